import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoforge.functions import columns as C
from clonoforge.functions.kernels import bounded, cdr3_distance, cdr3_distances, germline_distance, global_scores, k3_layers, k3_matrix, k3_pairs, seed_of, states
from clonoforge.functions.matrices import blosum62, encode, kernel_k1, mismatch_distances


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("table,p", [((12, 17, 3, 13), 0.01266384351683783), ((2, 2, 0, 8), 1 / 45)])
def test_fisher_one_sided(spark, table, p):
    assert one(spark, C.fisher(*map(F.lit, table))) == pytest.approx(p, rel=1e-9)


def test_fisher_large_and_two_sided(spark):
    assert one(spark, C.fisher(*map(F.lit, (12, 17, 3, 13)), two_sided=True)) == pytest.approx(0.02533, abs=1e-5)
    assert 0 < one(spark, C.fisher(*map(F.lit, (50, 383_632, 20, 576_562)))) < 1e-4
    assert one(spark, C.fisher(*map(F.lit, (5, 3, 0, 8)))) is None
    assert one(spark, C.odds_ratio(*map(F.lit, (15, 100, 20, 1000)))) == pytest.approx(8.647, abs=1e-3)


NUMBERS = [("123.45", 123.45), ("0", 0.0), ("abc", None), ("123abc", 123.0), ("123.45abc", 123.45), ("123.45.67", None), ("1..2", None), (">0.1", 0.1), (".", None), (None, None)]


def test_numbers_and_wells(spark):
    df = spark.createDataFrame(NUMBERS, "t string, n double").select("t", "n", C.first_number("t").alias("g"), C.clean_concentration("t").alias("c"))
    for r in df.collect():
        assert r.g == r.n, r.t
    assert one(spark, C.clean_concentration(F.lit(">0.1"))) is None and one(spark, C.clean_concentration(F.lit("<0.1"))) == 0.0
    assert [one(spark, C.well_id(F.lit(k))) for k in (0, 11, 12, 95)] == ["A1", "A12", "B1", "H12"]


FASTQ = {
    "sample01_S1_L001_R1_001.fastq.gz": ("sample01", 1, "L001", "R1"), "sample_01_with_underscores_S2_L002_R1_001.fastq": ("sample_01_with_underscores", 2, "L002", "R1"),
    "sample01_S1_L001_I2_001.fastq": ("sample01", 1, "L001", "I2"), "s_S1_L01_R1_001.fastq": None, "s_S1_L001_R3_001.fastq": None, "s_S1_L001_R1_002.fastq": None, "s_S1_L001_R1_001.fq.gz": None,
}


def test_fastq_names(spark):
    df = spark.createDataFrame([(k,) for k in FASTQ], "n string").select("n", *[c.alias(k) for k, c in C.fastq_parts("n").items()])
    for r in df.collect():
        assert (tuple(r[1:]) if r.sample_id else None) == FASTQ[r.n]


def test_sequence_functions(spark):
    assert one(spark, C.motif_region(F.lit("CASSIRSSYEQYF"))) == "SIRSSYE"
    assert [one(spark, C.trim_flanks(F.lit(x))) for x in ("CASSLGF", "CASW", "ASSLGF", "CASSLGA", "C")] == ["ASSLG", "AS", "ASSLGF", "CASSLGA", "C"]
    assert one(spark, C.default_allele(F.lit("TRBV19"))) == "TRBV19*01" and one(spark, C.default_allele(F.lit("TRAV12-2*02"))) == "TRAV12-2*02"
    assert one(spark, C.mark_hla(F.lit("DPA1*01:03/DPA1*02:01"), F.lit("DPA1*02:01"))) == "DPA1*01:03/DPA1*02:01!"
    assert set(one(spark, C.kmers(F.lit("ABA")))) == {"AB", "BA", "ABA"} and one(spark, C.kmers(F.lit(""))) == []
    assert [one(spark, C.strip_quotes(F.lit(x))) for x in ('"q"', "'s'", "'m\"", "''")] == ["q", "s", "'m\"", ""]
    assert [t.tag for t in one(spark, C.wildcard_tags(F.lit("AB")))] == ["%B", "A%"]


def plain_distance(a, b):
    d = mismatch_distances(blosum62())
    cost = lambda x, y: int(d[C.RESIDUES.index(x), C.RESIDUES.index(y)])
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) == len(b):
        return min(255, sum(cost(x, y) for x, y in zip(a[3:-2], b[3:-2], strict=True)))
    lo, hi = 5, len(short) - 5
    while lo > hi:
        lo, hi = lo - 1, hi + 1
    best = min(sum(cost(short[i], long[i]) for i in range(3, g)) + sum(cost(short[-1 - c], long[-1 - c]) for c in range(2, len(short) - g)) for g in range(lo, hi + 1))
    return min(255, best + 4 * (len(long) - len(short)))


def test_cdr3_distance():
    golden = [("CASSLGQETQYF", "CSRSLGQETQWY", 0), ("CASSLGQETQYF", "CASSPGQETQYF", 4), ("CASSLGQETQYF", "CASSLGGQETQYF", 4), ("CASSLGGQETQYF", "CASSLGQETQYF", 4)]
    for a, b, d in golden:
        assert cdr3_distance(a, b) == d
    rng = np.random.default_rng(3)
    for n, m in ((8, 8), (12, 12), (9, 12), (15, 11), (7, 20)):
        some = ["".join(rng.choice(list(C.RESIDUES), n)) for _ in range(6)]
        many = ["".join(rng.choice(list(C.RESIDUES), m)) for _ in range(5)]
        got = cdr3_distances(encode(some, n), encode(many, m))
        assert got.tolist() == [[plain_distance(a, b) for b in many] for a in some]
    assert germline_distance("MN.HEY", "MNAHEY") == 4


def plain_k3(a, b, most=30):
    k1 = kernel_k1().astype(float)
    total = 0.0
    for i in range(len(a)):
        for j in range(len(b)):
            p = 1.0
            for k in range(min(most, len(a) - i, len(b) - j)):
                p *= k1[C.RESIDUES.index(a[i + k]), C.RESIDUES.index(b[j + k])]
                total += p
    return total


def test_kernel():
    rng = np.random.default_rng(4)
    some = ["".join(rng.choice(list(C.RESIDUES), 9)) for _ in range(3)]
    many = ["".join(rng.choice(list(C.RESIDUES), 12)) for _ in range(4)]
    want = np.array([[plain_k3(a, b) for b in many] for a in some])
    x, y = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
    assert np.allclose(k3_pairs(encode(some, 9)[x], encode(many, 12)[y], cells=26), want.ravel())
    assert np.allclose(k3_layers(encode(many, 12)).sum(axis=1), [plain_k3(b, b) for b in many])
    long = ["".join(rng.choice(list(C.RESIDUES), 33)) for _ in range(2)]
    assert np.allclose(k3_matrix(encode(long, 33)[0], encode(long, 33)), [plain_k3(long[0], x) for x in long])


def plain_alignment(a, b, opening=7, extending=1):
    s = blosum62()
    low = -1e9
    h = {(0, 0): 0.0}
    e, f = {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            e[i, j] = max(h.get((i - 1, j), low) - opening, e.get((i - 1, j), low) - extending)
            f[i, j] = max(h.get((i, j - 1), low) - opening, f.get((i, j - 1), low) - extending)
            if (i, j) != (0, 0):
                diagonal = h[i - 1, j - 1] + s[C.RESIDUES.index(a[i - 1]), C.RESIDUES.index(b[j - 1])] if i and j else low
                h[i, j] = max(diagonal, e[i, j], f[i, j])
    return h[len(a), len(b)]


def test_alignment():
    rng = np.random.default_rng(6)
    many = ["".join(rng.choice(list(C.RESIDUES), 11)) for _ in range(6)]
    for n in (5, 11, 16):
        a = "".join(rng.choice(list(C.RESIDUES), n))
        assert global_scores(encode([a], n)[0], encode(many, 11)).tolist() == [plain_alignment(a, b) for b in many]


def test_random_stream():
    state, want = seed_of("x"), []
    for _ in range(50):
        state = (state * 6364136223846793005 + 1) & (1 << 64) - 1
        want.append(state * 37 >> 64)
    assert bounded(states(seed_of("x"), 50), 37).tolist() == want
    assert math.isclose(one_of_seed(), seed_of(""))


def one_of_seed():
    return 0xCBF29CE484222325


def test_factors_of_states_are_made_once(monkeypatch):
    from clonoforge.functions import kernels

    made = []
    monkeypatch.setattr(kernels.np, "cumprod", lambda *a, real=np.cumprod, **k: made.append(1) or real(*a, **k))
    for seed, n in ((3, 0), (5, 1), (1 << 63, 1000), (17, 40)):
        want, x = [], seed
        for _ in range(n):
            x = (x * int(kernels._MULTIPLIER) + 1) % (1 << 64)
            want.append(x)
        assert kernels.states(seed, n).tolist() == want
    assert len(made) <= 1
