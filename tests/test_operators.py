import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoforge.functions import kernels
from clonoforge.functions.matrices import blosum62
from clonoforge.operators import alignment, cells, distances, enrichment, graph, motifs, pipeline, scoring, similarity
from clonoforge.operators.distances import distance_pairs, edit_cutoff, hamming_pairs
from clonoforge.plans import pipelines
from clonoforge.sources import chains, files, plates
from tests.test_functions import plain_distance

# Invented cells: c1 has one chain of each kind, c2 two alphas and two betas, c3 no alpha, c4 no beta, c5 the chains of c1.
CONTIGS = """T1-Day0 c1 TRB TRBV3-1 TRBJ1-1 CASSAAQYF
T1-Day0 c1 TRA TRAV4 TRAJ10 CAVAAKLTF
T1-Day0 c2 TRB TRBV5 TRBJ2-2 CASSPPQYF
T1-Day0 c2 TRB TRBV6-1 TRBJ2-3 CASSRRQYF
T1-Day0 c2 TRA TRAV7 TRAJ20 CAVPPKLTF
T1-Day0 c2 TRA TRAV8-2 TRAJ21 CAVRRKLTF
T1-Day0 c3 TRB TRBV9 TRBJ1-5 CASSWWQYF
T1-Day0 c4 TRA TRAV9 TRAJ30 CAVWWKLTF
T1-Day0 c5 TRB TRBV3-1 TRBJ1-1 CASSAAQYF
T1-Day0 c5 TRA TRAV4 TRAJ10 CAVAAKLTF
T2-Day9 c1 TRB TRBV3-1 TRBJ1-1 CASSAAQYF"""


def test_pairing(spark):
    df = spark.createDataFrame([tuple(x.split()) for x in CONTIGS.splitlines()], "sample string, barcode string, chain string, v_gene string, j_gene string, cdr3 string")
    rows = cells.paired_clonotypes(df, keep_alpha=True).collect()
    got = {(r["sample"], r.CDR3b, r.CDR3a): r["count"] for r in rows}
    pairs = {("T1:Day0", f"CASS{b}QYF", f"CAV{a}KLTF"): 1 for b in ("PP", "RR") for a in ("PP", "RR")}
    assert got == pairs | {("T1:Day0", "CASSAAQYF", "CAVAAKLTF"): 2, ("T1:Day0", "CASSWWQYF", None): 1, ("T2:Day9", "CASSAAQYF", None): 1}


def test_splitting(spark):
    rows = [("CAVA;CAVG;CAVT", "CASSA", "TRAV1;TRAV2;TRAV3", "TRAJ1;TRAJ2;TRAJ3", "TRBV1", "TRBJ1", "one"), ("CAVS", "CASSG", "TRAV9", "TRAJ9", "TRBV2", "TRBJ2", "two")]
    df = spark.createDataFrame(rows, "CDR3a string, CDR3b string, TRAV string, TRAJ string, TRBV string, TRBJ string, sample string")
    out = cells.split_chains(df, "alpha").collect()
    assert [(r.CDR3a, r.TRAV, r.TRAJ, r["sample"]) for r in out] == [("CAVA", "TRAV1", "TRAJ1", "one"), ("CAVG", "TRAV2", "TRAJ2", "one"), ("CAVT", "TRAV3", "TRAJ3", "one"), ("CAVS", "TRAV9", "TRAJ9", "two")]
    ragged = df.withColumn("TRAV", F.lit("A;B;C"))
    with pytest.raises(Exception, match="differ in length"):
        cells.split_chains(ragged, "alpha").collect()
    assert cells.split_chains(ragged, "alpha", ragged="drop").count() == 3 and cells.ragged_rows(ragged, "alpha").count() == 1
    for columns in (["CDR3a", "CDR3b"], ["CDR3a", "CDR3b", "TRAV", "TRAJ", "TRBV", "TRBJ", "CTgeneA", "CTgeneB"], ["CDR3a", "CTgeneA", "CTgeneB"]):
        with pytest.raises(ValueError):
            cells.gene_style(columns)
    ids = spark.createDataFrame([("me:day 1", "x")], "`subject:condition` string, other string")
    assert cells.split_sample_id(ids).first().asDict() == {"other": "x", "subject": "me", "condition": "day 1"}


def test_chain_validation(spark):
    rows = [("S1", "a", "casslf", "CAXF", 2.0), ("S1", "a", "CAS*F", None, None), ("S2", "a", " CASSF ", "na", None)]
    df = spark.createDataFrame(rows, "subject string, condition string, beta string, alpha string, counts double")
    assert sorted(tuple(r) for r in chains.validate_chains(df).collect()) == [("S1", "a", "CASSLF", None, 2.0), ("S2", "a", "CASSF", None, 1.0)]
    with pytest.raises(Exception, match="chain record"):
        chains.validate_chains(df.withColumn("subject", F.lit(" "))).collect()
    assert chains.validate_chains(df.withColumn("counts", F.lit(-1.0)), "drop").count() == 0


def test_hla_fold(spark):
    cols = [f"{x}_{s}" for x in ("dpa1", "dpb1", "dqa1", "dqb1", "drb1", "drb345") for s in "lr"]
    row = ("P", "DPA1*01:03", "DPA1*02:01", "DPB1*04:01", "DPB1*04:01", "NA", "DQA1*05:01", "DQB1*02:01", "DQB1*03:02", "DRB1*15:01", "DRB1*04:03", "DRB3*02:02", "DRB4*01:03")
    out = chains.fold_hla(spark.createDataFrame([row], ", ".join(f"{c} string" for c in ["pid", *cols]))).first()
    assert list(out)[1:] == ["DPA1*01:03/DPA1*02:01", "DPB1*04:01", "DQA1*05:01", "DQB1*02:01/DQB1*03:02", "DRB1*15:01/DRB1*04:03", "DRB3*02:02", "DRB4*01:03", ""]


SNIFF = [("a\tb\n1\t2\n", "\t"), ("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a|b\n1|2\n", "|"), ('a\tb\n"x,y,z"\t2\n', "\t"), ("a;b,c;d\n1;2,3;4\n", ";"), ("a\n1\n2\n", None), ("", None), ("a,b\n1,2,3\n", None)]


@pytest.mark.parametrize("text,want", SNIFF)
def test_sniffing(text, want):
    assert files.sniff_separator(text.splitlines()) == want


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a;b\n1;x\n")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.txt")).collect()] == [(1, "x")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s_S1_L001_R1_001.fastq").write_text("hello")
    (tmp_path / "in" / "other.txt").write_text("x")
    assert [(r.file_name, r.md5) for r in files.scan_fastq(spark, str(tmp_path / "in")).collect()] == [("s_S1_L001_R1_001.fastq", "5d41402abc4b2a76b9719d911017c592")]
    body = '[[1,"term1",0.01,2.0,3.0,["gene1","gene2"],0.05],[2,"term2",NaN,1.0,2.0,["gene3"],0.1],[3]]'
    rows = files.enrichment_rows(spark.createDataFrame([(body,), ("[]",)], "b string"), "b", "lib").orderBy("rank").collect()
    assert [(r["rank"], r.term, r.p_value, r.overlap_genes, r.q_value) for r in rows] == [(1, "term1", 0.01, "gene1, gene2", 0.05), (2, "term2", 0.0, "gene3", 0.1)]
    line = "5 0.1 TGT CASSF TRBV1 . TRBJ1 TRBC c1 0".replace(" ", "\t")
    assert files.trust4_rows(spark.createDataFrame([(line,), ("#h",), (line.replace("TRB", "TRA"),)], "value string")).count() == 1


def test_plates():
    rows = [(1, 2), (2, 4), (5, 6), (7, 8)]
    assert plates.stride_groups(rows, 2) == [[(1, 2), (5, 6)], [(2, 4), (7, 8)]]


def test_distances_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = ["CASSLGQAYEQYF", "CASSPDRGNTEAFF", "CSARDRTGNGYTF"]
    pool = {"".join(c if rng.random() > 0.15 else rng.choice(list("ARNDQGILSTV")) for c in b) for b in base for _ in range(60)}
    df = spark.createDataFrame([(s,) for s in pool] + [(next(iter(pool)),), (None,), ("",)], "s string")
    want = {(a, b, plain_distance(a, b)) for a in pool for b in pool if a < b and plain_distance(a, b) <= 12}
    import clonoforge.operators.distances as D

    for steps in ((8000,) * 4, (0, 0, 0, 0)):  # without and with all signatures
        D.SIGNATURE_STEPS, old = steps, D.SIGNATURE_STEPS
        assert {(r.a, r.b, r.d) for r in distance_pairs(df, "s", 12, tile=16).collect()} == want
        D.SIGNATURE_STEPS = old
    near = {(a, b) for a in pool for b in pool if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2}
    assert {(r.a, r.b) for r in hamming_pairs(df, "s", 2).collect()} == near
    assert edit_cutoff(3, 3) == 36
    with pytest.raises(ValueError):
        edit_cutoff(30, 3)


EDGES = [(0, 1, 5), (0, 2, 200), (1, 2, 10), (3, 4, 20)]


def test_linkage(spark):
    df = spark.createDataFrame(EDGES, "i int, j int, d int")
    got = {(r.cutoff, r.v): r.component for r in graph.single_linkage(df, [4, 5, 10, 20]).collect()}
    assert got == {(5, 0): 0, (5, 1): 0, (10, 0): 0, (10, 1): 0, (10, 2): 0, (20, 0): 0, (20, 1): 0, (20, 2): 0, (20, 3): 3, (20, 4): 3}
    two = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3), (6, 7)]
    e = spark.createDataFrame([(a, b, 1) for a, b in two], "i int, j int, d int")
    kept = lambda o: {(r.i, r.j) for r in graph.shared_neighbour_edges(e, o).collect()}
    assert (2, 3) not in kept(0.5) and (2, 3) in kept(0.3) and (6, 7) in kept(0.5) and kept(0.0) == set(two)
    # A vertex of weight m is m equal records tied to each other.
    weights = {0: 2, 1: 1, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}
    copies = [(v, k) for v, m in weights.items() for k in range(m)]
    number = {c: i for i, c in enumerate(copies)}
    full = [(number[a], number[b], 1) for a in copies for b in copies if a < b and (a[0] == b[0] or (a[0], b[0]) in two)]
    expanded = {(copies[r.i][0], copies[r.j][0]) for r in graph.shared_neighbour_edges(spark.createDataFrame(full, "i int, j int, d int"), 0.45).collect()}
    w = spark.createDataFrame(list(weights.items()), "v int, m int")
    assert {(r.i, r.j) for r in graph.shared_neighbour_edges(e, 0.45, w).collect()} == {p for p in expanded if p[0] != p[1]}
    assert graph.components(df.limit(0)).count() == 0


def test_motif_statistics(spark):
    sample = spark.createDataFrame([("CASSIRSSYEQYF",), ("CASSLGQAYEQYF",)], "s string")
    reference = spark.createDataFrame([("CASSIRSTYEQYF",), ("CASSPGQAYEQYF",)], "s string")
    got = {r.motif: (r.n_sample, r.fold) for r in enrichment.motif_statistics(sample, reference).collect()}
    assert {k: got[k][0] for k in ("SIRS", "SS", "GQA", "YE")} == {"SIRS": 1, "SS": 1, "GQA": 1, "YE": 2} and got["GQA"][1] == pytest.approx(1 / 1.01)


def test_singles_and_numbers(spark):
    records = spark.createDataFrame([(x,) for x in "ABAAC"], "beta string")
    members = spark.createDataFrame([("1", "A"), ("1", "C")], "cid string, s string")
    reference = spark.createDataFrame([(x,) for x in "PQRSTUVWXY"], "s string")
    assert {r.pattern: r.n_records for r in enrichment.single_clusters(records, "beta", reference, members).collect()} == {"A": 3, "B": 1}


def test_motifs():
    assert motifs.representative_motif(["CASSIRSSYEQYF", "CASSIRSSYEQYF"]).consensus == "SIRSSYE"
    alike = ["CAAAGSYGAAA", "CAAAGGYGAAA", "CAAAGAYGAAA"]
    found = motifs.best_motif(alike, 4, blosum62())
    assert found.support >= 2 and len(found.consensus) == 4
    assert motifs.representative_motif(["CASSAAAAAEQYF", "CASSWWWWWEQYF", "CASSKKKKKEQYF"]) is None


def test_scores(spark):
    assert scoring.expansion_score([1] * 7, np.log1p(np.ones(50)), 100, "expansion:x") == 1.0
    share = scoring.expansion_score([100, 100], np.log1p([1, 1, 100, 100]), 4000, "expansion:y")
    assert abs(share - 1 / 6) < 0.05
    assert scoring.composition_score([], [1.0], 10, "x") == 1.0
    assert scoring.composition_score(["a"] * 6, [0.5, 0.5], 1000, "length:p", older=True) < 0.1
    loci = {c: "" for c in chains.LOCI}
    people = [(f"s{k}", "A*1" if k < 2 else "A*2") for k in range(10)] + [("untyped", "")]
    hla = spark.createDataFrame([(s, *[a if c == "dpa1" else "" for c in loci]) for s, a in people], "subject string, " + ", ".join(f"{c} string" for c in loci))
    tests = scoring.hla_tests(spark.createDataFrame([("c", "s0"), ("c", "s1"), ("d", "untyped")], "cid string, subject string"), "cid", hla)
    assert [(r.allele, round(r.p, 12)) for r in tests.collect()] == [("A*1", round(1 / 45, 12))]
    best = {r.cid: (r.hla_score, r.hits) for r in scoring.hla_scores(tests, spark.createDataFrame([("c",), ("d",)], "cid string"), "cid").collect()}
    assert best["d"] == (1.0, []) and best["c"][1] == ["dpa1:A*1"]
    assert scoring.nearest_size([125, 250, 500], 240) == 1


def test_similarity(spark):
    inputs = similarity.usable(spark.createDataFrame([("CASSLGF",), ("",), ("CF",), (None,), ("CAS1F",)], "s string"), "s")
    base = spark.createDataFrame([("ASSLG", "g", "e", "a", "o")] * 2, "sequence string, receptor_group string, epitope string, antigen string, organism string")
    pairs = similarity.similar_pairs(inputs, base, 0.9)
    assert [(r.sequence, r.match, round(r.score, 6)) for r in pairs.collect()] == [("ASSLG", "ASSLG", 1.0)]
    assert similarity.annotate(inputs, pairs, base).count() == 4 and similarity.annotate(inputs, pairs, base, True).count() == 2
    with pytest.raises(ValueError):
        similarity.similar_pairs(inputs, base, 1.5)


def test_alignment_groups(spark):
    rows = [("p", 1, "A;B;;", "CASSF"), ("p", 1, "B;C", "CASWF"), ("single", 2, "CASSF;CASF", "CASSF;CAF"), ("q", 3, None, "CASSF;CASWF"), ("r", 4, " A ;A; ;A ", "CASSF")]
    df = spark.createDataFrame(rows, "pattern string, cluster_index bigint, tcra string, tcrb string")
    groups = alignment.groups_of(df)
    assert {r.pattern: r.alphas for r in groups.collect()} == {"p": ["A", "B", "C"], "single": ["CASF", "CASSF"], "q": None, "r": ["A"]}
    out = {r.pattern: r for r in alignment.score_groups(groups, ["CASSF", "CAF"], 5).collect()}
    assert math.isnan(out["single"].tcrb_score) and math.isnan(out["q"].tcra_score) and not math.isnan(out["q"].tcrb_score)
    assert math.isnan(out["r"].tcra_score) and out["r"].tcra_v_background == -1.0 and 0 <= out["p"].tcra_v_background <= 1
    assert math.isnan(alignment.mean_score(["CASSF"]))
    with pytest.raises(ValueError):
        alignment.mean_score([])


def family(cdr3, v, alpha, va):
    return [(cdr3[:5] + r + cdr3[6:], v, alpha, va) for r in "AGSTND"]


def test_pipelines(spark):
    chains_ = family("CASSLGQAYEQYF", "TRBV7-9", "CAVRDSNYQLIW", "TRAV12-2") + family("CASSPDRGNTEAFF", "TRBV6-5", "CAMREGGSQGNLIF", "TRAV14/DV4") + [("CASSWWWWWWWEQYF", "TRBV1", None, None)]
    rows = [(k, f"s{k % 5}", "x", b, a, v, "J", va, "JA", 1.0 + k % 3) for k, (b, v, a, va) in enumerate(chains_)]
    records = spark.createDataFrame(rows, "rid bigint, subject string, condition string, beta string, alpha string, v_gene string, j_gene string, va_gene string, ja_gene string, counts double")
    rng = np.random.default_rng(1)
    reference = spark.createDataFrame([("CASS" + "".join(rng.choice(list("ARNDQGHKPSTY"), 6)) + "EQYF",) for _ in range(300)], "s string")
    hla = spark.createDataFrame([(f"s{k}", *["A*1"] * 8) for k in range(5)], "subject string, " + ", ".join(f"{c} string" for c in chains.LOCI))
    genes = spark.createDataFrame([("TRBV7-9", 0.5), ("TRBV6-5", 0.5)], "gene string, freq double")
    rep = pipeline.Repertoire(reference, genes, sizes={100: [0.5, 0.2]})
    for out in (pipeline.run_motif_clustering(records, rep, hla, simulations=20), pipeline.run_distance_clustering(records, rep, hla, edits=1, simulations=20)):
        assert tuple(out.columns) == pipeline.OUTPUT_COLUMNS
        got = out.collect()
        assert {r.tcrb for r in got} == {b for b, *_ in chains_}
        assert max(r.number_unique_cdr3 for r in got) == 6 and all(0 < r.final_score <= 1 for r in got)
    with pytest.raises(ValueError):
        pipeline.run_motif_clustering(records, pipeline.Repertoire(reference.limit(3), genes), hla)


def test_older_method_takes_motifs_by_simulation(spark):
    own = [f"CAS{a}WWWW{b}TQYF" for a, b in ("GA", "GD", "GE", "DH", "DK")] + [f"CASQ{a}HMHM{b}QYF" for a, b in ("RG", "SD")]
    sample = spark.createDataFrame([(s,) for s in own], "s string")
    filler = [f"CASS{a}{b}{c}{e}TEAFF" for a in "ADEGHILN" for b in "PQRSTVAY" for c in "ADEGHILN" for e in "PQRSTV"]
    reference = spark.createDataFrame([(s,) for s in [*filler, "CASVWWWWNTQYF"]], "s string")
    tests = {r.motif: (r.p, r.ratio) for r in enrichment.simulated_motifs(sample, reference).collect()}
    assert tests["HMHM"] == (0.001, 1 / (1000 * 7)) and tests["WWWW"][0] == 0.001 and tests["WWWW"][1] > 100
    # WWWW stands once in the reference and ties its five sequences; HMHM is absent and ties none.
    _, members = enrichment.network_clusters(sample, reference, 200)
    assert sorted(r.s for r in members.collect()) == sorted(own[:5])


def test_joint_distance_modes(spark):
    betas, alphas, genes = ["CASSLGTDTQYF", "CASSLATDTQYF", "CASSLGGTDTQYF"], ["CAVRDSNYQLIF", "CAVKDSNYQLIF", "CAVRDSNNYQLIF"], ["V1*01", "V2*01"]
    rows = [(f"{b}|{a}|{v}|{w}", b, a, v, w) for b in betas for a in alphas for v in genes for w in genes]
    vertices = spark.createDataFrame(rows, "v string, beta string, alpha string, vb string, va string")
    table = spark.createDataFrame([("V1*01", "AAAAA.A", "AAA..AA", "AAAAAA"), ("V2*01", "AAAAA.W", "AAA..AA", "AAAAAA")], "gene string, cdr1 string, cdr2 string, pmhc string")
    step = {(x, y): 0 if x == y else 4 for x in genes for y in genes}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                total = 3 * (plain_distance(x[1], y[1]) + plain_distance(x[2], y[2])) + step[x[3], y[3]] + step[x[4], y[4]]
                if total <= 24:
                    want[x[0], y[0]] = total
    got = distances.joint_pairs(vertices, 24, True, table, cdr3_weight=3, tile=5).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.d for r in got} == want
    plain = distances.joint_pairs(vertices.select("beta", "alpha").distinct().withColumn("v", F.concat_ws("|", "beta", "alpha")), 4, True).collect()
    pairs = [f"{b}|{a}" for b in betas for a in alphas]
    near = {(x, y) for x in pairs for y in pairs if x < y and sum(plain_distance(p, q) for p, q in zip(x.split("|"), y.split("|"), strict=True)) <= 4}
    assert {(r.i, r.j) for r in plain} == near


def test_distance_clusters_part_unlike_alphas(spark):
    rows = [(0, "CASSLGTDTQYF", "CAVRDSNYQLIF"), (1, "CASSLATDTQYF", "CAVRDSNYQLIF"), (2, "CASSLVTDTQYF", "CWWWWHHHHMMMMKKKLIF"), (3, "CASSLITDTQYF", None)]
    records = spark.createDataFrame([(r, f"p{r}", "x", b, a, "TRBV1" if r else "TRBV9", "TRBJ1", "TRAV1", "TRAJ1", 1.0) for r, b, a in rows], "rid long, subject string, condition string, beta string, alpha string, v_gene string, j_gene string, va_gene string, ja_gene string, counts double")
    one = records.filter("alpha IS NULL")
    assert pipeline.infer_mode(records) == "alpha-beta" and pipeline.infer_mode(one) == "beta"
    germline = spark.createDataFrame([("TRBV1*01",), ("TRAV1*01",)], "gene string")
    kept = lambda m: sorted(r.rid for r in pipeline.usable_records(records, pipeline.MODES[m], germline).collect())
    assert [kept(m) for m in pipeline.MODES] == [[0, 1, 2, 3], [1, 2, 3], [0, 1, 2], [1, 2]]
    rep = pipeline.Repertoire(spark.createDataFrame([(f"CASS{a}{b}TEAFF",) for a in "ADEGH" for b in "PQRST"], "s string"), spark.createDataFrame([("TRBV1", 0.5), ("TRBV9", 0.5)], "gene string, freq double"))
    hla = spark.createDataFrame([("p0", *[""] * 8)], "subject string, " + ", ".join(f"{x} string" for x in chains.LOCI))
    got = pipeline.run_distance_clustering(records, rep, hla, edits=2, simulations=20, mode=None).collect()
    together = {}
    for r in got:
        together.setdefault(r["index"], set()).add(r.tcrb)
    assert sorted(map(sorted, together.values())) == [["CASSLATDTQYF", "CASSLGTDTQYF"], ["CASSLVTDTQYF"]]


def test_queries_simulate_as_in_production(spark, monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from clonoforge.plans import analysis, pipelines

    asked = []
    for name in ("run_motif_clustering", "run_distance_clustering"):
        real = inspect.signature(getattr(pipelines, name))

        def record(*args, real=real, **named):
            bound = real.bind(*args, **named)
            bound.apply_defaults()
            asked.append(bound.arguments["simulations"])

        monkeypatch.setattr(pipelines, name, record)
    score = inspect.signature(scoring.composition_scores)

    def composition(*args):
        bound = score.bind(*args)
        bound.apply_defaults()
        asked.append(bound.arguments["simulations"])

    monkeypatch.setattr(analysis.S, "composition_scores", composition)
    for module in (pipelines, analysis):
        monkeypatch.setattr(module, "I", MagicMock())
        monkeypatch.setattr(module, "table", MagicMock())
    monkeypatch.setattr(pipelines, "cut", MagicMock())
    monkeypatch.setattr(analysis, "_clusters", MagicMock())
    analysis.I.reference.return_value.count.return_value = 2
    for query in (pipelines.QUERIES["gliph2_full"], pipelines.QUERIES["gliph1_full"], pipelines.QUERIES["tcrdist_full"], pipelines.QUERIES["tcrdist_full_single"], analysis.length_score_mc, analysis.v_score_mc):
        query(spark, "")
    assert asked == [1000] * 6


def test_group_background_uses_the_whole_pool(spark, monkeypatch):
    from clonoforge.plans import analysis

    pool = [f"CA{a}{b}DSNYQLIF"[: 10 + n % 3] for n, (a, b) in enumerate((x, y) for x in "ADEGH" for y in "KLMN")]
    monkeypatch.setattr(alignment.PoolScores, "KEPT", 5)
    drawn = np.array([[0, 3, 7, 11], [19, 2, 4, 5]])
    assert alignment.PoolScores(pool).means(drawn).tolist() == [alignment.mean_score([pool[i] for i in row]) for row in drawn]
    for k in (3, 17):  # one by one, and as products of matrices
        many = alignment.samples_without_replacement(40, k, 5, 30)
        twice = alignment.PoolScores([*pool, *(x[::-1] for x in pool)], kept=40)
        assert twice.means(many).tolist() == [alignment.mean_score([(pool + [x[::-1] for x in pool])[i] for i in row]) for row in many]
    rows = spark.createDataFrame([("p", k // 4, pool[k], "CASSF") for k in range(20)], "pattern string, cluster_index long, tcra string, tcrb string")
    monkeypatch.setattr(analysis, "table", lambda *_: rows)
    asked = {}
    monkeypatch.setattr(analysis.A, "score_groups", lambda groups, pool, replicates, keys: asked.update(pool=pool, replicates=replicates))
    analysis.QUERIES["group_alignment"](spark, "")
    assert asked == {"pool": sorted(set(pool)), "replicates": 1000} and "group_background" in analysis.QUERIES


def test_expansion_background_as_histogram():
    values, times = np.log1p([1, 2, 50, 4000]), np.array([300, 40, 5, 1])
    for k, own in enumerate(([1, 1, 2], [50, 1], [2] * 20)):
        assert scoring.expansion_score(own, values, 300, f"h{k}", times) == scoring.expansion_score(own, np.repeat(values, times), 300, f"h{k}")
    # Nearly all of a large repertoire's clones have count 1; a list of its different sizes would give about 1.
    assert scoring.expansion_score([5, 5], values, 1000, "large", np.array([40_000_000, 10, 5, 1])) == 0.001


def test_components_by_contraction(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(4000, 4300)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "i int, j int")).collect()}
    assert got == {v: root(v) for v in parent}


def test_numbers_are_dense_and_in_order(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{k}", f"p{rng.integers(0, 9)}", ["local", "global", "single"][k % 3], float(rng.integers(0, 5)) / 5) for k in range(500)]
    df = spark.createDataFrame(rows, "cid string, pattern string, kind string, p double").repartition(7)
    got = [r.cid for r in enrichment.number_clusters(df).orderBy("index").collect()]
    assert got == [c for c, *_ in sorted(rows, key=lambda r: (r[3], r[1], ["local", "global", "single"].index(r[2]), r[0]))]
    assert [r["index"] for r in enrichment.number_clusters(df).orderBy("index").collect()] == list(range(1, 501))
    assert enrichment.number_clusters(df.limit(0)).count() == 0


def test_large_clusters_have_the_same_motif(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(6):
        core = "".join(rng.choice(list("ADGHLPRST"), 6))
        for _ in range(14):
            own = list(core)
            if rng.random() < 0.7:
                own[rng.integers(0, 6)] = rng.choice(list("ADGHLPRST"))
            rows.append((c, "CAS" + rng.choice(list("GAST")) + "".join(own) + "TQYF"))
    rows += [(6, "".join(["CAS", *rng.choice(list("ADGHKLMPRSTVWY"), 9), "QYF"])) for _ in range(9)] + [(7, "CASSF"), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "cluster int, s string")
    one, two = (sorted(map(tuple, motifs.cluster_motifs(df, "cluster", "s", small=n).collect())) for n in (10_000, 1))
    assert one == two and [r for r in one if r[0] == 6][0][1] is None and sum(r[1] is not None for r in one) >= 7


def test_patterns_of_very_many_shapes(spark):
    text = "ADEGHIKLMNPQRSTVWY" * 4
    sequence = "CAS" + text + "QYF"
    patterns = sorted({text[3 : 3 + k][:w] + "%" + text[3 : 3 + k][w + 1 :] for k in range(20, 66) for w in range(k)} | {"no motif found", text[5:9], "WWW%"})
    assert len({(len(p), p.find("%")) for p in patterns}) > 1000
    one = spark.createDataFrame([(sequence,)], "s string")
    other = spark.createDataFrame([("CASSLGQAYEQYF",)] * 9, "s string")
    got = {r.pattern: r.p for r in pipeline.pattern_fisher(spark.createDataFrame([(p,) for p in patterns], "pattern string"), one, other).collect()}
    assert {p for p, x in got.items() if x == pytest.approx(0.1)} == set(patterns) - {"no motif found", "WWW%"} and got["no motif found"] == got["WWW%"] == 1.0


def test_similar_pairs_against_all_pairs(spark, monkeypatch):
    from clonoforge.functions.kernels import k3_matrix
    from clonoforge.functions.matrices import encode

    rng = np.random.default_rng(9)
    base = ["ASSLGQAYEQY", "ASSPDRGNTEAF", "SARDRTGNGYT", "A" * 33]
    pool = sorted({"".join(c if rng.random() > 0.1 else rng.choice(list("ARNDQGILSTV")) for c in b)[rng.integers(0, 2) :] for b in base for _ in range(25)})
    k3 = lambda a, b: k3_matrix(encode([a], len(a))[0], encode([b], len(b)))[0]
    want = {(a, b) for a in pool for b in pool if k3(a, b) / math.sqrt(k3(a, a) * k3(b, b)) > 0.9}
    df = spark.createDataFrame([(s,) for s in pool], "sequence string")
    for block in (10_000, 30):
        got = similarity.similar_pairs(df, df, 0.9, block).collect()
        assert {(r.sequence, r.match) for r in got} == want and len(got) == len(want)
    assert len(pool) < len(want) < len(pool) ** 2 / 2


def test_samples_without_replacement():
    drawn = alignment.samples_without_replacement(9, 6, 77, 400)
    assert drawn.shape == (400, 6) and all(len(set(row)) == 6 and set(row) <= set(range(9)) for row in drawn.tolist())
    assert abs(np.bincount(drawn.ravel(), minlength=9) - 400 * 6 / 9).max() < 60
    assert (alignment.samples_without_replacement(9, 6, 77, 3) == drawn[:3]).all() and (alignment.samples_without_replacement(9, 6, 77, 400, few=0) == drawn).all()
    groups = [["CASSF", "CAWSSF", "CAF"], ["CASSF"], [], ["CASSLF", "CASSWF"]]
    means = alignment.mean_scores(groups, pairs=2)
    assert np.isnan(means[1:3]).all() and [means[0], means[3]] == [alignment.mean_score(groups[0]), alignment.mean_score(groups[3])]


def test_repertoire_counts_are_not_rounded(spark):
    df = spark.createDataFrame([("A", 1.6), ("A", 0.2), ("A", None), ("B", 2.25)], "beta string, counts double")
    assert {r.beta: r.n for r in scoring.repertoire_counts(df).collect()} == {"A": 3.6, "B": 2.25}


def test_checkpoint_folder_of_a_cluster_must_be_named(monkeypatch):
    from unittest.mock import MagicMock

    from clonoforge import session

    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.getConf.return_value.get.return_value = None
    spark.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value.isDefined.return_value = False
    spark.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(spark)


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "CAAF;CAVF", "CASF"), ("c2", "CAAF", None)], "cell_id string, cdr3a string, cdr3b string")
    rows.repartition(2).write.parquet(str(tmp_path / "cells_trvj.parquet"))
    got = {tuple(r) for r in pipelines.stream_values(spark, str(tmp_path)).collect()}
    assert got == {("cdr3a", 1, 2), ("cdr3a", 2, 1), ("cdr3b", 1, 1)}


def _shipped_members(monkeypatch) -> list[int]:
    """Counts, once they are read, how many members of lists go to tasks."""
    seen, plain = [], distances.spread

    def counted(df, *columns):
        seen.append(df.agg(F.coalesce(F.sum(F.size("m1") + F.size("m2")), F.lit(0))).first()[0])
        return plain(df, *columns)

    monkeypatch.setattr(distances, "spread", counted)
    return seen


def _random_chains(n: int, seed: int) -> list[str]:
    draw = np.random.default_rng(seed)
    return ["C" + "".join(draw.choice(list("ADEGHILNPQRSTVWY"), draw.integers(9, 15))) + "F" for _ in range(n)]


def _far_genes(spark, n: int):
    return spark.createDataFrame([(f"V{k}*01", x * 7, x * 7, x * 6) for k, x in enumerate("AWDGKF"[:n])], "gene string, cdr1 string, cdr2 string, pmhc string")


def test_beta_alleles_far_apart_never_meet(spark, monkeypatch):
    rows = [(f"{b}|V{k // 3 % 5}*01", b, f"V{k // 3 % 5}*01") for k, b in enumerate(x for s in _random_chains(60, 1) for x in (s, s[:5] + "A" + s[6:], s[:5] + s[6:]))]
    vertices = spark.createDataFrame(rows, "v string, beta string, vb string").distinct()
    seen, held = _shipped_members(monkeypatch), vertices.count()
    got = {(r.i, r.j): r.d for r in distances.joint_pairs(vertices, 24, genes=_far_genes(spark, 5), cdr3_weight=3).collect()}
    assert sum(seen) <= 2 * held
    want = {(x[0], y[0]): d for x in rows for y in rows if x[0] < y[0] and x[2] == y[2] and (d := 3 * plain_distance(x[1], y[1])) <= 24}
    assert got == want and want


def test_two_chains_and_alleles_ship_few(spark, monkeypatch):
    near = [(x, y) for s, t in zip(_random_chains(40, 2), _random_chains(40, 3), strict=True) for x, y in ((s, t), (s[:5] + "A" + s[6:], t), (s, t[:6] + t[7:]))]
    rows = [(f"{b}|{a}|V{k % 3}*01|V{k % 2}*01", b, a, f"V{k % 3}*01", f"V{k % 2}*01") for p, (b, a) in enumerate(near) for k in (p // 3, p)]
    vertices = spark.createDataFrame(rows, "v string, beta string, alpha string, vb string, va string").distinct()
    seen, held = _shipped_members(monkeypatch), vertices.count()
    got = {(r.i, r.j): r.d for r in distances.joint_pairs(vertices, 24, True, _far_genes(spark, 3), cdr3_weight=3).collect()}
    assert sum(seen) <= 2 * held
    want = {(x[0], y[0]): d for x in rows for y in rows if x[0] < y[0] and x[3:] == y[3:] and (d := 3 * (plain_distance(x[1], y[1]) + plain_distance(x[2], y[2]))) <= 24}
    assert got == want and want


def test_two_chains_meet_by_the_nearer_one(spark, monkeypatch):
    near = [(x, y) for s, t in zip(_random_chains(60, 4), _random_chains(60, 5), strict=True) for x, y in ((s, t), (s[:5] + "A" + s[6:], t), (s, t[:6] + t[7:]), (s[:5] + s[6:], t[:6] + "W" + t[7:]))]
    rows = sorted({(f"{b}|{a}", b, a) for b, a in near})
    vertices = spark.createDataFrame(rows, "v string, beta string, alpha string")
    seen = _shipped_members(monkeypatch)
    got = distances.joint_pairs(vertices, 12, True, tile=3).collect()
    assert sum(seen) <= 16 * len(rows)
    want = {(x[0], y[0]): d for x in rows for y in rows if x[0] < y[0] and (d := plain_distance(x[1], y[1]) + plain_distance(x[2], y[2])) <= 12}
    assert len(got) == len(want) and {(r.i, r.j): r.d for r in got} == want


def test_joint_distance_query_ships_lists_of_near_alleles(spark, monkeypatch, tmp_path):
    from clonoforge.plans import analysis

    monkeypatch.setattr(analysis.I, "germline", lambda *_: _far_genes(spark, 5))
    own = [(b, f"V{k // 3 % 5}") for k, b in enumerate(x for s in _random_chains(60, 1) for x in (s, s[:5] + "A" + s[6:], s[:5] + s[6:]))]
    monkeypatch.setattr(analysis.I, "chains", lambda *_: spark.createDataFrame([*own, own[0]], "beta string, v_gene string"))
    seen = _shipped_members(monkeypatch)
    got = {(r.a, r.v1, r.b, r.v2): r.d for r in analysis.joint_distance(spark, str(tmp_path)).collect()}
    assert sum(seen) <= 2 * len(own)
    named = sorted({(b, f"{v}*01") for b, v in own})
    assert got == {(*x, *y): d for x in named for y in named if x < y and x[1] == y[1] and (d := 3 * plain_distance(x[0], y[0])) <= 36} and got


def _compared(monkeypatch, own: list[str], base: list[str]) -> tuple[int, set]:
    """How many pairs a search compares exactly, and its matches."""
    seen, plain = [], similarity.k3_pairs
    monkeypatch.setattr(similarity, "k3_pairs", lambda a, b: seen.append(len(a)) or plain(a, b))
    basis = similarity._basis(base)
    one, two = (similarity.Side(x, *similarity._profiles(x, basis)) for x in (own, base))
    found = {(one.names[i], two.names[j]) for x, y, _ in one.matches(two, similarity.THRESHOLD) for i, j in zip(x, y, strict=True)}
    return sum(seen), found


def test_few_pairs_are_compared_exactly(monkeypatch):
    pool = [f"AS{x[1:-1]}EQY" for x in _random_chains(300, 6)]
    compared, found = _compared(monkeypatch, pool, pool)
    assert compared < 0.05 * len(pool) ** 2 and {(x, x) for x in pool} <= found


def test_profiles_bound_scores():
    pool = [x[1:-1] for x in _random_chains(60, 7)] + ["A" * 33, "AG" * 17, "W", "CA", "ASSLG"]
    basis = similarity._basis(pool[:40])
    norms, profiles = similarity._profiles(pool, basis)
    for i, a in enumerate(pool):
        for j, b in enumerate(pool):
            score = similarity.k3_pairs(similarity.encode([a], len(a)), similarity.encode([b], len(b)))[0] / (norms[i] * norms[j])
            assert profiles[i] @ profiles[j] >= score - 1e-4


def test_unlike_database_is_hardly_compared(monkeypatch):
    own, base = [f"AS{x[1:-1]}EQY" for x in _random_chains(100, 8)], [f"AS{x[1:-1]}EQY" for x in _random_chains(300, 9)]
    compared, found = _compared(monkeypatch, own, [*base, own[0]])
    assert compared < 0.05 * len(own) * len(base) and (own[0], own[0]) in found


def test_small_cutoffs_part_tiles_by_all_classes(spark, monkeypatch):
    texts = sorted({x for s in _random_chains(60, 10) for x in (s, s[:5] + "G" + s[6:], s[:5] + s[6:], s[:4] + "V" + s[5:])})
    monkeypatch.setattr(distances, "SIGNATURE_STEPS", (100, 10_000, 10_000, 10_000))
    seen = _shipped_members(monkeypatch)
    got = {(r.a, r.b): r.d for r in distance_pairs(spark.createDataFrame([(s,) for s in texts], "s string"), "s", 6).collect()}
    assert sum(seen) and got == {(a, b): d for a in texts for b in texts if a < b and (d := plain_distance(a, b)) <= 6}


def _shares(groups: dict, pool: list[str], replicates: int) -> dict:
    """The background's share of each group with a mean, every replicate aligned by itself."""
    out = {}
    for (pattern, index), own in groups.items():
        drawn = alignment.samples_without_replacement(len(pool), len(own), alignment.seed_of(f"{pattern}|{index}"), replicates)
        out[pattern, index] = sum(alignment.mean_score([pool[i] for i in row]) > alignment.mean_score(own) for row in drawn) / replicates
    return out


def test_scores_of_a_pool_are_made_once(spark, monkeypatch):
    pool = sorted(set(_random_chains(300, 3)))
    codes = [alignment.encode([s], len(s))[0] for s in pool[:20]]
    for many in (s for s in pool if len(s) in (10, 15)):
        assert (alignment.scores_against(codes, alignment.encode([many], len(many)))[:, 0] == [kernels.global_scores(x, alignment.encode([many], len(many)))[0] for x in codes]).all()
    groups = {("p", 0): pool[:3], ("p", 1): pool[7:207], ("q", 2): pool[20:60]}
    monkeypatch.setattr(alignment.PoolScores, "KEPT", 5)
    # Where the pool's scores are stored no task aligns pairs of it again.
    monkeypatch.setattr(alignment.PoolScores, "table", lambda self: self.known)
    rows = spark.createDataFrame([(*k, v, None) for k, v in groups.items()], "pattern string, cluster_index long, alphas array<string>, betas array<string>")
    got = {(r.pattern, r.cluster_index): r.tcra_v_background for r in alignment.score_groups(rows, pool, 20).collect()}
    assert got == _shares(groups, pool, 20)


def test_group_background_aligns_no_betas(spark, monkeypatch):
    from clonoforge.plans import analysis

    pool = sorted(set(_random_chains(60, 4)))
    rows = spark.createDataFrame([("p", k % 7, pool[k], pool[-k]) for k in range(60)] + [("p", 9, None, "CASSF")], "pattern string, cluster_index long, tcra string, tcrb string")
    monkeypatch.setattr(analysis, "table", lambda *_: rows)
    given, scored = [], alignment.score_groups
    monkeypatch.setattr(analysis.A, "score_groups", lambda groups, *rest: given.append(groups) or scored(groups, *rest))
    key = lambda df: {(r.pattern, r.cluster_index): str(r.tcra_v_background) for r in df.collect()}
    assert key(analysis.QUERIES["group_background"](spark, "")) == key(analysis.QUERIES["group_alignment"](spark, "")) and len(pool) == 60
    assert not any(r.betas for r in given[0].collect()) and any(r.betas for r in given[1].collect())


def test_stored_tables_leave_no_shuffle_files(spark, monkeypatch):
    from clonoforge import session

    held, key = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size(), session._CLEANUP
    before, files = spark.conf.get(key), held()
    kept = session.cut(spark.range(1000).repartition(3).groupBy("id").count().repartition(2))
    assert kept.count() == 1000 and spark.conf.get(key) == before
    # Only the count's own shuffle may stay: data, index and checksum of each of its two tasks.
    assert held() - files <= 6


def test_few_values_are_not_counted_by_reference_value(monkeypatch):
    weights = np.random.default_rng(5).random(60)
    cases = [(k, own, older) for k in range(1, 25) for own in ([7] * k, list(range(k)), [0, 1] * (k // 2) + [2] * (k % 2)) for older in (False, True)]
    counted = []
    monkeypatch.setattr(scoring.np, "bincount", lambda *a, real=np.bincount, **k: counted.append(1) or real(*a, **k))
    few = [scoring.composition_score(own, weights, 500, f"v:{k}", older) for k, own, older in cases]
    assert not counted
    monkeypatch.setattr(scoring, "FEW", 1)
    assert few == [scoring.composition_score(own, weights, 500, f"v:{k}", older) for k, own, older in cases] and counted


def test_hla_tests_move_members_only(spark, monkeypatch):
    loci = [*scoring.LOCI]
    hla = spark.createDataFrame([(f"s{k}", *[f"A*0{k % 3}/A*0{k % 4}" if n < 2 and k % 5 else "" for n in range(len(loci))]) for k in range(30)], ["subject", *loci])
    members = spark.createDataFrame([(f"c{k % 4}", f"s{k * k % 30}") for k in range(60)], ["cid", "subject"])
    key = lambda df: sorted(map(tuple, df.collect()))
    tests = scoring.hla_tests(members, "cid", hla)
    plan = tests._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not any("allele" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "cluster" in x)
    small = key(tests)
    monkeypatch.setattr(scoring, "MOST_TYPED", 1)
    assert small and key(scoring.hla_tests(members, "cid", hla)) == small


def test_linkage_of_distance_clusters_holds_numbers(spark, monkeypatch):
    rows = [(k, "s", "c", beta, alpha, "V1", "J1", "V2", "J2", 1.0) for k, (beta, alpha) in enumerate((b, a) for x, a in zip(_random_chains(12, 6), _random_chains(12, 7), strict=True) for b in (x, x[:5] + "A" + x[6:], x[:5] + "W" + x[6:]))]
    records = spark.createDataFrame(rows, "rid long, subject string, condition string, beta string, alpha string, v_gene string, j_gene string, va_gene string, ja_gene string, counts double")
    seen, kept = [], {}
    for name, plain in (("shared_neighbour_linkage", pipeline.shared_neighbour_linkage), ("single_linkage", pipeline.single_linkage)):
        monkeypatch.setattr(pipeline, name, lambda pairs, *rest, plain=plain: seen.append(dict(pairs.dtypes)) or plain(pairs, *rest))
    monkeypatch.setattr(pipeline, "output_rows", lambda valid, records, clusters, by_record, *_: by_record)
    monkeypatch.setattr(pipeline, "pattern_fisher", lambda patterns, *_: patterns.withColumn("p", F.lit(1.0)))
    for method in ("shared-neighbour", "single-linkage"):
        repertoire = pipeline.Repertoire(records.select(F.col("beta").alias("s")), records)
        kept[method] = pipeline.run_distance_clustering(records, repertoire, records, method=method, mode="alpha-beta").collect()
    assert all(x == {"i": "bigint", "j": "bigint", "d": "int"} for x in seen) and len(seen) == 2
    for own in kept.values():  # a cluster is still named by its least vertex
        for cid in {r.cid for r in own if not r.cid.startswith("single")}:
            assert cid.split("|", 1)[1] == min(f"{rows[r.rid][3]}|{rows[r.rid][4]}" for r in own if r.cid == cid)


def _least_ends(edges) -> dict:
    """The least vertex of each vertex's component, by plain renaming."""
    label = {v: v for e in edges for v in e}
    for a, b in edges:
        one, two = sorted((label[a], label[b]))
        label = {v: one if x == two else x for v, x in label.items()}
    return label


def test_single_linkage_stores_a_forest_of_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    for n, m in ((5, 0), (12, 20), (40, 300)):
        i, j, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        kept = graph.least_forest(i, j, d)
        assert len(kept) < n
        for most in range(6):
            assert _least_ends([(i[k], j[k]) for k in kept if d[k] <= most]) == {v: x for v, x in _least_ends([(a, b) for a, b, x in zip(i, j, d, strict=True) if x <= most and a != b]).items()}
    # 57 records that are all near one another.
    rows = [(k, "s", "c", f"CASS{x}{y}GTDTQYF", "CAVRDSNYQLIF", "V1", "J1", "V2", "J2", 1.0) for k, (x, y) in enumerate((x, y) for x in "ARNDCQEGHILKMFPSTWY" for y in "AGS")]
    records = spark.createDataFrame(rows, "rid long, subject string, condition string, beta string, alpha string, v_gene string, j_gene string, va_gene string, ja_gene string, counts double")
    seen, plain = [], pipeline.single_linkage
    monkeypatch.setattr(pipeline, "single_linkage", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    monkeypatch.setattr(pipeline, "output_rows", lambda valid, records, clusters, by_record, *_: by_record)
    monkeypatch.setattr(pipeline, "pattern_fisher", lambda patterns, *_: patterns.withColumn("p", F.lit(1.0)))
    out = pipeline.run_distance_clustering(records, pipeline.Repertoire(records.select(F.col("beta").alias("s")), records), records, method="single-linkage", mode="alpha-beta").collect()
    assert seen[0] <= 2 * 56 and len({r.rid for r in out}) == 57  # at most two tasks found pairs


def test_motifs_by_halves_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(12)
    groups = {}
    for c in range(40):
        core = list(rng.choice(list("AGSTLV"), int(rng.integers(4, 12))))
        groups[c] = sorted({"CAS" + "".join(rng.choice(list("AGSTLVIW")) if rng.random() < 0.2 else x for x in core) + "EQF" for _ in range(int(rng.integers(1, 9)))})
    slow = lambda own: next((f for k in range(8, 2, -1) if (f := motifs.best_motif(own, k)) and f.fraction >= 0.5), None)
    want = {c: own[0] if len(own) == 1 else getattr(slow(own), "consensus", None) for c, own in groups.items()}
    members = spark.createDataFrame([(c, s) for c, own in groups.items() for s in own], "c long, s string").unionByName(spark.createDataFrame([(99, ""), (98, None)], "c long, s string"))
    found = motifs.cluster_motifs(members, "c", "s")
    assert {r.c: r.motif for r in found.collect()} == want | {99: None, 98: None}
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_numbers_name_the_same_pairs(spark):
    near = [(x, y) for s, t in zip(_random_chains(20, 4), _random_chains(20, 5), strict=True) for x, y in ((s, t), (s[:5] + "A" + s[6:], t), (s, t[:6] + t[7:]))]
    rows = [(f"{b}|{a}", b, a, k) for k, (b, a) in enumerate(sorted(set(near), key="|".join))]
    vertices = spark.createDataFrame(rows, "v string, beta string, alpha string, id long")
    both = [{(r.i, r.j): r.d for r in distances.joint_pairs(vertices, 12, True, number=n).collect()} for n in (None, "id")]
    assert both[0] and both[0] == {(rows[i][0], rows[j][0]): d for (i, j), d in both[1].items()}


def test_lists_are_parted_by_both_alleles(spark, monkeypatch):
    near = [(x, y) for s, t in zip(_random_chains(60, 13), _random_chains(60, 14), strict=True) for x, y in ((s, t), (s[:5] + "A" + s[6:], t), (s, t[:6] + t[7:]))]
    rows = [(f"{b}|{a}|V0*01|V{k // 3 % 6}*01", b, a, "V0*01", f"V{k // 3 % 6}*01") for k, (b, a) in enumerate(near)]
    vertices = spark.createDataFrame(rows, "v string, beta string, alpha string, vb string, va string").distinct()
    seen, held = _shipped_members(monkeypatch), vertices.count()
    got = {(r.i, r.j): r.d for r in distances.joint_pairs(vertices, 24, True, _far_genes(spark, 6), cdr3_weight=3, tile=20).collect()}
    assert sum(seen) <= 3 * held  # one beta allele: its lists of 20 would take 180 members to 10 tasks each
    want = {(x[0], y[0]): d for x in rows for y in rows if x[0] < y[0] and x[3:] == y[3:] and (d := 3 * (plain_distance(x[1], y[1]) + plain_distance(x[2], y[2]))) <= 24}
    assert got == want and want


def test_search_moves_no_inputs(spark):
    own = spark.createDataFrame([(x[1:-1],) for x in _random_chains(40, 15)], "sequence string")
    found = similarity.similar_pairs(own, own)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.sequence, r.match) for r in found.collect()} >= {(r.sequence, r.sequence) for r in own.collect()}


def test_pairs_are_compared_many_at_once(monkeypatch):
    pool = sorted({y for x in _random_chains(1500, 16) for y in (x[1:-1], x[1:5] + "V" + x[6:-1], x[1:5] + "I" + x[6:-1])})
    calls, plain = [], similarity.k3_pairs
    monkeypatch.setattr(similarity, "k3_pairs", lambda a, b: calls.append((a.shape[1], b.shape[1])) or plain(a, b))
    side = similarity.Side(pool, *similarity._profiles(pool, similarity._basis(pool[:500])))
    assert sum(1 for _ in side.matches(side, 0.97)) == len(set(calls)) == len(calls)
    found = {(i, j) for x, y, _ in side.take(np.arange(40)).matches(side, 0.95) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    from clonoforge.functions.kernels import k3_matrix

    want = set()
    for n in set(side.lengths.tolist()):
        at = np.flatnonzero(side.lengths == n)
        for a in range(40):
            score = k3_matrix(side.codes[a, : side.lengths[a]], side.codes[at, :n]) / (side.norms[a] * side.norms[at])
            want |= {(a, b) for b in at[score > 0.95].tolist()}
    assert found == want and len(found) > 40


def test_sequences_of_both_sides_meet_once(spark, monkeypatch):
    near = [y for x in _random_chains(40, 17) for y in (x[1:-1], x[1:5] + "S" + x[6:-1], x[1:5] + "T" + x[6:-1])]
    pool = sorted(set(near))
    sides = [spark.createDataFrame([(s,) for s in some], "sequence string") for some in (pool[:90], pool[30:], pool)]
    scanned, plain = [], type(sides[0]).mapInArrow
    monkeypatch.setattr(type(sides[0]), "mapInArrow", lambda df, run, schema, *rest: (scanned.append(df.count()) if "match" in schema.names else None) or plain(df, run, schema, *rest))
    side = similarity.Side(pool, *similarity._profiles(pool, similarity._basis(pool)))
    want = {(pool[i], pool[j]) for x, y, _ in side.matches(side, 0.9) for i, j in zip(x, y, strict=True)}
    for inputs, database, own, base in ((0, 1, pool[:90], pool[30:]), (2, 2, pool, pool), (0, 2, pool[:90], pool)):
        scanned.clear()
        got = similarity.similar_pairs(sides[inputs], sides[database], 0.9, 20).collect()
        assert {(r.sequence, r.match) for r in got} == {(a, b) for a, b in want if a in own and b in base} and len({(r.sequence, r.match) for r in got}) == len(got) > 20
        if own == base:
            assert len(scanned) > 4 and sum(scanned) < 0.75 * len(scanned) * len(own)
