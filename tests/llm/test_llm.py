import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoforge.llm import canonical, endings, groups, leaks, packing, truncation
from clonoforge.llm.queries import genes_of


def plain_groups(lists, known):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for own in lists:
        own = sorted({x for x in own or [] if x is not None and (known is None or x in known)})
        for x in own[1:]:
            a, b = root(own[0]), root(x)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    lists = [[rng.choice([None, *range(300)]) for _ in range(rng.randint(0, 3))] for _ in range(160)] + [None, [], [7, 7], [5, 1], [1, 5]]
    lists += [[k, k + 1] for k in range(400, 440)] + [[1000, k] for k in range(1001, 1200)]  # a chain and a star
    known = set(range(0, 2000, 1)) - set(range(0, 300, 7))
    df = spark.createDataFrame([(x, "e") for x in lists], "members array<bigint>, group_id string")
    ids = spark.createDataFrame([(k,) for k in known] + [(None,)], "rid bigint")
    got = {r.member: r.group_id for r in groups.consolidate([df], ids).collect()}
    assert got == plain_groups(lists, known)
    pairs = groups.pairs_as_lists(spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 4)], "a bigint, b bigint"), "a", "b")
    assert {r.member: r.group_id for r in groups.consolidate([pairs]).collect()} == {1: 1, 2: 1}
    assert groups.consolidate([df.limit(0)], ids).count() == 0


def test_hubs_are_renamed_alike(spark):
    rng = random.Random(12)
    edges = sorted({(h, k) for h in (1, 2) for k in range(10, 150)} | {tuple(sorted(rng.sample(range(200, 400), 2))) for _ in range(150)})
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    sets = []
    for degree in (groups.HUB_DEGREE, 3):
        found = {}
        for r in groups.contract(df, hub_degree=degree).collect():
            found.setdefault(r.label, set()).add(r.v)
        sets.append(sorted(map(sorted, found.values())))
    want = {}
    for v, g in plain_groups([list(e) for e in edges], None).items():
        want.setdefault(g, set()).add(v)
    assert sets[0] == sets[1] == sorted(map(sorted, want.values()))


def plain_weighted(a, b, cost):
    d = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if (i, j) != (0, 0):
                ways = []
                if i:
                    ways.append(d[i - 1, j] + cost(a[i - 1], ""))
                if j:
                    ways.append(d[i, j - 1] + cost("", b[j - 1]))
                if i and j:
                    ways.append(d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else cost(a[i - 1], b[j - 1])))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                    ways.append(d[i - 2, j - 2] + max(1.0, cost(a[i - 1], b[j - 1])))
                d[i, j] = min(ways)
    return d[len(a), len(b)]


def test_symmetric_deletes_find_all(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("ABCD") for _ in range(rng.randint(4, 9))) for _ in range(80)]
    rules = canonical.Rules(allowed=lambda w: 2)
    entries = [(n, n, float(k)) for k, n in enumerate(names)]
    matcher = canonical.Matcher(entries, rules)
    words = ["".join(rng.choice("ABCD") for _ in range(rng.randint(3, 10))) for _ in range(200)]
    want = {}
    for word in words:
        exact = [f for f in ((plain_weighted(word, n, canonical.unit_cost), -k, n) for k, n in enumerate(names)) if f[0] <= 2]
        want[word] = min(exact)[2] if exact else canonical.UNMATCHED
        assert matcher.lookup(word) == want[word]
    listed = spark.createDataFrame(entries, "spelling string, name string, frequency double")
    values = spark.createDataFrame([(w,) for w in words] + [(None,), (words[0],)], "value string")
    assert {r.value: r.name for r in canonical.canonical_by_join(values, listed, rules).collect()} == want


def test_short_keys_lose_nothing():
    class Petty(canonical.Rules):
        prefix, petty, from_end = 3, 2, True

        def is_petty(self, c):
            return c in "-0"

    rng = random.Random(8)
    cost = lambda x, y: 0.1 if (not x or x in "-0") and (not y or y in "-0") else 1.0
    rules = Petty(1, normalise=str, cost=cost, allowed=lambda w: 1.2 + 1e-9)
    names = sorted({"".join(rng.choice("AB-0") for _ in range(rng.randint(5, 9))) for _ in range(60)})
    matcher = canonical.Matcher([(n, n, 0.0) for n in names], rules)
    for _ in range(300):  # one letter and up to two petty edits away from a name
        word = list(rng.choice(names))
        for _ in range(rng.randint(0, 2)):
            word.insert(rng.randrange(len(word) + 1), rng.choice("-0"))
        if rng.random() < 0.5:
            word.insert(rng.randrange(len(word) + 1), rng.choice("AB"))
        word = "".join(word)
        within = [d for n in names if (d := plain_weighted(word, n, cost)) <= 0.2 + 1e-9]  # two petty edits
        assert matcher.nearest(word)[0] <= min(within, default=1.2) + 1e-9


def test_long_values_are_searched():
    name = "Institute of the molecular biology of rare organisms and applied sciences in Ulm"
    matcher = canonical.Matcher([(canonical.fold(name), name, 1.0)])
    assert len(name) > 75 and matcher.lookup(name.replace("rare", "raer")) == name and matcher.lookup(name[:40]) == canonical.UNMATCHED
    assert matcher.lookup("x" * 1_000_000) == canonical.UNMATCHED


GENES = [("TRBV1-1", 0.3), ("TRBV4", 0.1), ("TRBV10-2", 0.2), ("TRBV11-2", 0.2)]
TYPED = {
    "trbv1-1": "TRBV1-1", "TCRBV10-02": "TRBV10-2", "TRBVl-I": "TRBV1-1", "Vβ 10.2": "TRBV10-2", "T-cell receptor beta variable 4": "TRBV4", "ＴＲＢＶ４": "TRBV4", "TRBV10_2*03": "TRBV10-2", "TRVB4": "TRBV4", "TRBBV4": "TRBV4",
    "RBV11-2": "TRBV11-2", "(Trbv4)": "TRBV4", "TRBV4 - checked": "TRBV4", "hsTRBV11--2 (F)": "TRBV11-2", "IMGT:TRBV4?": "TRBV4", "ТRBѴ4": "TRBV4", "TRB4": "TRBV4", "TRV4": "TRBV4",
    "TRBV1": "UNMATCHED", "TRBV4-1": "UNMATCHED", "TRBV2-1": "UNMATCHED", "TRBJ1-1": "UNMATCHED", "TRGV4": "UNMATCHED", "TRAV1-1": "UNMATCHED", "IGHV1-1": "UNMATCHED", "CD4": "UNMATCHED", "see notes": "UNMATCHED", "?": "UNMATCHED", "x" * 5000: "UNMATCHED", "T4BV4": "TRBV4", "BV10 - 2": "TRBV10-2", "TRBV1O-2": "TRBV10-2", "TRBVlO_2 [manual]": "TRBV10-2", "TRBV11 1": "UNMATCHED", "TRBV102": "UNMATCHED", "TRBV1-0-2": "UNMATCHED", "UNMATCHED": "UNMATCHED",
}


def test_genes(spark):
    matcher = canonical.gene_matcher("TRB", GENES)
    assert {v: matcher.lookup(v) for v in TYPED} == TYPED
    alpha = canonical.gene_matcher("TRA", [("TRAV6/DV4", 1.0), ("TRAV14", 1.0)])
    assert [alpha.lookup(x) for x in ("AV6 / DV4", "Vα6_DV4", "TRAV6", "TRAV14/DV4", "TCRAV06/DV4", "RTAV6DV4")] == ["TRAV6/DV4", "TRAV6/DV4", "UNMATCHED", "UNMATCHED", "TRAV6/DV4", "TRAV6/DV4"]
    rows = [(1, "trbv4", "a"), (1, "trbv4", "a"), (2, "TRBV4", "a"), (3, " na ", "a"), (4, None, "a"), (5, "", "a"), (6, "odd", "a"), (7, "UNMATCHED", "a")]
    df = spark.createDataFrame(rows, "rid int, v_gene string, field string")
    out = canonical.canonical_values(df, {"v_gene": matcher}, ["rid", "field"])
    assert out.columns == ["rid", "field", "_field", "value", "name"]
    assert sorted((r.rid, r.name) for r in out.collect()) == [(1, "TRBV4"), (1, "TRBV4"), (6, "UNMATCHED"), (7, "UNMATCHED")]
    assert canonical.bounded(df, 3) is None and len(canonical.bounded(df, 8)) == 8


def test_a_reference_too_large_to_broadcast_gives_the_same(spark):
    typed = [(k, v, "AV6/DV4") for k, v in enumerate(v for v in TYPED if len(v) < 100)] + [(1000, None, "TRAV14 (F)"), (1001, "TRBV4", "TRAV14")]
    records = spark.createDataFrame(typed, "rid int, v_gene string, va_gene string")
    listed = [(g, "TRB", f) for g, f in GENES] + [("TRAV6/DV4", "TRA", 0.5), ("TRAV14", "TRA", None)]
    reference = spark.createDataFrame(listed, "gene string, chain string, freq double")
    got = [sorted(tuple(r) for r in genes_of(records, reference, ["rid"], most).collect()) for most in (100, 3)]
    assert got[0] == got[1] and len(got[0]) == 2 * len(typed) - 3


def best_fill(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))]
        room = rng.randint(1, 60)
        held = {x: [0] * lengths.count(x) for x in lengths}
        taken = packing.fullest(room, sorted(held), held)
        assert sum(taken) == best_fill(lengths, room) and all(taken.count(x) <= lengths.count(x) for x in taken)


def test_packing(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 60), "x") for k in range(700)] + [(900, 205, "x"), (901, 0, "x"), (902, None, "x"), (0, 5, "x")]
    sizes = spark.createDataFrame(rows, "doc int, n int, piece string")
    targets = spark.createDataFrame([(1, 64), (2, 100), (3, 0)], "target int, capacity int")
    out = packing.pack(sizes, targets, "doc", "n", "target", "capacity", shard_items=300).collect()
    for t, capacity in ((1, 64), (2, 100)):
        own = [r for r in out if r.target == t]
        assert sum(r.length for r in own) == sum(n or 0 for _, n, _ in rows)
        assert {r.doc for r in own if r.container_id is None} == {901, 902}
        room = {}
        for r in own:
            if r.container_id is not None:
                room[r.container_id] = room.get(r.container_id, 0) + r.length
            assert r.piece == 0 or r.doc == 900
        assert max(room.values()) <= capacity and sum(room.values()) / (len(room) * capacity) > 0.93
    assert packing.pack(sizes.limit(0), targets, "doc", "n", "target", "capacity").count() == 0
    with pytest.raises(ValueError):
        packing.pack_shard([5], 4)


def test_a_giant_item_fills_containers_of_its_own(spark):
    sizes = spark.createDataFrame([(1, 64_003), (2, 10), (3, 64)], "doc int, n int")
    targets = spark.createDataFrame([("t", 64)], "target string, capacity int")
    out = packing.pack(sizes, targets, "doc", "n", "target", "capacity", shard_items=100)
    rows = out.collect()
    assert sum(r.length for r in rows) == 64_077 and len(rows) == 1003
    room = {}
    for r in rows:
        room.setdefault(r.container_id, []).append(r.length)
    assert len(room) == 1002 and max(map(sum, room.values())) == 64
    assert sorted((r.start, r.length) for r in rows if r.doc == 1) == [(64 * k, min(64, 64_003 - 64 * k)) for k in range(1001)]
    assert packing.fill(out, targets, "target", "capacity").first().n_containers == 1002
    assert packing.pack(sizes, targets.limit(0), "doc", "n", "target", "capacity").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "def f(x): return x"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ab " * 20_000)], "doc int, text string")
    got = {r.doc: r.n_tokens for r in packing.token_counts(df, "text", ["doc"]).collect()}
    assert got[2] == got[3] == 0 and got[1] == 7 and got[4] > 1 and got[5] >= 20_000


def plain_leaks(docs, items, shared):
    w = lambda t: re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]", " ", t or "").lower())
    grams = lambda t: {tuple(t[i : i + shared]) for i in range(len(t) - shared + 1)}
    own = {k: grams(w(t)) for k, t in items}
    return {(d, k) for d, t in docs for k in own if own[k] & grams(w(t))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(60)]
    items += [(100, items[3][1]), (101, None), (102, "short")]
    docs = []
    for d in range(250):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.5:
            source = (rng.choice(items[:60])[1]).split()
            at, n = rng.randrange(len(source)), rng.randint(3, 30)
            text[len(text) // 2 : len(text) // 2] = source[at : at + n]
        docs.append((d, rng.choice([" ", "\n# ", "-_"]).join(text).upper()))
    docs += [(900, None), (901, " "), (902, "K" + items[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc int, text string, item string")
    it = spark.createDataFrame(items, "item int, passage string")
    for blocks, scan_bytes in ((20_000, leaks.SCAN_BYTES), (20, leaks.SCAN_BYTES), (20, 1)):
        got = {tuple(r) for r in leaks.find_leaks(df, it, "doc", "text", "item", "passage", 8, blocks, scan_bytes).collect()}
        assert got == plain_leaks(docs, items, 8)
    assert leaks.find_leaks(df.limit(0), it, "doc", "text", "item", "passage").count() == 0
    assert leaks.find_leaks(df, it.limit(0), "doc", "text", "item", "passage").count() == 0


@pytest.mark.parametrize("vocabulary,longest", [(9, 8), (3, 50)])
def test_wand_equals_full_scoring(vocabulary, longest):
    rng = random.Random(7)
    items = [(k, " ".join(f"w{rng.randint(0, vocabulary - 1)}" for _ in range(30))) for k in range(80)]
    index = leaks.Index(items, 6)
    assert max(len(docs) for docs, _ in index.lists) >= longest  # with few words lists are long and their blocks decide
    for _ in range(50):
        query = sorted(rng.sample(range(len(index.terms)), 12))
        scores = {}
        for t in query:
            for d, w in zip(*index.lists[t], strict=True):
                scores[d] = scores.get(d, 0) + w
        for threshold in (0.3, 0.6, 1.0):
            assert index.wand(query, threshold) == sorted(d for d, s in scores.items() if s >= threshold - 1e-12)


def test_terms_that_collide_lose_nothing():
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(20))) for k in range(30)]

    class Colliding(leaks.Index):
        def term(self, run):
            return sum(run) % 7

    index = Colliding(items, 6)
    for k, text in items:
        query = sorted({int(np.searchsorted(index.terms, index.term(run))) for run in zip(*(index_words(index, text)[i:] for i in range(3)))})
        assert k in index.wand(query)


def index_words(index, text):
    return [index.vocabulary[w] for w in leaks.words(text)]


WHOLE = [
    "", "  \n", None, "# Title\n\nSome text here ends well.\n", "# Title\n\n- one item\n- another item", "| a | b |\n|---|---|\n| 1 | 2 |", "More notes may follow later...", "def f(x):\n    y = x + 1\n    return y", "x = [\n    (1, \"a\"),\n]\n",
    "package main\n\nfunc f(a int) int {\n\treturn a\n}\n", "int f(int a) {\n  return a; // it's fine (really\n}\n", "const a = { b: 1 };\nfunction f() { return `x${a}`; }\n", '{"a": [1, 2], "b": "c"}', ".a {\n  color: red;\n}", "/* note */\nint x;\n",
    "A line of prose that ends here.", "Kept by the example team",
]
CUT = [
    "def f(x):\n    y = g(x, ", "def f(x):\n    \"\"\"Some text that", "def f(x):\n    for i in x:", "x = [\n    (1, \"a\"),\n    (2, \"b", "package main\n\nfunc f(a int) int {\n\treturn a", "int f(int a) {\n  /* this comment", "const a = { b: 1,", '{"a": [1, 2], "b',
    ".a {\n  color: re", "# T\n\nThis sentence goes on for quite some while and then it just stops in the mid", "Some text that was here [truncated]", "Any word and ano�", "# T\n\n```\ncode of a block\nmore",
]


def test_endings():
    assert [t for t in WHOLE if endings.ending(t) in endings.UNFINISHED] == []
    assert [t for t in CUT if endings.ending(t) not in endings.UNFINISHED] == []
    assert endings.ending("def f(x):\n    y = '" + "a" * 300_000) == "string"


def test_endings_have_no_windows():
    assert endings.ending(" " * 5000 + '{"a": [1, 2], "b') == "string" and endings.kind_of(" " * 5000 + '{"a": 1}') == "json"
    assert endings.ending("Some text that ends here. <!-- " + " " * 300 + "truncated" + " " * 300 + " -->") == "mark"
    assert endings.ending("Some text here ---- " + " " * 200 + "cut" + " " * 200 + " ----") == "mark"
    assert endings.ending("Some text that ends " + "." * 500) == "dots" and endings.ending("f(a)[1]{}") != "mark"


def test_censored_fit():
    rng = np.random.default_rng(1)
    lengths = np.minimum(np.exp(rng.normal(7.0, 0.8, 20_000)).astype(int) + 1, 2500)
    values, counts = np.unique(lengths, return_counts=True)
    mu, sigma = truncation.fit_censored(values, counts, 2500)
    assert abs(mu - 7.0) < 0.03 and abs(sigma - 0.8) < 0.03
    assert truncation.candidate_limits(values, counts) == [2500]
    free = np.unique(np.exp(rng.normal(7.0, 0.8, 5000)).astype(int), return_counts=True)
    assert truncation.candidate_limits(*free) == []


def test_judge(spark):
    rng = random.Random(9)
    rows = []
    for k in range(600):
        text = "def f(x):\n" + "".join(f"    y{j} = g(x, {rng.randint(1, 10 ** 6)})\n" for j in range(rng.randint(5, 120))) + "    return y1\n"
        cut_here = k % 2 == 0 and len(text) > 1000
        rows.append((k, text[:1000] if cut_here else text, "limited" if k % 2 == 0 else None, cut_here))
    rows += [(9000, None, "limited", False), (9001, " ", "limited", False), (9001, " ", "limited", False)]
    df = spark.createDataFrame(rows, "doc int, text string, source string, evidence boolean")
    judged = truncation.judge(df, "doc", "text", "source")
    got = {r.doc for r in judged.filter("is_cut").collect()}
    open_end = lambda t: not t.rstrip().endswith(")")
    want = {d for d, t, _, c in rows if c and open_end(t)}
    assert len(got ^ want) <= 0.05 * len(want)
    rate = {r.source: r.cut_share for r in truncation.rates(judged, "source").collect()}
    assert rate[None] == 0.0 and rate["limited"] > 0.5
    assert truncation.judge(df.limit(0), "doc", "text", "source").count() == 0


def test_a_seldom_cut_is_still_a_cut(spark):
    whole = spark.range(100_000).selectExpr("id AS doc", "concat('This text ends well, number ', id, repeat(' and so on', cast(id % 37 as int)), '.') AS text", "'seldom' AS source")
    ends = ["def f(x):\n    y = 'an open strin", "def f(x):\n    y = g(x, ", "int f(int a) {\n  return a;\n", "int f(int a) {\n  /* this comment", '{"a": [1, 2], "b']
    cut_ = spark.createDataFrame([(100_000 + k, t, "seldom") for k, t in enumerate(ends)], "doc long, text string, source string")
    judged = truncation.judge(whole.unionByName(cut_), "doc", "text", "source")
    assert sorted(r.doc for r in judged.filter("is_cut").collect()) == [100_000 + k for k in range(5)]


def test_an_end_that_whole_texts_have_is_learned():
    """A kind of end that stands in the same share of all sources, however seldom they cut, is no sign of a cut."""
    kinds = truncation.KINDS
    row = lambda **n: [float(n.get(k, 0)) for k in kinds]
    pools = np.array([row(none=100_000, statement=300), row(none=50_000, statement=150, string=50, bracket=50), row(none=8000, statement=24, string=1000, bracket=1000)])
    model = truncation.fit_endings(np.zeros(0), np.zeros((0, len(kinds))), pools)
    ratio = np.log(model.elsewhere / model.whole)
    at = kinds.index
    assert ratio[at("string")] > 8 and ratio[at("bracket")] > 8 and ratio[at("statement")] < 2
    assert model.rate(pools[2]) == pytest.approx(0.2, abs=0.01) and model.rate(pools[0]) < 1e-3


def test_a_doubtful_end_counts_at_a_limit_only(spark):
    rng = random.Random(10)
    body = lambda k: "".join(f"Sentence {rng.randint(1, 10 ** 6)} of text {k} ends here. " for _ in range(rng.randint(2, 60)))
    rows = [(k, body(k)[:900], "limited") for k in range(800)] + [(5000, body(1)[:400] + "\n\nKept by the team", "limited")]
    rows = [(d, (t[:897] + "...") if len(t) == 900 else t, s) for d, t, s in rows]
    judged = {r.doc: r for r in truncation.judge(spark.createDataFrame(rows, "doc int, text string, source string"), "doc", "text", "source").collect()}
    dotted = [d for d, t, _ in rows if t.endswith("...")]
    assert len(dotted) > 100 and all(judged[d].evidence == "dots" and judged[d].is_cut for d in dotted)
    assert judged[5000].evidence == "short" and not judged[5000].is_cut


def test_rows_of_data_among_prose():
    text = "# Notes\n\nSome words stand here. And some more of them. They end.\n\n" + "".join(f'    ("ROW_{k}", {k * 37}, "name{k}"),\n' for k in range(9))
    assert endings.ending(text + '    ("ROW_9", 20') == "bracket" and endings.ending(text + '    ("ROW_9", 20, "na') == "string"
    assert endings.ending(text + '    ("ROW_9",\n') not in endings.UNFINISHED


def test_comment_behind_code():
    code = "import os\n\ndef f(y):\n    return y\n\nx = f(y)  # "
    assert endings.ending(code + "taken from the") == "sentence" and endings.ending("int x = 1; // because of the") == "sentence"
    assert endings.ending(code + "the reason is that we") == "note" and endings.ending(code + "It is done.") == "none"
