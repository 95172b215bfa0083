from collections import defaultdict

from pyspark.sql import functions as F

from clonoforge.operators.hotkeys import newest, salted_counts, skewed_totals, spread_of


def _rows():
    rows = [("hot", f"s{k % 50}", k % 7) for k in range(3000)] + [(f"k{k % 400}", f"s{k % 9}", 1) for k in range(2000)]
    return rows + [(None, "s1", 2), (None, None, None), ("only", None, None), ("hot", None, 5)]


def test_totals_equal_brute_force(spark):
    df = spark.createDataFrame(_rows(), "key string, subject string, freq int").withColumn("n_rows", F.lit(9))
    want = defaultdict(lambda: [0, set(), None])
    for k, s, f in _rows():
        w = want[k]
        w[0] += 1
        w[1] |= {s} - {None}
        w[2] = w[2] if f is None else (w[2] or 0) + f
    for parts in (1, 5, None):
        got = {r.key: (r.n_rows, r.n_distinct, r.total) for r in skewed_totals(df, ["key"], "subject", "freq", parts).collect()}
        assert got == {k: (a, len(b), c) for k, (a, b, c) in want.items()}
    assert skewed_totals(df.limit(0), ["key"], "subject", "freq").count() == 0
    assert {r.key: r.n_rows for r in salted_counts(df, ["key"]).collect()} == {k: v[0] for k, v in want.items()}


def test_heavy_key_is_cut(spark):
    df = spark.createDataFrame([("hot", f"s{k}") for k in range(4000)] + [(f"k{k}", "s") for k in range(1000)], "key string, subject string")
    states = [r.states for r in spread_of(df, ["key"], "subject", 8).collect()]
    assert len(states) == 8 and max(states) < 2 * 5000 / 8


def test_newest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "z"), (2, None, None), (1, 2, "c")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in newest(df, ["k"], "v", ["x"]).collect()) == [(1, "c"), (2, None)]
