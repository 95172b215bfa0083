"""Texts cut off by field limits: censored length distributions joined with ending evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoforge.llm.endings import DOUBTFUL, FINISHED, UNFINISHED, ending
from clonoforge.session import cut

KINDS = (*UNFINISHED, *DOUBTFUL, FINISHED)
_OPEN = len(UNFINISHED)
#: Counts that the distributions of ends start from: cut texts end in something unfinished,
#: whole ones in nothing open. One text's worth of unfinished ends in whole texts is not believed.
CUT_PRIOR = np.array([1.0] * _OPEN + [0.25] * len(DOUBTFUL) + [0.25])
WHOLE_PRIOR = np.array([-1.0] * _OPEN + [0.5] * len(DOUBTFUL) + [5.0])
LEAST_COUNT = 0.01
#: The share of each kind of unfinished ends that the fit first gives to whole texts; it falls to
#: nothing where the kind keeps in step with the sources' rates of cuts, and grows where it does not.
FIRST_SHARE = 0.02
#: Steps in which log-odds of limits are counted, and the greatest that matter: at most 121 different ones.
STEP, MOST_ODDS = 0.5, 30.0
#: Sources are pooled by powers of two of their share of unfinished ends, down to 2 ** -LEAST_POWER.
LEAST_POWER = 40
#: A limit holds at least so many different texts, and so many times what lies around it.
LEAST_AT_LIMIT, TIMES_AROUND = 5, 10.0
#: Most of the values at or above a limit that may lie above it.
MOST_ABOVE = 0.25


def evidence(df: DataFrame, keep: str, text: str, source: str) -> DataFrame:
    """(doc, source, n_chars, n_bytes, content, evidence): one row per given text, read whole, no text kept."""
    read = df.select(F.col(keep).alias("doc"), F.col(source).alias("source"), F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("content"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = T.StructType([*(read.schema[c] for c in ("doc", "source", "n_chars", "n_bytes", "content")), T.StructField("evidence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ending(x.as_py()) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.string())], names=schema.names)

    return read.mapInArrow(run, schema)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _density(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: float | None) -> tuple[float, float]:
    """(mu, sigma) of the log-normal of greatest likelihood, values at or above `limit` known only to reach it (EM)."""
    x = np.log(np.maximum(lengths, 1).astype(float))
    free = np.ones(len(x), bool) if limit is None else lengths < limit
    n, s, q = counts[free].sum(), (counts[free] * x[free]).sum(), (counts[free] * x[free] ** 2).sum()
    held = counts[~free].sum()
    if n + held == 0:
        return 0.0, 1.0
    end = math.log(limit) if limit else 0.0
    mu = (s + held * end) / (n + held)
    var = max((q + held * end**2) / (n + held) - mu**2, 1e-6)
    for _ in range(200 if held else 0):
        sigma = math.sqrt(var)
        z = (end - mu) / sigma
        ratio = _density(z) / max(_tail(z), 1e-300)
        first = mu + sigma * ratio  # E[x | x >= end]
        second = mu * mu + var + sigma * (end + mu) * ratio
        new = (s + held * first) / (n + held)
        var = max((q + held * second) / (n + held) - new**2, 1e-6)
        if abs(new - mu) < 1e-9:
            break
        mu = new
    return mu, math.sqrt(var)


def candidate_limits(lengths: np.ndarray, counts: np.ndarray) -> list[int]:
    """Lengths at which different texts pile up and beyond which hardly any lie."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    above = counts[::-1].cumsum()[::-1]
    total = np.concatenate([[0], counts.cumsum()])
    out = []
    for k in np.flatnonzero(counts >= LEAST_AT_LIMIT):
        limit = int(lengths[k])
        lo = np.searchsorted(lengths, limit * 0.8)
        around = (total[k] - total[lo]) / max(1.0, limit * 0.2)
        if counts[k] >= TIMES_AROUND * max(around, 1e-9) and above[k] - counts[k] <= MOST_ABOVE * above[k]:
            out.append(limit)
    return out


def different_texts(found: DataFrame) -> DataFrame:
    """(source, n_chars, n_bytes, evidence): one row per source and different text, so that copies make no limit."""
    return found.groupBy("source", "content", "n_chars", "n_bytes").agg(F.first("evidence").alias("evidence")).drop("content")


def length_model(once: DataFrame) -> DataFrame:
    """(source, limits): the candidate limits of each source with the log-odds of a cut there.

    They are those of a length beyond the limit against one just there, under the log-normal
    fitted with the values at the limit and above as censored. Lengths are counted before
    anything is gathered: a task holds one source's distinct lengths, never its rows.
    """
    both = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length"))))
    counts = once.select("source", both.alias("m")).groupBy("source", "m.measure", "m.length").agg(F.count(F.lit(1)).alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        limits = []
        for measure, own in group.groupby("measure", sort=True):
            lengths, n = own["length"].to_numpy(), own["n"].to_numpy()
            for limit in candidate_limits(lengths, n):
                mu, sigma = fit_censored(lengths, n, limit)
                z = (math.log(limit) - mu) / sigma
                longer, here = _tail(z), _density(z) / (sigma * limit)
                limits.append((measure, limit, math.log(max(longer, 1e-12) / max(here, 1e-12)), float(mu), float(sigma), int(n[lengths == limit].sum())))
        return pd.DataFrame({"source": [group["source"].iat[0]], "limits": [limits]})

    schema = T.StructType([once.schema["source"], T.StructField("limits", T.ArrayType(T.StructType([T.StructField("measure", T.StringType()), T.StructField("limit", T.IntegerType()), T.StructField("log_odds", T.DoubleType()), T.StructField("mu", T.DoubleType()), T.StructField("sigma", T.DoubleType()), T.StructField("n", T.LongType())])))])
    return counts.groupBy("source").applyInPandas(run, schema)


def placed(df: DataFrame, model: DataFrame) -> DataFrame:
    """df with at_limit: the greatest log-odds of the limits of its source that the text has the length of, null elsewhere."""
    joined = df.join(model.select(F.col("source").alias("_source"), "limits"), F.col("source").eqNullSafe(F.col("_source")))
    here = F.filter("limits", lambda x: F.when(x["measure"] == "chars", F.col("n_chars")).otherwise(F.col("n_bytes")) == x["limit"])
    return joined.withColumn("at_limit", F.array_max(F.transform(here, lambda x: x["log_odds"]))).drop("_source", "limits")


class EndingModel(NamedTuple):
    """What ends texts have that are cut at a limit, cut elsewhere, and whole: shares of KINDS."""

    at_limit: np.ndarray
    elsewhere: np.ndarray
    whole: np.ndarray

    def rate(self, counts: np.ndarray, rounds: int = 200) -> float:
        """The share of cuts among texts at no limit with these counts of ends, by EM from the share of unfinished ones."""
        rate = counts[:_OPEN].sum() / max(counts.sum(), 1)
        for _ in range(rounds if rate else 0):
            yes = rate * self.elsewhere
            new = (counts * yes / (yes + (1 - rate) * self.whole)).sum() / counts.sum()
            if abs(new - rate) <= 1e-9 * new:
                break
            rate = new
        return float(min(max(rate, 1e-15), 1 - 1e-9))


def _share(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def fit_endings(odds: np.ndarray, limited: np.ndarray, pools: np.ndarray, rounds: int = 1000) -> EndingModel:
    """Shares of ends by EM.

    Row k of `limited` counts the texts of each of KINDS where the length gives the log-odds
    odds[k] of a cut; each row of `pools` those at no limit of sources that cut about equally
    often, at a rate that is fitted too. A kind of end that comes with cuts keeps in step
    with the rates of the pools; one that whole texts have does not, and the fit moves it
    to them.
    """
    at_limit = elsewhere = CUT_PRIOR / CUT_PRIOR.sum()
    whole = np.maximum(pools.sum(axis=0), 0) + np.maximum(WHOLE_PRIOR, LEAST_COUNT)
    whole[:_OPEN] = 1 + FIRST_SHARE * pools[:, :_OPEN].sum(axis=0)
    whole /= whole.sum()
    held = np.maximum(pools.sum(axis=1), 1)
    rate = np.clip(pools[:, :_OPEN].sum(axis=1) / held, 1e-15, 1 - 1e-9)
    for _ in range(rounds):
        here = limited * _share(odds[:, None] + np.log(at_limit) - np.log(whole))
        there = pools * _share((np.log(rate) - np.log1p(-rate))[:, None] + np.log(elsewhere) - np.log(whole))
        new = [here.sum(axis=0) + CUT_PRIOR, there.sum(axis=0) + CUT_PRIOR, np.maximum((limited - here).sum(axis=0) + (pools - there).sum(axis=0) + WHOLE_PRIOR, LEAST_COUNT)]
        new = [x / x.sum() for x in new]
        moved = max(np.abs(new[0] - at_limit).max(), np.abs(new[1] - elsewhere).max(), np.abs(new[2] - whole).max())
        at_limit, elsewhere, whole = new
        rate = np.clip(there.sum(axis=1) / held, 1e-15, 1 - 1e-9)
        if moved < 1e-10:
            break
    return EndingModel(at_limit, elsewhere, whole)


def _counts_of_kinds() -> list:
    return [F.count_if(F.col("evidence") == kind).alias(kind) for kind in KINDS]


def ending_counts(places: DataFrame, per_source: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`fit_endings`' input: at most 121 and 42 rows of 18 kinds, however many texts and sources there are."""
    step = F.round(F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), F.col("at_limit"))) / STEP).cast("int")
    limited = places.filter("at_limit IS NOT NULL").groupBy(step.alias("step")).agg(*_counts_of_kinds()).orderBy("step").collect()
    open_, every = (sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])) for kinds in (UNFINISHED, KINDS))
    power = F.when(open_ > 0, F.greatest(F.lit(-LEAST_POWER), F.floor(F.log2(open_ / every)))).otherwise(F.lit(-LEAST_POWER - 1))
    pools = per_source.groupBy(power.alias("power")).agg(*[F.sum(k).alias(k) for k in KINDS]).orderBy("power").collect()
    table = lambda rows: np.array([[float(r[k]) for k in KINDS] for r in rows]).reshape(len(rows), len(KINDS))
    return np.array([r.step * STEP for r in limited]), table(limited), table(pools)


def source_rates(per_source: DataFrame, endings: EndingModel) -> DataFrame:
    """(source, base): per source the log-odds of a cut away from its limits."""

    @F.pandas_udf(T.DoubleType())
    def base(*counts: pd.Series) -> pd.Series:
        rates = [endings.rate(row) for row in np.stack([c.to_numpy(float) for c in counts], axis=1)]
        return pd.Series([math.log(r) - math.log1p(-r) for r in rates], dtype=float)

    return per_source.select("source", base(*KINDS).alias("base"))


def judge(df: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """(doc, source, n_chars, evidence, at_limit, log_odds, is_cut): one row per given text.

    Null texts give no row, blank ones are never cut, repeated rows are judged each, a null
    source is a source of its own, an empty table gives no row; other columns are not read.

    Per source a right-censored log-normal is fitted to the lengths by maximum likelihood;
    the censoring posterior of a value at a candidate limit (elsewhere the source's own rate
    of cuts) is its prior. What ends cut and whole texts have is estimated from all texts
    by EM over these priors (`fit_endings`); the ratio of the two is the weight of the end found. A text is
    reported where the posterior says cut and something is left unfinished; a doubtful end,
    which whole files may have as well, only where the length is a limit. One that ends in
    nothing open is no case by the problem's definition, however sure the cut.
    """
    found = cut(evidence(df, doc, text, source))
    once = cut(different_texts(found))
    model = cut(length_model(once))
    places = cut(placed(once, model))
    per_source = cut(places.filter("at_limit IS NULL").groupBy("source").agg(*_counts_of_kinds()))
    endings = fit_endings(*ending_counts(places, per_source))
    base = source_rates(per_source, endings).select(F.col("source").alias("_own"), "base")
    joined = placed(found, model).join(base, F.col("source").eqNullSafe(F.col("_own")), "left")

    def weights(shares: np.ndarray):
        ratios = np.log(shares) - np.log(endings.whole)
        return F.element_at(F.create_map(*[F.lit(x) for kind, w in zip(KINDS, ratios.tolist(), strict=True) for x in (kind, w)]), F.col("evidence"))

    limited = F.col("at_limit").isNotNull()
    prior = F.when(limited, F.col("at_limit")).otherwise(F.col("base"))
    weight = F.when(limited, weights(endings.at_limit)).otherwise(weights(endings.elsewhere))
    log_odds = prior + weight
    can = F.col("evidence").isin(*UNFINISHED) | limited & (F.col("evidence") != FINISHED)
    return joined.select(F.col("doc").alias(doc), F.col("source").alias(source), "n_chars", "evidence", "at_limit", log_odds.alias("log_odds"), ((log_odds > 0) & can).alias("is_cut"))


def rates(judged: DataFrame, source: str) -> DataFrame:
    """(source, n_texts, n_cut, cut_share, expected_share): texts reported, and the mean posterior of a cut, per source."""
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds")))
    counted = judged.groupBy(source).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.avg(posterior).alias("expected_share"))
    return counted.select(source, "n_texts", "n_cut", (F.col("n_cut") / F.col("n_texts")).alias("cut_share"), "expected_share")
