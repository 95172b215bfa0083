"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _free(wanted: str, taken: Sequence[str]) -> str:
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted


def newest(df: DataFrame, key: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """Of rows delivered again under one key the one with the largest `version`.

    Ties are settled by the largest values, so the result does not depend on row order; a
    null version is the oldest. One hash shuffle on the key, combined before it.
    """
    pick = F.max(F.struct(F.col(version).alias("_version"), *[F.col(v) for v in values])).alias("_newest")
    return df.groupBy(*key).agg(pick).select(*key, *[F.col("_newest").getField(v).alias(v) for v in values])


def skewed_totals(df: DataFrame, keys: Sequence[str], order: str, amount: str | Column, partitions: int | None = None) -> DataFrame:
    """rows, distinct `order` values and total amount of each key, evenly spread: keys..., n_rows, n_distinct, total.

    1. Rows are combined before any exchange to one partial state per (keys, order).
    2. The states are range-partitioned on that composite key; Spark samples its quantiles,
       so a key with a third of the states is cut at values of `order` into as many ranges
       as its share asks for. (keys, order) is unique by then, so no state straddles a cut.
    3. Each partition folds its run of every key into one state, in the JVM, before the last
       exchange (the partial aggregate of the plan).
    4. A key cut by boundaries has one state per partition it spans, all others have one:
       the stitch adds up at most keys + partitions rows, whatever the skew.

    Null keys form a group of their own, a null `order` counts as a row but not as a
    distinct value, null amounts add nothing (the total of none is null). An empty table
    gives no row. Repeated rows all count; use `newest` first where they must not. Other
    columns are not read.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    key_columns = list(keys)
    state = df.select(*key_columns, F.col(order).alias("_order"), amount.alias("_amount"))
    state = state.groupBy(*key_columns, "_order").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_total"))
    spread = [partitions] if partitions else []
    ranged = state.repartitionByRange(*spread, *key_columns, "_order")
    return ranged.groupBy(*key_columns).agg(F.sum("_rows").alias("n_rows"), F.count("_order").alias("n_distinct"), F.sum("_total").alias("total"))


def spread_of(df: DataFrame, keys: Sequence[str], order: str, partitions: int) -> DataFrame:
    """How evenly the composite range partitioning spreads the states of `skewed_totals`.

    One row per partition: part, states, first and last key; for reports and tests.
    """
    state = df.select(*keys, F.col(order).alias("_order")).distinct()
    ranged = state.repartitionByRange(partitions, *keys, "_order").withColumn("part", F.spark_partition_id())
    packed = F.struct(*keys)
    return ranged.groupBy("part").agg(F.count(F.lit(1)).alias("states"), F.min(packed).alias("first"), F.max(packed).alias("last"))


def salted_counts(df: DataFrame, keys: Sequence[str], salts: int = 32) -> DataFrame:
    """Row counts per key by two-level salting: keys..., n_rows; for keys without a secondary order."""
    salt = _free("_salt", df.columns)
    first = df.select(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias(salt)).groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("n_rows"))
    return first.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))

