"""Consolidating pairwise matches into groups by random graph contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoforge.session import cut


def pairs_as_lists(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair as a list of two: column members."""
    return pairs.select(F.array(F.col(a).cast("bigint"), F.col(b).cast("bigint")).alias("members"))


def edges_of(lists: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct edges (a, b), a < b, that tie the members of each list (column members) together.

    Nulls, repeats and ids that are not in the one-column frame `known` are dropped from a
    list first; what is left is tied to its smallest member, so a list of k gives k - 1
    edges, never all its pairs. Repeated and turned lists are one list.
    """
    clean = F.array_sort(F.array_distinct(F.filter("members", lambda x: x.isNotNull())))
    lists = lists.select(clean.alias("members")).filter(F.size("members") > 1).distinct()
    if known is not None:
        ids = known.select(F.col(known.columns[0]).cast("bigint").alias("member")).filter(F.col("member").isNotNull()).distinct()
        # The list's content, hashed to 128 bits, names it; its members come together again
        # in a group no larger than the array they were read from.
        rows = lists.select(F.md5(F.array_join(F.col("members").cast("array<string>"), ",")).alias("list"), F.explode("members").alias("member"))
        kept = rows.join(ids, "member", "left_semi")
        lists = kept.groupBy("list").agg(F.array_sort(F.collect_set("member")).alias("members")).filter(F.size("members") > 1)
    first = F.element_at("members", 1)
    return lists.select(first.alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members") - 1)).alias("b")).distinct()


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(v, r, degree): each vertex, the one of its closed neighbourhood with the least fresh hash, and how many neighbours it has."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))
    ends = F.inline(F.array(F.struct(F.col("a").alias("v"), order("b").alias("o")), F.struct(F.col("b").alias("v"), order("a").alias("o"))))
    best = edges.select(ends).groupBy("v").agg(F.min("o.h").alias("h"), F.min_by("o.v", "o.h").alias("w"), F.count(F.lit(1)).alias("degree"))
    own = F.xxhash64(F.col("v"), F.lit(seed))
    return best.select("v", F.when(own <= F.col("h"), F.col("v")).otherwise(F.col("w")).alias("r"), "degree")


def _followed(hooks: DataFrame) -> DataFrame:
    """(v, r) with each hook followed once more, to what r is hooked to."""
    up = hooks.select(F.col("v").alias("r"), F.col("r").alias("up"))
    return hooks.join(up, "r").select("v", F.col("up").alias("r"))


def _renamed(edges: DataFrame, hooks: DataFrame, hubs: DataFrame | None, end: str) -> DataFrame:
    """edges with one end renamed. Edges of hubs meet a broadcast, so that no task gets a hub's edges; the rest are joined by hash."""
    near = hooks.select(F.col("v").alias(end), F.col("r").alias("_to"))
    if hubs is None:
        both = edges.join(near, end)
    else:
        few = F.broadcast(hubs.select(F.col("v").alias(end), F.col("r").alias("_to")))
        both = edges.join(few, end).unionByName(edges.join(few, end, "left_anti").join(near, end))
    return both.drop(end).withColumnRenamed("_to", end)


#: A hub has at least so many neighbours and more than this share of all edges' ends: of hubs there are 2 / HUB_SHARE at most.
HUB_DEGREE, HUB_SHARE = 100_000, 0.002


def contract(edges: DataFrame, seed: int = 17, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(v, label): every vertex of edges (a, b) with one label per connected component.

    Each round every vertex hooks to the member of its closed neighbourhood whose hash
    under the round's seed is least, hooks are followed once, both ends of the edges are
    renamed, loops fall away and equal edges become one. Every round at least the vertex of
    greatest hash in each component goes, so it ends by itself; a constant share of the
    vertices is expected to go, so the rounds are logarithmic and their total size is a
    multiple of the first. The hooks of all rounds are then expanded from the last to the
    first, stored every third step, so that no plan grows with the rounds. Every round is a table in
    the shared checkpoint folder: no link, component or label comes to the driver, only the
    count of edges left. Hubs, vertices with `hub_degree` neighbours and more than HUB_SHARE of
    all ends, are renamed by a broadcast of at most 1,000 rows.
    """
    rounds: list[DataFrame] = []
    edges = cut(edges)
    while left := edges.count():
        hooked = cut(_hooks(edges, seed + 7919 * len(rounds)))
        hooks = cut(_followed(hooked.select("v", "r")))
        rounds.append(hooks)
        most = max(hub_degree, HUB_SHARE * left)
        hubs = hooked.filter(F.col("degree") > most).select("v").join(hooks, "v") if left > most else None
        renamed = _renamed(_renamed(edges, hooks, hubs, "a"), hooks, hubs, "b").filter(F.col("a") != F.col("b"))
        edges = cut(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("label"))
    labels = rounds[-1].select("v", F.col("r").alias("label"))
    for step, hooks in enumerate(reversed(rounds[:-1]), 1):
        above = labels.select(F.col("v").alias("r"), "label")
        labels = hooks.join(above, "r", "left").select("v", F.coalesce("label", "r").alias("label"))
        labels = cut(labels) if step % 3 == 0 else labels
    return labels


def consolidate(lists: Sequence[DataFrame], known: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """(member, group_id): every id linked to another, group_id the smallest id of its group.

    `lists` are frames with an array column members (see `pairs_as_lists`); extra columns
    are not read. A list of one, a pair of one id with itself, nulls and ids not in `known`
    link nothing and give no row; empty tables give no row; repeated, turned and contained
    lists change nothing.
    """
    union = lists[0].select("members")
    for more in lists[1:]:
        union = union.unionByName(more.select("members"))
    labels = cut(contract(edges_of(union, known), seed))
    least = labels.groupBy("label").agg(F.min("v").alias("group_id"))
    return labels.join(least, "label").select(F.col("v").alias("member"), "group_id")
