"""Motif enrichment, similarity groups and their merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoforge.functions.columns import RESIDUES, fisher, fold_change, is_cdr3, kmers, matches_pattern, motif_region, wildcard_tags
from clonoforge.functions.kernels import seed_of
from clonoforge.operators.distances import hamming_pairs
from clonoforge.operators.graph import components
from clonoforge.session import cut, spread

#: Least fold change of a motif of 2, 3 and 4 or more residues.
LEAST_FOLD = {2: 1000.0, 3: 100.0, 4: 10.0, 5: 10.0}
LEAST_SHARED, LEAST_OVERLAP = 4, 0.8


def unique_sequences(df: DataFrame, column: str, only_cdr3: bool = False) -> DataFrame:
    """(s): distinct given sequences."""
    out = df.select(F.upper(F.trim(column)).alias("s")).filter(F.col("s").isNotNull() & (F.col("s") != ""))
    return (out.filter(is_cdr3("s")) if only_cdr3 else out).distinct()


def motif_members(unique: DataFrame) -> DataFrame:
    """(motif, s): every distinct k-mer of 2 to 5 residues of the sequences' motif regions."""
    return unique.select("s", F.explode(kmers(motif_region("s"))).alias("motif"))


def motif_counts(unique: DataFrame) -> DataFrame:
    """(motif, n): in how many distinct sequences each motif stands; combined before the shuffle."""
    return motif_members(unique).groupBy("motif").agg(F.count(F.lit(1)).alias("n"))


def reference_counts(sample: DataFrame, reference: DataFrame) -> DataFrame:
    """(motif, n) of the reference, of the sample's motifs only.

    Both sides are counted first: the join meets one row per motif, of which there are at
    most 20**2 + ... + 20**5 however many sequences there are.
    """
    return motif_counts(reference).join(motif_counts(sample).select("motif"), "motif", "left_semi")


def motif_statistics(sample: DataFrame, reference: DataFrame) -> DataFrame:
    """(motif, n_sample, n_reference, p, fold) of every motif of the sample's distinct sequences."""
    n_s, n_r = sample.count(), reference.count()
    joined = motif_counts(sample).withColumnRenamed("n", "n_sample").join(motif_counts(reference).withColumnRenamed("n", "n_reference"), "motif", "left").withColumn("n_reference", F.coalesce("n_reference", F.lit(0).cast("bigint")))
    total_s, total_r = F.lit(n_s).cast("bigint"), F.lit(n_r).cast("bigint")
    return joined.select("motif", "n_sample", "n_reference", fisher(F.col("n_sample"), total_s, F.col("n_reference"), total_r).alias("p"), fold_change(F.col("n_sample"), total_s, F.col("n_reference"), total_r).alias("fold"))


def least_fold():
    out = F.lit(LEAST_FOLD[5])
    for k in (2, 3):
        out = F.when(F.length("motif") == k, LEAST_FOLD[k]).otherwise(out)
    return out


def local_motifs(sample: DataFrame, reference: DataFrame, most_p: float = 0.05, least_members: int = 2) -> DataFrame:
    """The statistics of the enriched motifs."""
    return motif_statistics(sample, reference).filter((F.col("n_sample") >= least_members) & (F.col("p") <= most_p) & (F.col("fold") >= least_fold()))


def tag_members(unique: DataFrame) -> DataFrame:
    """(tag, s, residue): the one-wildcard tags of every sequence's motif region."""
    return unique.select("s", F.explode(wildcard_tags(motif_region("s"))).alias("t")).select(F.col("t.tag").alias("tag"), "s", F.col("t.residue").alias("residue"))


def _residue_groups(scores: np.ndarray | None) -> Callable[[list[str]], dict[str, int]]:
    def group(residues: list[str]) -> dict[str, int]:
        if scores is None:
            return dict.fromkeys(residues, 0)
        out: dict[str, int] = {}
        for r in sorted(set(residues)):
            near = {out[x] for x in out if scores[RESIDUES.index(x), RESIDUES.index(r)] >= 0}
            mine = min(near, default=len(out) + 1)
            out = {x: mine if g in near else g for x, g in out.items()} | {r: mine}
        return out

    return group


def global_clusters(sample: DataFrame, reference: DataFrame, scores: np.ndarray | None = None, most_fraction: float = 0.1, least_members: int = 2) -> DataFrame:
    """(tag, part, n_members, n_reference, p): sequences alike but for one residue of the motif region.

    With `scores` the residues at the wildcard must hang together by non-negative scores,
    which can part a tag into several clusters, and only reference sequences whose residue
    fits one of the cluster's count. The grouping works on a tag's distinct residues, of
    which there are at most twenty.
    """
    n_s, n_r = sample.count(), reference.count()
    own = tag_members(sample).groupBy("tag", "residue").agg(F.count(F.lit(1)).alias("n"))
    ref = tag_members(reference).groupBy("tag", "residue").agg(F.count(F.lit(1)).alias("m"))
    per_tag = own.groupBy("tag").agg(F.sum("n").alias("n_all"), F.collect_list(F.struct("residue", "n")).alias("own")).filter(F.col("n_all") >= least_members)
    ref_tag = ref.groupBy("tag").agg(F.sum("m").alias("m_all"), F.collect_list(F.struct("residue", "m")).alias("ref"))
    joined = per_tag.join(ref_tag, "tag", "left").filter(F.coalesce("m_all", F.lit(0)) / F.greatest(F.lit(n_r), F.lit(1)) <= most_fraction)
    if scores is None:
        parts = joined.select("tag", F.lit(0).alias("part"), F.col("n_all").alias("n_members"), F.coalesce("m_all", F.lit(0).cast("bigint")).alias("n_reference"))
    else:
        group = _residue_groups(scores)

        def split(frames):
            for pdf in frames:
                rows = []
                for tag, members, others in zip(pdf["tag"], pdf["own"], pdf["ref"], strict=True):
                    labels = group([r["residue"] for r in members])
                    others = [] if others is None else others
                    for part in sorted(set(labels.values())):
                        inside = [r for r in labels if labels[r] == part]
                        n = sum(int(r["n"]) for r in members if r["residue"] in inside)
                        m = sum(int(r["m"]) for r in others if any(x == r["residue"] or scores[RESIDUES.index(x), RESIDUES.index(r["residue"])] >= 0 for x in inside))
                        if n >= least_members:
                            rows.append((tag, part, n, m))
                yield pd.DataFrame(rows, columns=["tag", "part", "n_members", "n_reference"])

        parts = joined.select("tag", "own", "ref").mapInPandas(split, "tag string, part int, n_members bigint, n_reference bigint")
    p = fisher(F.col("n_members"), F.lit(n_s).cast("bigint"), F.col("n_reference"), F.lit(n_r).cast("bigint"))
    return parts.withColumn("p", p)


def global_members(sample: DataFrame, clusters: DataFrame, scores: np.ndarray | None = None) -> DataFrame:
    """(tag, part, s): the members of global clusters."""
    members = tag_members(sample)
    if scores is None:
        return members.join(clusters.select("tag", "part"), "tag").select("tag", "part", "s").distinct()
    group = _residue_groups(scores)

    @F.pandas_udf("array<struct<residue:string,part:int>>")
    def parts(residues: pd.Series) -> pd.Series:
        return residues.map(lambda r: [{"residue": x, "part": g} for x, g in group(list(r)).items()])

    residues = members.groupBy("tag").agg(F.sort_array(F.collect_set("residue")).alias("r"))
    labels = residues.select("tag", F.explode(parts("r")).alias("p")).select("tag", "p.residue", "p.part")
    return members.join(labels, ["tag", "residue"]).join(clusters.select("tag", "part"), ["tag", "part"]).select("tag", "part", "s").distinct()


def gliph_candidates(sample: DataFrame, reference: DataFrame, scores: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Local and global clusters and their members: (cid, pattern, kind, p) and (cid, s)."""
    local = local_motifs(sample, reference)
    global_ = global_clusters(sample, reference, scores)
    name = lambda kind, pattern, part: F.concat_ws("|", F.lit(kind), pattern, part.cast("string"))
    clusters = local.select(name("local", F.col("motif"), F.lit(0)).alias("cid"), F.col("motif").alias("pattern"), F.lit("local").alias("kind"), "p").unionByName(
        global_.select(name("global", F.col("tag"), F.col("part")).alias("cid"), F.col("tag").alias("pattern"), F.lit("global").alias("kind"), "p")
    )
    in_local = motif_members(sample).join(local.select("motif"), "motif", "left_semi").select(name("local", F.col("motif"), F.lit(0)).alias("cid"), "s")
    in_global = global_members(sample, global_, scores).select(name("global", F.col("tag"), F.col("part")).alias("cid"), "s")
    return cut(clusters), cut(in_local.unionByName(in_global).distinct())


def overlapping_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(l, g): local and global clusters sharing 4 members or more, and 0.8 of the smaller, unless equal.

    Members that stand in one local and one global cluster meet on the sequence; per
    sequence these are at most its k-mers times its tags, a bounded number.
    """
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    kinds = members.join(clusters.select("cid", "kind"), "cid")
    left = kinds.filter("kind = 'local'").select("s", F.col("cid").alias("l"))
    right = kinds.filter("kind = 'global'").select("s", F.col("cid").alias("g"))
    shared = left.join(right, "s").groupBy("l", "g").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= LEAST_SHARED)
    sized = shared.join(sizes.withColumnsRenamed({"cid": "l", "n": "nl"}), "l").join(sizes.withColumnsRenamed({"cid": "g", "n": "ng"}), "g")
    return sized.filter((F.col("shared") / F.least("nl", "ng") >= LEAST_OVERLAP) & ~((F.col("shared") == F.col("nl")) & (F.col("shared") == F.col("ng")))).select("l", "g")


def merge_clusters(clusters: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlapping local and global clusters as one: (cid, pattern, kind, p) and (cid, s).

    The pattern is the longest (then first) local one, else global one; p the least; a
    cluster of both kinds counts as global.
    """
    merged = components(overlapping_clusters(clusters, members), "l", "g").select(F.col("v").alias("cid"), "component")
    labelled = clusters.join(merged, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("pattern")), F.when(F.col("kind") == kind, F.struct(-F.length("pattern"), F.col("pattern"))))
    out = labelled.groupBy("component").agg(
        F.coalesce(best("local"), best("global")).alias("pattern"),
        F.when(F.bool_or(F.col("kind") == "global"), "global").otherwise("local").alias("kind"),
        F.min("p").alias("p"),
    )
    inside = members.join(labelled.select("cid", "component"), "cid").select(F.col("component").alias("cid"), "s").distinct()
    enough = inside.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("cid")
    return out.withColumnRenamed("component", "cid").join(enough, "cid", "left_semi"), inside.join(enough, "cid", "left_semi")


def single_clusters(records: DataFrame, beta: str, reference: DataFrame, members: DataFrame) -> DataFrame:
    """(pattern, n_records, p): every sequence of two records or more, or of no other cluster."""
    counts = records.groupBy(F.col(beta).alias("s")).agg(F.count(F.lit(1)).alias("n_records"))
    total, n_r = records.count(), reference.count()
    left = counts.join(members.select("s").distinct().withColumn("_in", F.lit(True)), "s", "left").filter((F.col("n_records") >= 2) | F.col("_in").isNull())
    ref = reference.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    joined = left.join(ref, "s", "left").withColumn("m", F.coalesce("m", F.lit(0).cast("bigint")))
    return joined.select(F.col("s").alias("pattern"), "n_records", F.coalesce(fisher(F.col("n_records"), F.lit(total).cast("bigint"), F.col("m"), F.lit(n_r).cast("bigint")), F.lit(1.0)).alias("p"))


def network_edges(sample: DataFrame, local: DataFrame, cutoff: int) -> DataFrame:
    """(a, b, kind, p): sequences tied by a shared enriched motif or by Hamming distance of their motif regions.

    A motif ties its members to its smallest one: the components, kinds and least p are
    those of all pairs.
    """
    inside = motif_members(sample).join(local.select("motif", "p"), "motif")
    heads = inside.groupBy("motif").agg(F.min("s").alias("a"))
    by_motif = inside.join(heads, "motif").filter("a <> s").select("a", F.col("s").alias("b"), F.lit("local").alias("kind"), "p")
    regions = sample.select("s", motif_region("s").alias("r"))
    pairs = hamming_pairs(regions.filter("r <> ''"), "r", cutoff).select("a", "b")
    first = regions.groupBy("r").agg(F.min("s").alias("head"))
    same = regions.join(first, "r").filter("s <> head").select(F.col("head").alias("a"), F.col("s").alias("b"))
    across = pairs.join(first.withColumnsRenamed({"r": "a", "head": "ha"}), "a").join(first.withColumnsRenamed({"r": "b", "head": "hb"}), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    by_region = same.unionByName(across).select("a", "b", F.lit("global").alias("kind"), F.lit(1.0).alias("p"))
    return by_motif.unionByName(by_region)


def simulated_motifs(sample: DataFrame, reference: DataFrame, simulations: int = 1000, least_members: int = 2) -> DataFrame:
    """(motif, p, ratio): the simulated test of every motif of `least_members` sequences or more."""
    counts = motif_statistics(sample, reference).select("motif", "n_sample", "n_reference").filter(F.col("n_sample") >= least_members)
    return simulated_motif_test(counts, sample.count(), reference.count(), simulations)


def network_clusters(sample: DataFrame, reference: DataFrame, n_records: int, most_p: float = 0.05, simulations: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The older network method: (cid, pattern, kind, p) and (cid, s).

    Motifs tie their members by the simulated test, so those absent from the reference drop
    out. Hamming distance up to 2 below 125 records, else 1; a component of both kinds of
    edges counts as local; its pattern is the literal not_implemented.
    """
    local = cut(simulated_motifs(sample, reference, simulations).filter((F.col("p") < most_p) & (F.col("ratio") >= least_fold())))
    edges = cut(network_edges(sample, local, 2 if n_records < 125 else 1))
    labels = components(edges, "a", "b")
    kinds = edges.join(labels.withColumnRenamed("v", "a"), "a").groupBy("component").agg(F.min("p").alias("p"), F.countDistinct("kind").alias("k"), F.min("kind").alias("kind"))
    clusters = kinds.select(F.col("component").alias("cid"), F.lit("not_implemented").alias("pattern"), F.when(F.col("k") > 1, "local").otherwise(F.col("kind")).alias("kind"), F.least("p", F.lit(1.0)).alias("p"))
    return clusters, labels.select(F.col("component").alias("cid"), F.col("v").alias("s"))


def simulated_motif_test(statistics: DataFrame, n_sample: int, n_reference: int, simulations: int) -> DataFrame:
    """(motif, p, ratio) by drawing samples from the reference, seeded by the motif.

    Only how many of a draw's sequences hold the motif matters. As they are picked evenly
    and with replacement, that number is binomial and drawn at once, one per simulation.
    """

    @F.pandas_udf("struct<p:double,ratio:double>")
    def test(motif: pd.Series, seen: pd.Series, held: pd.Series) -> pd.DataFrame:
        rows = []
        for m, observed, h in zip(motif, seen, held, strict=True):
            seed = seed_of(m)
            hits = np.random.RandomState([seed & 0xFFFFFFFF, seed >> 32]).binomial(n_sample, h / max(n_reference, 1), simulations) if h else np.zeros(simulations)
            mean = hits.sum() / simulations
            rows.append((max((hits >= observed).sum() / simulations, 1 / simulations), observed / mean if mean > 0 else 1 / (simulations * max(n_sample, 1))))
        return pd.DataFrame(rows, columns=["p", "ratio"])

    return spread(statistics, "motif").select("motif", test("motif", "n_sample", "n_reference").alias("t")).select("motif", "t.p", "t.ratio")


def pattern_counts(unique: DataFrame, pattern: str) -> DataFrame:
    """(n): how many sequences' motif regions hold a pattern with % wildcards."""
    return unique.filter(matches_pattern(motif_region("s"), pattern)).agg(F.count(F.lit(1)).alias("n"))


def number_clusters(clusters: DataFrame) -> DataFrame:
    """clusters with index 1, 2, ... by p, pattern, kind and id.

    Range partitions in that order are numbered each on its own and stored; only how many
    rows each partition has comes to the driver, and is added up to where it begins.
    """
    rank = F.when(F.col("kind") == "local", 0).when(F.col("kind") == "global", 1).otherwise(2)
    order = [F.col("p"), F.col("pattern"), rank, F.col("cid")]
    ranged = clusters.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    begins, total = {}, 0
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").toLocalIterator():
        begins[r["_part"]] = total
        total += r["n"]
    if not begins:
        return placed.drop("_part", "_place").withColumn("index", F.lit(0).cast("bigint"))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), F.col("_part"))
    return placed.withColumn("index", (first + F.col("_place") + 1).cast("bigint")).drop("_part", "_place")
