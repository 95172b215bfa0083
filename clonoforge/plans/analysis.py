"""Queries of the analytic commands: motifs, groups, distances, linkage, scores, search, alignment."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.functions import columns as C
from clonoforge.functions.kernels import global_scores
from clonoforge.functions.matrices import blosum62, encode, mismatch_distances
from clonoforge.operators import alignment as A
from clonoforge.operators import distances as D
from clonoforge.operators import enrichment as E
from clonoforge.operators import graph as G
from clonoforge.operators import scoring as S
from clonoforge.operators import similarity as M
from clonoforge.operators.motifs import cluster_motifs
from clonoforge.operators.pipeline import MODES, usable_records
from clonoforge.plans import inputs as I
from clonoforge.session import cut, table

# --- statistics in SQL ------------------------------------------------------------


def _ln_choose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


def _chance(k: str, nq: str, good: str, total: str) -> str:
    return f"exp({_ln_choose(good, k)} + {_ln_choose(f'({total}) - ({good})', f'({nq}) - ({k})')} - {_ln_choose(total, nq)})"


def fisher_sql(a: str, nq: str, c: str, nr: str) -> str:
    good, total = f"(({a}) + ({c}))", f"(({nq}) + ({nr}))"
    return f"least(1.0::DOUBLE, list_sum(list_transform(range(({a})::BIGINT, least({nq}, {good})::BIGINT + 1), lambda k: {_chance('k', nq, good, total)})))"


def two_sided_sql(a: str, nq: str, c: str, nr: str) -> str:
    good, total = f"(({a}) + ({c}))", f"(({nq}) + ({nr}))"
    p = lambda k: _chance(k, nq, good, total)
    return f"least(1.0::DOUBLE, list_sum(list_transform(range(greatest(0, {good} + ({nq}) - {total})::BIGINT, least({nq}, {good})::BIGINT + 1), lambda k: CASE WHEN {p('k')} <= {p(a)} * (1 + 1e-9) THEN {p('k')} ELSE 0 END)))"


REGION = "CASE WHEN length(s) > 6 THEN substr(s, 4, length(s) - 6) ELSE '' END"


def _motifs_sql(source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT s, substr(r, i::INTEGER, {k}) AS motif FROM (SELECT s, r, unnest(generate_series(1, length(r) - {k - 1})) AS i FROM (SELECT s, {REGION} AS r FROM ({source}) a) b) c" for k in C.KMER_LENGTHS)
    return f"SELECT DISTINCT s, motif FROM ({parts}) m"


def _counts_sql(source: str) -> str:
    return f"SELECT motif, count(*)::BIGINT AS n FROM ({_motifs_sql(source)}) x GROUP BY motif"


STATISTICS_SQL = f"""
SELECT s.motif, s.n AS n_sample, coalesce(r.n, 0)::BIGINT AS n_reference,
  round({fisher_sql('s.n', 't.ns', 'coalesce(r.n, 0)', 't.nr')}, 6)::DOUBLE AS p,
  round((s.n / (coalesce(r.n, 0) + 0.01::DOUBLE) / t.ns * t.nr)::DOUBLE, 6) AS fold
FROM ({_counts_sql(I.SAMPLE_SQL)}) s LEFT JOIN ({_counts_sql(I.REFERENCE_SQL)}) r ON r.motif = s.motif,
  (SELECT (SELECT count(*) FROM ({I.SAMPLE_SQL}) a) AS ns, (SELECT count(*) FROM ({I.REFERENCE_SQL}) b) AS nr) t
"""


def kmers(spark: SparkSession, d: str) -> DataFrame:
    return E.motif_members(I.sample(spark, d)).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("motif")), " ").alias("motifs"))


def motif_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.motif_counts(I.sample(spark, d))


def motif_semi(spark: SparkSession, d: str) -> DataFrame:
    return E.reference_counts(I.sample(spark, d), I.reference(spark, d))


def motif_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = E.motif_statistics(I.sample(spark, d), I.reference(spark, d))
    return s.select("motif", "n_sample", "n_reference", F.round("p", 6).alias("p"), F.round("fold", 6).alias("fold"))


def motif_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return E.local_motifs(I.sample(spark, d), I.reference(spark, d)).select("motif", "n_sample", "n_reference")


MOTIF_ENRICHMENT_SQL = f"SELECT motif, n_sample, n_reference FROM ({STATISTICS_SQL}) s WHERE n_sample >= 2 AND p <= 0.05 AND fold >= CASE length(motif) WHEN 2 THEN 1000 WHEN 3 THEN 100 ELSE 10 END"

# --- contingency tables over customers ------------------------------------------------

TABLES_SQL = """
SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING')::BIGINT AS a, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING')::BIGINT AS nq,
  count(*) FILTER (c_mktsegment <> 'BUILDING')::BIGINT AS c, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING')::BIGINT AS nr
FROM customer GROUP BY c_nationkey
"""


def _tables(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").withColumn("b", F.col("c_mktsegment") == "BUILDING")
    per = customers.groupBy("c_nationkey").agg(F.count_if("b").alias("a"), F.count_if(~F.col("b")).alias("c"))
    return per.crossJoin(F.broadcast(customers.agg(F.count_if("b").alias("nq"), F.count_if(~F.col("b")).alias("nr"))))


def fisher_test(spark: SparkSession, d: str, two_sided: bool = False) -> DataFrame:
    p = C.fisher(F.col("a"), F.col("nq"), F.col("c"), F.col("nr"), two_sided)
    return _tables(spark, d).select("c_nationkey", F.round(p, 9).alias("p"))


def odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("c_nationkey", F.round(C.odds_ratio(F.col("a"), F.col("nq"), F.col("c"), F.col("nr")), 9).alias("odds"))


ODDS_SQL = f"SELECT c_nationkey, round(CASE WHEN (nq - a) * c <> 0 THEN (a * (nr - c))::DOUBLE / ((nq - a) * c) WHEN a * (nr - c) = 0 THEN 1.0 ELSE 'infinity'::DOUBLE END, 9) AS odds FROM ({TABLES_SQL}) t"

# --- similarity groups ------------------------------------------------------------------


def _tags_sql(source: str) -> str:
    return f"SELECT s, substr(r, 1, i::INTEGER - 1) || '%' || substr(r, i::INTEGER + 1) AS tag, substr(r, i::INTEGER, 1) AS residue FROM (SELECT s, r, unnest(generate_series(1, length(r))) AS i FROM (SELECT s, {REGION} AS r FROM ({source}) a) b) c"


def wildcard_tags(spark: SparkSession, d: str) -> DataFrame:
    return E.tag_members(I.sample(spark, d))


def global_clusters(spark: SparkSession, d: str, with_matrix: bool = False) -> DataFrame:
    out = E.global_clusters(I.sample(spark, d), I.reference(spark, d), blosum62() if with_matrix else None)
    return out.select("tag", "part", "n_members", "n_reference", F.round("p", 6).alias("p"))


GLOBAL_SQL = f"""
WITH s AS (SELECT tag, count(*)::BIGINT AS n FROM ({_tags_sql(I.SAMPLE_SQL)}) x GROUP BY tag HAVING count(*) >= 2),
r AS (SELECT tag, count(*)::BIGINT AS m FROM ({_tags_sql(I.REFERENCE_SQL)}) x GROUP BY tag),
t AS (SELECT (SELECT count(*) FROM ({I.SAMPLE_SQL}) a) AS ns, (SELECT count(*) FROM ({I.REFERENCE_SQL}) b) AS nr)
SELECT s.tag, 0::INTEGER AS part, s.n AS n_members, coalesce(r.m, 0)::BIGINT AS n_reference, round({fisher_sql('s.n', 't.ns', 'coalesce(r.m, 0)', 't.nr')}, 6)::DOUBLE AS p
FROM s LEFT JOIN r ON r.tag = s.tag, t WHERE coalesce(r.m, 0) / t.nr <= 0.1
"""


_RESIDUE_PAIRS = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(C.RESIDUES) for j, b in enumerate(C.RESIDUES) if i == j or blosum62()[i, j] >= 0)
GLOBAL_MATRIX_SQL = f"""
WITH RECURSIVE alike(x, y) AS (VALUES {_RESIDUE_PAIRS}),
s AS (SELECT tag, residue, count(*)::BIGINT AS n FROM ({_tags_sql(I.SAMPLE_SQL)}) x GROUP BY 1, 2),
r AS (SELECT tag, residue, count(*)::BIGINT AS m FROM ({_tags_sql(I.REFERENCE_SQL)}) x GROUP BY 1, 2),
t AS (SELECT (SELECT count(*) FROM ({I.SAMPLE_SQL}) a) AS ns, (SELECT count(*) FROM ({I.REFERENCE_SQL}) b) AS nr),
kept AS (SELECT s.tag FROM (SELECT tag, sum(n) AS n FROM s GROUP BY 1) s LEFT JOIN (SELECT tag, sum(m) AS m FROM r GROUP BY 1) r ON r.tag = s.tag, t WHERE s.n >= 2 AND coalesce(r.m, 0) / t.nr <= 0.1),
own AS (SELECT s.* FROM s JOIN kept ON kept.tag = s.tag),
reach(tag, residue, least) AS (
  SELECT tag, residue, residue FROM own
  UNION SELECT b.tag, b.residue, a.least FROM reach a JOIN alike k ON k.x = a.residue JOIN own b ON b.tag = a.tag AND b.residue = k.y WHERE a.least < b.residue
),
labels AS (SELECT tag, residue, min(least) AS part FROM reach GROUP BY 1, 2),
ranks AS (SELECT tag, residue, row_number() OVER (PARTITION BY tag ORDER BY residue) AS k FROM own),
sizes AS (SELECT l.tag, l.part, sum(o.n)::BIGINT AS n FROM labels l JOIN own o ON o.tag = l.tag AND o.residue = l.residue GROUP BY 1, 2),
fits AS (SELECT DISTINCT l.tag, l.part, k.y AS residue FROM labels l JOIN alike k ON k.x = l.residue),
others AS (SELECT f.tag, f.part, sum(r.m)::BIGINT AS m FROM fits f JOIN r ON r.tag = f.tag AND r.residue = f.residue GROUP BY 1, 2)
SELECT z.tag, k.k::INTEGER AS part, z.n AS n_members, coalesce(o.m, 0)::BIGINT AS n_reference, round({fisher_sql('z.n', 't.ns', 'coalesce(o.m, 0)', 't.nr')}, 6)::DOUBLE AS p
FROM sizes z JOIN ranks k ON k.tag = z.tag AND k.residue = z.part LEFT JOIN others o ON o.tag = z.tag AND o.part = z.part, t WHERE z.n >= 2
"""


def hamming_pairs(spark: SparkSession, d: str, most: int = 1) -> DataFrame:
    return D.hamming_pairs(I.sample(spark, d), "s", most)


def _hamming_sql(most: int) -> str:
    return f"SELECT a.s AS a, b.s AS b, hamming(a.s, b.s)::INTEGER AS d FROM ({I.SAMPLE_SQL}) a JOIN ({I.SAMPLE_SQL}) b ON length(a.s) = length(b.s) AND a.s < b.s WHERE hamming(a.s, b.s) <= {most}"


def gliph1_components(spark: SparkSession, d: str) -> DataFrame:
    sample, reference = I.sample(spark, d), I.reference(spark, d)
    clusters, members = E.network_clusters(sample, reference, sample.count())
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(sizes, "cid").select("cid", "pattern", "kind", "n")


def cluster_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    clusters, members = E.merge_clusters(*E.gliph_candidates(I.sample(spark, d), I.reference(spark, d)))
    return clusters.join(members.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid").select("pattern", "kind", F.round("p", 9).alias("p"), "n")


_LEAST_FOLD_SQL = "CASE length(motif) WHEN 2 THEN 1000 WHEN 3 THEN 100 ELSE 10 END"
MERGE_SQL = f"""
WITH RECURSIVE t AS (SELECT (SELECT count(*) FROM ({I.SAMPLE_SQL}) a) AS ns, (SELECT count(*) FROM ({I.REFERENCE_SQL}) b) AS nr),
own AS ({_motifs_sql(I.SAMPLE_SQL)}), tags AS (SELECT DISTINCT tag, s FROM ({_tags_sql(I.SAMPLE_SQL)}) x),
mine AS (SELECT motif, count(*)::BIGINT AS n FROM own GROUP BY 1), theirs AS ({_counts_sql(I.REFERENCE_SQL)}),
tested AS (SELECT s.motif, s.n, {fisher_sql('s.n', 't.ns', 'coalesce(r.n, 0)', 't.nr')} AS p, s.n / (coalesce(r.n, 0) + 0.01::DOUBLE) / t.ns * t.nr AS fold FROM mine s LEFT JOIN theirs r ON r.motif = s.motif, t WHERE s.n >= 2),
gs AS (SELECT tag, count(*)::BIGINT AS n FROM tags GROUP BY 1 HAVING count(*) >= 2), gr AS (SELECT tag, count(*)::BIGINT AS m FROM ({_tags_sql(I.REFERENCE_SQL)}) x GROUP BY 1),
clusters AS (
  SELECT 'local|' || motif || '|0' AS cid, motif AS pattern, 'local' AS kind, p FROM tested WHERE p <= 0.05 AND fold >= {_LEAST_FOLD_SQL}
  UNION ALL SELECT 'global|' || gs.tag || '|0', gs.tag, 'global', {fisher_sql('gs.n', 't.ns', 'coalesce(gr.m, 0)', 't.nr')} FROM gs LEFT JOIN gr ON gr.tag = gs.tag, t WHERE coalesce(gr.m, 0) / t.nr <= 0.1
), members AS (
  SELECT c.cid, c.kind, o.s FROM clusters c JOIN own o ON c.kind = 'local' AND o.motif = c.pattern
  UNION ALL SELECT c.cid, c.kind, g.s FROM clusters c JOIN tags g ON c.kind = 'global' AND g.tag = c.pattern
), sizes AS (SELECT cid, count(*) AS n FROM members GROUP BY 1),
shared AS (SELECT l.cid AS l, g.cid AS g, count(*) AS n FROM members l JOIN members g ON g.s = l.s AND l.kind = 'local' AND g.kind = 'global' GROUP BY 1, 2 HAVING count(*) >= 4),
links AS (SELECT h.l, h.g FROM shared h JOIN sizes a ON a.cid = h.l JOIN sizes b ON b.cid = h.g WHERE h.n / least(a.n, b.n) >= 0.8 AND NOT (h.n = a.n AND h.n = b.n)),
ways AS (SELECT l AS a, g AS b FROM links UNION SELECT g, l FROM links),
reach(v, least) AS (SELECT a, a FROM ways UNION SELECT w.b, r.least FROM reach r JOIN ways w ON w.a = r.v WHERE r.least < w.b),
labelled AS (SELECT c.*, coalesce(x.component, c.cid) AS component FROM clusters c LEFT JOIN (SELECT v, min(least) AS component FROM reach GROUP BY 1) x ON x.v = c.cid),
merged AS (SELECT component, coalesce(first(pattern ORDER BY length(pattern) DESC, pattern) FILTER (kind = 'local'), first(pattern ORDER BY length(pattern) DESC, pattern) FILTER (kind = 'global')) AS pattern,
  CASE WHEN bool_or(kind = 'global') THEN 'global' ELSE 'local' END AS kind, min(p) AS p FROM labelled GROUP BY 1),
inside AS (SELECT l.component, count(DISTINCT m.s)::BIGINT AS n FROM members m JOIN labelled l ON l.cid = m.cid GROUP BY 1)
SELECT g.pattern, g.kind, round(g.p, 9)::DOUBLE AS p, i.n FROM merged g JOIN inside i ON i.component = g.component WHERE i.n >= 2
"""


PATTERNS = ("A%G", "G%%E", "S%", "%%%%%%%%%%")


def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    """In how many sequences' motif regions each pattern stands."""
    sample = I.sample(spark, d)
    counts = [E.pattern_counts(sample, p).select(F.lit(p).alias("pattern"), "n") for p in PATTERNS]
    return reduce(DataFrame.unionByName, counts)


PATTERN_MATCH_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (regexp_matches({REGION}, '{p.replace('%', '.')}'))::BIGINT AS n FROM ({I.SAMPLE_SQL}) x" for p in PATTERNS)


def singletons(spark: SparkSession, d: str) -> DataFrame:
    sample, reference = I.sample(spark, d), I.reference(spark, d)
    members = E.motif_members(sample).join(E.local_motifs(sample, reference).select("motif"), "motif", "left_semi").select("s")
    records = table(spark, d, "cluster_output").select(F.upper(F.trim("tcrb")).alias("beta")).filter(C.is_cdr3("beta"))
    return E.single_clusters(records, "beta", reference, members).select("pattern", "n_records", F.round("p", 6).alias("p"))


SINGLETONS_SQL = f"""
WITH rec AS (SELECT upper(trim(tcrb, ' ')) AS s FROM cluster_output WHERE regexp_full_match(upper(trim(tcrb, ' ')), {I._CDR3})),
n AS (SELECT s, count(*)::BIGINT AS n_records FROM rec GROUP BY s),
inside AS (SELECT DISTINCT m.s FROM ({_motifs_sql(I.SAMPLE_SQL)}) m JOIN ({MOTIF_ENRICHMENT_SQL}) e ON e.motif = m.motif),
t AS (SELECT (SELECT count(*) FROM rec) AS ns, (SELECT count(*) FROM ({I.REFERENCE_SQL}) b) AS nr),
r AS (SELECT s, count(*) AS m FROM ({I.REFERENCE_SQL}) x GROUP BY s)
SELECT n.s AS pattern, n.n_records, round({fisher_sql('n.n_records', 't.ns', 'coalesce(r.m, 0)', 't.nr')}, 6)::DOUBLE AS p
FROM n LEFT JOIN r ON r.s = n.s, t WHERE n.n_records >= 2 OR n.s NOT IN (SELECT s FROM inside)
"""


def exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return I.chains(spark, d).groupBy("beta", "alpha").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid")).filter("n >= 2")


# --- distances -----------------------------------------------------------------------------

_D = mismatch_distances(blosum62())
_D_LIST = "[" + ", ".join(str(int(x)) for x in _D.ravel()) + "]"


def tcrdist_pairs(spark: SparkSession, d: str, cutoff: int = 8, equal_only: bool = False) -> DataFrame:
    pairs = D.distance_pairs(I.sample(spark, d), "s", cutoff)
    return pairs.filter(F.length("a") == F.length("b")) if equal_only else pairs


TCRDIST_SQL = f"""
WITH coded AS (SELECT s, length(s) AS n, list_transform(range(4, length(s) - 1), lambda i: instr('{C.RESIDUES}', substr(s, i::INTEGER, 1)) - 1) AS c FROM ({I.SAMPLE_SQL}) x),
m AS (SELECT {_D_LIST} AS d)
SELECT a, b, dist::INTEGER AS d FROM (
  SELECT x.s AS a, y.s AS b, coalesce(list_sum(list_transform(range(1, len(x.c) + 1), lambda i: m.d[x.c[i] * 20 + y.c[i] + 1])), 0) AS dist
  FROM coded x JOIN coded y ON x.n = y.n AND x.s < y.s, m) t WHERE dist <= 8
"""


def _unequal_sql(sequences: str, cutoff: int) -> str:
    """(a, b, d) of all sequences of two lengths, one gap block in the longer at its best place; a is the shorter."""
    part = lambda begin, end, shift: f"coalesce(list_sum(list_transform(range({begin}, {end}), lambda i: m.d[x.c[i] * 20 + y.c[i + {shift}] + 1])), 0)"
    return f"""
SELECT x.s AS a, y.s AS b, list_min(list_transform(range(x.first_place, x.last_place + 1), lambda p: {part(4, 'p + 1', 0)} + {part('greatest(p + 1, 1)', 'x.n - 1', '(y.n - x.n)')})) + (y.n - x.n) * 4 AS dist
FROM (SELECT *, CASE WHEN n >= 10 THEN 5 ELSE 5 - (11 - n) // 2 END AS first_place, CASE WHEN n >= 10 THEN n - 5 ELSE n - 5 + (11 - n) // 2 END AS last_place FROM ({sequences}) q) x
JOIN ({sequences}) y ON y.n > x.n AND (y.n - x.n) * 4 <= {cutoff}, m
"""


_CODED_SQL = "SELECT s, length(s) AS n, list_transform(range(1, length(s) + 1), lambda i: instr('{r}', substr(s, i::INTEGER, 1)) - 1) AS c FROM ({x}) x"
ALL_TCRDIST_SQL = f"""
WITH m AS (SELECT {_D_LIST} AS d)
SELECT a, b, dist::INTEGER AS d FROM (
  SELECT a, b, d AS dist FROM ({TCRDIST_SQL}) e
  UNION ALL SELECT least(a, b), greatest(a, b), dist FROM ({_unequal_sql(_CODED_SQL.format(r=C.RESIDUES, x=I.SAMPLE_SQL), 8)}) u WHERE dist <= 8) t
"""


def germline_distance(spark: SparkSession, d: str) -> DataFrame:
    return D.germline_table(I.germline(spark, d))


GERMLINE_SQL = f"""
WITH g AS (SELECT gene, rpad(cdr1, 7, '.') || rpad(cdr2, 7, '.') || rpad(pmhc, 6, '.') AS x FROM ({I.GERMLINE_SQL}) a), m AS (SELECT {_D_LIST} AS d)
SELECT a.gene AS g1, b.gene AS g2, least(255, list_sum(list_transform(range(1, length(a.x) + 1), lambda i:
  CASE WHEN substr(a.x, i::INTEGER, 1) = '.' AND substr(b.x, i::INTEGER, 1) = '.' THEN 0 WHEN substr(a.x, i::INTEGER, 1) = '.' OR substr(b.x, i::INTEGER, 1) = '.' THEN 4
  ELSE m.d[(instr('{C.RESIDUES}', substr(a.x, i::INTEGER, 1)) - 1) * 20 + instr('{C.RESIDUES}', substr(b.x, i::INTEGER, 1))] END)))::INTEGER AS d
FROM g a, g b, m
"""


def joint_distance(spark: SparkSession, d: str) -> DataFrame:
    """Beta CDR3 (weight 3) and germline distance of all clones within three edits."""
    chains = I.chains(spark, d).filter("v_gene IS NOT NULL").select("beta", C.default_allele("v_gene").alias("v")).distinct()
    genes = I.germline(spark, d)
    known = cut(chains.join(genes.select(F.col("gene").alias("v")), "v", "left_semi"))
    cutoff = D.edit_cutoff(3, 3)
    vertices = cut(known.select(F.concat_ws("|", "beta", "v").alias("v"), "beta", F.col("v").alias("vb")))
    pairs = D.joint_pairs(vertices, cutoff, genes=genes, cdr3_weight=3)
    side = lambda c: F.struct(F.substring_index(c, "|", 1).alias("s"), F.substring_index(c, "|", -1).alias("v"))
    # The first is the one whose beta, then whose allele, comes first.
    ends = pairs.select(F.least(side("i"), side("j")).alias("x"), F.greatest(side("i"), side("j")).alias("y"), "d")
    return ends.select(F.col("x.s").alias("a"), F.col("x.v").alias("v1"), F.col("y.s").alias("b"), F.col("y.v").alias("v2"), "d")


_KNOWN_SQL = f"SELECT DISTINCT beta, CASE WHEN contains(v_gene, '*') THEN v_gene ELSE v_gene || '*01' END AS v FROM ({I.CHAINS_SQL}) c WHERE v_gene IS NOT NULL AND (CASE WHEN contains(v_gene, '*') THEN v_gene ELSE v_gene || '*01' END) IN (SELECT gene FROM ({I.GERMLINE_SQL}) g)"
JOINT_SQL = f"""
WITH known AS ({_KNOWN_SQL}), m AS (SELECT {_D_LIST} AS d), coded AS ({_CODED_SQL.format(r=C.RESIDUES, x='SELECT DISTINCT beta AS s FROM known')}),
near AS (
  SELECT a, b, dist FROM (
    SELECT x.s AS a, y.s AS b, coalesce(list_sum(list_transform(range(4, x.n - 1), lambda i: m.d[x.c[i] * 20 + y.c[i] + 1])), 0) AS dist FROM coded x JOIN coded y ON x.n = y.n AND x.s < y.s, m) t WHERE dist <= 12
  UNION ALL SELECT least(a, b), greatest(a, b), dist FROM ({_unequal_sql('SELECT * FROM coded', 12)}) u WHERE dist <= 12
  UNION ALL SELECT s, s, 0 FROM coded
), sides AS (SELECT n.a, k.v AS v1, n.b, l.v AS v2, n.dist FROM near n JOIN known k ON k.beta = n.a JOIN known l ON l.beta = n.b WHERE n.a < n.b OR k.v < l.v),
loops AS (SELECT g1, g2, d AS g FROM ({GERMLINE_SQL}) x)
SELECT a, v1, b, v2, least(255, least(255, dist * 3) + g)::INTEGER AS d FROM sides JOIN loops ON g1 = v1 AND g2 = v2 WHERE least(255, least(255, dist * 3) + g) <= 36
"""

def mode_pairs(spark: SparkSession, d: str, mode: str, cutoff: int) -> DataFrame:
    """Pairs of different records within a distance under one of the distance modes."""
    kind = MODES[mode]
    usable = usable_records(I.chains(spark, d), kind, I.germline(spark, d))
    parts = ["beta", *(["alpha"] if kind.alpha else []), *(["vb", "va"][: 1 + kind.alpha] if kind.germline else [])]
    vertices = cut(usable.select("v", *parts).distinct())
    return D.joint_pairs(vertices, cutoff, kind.alpha, I.germline(spark, d) if kind.germline else None, cdr3_weight=kind.cdr3_weight)


def _all_near_sql(column: str, cutoff: int) -> str:
    """CTEs near_<column>(a, b, dist): every two values within the cutoff, both ways and each with itself."""
    return f"""
c_{column} AS ({_CODED_SQL.format(r=C.RESIDUES, x=f'SELECT DISTINCT {column} AS s FROM vertices')}),
half_{column} AS (
  SELECT a, b, dist FROM (SELECT x.s AS a, y.s AS b, coalesce(list_sum(list_transform(range(4, x.n - 1), lambda i: m.d[x.c[i] * 20 + y.c[i] + 1])), 0) AS dist FROM c_{column} x JOIN c_{column} y ON x.n = y.n AND x.s < y.s, m) t WHERE dist <= {cutoff}
  UNION ALL SELECT a, b, dist FROM ({_unequal_sql(f'SELECT * FROM c_{column}', cutoff)}) u WHERE dist <= {cutoff}),
near_{column} AS (SELECT a, b, dist FROM half_{column} UNION ALL SELECT b, a, dist FROM half_{column} UNION ALL SELECT s, s, 0 FROM c_{column})"""


def _mode_sql(mode: str, cutoff: int) -> str:
    kind = MODES[mode]
    chains_ = ["beta", "alpha"][: 1 + kind.alpha]
    alleles = {"vb": "v_gene", "va": "va_gene"} if kind.alpha else {"vb": "v_gene"}
    alleles = alleles if kind.germline else {}
    columns = [*chains_, *[f"CASE WHEN contains({g}, '*') THEN {g} WHEN {g} IS NOT NULL THEN {g} || '*01' END AS {a}" for a, g in alleles.items()]]
    known = " AND ".join(["true", *[f"{a} IN (SELECT gene FROM ({I.GERMLINE_SQL}) g)" for a in alleles], *(["alpha <> ''"] if kind.alpha else [])])
    total = f"{kind.cdr3_weight} * ({' + '.join(f'n_{c}.dist' for c in chains_)})" + "".join(f" + g_{a}.d" for a in alleles)
    joins = "JOIN near_beta n_beta ON n_beta.a = x.beta JOIN vertices y ON y.beta = n_beta.b AND x.v < y.v " + ("JOIN near_alpha n_alpha ON n_alpha.a = x.alpha AND n_alpha.b = y.alpha " if kind.alpha else "") + " ".join(f"JOIN loops g_{a} ON g_{a}.g1 = x.{a} AND g_{a}.g2 = y.{a}" for a in alleles)
    return f"""
WITH m AS (SELECT {_D_LIST} AS d), vertices AS (SELECT DISTINCT *, concat_ws('|', {', '.join([*chains_, *alleles])}) AS v FROM (SELECT {', '.join(columns)} FROM ({I.CHAINS_SQL}) c) r WHERE {known}),
loops AS ({GERMLINE_SQL if kind.germline else "SELECT 1 AS g1"}), {', '.join(_all_near_sql(c, cutoff // kind.cdr3_weight) for c in chains_)}
SELECT x.v AS i, y.v AS j, ({total})::INTEGER AS d FROM vertices x {joins} WHERE {total} <= {cutoff}
"""


MODE_CUTOFFS = {"beta-full": 24, "alpha-beta": 12, "alpha-beta-full": 24}
_BLOSUM_LIST = "[" + ", ".join(str(int(x)) for x in blosum62().ravel()) + "]"
# Sequences that differ in one place align best without a gap: a gap costs 14 and a residue, the place 15 at most.
NW_SQL = f"""
SELECT a, b, list_sum(list_transform(range(1, length(a) + 1), lambda i: m.s[(instr('{C.RESIDUES}', substr(a, i::INTEGER, 1)) - 1) * 20 + instr('{C.RESIDUES}', substr(b, i::INTEGER, 1))]))::DOUBLE AS score
FROM ({_hamming_sql(1)}) p, (SELECT {_BLOSUM_LIST} AS s) m
"""

# --- linkage -----------------------------------------------------------------------------------

CUTOFFS = [1, 3, 6]


def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    return G.single_linkage(I.edges(spark, d), CUTOFFS)


def shared_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_neighbour_linkage(I.edges(spark, d), CUTOFFS)


def _linked_sql(pairs: str) -> str:
    return f"""
WITH RECURSIVE kept AS ({pairs}), ways AS (SELECT cutoff, i AS v, j AS w FROM kept UNION SELECT cutoff, j, i FROM kept),
reach(cutoff, v, least) AS (SELECT cutoff, v, v FROM ways UNION SELECT w.cutoff, w.w, r.least FROM reach r JOIN ways w ON w.cutoff = r.cutoff AND w.v = r.v WHERE r.least < w.w)
SELECT cutoff::INTEGER AS cutoff, v, min(least) AS component FROM reach GROUP BY 1, 2
"""


_LEVELS_SQL = f"SELECT c.cutoff, e.i, e.j FROM ({I.EDGES_SQL}) e JOIN (VALUES {', '.join(f'({c})' for c in CUTOFFS)}) c(cutoff) ON e.d <= c.cutoff WHERE e.i IS NOT NULL AND e.j IS NOT NULL"
SHARED_SQL = f"""
WITH lv AS ({_LEVELS_SQL}), bo AS (SELECT cutoff, i, j FROM lv UNION SELECT cutoff, j, i FROM lv),
deg AS (SELECT cutoff, i, count(*) AS n FROM bo GROUP BY 1, 2),
com AS (SELECT l.cutoff, l.i, l.j, count(*) AS common FROM lv l JOIN bo x ON x.cutoff = l.cutoff AND x.i = l.i JOIN bo y ON y.cutoff = l.cutoff AND y.i = l.j AND y.j = x.j GROUP BY 1, 2, 3)
SELECT l.cutoff, l.i, l.j FROM lv l JOIN deg a ON a.cutoff = l.cutoff AND a.i = l.i JOIN deg b ON b.cutoff = l.cutoff AND b.i = l.j
LEFT JOIN com c ON c.cutoff = l.cutoff AND c.i = l.i AND c.j = l.j
WHERE (coalesce(c.common, 0) + 2)::FLOAT >= 0.4::FLOAT * (a.n + b.n - coalesce(c.common, 0))::FLOAT
"""


def dedupe_threshold(spark: SparkSession, d: str) -> DataFrame:
    clean = table(spark, d, "paired_clusters").select("threshold", "pc_id", F.array_join(F.array_sort(F.array_distinct(F.filter("member_indices", lambda x: x.isNotNull()))).cast("array<string>"), ",").alias("members"))
    return S.dedupe_thresholds(clean.filter("members <> ''"))


DEDUPE_SQL = """
SELECT threshold, pc_id, members FROM (
  SELECT threshold, pc_id, members, row_number() OVER (PARTITION BY members ORDER BY threshold NULLS FIRST, pc_id) AS place FROM (
    SELECT threshold, pc_id, array_to_string(list_sort(list_distinct(list_filter(member_indices, lambda x: x IS NOT NULL))), ',') AS members FROM paired_clusters) a
  WHERE members <> '') b WHERE place = 1
"""

# --- scores ---------------------------------------------------------------------------------------


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, pattern, beta, v_gene, subject): the rows of cluster_output by cluster index."""
    rows = table(spark, d, "cluster_output").filter("cluster_index IS NOT NULL AND tcrb IS NOT NULL")
    return rows.select(F.col("cluster_index").alias("cluster"), "pattern", F.upper(F.trim("tcrb")).alias("beta"), F.col("vb").alias("v_gene"), "subject", "freq")


def hla_enrichment(spark: SparkSession, d: str) -> DataFrame:
    tests = S.hla_tests(_clusters(spark, d).filter("subject IS NOT NULL"), "cluster", I.hla(spark, d))
    return tests.select("cluster", "locus", "allele", "cluster_with", "draws", "others_with", "others", F.round("p", 6).alias("p"))


_TYPED_SQL = " UNION ALL ".join(f"SELECT subject, '{x}' AS locus, {x} AS alleles FROM hla WHERE {x} <> ''" for x in I.LOCI)
HLA_ENRICHMENT_SQL = f"""
WITH hla AS ({I.HLA_SQL}), typed AS ({_TYPED_SQL}),
alleles AS (SELECT DISTINCT subject, locus, trim(a, ' ') AS allele FROM (SELECT subject, locus, unnest(string_split(alleles, '/')) AS a FROM typed) t WHERE trim(a, ' ') <> ''),
pop AS (SELECT locus, count(DISTINCT subject) AS population FROM typed GROUP BY 1),
carriers AS (SELECT locus, allele, count(DISTINCT subject) AS total_with FROM alleles GROUP BY 1, 2),
ins AS (SELECT DISTINCT cluster_index AS cluster, subject FROM cluster_output WHERE cluster_index IS NOT NULL AND tcrb IS NOT NULL AND subject IS NOT NULL),
draws AS (SELECT i.cluster, t.locus, count(DISTINCT i.subject) AS draws FROM ins i JOIN typed t ON t.subject = i.subject GROUP BY 1, 2),
shared AS (SELECT i.cluster, a.locus, a.allele, count(*) AS cluster_with FROM ins i JOIN alleles a ON a.subject = i.subject GROUP BY 1, 2, 3 HAVING count(*) > 1),
r AS (SELECT s.cluster, s.locus, s.allele, s.cluster_with, d.draws, c.total_with - s.cluster_with AS others_with, p.population - d.draws AS others
  FROM shared s JOIN draws d ON d.cluster = s.cluster AND d.locus = s.locus JOIN carriers c ON c.locus = s.locus AND c.allele = s.allele JOIN pop p ON p.locus = s.locus
  WHERE d.draws >= 2 AND p.population > d.draws)
SELECT cluster, locus, allele, cluster_with::BIGINT AS cluster_with, draws::BIGINT AS draws, others_with::BIGINT AS others_with, others::BIGINT AS others, round({fisher_sql('cluster_with', 'draws', 'others_with', 'others')}, 6)::DOUBLE AS p FROM r
"""

SIZE_SQL = "SELECT p_size::BIGINT AS size, round(avg(p_retailprice) / 10000.0, 6)::DOUBLE AS probability FROM part WHERE p_size <= 40 GROUP BY 1"


def cluster_size_score(spark: SparkSession, d: str) -> DataFrame:
    table_ = table(spark, d, "part").filter("p_size <= 40").groupBy(F.col("p_size").cast("bigint").alias("size")).agg(F.round(F.avg("p_retailprice") / 10000.0, 6).alias("probability"))
    sizes = _clusters(spark, d).groupBy("cluster").agg(F.countDistinct("beta").alias("size"))
    return S.size_scores(sizes, table_).select("cluster", "size", "size_score")


def final_score(spark: SparkSession, d: str, older: bool = False) -> DataFrame:
    rows = table(spark, d, "cluster_output").fillna(1.0, ["cluster_size_score", "length_score", "vb_score", "expansion_score", "hla_score"])
    return rows.select("run_id", "row_no", "loaded_at", F.round(S.final_score(older), 12).alias("score"))


def _final_sql(scale: str) -> str:
    c = lambda x: f"CASE WHEN {x}::VARCHAR = 'nan' THEN 1.0::DOUBLE ELSE coalesce({x}, 1.0::DOUBLE) END"
    return f"SELECT run_id, row_no, loaded_at, round({c('cluster_size_score')} * {c('length_score')} * {c('vb_score')} * {c('expansion_score')} * {c('hla_score')}{scale}, 12) AS score FROM cluster_output"


def length_score_mc(spark: SparkSession, d: str) -> DataFrame:
    reference = I.reference(spark, d)
    n = reference.count()
    frequencies = reference.groupBy(F.length("s").alias("value")).agg((F.count(F.lit(1)) / F.lit(n)).alias("freq"))
    members = _clusters(spark, d).select("cluster", "pattern", "beta", F.length("beta").alias("n")).distinct()
    return S.composition_scores(members.withColumn("pattern", F.col("cluster").cast("string")), "cluster", "n", frequencies, "pattern", "length")


def v_score_mc(spark: SparkSession, d: str) -> DataFrame:
    frequencies = table(spark, d, "gene_reference").filter("chain = 'TRB'").select("gene", "freq")
    members = _clusters(spark, d).withColumn("pattern", F.col("cluster").cast("string"))
    return S.composition_scores(members, "cluster", "v_gene", frequencies, "pattern", "v")


def expansion_mc(spark: SparkSession, d: str) -> DataFrame:
    """Expansion scores of clusters against the repertoire's clone sizes, given as counts per size."""
    rows = table(spark, d, "cluster_output").select(F.upper(F.trim("tcrb")).alias("beta"), F.col("freq").alias("counts")).filter("beta IS NOT NULL")
    members = _clusters(spark, d).select("cluster", F.col("cluster").alias("name"), F.col("beta").alias("s")).distinct()
    return S.expansion_scores(members, cut(S.repertoire_counts(rows)), "cluster", "name").select("cluster", F.col("expansion_score").alias("score"))


def gliph1_mc(spark: SparkSession, d: str) -> DataFrame:
    return E.simulated_motifs(I.sample(spark, d), I.reference(spark, d))


# --- motifs, search, alignment ----------------------------------------------------------------------


def rep_motif(spark: SparkSession, d: str) -> DataFrame:
    """The representative beta motif of every group of matched records."""
    groups = G.components(I.edges(spark, d).filter("d <= 3")).select(F.col("v").alias("rid"), F.col("component").alias("cluster"))
    return cluster_motifs(groups.join(I.chains(spark, d), "rid"), "cluster", "beta")


def alpha_motif(spark: SparkSession, d: str) -> DataFrame:
    groups = G.components(I.edges(spark, d).filter("d <= 3")).select(F.col("v").alias("rid"), F.col("component").alias("cluster"))
    return cluster_motifs(groups.join(I.chains(spark, d), "rid"), "cluster", "alpha")


def _rep_motif_sql(column: str) -> str:
    """The motif of every group of matched records, word by word: support as lists of sequences."""
    return f"""
WITH RECURSIVE ways AS (SELECT i AS v, j AS w FROM ({I.EDGES_SQL}) e WHERE d <= 3 AND i IS NOT NULL AND j IS NOT NULL UNION SELECT j, i FROM ({I.EDGES_SQL}) e WHERE d <= 3 AND i IS NOT NULL AND j IS NOT NULL),
reach(v, least) AS (SELECT v, v FROM ways UNION SELECT w.w, r.least FROM reach r JOIN ways w ON w.v = r.v WHERE r.least < w.w),
seqs AS (SELECT DISTINCT g.cluster, c.{column} AS s FROM (SELECT v, min(least) AS cluster FROM reach GROUP BY 1) g JOIN ({I.CHAINS_SQL}) c ON c.rid = g.v),
sizes AS (SELECT cluster, count(s) FILTER (s <> '')::BIGINT AS n, min(s) FILTER (s <> '') AS one FROM seqs GROUP BY 1),
alike(x, y) AS (VALUES {_RESIDUE_PAIRS}),
regions AS (SELECT s.cluster, s.s, CASE WHEN length(s.s) > 6 THEN substr(s.s, 4, length(s.s) - 6) ELSE s.s END AS r FROM seqs s JOIN sizes z ON z.cluster = s.cluster WHERE s.s <> '' AND z.n > 1),
words AS (SELECT DISTINCT cluster, s, k, substr(r, i::INTEGER, k::INTEGER) AS word FROM (SELECT *, unnest(generate_series(1, length(r) - k + 1)) AS i FROM (SELECT *, unnest(range(3, 9)) AS k FROM regions) a) b),
own AS (SELECT cluster, k, word, count(*) AS own FROM words GROUP BY 1, 2, 3),
held AS (SELECT cluster, k, word, own, p, substr(word, 1, p::INTEGER) || '%' || substr(word, p::INTEGER + 2) AS mask, substr(word, p::INTEGER + 1, 1) AS letter FROM (SELECT *, unnest(range(0, k)) AS p FROM own) o),
covered AS (SELECT c.cluster, c.k, c.p, c.word AS center, c.own AS own_center, c.mask, h.letter, h.own, h.word FROM held c JOIN held h ON h.cluster = c.cluster AND h.k = c.k AND h.p = c.p AND h.mask = c.mask JOIN alike a ON a.x = c.letter AND a.y = h.letter),
breadth AS (SELECT cluster, k, p, center, any_value(own_center) AS own_center, any_value(mask) AS mask, count(*) AS breadth, string_agg(letter, '/' ORDER BY own DESC, letter) AS letters FROM covered GROUP BY 1, 2, 3, 4),
support AS (SELECT c.cluster, c.k, c.p, c.center, list_sort(list(DISTINCT w.s)) AS held FROM covered c JOIN words w ON w.cluster = c.cluster AND w.k = c.k AND w.word = c.word GROUP BY 1, 2, 3, 4),
firsts AS (SELECT b.*, len(u.held) AS support, row_number() OVER (PARTITION BY b.cluster, b.k, b.center, u.held ORDER BY b.p) AS turn FROM breadth b JOIN support u ON u.cluster = b.cluster AND u.k = b.k AND u.p = b.p AND u.center = b.center),
named AS (SELECT *, CASE WHEN breadth > 1 THEN mask ELSE center END AS consensus FROM firsts WHERE turn = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster, k ORDER BY support DESC, own_center DESC, breadth DESC, consensus, p) AS place FROM named),
chosen AS (SELECT b.*, row_number() OVER (PARTITION BY b.cluster ORDER BY b.k DESC) AS turn_k FROM best b JOIN sizes z ON z.cluster = b.cluster WHERE b.place = 1 AND b.support / z.n >= 0.5)
SELECT z.cluster, CASE WHEN z.n = 1 THEN z.one ELSE c.consensus END AS motif, CASE WHEN z.n = 1 THEN z.one WHEN c.breadth > 1 THEN substr(c.center, 1, c.p::INTEGER) || '[' || c.letters || ']' || substr(c.center, c.p::INTEGER + 2) ELSE c.center END AS degenerate,
  CASE WHEN z.n = 1 THEN 1 ELSE coalesce(c.support, 0) END::BIGINT AS support, CASE WHEN z.n = 1 THEN 1.0 ELSE c.support / z.n END::DOUBLE AS fraction, z.n
FROM sizes z LEFT JOIN chosen c ON c.cluster = z.cluster AND c.turn_k = 1
"""


def _database(spark: SparkSession, d: str) -> DataFrame:
    """Annotated sequences: those of clusters, with their patterns as epitopes."""
    rows = table(spark, d, "cluster_output").select("tcrb", F.col("kind").alias("receptor_group"), F.col("pattern").alias("epitope"), F.col("vb").alias("antigen"), F.col("condition").alias("organism")).distinct()
    return M.usable(rows, "tcrb").select("sequence", *M.ANNOTATIONS)


def tcrmatch_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.similar_pairs(M.usable(table(spark, d, "cluster_output").select("tcrb"), "tcrb"), _database(spark, d))


def tcrmatch_annotated(spark: SparkSession, d: str) -> DataFrame:
    database = cut(_database(spark, d))
    inputs = cut(M.usable(table(spark, d, "cluster_output").select("tcrb").distinct(), "tcrb"))
    pairs = M.similar_pairs(inputs, database)
    out = M.annotate(inputs.select("sequence").distinct(), pairs, database, dedupe_database=True)
    return out.withColumn("score", M.written_score())


def tcrmatch_trust4(spark: SparkSession, d: str) -> DataFrame:
    from clonoforge.sources.files import trust4_rows

    rows = table(spark, d, "cluster_output").filter("tcrb IS NOT NULL").select("freq", F.upper(F.trim("tcrb")).alias("beta"), F.coalesce("vb", F.lit(".")).alias("v"), F.coalesce("jb", F.lit(".")).alias("j")).distinct()
    lines = rows.select(F.concat_ws("\t", F.col("freq").cast("string"), F.lit("0.1"), F.lit("TGT"), "beta", "v", F.lit("."), "j", F.lit("TRBC"), F.lit("c1"), F.lit("0")).alias("value"))
    database = cut(_database(spark, d))
    rows = cut(M.usable(trust4_rows(lines), "sequence"))
    pairs = M.similar_pairs(rows, database)
    return rows.join(pairs, "sequence").select("line", "match", M.written_score().alias("score"))


def group_alignment(spark: SparkSession, d: str, replicates: int = 1000, betas: bool = True) -> DataFrame:
    """Mean alignment scores of clusters by pattern and index; groups of at most 1000 sequences by definition. Without `betas` tcrb_score is NaN."""
    rows = table(spark, d, "cluster_output").filter("cluster_index IS NOT NULL").select(F.coalesce("pattern", F.lit("")).alias("pattern"), "cluster_index", "tcra", "tcrb").distinct()
    keys = ["pattern", "cluster_index"]
    long = rows.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("c"), F.col("tcra").alias("l")), F.struct(F.lit("b").alias("c"), F.col("tcrb").alias("l")))).alias("x")).select(*keys, "x.c", F.explode(C.trimmed_list(F.upper("x.l"))).alias("s")).distinct()
    chosen = A.picked(long.filter(C.is_residues("s")), [*keys, "c"], "s")
    groups = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("c") == "a", F.col("s")))).alias("alphas"), (F.array_sort(F.collect_list(F.when(F.col("c") == "b", F.col("s")))) if betas else F.first(F.array().cast("array<string>"))).alias("betas"))
    pool: list[str] = []
    if replicates:
        pool = A.pool_of(A.unique_alphas(rows.withColumn("tcra", F.upper("tcra"))).filter(C.is_residues("s")))
    return A.score_groups(groups, pool, replicates, keys)


def group_background(spark: SparkSession, d: str) -> DataFrame:
    """Share of background samples whose alphas align better than the group's own."""
    return group_alignment(spark, d, betas=False).select("pattern", "cluster_index", "tcra_v_background")


def nw_score(spark: SparkSession, d: str) -> DataFrame:
    """Alignment score of every pair of sequences that differ in one place."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(global_scores(encode([x], len(x))[0], encode([y], len(y)))[0]) for x, y in zip(a, b, strict=True)])

    return hamming_pairs(spark, d).select("a", "b", score("a", "b").alias("score"))


QUERIES = {
    "kmers": kmers,
    "motif_counts": motif_counts,
    "motif_semi": motif_semi,
    "motif_statistics": motif_statistics,
    "motif_enrichment": motif_enrichment,
    "fisher_one_sided": fisher_test,
    "fisher_two_sided": partial(fisher_test, two_sided=True),
    "odds_ratio": odds_ratio,
    "wildcard_tags": wildcard_tags,
    "global_clusters": global_clusters,
    "global_clusters_matrix": partial(global_clusters, with_matrix=True),
    "hamming_pairs": hamming_pairs,
    "hamming_pairs_2": partial(hamming_pairs, most=2),
    "gliph1_components": gliph1_components,
    "cluster_overlap_merge": cluster_overlap_merge,
    "singletons": singletons,
    "exact_clusters": exact_clusters,
    "tcrdist_pairs_eqlen": partial(tcrdist_pairs, equal_only=True),
    "tcrdist_pairs": tcrdist_pairs,
    "pattern_match": pattern_match,
    **{f"pairs_{m.replace('-', '_')}": partial(mode_pairs, mode=m, cutoff=c) for m, c in MODE_CUTOFFS.items()},
    "germline_distance": germline_distance,
    "joint_distance": joint_distance,
    "single_linkage": single_linkage,
    "shared_neighbor": shared_neighbor,
    "dedupe_threshold": dedupe_threshold,
    "hla_enrichment": hla_enrichment,
    "cluster_size_score": cluster_size_score,
    "final_score": final_score,
    "final_score_older": partial(final_score, older=True),
    "length_score_mc": length_score_mc,
    "v_score_mc": v_score_mc,
    "expansion_mc": expansion_mc,
    "gliph1_mc": gliph1_mc,
    "rep_motif": rep_motif,
    "alpha_motif": alpha_motif,
    "tcrmatch_pairs": tcrmatch_pairs,
    "tcrmatch_annotated": tcrmatch_annotated,
    "tcrmatch_trust4": tcrmatch_trust4,
    "nw_score": nw_score,
    "group_alignment": group_alignment,
    "group_background": group_background,
}
SQL = {
    "kmers": f"SELECT s, string_agg(motif, ' ' ORDER BY motif) AS motifs FROM ({_motifs_sql(I.SAMPLE_SQL)}) m GROUP BY s",
    "motif_counts": _counts_sql(I.SAMPLE_SQL),
    "motif_semi": f"SELECT r.motif, r.n FROM ({_counts_sql(I.REFERENCE_SQL)}) r SEMI JOIN ({_counts_sql(I.SAMPLE_SQL)}) s ON s.motif = r.motif",
    "motif_statistics": STATISTICS_SQL,
    "motif_enrichment": MOTIF_ENRICHMENT_SQL,
    "fisher_one_sided": f"SELECT c_nationkey, round({fisher_sql('a', 'nq', 'c', 'nr')}, 9)::DOUBLE AS p FROM ({TABLES_SQL}) t",
    "fisher_two_sided": f"SELECT c_nationkey, round({two_sided_sql('a', 'nq', 'c', 'nr')}, 9)::DOUBLE AS p FROM ({TABLES_SQL}) t",
    "odds_ratio": ODDS_SQL,
    "wildcard_tags": _tags_sql(I.SAMPLE_SQL),
    "global_clusters": GLOBAL_SQL,
    "hamming_pairs": _hamming_sql(1),
    "hamming_pairs_2": _hamming_sql(2),
    "singletons": SINGLETONS_SQL,
    "exact_clusters": f"SELECT beta, alpha, count(*)::BIGINT AS n, min(rid) AS first_rid FROM ({I.CHAINS_SQL}) c GROUP BY 1, 2 HAVING count(*) >= 2",
    "tcrdist_pairs_eqlen": TCRDIST_SQL,
    "tcrdist_pairs": ALL_TCRDIST_SQL,
    "joint_distance": JOINT_SQL,
    "nw_score": NW_SQL,
    "cluster_overlap_merge": MERGE_SQL,
    "global_clusters_matrix": GLOBAL_MATRIX_SQL,
    "rep_motif": _rep_motif_sql("beta"),
    "alpha_motif": _rep_motif_sql("alpha"),
    "pattern_match": PATTERN_MATCH_SQL,
    **{f"pairs_{m.replace('-', '_')}": _mode_sql(m, c) for m, c in MODE_CUTOFFS.items()},
    "germline_distance": GERMLINE_SQL,
    "single_linkage": _linked_sql(_LEVELS_SQL),
    "shared_neighbor": _linked_sql(SHARED_SQL),
    "dedupe_threshold": DEDUPE_SQL,
    "hla_enrichment": HLA_ENRICHMENT_SQL,
    "cluster_size_score": f"SELECT s.cluster, s.size, coalesce(t.probability, 1.0)::DOUBLE AS size_score FROM (SELECT cluster_index AS cluster, count(DISTINCT upper(trim(tcrb, ' ')))::BIGINT AS size FROM cluster_output WHERE cluster_index IS NOT NULL AND tcrb IS NOT NULL GROUP BY 1) s LEFT JOIN ({SIZE_SQL}) t ON t.size = s.size",
    "final_score": _final_sql(""),
    "final_score_older": _final_sql(" * 0.064"),
}
