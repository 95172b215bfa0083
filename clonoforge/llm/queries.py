"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.llm.canonical import LOOKALIKES, OTHER_SEGMENTS, UNMATCHED, GeneRules, bounded, canonical_by_join, canonical_values, gene_matcher, gene_table, typed_values
from clonoforge.llm.groups import consolidate, pairs_as_lists
from clonoforge.llm.leaks import find_leaks
from clonoforge.llm.packing import fill, pack, token_counts
from clonoforge.llm.truncation import judge, rates
from clonoforge.session import cut, table

#: Genes whose dictionary is broadcast, more than any species has; beyond it the dictionary is a table.
MOST_GENES = 20_000
GENE_FIELDS = {"v_gene": "TRB", "va_gene": "TRA"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every linked record."""
    matches = pairs_as_lists(table(spark, d, "chain_matches"), "rid_a", "rid_b")
    lists = table(spark, d, "paired_clusters").select(F.col("member_indices").alias("members"))
    return consolidate([matches, lists], table(spark, d, "chain_records").select("rid")).select(F.col("member").alias("rid"), "group_id")


P2_FOUND_SQL = """
WITH RECURSIVE known AS (SELECT DISTINCT rid FROM chain_records WHERE rid IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS list, member_indices FROM paired_clusters),
members AS (SELECT list, m AS member FROM (SELECT list, unnest(member_indices) AS m FROM numbered) t WHERE m IN (SELECT rid FROM known)),
heads AS (SELECT list, min(member) AS head FROM members GROUP BY list),
links AS (
  SELECT rid_a AS a, rid_b AS b FROM chain_matches WHERE rid_a IN (SELECT rid FROM known) AND rid_b IN (SELECT rid FROM known) AND rid_a <> rid_b
  UNION SELECT head, member FROM heads JOIN members USING (list) WHERE head <> member
),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(rid, least) AS (
  SELECT a, a FROM ways
  UNION
  SELECT w.b, r.least FROM reach r JOIN ways w ON w.a = r.rid WHERE r.least < w.b
)
SELECT rid, min(least) AS group_id FROM reach GROUP BY rid
"""


def genes_of(records: DataFrame, reference: DataFrame, keep: list[str], most: int = MOST_GENES) -> DataFrame:
    """(keep..., field, value, name) of the typed genes, by a broadcast dictionary, or for more than `most` genes by a join; the same rows."""
    rows = bounded(reference.select("chain", "gene", "freq"), most)
    if rows is not None:
        matchers = {field: gene_matcher(chain, [(r.gene, r.freq or 0.0) for r in rows if r.chain == chain]) for field, chain in GENE_FIELDS.items()}
        return canonical_values(records, matchers, keep)
    fields = F.create_map(*[F.lit(x) for field, chain in GENE_FIELDS.items() for x in (chain, field)])
    listed = reference.withColumn("field", F.element_at(fields, F.col("chain"))).filter(F.col("field").isNotNull())
    typed = typed_values(records, list(GENE_FIELDS), keep)
    unlisted = typed.join(listed.select("field", F.col("gene").alias("value")), ["field", "value"], "left_anti")
    return unlisted.join(canonical_by_join(unlisted, gene_table(listed), GeneRules(), ["field"]), ["field", "value"]).select(*keep, "field", "value", "name")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return genes_of(table(spark, d, "chain_records"), table(spark, d, "gene_reference"), ["rid"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed gene of every typed value that is not one already."""
    return _genes(spark, d).select("rid", "field", F.col("name").alias("gene"))


def p3_misses(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no listed gene, and in how many rows each stands."""
    return _genes(spark, d).filter(F.col("name") == UNMATCHED).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def _plain_letters() -> dict[str, str]:
    """Every character of the first plane that stands for one ASCII sign, and that sign."""
    out = {chr(k): chr(v) if isinstance(v, int) else v for k, v in LOOKALIKES.items()}
    for c in map(chr, (k for k in range(0x80, 0x10000) if not 0xD800 <= k < 0xE000)):
        if len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain.isascii() and plain.isprintable() and plain != "'":
            out.setdefault(c, plain)
    return out | dict.fromkeys("‐‑‒–—―−﹣－", "-") | dict.fromkeys("∕⁄／", "/")


def _number_sql(c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN coalesce(nullif(ltrim(translate({c}, 'OIL|', '0111'), '0'), ''), '0') ELSE '' END"


# The same genes by another way: words and remarks are cut off by expressions, numbers compared, letters by their distance.
_PLAIN = _plain_letters()
_N = "[0-9OIL|]+"
_GENE = rf"([A-Z](?:[A-Z]|[\s._-]+[A-Z])*?)[\s._:-]*({_N})(?:(?:\s*[-._]+\s*|\s+)({_N}))?(?:[\s/_.,;-]*DV[\s-]*({_N}(?:[-.]{_N})?))?(?:[^A-Z0-9].*)?$"
_OWN = ("TR{x}V", "TCR{x}V", "TCRV{x}", "{x}V", "V{x}")
_GENES_SQL = f"""
WITH typed AS (
  SELECT rid, 'v_gene' AS field, 'TRB' AS chain, v_gene AS value FROM chain_records UNION ALL SELECT rid, 'va_gene', 'TRA', va_gene FROM chain_records
), given AS (
  SELECT * FROM typed t WHERE upper(trim(value, E' \\t\\r\\n')) NOT IN ('', 'NA') AND NOT EXISTS (SELECT 1 FROM gene_reference g WHERE g.chain = t.chain AND g.gene = t.value)
), folded AS (SELECT DISTINCT chain, value, upper(translate(value, '{''.join(_PLAIN)}', '{''.join(_PLAIN.values())}')) AS x FROM given
), cleaned AS (
  SELECT chain, value, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\*\\s*[0-9OIL]+(:[0-9]+)?', ' ', 'g'),
    'T[\\s-]?CELL[\\s-]+RECEPTOR', 'TCR'), '\\bALPHA\\b', 'A'), '\\bBETA\\b', 'B'), '\\bVARIABLE\\b|\\bVAR\\b\\.?', 'V'), '^[^A-Z]*(?:(?:HUMAN|HOMO SAPIENS|GENE|IMGT|HSA?)[^A-Z]+)+', ''), '^[^A-Z]*HSA?_?(TR|TCR)', '\\1') AS x FROM folded
), parts AS (SELECT chain, value, regexp_extract(x, '{_GENE}', ['pre', 'fam', 'mem', 'dv']) AS p FROM cleaned
), read AS (
  SELECT chain, value, regexp_replace(p.pre, '[^A-Z]', '', 'g') AS letters, {_number_sql('p.fam')} || CASE WHEN p.mem <> '' THEN '-' || {_number_sql('p.mem')} ELSE '' END || CASE WHEN p.dv <> '' THEN '/DV' || {_number_sql('p.dv')} ELSE '' END AS number FROM parts
), meant AS (
  SELECT r.chain, r.value, max(g.gene) AS gene FROM read r JOIN gene_reference g ON g.chain = r.chain AND substr(g.gene, 5) = r.number
  WHERE list_contains(list_transform({list(_OWN)!r}, lambda s: replace(s, '{{x}}', substr(r.chain, 3))), r.letters)
    OR length(r.letters) > 2 AND r.letters NOT IN ({', '.join(repr(x) for x in OTHER_SEGMENTS)})
      AND len(list_filter({list(_OWN)!r}, lambda s: damerau_levenshtein(replace(s, '{{x}}', substr(r.chain, 3)), r.letters) <= 1)) > 0
  GROUP BY 1, 2
)
"""
P3_FOUND_SQL = _GENES_SQL + "SELECT g.rid, g.field, coalesce(m.gene, 'UNMATCHED') AS gene FROM given g LEFT JOIN meant m ON m.chain = g.chain AND m.value = g.value"
P3_MISSES_SQL = _GENES_SQL + "SELECT g.field, g.value, count(*)::BIGINT AS n_rows FROM given g LEFT JOIN meant m ON m.chain = g.chain AND m.value = g.value WHERE m.gene IS NULL GROUP BY 1, 2"


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text in a container of each capacity, measured in tokens."""
    sizes = token_counts(table(spark, d, "documents"), "text", ["doc_id"])
    return pack(sizes, table(spark, d, "pack_targets"), "doc_id", "n_tokens", "target_id", "capacity_tokens")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill(p6_pack(spark, d), table(spark, d, "pack_targets"), "target_id", "capacity_tokens")


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers of each capacity: every text is there, nothing is lost, overfull or split without need."""
    sizes = cut(token_counts(table(spark, d, "documents"), "text", ["doc_id"]))
    targets = table(spark, d, "pack_targets")
    packed = cut(pack(sizes, targets, "doc_id", "n_tokens", "target_id", "capacity_tokens"))
    per_item = packed.groupBy("target_id", "doc_id").agg(F.sum("length").alias("held"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id").join(targets.select("target_id", F.col("capacity_tokens").cast("bigint").alias("room")), "target_id")
    needed = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("room")))
    items = per_item.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("n_tokens") - F.col("held")).alias("n_lost"), F.count_if(F.col("pieces") != needed).alias("n_missplit"))
    full = packed.filter("container_id IS NOT NULL").groupBy("target_id", "container_id").agg(F.sum("length").alias("held")).join(targets.select("target_id", F.col("capacity_tokens").alias("room")), "target_id")
    return items.join(full.groupBy("target_id").agg(F.count_if(F.col("held") > F.col("room")).alias("n_overfull")), "target_id")


P6_SOUND_SQL = "SELECT target_id, (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS n_items, 0::BIGINT AS n_lost, 0::BIGINT AS n_missplit, 0::BIGINT AS n_overfull FROM pack_targets WHERE capacity_tokens > 0"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document and the test items that stand in it."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage")


P7_FOUND_SQL = """
WITH runs AS (
  SELECT item_id, regexp_extract_all(lower(regexp_replace(passage, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+') AS w FROM eval_items
), grams AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM runs) t
), texts AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, array_to_string(w[i:i+11], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM texts) t
)
SELECT DISTINCT doc_id, item_id FROM places JOIN grams USING (gram)
"""


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_found(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


P7_ITEMS_SQL = f"SELECT item_id, count(DISTINCT doc_id)::BIGINT AS n_docs FROM ({P7_FOUND_SQL}) found GROUP BY item_id"

def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose text was cut."""
    return judge(table(spark, d, "documents"), "doc_id", "text", "source").filter("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of its texts that each source cuts."""
    return rates(judge(table(spark, d, "documents"), "doc_id", "text", "source"), "source")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_misses": p3_misses,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_sound": p6_sound,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}
SQL = {"p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p3_misses": P3_MISSES_SQL, "p6_sound": P6_SOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_items": P7_ITEMS_SQL}
