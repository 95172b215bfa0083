"""Queries of the relational commands: cells, splitting, chains, plates, files, enrichment tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.functions import columns as C
from clonoforge.operators.alignment import groups_of, join_scores, unique_alphas
from clonoforge.operators.cells import paired_clonotypes, ragged_rows, split_chains, split_sample_id, union_files
from clonoforge.operators.distances import lookup_germline
from clonoforge.plans import inputs as I
from clonoforge.session import table
from clonoforge.sources import files as S
from clonoforge.sources import plates as P
from clonoforge.sources.chains import LOCI, join_hla
from clonoforge.sources.tables import paired_files


def agg_cellranger(spark: SparkSession, d: str, keep_alpha: bool = False) -> DataFrame:
    return paired_clonotypes(I.contigs(spark, d), keep_alpha)


def _agg_sql(keep_alpha: bool) -> str:
    extra = "TRAV, TRAJ, " if keep_alpha else ""
    return f"""
WITH contigs AS ({I.CONTIGS_SQL}),
b AS (SELECT * FROM contigs WHERE chain = 'TRB'), a AS (SELECT * FROM contigs WHERE chain = 'TRA'),
pairs AS (SELECT replace(b.sample, '-', ':') AS sample, b.cdr3 AS CDR3b, b.v_gene AS TRBV, b.j_gene AS TRBJ, a.cdr3 AS CDR3a, a.v_gene AS TRAV, a.j_gene AS TRAJ
  FROM b LEFT JOIN a ON a.sample = b.sample AND a.barcode = b.barcode),
counted AS (SELECT sample, CDR3b, TRBV, TRBJ, CDR3a, TRAV, TRAJ, count(*) AS count FROM pairs WHERE CDR3b IS NOT NULL AND CDR3b <> '' GROUP BY ALL)
SELECT sample, CDR3b, TRBV, TRBJ, CDR3a, {extra}count::BIGINT AS count FROM counted
"""


def union_cells(spark: SparkSession, d: str) -> DataFrame:
    cols = ("cell_id", "cdr3a", "cdr3b", "sample_id")
    return union_files([table(spark, d, t).select(*cols) for t in ("cells_trvj", "cells_ctgene")])


def _subject_condition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chain_records").select("rid", F.concat_ws(":", "subject", "condition").alias("subject:condition"))


def split_once(spark: SparkSession, d: str) -> DataFrame:
    key = "`subject:condition`"
    return _subject_condition(spark, d).select("rid", C.before_first(F.col(key)).alias("subject"), C.after_first(F.col(key)).alias("condition"))


SPLIT_ID_SQL = "SELECT rid, split_part(k, ':', 1) AS subject, split_part(k, ':', -1) AS condition FROM (SELECT rid, concat_ws(':', subject, condition) AS k FROM chain_records) t"
SPLIT_ONCE_SQL = """
SELECT rid, CASE WHEN contains(k, ':') THEN nullif(trim(split_part(k, ':', 1), ' '), '') END AS subject,
  CASE WHEN contains(k, ':') THEN nullif(trim(substr(k, instr(k, ':') + 1), ' '), '') END AS condition
FROM (SELECT rid, concat_ws(':', subject, condition) AS k FROM chain_records) t
"""


def split_trvj(spark: SparkSession, d: str, chain: str = "alpha") -> DataFrame:
    return split_chains(table(spark, d, "cells_trvj").drop("loaded_at"), chain, ragged="drop")


def split_ctgene(spark: SparkSession, d: str) -> DataFrame:
    return split_chains(table(spark, d, "cells_ctgene").drop("loaded_at"), "alpha", ragged="drop")


def split_ragged(spark: SparkSession, d: str) -> DataFrame:
    return ragged_rows(table(spark, d, "cells_trvj"), "beta").select("cell_id")


def _split_sql(source: str, fields: tuple[str, ...], rest: tuple[str, ...]) -> str:
    lists = ", ".join(f"string_split({f}, ';') AS l_{f}" for f in fields)
    equal = " AND ".join(f"len(l_{f}) = len(l_{fields[0]})" for f in fields[1:])
    given = " AND ".join(f"{f} IS NOT NULL" for f in fields)
    return f"""
SELECT {', '.join(rest)}, {', '.join(f'l_{f}[i] AS {f}' for f in fields)}
FROM (SELECT *, unnest(generate_series(1, len(l_{fields[0]}))) AS i FROM (SELECT *, {lists} FROM {source} WHERE {given}) x WHERE {equal}) y
"""


def split_ragged_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row and chain of both tables whose lists differ in length, which the splitting queries drop."""
    sides = [ragged_rows(table(spark, d, t), chain).select(F.lit(t).alias("source"), F.lit(chain).alias("chain"), "cell_id") for t in ("cells_trvj", "cells_ctgene") for chain in ("alpha", "beta")]
    return union_files(sides)


def _ragged_sql() -> str:
    fields = {("cells_trvj", "alpha"): ("cdr3a", "trav", "traj"), ("cells_trvj", "beta"): ("cdr3b", "trbv", "trbj"), ("cells_ctgene", "alpha"): ("cdr3a", "ctgenea"), ("cells_ctgene", "beta"): ("cdr3b", "ctgeneb")}
    n = lambda c: f"len(string_split({c}, ';'))"
    return " UNION ALL ".join(f"SELECT '{t}' AS source, '{chain}' AS chain, cell_id FROM {t} WHERE {' OR '.join(f'{n(c)} <> {n(cols[0])}' for c in cols[1:])}" for (t, chain), cols in fields.items())


def unique_alpha(spark: SparkSession, d: str) -> DataFrame:
    return unique_alphas(table(spark, d, "cluster_output"))


UNIQUE_ALPHA_SQL = "SELECT DISTINCT s FROM (SELECT trim(unnest(string_split(tcra, ';')), ' ') AS s FROM cluster_output WHERE tcra IS NOT NULL) t WHERE s <> ''"


def align_groups(spark: SparkSession, d: str) -> DataFrame:
    g = groups_of(table(spark, d, "cluster_output"))
    return g.select("pattern", "cluster_index", "n", F.array_join("alphas", ";").alias("alphas"), F.array_join("betas", ";").alias("betas"))


ALIGN_GROUPS_SQL = """
WITH rows AS (SELECT DISTINCT pattern, cluster_index, tcra, tcrb FROM cluster_output),
a AS (SELECT DISTINCT pattern, cluster_index, s FROM (SELECT pattern, cluster_index, trim(unnest(string_split(tcra, ';')), ' ') AS s FROM rows) t WHERE s <> ''),
b AS (SELECT DISTINCT pattern, cluster_index, s FROM (SELECT pattern, cluster_index, trim(unnest(string_split(tcrb, ';')), ' ') AS s FROM rows) t WHERE s <> ''),
n AS (SELECT pattern, cluster_index, count(*)::BIGINT AS n FROM rows GROUP BY 1, 2),
la AS (SELECT pattern, cluster_index, string_agg(s, ';' ORDER BY s) AS alphas FROM a GROUP BY 1, 2),
lb AS (SELECT pattern, cluster_index, string_agg(s, ';' ORDER BY s) AS betas FROM b GROUP BY 1, 2)
SELECT n.pattern, n.cluster_index, n.n, la.alphas, lb.betas FROM n
LEFT JOIN la ON la.pattern IS NOT DISTINCT FROM n.pattern AND la.cluster_index IS NOT DISTINCT FROM n.cluster_index
LEFT JOIN lb ON lb.pattern IS NOT DISTINCT FROM n.pattern AND lb.cluster_index IS NOT DISTINCT FROM n.cluster_index
"""


def scores_left_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cluster_output")
    scores = rows.filter("pattern IS NOT NULL AND freq > 1").groupBy("pattern", "cluster_index").agg(F.sum("freq").alias("group_freq"))
    return join_scores(rows.select("run_id", "row_no", "loaded_at", "pattern", "cluster_index"), scores)


SCORES_SQL = """
SELECT c.run_id, c.row_no, c.loaded_at, c.pattern, c.cluster_index, s.group_freq::BIGINT AS group_freq FROM cluster_output c
LEFT JOIN (SELECT pattern, cluster_index, sum(freq) AS group_freq FROM cluster_output WHERE pattern IS NOT NULL AND freq > 1 GROUP BY 1, 2) s
ON s.pattern = c.pattern AND s.cluster_index = c.cluster_index
"""

_CHAIN_COLUMNS = ("rid", "subject", "condition", "beta", "alpha", "v_gene", "j_gene", "va_gene", "ja_gene", "counts")


def chain_validate(spark: SparkSession, d: str) -> DataFrame:
    return I.chains(spark, d).select(*_CHAIN_COLUMNS)


def chain_hla_join(spark: SparkSession, d: str) -> DataFrame:
    return join_hla(I.chains(spark, d).select("rid", "subject", "beta"), I.hla(spark, d))


CHAIN_HLA_SQL = f"SELECT c.rid, c.subject, c.beta, {', '.join(f'''coalesce(h.{x}, '') AS {x}''' for x in LOCI)} FROM ({I.CHAINS_SQL}) c LEFT JOIN ({I.HLA_SQL}) h ON h.subject = c.subject"


def default_allele(spark: SparkSession, d: str) -> DataFrame:
    return I.chains(spark, d).select("rid", C.default_allele("v_gene").alias("v_allele"), C.default_allele("va_gene").alias("va_allele"))


def _allele_sql(c: str) -> str:
    return f"CASE WHEN contains({c}, '*') THEN {c} WHEN {c} IS NOT NULL THEN {c} || '*01' END"


def germline_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup_germline(I.chains(spark, d).select("rid", "v_gene"), "v_gene", I.germline(spark, d))


def valid_cdr3(spark: SparkSession, d: str) -> DataFrame:
    return I.chains(spark, d).filter(C.is_cdr3("beta")).select("rid", "beta", C.trim_flanks("beta").alias("trimmed"), C.motif_region("beta").alias("region"))


VALID_CDR3_SQL = f"""
SELECT rid, beta, regexp_replace(beta, '^C(.*)[FW]$', '\\1') AS trimmed, CASE WHEN length(beta) > 6 THEN substr(beta, 4, length(beta) - 6) ELSE '' END AS region
FROM ({I.CHAINS_SQL}) c WHERE regexp_full_match(beta, 'C[{C.RESIDUES}]{{6,}}F')
"""

# --- plates -------------------------------------------------------------------


def plate_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return P.unpivot_plate(I.grid(spark, d)).select("plate", "part", "measure", "name", F.col("n").cast("int").alias("n"), "well_id", "value")


PLATE_SQL = f"""
WITH cells AS ({I.CELLS_OF_GRID_SQL}),
placed AS (
  SELECT plate, 'setup' AS part, row_id % 2 AS measure, row_id // 2 AS plate_row, c, label, value FROM cells WHERE row_id < 16
  UNION ALL
  SELECT plate, 'data', (row_id - 21) % 3, (row_id - 21) // 3, c, label, value FROM cells WHERE row_id BETWEEN 21 AND 44
)
SELECT p.plate, p.part, p.measure::INTEGER AS measure, f.label AS name, (p.plate_row * 12 + p.c)::INTEGER AS n, chr((65 + p.plate_row)::INTEGER) || (p.c + 1) AS well_id, p.value
FROM placed p JOIN (SELECT DISTINCT plate, part, measure, label FROM placed WHERE plate_row = 0) f USING (plate, part, measure)
"""


def conc_clean(spark: SparkSession, d: str) -> DataFrame:
    return P.unpivot_plate(I.grid(spark, d)).select("plate", "part", "measure", "well_id", C.first_number("value").alias("number"), C.clean_concentration("value").alias("clean"))


CONC_SQL = f"""
SELECT plate, part, measure, well_id, number, CASE WHEN contains(value, '>') THEN NULL WHEN contains(value, '<') THEN 0.0::DOUBLE ELSE number END AS clean
FROM (SELECT *, CASE WHEN length(run) - length(replace(run, '.', '')) <= 1 THEN try_cast(nullif(run, '') AS DOUBLE) END AS number
  FROM (SELECT *, regexp_extract(value, '[0-9.]+') AS run FROM ({PLATE_SQL}) a) b) c
"""


_MEASURES = ("measure 0", "measure 1", "measure 2")


def plate_wide(spark: SparkSession, d: str) -> DataFrame:
    wells = P.unpivot_plate(I.grid(spark, d)).filter("part = 'data'")
    return P.wide_plate(wells, _MEASURES).select("plate", "well_id", *[F.col(name).alias(f"m{k}") for k, name in enumerate(_MEASURES)])


PLATE_WIDE_SQL = f"SELECT plate, well_id, {', '.join(f'any_value(value) FILTER (measure = {k}) AS m{k}' for k in range(3))} FROM ({PLATE_SQL}) p WHERE part = 'data' GROUP BY 1, 2"


def conc_masked(spark: SparkSession, d: str) -> DataFrame:
    wide = plate_wide(spark, d).withColumn("limit_by", C.first_number("m1"))
    return wide.select("plate", "well_id", P.masked_concentration("m0", "limit_by", 40.0).alias("clean"), P.masked_concentration("m0").alias("adjusted"))


def _number_sql(c: str) -> str:
    run = f"regexp_extract({c}, '[0-9.]+')"
    return f"CASE WHEN length({run}) - length(replace({run}, '.', '')) <= 1 THEN try_cast(nullif({run}, '') AS DOUBLE) END"


CONC_MASKED_SQL = f"""
SELECT plate, well_id, CASE WHEN {_number_sql('m1')} > 40.0 THEN NULL ELSE a END AS clean, a AS adjusted
FROM (SELECT *, CASE WHEN contains(m0, '>') THEN NULL WHEN contains(m0, '<') THEN 0.0::DOUBLE ELSE {_number_sql('m0')} END AS a FROM ({PLATE_WIDE_SQL}) w) x
"""


def plate_sort(spark: SparkSession, d: str) -> DataFrame:
    wells = P.unpivot_plate(I.grid(spark, d)).filter("part = 'data'").groupBy("plate", "well_id").agg(*[F.max(F.when(F.col("measure") == k, F.col("value"))).alias(f"data_{k}") for k in range(3)])
    return wells.filter(P.enough_cells(["data_0", "data_1", "data_2"], 3)).orderBy("data_0", "data_1", "data_2", "plate", "well_id")


PLATE_SORT_SQL = f"""
SELECT plate, well_id, data_0, data_1, data_2 FROM (
  SELECT plate, well_id, max(value) FILTER (measure = 0) AS data_0, max(value) FILTER (measure = 1) AS data_1, max(value) FILTER (measure = 2) AS data_2
  FROM ({PLATE_SQL}) p WHERE part = 'data' GROUP BY 1, 2) t
WHERE data_0 <> '' AND data_1 <> '' AND data_2 <> ''
"""

# --- files --------------------------------------------------------------------


def fastq_parse(spark: SparkSession, d: str) -> DataFrame:
    return S.parse_fastq(I.fastq_names(spark, d))


_FASTQ = C.FASTQ_NAME.replace("\\d", "[0-9]")
FASTQ_SQL = f"""
SELECT o_orderkey, file_name, regexp_extract(file_name, '{_FASTQ}', 1) AS sample_id, regexp_extract(file_name, '{_FASTQ}', 2)::INTEGER AS sample_number,
  regexp_extract(file_name, '{_FASTQ}', 3) AS lane, regexp_extract(file_name, '{_FASTQ}', 4) AS read_number
FROM (SELECT o_orderkey, {I.FASTQ_EXPR} AS file_name FROM orders) t WHERE regexp_matches(file_name, '{_FASTQ}')
"""


def fastq_files(spark: SparkSession, d: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    return S.files_of(S.parse_fastq(I.fastq_names(spark, d)), keys)


def _fastq_files_sql(keys: str) -> str:
    return f"SELECT {keys}, string_agg(file_name, chr(9) ORDER BY sample_id, sample_number::VARCHAR, lane, read_number, file_name) AS files FROM ({FASTQ_SQL}) f GROUP BY {keys}"


def fastq_pairs(spark: SparkSession, d: str) -> DataFrame:
    return paired_files(S.parse_fastq(I.fastq_names(spark, d)))


_READS_SQL = ", ".join(f"max(file_name) FILTER (read_number = '{r}')" for r in ("R1", "R2", "I1", "I2"))
FASTQ_PAIRS_SQL = f"SELECT sample_id, sample_number, lane, concat_ws(chr(9), {_READS_SQL}) AS files FROM ({FASTQ_SQL}) f GROUP BY 1, 2, 3"


def md5_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


# --- enrichment responses ----------------------------------------------------------


def enrich_json(spark: SparkSession, d: str) -> DataFrame:
    return S.enrichment_rows(I.responses(spark, d), "body", "lib")


ENRICH_SQL = "SELECT p_partkey AS rank, p_name AS term, (p_size / 100.0)::DOUBLE AS p_value, p_size::DOUBLE AS zscore, 0.0::DOUBLE AS combined_score, p_brand || ', ' || p_type AS overlap_genes, 0.5::DOUBLE AS q_value, 'lib' AS library FROM part"


def enrich_topn(spark: SparkSession, d: str) -> DataFrame:
    return S.top_terms(enrich_json(spark, d), 25).select("rank", "term", "p_value")


def neglog10(spark: SparkSession, d: str) -> DataFrame:
    return enrich_json(spark, d).select("rank", F.round(C.neg_log10("p_value"), 9).alias("neg_log10_p"))


def enrich_union(spark: SparkSession, d: str) -> DataFrame:
    """The results of several libraries under each other."""
    return union_files([S.enrichment_rows(I.responses(spark, d), "body", name) for name in ("lib", "other")]).select("library", "rank", "term", "p_value")


def enrich_chart(spark: SparkSession, d: str) -> DataFrame:
    return S.chart_values(enrich_json(spark, d)).select("term", F.round("neg_log10_p", 9).alias("neg_log10_p"))


def input_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether any record has an alpha, and any a count of its own."""
    return table(spark, d, "chain_records").agg(F.bool_or(F.coalesce(C.is_residues(F.upper(C.given("alpha"))), F.lit(False))).alias("has_alpha"), F.bool_or(F.col("counts").isNotNull()).alias("has_counts"))


INPUT_FLAGS_SQL = f"SELECT bool_or(coalesce(regexp_full_match(upper(trim(alpha, ' ')), '[{C.RESIDUES}]+') AND upper(trim(alpha, ' ')) <> 'NA', false)) AS has_alpha, bool_or(counts IS NOT NULL) AS has_counts FROM chain_records"


def hla_mark(spark: SparkSession, d: str) -> DataFrame:
    folded = I.hla(spark, d)
    return folded.select("subject", C.mark_hla(F.col("dpa1"), F.substring_index("dpa1", "/", 1)).alias("dpa1"))


HLA_MARK_SQL = f"SELECT subject, CASE WHEN dpa1 = '' THEN '' WHEN contains(dpa1, '/') THEN split_part(dpa1, '/', 1) || '!/' || split_part(dpa1, '/', 2) ELSE dpa1 || '!' END AS dpa1 FROM ({I.HLA_SQL}) h"


def repertoire(spark: SparkSession, d: str) -> DataFrame:
    from clonoforge.operators.scoring import log_background, repertoire_counts

    counts = repertoire_counts(I.chains(spark, d))
    return counts.join(log_background(counts), "beta").select("beta", F.round("n", 6).alias("n"), F.round("log_n", 9).alias("log_n"))


REPERTOIRE_SQL = f"""
SELECT beta, round(n, 6)::DOUBLE AS n, round(ln(1.0 + n), 9)::DOUBLE AS log_n FROM (
  SELECT beta, sum(greatest(coalesce(counts, 1.0::DOUBLE), 1.0::DOUBLE)) AS n FROM ({I.CHAINS_SQL}) c GROUP BY beta) t
"""

QUERIES = {
    "agg_cellranger": agg_cellranger,
    "agg_cellranger_alpha": partial(agg_cellranger, keep_alpha=True),
    "union_files": union_cells,
    "split_sample_id": lambda s, d: split_sample_id(_subject_condition(s, d)),
    "split_once_subject": split_once,
    "split_cdr3_trvj": split_trvj,
    "split_cdr3_trvj_beta": partial(split_trvj, chain="beta"),
    "split_cdr3_ctgene": split_ctgene,
    "split_cdr3_ragged": split_ragged,
    "split_ragged_all": split_ragged_all,
    "plate_wide": plate_wide,
    "conc_masked": conc_masked,
    "fastq_pairs": fastq_pairs,
    "enrich_union": enrich_union,
    "enrich_chart": enrich_chart,
    "input_flags": input_flags,
    "unique_alpha": unique_alpha,
    "align_groups": align_groups,
    "scores_left_join": scores_left_join,
    "chain_validate": chain_validate,
    "hla_fold": I.hla,
    "chain_hla_join": chain_hla_join,
    "default_allele": default_allele,
    "germline_lookup": germline_lookup,
    "valid_cdr3": valid_cdr3,
    "plate_unpivot": plate_unpivot,
    "conc_clean": conc_clean,
    "plate_sort": plate_sort,
    "fastq_parse": fastq_parse,
    "fastq_sample": fastq_files,
    "fastq_lane": partial(fastq_files, keys=("lane",)),
    "md5_manifest": md5_manifest,
    "enrich_json": enrich_json,
    "enrich_topn": enrich_topn,
    "neglog10": neglog10,
    "hla_mark": hla_mark,
    "repertoire_counts": repertoire,
}
SQL = {
    "agg_cellranger": _agg_sql(False),
    "agg_cellranger_alpha": _agg_sql(True),
    "union_files": "SELECT cell_id, cdr3a, cdr3b, sample_id FROM cells_trvj UNION ALL SELECT cell_id, cdr3a, cdr3b, sample_id FROM cells_ctgene",
    "split_sample_id": SPLIT_ID_SQL,
    "split_once_subject": SPLIT_ONCE_SQL,
    "split_cdr3_trvj": _split_sql("cells_trvj", ("cdr3a", "trav", "traj"), ("cell_id", "cdr3b", "trbv", "trbj", "sample_id")),
    "split_cdr3_trvj_beta": _split_sql("cells_trvj", ("cdr3b", "trbv", "trbj"), ("cell_id", "cdr3a", "trav", "traj", "sample_id")),
    "split_cdr3_ctgene": _split_sql("cells_ctgene", ("cdr3a", "ctgenea"), ("cell_id", "cdr3b", "ctgeneb", "sample_id")),
    "split_cdr3_ragged": "SELECT cell_id FROM cells_trvj WHERE len(string_split(cdr3b, ';')) <> len(string_split(trbv, ';')) OR len(string_split(cdr3b, ';')) <> len(string_split(trbj, ';'))",
    "split_ragged_all": _ragged_sql(),
    "plate_wide": PLATE_WIDE_SQL,
    "conc_masked": CONC_MASKED_SQL,
    "fastq_pairs": FASTQ_PAIRS_SQL,
    "enrich_union": f"SELECT n AS library, rank, term, p_value FROM ({ENRICH_SQL}) e, (VALUES ('lib'), ('other')) l(n)",
    "enrich_chart": f"SELECT term, CASE WHEN p_value > 0 THEN round(-log10(p_value), 9) ELSE 0.0 END::DOUBLE AS neg_log10_p FROM (SELECT * FROM ({ENRICH_SQL}) e ORDER BY rank LIMIT 10) t",
    "input_flags": INPUT_FLAGS_SQL,
    "unique_alpha": UNIQUE_ALPHA_SQL,
    "align_groups": ALIGN_GROUPS_SQL,
    "scores_left_join": SCORES_SQL,
    "chain_validate": f"SELECT {', '.join(_CHAIN_COLUMNS)} FROM ({I.CHAINS_SQL}) c",
    "hla_fold": I.HLA_SQL,
    "chain_hla_join": CHAIN_HLA_SQL,
    "default_allele": f"SELECT rid, {_allele_sql('v_gene')} AS v_allele, {_allele_sql('va_gene')} AS va_allele FROM ({I.CHAINS_SQL}) c",
    "germline_lookup": f"SELECT c.rid, c.v_gene, g.cdr1, g.cdr2, g.pmhc FROM ({I.CHAINS_SQL}) c JOIN ({I.GERMLINE_SQL}) g ON g.gene = {_allele_sql('c.v_gene')}",
    "valid_cdr3": VALID_CDR3_SQL,
    "plate_unpivot": PLATE_SQL,
    "conc_clean": CONC_SQL,
    "plate_sort": PLATE_SORT_SQL,
    "fastq_parse": FASTQ_SQL,
    "fastq_sample": _fastq_files_sql("sample_id"),
    "fastq_lane": _fastq_files_sql("lane"),
    "md5_manifest": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "enrich_json": ENRICH_SQL,
    "enrich_topn": f"SELECT rank, term, p_value FROM ({ENRICH_SQL}) e ORDER BY rank LIMIT 25",
    "neglog10": f"SELECT rank, CASE WHEN p_value > 0 THEN round(-log10(p_value), 9) ELSE 0.0 END::DOUBLE AS neg_log10_p FROM ({ENRICH_SQL}) e",
    "hla_mark": HLA_MARK_SQL,
    "repertoire_counts": REPERTOIRE_SQL,
}
