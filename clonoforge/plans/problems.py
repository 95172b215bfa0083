"""Queries of the general data-preparation problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.operators.badrows import faulty_lines, loaded_lines, parse_chain_lines
from clonoforge.operators.hotkeys import newest, skewed_totals
from clonoforge.operators.packed import split_packed
from clonoforge.session import table

PACKED = {"cells_trvj": ("cdr3a", "cdr3b", "trav"), "cells_ctgene": ("cdr3a", "cdr3b", "ctgenea")}


def _packed(spark: SparkSession, d: str, least: int) -> DataFrame:
    parts = [split_packed(table(spark, d, t), fields, ["cell_id"], least) for t, fields in PACKED.items()]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of a field that holds two or more."""
    return _packed(spark, d, 2).select("cell_id", "field", "pos", "item")


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every packed field, single ones too, with the parser's flag."""
    return _packed(spark, d, 1)


#: The places of packed fields in SQL: tokens by one expression, places by counting what parts them.
_PLACES_SQL = r"""
WITH cells AS (
  SELECT cell_id, unnest(['cdr3a', 'cdr3b', 'trav']) AS field, unnest([cdr3a, cdr3b, trav]) AS v FROM cells_trvj
  UNION ALL SELECT cell_id, unnest(['cdr3a', 'cdr3b', 'ctgenea']), unnest([cdr3a, cdr3b, ctgenea]) FROM cells_ctgene
), bare AS (
  SELECT row_number() OVER () AS cell, cell_id, field, regexp_replace(trim(v, E' \t\r\n '), '(?s)^[\[({](.*)[\])}]$', '\1') AS v FROM cells WHERE v IS NOT NULL
), tokens AS (
  SELECT cell, cell_id, field, regexp_extract_all(trim(v, E' \t\r\n '), '"[^"]*"|''[^'']*''|“[^”]*”|‘[^’]*’|`[^`]*`|(?i:n/a)|[;；,，、|&+_/]|(?:[^;；,，、|/&+_\s\x{A0}]|/[Dd][Vv][0-9])+') AS t FROM bare
), parts AS (
  SELECT cell, cell_id, field, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM tokens
), marked AS (
  SELECT *, regexp_full_match(token, '[;；,，、|&+_/]') AS is_mark, lag(token) OVER (PARTITION BY cell ORDER BY k) AS before FROM parts
), placed AS (
  SELECT *, 1 + sum(CASE WHEN is_mark THEN 1 WHEN before IS NOT NULL AND NOT regexp_full_match(before, '[;；,，、|&+_/]') THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY k) AS pos FROM marked
), items AS (
  SELECT cell, cell_id, field, pos::INTEGER AS pos, trim(token, E' \t\r\n "''“”‘’`[]{}()') AS item,
    CASE WHEN regexp_full_match(token, '"[^"]*"|''[^'']*''|“[^”]*”|‘[^’]*’|`[^`]*`') OR token = trim(token, E'"''“”‘’`[]{}()') THEN NULL WHEN regexp_matches(token, '["''“”‘’`]$|^["''“‘`]') THEN 'quote' ELSE 'bracket' END AS error
  FROM placed WHERE NOT is_mark
), given AS (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM items WHERE upper(item) NOT IN ('', 'NA', 'N/A', 'NAN', 'NULL', 'NONE'))
"""
P1_FOUND_SQL = _PLACES_SQL + "SELECT cell_id, field, pos, item FROM given WHERE n >= 2"
P1_VALUES_SQL = _PLACES_SQL + "SELECT cell_id, field, pos, item, error FROM given"


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """rows, distinct subjects and total freq of each pattern and each tcrb.

    A row delivered again counts once, as last loaded. Blanks around a value and its case
    do not part keys; blank values are the null key.
    """
    rows = newest(table(spark, d, "cluster_output"), ["run_id", "row_no"], "loaded_at", ["pattern", "tcrb", "subject", "freq"])
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), clean(c).alias("key")) for c in ("pattern", "tcrb")]))
    long = rows.select(pairs.alias("_pair"), "subject", "freq").select("_pair.field", "_pair.key", "subject", "freq")
    return skewed_totals(long, ["field", "key"], "subject", "freq").select("field", "key", "n_rows", F.col("n_distinct").alias("n_subjects"), F.col("total").alias("total_freq"))


P4_TOTALS_SQL = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, row_no
    ORDER BY loaded_at DESC NULLS LAST, pattern DESC NULLS LAST, tcrb DESC NULLS LAST, subject DESC NULLS LAST, freq DESC NULLS LAST) AS place
  FROM cluster_output
), latest AS (SELECT * FROM ranked WHERE place = 1),
long AS (
  SELECT 'pattern' AS field, nullif(upper(trim(pattern, ' ')), '') AS key, subject, freq FROM latest
  UNION ALL
  SELECT 'tcrb', nullif(upper(trim(tcrb, ' ')), ''), subject, freq FROM latest
)
SELECT field, key, count(*)::BIGINT AS n_rows, count(DISTINCT subject)::BIGINT AS n_subjects, sum(freq)::BIGINT AS total_freq
FROM long GROUP BY field, key
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every faulty line with its first reason."""
    return faulty_lines(parse_chain_lines(table(spark, d, "raw_chains")))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed records of all other lines."""
    return loaded_lines(parse_chain_lines(table(spark, d, "raw_chains")))


#: Lines in SQL: quoting and fields by expressions made of each file's separator.
_LINES_SQL = r"""
WITH heads AS (SELECT file_name, arg_min(line, line_id) AS h FROM raw_chains WHERE line_no = 1 GROUP BY file_name),
clean AS (SELECT file_name, regexp_replace(regexp_replace(h, '^\x{FEFF}', ''), '\r?\n?$', '') AS h, regexp_replace(regexp_replace(regexp_replace(h, '^\x{FEFF}', ''), '\r?\n?$', ''), '"[^"]*"', '', 'g') AS bare FROM heads),
parted AS (SELECT file_name, h, list_reduce([chr(9), ',', ';', '|'], lambda x, y: CASE WHEN len(string_split(bare, y)) > len(string_split(bare, x)) THEN y ELSE x END) AS sep FROM clean),
layout AS (SELECT file_name, sep, list_transform(string_split(h, sep), lambda x: lower(trim(trim(x, ' '), '"'))) AS names FROM parted),
body AS (
  SELECT r.line_id, r.file_name, l.names, CASE WHEN l.sep = '|' THEN '\|' ELSE l.sep END AS sep, l.sep AS bare_sep, regexp_replace(regexp_replace(r.line, '^\x{FEFF}', ''), '\r?\n?$', '') AS line
  FROM raw_chains r LEFT JOIN layout l ON l.file_name = r.file_name WHERE r.line IS NOT NULL AND coalesce(r.line_no, 0) <> 1
), cells AS (
  SELECT *, regexp_full_match(bare_sep || line, '(?s)(?:' || sep || '(?:"(?:[^"]|"")*"|[^"' || sep || '][^' || sep || ']*)?)*') AS quoted_well,
    list_transform(regexp_extract_all(bare_sep || line, '(?s)' || sep || '(?:"(?:[^"]|"")*"|[^' || sep || ']*)'), lambda x: substr(x, 2)) AS raw
  FROM body WHERE trim(line, E' \t\r\n') <> ''
), fields AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM cells
), named AS (
  SELECT *, trim(f[list_position(names, 'cdr3b')], E' \t\r\n') AS b, trim(f[list_position(names, 'cdr3a')], E' \t\r\n') AS a, trim(f[list_position(names, 'count')], E' \t\r\n') AS c, coalesce(f[list_position(names, 'subject:condition')], '') AS s FROM fields
), judged AS (
SELECT *, upper(CASE WHEN upper(b) NOT IN ('', 'NA') THEN b END) AS beta, upper(CASE WHEN upper(a) NOT IN ('', 'NA') THEN a END) AS alpha, CASE WHEN upper(c) NOT IN ('', 'NA') THEN c END AS count_text FROM named
), reasoned AS (
SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN names IS NULL OR len(f) <> len(names) THEN 'columns'
  WHEN NOT coalesce(regexp_full_match(beta, '[ACDEFGHIKLMNPQRSTVWY]+'), false) THEN 'beta'
  WHEN alpha IS NOT NULL AND NOT regexp_full_match(alpha, '[ACDEFGHIKLMNPQRSTVWY]+') THEN 'alpha'
  WHEN count_text IS NOT NULL AND NOT (regexp_full_match(count_text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(count_text AS DOUBLE), -1) >= 0 AND try_cast(count_text AS DOUBLE) < 'infinity'::DOUBLE) THEN 'counts'
  WHEN NOT contains(s, ':') OR trim(split_part(s, ':', 1), E' \t\r\n') = '' OR trim(substr(s, instr(s, ':') + 1), E' \t\r\n') = '' THEN 'subject' END AS reason FROM judged)
"""
P5_FOUND_SQL = _LINES_SQL + "SELECT line_id, reason FROM reasoned WHERE reason IS NOT NULL"
_FIELD_SQL = "CASE WHEN upper(trim(f[list_position(names, '{0}')], E' \\t\\r\\n')) NOT IN ('', 'NA') THEN trim(f[list_position(names, '{0}')], E' \\t\\r\\n') END AS {1}"
P5_LOADED_SQL = (
    _LINES_SQL
    + "SELECT line_id, file_name, trim(split_part(s, ':', 1), E' \\t\\r\\n') AS subject, trim(substr(s, instr(s, ':') + 1), E' \\t\\r\\n') AS condition, beta, alpha, "
    + ", ".join(_FIELD_SQL.format(source, name) for source, name in (("trbv", "v_gene"), ("trbj", "j_gene"), ("trav", "va_gene"), ("traj", "ja_gene")))
    + ", coalesce(count_text::DOUBLE, 1.0::DOUBLE) AS counts FROM reasoned WHERE reason IS NULL"
)

QUERIES = {
    "p1_found": p1_found,
    "p1_values": p1_values,
    "p4_totals": p4_totals,
    "p5_found": p5_found,
    "p5_loaded": p5_loaded,
}
SQL = {"p1_found": P1_FOUND_SQL, "p1_values": P1_VALUES_SQL, "p4_totals": P4_TOTALS_SQL, "p5_found": P5_FOUND_SQL, "p5_loaded": P5_LOADED_SQL}
