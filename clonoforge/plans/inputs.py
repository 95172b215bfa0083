"""Inputs of the queries: each as a DataFrame and as the same rows in SQL.

Tables that the test data do not hold (contigs, plates, file names, responses) are made of
ones they do, by expressions that read alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.functions.columns import RESIDUES
from clonoforge.operators.enrichment import unique_sequences
from clonoforge.session import table
from clonoforge.sources.chains import LOCI, fold_hla, validate_chains


def residues(key: str, start: int, n: int) -> str:
    """SQL for n residues out of the hash of a key."""
    return f"translate(substr(md5(cast({key} as string)), {start}, {n}), '0123456789abcdef', 'ADEGHILNPQRSTVWY')"


def _family(key: str) -> str:
    """Families of six sequences that differ in one place."""
    k = f"cast(floor({key} / 6.0) as bigint)"
    return f"concat('CASS', {residues(k, 1, 3)}, substr('AGSTND', cast({key} % 6 + 1 as int), 1), {residues(k, 4, 2)}, 'EQYF')"


CONTIG_COLUMNS = {
    "sample": "concat('S', cast(l_orderkey % 5 as string), CASE WHEN l_orderkey % 2 = 0 THEN '-Inf' ELSE '-Pep' END)",
    "barcode": "cast(l_orderkey as string)",
    "chain": "CASE WHEN l_linenumber % 2 = 0 THEN 'TRA' ELSE 'TRB' END",
    "v_gene": "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'TRAV' ELSE 'TRBV' END, cast(l_partkey % 12 + 1 as string))",
    "j_gene": "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'TRAJ' ELSE 'TRBJ' END, cast(l_partkey % 7 + 1 as string))",
    "cdr3": _family("l_partkey"),
}
CONTIGS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONTIG_COLUMNS.items()) + " FROM lineitem"


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in CONTIG_COLUMNS.items()])


def chains(spark: SparkSession, d: str) -> DataFrame:
    return validate_chains(table(spark, d, "chain_records"), on_error="drop")


def _given(c: str) -> str:
    return f"CASE WHEN trim({c}, ' ') <> '' AND upper(trim({c}, ' ')) <> 'NA' THEN trim({c}, ' ') END"


CHAINS_SQL = f"""
SELECT rid, {_given('subject')} AS subject, {_given('condition')} AS condition, upper({_given('beta')}) AS beta,
  CASE WHEN regexp_full_match(upper({_given('alpha')}), '[{RESIDUES}]+') THEN upper({_given('alpha')}) END AS alpha,
  {_given('v_gene')} AS v_gene, {_given('j_gene')} AS j_gene, {_given('va_gene')} AS va_gene, {_given('ja_gene')} AS ja_gene,
  coalesce(counts, 1.0::DOUBLE) AS counts
FROM chain_records
WHERE {_given('subject')} IS NOT NULL AND {_given('condition')} IS NOT NULL
  AND regexp_full_match(upper({_given('beta')}), '[{RESIDUES}]+')
  AND (counts IS NULL OR (counts >= 0 AND counts <> 'nan'::DOUBLE AND counts < 'infinity'::DOUBLE))
"""

_CDR3 = f"'C[{RESIDUES}]{{6,}}F'"
SAMPLE_SQL = f"SELECT DISTINCT upper(trim(tcrb, ' ')) AS s FROM cluster_output WHERE regexp_full_match(upper(trim(tcrb, ' ')), {_CDR3})"
REFERENCE_SQL = f"SELECT DISTINCT upper(trim(beta, ' ')) AS s FROM chain_records WHERE regexp_full_match(upper(trim(beta, ' ')), {_CDR3})"


def sample(spark: SparkSession, d: str) -> DataFrame:
    """(s): the distinct valid sequences of clusters."""
    return unique_sequences(table(spark, d, "cluster_output"), "tcrb", only_cdr3=True)


def reference(spark: SparkSession, d: str) -> DataFrame:
    """(s): the distinct valid sequences of the repertoire."""
    return unique_sequences(table(spark, d, "chain_records"), "beta", only_cdr3=True)


def hla(spark: SparkSession, d: str) -> DataFrame:
    return fold_hla(table(spark, d, "hla_records"))


def _hla_locus(locus: str) -> str:
    if locus in LOCI[:5]:
        l, r = _given(f"{locus}_l"), _given(f"{locus}_r")
    else:
        l, r = (f"CASE WHEN upper({_given(f'drb345_{x}')}) LIKE '{locus.upper()}%' THEN {_given(f'drb345_{x}')} END" for x in "lr")
    return f"coalesce(CASE WHEN {l} = {r} THEN {l} WHEN {l} IS NOT NULL AND {r} IS NOT NULL THEN {l} || '/' || {r} ELSE coalesce({l}, {r}) END, '') AS {locus}"


HLA_SQL = "SELECT trim(pid, ' ') AS subject, " + ", ".join(map(_hla_locus, LOCI)) + " FROM hla_records"

GERMLINE_COLUMNS = {
    "gene": "concat(gene, '*01')",
    "cdr1": f"concat({residues('gene_id', 1, 5)}, '.', {residues('gene_id', 6, 1)})",
    "cdr2": f"concat({residues('gene_id', 7, 3)}, '..', {residues('gene_id', 10, 2)})",
    "pmhc": residues("gene_id", 12, 6),
}
GERMLINE_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in GERMLINE_COLUMNS.items()) + " FROM gene_reference"


def germline(spark: SparkSession, d: str) -> DataFrame:
    """(gene, cdr1, cdr2, pmhc): aligned loops for every listed V gene."""
    return table(spark, d, "gene_reference").selectExpr(*[f"{e} AS {c}" for c, e in GERMLINE_COLUMNS.items()])


EDGES_SQL = "SELECT least(rid_a, rid_b) AS i, greatest(rid_a, rid_b) AS j, min(distance) AS d FROM chain_matches WHERE rid_a <> rid_b GROUP BY 1, 2"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, d): distinct pairs of chain matches with their least distance."""
    m = table(spark, d, "chain_matches").filter("rid_a <> rid_b")
    return m.groupBy(F.least("rid_a", "rid_b").alias("i"), F.greatest("rid_a", "rid_b").alias("j")).agg(F.min("distance").alias("d"))


GRID_CELL = "CASE WHEN (r_regionkey + row_id * 12 + c) % 11 = 0 THEN concat('>', cast(row_id as string), '.5') WHEN (r_regionkey + row_id * 12 + c) % 7 = 0 THEN concat('<', cast(c as string)) WHEN (r_regionkey + row_id * 12 + c) % 13 = 0 THEN '' ELSE concat(cast((r_regionkey * 37 + row_id * 17 + c * 5) % 97 as string), '.', cast(c as string), 'pg') END"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(plate, row_id, cells, label): one plate per region, 45 rows of 12 text cells."""
    rows = table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(44))).alias("row_id"))
    cell = F.expr(f"transform(sequence(0, 11), c -> {GRID_CELL})")
    return rows.select(F.col("r_regionkey").alias("plate"), "row_id", cell.alias("cells"), F.concat(F.lit("measure "), (F.col("row_id") % 7).cast("string")).alias("label"))


CELLS_OF_GRID_SQL = f"""
SELECT r_regionkey AS plate, row_id, c, concat('measure ', cast(row_id % 7 as string)) AS label, {GRID_CELL} AS value
FROM region, (SELECT unnest(range(45))::INTEGER AS row_id) r, (SELECT unnest(range(12))::INTEGER AS c) k
"""

FASTQ_EXPR = "concat('smp_', cast(o_custkey as string), CASE WHEN o_orderkey % 17 = 0 THEN '_X' ELSE '_S' END, cast(o_custkey % 30 + 1 as string), '_L00', cast(o_orderkey % 4 + 1 as string), '_', CASE WHEN o_orderkey % 3 = 0 THEN 'I1' WHEN o_orderkey % 3 = 1 THEN 'R1' ELSE 'R2' END, '_001.fastq', CASE WHEN o_orderkey % 2 = 0 THEN '.gz' ELSE '' END)"


def fastq_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{FASTQ_EXPR} AS file_name")


RESPONSE_EXPR = """concat('[[', cast(p_partkey as string), ',"', p_name, '",', cast(p_size / 100.0 as string), ',', cast(p_size as string), ',NaN,["', p_brand, '","', p_type, '"],0.5],[2,"short"]]')"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{RESPONSE_EXPR} AS body")
