"""Readers and sinks of the command's own file layouts, with the errors their input can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.functions.columns import after_first, before_first, given
from clonoforge.operators.similarity import ANNOTATIONS, written_score
from clonoforge.sources.chains import LOCI, fold_hla, validate_chains
from clonoforge.sources.files import TRUST4_HEADER, trust4_rows

_CHAIN_FIELDS = {"beta": "CDR3b", "alpha": "CDR3a", "v_gene": "TRBV", "j_gene": "TRBJ", "va_gene": "TRAV", "ja_gene": "TRAJ"}
_HLA_FIELDS = ["pid", *[f"{locus}_{side}" for locus in (*LOCI[:5], "drb345") for side in "lr"]]


def _some(df: DataFrame, what: str, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} in {path}")
    return df


def read_chains(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """Chain records (subject, condition, beta, alpha, genes, counts) of a tab-separated file with a header.

    The columns subject:condition and CDR3b must be there; the others may be missing. What
    `validate_chains` calls an error is one here, and so are a count that is no number and a
    file without a single usable record.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    named = {c.strip(): c for c in raw.columns}
    for needed in ("subject:condition", "CDR3b"):
        if needed not in named:
            raise ValueError(f"{path} has no column {needed}")
    column = lambda name: F.col(f"`{named[name]}`") if name in named else F.lit(None).cast("string")
    count = given(column("count"))
    number = count.try_cast("double")
    counts = F.when(count.isNotNull() & number.isNull(), F.lit(float("nan"))).otherwise(number)
    fields = {name: column(source) for name, source in _CHAIN_FIELDS.items()}
    both = column("subject:condition")
    records = raw.select(before_first(both).alias("subject"), after_first(both).alias("condition"), *[c.alias(name) for name, c in fields.items()], counts.alias("counts"))
    return _some(validate_chains(records, on_error), "chain record", path)


def read_hla(spark: SparkSession, path: str) -> DataFrame:
    """(subject, one text per locus) of a tab-separated file: subject, then up to twelve allele columns.

    An empty subject, a row of more than 13 columns, a subject with two rows and a file
    without rows are errors. The tables hold a row per person.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.filter("_at > 0 AND value <> ''").select(cells.alias("c"))
    error = F.when(given(F.element_at("c", 1)).isNull(), "an empty subject").when(F.size("c") > 13, "a row of more than 13 columns")
    checked = rows.filter(F.when(error.isNull(), True).otherwise(F.raise_error(F.concat(error, F.lit(f" in {path}"))).cast("boolean")))
    folded = fold_hla(checked.select(*[F.try_element_at("c", F.lit(k + 1)).alias(name) for k, name in enumerate(_HLA_FIELDS)]))
    twice = folded.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("subject").limit(1).collect()
    if twice:
        raise ValueError(f"two rows of subject {twice[0].subject} in {path}")
    return _some(folded, "HLA record", path)


def read_germline(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """(gene, cdr1, cdr2, pmhc): the V genes of an organism; genes with fewer than three loops or an empty first fall out.

    A missing column and an organism without V genes are errors. The last row of a gene counts.
    """
    raw = spark.read.csv(path, sep="\t", header=True).withColumn("_at", F.monotonically_increasing_id())
    for needed in ("id", "organism", "region", "cdrs"):
        if needed not in raw.columns:
            raise ValueError(f"{path} has no column {needed}")
    loops = raw.filter((F.col("organism") == organism) & (F.col("region") == "V")).select("id", "_at", F.split("cdrs", ";").alias("c")).filter((F.size("c") >= 3) & (F.element_at("c", 1) != ""))
    last = loops.groupBy("id").agg(F.max_by("c", "_at").alias("c"))
    return _some(last.select(F.col("id").alias("gene"), *[F.element_at("c", k + 1).alias(name) for k, name in enumerate(("cdr1", "cdr2", "pmhc"))]), f"V gene of {organism}", path)


def read_epitopes(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, original, annotations): an annotated database, tabs between its fields, missing ones ''.

    The sequence is the first word of a line; the header (trimmed_seq) and blank lines fall out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    word = F.regexp_extract("value", r"^\s*(\S+)", 1)
    field = lambda k: F.coalesce(F.try_element_at(F.split("value", "\t"), F.lit(k)), F.lit(""))
    places = {"receptor_group": 3, "epitope": 4, "organism": 5, "antigen": 6}
    return lines.filter((word != "") & (word != "trimmed_seq")).select(word.alias("sequence"), field(2).alias("original"), *[field(places[name]).alias(name) for name in ANNOTATIONS])


def read_trust4(spark: SparkSession, path: str) -> DataFrame:
    """(line, sequence) of the beta chains of a report; its header must be the ten columns of TRUST4_HEADER."""
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0].value.rstrip("\r\n") != "\t".join(TRUST4_HEADER):
        raise ValueError(f"{path} has not the ten columns of a report")
    return trust4_rows(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")))


def read_repertoire(spark: SparkSession, folder: str):
    """A reference of Parquet tables in one folder: sequences (s), genes (gene, freq), lengths (value, freq), sizes (sample_size, cluster_size, probability).

    lengths and sizes may be missing. A tabled sample size has one probability per cluster size from 1 on.
    """
    from clonoforge.operators.pipeline import Repertoire

    def held(name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{folder}/{name}.parquet") if there else None

    sequences, genes = held("sequences"), held("genes")
    if sequences is None or genes is None:
        raise ValueError(f"{folder} holds no sequences or no genes")
    sizes: dict[int, list[float]] = {}
    if (tabled := held("sizes")) is not None:
        for r in tabled.orderBy("sample_size", "cluster_size").toLocalIterator():
            own = sizes.setdefault(r.sample_size, [])
            own += [1.0] * (r.cluster_size - 1 - len(own)) + [r.probability]
    return Repertoire(sequences.select("s"), genes.select("gene", "freq"), held("lengths"), sizes)


# --- sinks ------------------------------------------------------------------------

# The header of the cluster file, which tools behind it read by name.
CLUSTER_HEADER = {
    "index": "index", "pattern": "pattern", "number_subject": "number_subject", "number_unique_cdr3": "number_unique_cdr3", "tcrb": "TcRb", "fisher_score": "Fisher_score", "freq": "Freq", "subject": "subject",
    "condition": "condition", "final_score": "final_score", "hla_score": "hla_score", "vb_score": "vb_score", "expansion_score": "expansion_score", "length_score": "length_score",
    "cluster_size_score": "cluster_size_score", "kind": "type", "ultcrb": "ulTcRb", "vb": "VB", "jb": "JB", "tcra": "TcRa", **{locus: f"HLA-{locus.upper()}" for locus in LOCI},
}


def cluster_file_rows(rows: DataFrame) -> DataFrame:
    """Output rows under the names of the cluster file: 28 columns, pattern_alpha with any alpha, VA and JA with any alpha gene."""
    held = rows.agg(F.bool_or(F.coalesce(F.col("tcra") != "", F.lit(False))).alias("alpha"), F.bool_or(F.col("va").isNotNull() | F.col("ja").isNotNull()).alias("genes")).first()
    extra = {"pattern_alpha": "pattern_alpha"} if held.alpha else {}
    extra |= {"va": "VA", "ja": "JA"} if held.genes else {}
    return rows.select(*[F.col(c).alias(name) for c, name in (CLUSTER_HEADER | extra).items()])


def write_clusters(rows: DataFrame, path: str) -> None:
    """Output rows as tab-separated files below a folder, in their order; missing values are empty."""
    ordered = cluster_file_rows(rows).orderBy("Fisher_score", "pattern", "index")
    ordered.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def match_rows(annotated: DataFrame, trimmed: bool = True, first: Sequence[str] = ()) -> DataFrame:
    """Annotated matches under the names of the match file; its first column says whether flanks were trimmed."""
    names = ["input_sequence", "match_sequence", "score", *ANNOTATIONS]
    header = [f"trimmed_{names[0]}" if trimmed else names[0], *names[1:]]
    values = {n: F.col(n) for n in names} | {"score": written_score()}
    return annotated.select(*first, *[values[n].alias(h) for n, h in zip(names, header, strict=True)])


def write_matches(annotated: DataFrame, path: str, trimmed: bool = True) -> None:
    match_rows(annotated, trimmed).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def _report(title: str, layout: str, lines: DataFrame, path: str) -> None:
    """A report's comment lines and then `value` in order of `at`, as text below a folder."""
    head = lines.sparkSession.createDataFrame([(0, f"# {title}"), (1, f"# Format: {layout}"), (2, "")], "part int, value string")
    both = head.select("part", F.lit("").alias("at"), "value").unionByName(lines.select(F.lit(3).alias("part"), F.col("at").cast("string").alias("at"), "value"))
    both.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def write_sample_report(files: DataFrame, path: str) -> None:
    """(sample_id, files) as one line a sample."""
    _report("All FastQ Files per Sample", "sample_id: /path/to/file1.fastq.gz /path/to/file2.fastq.gz ...", files.select(F.col("sample_id").alias("at"), F.concat_ws("\t", "sample_id", "files").alias("value")), path)


def paired_files(parsed: DataFrame, name: str = "file_name") -> DataFrame:
    """(sample_id, sample_number, lane, files): R1, R2, I1, I2 of a sample and lane, by tabs; the last name of each in order."""
    of = lambda read: F.max(F.when(F.col("read_number") == read, F.col(name)))
    return parsed.groupBy("sample_id", "sample_number", "lane").agg(F.concat_ws("\t", *[of(x) for x in ("R1", "R2", "I1", "I2")]).alias("files"))


def write_paired_report(pairs: DataFrame, path: str) -> None:
    at: Column = F.concat_ws("\t", "sample_id", F.col("sample_number").cast("string"), "lane")
    _report("Paired FastQ Files by Sample and Lane", "sample_lane: R1=/path/to/R1.fastq.gz, R2=/path/to/R2.fastq.gz", pairs.select(at.alias("at"), F.col("files").alias("value")), path)


def write_md5_report(files: DataFrame, path: str) -> None:
    """(file_name, md5) as one line a file."""
    _report("MD5 Checksums for Files", "filename\tmd5_hash", files.select(F.col("file_name").alias("at"), F.concat_ws("\t", "file_name", "md5").alias("value")), path)

