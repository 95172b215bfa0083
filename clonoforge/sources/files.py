"""Sequencing files, enrichment responses, and text tables of any separator."""

from __future__ import annotations

import hashlib
import io
import os
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoforge.functions.columns import fastq_parts, neg_log10

SNIFFED_LINES = 20
SEPARATORS = "\t,;|"


# --- text tables ----------------------------------------------------------------


def sniff_separator(lines: Sequence[str]) -> str | None:
    """The separator that stands equally often, and not never, on each of the first lines outside quotes.

    Of several the one that stands most often; on ties the last of SEPARATORS. None where
    none does.
    """
    rows = [x.rstrip("\r\n") for x in lines]
    rows = [re.sub(r'"[^"]*"?', "", x) for x in rows if x.strip()][:SNIFFED_LINES]
    best = None
    for separator in SEPARATORS:
        counts = {x.count(separator) for x in rows}
        if len(counts) == 1 and (n := counts.pop()) and (best is None or n >= best[0]):
            best = (n, separator)
    return best[1] if best else None


def read_table(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A table with a header: stdin for `-`, Excel by extension, else text by the given, sniffed or usual separator."""
    if path == "-":
        return read_text(spark, sys.stdin.read(), separator)
    ext = os.path.splitext(path)[1].lower()
    if ext == ".xls":
        raise ValueError("the old Excel format is not supported")
    if ext == ".xlsx":
        return read_excel(spark, path)
    if separator is None:
        head = [r.value for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
        separator = sniff_separator(head) or ("\t" if ext in ("", ".tsv") else ",")
    return spark.read.csv(path, sep=separator, header=True, inferSchema=True)


def read_text(spark: SparkSession, text: str, separator: str | None = None) -> DataFrame:
    """A table held in memory; tab where nothing can be sniffed."""
    lines = text.splitlines()
    separator = separator or sniff_separator(lines) or "\t"
    return spark.read.csv(spark.sparkContext.parallelize(lines), sep=separator, header=True, inferSchema=True)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, skip_rows: int = 0, header: bool = True) -> DataFrame:
    """A sheet as text columns; the row at `skip_rows` is dropped, names come from the sheet's first row."""
    rows = excel_rows(open(path, "rb").read(), sheet)
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    names = rows[0] if header and rows else [f"column_{k}" for k in range(width)]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    return spark.createDataFrame([tuple(r) for r in rows[skip_rows + 1 :]], ", ".join(f"`{n}` string" for n in names)) if names else spark.createDataFrame([], "empty string")


def excel_rows(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """All cells of a sheet as text, read from the file's parts without a spreadsheet library."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(link)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{space}sheet")]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            raise ValueError(f"no sheet {sheet}")
        root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in root.iter(f"{space}row"):
        cells: list[str] = []
        for cell in row.iter(f"{space}c"):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            at = 0
            for letter in letters:
                at = at * 26 + ord(letter) - 64
            cells += [""] * (at - 1 - len(cells))
            value = cell.find(f"{space}v")
            if cell.get("t") == "s" and value is not None:
                cells.append(shared[int(value.text)])
            elif cell.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in cell.iter(f"{space}t")))
            else:
                cells.append("" if value is None else value.text or "")
        number = int(row.get("r", len(out) + 1))
        out += [[] for _ in range(number - 1 - len(out))]
        out.append(cells)
    return out


def write_table(df: DataFrame, path: str, separator: str | None = None) -> None:
    """Text with a header: to stdout for `-`, tabs for .tsv and no extension, else commas; only these two separators."""
    if separator not in (None, "\t", ","):
        raise ValueError("the separator is a tab or a comma")
    separator = separator or ("\t" if os.path.splitext(path)[1].lower() in ("", ".tsv") else ",")
    if path == "-":
        sys.stdout.write(separator.join(df.columns) + "\n")
        for row in df.toLocalIterator(prefetchPartitions=True):
            sys.stdout.write(separator.join("" if v is None else str(v) for v in row) + "\n")
    else:
        df.write.mode("overwrite").csv(path, sep=separator, header=True)


# --- receptor search inputs --------------------------------------------------------


def read_airr(spark: SparkSession, path: str) -> DataFrame:
    """(sequence) of a rearrangement table; empty where it has no cdr3_aa."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.col("cdr3_aa").alias("sequence")) if "cdr3_aa" in df.columns else spark.createDataFrame([], "sequence string")


TRUST4_HEADER = "#count frequency CDR3nt CDR3aa V D J C cid cid_full_length".split()


def trust4_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line, sequence) of the report lines whose V, D or J field begins with TRB."""
    fields = F.split(F.trim(value), r"\s+")
    beta = F.exists(F.slice(fields, 5, 3), lambda x: x.startswith("TRB"))
    return lines.filter(~F.col(value).startswith("#") & beta).select(F.col(value).alias("line"), F.element_at(fields, 4).alias("sequence"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(sequence) of a text file, trimmed, without empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("sequence")).filter("sequence <> ''")


# --- sequencing files ---------------------------------------------------------------


def _md5_of(path: str, piece: int = 8 << 20) -> str:
    """The MD5 of a file, read in pieces, whatever its size."""
    held = hashlib.md5(usedforsecurity=False)
    with pafs.FileSystem.from_uri(path)[0].open_input_stream(pafs.FileSystem.from_uri(path)[1], compression=None) as stream:
        while block := stream.read(piece):
            held.update(block)
    return held.hexdigest()


def scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, md5) of all .fastq and .fastq.gz files below a folder.

    Files are listed by name first, no content is loaded into a row; each is hashed in pieces by
    the task that has its name, through the file system its path names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = files.withColumn("file_name", F.substring_index("path", "/", -1)).filter(F.lower("file_name").rlike(r"\.fastq(\.gz)?$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = [x if "://" in x else re.sub("^file:/+", "file:///", x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_md5_of, uris), pa.string())], names=["path", "file_name", "md5"])

    return named.mapInArrow(run, "path string, file_name string, md5 string")


def parse_fastq(files: DataFrame, name: str = "file_name") -> DataFrame:
    """files with the parts of their names; files that are no FASTQ by name fall out."""
    return files.withColumns(fastq_parts(name)).filter("sample_id IS NOT NULL")


def files_of(parsed: DataFrame, keys: Sequence[str], name: str = "file_name") -> DataFrame:
    """(keys, files): the file names of each sample or lane in order of sample, number, lane and read, by tabs."""
    order = F.struct("sample_id", F.col("sample_number").cast("string").alias("number"), "lane", "read_number", F.col(name).alias("name"))
    return parsed.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("f")).select(*keys, F.array_join(F.transform("f", lambda x: x["name"]), "\t").alias("files"))


# --- enrichment responses -------------------------------------------------------------


def enrichment_rows(df: DataFrame, column: str, library: str) -> DataFrame:
    """One row per term of a response [[rank, term, p, z, combined, [genes], q], ...]; shorter rows fall out."""
    text = F.regexp_replace(F.regexp_replace(column, r"\bNaN\b", "null"), r"\bInfinity\b", "null")
    rows = df.select(F.explode(F.from_json(text, "array<array<string>>")).alias("r")).filter(F.size("r") >= 7)
    number = lambda k: F.coalesce(F.element_at("r", k).try_cast("double"), F.lit(0.0))
    genes = F.array_join(F.coalesce(F.from_json(F.element_at("r", 6), "array<string>"), F.array().cast("array<string>")), ", ")
    return rows.select(
        F.coalesce(F.element_at("r", 1).try_cast("bigint"), F.lit(0)).alias("rank"), F.coalesce(F.element_at("r", 2), F.lit("")).alias("term"),
        number(3).alias("p_value"), number(4).alias("zscore"), number(5).alias("combined_score"), genes.alias("overlap_genes"), number(7).alias("q_value"), F.lit(library).alias("library"),
    )


def top_terms(rows: DataFrame, n: int, order: str = "rank") -> DataFrame:
    """The first n terms in the server's order."""
    return rows.orderBy(order).limit(n)


def chart_values(rows: DataFrame, n: int = 10) -> DataFrame:
    """(term, neg_log10_p) of the first n terms."""
    return top_terms(rows, n).select("term", neg_log10("p_value").alias("neg_log10_p"))
