"""Delimited lines of many layouts into typed chain records, faulty lines apart with the reason."""

from __future__ import annotations

import csv
import math
import re
import sys
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoforge.session import cut

SEPARATORS = "\t,;|"
REASONS = ("quoting", "columns", "beta", "alpha", "counts", "subject")
RECORD_FIELDS = ("subject", "condition", "beta", "alpha", "v_gene", "j_gene", "va_gene", "ja_gene")
#: Header name of each record field.
HEADER_NAMES = {"beta": "cdr3b", "alpha": "cdr3a", "v_gene": "trbv", "j_gene": "trbj", "va_gene": "trav", "ja_gene": "traj"}
_RESIDUES = re.compile(r"[ACDEFGHIKLMNPQRSTVWY]+")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: Line ends inside a line, which a csv reader would take for its end; private-use stand-ins.
_INNER = str.maketrans({"\r": "", "\n": ""})
_OUTER = str.maketrans({"": "\r", "": "\n"})


def strip_line(line: str) -> str:
    """line without its leading byte-order mark and final line end."""
    line = line.removeprefix("﻿")
    return line.removesuffix("\n").removesuffix("\r")


def header_separator(header: str) -> str:
    """The separator that stands most often outside quotes; ties go to the first of SEPARATORS."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(SEPARATORS, key=bare.count)


def parse_strict(line: str, separator: str) -> list[str] | None:
    """The fields of one assembled record; None where its quoting is broken."""
    inner = "\r" in line or "\n" in line
    try:
        rows = list(csv.reader([line.translate(_INNER) if inner else line], delimiter=separator, strict=True))
    except csv.Error:
        return None
    fields = rows[0] if rows else [""]
    return [x.translate(_OUTER) for x in fields] if inner else fields


def _given(value: str | None) -> str | None:
    value = (value or "").strip()
    return None if not value or value.upper() == "NA" else value


class Layout:
    """What one header line says about the lines of its file."""

    def __init__(self, header: str | None):
        line = strip_line(header or "")
        self.separator = header_separator(line)
        names = [x.strip().lower() for x in parse_strict(line, self.separator) or line.split(self.separator)]
        self.width = len(names) if line.strip() else 0
        self.at = {name: names.index(source) for name, source in HEADER_NAMES.items() if source in names}
        self.subject = names.index("subject:condition") if "subject:condition" in names else None
        self.counts = names.index("count") if "count" in names else None

    def record(self, line: str) -> tuple[str | None, dict]:
        """(reason or None, the fields that could be read)."""
        fields = parse_strict(line, self.separator)
        if fields is None:
            return "quoting", {}
        if len(fields) != self.width:
            return "columns", {}
        out: dict = {name: _given(fields[k]) for name, k in self.at.items()}
        reason = None
        beta = out["beta"] = (out.get("beta") or "").upper() or None
        if beta is None or not _RESIDUES.fullmatch(beta):
            reason = "beta"
        alpha = out["alpha"] = (out.get("alpha") or "").upper() or None
        if alpha is not None and not _RESIDUES.fullmatch(alpha):
            reason = reason or "alpha"
        counts = _given(fields[self.counts]) if self.counts is not None else None
        out["counts"] = None
        if counts is not None:
            number = float(counts) if _NUMBER.fullmatch(counts) else math.nan
            if math.isfinite(number) and number >= 0:
                out["counts"] = number
            else:
                reason = reason or "counts"
        subject, colon, condition = (fields[self.subject] if self.subject is not None else "").partition(":")
        out["subject"], out["condition"] = subject.strip() or None, condition.strip() or None
        if not colon or not subject.strip() or not condition.strip():
            reason = reason or "subject"
        return reason, out


class _Quotes:
    """Where a strict reader stands in a record, one physical line after the other: its state between two of them."""

    def __init__(self, separator: str):
        self.separator = separator
        self.opens = re.compile(rf'(?:^|{re.escape(separator)})"')

    def after(self, line: str, inside: bool) -> bool | None:
        """Whether a quote is open behind the line; None where one closes before its field ends."""
        at = 0
        while True:
            if not inside:
                m = self.opens.search(line) if at == 0 else self.opens.search(line, at)
                if m is None or at and m.start() < at:
                    return False
                at, inside = m.end(), True
            end = line.find('"', at)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == '"':
                at = end + 2
                continue
            if end + 1 < len(line) and line[end + 1] != self.separator:
                return None
            at, inside = end + 1, False
            if at >= len(line):
                return False


def assemble(lines: Iterable[str], separator: str = ",", width: int | None = None, most: int = 64_000_000) -> Iterator[str]:
    """Physical lines to records, for raw text in which a quoted field may hold line ends.

    A line whose quote is open is joined with the next ones until the quote closes where a
    field ends. If it closes inside a field instead, or the record has not `width` fields, or
    the text ends first, or the record grows beyond `most` characters (the greatest a record
    may have, a bound on memory), the quote was broken: its line is a record of its own, and
    reading goes on with the next line. A broken quote thus never swallows what follows. Lines
    are looked at twice at most up to the next line with a quote, so the time is linear.
    """
    quotes = _Quotes(separator)
    source = iter(lines)
    waiting: deque[str] = deque()  # lines that were looked at and given back
    while True:
        if waiting:
            first = waiting.popleft()
        elif (first := next(source, None)) is None:
            return
        state = quotes.after(first, False)
        if not state:
            yield first
            continue
        held, size, looked, closed = [first], len(first), 0, False
        while size <= most:
            if looked < len(waiting):
                line = waiting[looked]
            elif (line := next(source, None)) is None:
                break
            else:
                waiting.append(line)
            looked += 1
            held.append(line)
            size += len(line) + 1
            state = quotes.after(line, True)
            if not state:
                closed = state is False
                break
        record = "\n".join(held)
        if closed and width is not None:
            fields = parse_strict(record, separator)
            closed = fields is not None and len(fields) == width
        if closed:
            for _ in range(looked):
                waiting.popleft()
            yield record
        else:
            yield first


def _record_columns(out: dict[str, list]) -> list[pa.Array]:
    return [pa.array(out[c], pa.string()) for c in RECORD_FIELDS] + [pa.array(out["counts"], pa.float64()), pa.array(out["reason"], pa.string()), pa.array(out["line"], pa.string())]


_PARSED = [*(T.StructField(c, T.StringType()) for c in RECORD_FIELDS), T.StructField("counts", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("line", T.StringType())]


def parse_records(lines: Iterable[str], layout: Layout, out: dict[str, list]) -> int:
    """Assembles and parses lines of one layout into the lists of `out`; how many records there were."""
    return sum(parse_record(record, layout, out) for record in assemble(lines, layout.separator, layout.width))


def parse_record(record: str, layout: Layout, out: dict[str, list]) -> int:
    """Parses one record into the lists of `out`; 0 for a blank one."""
    if not record or record.isspace():
        return 0
    reason, fields = layout.record(record)
    for c in RECORD_FIELDS:
        out[c].append(fields.get(c))
    out["counts"].append(fields.get("counts"))
    out["reason"].append(reason)
    out["line"].append(record)
    return 1


#: Bytes of header lines that are broadcast; more of them meet their lines in a shuffle.
HEADER_BYTES = 32_000_000


def parse_chain_lines(lines: DataFrame, line_id: str = "line_id", file_name: str = "file_name", line_no: str = "line_no", line: str = "line", header_bytes: int = HEADER_BYTES) -> DataFrame:
    """Every data record once: line_id, file_name, line_no, the fields of a record, reason, line.

    A valid record has reason null and all its fields; a faulty one has the first reason of
    REASONS that holds and the fields that could still be read. Header lines (line_no 1) and
    blank or null lines give no row. The header of a file is the one with the smallest
    line_id where several were delivered; a file without one has no known number of columns,
    so its lines are `columns`. Repeated lines are each parsed; extra columns are not read;
    an empty table gives no row; a line may be as long as memory allows.

    The headers, a row a file, are stored and measured: up to `header_bytes` they are broadcast
    and no line is moved, beyond it lines meet their header in a shuffle, in which adaptive
    execution splits a file that holds much of the rows. Inside the partition a row's text is
    assembled to records (`assemble`; a row with no line end inside is one record), each read
    by a strict csv reader, its structural exception caught before any typed field is built.
    """
    read = lines.select(F.col(line_id).alias("line_id"), F.col(file_name).alias("file_name"), F.col(line_no).alias("line_no"), F.col(line).alias("line"))
    headers = cut(read.filter(F.col("line_no") == 1).groupBy("file_name").agg(F.min_by("line", "line_id").alias("header")))
    size = headers.agg(F.coalesce(F.sum(F.length("file_name") + F.length("header") + 32), F.lit(0))).first()[0]
    body = read.filter((F.coalesce(F.col("line_no"), F.lit(0)) != 1) & F.col("line").isNotNull())
    few = F.broadcast(headers) if size <= header_bytes else headers
    joined = body.join(few, body["file_name"].eqNullSafe(few["file_name"]), "left").select(body["line_id"], body["file_name"], body["line_no"], "line", "header")
    schema = T.StructType([*joined.schema[:3], *_PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        layouts: dict[str | None, Layout] = {}
        for batch in batches:
            rows: list[int] = []
            out: dict[str, list] = {c: [] for c in (*RECORD_FIELDS, "counts", "reason", "line")}
            for k, (text, header) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                text = strip_line(text)
                layout = layouts.get(header) or layouts.setdefault(header, Layout(header))
                # A row without a line end inside is one record as it stands.
                n = parse_records(text.split("\n"), layout, out) if "\n" in text else parse_record(text, layout, out)
                rows += [k] * n
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], *_record_columns(out)], names=schema.names)

    return joined.mapInArrow(run, schema)


def read_chain_text(spark: SparkSession, path: str) -> DataFrame:
    """The records of delivered chain files: file_name, record_no, the fields of a record, reason, line.

    Raw text, whose quoted fields may hold line ends: the first line of each file is its header,
    the others are assembled to records and parsed as in `parse_chain_lines`. A file is read
    by one task, files are spread over tasks. Empty files give no row.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_name"), "value")
    schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("record_no", T.IntegerType()), *_PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                header, *lines = strip_line(text).split("\n")
                out: dict[str, list] = {c: [] for c in (*RECORD_FIELDS, "counts", "reason", "line")}
                n = parse_records((x.removesuffix("\r") for x in lines), Layout(header), out)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), *_record_columns(out)], names=schema.names)

    return files.mapInArrow(run, schema)


def faulty_lines(parsed: DataFrame) -> DataFrame:
    """line_id and reason of each line that is no record."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_lines(parsed: DataFrame) -> DataFrame:
    """The typed records of the valid lines; a missing count is 1."""
    return parsed.filter(F.col("reason").isNull()).select("line_id", "file_name", *RECORD_FIELDS, F.coalesce("counts", F.lit(1.0)).alias("counts"))

