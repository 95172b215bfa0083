"""Several values packed in one field: a parsing expression grammar over delimited text.

Grammar, ordered alternatives first to last (a failed alternative backtracks to where
it began):

    field     <- blank* ( bracketed blank* !. / places ) 
    bracketed <- '[' places ']' / '{' places '}' / '(' places ')'
    places    <- place (separator place)*
    place     <- quoted / bracketed / bare / nothing
    quoted    <- quote (doubled / !quote .)* quote &( blank* (separator / close / !.) )
    bare      <- ( joined / !separator !close . )+
    joined    <- '/' 'DV' digit          -- a slash that belongs to a name
    separator <- blank* mark blank*  /  space* (CRLF / newline / tab) space*  /  space+

A quote that is never closed, or that closes in the middle of a value, fails `quoted`;
the place is then read again as `bare`, its stray quotes are taken off and the row
carries the flag `quote`. A bracket without its partner does the same with `bracket`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = ";；,，、|/&+_"
MISSING = frozenset({"", "NA", "N/A", "NAN", "NULL", "NONE"})
_OPEN = {"[": "]", "{": "}", "(": ")"}
_CLOSE = "])}"
_QUOTES = "\"'“”‘’`"
_PAIRED = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_BLANKS = re.compile(r"[ \t\r\n ]*")
_JOINED = re.compile(r"/DV\d", re.I)
_NOT_AVAILABLE = re.compile(r"N/A(?![A-Za-z0-9])", re.I)


class Grammar:
    """The grammar above for one set of separator marks."""

    def __init__(self, marks: str = MARKS):
        self.separator = re.compile(rf"[ \t\r\n ]*[{re.escape(marks)}][ \t\r\n ]*|[  ]*(?:\r\n|[\n\r\t])[  ]*|[  ]+")
        #: A run of characters that no alternative treats specially.
        self.plain = re.compile(rf"[^{re.escape(marks)}\s \])}}]+")

    def _quoted(self, s: str, i: int, close: str) -> tuple[int, str] | None:
        end = _PAIRED.get(s[i : i + 1])
        if end is None:
            return None
        j, out = i + 1, []
        while (k := s.find(end, j)) >= 0:
            out.append(s[j:k])
            if s[k + 1 : k + 2] == end:
                out.append(end)
                j = k + 2
                continue
            rest = _BLANKS.match(s, k + 1).end()
            if rest >= len(s) or s[rest] in close or self.separator.match(s, k + 1):
                return k + 1, "".join(out)
            return None  # closed in the middle of a value
        return None  # never closed

    def _bare(self, s: str, i: int, close: str) -> tuple[int, str]:
        if m := _NOT_AVAILABLE.match(s, i):
            return m.end(), m.group()
        j = i
        while j < len(s):
            if m := self.plain.match(s, j):
                j = m.end()
            elif s[j] == "/" and j > i and (m := _JOINED.match(s, j)):
                j = m.end()
            elif s[j] in close or self.separator.match(s, j):
                break
            else:
                j += 1
        return j, s[i:j]

    def _places(self, s: str, i: int, close: str) -> tuple[int, list[tuple[str, str | None]]]:
        out: list[tuple[str, str | None]] = []
        while True:
            i = _BLANKS.match(s, i).end() if not out else i
            if found := self._quoted(s, i, close):
                i = found[0]
                out.append((found[1].strip(), None))
            elif found := self._bracketed(s, i):
                i = found[0]
                out += found[1]
            else:
                flag = "quote" if s[i : i + 1] in _PAIRED else "bracket" if s[i : i + 1] in _OPEN else None
                i, item = self._bare(s, i, close)
                clean = item.strip(" \t\r\n " + _QUOTES + "[]{}()")
                if flag is None and clean != item.strip():
                    flag = "quote" if item.strip()[-1] in _QUOTES else "bracket"
                out.append((clean, flag))
            m = self.separator.match(s, i)
            if not m or m.end() == i:
                return i, out
            if m.end() >= len(s) and m.group().isspace() or s[m.end() : m.end() + 1] in close and s[m.end() : m.end() + 1] and m.group().isspace():
                return m.end(), out  # blanks before the end part nothing
            i = m.end()

    def _bracketed(self, s: str, i: int) -> tuple[int, list[tuple[str, str | None]]] | None:
        end = _OPEN.get(s[i : i + 1])
        if end is None:
            return None
        j, out = self._places(s, i + 1, end)
        j = _BLANKS.match(s, j).end()
        if s[j : j + 1] != end:
            return None
        rest = _BLANKS.match(s, j + 1).end()
        if rest < len(s) and s[rest] not in _CLOSE and not self.separator.match(s, j + 1):
            return None
        return j + 1, out

    def parse(self, s: str) -> list[tuple[str, str | None]]:
        """The places of s in order, each a clean item ('' for an empty place) and its flag."""
        i = _BLANKS.match(s, 0).end()
        if (found := self._bracketed(s, i)) and _BLANKS.match(s, found[0]).end() >= len(s):
            return found[1]
        i, out = self._places(s, i, "")
        while i < len(s):  # a close that nothing opened: read on behind it
            i, more = self._places(s, i + 1, "")
            out += [(item, flag or "bracket") for item, flag in more if item]
        return out


def _free(wanted: str, taken: Sequence[str]) -> str:
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted


def split_packed(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), least: int = 1, marks: str = MARKS) -> DataFrame:
    """One row per value of each of `fields`: the columns `keep`, field, pos, item, error.

    pos counts places from 1; an empty place or a missing-value word counts but gives no
    row. `least` keeps only fields holding at least so many values. error is null, `quote`
    or `bracket`. Null, blank and missing-value fields give no row; repeated rows are split
    each on its own; other columns of df are not touched, and where `keep` names one of the
    result's own columns that result column gets underscores in front. Very long fields
    take time in proportion to their length.

    No shuffle: the fields are unpivoted in the JVM, fields without any separator, quote or
    bracket never reach Python when two values are asked for, the rest goes through Arrow.
    """
    keep = list(keep)
    names = dict(zip(("field", "pos", "item", "error"), (_free(x, keep) for x in ("field", "pos", "item", "error")), strict=True))
    value = _free("value", [*keep, *names.values()])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in fields]))
    cell = _free("cell", [*keep, *names.values(), value])
    long = df.select(*keep, cells.alias(cell)).select(*keep, F.col(f"{cell}.f").alias(names["field"]), F.col(f"{cell}.v").alias(value)).filter(F.col(value).isNotNull())
    if least > 1:
        long = long.filter(F.trim(F.col(value)).rlike(rf"[{re.escape(marks)}\s ]"))
    schema = T.StructType([*(long.schema[c] for c in keep), T.StructField(names["field"], T.StringType()), T.StructField(names["pos"], T.IntegerType()), T.StructField(names["item"], T.StringType()), T.StructField(names["error"], T.StringType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(marks)
        for batch in batches:
            rows, pos, items, errors = [], [], [], []
            for r, text in enumerate(batch.column(n + 1).to_pylist()):
                places = [(k, item, flag) for k, (item, flag) in enumerate(grammar.parse(text), 1) if item.upper() not in MISSING]
                if len(places) >= least:
                    for k, item, flag in places:
                        rows.append(r)
                        pos.append(k)
                        items.append(item)
                        errors.append(flag)
            taken = batch.take(pa.array(rows, pa.int32()))
            columns = [taken.column(k) for k in range(n + 1)] + [pa.array(pos, pa.int32()), pa.array(items, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return long.mapInArrow(run, schema)
