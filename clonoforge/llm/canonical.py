"""Mapping free-entered values to a canonical list by symmetric deletion."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNMATCHED = "UNMATCHED"
#: Letters of other scripts that look like or stand for Latin ones and survive compatibility folding.
LOOKALIKES = str.maketrans("АВЕКМНОРСТУХѴаеорсухѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβγδ", "ABEKMHOPCTYXVaeopcyxvABEZHIKMNOPTYXabgd")
_DASHES = re.compile("[‐‑‒–—―−﹣－]")
_SLASHES = re.compile("[∕⁄／]")
INFINITE = float("inf")


def fold(value: str) -> str:
    """Compatibility form, Latin letters, upper case, single blanks: the default normaliser."""
    value = unicodedata.normalize("NFKC", value.translate(LOOKALIKES)).translate(LOOKALIKES)
    return " ".join(_SLASHES.sub("/", _DASHES.sub("-", value)).upper().split())


def unit_cost(x: str, y: str) -> float:
    return 1.0


def weighted_distance(a: str, b: str, cost: Callable[[str, str], float], most: float, band: int | None = None) -> float:
    """Damerau-Levenshtein distance (neighbours exchanged once) under cost(x, y); '' stands for nothing.

    An exchange of neighbours costs 1 where each of the two may be changed at cost 1.
    Returns infinity as soon as every way is beyond `most`. With `band` only alignments that
    never shift by more than so many places are looked at: enough where both texts are known
    to come together by at most `band` deletes each, and then the time is linear.
    """
    n, m = len(a), len(b)
    band = max(n, m) if band is None else band
    if abs(n - m) > band:
        return INFINITE
    before: list[float] = []
    row = [0.0] + [INFINITE] * m
    for j in range(1, min(m, band) + 1):
        row[j] = row[j - 1] + cost("", b[j - 1])
    for i in range(1, n + 1):
        x, lo, hi = a[i - 1], max(1, i - band), min(m, i + band)
        new = [INFINITE] * (m + 1)
        if i <= band:
            new[0] = row[0] + cost(x, "")
        least = new[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            best = min(row[j] + cost(x, ""), new[j - 1] + cost("", y), row[j - 1] + (0.0 if x == y else cost(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, before[j - 2] + max(1.0, cost(x, y)))
            new[j] = best
            least = min(least, best)
        if least > most:
            return INFINITE
        before, row = row, new
    return row[m] if row[m] <= most else INFINITE


class Rules:
    """How values are spelled, and how far a value may be from the entry it means.

    normalise     value -> word; '' means nothing is there
    cost          weights of the edits
    edits, petty  at most so many dear and so many petty edits; `is_petty` says which characters are
                  petty (separators, look-alikes), and an edit of them costs `petty_cost` at least
    allowed       the greatest weighted distance for a word
    variants      the word itself, and what is left of it without what may be a remark, each
                  with what leaving that out costs

    A word's keys are the first `prefix` characters (the last ones where `from_end`) of what comes of
    deleting at most `edits` other and `petty` petty characters of it. If two words are within
    these edits of each other, the same text is left of both after such deletes, and so
    they share a key. Only the first `prefix + edits + petty` characters matter: long words
    cost no more keys than short ones, and none is left out.
    """

    prefix = 16
    from_end = False
    petty = 0
    petty_cost = 0.1

    def __init__(self, edits: int = 2, normalise: Callable[[str], str] = fold, cost: Callable[[str, str], float] = unit_cost, allowed: Callable[[str], float] | None = None):
        self.edits, self.normalise, self.cost = edits, normalise, cost
        self._allowed = allowed

    def is_petty(self, c: str) -> bool:
        return False

    def allowed(self, word: str) -> float:
        return min(self.edits, len(word) // 4) if self._allowed is None else self._allowed(word)

    def variants(self, word: str, longest: int) -> list[tuple[str, float]]:
        """Those that can meet an entry of at most `longest` characters."""
        return [(word, 0.0)] if len(word) <= longest + self.edits + self.petty else []

    def keys(self, word: str, dear: bool = True) -> Iterator[tuple[float, set[str]]]:
        """(least cost, keys) by number of deletes, cheapest first; without `dear` only petty deletes."""
        reach = self.prefix + self.edits + self.petty
        head = word[-reach:] if self.from_end else word[:reach]
        cut = slice(-self.prefix, None) if self.from_end else slice(self.prefix)
        places = [i for i, c in enumerate(head) if not self.is_petty(c)] if dear else []
        small = [i for i, c in enumerate(head) if self.is_petty(c)]
        levels = sorted((few + many * self.petty_cost, few, many) for few in range(min(self.edits if dear else 0, len(places)) + 1) for many in range(min(self.petty, len(small)) + 1))
        for least, few, many in levels:
            out = set()
            for a in combinations(places, few):
                for b in combinations(small, many):
                    key = head
                    for i in sorted(a + b, reverse=True):
                        key = key[:i] + key[i + 1 :]
                    out.add(key[cut])
            yield least, out

    def distance(self, word: str, spelling: str, most: float) -> float:
        """weighted_distance of what is left without equal beginnings and ends."""
        begin, a, b = 0, len(word), len(spelling)
        while begin < a and begin < b and word[begin] == spelling[begin]:
            begin += 1
        while a > begin and b > begin and word[a - 1] == spelling[b - 1]:
            a, b = a - 1, b - 1
        return weighted_distance(word[begin:a], spelling[begin:b], self.cost, most, self.edits + self.petty)


class Matcher:
    """A dictionary of symmetric deletes over (spelling, canonical name, frequency).

    lookup() gives the canonical name of the nearest spelling: least weighted distance,
    then greatest frequency, then name. Only the entries travel with a task; the dictionary
    is built from them once per worker.
    """

    def __init__(self, entries: Iterable[tuple[str, str, float]], rules: Rules | None = None):
        self.entries = list(dict.fromkeys(entries))
        self.rules = rules or Rules()
        self._index: dict[str, list[int]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None, "_exact": None}

    @property
    def names(self) -> list[str]:
        return sorted({name for _, name, _ in self.entries} - {UNMATCHED})

    @property
    def index(self) -> dict[str, list[int]]:
        if self._index is None:
            index: dict[str, list[int]] = {}
            for k, (spelling, name, _) in enumerate(self.entries):
                for key in set().union(*(keys for _, keys in self.rules.keys(spelling, name != UNMATCHED))):
                    index.setdefault(key, []).append(k)
            self._exact: dict[str, list[int]] = {}
            for k, (spelling, _, _) in enumerate(self.entries):
                self._exact.setdefault(spelling, []).append(k)
            self._longest = max((len(spelling) for spelling, _, _ in self.entries), default=0)
            self._index = index
        return self._index

    def nearest(self, value: str) -> tuple[float, float, str] | None:
        """(distance, -frequency, name) of the best entry, or None.

        Keys are looked up from the cheapest deletes on, and no further once nothing nearer can come.
        """
        rules, index = self.rules, self.index
        word = rules.normalise(value)
        if not word:
            return None
        best: tuple[float, float, str] | None = None
        open_ = []
        for text, spent in rules.variants(word, self._longest):
            for k in self._exact.get(text, ()):
                found = (spent, -self.entries[k][2], self.entries[k][1])
                best = found if best is None or found < best else best
            most = rules.allowed(text)
            open_.append((text, spent, most, rules.keys(text, most >= 1.0), set()))
        while open_:
            left = []
            for text, spent, most, levels, seen in open_:
                if best is not None and spent > best[0]:
                    continue
                least, keys = next(levels, (INFINITE, ()))
                if least > most or best is not None and least + spent > best[0]:
                    continue
                for key in keys:
                    for k in index.get(key, ()):
                        if k in seen:
                            continue
                        seen.add(k)
                        spelling, name, frequency = self.entries[k]
                        bound = most if best is None else min(most, best[0] - spent + 1e-9)
                        d = rules.distance(text, spelling, bound) if bound >= 0 else INFINITE
                        if d <= most and (best is None or (d + spent, -frequency, name) < best):
                            best = (d + spent, -frequency, name)
                left.append((text, spent, most, levels, seen))
            open_ = left
        return best

    def lookup(self, value: str) -> str:
        found = self.nearest(value)
        return found[2] if found else UNMATCHED


# --- receptor genes -----------------------------------------------------------

#: What may stand before a gene's number, A or B in place of x; all of it is dictionary, none of it code.
SPELLINGS = ("TRxV", "TCRxV", "TCRVx", "xV", "Vx", "HSTRxV")
LONG_SPELLINGS = tuple(f"{head} {name} {segment}" for head in ("T CELL RECEPTOR", "TCR") for name in ("x", "xLONG") for segment in ("V", "VAR.", "VARIABLE"))
_LONG = {"A": "ALPHA", "B": "BETA", "G": "GAMMA", "D": "DELTA"}
#: Segments that are no V gene of the chain. A value nearest to one of them means none.
OTHER_SEGMENTS = tuple(f"{head}{chain}{segment}" for head in ("TR", "TCR") for chain in "ABGD" for segment in "VDJC") + tuple(f"{chain}{segment}" for chain in "ABGD" for segment in "VDJC") + ("TCRVA", "TCRVB", "TCRVG", "TCRVD", "VA", "VB", "VG", "VD", "IGHV", "IGKV", "IGLV")

_SOFT, _HARD, _HARD_DASH, _ZERO = "_", "=", "-", "º"
_ALIKE = {"O": "0", "I": "1", "L": "1", "|": "1"}
_NUMERIC = "0123456789OIL|"
_NUMBERS = frozenset("0123456789|º")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BETWEEN = re.compile(rf"(?<=[{re.escape(_NUMERIC)}])[^A-Z0-9|*]+(?=[{re.escape(_NUMERIC)}])")
_OTHER_SIGN = re.compile(r"[^A-Z0-9|*\x01\x02]")
_LEADING_ZERO = re.compile(r"(?<![0-9])0+(?=[0-9])")
_TOKEN = re.compile(r"[A-Z]+|[0-9|º]+|.", re.S)
#: Where a remark behind the name may begin: an allele, or a sign and then a word that is no DV number.
_REMARK = re.compile(r"\*|[_=-]+(?!DV[_=-]*[0-9OIL|º])(?=[A-Z*]|$)|_+$")


def gene_word(value: str) -> str:
    """A typed gene with its characters classed, none left out.

    Between two digits the first sign parts numbers: `-` for a dash, `=` for any other. All
    other signs and blanks are `_`, and zeros before a number are `º`. l, I, | and O count
    as digits as far as signs go; they stay what they are.
    """
    text = fold(value)

    def between(m: re.Match) -> str:
        run = m.group()
        return ("\x01" if "-" in run else "\x02") + _SOFT * (len(run) - 1)

    text = _OTHER_SIGN.sub(_SOFT, _BETWEEN.sub(between, text)).translate({1: _HARD_DASH, 2: _HARD})
    return _LEADING_ZERO.sub(lambda m: _ZERO * len(m.group()), text)


@lru_cache(maxsize=1 << 16)
def gene_cost(x: str, y: str) -> float:
    """Signs, leading zeros and look-alikes are petty, one letter may be mistyped, digits and what parts them tell genes apart."""
    if x in ("", _SOFT, _ZERO) and y in ("", _SOFT, _ZERO):
        return 0.1
    if x in "-=" and y in "-=" and x and y:
        return 0.1
    if x and y and (_ALIKE.get(x) == y or _ALIKE.get(y) == x or x in _ALIKE and y in _ALIKE and _ALIKE[x] == _ALIKE[y]):
        return 0.1
    return 1.0 if (not x or x.isalpha() and x != _ZERO) and (not y or y.isalpha() and y != _ZERO) else 99.0


class GeneRules(Rules):
    """Genes: one letter may be mistyped, three petty edits besides; remarks before and behind may be left out.

    Keys are of the last characters, since the number is what tells genes apart.
    """

    petty = 3
    prefix = 6
    from_end = True

    def __init__(self, edits: int = 1):
        super().__init__(edits, gene_word, gene_cost)

    def is_petty(self, c: str) -> bool:
        return c in "_-=º0|1OIL"

    def allowed(self, word: str) -> float:
        """Three petty edits, and a letter only in a name of more than two."""
        letters = re.search(r"[A-Z]+", word.replace(_SOFT, ""))
        return self.petty * self.petty_cost + (self.edits if letters and len(letters.group()) > 2 else 0) + 1e-9

    def variants(self, word: str, longest: int) -> list[tuple[str, float]]:
        """The word without tokens before it, and without a remark behind it; what is left out costs a little."""
        starts, spent = [], 0.0
        for m in _TOKEN.finditer(word):
            if word[m.start()] in _LETTERS:
                starts.append((m.start(), spent))
            spent += 2.0 if word[m.start()] in _NUMBERS else 0.01  # a number before the name is dearer than a typing error in it
        ends = sorted({len(word), *(m.start() for m in _REMARK.finditer(word))})
        most = longest + self.edits + self.petty
        out: dict[str, float] = {}
        for a, ca in starts:
            for k in range(bisect_right(ends, a), bisect_right(ends, a + most)):
                text, spent = word[a : ends[k]], ca + 0.01 * (k + 1) * (ends[k] < len(word))
                out[text] = min(out.get(text, INFINITE), spent)
        return sorted(out.items(), key=lambda kv: kv[1])


def gene_entries(chain: str, gene: str, frequency: float) -> Iterator[tuple[str, str, float]]:
    """(spelling, name, frequency): how a V gene of one chain may be written, and what its number means elsewhere."""
    word = gene_word(gene)
    number = word[re.match(r"[A-Z]*", word).end() :]
    x = chain[-1]
    own = {s.replace("xLONG", _LONG[x]).replace("x", x) for s in SPELLINGS + LONG_SPELLINGS}
    for spelling in sorted(own):
        yield gene_word(spelling + " " * (" " in spelling) + number.replace(_SOFT, "/")), gene, frequency
    for other in sorted(set(OTHER_SEGMENTS) - own):
        yield gene_word(other + number.replace(_SOFT, "/")), UNMATCHED, -1.0


def gene_matcher(chain: str, genes: Iterable[tuple[str, float]]) -> Matcher:
    """V genes of one chain (`TRA` or `TRB`) from (gene, frequency) pairs."""
    return Matcher((entry for gene, frequency in genes for entry in gene_entries(chain, gene, frequency)), GeneRules())


# --- in Spark -----------------------------------------------------------------


def is_missing(c: str):
    """Null, blank or NA in any case."""
    return F.col(c).isNull() | F.upper(F.trim(F.translate(F.col(c), " \t\r\n", "    "))).isin("", "NA")


def bounded(df: DataFrame, most: int) -> list | None:
    """df's rows, or None where there are more than `most`; never collects more than that."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _free(wanted: Sequence[str], taken: Sequence[str]) -> list[str]:
    out: list[str] = []
    for name in wanted:
        while name in taken or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def typed_values(df: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., field, value): every given value of `fields`; field and value get underscores where keep names them."""
    keep = list(keep)
    field, value, _, holder = _free(("field", "value", "name", "_cells"), keep)
    parts = [F.when(~is_missing(c), F.struct(F.lit(c).alias("f"), F.col(c).alias("v"))) for c in fields]
    long = df.select(*keep, F.explode(F.array_compact(F.array(*parts))).alias(holder))
    return long.select(*keep, F.col(f"{holder}.f").alias(field), F.col(f"{holder}.v").alias(value))


def canonical_values(df: DataFrame, fields: dict[str, Matcher], keep: Sequence[str]) -> DataFrame:
    """(keep..., field, value, name): every given value of `fields` that is not itself a listed name.

    name is the canonical name or UNMATCHED. Null, blank and NA values and exactly listed
    names give no row; repeated rows give one row each; other columns are not read, and
    where keep names field, value or name these get underscores in front. The matchers hold
    a reference of bounded size (see `bounded`) and are broadcast; values are looked up
    once per batch and remembered, so there is no shuffle and a value that fills a third
    of the rows costs one lookup per worker. A reference beyond that size: `canonical_by_join`.
    """
    keep = list(keep)
    long = typed_values(df, list(fields), keep)
    field, value = long.columns[-2:]
    target = _free(("field", "value", "name"), keep)[2]
    listed = F.lit(False)
    for c, m in fields.items():
        listed = listed | (F.col(field) == c) & F.col(value).isin(m.names)
    long = long.filter(~listed)
    schema = T.StructType([*long.schema, T.StructField(target, T.StringType())])
    n = len(keep)
    shared = df.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = shared.value
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            names = []
            for key in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if (name := known.get(key)) is None:
                    name = known[key] = matchers[key[0]].lookup(key[1])
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=schema.names)

    return long.mapInArrow(run, schema)


def canonical_by_join(values: DataFrame, entries: DataFrame, rules: Rules, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, name) for the distinct `value`s of a frame against entries (by..., spelling, name, frequency) of any size.

    The search of `Matcher` with the dictionary as a table, under the same rules: both sides
    are exploded to their keys and meet in an equi-join, candidates are ranked by weighted
    distance, frequency and name, a listed name means itself. Columns `by` part independent
    reference lists. A key that many entries share is an ordinary skewed join key, which
    adaptive execution splits. Nulls give no row.
    """
    by = list(by)
    longest = entries.agg(F.max(F.length("spelling"))).first()[0] or 0

    def exploded(df: DataFrame, columns: Sequence[str], texts: Callable[[tuple], list[tuple[str, float, bool]]], out: Sequence[str]) -> DataFrame:
        read = df.select(*columns)
        extra = [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField("key", T.StringType())]
        schema = T.StructType([*read.schema, *extra])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[int] = []
                words: list[str] = []
                costs: list[float] = []
                keys: list[str] = []
                for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    for text, spent, dear in texts(row):
                        for key in set().union(*(found for _, found in rules.keys(text, dear))):
                            rows.append(k)
                            words.append(text)
                            costs.append(spent)
                            keys.append(key)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int32())).columns, pa.array(words, pa.string()), pa.array(costs, pa.float64()), pa.array(keys, pa.string())], names=schema.names)

        return read.mapInArrow(run, schema)

    def of_value(row: tuple) -> list[tuple[str, float, bool]]:
        word = rules.normalise(row[-1])
        return [(text, spent, rules.allowed(text) >= 1.0) for text, spent in rules.variants(word, longest)] if word else []

    @F.pandas_udf(T.DoubleType())
    def distance(word, spelling):
        return word.combine(spelling, lambda x, y: 0.0 if x == y else rules.distance(x, y, rules.allowed(x)))

    every = values.select(*by, "value").filter(F.col("value").isNotNull()).distinct()
    listed = entries.select(*by, "spelling", "name", "frequency").distinct()
    typed = exploded(every, [*by, "value"], of_value, ("word", "spent")).alias("t")
    # The order of columns lets the last two of an entry decide which deletes it needs.
    known = exploded(listed, [*by, "frequency", "name", "spelling"], lambda row: [(row[-1], 0.0, row[-2] != UNMATCHED)], ("_word", "_spent")).drop("_word", "_spent")
    pairs = typed.join(known, [*by, "key"]).select(*by, "value", "word", "spent", "name", "spelling", "frequency").distinct()
    ranked = pairs.withColumn("d", distance("word", "spelling")).filter(F.col("d") < F.lit(INFINITE))
    best = ranked.groupBy(*by, "value").agg(F.min(F.struct((F.col("d") + F.col("spent")).alias("d"), (-F.col("frequency")).alias("f"), "name")).alias("b")).select(*by, "value", F.col("b.name").alias("found"))
    same = listed.filter(F.col("name") != UNMATCHED).select(*by, F.col("name").alias("value"), F.col("name").alias("own")).distinct()
    return every.join(best, [*by, "value"], "left").join(same, [*by, "value"], "left").select(*by, "value", F.coalesce("own", "found", F.lit(UNMATCHED)).alias("name"))


def gene_table(genes: DataFrame) -> DataFrame:
    """entries (field, spelling, name, frequency) for `canonical_by_join` of genes (field, chain, gene, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(field, *entry) for field, chain, gene, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True) for entry in gene_entries(chain, gene, freq or 0.0)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())], names=["field", "spelling", "name", "frequency"])

    return genes.select("field", "chain", "gene", "freq").mapInArrow(run, "field string, spelling string, name string, frequency double")
