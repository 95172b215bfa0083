"""Scalar functions as Column builders: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty residues in the order of the substitution matrices.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
KMER_LENGTHS = (2, 3, 4, 5)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ---------------------------------------------------------------------


def given(c: str | Column) -> Column:
    """c without surrounding blanks; null where blank or NA in any case."""
    t = F.trim(col(c))
    return F.when((t != "") & (F.upper(t) != "NA"), t)


def first_part(c: str | Column, separator: str = ":") -> Column:
    return F.substring_index(col(c), separator, 1)


def last_part(c: str | Column, separator: str = ":") -> Column:
    return F.substring_index(col(c), separator, -1)


def before_first(c: str | Column, separator: str = ":") -> Column:
    """What stands before the first separator, trimmed; null without one or where blank."""
    return F.when(col(c).contains(separator), F.nullif(F.trim(F.substring_index(col(c), separator, 1)), F.lit("")))


def after_first(c: str | Column, separator: str = ":") -> Column:
    """What stands behind the first separator, trimmed; null without one or where blank."""
    return F.when(col(c).contains(separator), F.nullif(F.trim(F.substring(col(c), F.instr(col(c), separator) + F.lit(1), F.length(col(c)))), F.lit("")))


def strip_quotes(c: str | Column) -> Column:
    """One pair of equal quotes around c taken off."""
    return F.regexp_replace(F.regexp_replace(col(c), r'^"(.*)"$', "$1"), r"^'(.*)'$", "$1")


def trimmed_list(c: str | Column, separator: str = ";") -> Column:
    """Distinct trimmed non-empty pieces in order of first appearance; null for null."""
    return F.array_distinct(F.filter(F.transform(F.split(col(c), separator), lambda x: F.trim(x)), lambda x: x != ""))


def first_number(c: str | Column) -> Column:
    """The first run of digits with at most one dot; null without digits or where a second dot follows."""
    kept = F.regexp_replace(col(c), r"^[^0-9.]+", "")
    run = F.regexp_extract(kept, r"^([0-9.]+)", 1)
    return F.when(run.rlike(r"[0-9]") & ~run.rlike(r"\..*\."), run.try_cast("double"))


def clean_concentration(c: str | Column) -> Column:
    """Above range (>) is null, below range (<) is 0, else the first number."""
    return F.when(col(c).contains(">"), F.lit(None).cast("double")).when(col(c).contains("<"), F.lit(0.0)).otherwise(first_number(c))


def well_id(n: Column, columns: int = 12) -> Column:
    """A1, A2, ... for well number n from 0, row by row."""
    return F.concat(F.char(F.lit(65) + F.floor(n / columns).cast("int")), (n % columns + 1).cast("string"))


# Fixed value: how sequencing machines name their FASTQ files.
FASTQ_NAME = r"^(.+?)_S(\d+)_(L\d{3})_([IR][12])_001\.fastq(?:\.gz)?$"


def fastq_parts(c: str | Column) -> dict[str, Column]:
    """sample_id, sample_number, lane, read_number; all null where the name is no FASTQ name."""
    fits = col(c).rlike(FASTQ_NAME)
    part = lambda k: F.when(fits, F.regexp_extract(col(c), FASTQ_NAME, k))
    return {"sample_id": part(1), "sample_number": part(2).cast("int"), "lane": part(3), "read_number": part(4)}


def neg_log10(p: str | Column) -> Column:
    return F.when(col(p) > 0, -F.log10(col(p))).otherwise(0.0)


# --- receptor sequences -------------------------------------------------------


def is_residues(c: str | Column) -> Column:
    return col(c).rlike(f"^[{RESIDUES}]+$")


def is_cdr3(c: str | Column) -> Column:
    """At least eight residues from C to F."""
    return col(c).rlike(f"^C[{RESIDUES}]{{6,}}F$")


def trim_flanks(c: str | Column) -> Column:
    """Without the leading C and the final F or W, where both are there."""
    return F.regexp_replace(col(c), "^C(.*)[FW]$", "$1")


def motif_region(c: str | Column) -> Column:
    """Without three residues at either end; '' for six or fewer."""
    return F.when(F.length(col(c)) > 6, F.substring(col(c), F.lit(4), F.length(col(c)) - 6)).otherwise("")


def kmers(region: Column, lengths: tuple[int, ...] = KMER_LENGTHS) -> Column:
    """The distinct k-mers of a region."""

    def of(k: int) -> Column:
        places = F.when(F.length(region) >= k, F.sequence(F.lit(1), F.length(region) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(region, i, F.lit(k)))

    return F.array_distinct(F.flatten(F.array(*[of(k) for k in lengths])))


def wildcard_tags(region: Column) -> Column:
    """The region with each of its residues in turn replaced by %, as structs tag, position, residue."""
    places = F.when(F.length(region) > 0, F.sequence(F.lit(1), F.length(region))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            F.concat(F.substring(region, F.lit(1), i - 1), F.lit("%"), F.substring(region, i + 1, F.length(region))).alias("tag"),
            i.alias("position"),
            F.substring(region, i, F.lit(1)).alias("residue"),
        ),
    )


def matches_pattern(region: Column, pattern: str) -> Column:
    """% stands for one residue; the pattern may lie anywhere in the region."""
    return region.rlike(pattern.replace("%", "."))


def default_allele(c: str | Column) -> Column:
    """*01 where no allele is given."""
    return F.when(col(c).contains("*"), col(c)).otherwise(F.concat(col(c), F.lit("*01")))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two equally long texts, else null."""
    different = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), different)


def frequency(counts: str | Column) -> Column:
    """A count as a whole number of at least 1; 1 where none is given."""
    return F.greatest(F.coalesce(F.round(col(counts)).cast("bigint"), F.lit(1)), F.lit(1))


def mark_hla(alleles: Column, hit: str | Column) -> Column:
    """`!` behind each allele of a list parted by , ; | or / that equals hit."""
    token = F.concat(F.lit(r"(^|[,;|/]\s*)("), F.regexp_replace(col(hit), r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1"), F.lit(r")(?=\s*(?:[,;|/]|$))"))
    return F.when(F.coalesce(col(hit), F.lit("")) == "", alleles).otherwise(F.regexp_replace(alleles, token, F.lit("$1$2!")))


# --- statistics ---------------------------------------------------------------


def ln_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, Stirling's series beyond."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + (F.lit(1 / 12.0) - (F.lit(1 / 360.0) - F.lit(1 / 1260.0) / (x * x)) / (x * x)) / x
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def hypergeometric(k: Column, draws: Column, good: Column, total: Column) -> Column:
    """P(X = k) for `draws` of `total` things, `good` of which count."""
    possible = (k <= draws) & (k <= good) & (draws - k <= total - good)
    return F.when(possible, F.exp(ln_choose(good, k) + ln_choose(total - good, draws - k) - ln_choose(total, draws))).otherwise(0.0)


def fisher(a: Column, n_query: Column, c: Column, n_reference: Column, two_sided: bool = False) -> Column:
    """Fisher's exact test of a hits in n_query against c in n_reference.

    One-sided: at least a hits. Two-sided: all tables no likelier than the one seen, up to
    one part in 10**12. Null where a count exceeds its total.

    Terms are added up to ten standard deviations and forty counts beyond the mode (or beyond
    a, where that is further): what lies behind is below the last place of a double. A row
    thus takes about its spread in terms, not its totals.
    """
    a, n_query, c, n_reference = (x.cast("bigint") for x in (a, n_query, c, n_reference))
    total, good = n_query + n_reference, a + c
    least = F.greatest(F.lit(0).cast("bigint"), good + n_query - total)
    most = F.least(n_query, good)
    chance = lambda k: hypergeometric(k, n_query, good, total)
    mode = (n_query + 1).cast("double") * (good + 1) / (total + 2)
    share = good.cast("double") / total
    spread = F.ceil(F.sqrt(n_query * share * (1.0 - share)) * 10.0).cast("bigint") + 40
    far = F.greatest(a, F.ceil(mode).cast("bigint")) + spread
    if two_sided:
        seen = chance(a) * (1.0 + 1e-12)
        near = F.least(a, F.floor(mode).cast("bigint")) - spread
        # The other side holds tables as unlikely as far from the mode as a is, and beyond.
        reach = F.abs(a - mode).cast("bigint") + spread
        places = F.sequence(F.greatest(least, F.least(near, mode.cast("bigint") - reach)), F.least(most, F.greatest(far, mode.cast("bigint") + reach)))
        out = F.aggregate(places, F.lit(0.0), lambda s, k: s + F.when(chance(k) <= seen, chance(k)).otherwise(0.0))
    else:
        # From one k to the next by the ratio of their chances: the logarithms are taken once.
        first = chance(a)
        spare = (total - good - n_query).cast("double")

        def add(held: Column, k: Column) -> Column:
            p = held["p"] * ((good - k + 1) * (n_query - k + 1)).cast("double") / (k.cast("double") * (spare + k))
            return F.struct((held["s"] + p).alias("s"), p.alias("p"))

        # So far below the mode that what is missing of 1 is lost in rounding: all there is.
        below = a.cast("double") < mode - spread.cast("double") - 1
        rest = F.when((a < most) & ~below, F.sequence(a + 1, F.least(most, far))).otherwise(F.array().cast("array<bigint>"))
        tail = F.aggregate(rest, F.struct(first.alias("s"), first.alias("p")), add, lambda held: held["s"])
        out = F.when(below, 1.0).otherwise(tail)
    return F.when((a <= n_query) & (c <= n_reference), F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))


def odds_ratio(a: Column, n_query: Column, c: Column, n_reference: Column) -> Column:
    """Infinite where only the denominator is 0, 1 where both are."""
    num = a.cast("double") * (n_reference - c)
    den = (n_query - a).cast("double") * c
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0))).when(num == 0, 1.0).otherwise(F.lit(float("inf")))


def fold_change(seen: Column, n_sample: Column, reference: Column, n_reference: Column) -> Column:
    """How many times likelier in the sample; a hundredth of a count stands for none in the reference."""
    return seen / (reference + F.lit(0.01)) / n_sample * n_reference
