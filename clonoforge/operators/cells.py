"""Cells with several chains: pairing, counting and lock-step splitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoforge.functions.columns import col, first_part, last_part


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one schema under each other; a missing column is an error."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def paired_clonotypes(contigs: DataFrame, keep_alpha: bool = False) -> DataFrame:
    """Counts of alpha-beta pairs over cells: sample, CDR3b, TRBV, TRBJ, CDR3a[, TRAV, TRAJ], count.

    `contigs` has sample, barcode, chain (TRB or TRA), v_gene, j_gene, cdr3. In each cell
    every alpha meets every beta; a cell without alpha keeps its betas with null alpha.
    Counts are over all six genes and sequences even when the alpha genes are not output.
    Rows whose CDR3b is null or empty are dropped, - in a sample becomes :.

    Two shuffles, on the cell and on the six columns; only lists of one cell's chains are held.
    """
    one = F.struct("v_gene", "j_gene", "cdr3")
    cells = contigs.groupBy("sample", "barcode").agg(F.collect_list(F.when(col("chain") == "TRB", one)).alias("b"), F.collect_list(F.when(col("chain") == "TRA", one)).alias("a"))
    pairs = cells.select("sample", F.explode_outer("a").alias("a"), "b").select("sample", "a", F.explode_outer("b").alias("b"))
    named = pairs.select(
        F.translate("sample", "-", ":").alias("sample"),
        col("b.cdr3").alias("CDR3b"), col("b.v_gene").alias("TRBV"), col("b.j_gene").alias("TRBJ"),
        col("a.cdr3").alias("CDR3a"), col("a.v_gene").alias("TRAV"), col("a.j_gene").alias("TRAJ"),
    )
    counted = named.filter(col("CDR3b").isNotNull() & (col("CDR3b") != "")).groupBy(*named.columns).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("sample", "CDR3b", "TRBV", "TRBJ", "CDR3a", *(("TRAV", "TRAJ") if keep_alpha else ()), "count")


def split_sample_id(df: DataFrame, column: str = "subject:condition", separator: str = ":") -> DataFrame:
    """`column` as subject (first part) and condition (last part), which are the same without a separator."""
    c = f"`{column}`"
    return df.select(*[F.col(f"`{x}`") for x in df.columns if x != column], first_part(F.col(c), separator).alias("subject"), last_part(F.col(c), separator).alias("condition"))


STYLES = {"trvj": {"alpha": ("CDR3a", "TRAV", "TRAJ"), "beta": ("CDR3b", "TRBV", "TRBJ")}, "ctgene": {"alpha": ("CDR3a", "CTgeneA"), "beta": ("CDR3b", "CTgeneB")}}


def gene_style(columns: Sequence[str]) -> str:
    """trvj or ctgene: exactly one of the two sets of gene columns must be there, with CDR3a and CDR3b."""
    low = {c.lower() for c in columns}
    if not {"cdr3a", "cdr3b"} <= low:
        raise ValueError("the columns CDR3a and CDR3b are needed")
    trvj, ct = {"trav", "traj", "trbv", "trbj"} <= low, {"ctgenea", "ctgeneb"} <= low
    if trvj == ct:
        raise ValueError("both kinds of gene columns are there" if trvj else "no gene columns are there")
    return "trvj" if trvj else "ctgene"


def split_chains(df: DataFrame, chain: str, separator: str = ";", ragged: str = "error") -> DataFrame:
    """The lists of one chain (`alpha` or `beta`), parted at `separator`, exploded in lock step.

    Lists of unequal length in one row are an error, or with ragged="drop" the row falls out
    (see `ragged_rows`). Rows whose lists are null fall out. Empty pieces are kept.
    """
    style = STYLES[gene_style(df.columns)]
    names = {c.lower(): c for c in df.columns}
    fields = [names[c.lower()] for c in style[chain]]
    sizes = [F.size(F.split(F.col(c), separator)) for c in fields]
    equal = reduce(lambda a, b: a & b, [s == sizes[0] for s in sizes[1:]])
    lists = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fields]))
    if ragged == "error":
        lists = lists.filter(F.when(equal, True).otherwise(F.raise_error(F.lit("lists of one row differ in length")).cast("boolean")))
    else:
        lists = lists.filter(equal)
    zipped = F.arrays_zip(*[F.split(F.col(c), separator).alias(c) for c in fields])
    rest = [c for c in df.columns if c not in fields]
    exploded = lists.select(*rest, F.explode(zipped).alias("_piece"))
    return exploded.select(*[F.col(f"_piece.{c}").alias(c) if c in fields else c for c in df.columns])


def ragged_rows(df: DataFrame, chain: str, separator: str = ";") -> DataFrame:
    """The rows that `split_chains` cannot split."""
    style = STYLES[gene_style(df.columns)]
    names = {c.lower(): c for c in df.columns}
    sizes = [F.size(F.split(F.col(names[c.lower()]), separator)) for c in style[chain]]
    return df.filter(reduce(lambda a, b: a | b, [s != sizes[0] for s in sizes[1:]]))
