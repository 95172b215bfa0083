"""Chain and HLA tables: validation and folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoforge.functions.columns import given, is_residues

#: The eight loci, in the order of every HLA column list.
LOCI = ("dpa1", "dpb1", "dqa1", "dqb1", "drb1", "drb3", "drb4", "drb5")


def validate_chains(df: DataFrame, on_error: str = "raise") -> DataFrame:
    """Chain records fit for analysis: subject, condition and beta given, beta of residues, counts from 0.

    beta and alpha are trimmed and in upper case; an alpha that is not of residues is null;
    a missing count is 1; rows whose beta is not of residues fall out. A missing subject,
    condition or beta and a count that is negative or not finite are an error, or fall out
    with on_error="drop". Other columns pass through.
    """
    beta, alpha = F.upper(given("beta")), F.upper(given("alpha"))
    fit = given("subject").isNotNull() & given("condition").isNotNull() & beta.isNotNull() & (F.col("counts").isNull() | (F.col("counts") >= 0) & ~F.isnan("counts") & (F.col("counts") < float("inf")))
    if on_error == "raise":
        df = df.filter(F.when(fit, True).otherwise(F.raise_error(F.lit("a chain record lacks subject, condition or beta, or has an invalid count")).cast("boolean")))
    else:
        df = df.filter(fit)
    return df.filter(is_residues(beta)).withColumns({
        "subject": given("subject"), "condition": given("condition"), "beta": beta,
        "alpha": F.when(is_residues(alpha), alpha), "counts": F.coalesce("counts", F.lit(1.0)),
        **{c: given(c) for c in ("v_gene", "j_gene", "va_gene", "ja_gene") if c in df.columns},
    })


def _joined(*columns: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull())), "/")


def fold_hla(df: DataFrame, subject: str = "pid") -> DataFrame:
    """Twelve left and right allele columns as one text per locus, distinct alleles joined by /.

    The last pair holds DRB3, DRB4 and DRB5 alleles, told apart by their names. '' stands
    for an untyped locus.
    """
    out = {locus: _joined(given(f"{locus}_l"), given(f"{locus}_r")) for locus in LOCI[:5]}
    for locus in LOCI[5:]:
        own = [F.when(F.upper(given(f"drb345_{side}")).startswith(locus.upper()), given(f"drb345_{side}")) for side in "lr"]
        out[locus] = _joined(*own)
    return df.select(F.trim(subject).alias("subject"), *[c.alias(locus) for locus, c in out.items()])


def join_hla(chains: DataFrame, folded: DataFrame) -> DataFrame:
    """Chains with the folded HLA of their subject; '' at every locus where the subject is not typed."""
    joined = chains.join(folded, "subject", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in LOCI})
