"""Plate-reader grids: 96 wells out of stacked 8 x 12 blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoforge.functions.columns import clean_concentration, well_id

SETUP_ROWS, DATA_FROM, DATA_TO = 16, 21, 45
PLATE_COLUMNS = 12


def stride_groups(rows: Sequence[Sequence], stride: int) -> list[list]:
    """Every stride-th row together: group k holds rows k, k + stride, ...; a short last block is padded with empties."""
    width = len(rows[0]) if rows else 0
    out = []
    for first in range(0, stride):
        own = list(rows[first::stride])
        out.append(own if own else [("",) * width])
    return out[: max(1, min(stride, len(rows)))] if rows else []


def unpivot_plate(grid: DataFrame, row: str = "row_id", cells: str = "cells", label: str = "label", setup_stride: int = 2, data_stride: int = 3) -> DataFrame:
    """(row_block, well, name, value) of a grid of text rows.

    Rows 0-15 are setup (stride 2), 21-44 data (stride 3); row r of a part belongs to
    measure r % stride and plate row r / stride; the measure's name is the label of its
    first row; wells count row by row.
    """
    setup = F.col(row) < SETUP_ROWS
    data = (F.col(row) >= DATA_FROM) & (F.col(row) < DATA_TO)
    at = F.when(setup, F.col(row)).otherwise(F.col(row) - DATA_FROM)
    stride = F.when(setup, F.lit(setup_stride)).otherwise(F.lit(data_stride))
    named = grid.filter(setup | data).withColumns({"part": F.when(setup, "setup").otherwise("data"), "measure": (at % stride).cast("int"), "plate_row": F.floor(at / stride).cast("int")})
    labels = named.filter("plate_row = 0").select("plate", "part", "measure", F.col(label).alias("name"))
    wells = named.select("plate", "part", "measure", "plate_row", F.posexplode(cells).alias("c", "value"))
    return wells.join(labels, ["plate", "part", "measure"]).select("plate", "part", "measure", "name", (F.col("plate_row") * PLATE_COLUMNS + F.col("c")).alias("n"), well_id(F.col("plate_row") * PLATE_COLUMNS + F.col("c")).alias("well_id"), "value")


def wide_plate(wells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per well, one column per measure."""
    return wells.groupBy("plate", "n", "well_id").pivot("name", list(names)).agg(F.first("value"))


def enough_cells(columns: Sequence[str], least: int) -> Column:
    """At least so many cells are neither null, empty nor NaN."""
    full = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.lower(F.col(c).cast("string")) != "nan"), 1).otherwise(0) for c in columns]
    return sum(full[1:], full[0]) >= least


def masked_concentration(adjusted: str, threshold: str | None = None, limit: float | None = None) -> Column:
    """The cleaned concentration, null where the threshold column exceeds the limit."""
    clean = clean_concentration(adjusted)
    return clean if threshold is None else F.when(F.col(threshold).try_cast("double") > limit, F.lit(None).cast("double")).otherwise(clean)
