"""Spatial helpers: independent strips of boxes, and grid cells for overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.operators.ordered import Ordered


def split_islands(boxes: DataFrame, keys: list[str], tie: list[str], hot_rows: int | None = None) -> DataFrame:
    """Add ``island_x`` and ``island_y``: boxes of different islands cannot touch.

    Sorted by their left edge, a box that starts right of everything before it opens a new strip.
    The hull of boxes in one strip stays in that strip, so even boxes that grow by merging never
    meet across strips.  The same is done by top edge inside each strip.
    """

    def strips(df, keys, low, high, name):
        rows = Ordered(df, keys, [low, high, *tie], hot_rows).running(_end=("max", F.col(high))).previous(_before=F.col("_end"))
        opens = F.col("_before").isNull() | (F.col(low) > F.col("_before"))
        return rows.running(**{name: ("sum", opens.cast("long"))}).result().drop("_end", "_before")

    by_x = strips(boxes, keys, "x0", "x1", "island_x")
    return strips(by_x, keys + ["island_x"], "y0", "y1", "island_y")


def box_cells(boxes: DataFrame, size: int) -> DataFrame:
    """One row per grid cell a box covers."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return boxes.withColumn("cell_x", span("x0", "x1")).withColumn("cell_y", span("y0", "y1"))


def home_cell(x: Column, y: Column, size: int) -> Column:
    """True in the one shared cell that holds the overlap's top-left corner."""
    return (F.col("cell_x") == F.floor(x / size)) & (F.col("cell_y") == F.floor(y / size))
