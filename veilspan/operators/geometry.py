"""Joins by place: intervals on a line that overlap, and points in boxes, each meeting in cells of a grid.

A side is dealt to the cells it covers, cells are equality keys, and a pair that shares several cells
is kept in one of them. So rows of one document meet their neighbours only, and a large document is
spread over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_CHARS = 1024
CELL_POINTS = 64.0  # of a page's side


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], of_a: tuple[str, str], of_b: tuple[str, str], cell: int = CELL_CHARS) -> DataFrame:
    """Rows of a and b (columns of both) with equal keys whose half-open ranges overlap; touching or empty ranges do not.

    of_a, of_b: the names of start and end. Other columns of a and b must differ.
    """
    (a0, a1), (b0, b1) = of_a, of_b
    first = lambda c: F.floor(F.col(c) / cell)
    cells = lambda s, e: F.explode(F.sequence(first(s), F.floor((F.col(e) - 1) / cell))).alias("_cell")
    left = a.where(F.col(a1) > F.col(a0)).select("*", cells(a0, a1))
    right = b.where(F.col(b1) > F.col(b0)).select("*", cells(b0, b1))
    j = left.join(right, [*keys, "_cell"]).where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)))
    return j.where(F.col("_cell") == F.greatest(first(a0), first(b0))).drop("_cell")  # the first cell of both


def _level(side, cell: float):
    """How often a cell is doubled until it is as long as a side."""
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell)), F.lit(0)).cast("int")


def points_in(points: DataFrame, boxes: DataFrame, keys: list[str], x: str = "x", y: str = "y", cell: float = CELL_POINTS) -> DataFrame:
    """Rows of points and boxes (columns of both) with equal keys where x0 < x < x1 and y0 < y < y1 (or as `closed` boxes say).

    boxes: keys, x0, y0, x1, y1 and others; an optional boolean `closed` includes x0 and y0. A box
    meets points in cells as large as itself, of which it covers at most nine, however large it is.
    """
    b = boxes.where("x1 > x0 and y1 > y0").withColumn("_level", _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), cell))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    b = b.select("*", F.explode(span("x0", "x1")).alias("_cx")).select("*", F.explode(span("y0", "y1")).alias("_cy"))
    levels = boxes.where("x1 > x0 and y1 > y0").groupBy(*keys).agg(F.collect_set(_level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), cell)).alias("_levels"))  # a few numbers
    p = points.join(levels, keys).select("*", F.explode("_levels").alias("_level")).drop("_levels")
    p = p.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    closed = F.col("closed") if "closed" in boxes.columns else F.lit(False)
    inside = (F.col(x) < F.col("x1")) & (F.col(y) < F.col("y1")) & (
        ((F.col(x) > F.col("x0")) & (F.col(y) > F.col("y0"))) | (closed & (F.col(x) >= F.col("x0")) & (F.col(y) >= F.col("y0")))
    )
    return p.join(b, [*keys, "_level", "_cx", "_cy"]).where(inside).drop("_level", "_cx", "_cy")
