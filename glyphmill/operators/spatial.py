"""Overlap joins of boxes: an equi-join on (sample, grid cell) with the exact test behind it.

Both sides are posted to every cell that they touch; a pair is kept only in the cell that holds the upper left corner of its
intersection, so there is nothing to make distinct. A page with many boxes spreads over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, intersection

CELL = 64


def spread(rows: DataFrame) -> DataFrame:
    """rows for a join that sends neither side to the driver. The optimizer takes rows that an array was exploded to for as few as the arrays, and would broadcast a whole table of them."""
    return rows.hint("merge")


def cell_sizes(boxes: DataFrame, key: str, prefix: str = "", least: int = 8, empty: int = 16) -> DataFrame:
    """key, cell: a grid cell as large as the median of the longer sides of a key's boxes, in whole pixels; for keys without measurable boxes a fixed one."""
    b = Box.of(prefix)
    side = F.percentile(F.greatest(b.w, b.h), F.lit(0.5))
    return boxes.groupBy(key).agg(side.alias("side")).select(key, F.when(F.col("side").isNull(), empty).otherwise(F.greatest(F.lit(least), F.floor("side"))).cast("int").alias("cell"))


def posted(df: DataFrame, prefix: str, cell: Column, gx: str = "gx", gy: str = "gy") -> DataFrame:
    b = Box.of(prefix)
    low, high = (lambda c: F.floor(c / cell).cast("int")), (lambda c, n: F.floor((c + F.greatest(n, F.lit(1)) - 1) / cell).cast("int"))
    return df.withColumn(gx, F.explode(F.sequence(low(b.x), high(b.x, b.w)))).withColumn(gy, F.explode(F.sequence(low(b.y), high(b.y, b.h))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, lp: str, rp: str, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """Pairs of one key whose boxes (columns lp + x.. and rp + x..) meet, with their intersection's area as inter.

    cells: a grid cell of each key, as cell_sizes gives, for keys whose boxes differ much in size; keys without one take cell. The pairs are the same.
    """
    a, b = Box.of(lp), Box.of(rp)
    size = F.lit(cell)
    if cells is not None:
        own = cells.select(F.col(key).alias("_of"), F.col("cell").alias("_cell"))
        left = left.join(own, F.col(key) == F.col("_of"), "left").drop("_of")
        right = right.join(own, F.col(key) == F.col("_of"), "left").drop("_of")
        size = F.coalesce("_cell", F.lit(cell))
    r = posted(right, rp, size, "_rx", "_ry").withColumnRenamed(key, "_key").drop("_cell")
    on = (F.col(key) == F.col("_key")) & (F.col("gx") == F.col("_rx")) & (F.col("gy") == F.col("_ry"))
    pairs = posted(left, lp, size).join(spread(r), on).withColumn("inter", intersection(a, b)).where("inter > 0")
    own_cell = (F.floor(F.greatest(a.x, b.x) / size) == F.col("gx")) & (F.floor(F.greatest(a.y, b.y) / size) == F.col("gy"))
    return pairs.where(own_cell).drop("gx", "gy", "_rx", "_ry", "_key", "_cell")
