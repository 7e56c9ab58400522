"""Regridding between grids that do not nest, in one projection by exact areas or across projections by points inside each cell.

Weights are a table (row, col, srow, scol, w) of what share of a target cell each source cell covers; they are found by
arithmetic on the grids' corners, so that only the lookup of the source's values is a join, on (row, col).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Raster(NamedTuple):
    """A north-up grid: the outer corner of its first cell, the width and height of a cell."""

    x0: float
    y1: float
    dx: float
    dy: float


def area_weights(target: DataFrame, grid: Raster, source: Raster) -> DataFrame:
    """row, col, srow, scol, w: what share of each of target(row, col)'s cells each source cell covers; w sums to 1 for every cell."""

    def along(place: str, start: float, step: float, s_start: float, s_step: float) -> tuple[Column, Callable[[Column], Column]]:
        low = (F.lit(start) + F.col(place) * step - s_start) / s_step  # in source cells
        high = (F.lit(start) + (F.col(place) + 1) * step - s_start) / s_step
        return F.sequence(F.floor(low), F.greatest(F.ceil(high) - 1, F.floor(low))), lambda k: (F.least(high, k + 1) - F.greatest(low, k)) * s_step / step

    cols, wide = along("col", grid.x0, grid.dx, source.x0, source.dx)
    rows, high = along("row", -grid.y1, grid.dy, -source.y1, source.dy)
    each = target.select("row", "col").withColumn("srow", F.explode(rows)).withColumn("scol", F.explode(cols))
    return each.withColumn("w", wide(F.col("scol")) * high(F.col("srow"))).filter("w > 0")


def projected_weights(target: DataFrame, grid: Raster, source: Raster, project: Callable[[Column, Column], tuple[Column, Column]], points: int = 4) -> DataFrame:
    """row, col, srow, scol, w: shares of points x points places inside each of target(row, col)'s cells, projected into the source's plane.

    Places that project() gives no coordinates (NULL) have a share without a source cell.
    """
    k = F.sequence(F.lit(0), F.lit(points - 1))
    each = target.select("row", "col", F.explode(k).alias("_i")).select("*", F.explode(k).alias("_j"))
    x = F.lit(grid.x0) + (F.col("col") + (F.col("_j") + 0.5) / points) * grid.dx
    y = F.lit(grid.y1) - (F.col("row") + (F.col("_i") + 0.5) / points) * grid.dy
    u, v = project(x, y)
    places = each.select("row", "col", F.floor((source.y1 - v) / source.dy).alias("srow"), F.floor((u - source.x0) / source.dx).alias("scol"))
    return places.groupBy("row", "col", "srow", "scol").agg((F.count("*") / (points * points)).alias("w"))


def regridded(source: DataFrame, value: str, weights: DataFrame, least: float = 0.0) -> DataFrame:
    """row, col, value, share: the mean of source(row, col, value) over each target cell, weighted, and the share that has values.

    Cells with a share of at most `least` are NULL. Null values and source cells that are not there do not count.
    """
    known = source.filter(F.col(value).isNotNull()).select(F.col("row").cast("long").alias("srow"), F.col("col").cast("long").alias("scol"), F.col(value).cast("double").alias("_v"))
    sums = weights.join(known, ["srow", "scol"], "left").groupBy("row", "col").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("w"))).alias("_w"), F.sum(F.col("w") * F.col("_v")).alias("_s"))
    share = F.least(F.coalesce("_w", F.lit(0.0)), F.lit(1.0))
    return sums.select("row", "col", F.when(share > least, F.col("_s") / F.col("_w")).alias(value), share.alias("share"))


def majority(source: DataFrame, value: str, weights: DataFrame) -> DataFrame:
    """row, col, value: the class that covers most of each target cell (the smaller of equals); NULL where none does."""
    known = source.filter(F.col(value).isNotNull()).select(F.col("row").cast("long").alias("srow"), F.col("col").cast("long").alias("scol"), F.col(value).alias("_v"))
    each = weights.join(known, ["srow", "scol"], "left").groupBy("row", "col", "_v").agg(F.round(F.sum("w"), 12).alias("_w"))
    return each.groupBy("row", "col").agg(F.min_by("_v", F.struct(F.when(F.col("_v").isNull(), 1).otherwise(0), -F.col("_w"), F.col("_v"))).alias(value))
