"""Regular grids as tables of row, col and values: their geometry, resampling, terrain, zones.

A grid is north-up: row 0 is the northernmost, x grows with col. Neighbours and coarse cells are met by equi-joins on
row and col, so a grid of any size stays partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.core import clip
from strataflow.operators.spatial import TILE, block_stats, steepest_neighbour, tile_array, tiled


@dataclass(frozen=True)
class Domain:
    """Bounds (left, bottom, right, top) of a grid in metres, snapped outwards to whole cells unless told otherwise."""

    name: str
    extent: tuple[float, float, float, float]
    res: float = 90.0
    snap: bool = True

    def bounds(self) -> tuple[float, float, float, float]:
        x0, y0, x1, y1 = self.extent
        if not self.snap:
            return x0, y0, x1, y1
        r = self.res
        return math.floor(x0 / r) * r, math.floor(y0 / r) * r, math.ceil(x1 / r) * r, math.ceil(y1 / r) * r

    def shape(self) -> tuple[int, int]:
        """Rows and columns."""
        x0, y0, x1, y1 = self.bounds()
        return round((y1 - y0) / self.res), round((x1 - x0) / self.res)

    def n_cells(self) -> int:
        rows, cols = self.shape()
        return rows * cols

    def transform(self) -> tuple[float, float, float]:
        """Left, top and cell size."""
        x0, _, _, y1 = self.bounds()
        return x0, y1, self.res

    def template(self, spark: SparkSession) -> DataFrame:
        """cell, row, col, x, y (of its centre) of every cell."""
        x0, y1, res = self.transform()
        cols = self.shape()[1]
        cells = spark.range(self.n_cells()).select(F.col("id").alias("cell"), F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
        return cells.withColumn("x", x0 + res * (F.col("col") + 0.5)).withColumn("y", y1 - res * (F.col("row") + 0.5))

    def bbox_degrees(self, steps: int = 50) -> tuple[float, float, float, float]:
        """West, south, east, north of the outline, to 3 decimals."""
        x0, y0, x1, y1 = self.bounds()
        along = [k / (steps - 1) for k in range(steps)]
        outline = [(x0 + t * (x1 - x0), y) for t in along for y in (y0, y1)] + [(x, y0 + t * (y1 - y0)) for t in along for x in (x0, x1)]
        lons, lats = zip(*(albers_inverse(x, y) for x, y in outline))
        return round(min(lons), 3), round(min(lats), 3), round(max(lons), 3), round(max(lats), 3)


def domain_of(left: float, bottom: float, right: float, top: float, res: float = 90.0, name: str = "bbox") -> Domain:
    return Domain(name, (left, bottom, right, top), res, snap=False)


def which_domain(shape: tuple[int, int], bounds: tuple[float, ...], known: list[Domain], tolerance: float = 1.0) -> str:
    """The name of the domain with that shape and, to the tolerance, those bounds, or 'unknown'."""
    for d in known:
        if tuple(shape) == d.shape() and all(abs(a - b) <= tolerance for a, b in zip(bounds, d.bounds())):
            return d.name
    return "unknown"


def on_domain(grid: DataFrame, domain: Domain) -> DataFrame:
    """grid; rows outside the domain end the query."""
    rows, cols = domain.shape()
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return grid.withColumn("row", F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit(f"a cell is not on {domain.name}")).cast("int")))


def albers_inverse(x: float, y: float) -> tuple[float, float]:
    """Longitude and latitude of EPSG:5070 metres, by Newton's method on the authalic function (Snyder 1987)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q_of(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = math.radians(29.5), math.radians(45.5), math.radians(23.0)
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(p2) - q_of(p1))
    big = m_of(p1) ** 2 + n * q_of(p1)
    rho0 = a * math.sqrt(big - n * q_of(p0)) / n
    rho, theta = math.hypot(x, rho0 - y), math.atan2(x, rho0 - y)
    q = (big - (rho * n / a) ** 2) / n
    phi = math.asin(max(-1.0, min(1.0, q / 2)))
    for _ in range(20):
        s = math.sin(phi)
        step = (1 - e2 * s * s) ** 2 / (2 * math.cos(phi)) * (q / (1 - e2) - s / (1 - e2 * s * s) + math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        phi += step
        if abs(step) < 1e-13:
            break
    return -96.0 + math.degrees(theta / n), math.degrees(phi)


# -- resampling: fine cells are `k` to a coarse one each way


def bilinear(coarse: DataFrame, fine: DataFrame, value: str, k: int, out: str | None = None) -> DataFrame:
    """fine(row, col, ...) with the coarse value interpolated at each centre; missing neighbours leave their weight to the others."""
    out = out or value
    u, v = (F.col("row") + 0.5) / k - 0.5, (F.col("col") + 0.5) / k - 0.5
    r, c = F.floor(u).cast("int"), F.floor(v).cast("int")
    # Each coarse cell goes to the four squares between centres that it is a corner of, so that fine cells are joined once.
    steps = [(i, j) for i in (0, 1) for j in (0, 1)]
    squares = F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c"), F.lit(k).alias("k")) for k, (i, j) in enumerate(steps)])
    have = coarse.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.explode(squares).alias("_q"))
    have = have.groupBy(F.col("_q.r").alias("_r"), F.col("_q.c").alias("_c")).agg(*[F.max(F.when(F.col("_q.k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])
    found = fine.withColumns({"_u": u - r, "_w": v - c, "_r": r, "_c": c}).join(have, ["_r", "_c"], "left")
    weights = [(F.col("_u") if i else 1 - F.col("_u")) * (F.col("_w") if j else 1 - F.col("_w")) for i, j in steps]
    total, summed = F.lit(0.0), F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.when(F.col(f"_v{k}").isNotNull(), w).otherwise(0.0)
        summed = summed + F.coalesce(w * F.col(f"_v{k}"), F.lit(0.0))
    kept = [F.col(x) for x in fine.columns if x not in ("row", "col")]
    return found.select("row", "col", *kept, F.when(total > 0, summed / total).alias(out))


def nearest(coarse: DataFrame, fine: DataFrame, value: str, k: int, out: str | None = None) -> DataFrame:
    """fine with the value of the coarse cell that holds it."""
    have = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias(out or value))
    return fine.withColumn("_r", F.expr(f"cast(row div {k} as int)")).withColumn("_c", F.expr(f"cast(col div {k} as int)")).join(have, ["_r", "_c"], "left").drop("_r", "_c")


def averaged(fine: DataFrame, value: str, k: int, out: str | None = None) -> DataFrame:
    """row, col, mean of the fine cells of each coarse one."""
    return block_stats(fine, value, k).select(F.col("brow").cast("int").alias("row"), F.col("bcol").cast("int").alias("col"), F.col("mean").alias(out or value))


def clean(x: Column, nodata: float = -9999.0, scale: float = 1.0, clamp: bool = True) -> Column:
    """A resampled value: nodata is missing, negatives are 0, then scaled."""
    x = F.when(x != nodata, x)
    return (F.greatest(x, F.lit(0.0)) if clamp else x) * scale


def masked(grid: DataFrame, mask: DataFrame, value: str, flag: str = "mask") -> DataFrame:
    """grid with the value missing wherever the mask (row, col, flag) is not above 0."""
    return grid.join(mask.select("row", "col", F.col(flag).alias("_m")), ["row", "col"], "left").withColumn(value, F.when(F.col("_m") > 0, F.col(value))).drop("_m")


DOWNSCALERS: dict[str, Callable[..., DataFrame]] = {}


def downscaler(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        DOWNSCALERS[name] = f
        return f

    return put


@downscaler("bilinear")
def _bilinear(coarse: DataFrame, fine: DataFrame, value: str, k: int, covariates: list[str]) -> DataFrame:
    return bilinear(coarse, fine, value, k)


@downscaler("twi")
def _by_wetness(coarse: DataFrame, fine: DataFrame, value: str, k: int, covariates: list[str], strength: float = 0.035, limit: float = 3.0) -> DataFrame:
    """Bilinear plus strength times the standardised departure of the first covariate from its own coarse field."""
    base = bilinear(coarse, fine, value, k)
    if not covariates:
        return base
    smooth = bilinear(averaged(fine, covariates[0], k, "_smooth"), base, "_smooth", k).withColumn("_d", F.col(covariates[0]) - F.col("_smooth"))
    sd = smooth.agg(F.stddev_pop("_d").alias("_sd"))  # one row
    shift = F.when(F.col("_sd") > 1e-9, strength * clip(F.col("_d") / F.col("_sd"), -limit, limit)).otherwise(0.0)
    return smooth.join(F.broadcast(sd)).withColumn(value, F.col(value) + shift).drop("_smooth", "_d", "_sd")


def _by_model(coarse: DataFrame, fine: DataFrame, value: str, k: int, covariates: list[str], fit: Callable, least: int = 12) -> DataFrame:
    """Values predicted from the covariates by a model of the coarse cells, plus each coarse cell's error; bilinear where that is missing."""
    base = bilinear(coarse, fine, value, k, "_base")
    train = coarse.select("row", "col", F.col(value).alias("_y"))
    for c in covariates:
        train = train.join(averaged(fine, c, k), ["row", "col"])
    train = train.dropna()
    if not covariates or train.limit(least).count() < least:
        return base.withColumnRenamed("_base", value)
    predicted = fit(train, covariates, "_y")(base.dropna(subset=covariates)).select("row", "col", F.col("prediction").alias("_p"))
    error = coarse.join(averaged(predicted, "_p", k), ["row", "col"]).select("row", "col", (F.col(value) - F.col("_p")).alias("_e"))
    both = nearest(error, predicted, "_e", k).select("row", "col", (F.col("_p") + F.col("_e")).alias("_m"))
    return base.join(both, ["row", "col"], "left").withColumn(value, F.coalesce("_m", "_base")).drop("_m", "_base")


@downscaler("regression")
def _by_regression(coarse: DataFrame, fine: DataFrame, value: str, k: int, covariates: list[str]) -> DataFrame:
    def fit(train: DataFrame, names: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression

        assembler = VectorAssembler(inputCols=names, outputCol="_x")
        model = LinearRegression(featuresCol="_x", labelCol=label, solver="normal").fit(assembler.transform(train))
        return lambda df: model.transform(assembler.transform(df))

    return _by_model(coarse, fine, value, k, covariates, fit)


@downscaler("ml")
def _by_forest(coarse: DataFrame, fine: DataFrame, value: str, k: int, covariates: list[str]) -> DataFrame:
    def fit(train: DataFrame, names: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
        from strataflow.operators.learn import forest

        model, assembler = forest(train, names, label, trees=200, depth=12)
        return lambda df: model.transform(assembler.transform(df))

    return _by_model(coarse, fine, value, k, covariates, fit)


def downscale(coarse: DataFrame, fine: DataFrame, value: str, k: int, method: str = "bilinear", covariates: list[str] | None = None) -> DataFrame:
    """fine(row, col, covariates...) with the coarse value brought to its cells by a registered method."""
    if method not in DOWNSCALERS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(DOWNSCALERS)}")
    return DOWNSCALERS[method](coarse, fine, value, k, covariates or [])


def moisture_downscaled(driver: DataFrame, envelope: DataFrame, k: int, theta: str = "theta", method: str = "bilinear", covariates: list[str] | None = None) -> DataFrame:
    """row, col, theta on the fine grid of envelope(row, col, wp, sat): saturation is interpolated between coarse cells, moisture follows.

    driver(row, col, theta) is coarse; its own envelope is the mean of the fine one.
    """
    own = driver.join(averaged(envelope, "wp", k), ["row", "col"]).join(averaged(envelope, "sat", k), ["row", "col"])
    fraction = clip((F.col(theta) - F.col("wp")) / F.greatest(F.col("sat") - F.col("wp"), F.lit(1e-6)), 0.0, 1.0)
    fine = downscale(own.select("row", "col", fraction.alias("_f")), envelope, "_f", k, method, covariates)
    return fine.select("row", "col", (F.col("wp") + clip(F.col("_f"), 0.0, 1.0) * (F.col("sat") - F.col("wp"))).alias(theta))


# -- terrain


def slope_degrees(grid: DataFrame, z: str, res: float, tile: int = TILE) -> DataFrame:
    """row, col, slope by the weighted differences of the eight neighbours (Horn 1981); a missing neighbour counts as the cell itself.

    Cells are dealt to tiles with one cell around; cells without a height have no row.
    """
    # weight of a neighbour's height in the east-west and in the north-south difference
    steps = [(i, j, j * (2 if i == 0 else 1), -i * (2 if j == 0 else 1)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole, r, c = tile_array(key, table, tile)
        known = ~np.isnan(whole[r, c])
        r, c = r[known], c[known]
        here, dx, dy = whole[r, c], np.zeros(len(r)), np.zeros(len(r))
        for i, j, a, b in steps:
            d = np.nan_to_num(whole[r + i, c + j] - here, nan=0.0)
            dx += a * d
            dy += b * d
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy) / (8 * res)))
        return pa.table({"row": r - 1 + key[0].as_py() * tile, "col": c - 1 + key[1].as_py() * tile, "slope": slope})

    found = tiled(grid, z, tile).groupBy("ty", "tx").applyInArrow(run, "row long, col long, slope double")
    return found.select(*[F.col(c).cast(grid.schema[c].dataType).alias(c) for c in ("row", "col")], "slope")


def drainage(grid: DataFrame, z: str, cols: int, res: float = 1.0) -> DataFrame:
    """node, next (NULL at an end), z of each cell; node is row * cols + col."""
    found = steepest_neighbour(grid, z, res)
    return found.select(
        (F.col("row").cast("long") * cols + F.col("col")).alias("node"), (F.col("nrow").cast("long") * cols + F.col("ncol")).alias("next"), "z"
    )


def contributing_cells(graph: DataFrame, materialize: Callable[[DataFrame], DataFrame], most: int = 64) -> DataFrame:
    """node, cells: how many nodes drain through each of graph(node, next), itself included, by doubling the reach.

    After k passes a node knows those up to 2^k - 1 steps above it and the node 2^k below, so the passes grow with the
    logarithm of the longest path. Depressions are not filled: what drains into a pit ends there.
    """
    state = materialize(graph.select("node", "next", F.lit(1).cast("long").alias("cells")))
    for _ in range(most):
        above = state.filter("next is not null").groupBy(F.col("next").alias("_below")).agg(F.sum("cells").alias("_more"))
        hop = state.select(F.col("node").alias("_at"), F.col("next").alias("_further"))
        grown = state.join(above, F.col("node") == F.col("_below"), "left").join(hop, F.col("next") == F.col("_at"), "left")
        state = materialize(grown.select("node", F.col("_further").alias("next"), (F.col("cells") + F.coalesce("_more", F.lit(0))).alias("cells")))
        if not state.filter("next is not null").limit(1).count():
            return state.select("node", "cells")
    raise ValueError(f"some nodes have no end within {most} doublings: next has a cycle")


def height_above_drainage(graph: DataFrame, streams: DataFrame, drain_to: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, hand: height of graph(node, next, z) over the stream cell it drains to, at least 0; NULL where it drains elsewhere.

    streams(node) end every path; drain_to gives node, root of a graph.
    """
    wet = streams.select(F.col("node").alias("_s")).distinct()
    marked = graph.join(wet, F.col("node") == F.col("_s"), "left")
    roots = drain_to(marked.select("node", F.when(F.col("_s").isNull(), F.col("next")).alias("next")))
    ends = marked.select(F.col("node").alias("root"), F.col("z").alias("_rz"), F.col("_s").isNotNull().alias("_wet"))
    found = roots.join(ends, "root").join(graph.select("node", "z"), "node")
    return found.select("node", F.when(F.col("_wet"), F.greatest(F.col("z") - F.col("_rz"), F.lit(0.0))).alias("hand"))


# -- zones and shapes


def zonal(grid: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """zone, n, mean, sd, min, max of the cells of zones(row, col, zone)."""
    return grid.join(zones.select("row", "col", "zone"), ["row", "col"]).groupBy("zone").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, an array of structs (x, y): by how often a ray to the east crosses it."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(1.0) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crosses)) % 2 == 1


def cells_in_shapes(cells: DataFrame, shapes: DataFrame, bucket: float) -> DataFrame:
    """cells(..., x, y) with the code of the first (by rank) of shapes(code, rank, ring) that holds the centre, else NULL.

    Shapes are dealt to the square buckets that their boxes touch; a cell meets those of its own bucket only. Of the cells only
    the places are shuffled twice; other columns may hold anything, a cell without a place is in no shape.
    """

    def touched(c: str) -> Column:
        along = F.col(f"ring.{c}")
        return F.sequence(F.floor(F.array_min(along) / bucket), F.floor(F.array_max(along) / bucket))

    dealt = shapes.withColumn("_bx", F.explode(touched("x"))).withColumn("_by", F.explode(touched("y")))
    keyed = cells.select("x", "y").distinct().withColumn("_bx", F.floor(F.col("x") / bucket)).withColumn("_by", F.floor(F.col("y") / bucket))
    hits = keyed.join(dealt, ["_bx", "_by"]).filter(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    best = hits.groupBy("x", "y").agg(F.min_by("code", F.struct("rank", "code")).alias("code"))
    return cells.join(best, ["x", "y"], "left").select(*cells.columns, "code")
