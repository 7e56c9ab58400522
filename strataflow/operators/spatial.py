"""Points, cells and grids: lookups, blocks, neighbours, drainage, distance-weighted fields.

Observation networks (stations) are small beside grids, but that is not taken for granted: they are joined through square
buckets as wide as the reach, so a cell meets only the stations near it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_pairs(cells: DataFrame, points: DataFrame, reach: float, cx: str = "x", cy: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """cells joined to the points within reach, with the distance d: an equi-join of buckets, no cross join."""
    ix, iy = F.floor(F.col(px) / reach), F.floor(F.col(py) / reach)
    around = F.array(*[F.struct((ix + i).alias("bx"), (iy + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = points.withColumn("_b", F.explode(around)).select("*", "_b.bx", "_b.by").drop("_b")
    own = cells.withColumn("bx", F.floor(F.col(cx) / reach)).withColumn("by", F.floor(F.col(cy) / reach))
    d = F.sqrt((F.col(cx) - F.col(px)) * (F.col(cx) - F.col(px)) + (F.col(cy) - F.col(py)) * (F.col(cy) - F.col(py)))
    return own.join(spread, ["bx", "by"]).drop("bx", "by").withColumn("d", d).filter(F.col("d") <= reach)


def cell_of(x: Column, y: Column, x0: float, y1: float, res: float) -> tuple[Column, Column]:
    """row, col of the cell that holds a point of a north-up grid."""
    return F.floor((y1 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def block_stats(grid: DataFrame, value: str, k: int) -> DataFrame:
    """Mean and population deviation of k x k blocks."""
    return grid.groupBy(F.expr(f"row div {k}").alias("brow"), F.expr(f"col div {k}").alias("bcol")).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n")
    )


def block_broadcast(grid: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Each cell with its block's population deviation."""
    w = Window.partitionBy(F.expr(f"row div {k}"), F.expr(f"col div {k}"))
    return grid.withColumn(out, F.stddev_pop(value).over(w))


#: Neighbour steps (row, col) in the order that breaks ties: N, NE, E, SE, S, SW, W, NW.
D8 = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


#: Cells along the side of a tile of a grid.
TILE = 256


def tiled(grid: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """row, col, v, ty, tx: each cell at its tile, and cells on a tile's edge at the tiles beside it too, so that a tile sees one cell around."""

    def at(c: str, step: Column | int) -> Column:
        return F.floor((F.col(c) + step) / tile).cast("int")

    beside = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct(at("row", F.floor(k / 3) - 1).alias("ty"), at("col", k % 3 - 1).alias("tx"))))
    # Most cells lie inside their tile and go there only.
    inner = (F.pmod("row", F.lit(tile)).between(1, tile - 2)) & (F.pmod("col", F.lit(tile)).between(1, tile - 2))
    own = F.array(F.struct(at("row", 0).alias("ty"), at("col", 0).alias("tx")))
    known = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    return known.select("*", F.explode(F.when(inner, own).otherwise(beside)).alias("_t")).select("row", "col", "v", "_t.ty", "_t.tx")


def tile_array(key: tuple, table: pa.Table, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile with one cell around it (NaN where there is none), and the places in it of the table's own cells."""
    r, c = (table[n].to_numpy() - k.as_py() * tile + 1 for n, k in zip(("row", "col"), key))
    whole = np.full((tile + 2, tile + 2), np.nan)
    whole[r, c] = table["v"].to_numpy(zero_copy_only=False)
    own = (r >= 1) & (r <= tile) & (c >= 1) & (c <= tile)
    return whole, r[own], c[own]


def steepest_neighbour(grid: DataFrame, z: str, res: float = 1.0, tile: int = TILE) -> DataFrame:
    """row, col, z, nrow, ncol: where each cell drains; NULL for pits and flats. Ties go to the first of D8.

    Cells are dealt to tiles with one cell around, so the grid is shuffled once and each task looks at arrays.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole, r, c = tile_array(key, table, tile)
        here = whole[r, c]
        best, to = np.zeros(len(r)), np.full(len(r), -1)
        for k, (i, j) in enumerate(D8):
            drop = (here - whole[r + i, c + j]) / ((2**0.5 if i * j else 1.0) * res)
            better = drop > best  # false for NaN
            best[better], to[better] = drop[better], k
        steps, none = np.array(D8), to < 0
        row, col = r - 1 + key[0].as_py() * tile, c - 1 + key[1].as_py() * tile
        return pa.table({
            "row": row, "col": col, "z": pa.array(here, mask=np.isnan(here)),
            "nrow": pa.array(row + steps[to, 0], mask=none), "ncol": pa.array(col + steps[to, 1], mask=none),
        })

    found = tiled(grid, z, tile).groupBy("ty", "tx").applyInArrow(run, "row long, col long, z double, nrow long, ncol long")
    kinds = {"row": grid.schema["row"].dataType, "col": grid.schema["col"].dataType}
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("row", "col")], "z", F.col("nrow").cast(kinds["row"]).alias("nrow"), F.col("ncol").cast(kinds["col"]).alias("ncol"))


def drain_to(graph: DataFrame, materialize, most: int = 64) -> DataFrame:
    """node, root: follow next(node, next) to its end by pointer doubling; each pass is written out by `materialize`."""
    state = materialize(graph.select("node", F.coalesce("next", "node").alias("next")))
    for _ in range(most):
        hop = state.select(F.col("node").alias("_n"), F.col("next").alias("_further"))
        new = materialize(state.join(hop, state["next"] == F.col("_n")).select("node", F.col("_further").alias("next"), (F.col("_further") != F.col("next")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        state = new.select("node", "next")
        if not moved:
            return state.withColumnRenamed("next", "root")
    raise ValueError(f"some nodes have no end within {most} doublings: next has a cycle")


def anchor(pairs: DataFrame, keys: list[str], residual: str, length: float, prior_sigma: float, obs_sigma: float = 0.02) -> DataFrame:
    """Distance-weighted residual and its deviation at each key of near_pairs()."""
    w = F.exp(-F.col("d") * F.col("d") / (2 * length * length))
    agg = pairs.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * F.col(residual)).alias("_wr"), F.max(w).alias("support"))
    field = F.when(F.col("_w") > 1e-9, F.col("_wr") / F.col("_w") * F.col("support")).otherwise(0.0)
    return agg.select(*keys, field.alias("anchor"), (obs_sigma * F.col("support") + prior_sigma * (1 - F.col("support"))).alias("sigma"))


def assimilate(pairs: DataFrame, keys: list[str], value: str, sigma: str, length: float, prior_sigma: float) -> DataFrame:
    """Precision- and distance-weighted field, drawn to 0 by the prior, and its deviation."""
    w = F.exp(-F.col("d") * F.col("d") / (2 * length * length)) / (F.col(sigma) * F.col(sigma))
    p0 = 1 / prior_sigma**2
    agg = pairs.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * F.col(value)).alias("_wv"))
    return agg.select(*keys, (F.col("_wv") / (F.col("_w") + p0)).alias("field"), F.sqrt(1 / (F.col("_w") + p0)).alias("sigma"))


def inverse_distance(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = 1 / ((F.col("d") + 1e-6) * (F.col("d") + 1e-6))
    return pairs.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("idw"), F.min("d").alias("d_min"))


def semivariogram(points: DataFrame, value: str, reach: float, lags: int) -> DataFrame:
    """lag, gamma, n over pairs of points (pid, px, py) within reach, of different pid; gamma is of the pairs that have both values.

    Points at one place count by their number, mean and squares about it, from which the sums over all their pairs follow.
    """
    known = points.select("pid", "px", "py", F.col(value).cast("double").alias("_v")).filter("pid is not null and px is not null and py is not null")

    def found(keys: list[str]) -> DataFrame:
        """lag, n, k, g of all pairs of rows with the same keys: their number, that of pairs with both values, and the sum of half their squares."""
        sums = known.groupBy(*keys, "px", "py").agg(F.count("*").alias("n"), F.count("_v").alias("k"), F.coalesce(F.avg("_v"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("_v") * F.count("_v"), F.lit(0.0)).alias("s"))
        other = sums.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("px").alias("x"), F.col("py").alias("y"), *[F.col(c).alias(f"_{c}") for c in "nkms"])
        pairs = near_pairs(other, sums, reach).filter(F.struct("px", "py") <= F.struct("x", "y")).filter(F.col("d") < reach)
        for c in keys:
            pairs = pairs.filter(F.col(c) == F.col(f"_{c}"))
        one = (F.col("px") == F.col("x")) & (F.col("py") == F.col("y"))
        n, k = (F.when(one, F.col(c) * (F.col(c) - 1) / 2).otherwise(F.col(c) * F.col(f"_{c}")) for c in "nk")
        apart = F.col("_k") * F.col("s") + F.col("k") * F.col("_s") + F.col("k") * F.col("_k") * (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m"))
        g = F.when(one, F.col("k") * F.col("s")).otherwise(apart) / 2
        return pairs.select(F.floor(F.col("d") / (reach / lags)).cast("int").alias("lag"), n.cast("long").alias("n"), k.cast("long").alias("k"), g.alias("g"))

    # Pairs of rows of one pid are no pairs of points.
    pids = known.groupBy("pid").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("pid")
    every = found([])
    known = known.join(pids, "pid", "left_semi")
    every = every.unionByName(found(["pid"]).select("lag", *[(-F.col(c)).alias(c) for c in "nkg"]))
    sums = every.groupBy("lag").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("g").alias("g")).filter("n > 0")
    return sums.select("lag", F.when(F.col("k") > 0, F.col("g") / F.col("k")).alias("gamma"), "n")
