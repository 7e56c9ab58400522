"""Filled terrain: depressions raised to the level at which they spill, and drainage that crosses what was filled.

A tile is flooded from its own edge inwards by rising level, each cell labelled by the edge cell its flood came from. Two
labels that meet are joined at the higher of their levels, inside a tile and across its border; so all that one tile has to
know of others is the graph of labels. The level of a label is the least, over the ways out of the raster, of the highest step on
the way (a minimax path), found by relaxing the graph until nothing falls; a cell's level is the higher of its own and its
label's. The raster goes through two tasks a cell, the rounds touch labels only (one or so for each border cell).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.spatial import D8, steepest_neighbour, tile_array, tiled

TILE = 128
#: The labels of a cell without one and of what lies outside, and what a cell's row counts in its label.
UNSET, OUTSIDE, WIDE = -(1 << 63), 1 - (1 << 63), 1 << 32

_STEPS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def flood(z: np.ndarray, open_: np.ndarray, edge: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Level and label of each cell of a tile (NaN cells: none), and the least level at which each pair of labels meets.

    open_ cells drain to the outside, edge cells border on another tile; both are flooded from their own height. A label is the
    name of the edge cell it began at.
    """
    ny, nx = z.shape
    level, label = np.where(open_ | edge, z, np.nan), np.full(z.shape, UNSET)
    label[open_] = OUTSIDE
    done = np.zeros(z.shape, bool)
    meets: dict[tuple[int, int], float] = {}
    heap = [(float(z[i, j]), int(i), int(j)) for i, j in np.argwhere((open_ | edge) & ~np.isnan(z))]
    heapq.heapify(heap)
    while heap:
        at, i, j = heapq.heappop(heap)
        if done[i, j]:
            continue
        done[i, j] = True
        if label[i, j] == UNSET:
            label[i, j] = name[i, j]
        own = int(label[i, j])
        for di, dj in _STEPS:
            k, m = i + di, j + dj
            if not (0 <= k < ny and 0 <= m < nx) or np.isnan(z[k, m]):
                continue
            other = int(label[k, m])
            if other == UNSET:
                label[k, m], level[k, m] = own, max(float(z[k, m]), at)
                heapq.heappush(heap, (float(level[k, m]), k, m))
            elif other != own:
                pair, height = (min(own, other), max(own, other)), max(at, float(level[k, m]))
                if height < meets.get(pair, np.inf):
                    meets[pair] = height
    return level, label, meets


def filled(grid: DataFrame, z: str, materialize: Callable[[DataFrame], DataFrame], tile: int = TILE, most: int = 4096) -> DataFrame:
    """row, col, z, level: the height at which water leaves each cell of grid(row, col, z); z where it needs no filling.

    Water leaves over the raster's edge and over cells that are not there or have a null z, by any of eight steps. row and col may
    start anywhere. A repeated cell counts once, at its lowest.
    """
    known = grid.filter(F.col(z).isNotNull()).groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.min(F.col(z).cast("double")).alias("z"))
    sent = tiled(known, "z", tile)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        whole, _, _ = tile_array(key, table, tile)
        there = ~np.isnan(whole)
        mine = there[1:-1, 1:-1]
        around = np.ones(mine.shape, bool)
        foreign = np.zeros(mine.shape, bool)
        ring = there.copy()
        ring[1:-1, 1:-1] = False
        for di, dj in _STEPS:
            window = (slice(1 + di, tile + 1 + di), slice(1 + dj, tile + 1 + dj))
            around &= there[window]
            foreign |= ring[window]
        i, j = np.indices(mine.shape)
        name = (i + ty * tile).astype(np.int64) * WIDE + (j + tx * tile)
        level, label, meets = flood(whole[1:-1, 1:-1], mine & ~around, mine & foreign, name)
        a, b = np.nonzero(mine)
        cells = pa.table({"row": a + ty * tile, "col": b + tx * tile, "z": whole[1:-1, 1:-1][mine], "level": level[mine], "label": label[mine], "border": (foreign & mine)[mine], "other": pa.nulls(len(a), pa.int64())})
        pairs = list(meets)
        graph = pa.table({"row": pa.nulls(len(pairs), pa.int64()), "col": pa.nulls(len(pairs), pa.int64()), "z": pa.nulls(len(pairs), pa.float64()), "level": pa.array(list(meets.values()), pa.float64()),
                          "label": pa.array([p[0] for p in pairs], pa.int64()), "border": pa.nulls(len(pairs), pa.bool_()), "other": pa.array([p[1] for p in pairs], pa.int64())})
        return pa.concat_tables([cells, graph])

    flooded = materialize(sent.groupBy("ty", "tx").applyInArrow(run, "row long, col long, z double, level double, label long, border boolean, other long"))
    cells = flooded.filter(F.col("row").isNotNull())
    border = cells.filter("border").select("row", "col", "level", "label")
    ahead = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in _STEPS]))
    asks = border.select(F.col("label").alias("_a"), F.col("level").alias("_l"), ahead.alias("_n")).select("_a", "_l", "_n.row", "_n.col")
    across = asks.join(border, ["row", "col"]).select(F.col("_a").alias("a"), F.col("label").alias("b"), F.greatest("_l", "level").alias("h"))
    inside = flooded.filter(F.col("row").isNull()).select(F.col("label").alias("a"), F.col("other").alias("b"), F.col("level").alias("h"))
    graph = across.unionByName(inside).unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"), "h")).filter("a <> b")
    graph = materialize(graph.groupBy("a", "b").agg(F.min("h").alias("h")))

    spills = graph.filter(F.col("a") == OUTSIDE).select(F.col("b").alias("label"), F.col("h").alias("spill"))
    fresh = spills = materialize(spills)
    for _ in range(most):  # only labels that fell in the last round can lower others
        reached = fresh.join(graph, F.col("label") == F.col("a")).groupBy("b").agg(F.min(F.greatest("spill", "h")).alias("_new")).filter(F.col("b") != OUTSIDE)
        fresh = materialize(reached.join(spills.withColumnRenamed("spill", "_old"), F.col("b") == F.col("label"), "left").filter("_old is null or _new < _old").select(F.col("b").alias("label"), F.col("_new").alias("spill")))
        if not fresh.limit(1).count():
            break
        spills = materialize(spills.unionByName(fresh).groupBy("label").agg(F.min("spill").alias("spill")))
    else:
        raise ValueError(f"levels still fall after {most} rounds")
    return cells.join(spills, "label", "left").select("row", "col", "z", F.greatest("level", F.coalesce("spill", F.col("level"))).alias("level"))


def filled_drainage(levels: DataFrame, cols: int, materialize: Callable[[DataFrame], DataFrame], res: float = 1.0, most: int = 4096) -> DataFrame:
    """node, next (NULL where water leaves the raster), z, level of filled()'s rows; node is row * cols + col.

    Water takes the steepest way down the levels; on a flat it takes the shortest way, step by step, to a cell that drains (a tie
    goes to the first of D8). A round for each step of the longest such way; the rounds touch flat cells only.
    """
    down = steepest_neighbour(levels.select("row", "col", "level"), "level", res).withColumnRenamed("z", "level")
    many = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("row") + i).alias("nrow"), (F.col("col") + j).alias("ncol")) for k, (i, j) in enumerate(D8)])
    ends = down.filter(F.col("nrow").isNull()).select("row", "col", "level", F.explode(many).alias("_n")).select("row", "col", "level", "_n.k", "_n.nrow", "_n.ncol")
    other = down.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("level").alias("_nl"), F.col("nrow").isNotNull().alias("_drains"))
    about = ends.join(other, ["nrow", "ncol"], "left")
    inner = about.groupBy("row", "col").agg(F.count("_nl").alias("_there")).filter("_there = 8").select("row", "col")
    # Flat cells and their flat neighbours; `settled` are the cells that drain.
    flat = materialize(about.join(inner, ["row", "col"], "left_semi").filter("_nl = level").select("row", "col", "k", "nrow", "ncol"))
    waiting = flat.select("row", "col").distinct()
    settled = flat.select("nrow", "ncol").distinct().join(waiting.select(F.col("row").alias("nrow"), F.col("col").alias("ncol")), ["nrow", "ncol"], "left_anti")
    fresh, found = materialize(settled), None
    for _ in range(most):
        best = flat.join(fresh, ["nrow", "ncol"]).groupBy("row", "col").agg(F.min(F.struct("k", "nrow", "ncol")).alias("_b")).select("row", "col", "_b.nrow", "_b.ncol")
        taken = materialize(best if found is None else best.join(found.select("row", "col"), ["row", "col"], "left_anti"))
        if not taken.limit(1).count():
            break
        found = taken if found is None else materialize(found.unionByName(taken))
        fresh = taken.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    else:
        raise ValueError(f"a flat is wider than {most} steps")
    way = down if found is None else down.join(found.select("row", "col", F.col("nrow").alias("_r"), F.col("ncol").alias("_c")), ["row", "col"], "left").withColumns({"nrow": F.coalesce("nrow", "_r"), "ncol": F.coalesce("ncol", "_c")})
    return way.join(levels.select("row", "col", "z"), ["row", "col"]).select(
        (F.col("row") * cols + F.col("col")).alias("node"), (F.col("nrow") * cols + F.col("ncol")).alias("next"), "z", "level"
    )
