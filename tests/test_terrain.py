"""Filled terrain against one heap over the whole raster."""

import heapq
from functools import partial

import numpy as np
import pytest

from strataflow.operators import grid, spatial, terrain
from strataflow.session import checkpointed

STEPS = terrain._STEPS


def by_heap(z):
    """Priority flood of cells {(row, col): z} from all cells with a missing neighbour."""
    level = {c: z[c] for c in z if any((c[0] + i, c[1] + j) not in z for i, j in STEPS)}
    heap = [(v, c) for c, v in level.items()]
    heapq.heapify(heap)
    while heap:
        at, (r, c) = heapq.heappop(heap)
        for i, j in STEPS:
            n = (r + i, c + j)
            if n in z and n not in level:
                level[n] = max(z[n], at)
                heapq.heappush(heap, (level[n], n))
    return level


def drained(level):
    """next of each cell: steepest on the levels, the shortest way over flats, ties to the first of D8."""
    out, flat = {}, []
    for (r, c), v in level.items():
        best, steep, near = None, 0.0, 0
        for i, j in spatial.D8:
            n = (r + i, c + j)
            if n in level:
                near += 1
                drop = (v - level[n]) / (2**0.5 if i * j else 1.0)
                if drop > steep:
                    best, steep = n, drop
        out[r, c] = best
        if best is None and near == 8:
            flat.append((r, c))
    waiting = set(flat)
    while waiting:
        taken = {}
        for r, c in waiting:
            for i, j in spatial.D8:
                n = (r + i, c + j)
                if level[n] == level[r, c] and n not in waiting:
                    taken[r, c] = n
                    break
        assert taken
        out |= taken
        waiting -= set(taken)
    return out


def surface(seed, ny=37, nx=29):
    rng = np.random.default_rng(seed)
    z = np.round(rng.random((ny, nx)) * 20 + 3 * np.sin(np.arange(ny) / 4)[:, None] + 3 * np.cos(np.arange(nx) / 5)[None, :])
    if seed == 1:  # nested bowls and a hole in the raster
        i, j = np.indices((ny, nx))
        z = np.round(np.hypot(i - 18, j - 14)) % 7 + 2 * (np.hypot(i - 18, j - 14) > 9)
    cells = {(int(r) - 5, int(c) + 3): float(z[r, c]) for r in range(ny) for c in range(nx)}
    if seed != 2:
        for r in range(9, 12):
            cells.pop((r, 12), None)
    return cells


def frame(spark, cells):
    rows = [(r, c, v, "x") for (r, c), v in cells.items()]
    return spark.createDataFrame([*rows, (400, 400, None, "y"), rows[0]], "row int, col int, h double, level string")


@pytest.mark.parametrize("seed,tile", [(0, 8), (1, 8), (2, 16), (3, 64)])
def test_levels(spark, seed, tile):
    cells = surface(seed)
    got = terrain.filled(frame(spark, cells), "h", checkpointed, tile=tile).collect()
    assert {(r["row"], r["col"]): r["level"] for r in got} == by_heap(cells) and len(got) == len(cells)


@pytest.mark.parametrize("seed", [0, 1])
def test_area_and_height(spark, seed):
    cells = {(r + 5, c): v for (r, c), v in surface(seed).items()}
    levels = checkpointed(terrain.filled(frame(spark, cells), "h", checkpointed, tile=8))
    graph = checkpointed(terrain.filled_drainage(levels, 1000, checkpointed))
    node = lambda c: c[0] * 1000 + c[1]
    want = drained(by_heap(cells))
    assert {r["node"]: r["next"] for r in graph.collect()} == {node(c): n and node(n) for c, n in want.items()}
    area = dict.fromkeys(want, 0)
    streams = {c for c in cells if node(c) % 11 == 0}
    height = {}
    for c in want:
        at = c
        while at is not None:
            area[at] += 1
            at = want[at]
        at = c
        while at not in streams and want[at] is not None:
            at = want[at]
        height[node(c)] = max(cells[c] - cells[at], 0.0) if at in streams else None
    got = grid.contributing_cells(graph, checkpointed)
    assert {r["node"]: r["cells"] for r in got.collect()} == {node(c): n for c, n in area.items()}
    wet = spark.createDataFrame([(node(c),) for c in streams], "node long")
    hand = grid.height_above_drainage(graph, wet, partial(spatial.drain_to, materialize=checkpointed))
    assert {r["node"]: r["hand"] for r in hand.collect()} == height


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "row int, col int, h double")
    assert terrain.filled(empty, "h", checkpointed).count() == 0
    one = terrain.filled(spark.createDataFrame([(7, -3, 2.5)], empty.schema), "h", checkpointed).collect()
    assert [tuple(r) for r in one] == [(7, -3, 2.5, 2.5)]


@pytest.mark.parametrize("tile", [7, 256])
def test_neighbours_over_tile_edges(spark, tile):
    cells = surface(0)
    df = frame(spark, cells)
    got = {(r["row"], r["col"]): r for r in spatial.steepest_neighbour(df, "h", 2.0, tile).filter("z is not null").collect()}
    slopes = {(r["row"], r["col"]): r["slope"] for r in grid.slope_degrees(df, "h", 2.0, tile).collect()}
    assert got.keys() == cells.keys() == slopes.keys()
    for (r, c), z in cells.items():
        best, steep, dx, dy = None, 0.0, 0.0, 0.0
        for i, j in spatial.D8:
            n = (r + i, c + j)
            if n in cells:
                drop = (z - cells[n]) / ((2**0.5 if i * j else 1.0) * 2.0)
                if drop > steep:
                    best, steep = n, drop
                dx += j * (2 if i == 0 else 1) * (cells[n] - z)
                dy -= i * (2 if j == 0 else 1) * (cells[n] - z)
        row = got[r, c]
        assert (None if best is None else best) == (None if row["nrow"] is None else (row["nrow"], row["ncol"]))
        assert slopes[r, c] == pytest.approx(np.degrees(np.arctan(np.hypot(dx, dy) / 16)), abs=1e-9)
