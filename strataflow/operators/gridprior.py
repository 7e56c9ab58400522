"""A Matern prior on a uniform raster as an operator: products with its covariance, never the covariance itself.

On a raster the covariance depends on row and column differences alone, so a product with it is a circular convolution on a
raster of twice the size, and a circular convolution is a product of Fourier transforms. The two-dimensional transform is
dealt over tasks: rows are transformed one by one, shuffled into blocks of columns, transformed down the columns, multiplied
by the kernel's transform and brought back the same way. No task holds more than some rows, or a block of columns; the product is
exact (to rounding). Regions that do not covary are products apart, each from its own cells to its own cells.

Where cells lie anywhere, or values are given at few of them, `masked_product` sums kernels directly, tile by tile.

Only the matrix of observations x observations is ever dense, in one task for each key; a network bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.priors import matern
from strataflow.session import checkpointed, spread

#: Frequencies of a row that go together down the columns; cells of rows that go together; cells along the side of a tile;
#: observations whose footprints go together.
BAND, STRIP, TILE, BLOCK = 64, 1 << 16, 64, 256


def even_size(n: int) -> int:
    """The least number from n on that has no prime factor but 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in names)


def paired(left: DataFrame, right: DataFrame, keys: list[str]):
    """The cogroup of two tables by keys; both may come from one table, so one side gets columns of its own."""
    fresh = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.alias("l").groupBy(*[F.col(f"l.{k}") for k in keys]).cogroup(fresh.alias("r").groupBy(*[F.col(f"r.{k}") for k in keys]))


def _bands(spectrum: np.ndarray) -> list[np.ndarray]:
    return [spectrum[..., a : a + BAND] for a in range(0, spectrum.shape[-1], BAND)]


def _labelled(key: tuple, names: list[str], many: int, **columns: object) -> pa.Table:
    """A table of `many` rows that all have the key, and the columns."""
    found = {n: pa.repeat(k, many) for n, k in zip(names, key)}
    return pa.table({**found, **columns})


def kernel_bands(spark, shape: tuple[int, int], cell: tuple[float, float], sigma: float, length: float, nu: float) -> DataFrame:
    """band, spectrum: the kernel's transform on the doubled raster, a block of columns a row (as bytes of doubles, row by row)."""
    my, mx = (even_size(2 * n - 1) for n in shape)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = np.minimum(np.arange(mx), mx - np.arange(mx)) * cell[1]
        for batch in batches:
            for row in batch.column("id").to_pylist():
                kernel = sigma**2 * matern(np.hypot(min(row, my - row) * cell[0], across), length, nu)
                bands = _bands(np.fft.rfft(kernel).real)
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(bands), pa.int32()), "band": pa.array(range(len(bands)), pa.int32()), "part": [b.tobytes() for b in bands]})

    def down(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["row"].to_numpy())
        whole = np.stack([np.frombuffer(b) for b in table["part"].to_pylist()])[order]
        return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "spectrum": [np.fft.fft(whole, axis=0).real.tobytes()]})

    parts = spark.range(my).mapInArrow(rows, "row int, band int, part binary")
    return parts.groupBy("band").applyInArrow(down, "band int, spectrum binary")


def grid_product(fields: DataFrame, keys: list[str], shape: tuple[int, int], cell: tuple[float, float], sigma: float, length: float, nu: float = 1.5) -> DataFrame:
    """keys, row, col, value: the covariance times each key's field(keys, row, col, value), at every cell of the raster.

    A cell that a field does not name, or a null value, counts as 0; a cell named twice as the sum. A cell outside the raster ends
    the query. cell is the height and width of a cell, in the unit of length.
    """
    ny, nx = shape
    my, mx = (even_size(2 * n - 1) for n in shape)
    kinds, names = _kinds(fields, keys), keys

    strip = max(1, STRIP // mx)  # rows that go together

    def across(key: tuple, table: pa.Table) -> pa.Table:
        rows, cols, values = table["row"].to_numpy(), table["col"].to_numpy(), table["value"].to_numpy()
        if len(rows) and not (0 <= rows.min() and rows.max() < ny and 0 <= cols.min() and cols.max() < nx):
            raise ValueError(f"rows {rows.min()} to {rows.max()}, columns {cols.min()} to {cols.max()} are not all in a raster of {ny} x {nx}")
        there, at = np.unique(rows, return_inverse=True)
        lines = np.zeros((len(there), mx))
        np.add.at(lines, (at, cols), values)
        bands = _bands(np.fft.rfft(lines, axis=1))
        return _labelled(key, [*names, "strip"], len(bands), band=pa.array(range(len(bands)), pa.int32()), rows=pa.array([there.tolist()] * len(bands), pa.list_(pa.int32())), part=[b.tobytes() for b in bands])

    def down(key: tuple, table: pa.Table, kernel: pa.Table) -> pa.Table:
        spectrum = np.frombuffer(kernel["spectrum"][0].as_py()).reshape(my, -1)
        whole = np.zeros((my, spectrum.shape[1]), complex)
        for rows, part in zip(table["rows"].to_pylist(), table["part"].to_pylist()):
            whole[rows] = np.frombuffer(part, complex).reshape(len(rows), -1)
        back = np.fft.ifft(np.fft.fft(whole, axis=0) * spectrum, axis=0)[:ny]
        parts = [back[a : a + strip].tobytes() for a in range(0, ny, strip)]
        return _labelled(key, [*names, "band"], len(parts), strip=pa.array(range(len(parts)), pa.int32()), part=parts)

    def home(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * strip
        many = min(strip, ny - first)
        parts = table["part"].to_pylist()
        order = np.argsort(table["band"].to_numpy())
        lines = np.fft.irfft(np.concatenate([np.frombuffer(parts[i], complex).reshape(many, -1) for i in order], axis=1), mx, axis=1)[:, :nx]
        row, col = np.indices(lines.shape, np.int32)
        return _labelled(key[:-1], names, lines.size, row=(row + first).ravel(), col=col.ravel(), value=lines.ravel())

    known = fields.filter(F.col("value").isNotNull()).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    strips = known.withColumn("strip", F.floor(F.col("row") / strip).cast("int")).groupBy(*keys, "strip").applyInArrow(across, kinds + "strip int, band int, rows array<int>, part binary")
    kernel = kernel_bands(fields.sparkSession, shape, cell, sigma, length, nu)
    asked = strips.select(*keys, "band").distinct().join(kernel, "band")
    turned = paired(strips, asked, [*keys, "band"]).applyInArrow(down, kinds + "band int, strip int, part binary")
    return turned.groupBy(*keys, "strip").applyInArrow(home, kinds + "row int, col int, value double")


def _scaled(cells: DataFrame, scale: str | None) -> Column:
    return F.col(scale).cast("double") if scale else F.lit(1.0)


def prior_product(
    fields: DataFrame, cells: DataFrame, keys: list[str], shape: tuple[int, int], cell: tuple[float, float],
    sigma: float, length: float, nu: float = 1.5, region: str | None = None, scale: str | None = None,
) -> DataFrame:
    """keys, row, col, value: the prior covariance times each key's field, at the cells(row, col) that there are.

    region is a column of cells: cells of different regions (a null one is a region too) do not covary. scale is a column of cells
    that multiplies their prior deviation. Values of cells that there are not count as 0.
    """
    about = cells.select("row", "col", _scaled(cells, scale).alias("_scale"), *([F.coalesce(F.col(region).cast("string"), F.lit("")).alias("_region")] if region else []))
    given = fields.select(*keys, "row", "col", "value").join(about, ["row", "col"]).withColumn("value", F.col("value") * F.col("_scale"))
    apart = [*keys, "_region"] if region else keys
    product = grid_product(given.select(*apart, "row", "col", "value"), apart, shape, cell, sigma, length, nu)
    return product.join(about, ["row", "col", "_region"] if region else ["row", "col"]).select(*keys, "row", "col", (F.col("value") * F.col("_scale")).alias("value"))


def observed_covariance(footprints: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, obs, other, value: the prior covariance of what two observations see. footprints(keys, obs, row, col, w); columns are their products."""
    seen = footprints.select(*keys, F.col("obs").alias("other"), "row", "col", "w")
    return columns.join(seen, [*keys, "row", "col"]).groupBy(*keys, "obs", "other").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _entries(footprints: DataFrame, cells: DataFrame, region: str | None, scale: str | None) -> DataFrame:
    """footprints with v, their weight times the cell's scale (0 where there is no such cell), and _region, the cell's region."""
    about = cells.select("row", "col", _scaled(cells, scale).alias("_scale"), (F.coalesce(F.col(region).cast("string"), F.lit("")) if region else F.lit("")).alias("_region"))
    joined = footprints.join(about, ["row", "col"], "left")
    return joined.withColumn("v", F.coalesce(F.col("w") * F.col("_scale"), F.lit(0.0))).drop("_scale")


def _codes(table: pa.Table) -> np.ndarray:
    return np.unique(np.array(table["_region"].to_pylist(), object).astype(str), return_inverse=True)[1] if len(table) else np.zeros(0, int)


def footprint_covariance(
    footprints: DataFrame, cells: DataFrame, keys: list[str], cell: tuple[float, float],
    sigma: float, length: float, nu: float = 1.5, region: str | None = None, scale: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """keys, obs, other, value: observed_covariance() of each pair obs <= other that shares a region, without the products on the raster.

    footprints(keys, obs, row, col, w): kernels are summed between the entries of two observations, in pairs of blocks of `block`
    observations. What is shuffled is of the footprints' size times the number of blocks, whatever the raster's size.
    """
    feet = _entries(footprints.select(*keys, "obs", "row", "col", F.col("w").cast("double").alias("w")), cells, region, scale).filter(F.col("_region").isNotNull())
    many = max(1, -(-(feet.groupBy(*keys).agg(F.count_distinct("obs").alias("n")).agg(F.max("n")).first()[0] or 0) // block))
    own = F.pmod(F.xxhash64("obs"), F.lit(many)).cast("int")
    dealt = feet.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    dealt = dealt.select(*keys, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", "obs", "row", "col", "v", "_region")
    kind = feet.schema["obs"].dataType.simpleString()

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[-2].as_py(), key[-1].as_py()
        names, obs = np.unique(table["obs"].to_numpy(), return_inverse=True)
        own, zone = table["_own"].to_numpy(), _codes(table)
        y, x, v = table["row"].to_numpy() * cell[0], table["col"].to_numpy() * cell[1], table["v"].to_numpy()
        found, shared = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), bool)
        for z in np.unique(zone):
            a, b = (np.flatnonzero((zone == z) & (own == k)) for k in (lo, hi))
            if not len(a) or not len(b):
                continue
            b = b[np.argsort(obs[b], kind="stable")]
            there, starts = np.unique(obs[b], return_index=True)
            shared[np.ix_(np.unique(obs[a]), there)] = True
            step = max(1, (1 << 20) // len(b))
            for i in range(0, len(a), step):
                some = a[i : i + step]
                kernel = sigma**2 * matern(np.hypot(y[some, None] - y[b], x[some, None] - x[b]), length, nu) * v[b]
                np.add.at(found, (obs[some][:, None], there), v[some, None] * np.add.reduceat(kernel, starts, axis=1))
        i, j = np.nonzero(np.triu(shared) if lo == hi else shared)
        return _labelled(key[:-2], keys, len(i), obs=pa.array(names[i], table["obs"].type), other=pa.array(names[j], table["obs"].type), value=found[i, j])

    out = spread(dealt, *keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi").applyInArrow(pairs, _kinds(feet, keys) + f"obs {kind}, other {kind}, value double")
    return out.select(*keys, F.least("obs", "other").alias("obs"), F.greatest("obs", "other").alias("other"), "value")


def grid_resolution(
    cells: DataFrame, footprints: DataFrame, keys: list[str], shape: tuple[int, int], cell: tuple[float, float],
    sigma: float, length: float, nu: float = 1.5, region: str | None = None, scale: str | None = None, tile: int = TILE,
) -> DataFrame:
    """keys, row, col, resolved, width: the share of each cell's prior variance that a key's observations remove, and how wide they smear it.

    footprints(keys, obs, row, col, w, noise): an observation is the sum of w times its cells' values, with the noise variance.
    The width is the root mean square distance of the averaging kernel's absolute weights (null where there are none). Cells
    that no observation reaches have resolved 0. Each key's observations are one dense matrix; cells come in tiles, which sum the
    kernels of the footprints themselves, so nothing is kept for an observation and a cell.
    """
    feet = checkpointed(footprints.select(*keys, "obs", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("w").cast("double").alias("w"), F.col("noise").cast("double").alias("noise")))
    names, one = keys or ["_all"], F.lit(0).alias("_all")
    entries = _entries(feet, cells, region, scale).select("*", *([] if keys else [one]))
    obs_kind = feet.schema["obs"].dataType.simpleString()

    def inverse(key: tuple, pairs: pa.Table, noise: pa.Table) -> pa.Table:
        obs = np.sort(noise["obs"].to_numpy())
        c = np.zeros((len(obs), len(obs)))
        i, j = (np.searchsorted(obs, pairs[n].to_numpy()) for n in ("obs", "other"))
        c[i, j] = c[j, i] = pairs["value"].to_numpy()
        by_obs = dict(zip(noise["obs"].to_pylist(), noise["noise"].to_pylist()))
        whole = np.linalg.inv(c + np.diag([by_obs[o] for o in obs.tolist()]))
        return _labelled(key, names, 1, all_obs=pa.array([obs.tolist()], pa.list_(noise["obs"].type)), inverse=[whole.tobytes()])

    noise = entries.groupBy(*names, "obs").agg(F.max("noise").alias("noise"))
    pairs = footprint_covariance(feet, cells, keys, cell, sigma, length, nu, region, scale).select("*", *([] if keys else [one]))
    kinds = _kinds(entries, names)
    solved = checkpointed(paired(pairs, noise, names).applyInArrow(inverse, kinds + f"all_obs array<{obs_kind}>, inverse binary"))
    seen = F.collect_list(F.struct("obs", "row", "col", "w", "v", F.coalesce("_region", F.lit("")).alias("_region")))  # a network's footprints
    about = solved.join(entries.groupBy(*names).agg(seen.alias("feet")), names)

    mark = F.coalesce(F.col(region).cast("string"), F.lit("")) if region else F.lit("")
    here = cells.select("row", "col", _scaled(cells, scale).alias("_scale"), mark.alias("_region"), F.floor(F.col("row") / tile).cast("int").alias("_ty"), F.floor(F.col("col") / tile).cast("int").alias("_tx"))
    asked = here.select("_ty", "_tx").distinct().crossJoin(about)
    variance = sigma**2

    def smear(key: tuple, here: pa.Table, about: pa.Table) -> pa.Table:
        row, col = (here[n].to_numpy().astype(np.int64) for n in ("row", "col"))
        scale, zone = here["_scale"].to_numpy(), np.array(here["_region"].to_pylist(), object).astype(str)
        found = []
        for k in range(len(about)):
            obs = np.array(about["all_obs"][k].as_py())
            whole = np.frombuffer(about["inverse"][k].as_py()).reshape(len(obs), len(obs))
            foot = pa.Table.from_struct_array(pa.chunked_array([about["feet"][k].values]))
            at = np.searchsorted(obs, foot["obs"].to_numpy())
            foot_row, foot_col, v = (foot[n].to_numpy() for n in ("row", "col", "v"))
            foot_zone = np.array(foot["_region"].to_pylist(), object).astype(str)
            spots, spot = np.unique(np.stack([foot_row, foot_col], 1), axis=0, return_inverse=True)
            g = np.zeros((len(obs), len(spots)))
            np.add.at(g, (at, spot.ravel()), foot["w"].to_numpy())
            h = np.zeros((len(row), len(obs)))
            for z in np.unique(zone):
                mine, theirs = np.flatnonzero(zone == z), np.flatnonzero((foot_zone == z) & (v != 0))
                if not len(theirs):
                    continue
                theirs = theirs[np.argsort(at[theirs], kind="stable")]
                there, starts = np.unique(at[theirs], return_index=True)
                step = max(1, (1 << 20) // len(theirs))
                for i in range(0, len(mine), step):
                    some = mine[i : i + step]
                    far = np.hypot((row[some, None] - foot_row[theirs]) * cell[0], (col[some, None] - foot_col[theirs]) * cell[1])
                    kernel = sigma**2 * matern(far, length, nu) * v[theirs]
                    h[some[:, None], there] = scale[some, None] * np.add.reduceat(kernel, starts, axis=1)
            gain = h @ whole
            total, wide = np.zeros(len(row)), np.zeros(len(row))
            step, reached = max(1, (1 << 20) // max(1, len(spots))), np.flatnonzero(gain.any(1))
            for i in range(0, len(reached), step):
                some = reached[i : i + step]
                weights = np.abs(gain[some] @ g)
                far = ((row[some, None] - spots[:, 0]) * cell[0]) ** 2 + ((col[some, None] - spots[:, 1]) * cell[1]) ** 2
                total[some], wide[some] = weights.sum(1), (weights * far).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                width = np.sqrt(wide / total)
                share = np.clip((gain * h).sum(1) / variance / (scale * scale), 0, 1)
            share[np.isnan(share)] = 0.0
            found.append(_labelled([about[n][k] for n in keys], keys, len(row), row=here["row"], col=here["col"], resolved=share, width=pa.array(width, mask=~(total > 0))))
        if not keys and not found:
            found = [pa.table({"row": here["row"], "col": here["col"], "resolved": np.zeros(len(row)), "width": pa.nulls(len(row), pa.float64())})]
        if not found:
            return pa.table({**{n: pa.array([], about[n].type) for n in keys}, "row": here["row"].slice(0, 0), "col": here["col"].slice(0, 0), "resolved": pa.array([], pa.float64()), "width": pa.array([], pa.float64())})
        return pa.concat_tables(found)

    return paired(spread(here, "_ty", "_tx"), asked, ["_ty", "_tx"]).applyInArrow(smear, _kinds(feet, keys) + _kinds(cells, ["row", "col"]) + "resolved double, width double")


# -- cells anywhere


def masked_product(
    cells: DataFrame, vectors: DataFrame, keys: list[str], sigma: float, length: float, nu: float = 1.5, region: str | None = None, tile: float | None = None, spread: int = 1
) -> DataFrame:
    """keys, cell, value: the prior covariance times each of vectors(keys, cell, w), at cells(cell, x, y) of the regions it touches.

    Cells need no raster. The covariance of two cells of different regions (a column of cells; a null is a region too) is 0, which
    is a block structure: a task holds one square tile of one region's cells and one part (of `spread`, by a hash of the keys)
    of the entries of that region's vectors. No cells x cells array is made: its columns are summed as they come. tile is
    the side of a tile, 16 lengths unless given. A cell that a vector names twice counts twice; null weights count as 0.
    """
    side = tile or 16 * length
    mark = F.coalesce(F.col(region).cast("string"), F.lit("")) if region else F.lit("")
    place = cells.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), mark.alias("_region"))
    placed = place.select("*", F.floor(F.col("x") / side).alias("_tx"), F.floor(F.col("y") / side).alias("_ty"))
    part = F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int") if keys else F.lit(0)
    entries = vectors.select(*keys, "cell", F.col("w").cast("double").alias("w")).filter("w <> 0").join(place, "cell").select(*keys, "x", "y", "w", "_region", part.alias("_part"))
    tiles = placed.select("_region", "_tx", "_ty").distinct()
    sent = entries.join(tiles, "_region")
    kinds, names = _kinds(vectors, keys), keys
    cell_kind = cells.schema["cell"].dataType.simpleString()

    def add(key: tuple, here: pa.Table, from_: pa.Table) -> pa.Table:
        xy = np.stack([here["x"].to_numpy(), here["y"].to_numpy()], 1)
        groups = from_.group_by(names, use_threads=False).aggregate([("x", "list"), ("y", "list"), ("w", "list")]) if names else None
        found = []
        for i in range(len(groups) if names else min(1, len(from_))):
            x, y, w = (np.array(groups[f"{c}_list"][i].as_py()) if names else from_[c].to_numpy() for c in "xyw")
            total = np.zeros(len(xy))
            for a in range(0, len(x), 4096):
                total += sigma**2 * matern(np.hypot(xy[:, :1] - x[None, a : a + 4096], xy[:, 1:] - y[None, a : a + 4096]), length, nu) @ w[a : a + 4096]
            found.append(pa.table({**{n: pa.array([groups[n][i].as_py()] * len(xy), groups[n].type) for n in names}, "cell": here["cell"].combine_chunks(), "value": total}))
        if found:
            return pa.concat_tables(found)
        return pa.table({**{n: pa.array([], from_[n].type) for n in names}, "cell": here["cell"].combine_chunks().slice(0, 0), "value": pa.array([], pa.float64())})

    spread_cells = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    key = ["_region", "_tx", "_ty", "_part"]
    return paired(spread_cells, sent, key).applyInArrow(add, kinds + f"cell {cell_kind}, value double")


def field_variance(sigma: float, cells: DataFrame, scale: str | None = None) -> DataFrame:
    """row, col, variance: the prior's diagonal."""
    return cells.select("row", "col", (F.lit(sigma) * _scaled(cells, scale) * F.lit(sigma) * _scaled(cells, scale)).alias("variance"))


def raster_of(cells: DataFrame, x: str = "x", y: str = "y", tolerance: float = 1e-9) -> tuple[int, int, float, float]:
    """Rows, columns, height and width of a cell of a complete uniform raster given by its centres; anything else raises ValueError.

    The raster is not guessed: a ragged, masked or repeated set of cells has another number of cells than rows x columns, an
    uneven one a step that differs from the mean one.
    """

    def steps(c: str) -> tuple[int, float, float, float]:
        from pyspark.sql import Window

        places = cells.select(F.col(c).cast("double").alias("v")).distinct()
        step = F.col("v") - F.lag("v").over(Window.orderBy("v"))  # as many rows as the raster has rows or columns
        r = places.select("v", step.alias("s")).agg(F.count("*"), F.min("s"), F.max("s"), F.max(F.abs("v"))).first()
        return r[0], r[1] or 0.0, r[2] or 0.0, r[3] or 0.0

    n, different = cells.agg(F.count("*"), F.count_distinct(F.col(x), F.col(y))).first()
    (nx, dx, dx_most, ax), (ny, dy, dy_most, ay) = steps(x), steps(y)
    if not n or n != different or n != nx * ny:
        raise ValueError(f"{n} cells ({different} different ones) are no complete raster of {ny} rows and {nx} columns")
    for low, high, size, name in ((dx, dx_most, ax, x), (dy, dy_most, ay, y)):
        if high - low > tolerance * max(size, high, 1.0) * 10 or not math.isfinite(high):
            raise ValueError(f"steps of {name} are not uniform: {low} to {high}")
    return ny, nx, dy, dx
