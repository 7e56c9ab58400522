"""Features of sites from whatever layers there are, dynamic maps, and parameters chosen by search."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators import geostat
from strataflow.operators.spatial import cell_of


def feature_matrix(sites: DataFrame, layers: dict[str, DataFrame | None], x0: float, y1: float, res: float, needed: list[str], x: str = "x", y: str = "y") -> tuple[DataFrame, list[str]]:
    """sites with a column for each layer(row, col, value) that there is, at the cell that holds the site, and these columns' names.

    Layers that are None are left out, but each of `needed` must be there. A site outside a layer, or on a null cell, has NULL.
    The sites go through one shuffle, each layer through its own: all are joined on (row, col). Repeated cells of a layer count
    as their mean.
    """
    if missing := [n for n in needed if layers.get(n) is None]:
        raise ValueError(f"no layer for {', '.join(missing)}")
    row, col = cell_of(F.col(x), F.col(y), x0, y1, res)
    out, names = sites.withColumn("_row", row).withColumn("_col", col), [n for n, df in layers.items() if df is not None]
    for n in names:
        values = layers[n].groupBy(F.col("row").cast("int").alias("_row"), F.col("col").cast("int").alias("_col")).agg(F.avg("value").alias(n))
        out = out.join(values, ["_row", "_col"], "left")
    return out.drop("_row", "_col"), names


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns all have a value (NaN is none)."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def cell_means(points: DataFrame, keys: list[str], value: str, noise: str, res: float) -> DataFrame:
    """keys, px, py, value, noise, n: points of one square cell as their mean place and value; independent errors shrink with the root of n."""
    box = [F.floor(F.col("px") / res).alias("_bx"), F.floor(F.col("py") / res).alias("_by")]
    rows = points.filter(F.col(value).isNotNull())
    s = F.col(noise)
    found = rows.groupBy(*keys, *box).agg(F.avg("px").alias("px"), F.avg("py").alias("py"), F.avg(value).alias(value), (F.sqrt(F.sum(s * s)) / F.count("*")).alias(noise), F.count("*").alias("n"))
    return found.drop("_bx", "_by")


# -- dynamic maps


def bilinear_weights(fine: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """row, col, crow, ccol, w: the four coarse cells (of k x k fine ones) about each fine cell's centre; beyond the outer centres the nearest."""

    def along(c: str, n: int) -> tuple[Column, Column]:
        u = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(c) + 0.5) / k - 0.5))
        low = F.least(F.floor(u), F.lit(max(n - 2, 0)))
        return low, u - low

    (r, fr), (c, fc) = along("row", rows), along("col", cols)
    corners = F.array(*[F.struct((r + i).cast("int").alias("crow"), (c + j).cast("int").alias("ccol"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    return fine.select("row", "col", F.explode(corners).alias("_c")).select("row", "col", "_c.*").filter("w > 0")


def dynamic_depth(
    monthly: DataFrame, baseline: DataFrame, window: tuple[str, str], k: int, model: tuple[float, float, float], least: int = 8,
) -> DataFrame:
    """month, row, col, depth, sigma: baseline(row, col, depth) plus each month's anomalies, kriged to coarse cells and interpolated.

    monthly has site, month, px, py (in fine cells) and depth; anomalies are from a site's mean in the window (both months of it included).
    Months with fewer than `least` sites are left out. A kriged anomaly stays within one standard deviation of the observed range of its
    month, its sigma under that deviation. Coarse cells are k x k fine ones. Nothing but one month's coarse block and stations is in a task.
    """
    inside = monthly.filter(F.col("month").between(*[F.lit(d).cast("date") for d in window]) & F.col("depth").isNotNull())
    mean = inside.groupBy("site").agg(F.avg("depth").alias("_mean"))
    anomalies = inside.join(mean, "site").withColumn("anomaly", F.col("depth") - F.col("_mean"))
    spread = F.stddev_pop("anomaly")
    about = anomalies.groupBy("month").agg(F.count_distinct("site").alias("_sites"), F.when(spread > 0, spread).otherwise(1.0).alias("_sd"), F.min("anomaly").alias("_lo"), F.max("anomaly").alias("_hi")).filter(F.col("_sites") >= least)
    known = baseline.filter(F.col("depth").isNotNull())
    rows, cols = baseline.agg((F.max("row") + 1).cast("int"), (F.max("col") + 1).cast("int")).first()
    if rows is None:
        rows = cols = 0
    nr, nc = -(-rows // k), -(-cols // k)
    coarse = about.select("month", F.explode(F.sequence(F.lit(0), F.lit(max(nr, 1) - 1))).alias("crow")).select("month", "crow", F.explode(F.sequence(F.lit(0), F.lit(max(nc, 1) - 1))).alias("ccol"))
    coarse = coarse.select("month", (F.col("crow").cast("long") * max(nc, 1) + F.col("ccol")).alias("cell"), ((F.col("ccol") + 0.5) * k).alias("x"), ((F.col("crow") + 0.5) * k).alias("y"))
    kriged = geostat.krige_groups(anomalies.select("month", "px", "py", "anomaly"), coarse, ["month"], "anomaly", model, 1, 64.0 * k).join(about, "month")
    bounded = kriged.select(
        "month", F.expr(f"cast(cell div {max(nc, 1)} as int)").alias("crow"), (F.col("cell") % max(nc, 1)).cast("int").alias("ccol"),
        F.greatest(F.col("_lo") - F.col("_sd"), F.least(F.col("_hi") + F.col("_sd"), F.col("estimate"))).alias("_a"), F.least("sd", "_sd").alias("_s"),
    )
    weights = bilinear_weights(known.select("row", "col"), k, max(nr, 1), max(nc, 1))
    fine = weights.join(bounded, ["crow", "ccol"]).groupBy("month", "row", "col").agg(F.sum(F.col("w") * F.col("_a")).alias("_a"), F.sum(F.col("w") * F.col("_s")).alias("sigma"))
    return fine.join(known.select("row", "col", "depth"), ["row", "col"]).select("month", "row", "col", (F.col("depth") + F.col("_a")).alias("depth"), "sigma")


# -- parameters by search


def candidates(df: DataFrame, grid: dict[str, list[float]], name: str = "candidate") -> DataFrame:
    """Each row of df with each combination of the grid's values: their number and columns of their own, to be keys of what follows."""
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    listed = F.array(*[F.struct(F.lit(i).alias(name), *[F.lit(float(v)).alias(k) for k, v in c.items()]) for i, c in enumerate(every)])
    return df.withColumn("_c", F.explode(listed)).select(*df.columns, "_c.*")


def best_candidate(scores: DataFrame, name: str, score: str) -> DataFrame:
    """candidate, score: that of the highest mean over the units of scores(unit, candidate, score); the lower number of equals. Nulls do not count."""
    means = scores.groupBy(name).agg(F.avg(score).alias(score)).filter(F.col(score).isNotNull())
    return means.orderBy(F.desc(score), name).limit(1)


def leave_one_out(scores: DataFrame, unit: str, name: str, score: str) -> DataFrame:
    """unit, candidate, score: for each unit, the candidate that is best for the mean of all others, and the unit's own score with it.

    The mean of the others is the sum less the unit's own; candidates that no other unit has a score for are left out.
    """
    sums = scores.groupBy(name).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    own = scores.groupBy(unit, name).agg(F.avg(score).alias(score))
    rows = own.join(sums, name)
    rest = F.col("_n") - F.col(score).isNotNull().cast("int")
    mean = (F.col("_s") - F.coalesce(F.col(score), F.lit(0.0))) / F.when(rest > 0, rest)
    ranked = rows.withColumn("_m", mean).filter("_m is not null")
    place = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(F.round("_m", 12)), name))
    return ranked.withColumn("_p", place).filter("_p = 1").select(unit, name, score)
