"""Ordered folds with carried state: a series is sorted into an array per key and folded by a JVM-side aggregate.

One key's series must fit in memory; simulations have a bounded number of steps. Every step function maps (state, step)
to (state, output); outputs are collected in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.core import clip

Step = Callable[[Column, Column], tuple[dict[str, Column], Column]]


def ordered_fold(df: DataFrame, keys: list[str], order: str, inputs: list[str], state: dict[str, Column], step: Step, out: str) -> DataFrame:
    """keys, order, out: the output of each step of each key's series."""
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *inputs))).alias("_series"))
    start = F.struct(*[v.cast("double").alias(k) for k, v in state.items()], F.array().cast("array<double>").alias("_out"))

    def fold(acc: Column, x: Column) -> Column:
        new, result = step(acc, x)
        return F.struct(*[new[k].cast("double").alias(k) for k in state], F.array_append(acc["_out"], result.cast("double")).alias("_out"))

    done = series.select(*keys, "_series", F.aggregate("_series", start, fold, lambda acc: acc["_out"]).alias("_results"))
    zipped = F.arrays_zip(F.transform("_series", lambda x: x[order]).alias(order), F.col("_results").alias(out))
    return done.select(*keys, F.inline(zipped).alias(order, out))


def ordered_folds(df: DataFrame, keys: list[str], order: str, inputs: list[str], given: dict[str, str | float | Column], state: dict[str, Column], step, outputs: list[str]) -> DataFrame:
    """keys, order, outputs: what step(state, row, given) -> (state, {output: value}) gives for each step of each key's series.

    given are numbers, or columns of df that hold one value a key (any is taken if they differ, a null one wins over none);
    state may refer to them by name as columns.
    """
    constant = {k: v for k, v in given.items() if isinstance(v, str)}
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *inputs))).alias("_series"), *[F.first(v, ignorenulls=True).cast("double").alias(f"_g_{k}") for k, v in constant.items()])
    known = {k: F.col(f"_g_{k}") if k in constant else v if isinstance(v, Column) else F.lit(float(v)) for k, v in given.items()}
    empty = F.array().cast("array<struct<" + ",".join(f"{o}:double" for o in outputs) + ">>")
    start = F.struct(*[(v(known) if callable(v) and not isinstance(v, Column) else v).cast("double").alias(k) for k, v in state.items()], empty.alias("_out"))

    def fold(acc: Column, x: Column) -> Column:
        new, values = step(acc, x, known)
        row = F.struct(*[values[o].cast("double").alias(o) for o in outputs])
        return F.struct(*[new[k].cast("double").alias(k) for k in state], F.array_append(acc["_out"], row).alias("_out"))

    done = series.select(*keys, "_series", F.aggregate("_series", start, fold, lambda acc: acc["_out"]).alias("_r"))
    zipped = F.zip_with("_series", "_r", lambda a, b: F.struct(a[order].alias(order), *[b[o].alias(o) for o in outputs]))
    return done.select(*keys, F.inline(zipped).alias(order, *outputs))


def total_bucket(df: DataFrame, keys: list[str], order: str, precip: str, pet: str, wp: float, fc: float, sat: float, root_m: float = 1.0, drain: float = 0.6) -> DataFrame:
    """theta of a one-layer bucket that starts at field capacity."""
    z = 1000 * root_m

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        s = acc["s"] + x[precip]
        s = s - F.least(x[pet], F.greatest(s - wp * z, F.lit(0.0)))
        s = s - drain * F.greatest(s - fc * z, F.lit(0.0))
        s = clip(s, wp * z, sat * z)
        return {"s": s}, s / z

    return ordered_fold(df, keys, order, [precip, pet], {"s": F.lit(fc * z)}, step, "theta")


def snow_pack(df: DataFrame, keys: list[str], order: str, precip: str, temp: str, days: float, ddf: float = 3.0, hi: float = 3.0, lo: float = -1.0, melt_t: float = 0.0, start: str | float = 0.0) -> DataFrame:
    """keys, order, liquid, swe: liquid input after snow storage and degree-day melt, and the store left after each step.

    start is the store before the first step, a number or a column; the last swe continues a run that was cut.
    """

    def step(acc: Column, x: Column, _: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
        frozen = clip((hi - x[temp]) / max(hi - lo, 0.1), 0.0, 1.0)
        swe = acc["swe"] + frozen * x[precip]
        melt = F.least(swe, ddf * F.greatest(x[temp] - melt_t, F.lit(0.0)) * days)
        return {"swe": swe - melt}, {"liquid": (1 - frozen) * x[precip] + melt, "swe": swe - melt}

    return ordered_folds(df, keys, order, [precip, temp], {"start": start}, {"swe": lambda g: F.coalesce(g["start"], F.lit(0.0))}, step, ["liquid", "swe"])


def snow_liquid(df: DataFrame, keys: list[str], order: str, precip: str, temp: str, days: float, ddf: float = 3.0, hi: float = 3.0, lo: float = -1.0, melt_t: float = 0.0) -> DataFrame:
    """Liquid input after snow storage and degree-day melt, from an empty store."""
    return snow_pack(df, keys, order, precip, temp, days, ddf, hi, lo, melt_t).drop("swe")


def thornthwaite_mather(df: DataFrame, keys: list[str], order: str, precip: str, pet: str, awc: float, init: float = 0.5) -> DataFrame:
    """Relative wetness of a bucket with accumulated potential water loss. The loss starts at the first step's deficit."""
    cap = max(1.0, awc)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        p, e = x[precip], x[pet]
        loss0 = F.when(acc["first"] > 0, F.greatest(e - p, F.lit(0.0))).otherwise(acc["apwl"])
        wet = p >= e
        filled = F.least(acc["s"] + p - e, F.lit(cap))
        wet_loss = F.when(filled >= cap, 0.0).otherwise(-cap * F.ln(clip(filled / cap, 1e-6, 1.0)))
        dry_loss = loss0 + (e - p)
        s = F.when(wet, filled).otherwise(cap * F.exp(-dry_loss / cap))
        return {"s": s, "apwl": F.when(wet, wet_loss).otherwise(dry_loss), "first": F.lit(0.0)}, clip(s / cap, 0.0, 1.0)

    return ordered_fold(df, keys, order, [precip, pet], {"s": F.lit(init * cap), "apwl": F.lit(0.0), "first": F.lit(1.0)}, step, "wetness")


def baseflow(df: DataFrame, keys: list[str], order: str, flow: str, alpha: float = 0.925, passes: int = 3) -> DataFrame:
    """Baseflow by the recursive digital filter of Lyne and Hollick, forward and backward in turn, held in [0, flow]."""
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, flow))).alias("_series"))
    series = series.withColumn("_q", F.transform("_series", lambda x: x[flow].cast("double"))).withColumn("_b", F.col("_q"))
    for k in range(passes):
        turn = (lambda c: F.reverse(c)) if k % 2 else (lambda c: c)
        pairs = F.arrays_zip(turn(F.col("_b")).alias("c"), turn(F.col("_q")).alias("q"))
        empty = F.array().cast("array<double>")
        first = F.struct(F.lit(0.0).alias("f"), F.lit(None).cast("double").alias("prev"), empty.alias("out"))

        def fold(acc: Column, x: Column) -> Column:
            f = F.when(acc["prev"].isNull(), 0.0).otherwise(alpha * acc["f"] + (1 + alpha) / 2 * (x["c"] - acc["prev"]))
            b = clip(x["c"] - F.greatest(f, F.lit(0.0)), F.lit(0.0), x["q"])
            return F.struct(f.alias("f"), x["c"].alias("prev"), F.array_append(acc["out"], b).alias("out"))

        series = series.withColumn("_p", pairs).withColumn("_b", turn(F.aggregate("_p", first, fold, lambda acc: acc["out"]))).drop("_p")
    zipped = F.arrays_zip(F.transform("_series", lambda x: x[order]).alias(order), F.col("_q").alias(flow), F.col("_b").alias("baseflow"))
    return series.select(*keys, F.inline(zipped).alias(order, flow, "baseflow"))


#: Days of a mean month.
MONTH_DAYS = 30.4375


def coupled_budget(
    df: DataFrame, keys: list[str], order: str, liquid: str, pet: str, wp: float | str, fc: float | str, sat: float | str, wt0: float | str,
    root_m: float = 1.0, sy: float = 0.30, recession: float = 6.0, cap_max: float = 30.0, fringe: float = 1.0, drain: float = 0.6,
    days: float | None = None, drain_days: float = 2.0, slope: str | float | None = None, aniso: float = 20.0, hand: str | float | None = None,
    recharge_a_day: float = 1.0, area_runoff: bool = True, full: bool = True,
) -> DataFrame:
    """keys, order, runoff, recharge, interflow, aet, cap_rise, baseflow, theta, wt_depth: soil store and water table.

    Fluxes in order: capillary rise from the table before, saturation runoff, evaporation, drainage (what a slope lets go
    sideways is interflow, the rest recharges), recharge, recession. wp, fc, sat, wt0, slope (a tangent) and hand (height
    above the drainage) are numbers or columns with one value a key. Steps are months, or of `days`: then the monthly rates are
    scaled and drainage follows an e-folding time. Without hand the table falls back to wt0; with it, it drains what stands above
    the river, at the rate that carries recharge_a_day (mm) at wt0. The store starts at field capacity, or with full=False at wp.
    """
    z, zero = 1000 * root_m, F.lit(0.0)
    share = 1.0 if days is None else days / MONTH_DAYS
    back = min(share / max(recession, 1e-6), 1.0)
    leaves = min(max(drain, 0.0), 1.0) if days is None else 1 - math.exp(-days / max(drain_days, 1e-6))
    outputs = ["runoff", "recharge", "interflow", "aet", "cap_rise", "baseflow", "theta", "wt_depth"]
    given = {"wp": wp, "fc": fc, "sat": sat, "wt0": wt0} | ({} if slope is None else {"slope": slope}) | ({} if hand is None else {"hand": hand})

    def step(acc: Column, x: Column, g: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
        low, high, field = g["wp"] * z, g["sat"] * z, g["fc"] * z
        s, h, p, e = acc["s"], acc["h"], x[liquid].cast("double"), x[pet].cast("double")
        depth = g["wt0"] - h
        reach = clip((root_m + fringe - depth) / max(root_m + fringe, 1e-6), 0.0, 1.0)
        rise = F.least(s + cap_max * share * reach * clip((high - s) / F.greatest(high - low, F.lit(1e-6)), 0.0, 1.0), high) - s
        s1 = s + rise
        direct = F.greatest(p - 1000 * F.greatest(sy * depth, zero), zero) if area_runoff else zero
        s2 = s1 + p - direct
        over = F.greatest(s2 - high, zero)
        s3 = s2 - over
        aet = F.least(e, F.greatest(s3 - low, zero))
        s4 = s3 - aet
        gone = F.greatest(s4 - field, zero) * leaves
        aside = gone * (1 - 1 / (1 + aniso * F.abs(g["slope"]))) if slope is not None else zero
        s5 = clip(s4 - gone, low, high)
        h1 = h + (gone - aside) / 1000 / max(sy, 1e-6)
        if hand is None:
            drop = h1 * back
        else:
            above = F.greatest(g["hand"], zero)
            head = F.greatest(above - g["wt0"], zero)
            rate = F.when(head > 1e-3, clip(recharge_a_day * (days or MONTH_DAYS) / 1000 / max(sy, 1e-6) / head, 0.0, 1.0)).otherwise(0.0)
            drop = F.greatest(above - (g["wt0"] - h1), zero) * rate
        values = (direct + over, gone - aside, aside, aet, rise, F.greatest(drop, zero) * sy * 1000, s5 / z, g["wt0"] - (h1 - drop))
        return {"s": s5, "h": h1 - drop}, dict(zip(outputs, values))

    return ordered_folds(df, keys, order, [liquid, pet], given, {"s": lambda g: g["fc" if full else "wp"] * z, "h": zero}, step, outputs)


def retention(x: Column, alpha: float, n: float) -> Column:
    """Suction of a saturation on a van Genuchten curve."""
    m = 1 - 1 / n
    return (1 / alpha) * F.pow(F.pow(clip(x, 1e-3, 1 - 1e-6), F.lit(-1 / m)) - 1, F.lit(1 / n))


def hysteretic_suction(df: DataFrame, keys: list[str], order: str, se: str, alpha_d: float, n: float, ratio: float = 2.0, start: str = "drying") -> DataFrame:
    """Suction along a path of saturations between the drying and the wetting curve, turning at reversals.

    The first saturation lies on the curve that start names, drying or wetting.
    """
    if start not in ("drying", "wetting"):
        raise ValueError(f"start must be drying or wetting, not {start!r}")
    way, alpha0 = (-1.0, alpha_d) if start == "drying" else (1.0, ratio * alpha_d)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        now = clip(x[se], 1e-3, 1 - 1e-6)
        first = acc["prev"] < 0
        turn = F.when(first, F.lit(way)).when(now > acc["prev"] + 1e-12, 1.0).when(now < acc["prev"] - 1e-12, -1.0).otherwise(acc["dir"])
        reverse = ~first & (turn != acc["dir"])
        ser = F.when(first, now).when(reverse, acc["prev"]).otherwise(acc["ser"])
        hr = F.when(first, retention(now, alpha0, n)).when(reverse, acc["h"]).otherwise(acc["hr"])
        dry, wet = retention(ser, alpha_d, n), retention(ser, ratio * alpha_d, n)
        anchor = clip((hr - wet) / F.greatest(dry - wet, F.lit(1e-12)), 0.0, 1.0)
        falling = 1 - (1 - anchor) * clip(now / ser, 0.0, 1.0)
        rising = anchor * clip((1 - now) / F.greatest(1 - ser, F.lit(1e-9)), 0.0, 1.0)
        lam = F.when(turn < 0, falling).otherwise(rising)
        h = retention(now, ratio * alpha_d, n) + lam * (retention(now, alpha_d, n) - retention(now, ratio * alpha_d, n))
        return {"prev": now, "dir": turn, "ser": ser, "hr": hr, "h": h}, h

    state = {"prev": F.lit(-1.0), "dir": F.lit(way), "ser": F.lit(1.0), "hr": F.lit(0.0), "h": F.lit(0.0)}
    return ordered_fold(df, keys, order, [se], state, step, "suction")


def hysteretic_velocity(df: DataFrame, keys: list[str], order: str, se: str, alpha_d: float, n: float, vs: Callable[[Column, Column], Column], ratio: float = 2.0, start: str = "drying") -> DataFrame:
    """keys, order, se, suction, vs, dvv: the shear velocity vs(suction, se) along a hysteretic path, and its change from the first step's.

    With ratio 1 the wetting and the drying way coincide and a closed path closes.
    """
    from pyspark.sql import Window

    path = hysteretic_suction(df, keys, order, se, alpha_d, n, ratio, start).join(df.select(*keys, order, se), [*keys, order])
    speed = path.withColumn("vs", vs(F.col("suction"), F.col(se)))
    first = F.first("vs").over(Window.partitionBy(*keys).orderBy(order))
    return speed.select(*keys, order, se, "suction", "vs", (F.col("vs") / first - 1).alias("dvv"))
