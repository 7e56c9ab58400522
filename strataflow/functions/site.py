"""Velocities of the uppermost ground: travel-time averages of profiles and the probabilities of site classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.classify import CLASS_BOUNDS, CLASS_NAMES
from strataflow.functions.normal import norm_cdf


def _log_mean(a: Column, b: Column) -> Column:
    """The velocity of a layer in which it runs linearly from a to b."""
    close = F.abs(b - a) < 1e-9
    return F.greatest(F.when(close, 0.5 * (a + b)).otherwise((b - a) / F.ln(F.when(close, 2.0).otherwise(b / F.greatest(a, F.lit(1e-9))))), F.lit(1e-9))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def profile_velocity(profile: Column, top: float = 30.0) -> Column:
    """top over the travel time to it, of an array of structs (z, vs) in any order.

    The first sample holds up to the surface, the last one down to top. NULL for an empty profile.
    """

    def from_surface(p: Column) -> Column:
        return F.when(p[0]["z"] > 0, F.concat(F.array(F.struct(F.lit(0.0).alias("z"), p[0]["vs"].alias("vs"))), p)).otherwise(p)

    def down(p: Column) -> Column:
        last = F.element_at(p, -1)
        return F.when(last["z"] < top, F.concat(p, F.array(F.struct(F.lit(top).alias("z"), last["vs"].alias("vs"))))).otherwise(p)

    def time(a: Column, b: Column) -> Column:
        cut = b["z"] > top
        v2 = F.when(cut, a["vs"] + (top - a["z"]) / (b["z"] - a["z"]) * (b["vs"] - a["vs"])).otherwise(b["vs"])
        return F.when(a["z"] < top, (F.least(b["z"], F.lit(top)) - a["z"]) / _let(v2, lambda v: _log_mean(a["vs"], v))).otherwise(0.0)

    def travel(p: Column) -> Column:
        return _sum(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), time))

    filled = F.when(F.size(profile) > 0, profile)
    found = _let(F.array_sort(filled), lambda p: _let(from_surface(p), lambda p: _let(down(p), lambda p: top / F.greatest(travel(p), F.lit(1e-9)))))
    return F.when(F.size(profile) > 0, found)


def buried_profile_velocity(profile: Column, top: float = 30.0, least: float = 1.0) -> Column:
    """As profile_velocity(), from the first sample of at least `least` (air or water above it) down by top.

    NULL where the samples do not reach that far or are broken by one that is missing or too slow.
    """
    p = F.array_sort(profile)
    n = F.size(p)

    def good(s: Column) -> Column:
        return F.coalesce(s["vs"] >= least, F.lit(False)) & ~F.isnan(F.coalesce(s["vs"], F.lit(0.0)))

    places = F.sequence(F.lit(0), n - 1)
    first = F.array_min(F.filter(places, lambda i: good(F.get(p, i))))
    target = F.get(p, first)["z"] + top
    # The first sample at the target or beyond it; with rounding left over, the last one.
    below = F.greatest(F.least(F.coalesce(F.array_min(F.filter(places, lambda i: F.get(p, i)["z"] >= target)), n - 1), n - 1), F.lit(1))

    def time(i: Column) -> Column:
        a, b = F.get(p, i - 1), F.get(p, i)
        share = F.when(i == below, (target - a["z"]) / F.when(b["z"] == a["z"], 1.0).otherwise(b["z"] - a["z"])).otherwise(1.0)
        return share * (b["z"] - a["z"]) / _log_mean(a["vs"], b["vs"])

    unbroken = F.forall(F.sequence(first, below), lambda i: good(F.get(p, i)))
    covered = F.element_at(p, -1)["z"] - F.get(p, first)["z"] >= top - 1e-9
    travel = F.when(first < below, _sum(F.transform(F.sequence(first + 1, F.greatest(first + 1, below)), time)))
    return F.when((n >= 2) & first.isNotNull(), F.when(unbroken & covered & (travel > 0), top / F.greatest(travel, F.lit(1e-12))))


def class_probabilities(mean: Column, std: Column, lognormal: bool = False) -> dict[str, Column]:
    """The probability of each site class, slowest first, of a velocity N(mean, std) or one whose logarithm is N(ln mean, std)."""
    loc = F.ln(mean) if lognormal else mean
    edges = [F.ln(F.lit(b)) if lognormal else F.lit(b) for b in CLASS_BOUNDS]
    sure = std == 0
    cdf = [F.when(sure, (mean < b).cast("double")).otherwise(norm_cdf((edge - loc) / F.when(sure, 1.0).otherwise(std))) for b, edge in zip(CLASS_BOUNDS, edges)]
    lower, upper = [F.lit(0.0), *cdf], [*cdf, F.lit(1.0)]
    return {name: b - a for name, a, b in zip(CLASS_NAMES, lower, upper)}


def likeliest_class(mean: Column, std: Column, lognormal: bool = False) -> Column:
    """A struct (class, p); of equals the slower."""
    found = class_probabilities(mean, std, lognormal)
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k"), F.lit(name).alias("class")) for k, (name, p) in enumerate(found.items())]))
    return F.struct(best["class"].alias("class"), best["p"].alias("p"))
