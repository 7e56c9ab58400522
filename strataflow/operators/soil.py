"""Soil properties of the root zone from point depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.core import clip

#: Organic matter in a unit of organic carbon (van Bemmelen), and how each property is scaled in its integers.
CARBON_TO_MATTER = 1.724
SCALES = {"claytotal": 1.0, "sandtotal": 1.0, "silttotal": 1.0, "dbovendry": 100.0, "soc": 1000.0, "resdept_all_cm": 1.0, "anylithicdpt_cm": 1.0}


def trapezoid(depths: list[float]) -> dict[float, float]:
    """The share of the profile that each of some ascending point depths stands for."""
    if len(depths) < 2:
        return dict.fromkeys(depths, 1.0)
    ends = [depths[0], *[(a + b) / 2 for a, b in zip(depths, depths[1:])], depths[-1]]
    return {z: (b - a) / (depths[-1] - depths[0]) for z, a, b in zip(depths, ends, ends[1:])}


def depth_means(layers: DataFrame, keys: list[str], depths: list[float], root_cm: float = 100.0, renormalise: bool = False) -> DataFrame:
    """keys, property, value: layers(keys, property, depth, value) averaged from the surface to the root depth, scaled to their units.

    Values are integrated by trapezoids over the given point depths. A missing depth counts as 0, unless renormalise; a cell
    without any value has none. Properties that SCALES does not know are not scaled.
    """
    weights = trapezoid([z for z in depths if z <= root_cm])
    share = F.create_map(*[F.lit(float(x)) for pair in weights.items() for x in pair])
    scale = F.coalesce(F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])[F.col("property")], F.lit(1.0))
    rows = layers.filter(F.col("value").isNotNull()).withColumn("_w", share[F.col("depth").cast("double")]).filter("_w is not null")
    total = F.sum(F.col("_w") * F.col("value") / scale)
    return rows.groupBy(*keys, "property").agg((total / F.sum("_w") if renormalise else total).alias("value"))


def organic_matter(carbon: Column) -> Column:
    """Per cent of organic matter, held in 0 to 8."""
    return clip(carbon * CARBON_TO_MATTER, 0.0, 8.0)


def root_depth(restrictive_cm: Column, lithic_cm: Column) -> Column:
    """Metres down to the nearer of a restrictive layer and rock (a missing one is 2 m down), held in 0.1 to 2."""
    return clip(F.least(F.coalesce(restrictive_cm, F.lit(200.0)), F.coalesce(lithic_cm, F.lit(200.0))) / 100, 0.1, 2.0)


def root_zone(layers: DataFrame, single: DataFrame, keys: list[str], depths: list[float], root_cm: float = 100.0) -> DataFrame:
    """keys, clay, sand, silt, density, carbon, om, root_m: depth means of layers(keys, property, depth, value), and single(keys, property, value)."""
    names = {"claytotal": "clay", "sandtotal": "sand", "silttotal": "silt", "dbovendry": "density", "soc": "carbon"}
    means = depth_means(layers, keys, depths, root_cm).groupBy(*keys).pivot("property", list(names)).agg(F.first("value"))
    means = means.select(*keys, *[F.col(k).alias(v) for k, v in names.items()])
    once = single.groupBy(*keys).pivot("property", ["resdept_all_cm", "anylithicdpt_cm"]).agg(F.first("value"))
    found = means.join(once, keys, "left")
    return found.select(*keys, *names.values(), organic_matter(F.col("carbon")).alias("om"), root_depth(F.col("resdept_all_cm"), F.col("anylithicdpt_cm")).alias("root_m"))
