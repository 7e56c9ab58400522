"""Classifications as CASE expressions, first match first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.core import col, flag

SHALLOW_MAX_M, DEEP_MIN_M = 30.0, 60.0
#: Upper slope edges (tangent) and the velocities of the bins they bound, by tectonic setting.
SLOPE_EDGES = {"active": (0.0022, 0.0063, 0.018, 0.05, 0.10, 0.138), "stable": (2e-5, 0.002, 0.004, 0.0072, 0.013, 0.018)}
SLOPE_VS30 = (180.0, 240.0, 300.0, 360.0, 490.0, 620.0, 760.0)
#: Lower velocity bounds of the site classes, worst first.
CLASS_BOUNDS, CLASS_NAMES = (180.0, 360.0, 760.0, 1500.0), ("E", "D", "C", "B", "A")


def hydro_class(depth: str | Column, deep: str | Column, shallow_max: float = SHALLOW_MAX_M, deep_min: float = DEEP_MIN_M) -> Column:
    """shallow_watertable, deep_confined or ambiguous by well depth."""
    d = col(depth)
    return (
        F.when(flag(deep) | (d >= deep_min), "deep_confined").when(d <= shallow_max, "shallow_watertable").otherwise("ambiguous")
    )


def measurement_target(
    depth: Column, top: Column, bottom: Column, code: Column, flowing: Column, deep: Column, shallow_max: float = SHALLOW_MAX_M, deep_min: float = DEEP_MIN_M
) -> Column:
    """What a well observes: water_table, aquifer_head or unknown, by the strongest evidence there is.

    Evidence counts in the order flowing, aquifer code, screen, depth.
    """
    confined = F.coalesce(F.upper(F.trim(code)).isin("C", "M", "X"), F.lit(False))
    flows, is_deep = flag(flowing), flag(deep)
    base = (
        F.when(confined, "aquifer_head")
        .when((top > shallow_max) & bottom.isNotNull(), "aquifer_head")
        .when(top >= deep_min, "aquifer_head")
        .when(top <= shallow_max, "water_table")
        .when((depth >= deep_min) | is_deep, "aquifer_head")
        .when(depth <= shallow_max, "water_table")
        .otherwise("unknown")
    )
    return (
        F.when(flows & (F.coalesce(depth >= deep_min, F.lit(False)) | is_deep | confined), "aquifer_head")
        .when(flows & (base == "water_table"), "unknown")
        .otherwise(base)
    )


def domain_class(hand: Column, lithology: Column, coast: Column, buffer_m: float = 2000.0, coast_hand: float = 10.0, valley_hand: float = 8.0) -> Column:
    """Hydrogeologic domain 0 valley, 1 basin, 2 fractured, 3 volcanic, 4 confined basalt, 5 coastal; 255 without lithology.

    A missing height above drainage is neither low nor near the coast.
    """
    near_coast = F.coalesce((coast <= buffer_m) & (hand <= coast_hand), F.lit(False))
    return (
        F.when(lithology.isNull(), 255)
        .when(near_coast, 5)
        .when(lithology == 3, 4)
        .when(lithology == 2, 3)
        .when(lithology == 1, 2)
        .when((lithology == 0) & F.coalesce(hand <= valley_hand, F.lit(False)), 0)
        .when(lithology == 0, 1)
        .otherwise(255)
        .cast("smallint")
    )


def terrain_zone(hand: str | Column, valley: float = 5.0, transition: float = 20.0) -> Column:
    h = col(hand)
    return F.when(h.isNull() | (h < valley), "valley").when(h < transition, "transition").otherwise("upland")


def binned(x: str | Column, edges: tuple[float, ...], values: tuple) -> Column:
    """values[k] for the bin of x; a value equal to an edge belongs to the upper bin."""
    x = col(x)
    out = F.when(x.isNull(), F.lit(None))
    for edge, value in zip(edges, values):
        out = out.when(x < edge, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def slope_vs30(slope_deg: str | Column, region: str = "active") -> Column:
    return binned(F.tan(F.radians(col(slope_deg))), SLOPE_EDGES[region], SLOPE_VS30)


def site_class(vs30: str | Column) -> Column:
    return binned(vs30, CLASS_BOUNDS, CLASS_NAMES)
