"""Soil, water and pressure expressions. Formulas are those of the published papers they are named after."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.core import clip, col

RHO_W, GRAVITY = 1000.0, 9.80665


def saxton_rawls(sand_pct: str | Column, clay_pct: str | Column, om_pct: float | Column = 2.5) -> dict[str, Column]:
    """theta_wp, theta_fc, theta_sat, ksat_mm_h from texture (Saxton and Rawls 2006)."""
    s, c, om = col(sand_pct) / 100, col(clay_pct) / 100, col(om_pct)
    t15 = -0.024 * s + 0.487 * c + 0.006 * om + 0.005 * s * om - 0.013 * c * om + 0.068 * s * c + 0.031
    wp = t15 + (0.14 * t15 - 0.02)
    t33 = -0.251 * s + 0.195 * c + 0.011 * om + 0.006 * s * om - 0.027 * c * om + 0.452 * s * c + 0.299
    fc = t33 + 1.283 * t33 * t33 - 0.374 * t33 - 0.015
    ts = 0.278 * s + 0.034 * c + 0.022 * om - 0.018 * s * om - 0.027 * c * om - 0.584 * s * c + 0.078
    sat = fc + (ts + 0.636 * ts - 0.107) - 0.097 * s + 0.043
    slope = (F.ln(fc) - F.ln(wp)) / (math.log(1500.0) - math.log(33.0))
    ksat = 1930 * F.pow(F.greatest(sat - fc, F.lit(1e-6)), 3 - slope)
    low = clip(wp, 0.01, 0.5)
    field = clip(fc, low + 0.01, 0.6)
    return {"theta_wp": low, "theta_fc": field, "theta_sat": clip(sat, field + 0.01, 0.75), "ksat_mm_h": ksat}


def ksat_pedotransfer(ph: Column, clay: Column, silt: Column, cec: Column, scale: float = 1.0) -> Column:
    return F.pow(F.lit(10.0), 0.40220 + 0.26122 * ph + 0.44565 - 0.02329 * clay - 0.01265 * silt - 0.01038 * cec) * scale


def transmissivity(ksat: Column, thickness: Column, anisotropy: float = 1.0, decay_depth: float | None = None) -> Column:
    return ksat * decay_depth if decay_depth is not None else ksat * thickness * anisotropy


def extraterrestrial_mm(doy: Column, lat_deg: Column) -> Column:
    """Daily extraterrestrial radiation in mm of evaporation (FAO-56)."""
    j = 2 * math.pi * doy / 365
    dr, decl, phi = 1 + 0.033 * F.cos(j), 0.409 * F.sin(j - 1.39), F.radians(lat_deg)
    ws = F.acos(clip(-F.tan(phi) * F.tan(decl), -1.0, 1.0))
    return 0.408 * (24 * 60 / math.pi) * 0.0820 * dr * (ws * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(ws))


def hargreaves_pet(tmax: Column, tmin: Column, tmean: Column, doy: Column, lat: Column) -> Column:
    """Daily potential evapotranspiration in mm (Hargreaves and Samani 1985)."""
    ra = extraterrestrial_mm(doy, lat)
    return F.greatest(0.0023 * (tmean + 17.8) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))) * ra, F.lit(0.0))


def saturation_fraction(theta: Column, porosity: Column) -> Column:
    return F.when(porosity > 0, clip(theta / porosity, 0.0, 1.0))


def pore_pressure(head: Column, z: Column) -> Column:
    """Pa below the water table, 0 above."""
    return RHO_W * GRAVITY * F.greatest(head - z, F.lit(0.0))


def pore_pressure_slope(head: Column, z: Column, slope_rad: Column) -> Column:
    return pore_pressure(head, z) * F.pow(F.cos(slope_rad), F.lit(2.0))


def pressure_head(p: Column) -> Column:
    return p / (RHO_W * GRAVITY)


def head_from_storage(ds: Column, sy: Column, ref: float | Column = 0.0) -> Column:
    return col(ref) + ds / sy


def storage_from_head(dh: Column, sy: Column) -> Column:
    return sy * dh


def vg_suction(se: Column, alpha: float | Column, n: float | Column) -> Column:
    """Van Genuchten suction at effective saturation se."""
    n = col(n)
    m = 1 - 1 / n
    return (1 / col(alpha)) * F.pow(F.pow(clip(se, 1e-3, 1 - 1e-6), -1 / m) - 1, 1 / n)


def shear_velocity(theta: Column, se: Column, suction_kpa: Column, phi: Column) -> Column:
    """Hertz-Mindlin shear velocity of unsaturated soil in m/s."""
    p = F.greatest(10.0 + se * suction_kpa, F.lit(1.0))
    g = 75.0 * F.pow(p / 100.0, F.lit(1 / 3)) * 1e6
    return F.sqrt(g / (2650.0 * (1 - phi) + 1000.0 * theta))


def twi(area_m2: Column, slope_deg: Column, cell_m: float | None = None) -> Column:
    """Topographic wetness index; with cell_m the specific one, slope held at 0.1 degrees at least."""
    if cell_m is None:
        return F.ln(area_m2 / F.tan(F.radians(slope_deg)))
    return F.ln((area_m2 / cell_m) / F.tan(F.radians(F.greatest(slope_deg, F.lit(0.1)))))


def matern(dist: Column, length: float | Column, nu: float = 1.5) -> Column:
    """Matern correlation for smoothness 1/2, 3/2 and 5/2."""
    x = math.sqrt(2 * nu) * dist / col(length)
    poly = {0.5: F.lit(1.0), 1.5: 1 + x, 2.5: 1 + x + x * x / 3}
    if nu not in poly:
        raise ValueError("smoothness must be 0.5, 1.5 or 2.5")
    return poly[nu] * F.exp(-x)


def ou_correlation(lag: Column, tau: float | Column) -> Column:
    return F.exp(-lag / col(tau))


def information_gain(prior_var: Column, post_var: Column, most: float = 4.0) -> Column:
    """Nats, held in [0, most]."""
    return clip(0.5 * F.ln(prior_var / post_var), 0.0, most)


def peak_depth_km(f_hz: Column, vs: float = 1500.0) -> Column:
    return vs / (3 * f_hz) / 1000


# The ellipsoid (GRS 80), and the parallels, origin and central meridian of EPSG:5070.
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257222101
_PARALLELS, _ORIGIN, _MERIDIAN = (29.5, 45.5), 23.0, -96.0


def _cone() -> tuple[float, float, float, float, float]:
    """e, e^2, n, C and rho0 of the conic projection (Snyder 1987)."""
    e2 = 2 * _FLATTENING - _FLATTENING**2
    e = math.sqrt(e2)

    def q_of(phi: float) -> float:
        sin = math.sin(phi)
        return (1 - e2) * (sin / (1 - e2 * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2 = map(math.radians, _PARALLELS)
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(p2) - q_of(p1))
    big = m_of(p1) ** 2 + n * q_of(p1)
    return e, e2, n, big, _AXIS * math.sqrt(big - n * q_of(math.radians(_ORIGIN))) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:5070 x, y in metres (Snyder 1987, ellipsoidal Albers equal area)."""
    e, e2, n, big, rho0 = _cone()
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = _AXIS * F.sqrt(big - n * q) / n
    theta = n * F.radians(lon - _MERIDIAN)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of EPSG:5070 metres: the inverse of albers(), the latitude by its series in the authalic one.

    Both are NULL for a place that no point of the earth is projected to.
    """
    e, e2, n, big, rho0 = _cone()
    up = rho0 - y
    rho = F.sqrt(x * x + up * up)
    q = (big - F.pow(rho * n / _AXIS, 2)) / n
    pole = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
    there = F.abs(q / pole) <= 1
    beta = F.asin(F.when(there, q / pole))
    e4, e6 = e2 * e2, e2**3
    lat = (
        beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    )
    return F.when(there, _MERIDIAN + F.degrees(F.atan2(x, up) / n)), F.degrees(lat)


# -- state conversions


#: What a specific yield may be.
SPECIFIC_YIELD_RANGE = (0.005, 0.6)


def checked_specific_yield(sy: Column) -> Column:
    """sy; a value outside SPECIFIC_YIELD_RANGE ends the query."""
    return F.when(sy.isNull() | sy.between(*SPECIFIC_YIELD_RANGE), sy).otherwise(
        F.raise_error(F.concat(F.lit("specific yield out of range: "), sy.cast("string"))).cast("double")
    )


def depth_to_water(surface: Column, head: Column) -> Column:
    return surface - head


def water_table_elevation(surface: Column, depth: Column) -> Column:
    return surface - depth


def depth_anomaly(head_anomaly: Column) -> Column:
    return -head_anomaly


def head_anomaly(depth_anomaly: Column) -> Column:
    return -depth_anomaly


def hydraulic_head(p: Column, z: Column) -> Column:
    return z + pressure_head(p)


def topmodel_depth(mean_depth: Column, scale: float, twi: Column, mean_twi: Column) -> Column:
    """Water-table depth by wetness index about its mean, never above ground."""
    return F.greatest(mean_depth - scale * (twi - mean_twi), F.lit(0.0))


# -- soil hydraulics

MM_H_TO_M_DAY = 24 / 1000


def ksat_texture_m_day(sand_pct: Column, clay_pct: Column, om_pct: float | Column = 2.5) -> Column:
    return saxton_rawls(sand_pct, clay_pct, om_pct)["ksat_mm_h"] * MM_H_TO_M_DAY


def saturated_conductivity(method: str, **given: Column) -> Column:
    """Saturated conductivity by saxton_rawls (sand_pct, clay_pct), solus_pedotransfer (ph, clay_pct, silt_pct, cec) or as provided (ksat_field)."""
    needs = {"saxton_rawls": ("sand_pct", "clay_pct"), "solus_pedotransfer": ("ph", "clay_pct", "silt_pct", "cec"), "provided": ("ksat_field",)}
    if method not in needs:
        raise ValueError(f"unknown method {method!r}; there are {sorted(needs)}")
    missing = [k for k in needs[method] if given.get(k) is None]
    if missing:
        raise ValueError(f"{method} needs {missing}")
    if method == "saxton_rawls":
        return ksat_texture_m_day(given["sand_pct"], given["clay_pct"], given.get("om_pct", 2.5))
    if method == "solus_pedotransfer":
        return ksat_pedotransfer(given["ph"], given["clay_pct"], given["silt_pct"], given["cec"], given.get("unit_scale", 1.0))
    return given["ksat_field"].cast("double")


def transmissivity_by(method: str, ksat: Column, thickness: Column, anisotropy: float = 2.5, decay_depth: Column | None = None) -> Column:
    """ksat_x_thickness, ksat_x_thickness_anisotropy or topmodel_exponential (decay depth; the thickness where there is none)."""
    found = {
        "ksat_x_thickness": lambda: ksat * thickness,
        "ksat_x_thickness_anisotropy": lambda: ksat * thickness * anisotropy,
        "topmodel_exponential": lambda: ksat * (thickness if decay_depth is None else decay_depth),
    }
    if method not in found:
        raise ValueError(f"unknown method {method!r}; there are {sorted(found)}")
    return found[method]()


def soil_hydraulics(method: str, transmissivity_method: str = "ksat_x_thickness", thickness: Column | None = None, **given: Column) -> dict[str, Column]:
    """ksat and, with a thickness, transmissivity."""
    extra = {k: given.pop(k) for k in ("anisotropy", "decay_depth") if k in given}
    ksat = saturated_conductivity(method, **given)
    return {"ksat": ksat} | ({} if thickness is None else {"transmissivity": transmissivity_by(transmissivity_method, ksat, thickness, **extra)})


#: Deviations of the pedotransfer moisture and of the wetness (as a share of the available water).
PTF_SIGMA, WETNESS_SIGMA = 0.03, 0.12


def moisture_from_wetness(w: Column, wp: Column, fc: Column, sat: Column) -> tuple[Column, Column]:
    """Moisture at relative wetness w, and its deviation."""
    w = clip(w, 0.0, 1.0)
    awc = F.greatest(fc - wp, F.lit(1e-6))
    var = F.pow((1 - w) * PTF_SIGMA, 2) + F.pow(w * PTF_SIGMA, 2) + F.pow(WETNESS_SIGMA * awc, 2)
    return F.least(wp + w * (fc - wp), sat), F.sqrt(var)


# -- velocity changes

#: Relative velocity change per metre of head, and per unit of moisture (of the material).
HEAD_SENSITIVITY, MOISTURE_SENSITIVITY = 5.0e-4, -1.0


def van_genuchten_of(sand_pct: Column, clay_pct: Column) -> tuple[Column, Column]:
    """alpha and n by texture."""
    s, c = sand_pct / 100, clay_pct / 100
    return clip(0.02 + 0.13 * s - 0.05 * c, 0.005, 0.25), clip(1.2 + 1.3 * s - 0.4 * c, 1.1, 2.8)


def vadose_velocity(theta: Column, wp: Column, sat: Column, alpha: Column, n: Column) -> Column:
    """Shear velocity at moisture theta, by the suction of the drying curve."""
    se = clip((theta - wp) / F.greatest(sat - wp, F.lit(1e-6)), 1e-3, 1.0)
    pc = (1 / alpha) * F.pow(F.pow(se, -1 / (1 - 1 / n)) - 1, 1 / n)
    return shear_velocity(theta, se, pc, sat)


def saturated_change(depth_anomaly: Column, k: float = HEAD_SENSITIVITY) -> Column:
    return k * depth_anomaly


def velocity_changes(depth_anomaly: Column, theta: Column, theta_ref: Column, wp: Column, sat: Column, alpha: Column, n: Column) -> tuple[Column, Column]:
    """Relative changes of the low (saturated) and the high (vadose) band."""
    now, before = vadose_velocity(theta, wp, sat, alpha, n), vadose_velocity(theta_ref, wp, sat, alpha, n)
    return saturated_change(depth_anomaly), (now - before) / before


def states_of_changes(low: Column, high: Column, depth0: Column, theta_ref: Column, wp: Column, sat: Column, alpha: Column, n: Column, steps: int = 41) -> tuple[Column, Column]:
    """Water-table depth and moisture that explain the changes; moisture is the best of evenly spaced ones, the driest of equals."""
    before = vadose_velocity(theta_ref, wp, sat, alpha, n)

    def tried(k: Column) -> Column:
        theta = wp + k / (steps - 1) * (sat - wp)
        return F.struct(F.abs((vadose_velocity(theta, wp, sat, alpha, n) - before) / before - high).alias("gap"), k.alias("k"), theta.alias("theta"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), tried))
    return depth0 + low / HEAD_SENSITIVITY, best["theta"]


def head_change_of(dvv: Column, std: Column, k: float = HEAD_SENSITIVITY) -> tuple[Column, Column]:
    return dvv / k, F.abs(std / k)


def moisture_change_of(dvv: Column, std: Column, sensitivity: float = MOISTURE_SENSITIVITY) -> tuple[Column, Column]:
    return dvv / sensitivity, F.abs(std / sensitivity)


def vs30_change_of(dvv: Column, std: Column | None = None) -> tuple[Column, Column]:
    return dvv.cast("double"), F.lit(None).cast("double") if std is None else F.abs(std)


def intensity_2d(r_km: Column, t_s: float | Column, diffusivity: float = 8.0) -> Column:
    """Diffuse energy density in the plane."""
    t = F.greatest(col(t_s), F.lit(1e-6))
    return F.exp(-r_km * r_km / (4 * diffusivity * t)) / (4 * math.pi * diffusivity * t)


# -- priors and observation streams

#: Days over which a state forgets.
MEMORY_DAYS = {"soil_moisture": 5.0, "gwl": 120.0}


def converted_range(length: float, nu: float, to: str = "lindgren") -> float:
    """A Matern length as twice itself ('lindgren') or as an inverse length ('kappa')."""
    if not (math.isfinite(length) and length > 0):
        raise ValueError(f"length must be positive and finite, not {length!r}")
    if to not in ("lindgren", "kappa"):
        raise ValueError(f"no convention {to!r}")
    return 2.0 * length if to == "lindgren" else math.sqrt(2 * nu) / length


def microergodic(sigma: float, length: float, nu: float) -> float:
    return sigma**2 * converted_range(length, nu, "kappa") ** (2 * nu)


def temporal_resolution(revisit_days: Column, tau: float | Column) -> Column:
    return F.pow(ou_correlation(revisit_days, tau), 2)


def lagged_observation(g: Column, lag_days: Column, tau: float | Column, state_var: Column, noise_var: Column) -> tuple[Column, Column]:
    """A footprint weight and the noise variance of an observation that is lag_days old."""
    rho = ou_correlation(lag_days, tau)
    return rho * g, state_var * (1 - rho * rho) + noise_var


def effective_observability(spatial: Column, revisit_days: Column, state: str) -> Column:
    return spatial * temporal_resolution(revisit_days, MEMORY_DAYS[state])
