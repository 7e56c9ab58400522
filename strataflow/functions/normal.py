"""The normal distribution as expressions, which Spark has no functions for, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients, from the constant up, of Wichura's rational approximations of the quantile (AS 241, numerators and
# denominators for the middle, the tails and the far tails) and of Hart's of the distribution function (as given by West 2005).
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
BODY = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2),
)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ratio(x: Column, coefficients: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + c, reversed(p[:-1]), F.lit(p[-1])) for p in coefficients)
    return top / bottom


def norm_cdf(z: Column | str) -> Column:
    """The share of the distribution below z, right to about 1e-15."""

    def below(x: Column) -> Column:
        a = F.abs(x)
        tail = F.exp(-x * x / 2)
        far = tail / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, tail * _ratio(a, BODY)).otherwise(far)
        return F.when(x > 0, 1 - upper).otherwise(upper)

    return _once((F.col(z) if isinstance(z, str) else z).cast("double"), below)


def norm_ppf(p: Column | str) -> Column:
    """The quantile of a share, held within 1e-12 of 0 and 1."""

    def quantile(x: Column) -> Column:
        q = x - 0.5
        r = F.sqrt(-F.ln(F.least(x, 1 - x)))
        outer = F.when(r <= 5, _ratio(r - 1.6, TAIL)).otherwise(_ratio(r - 5, FAR))
        return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, MIDDLE)).otherwise(F.when(q < 0, -outer).otherwise(outer))

    share = (F.col(p) if isinstance(p, str) else p).cast("double")
    return _once(F.when(share.isNotNull(), F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), share))), quantile)


def pit(y: Column, mu: Column, sigma: Column) -> Column:
    return norm_cdf((y - mu) / F.greatest(sigma, F.lit(1e-9)))


def crps(y: Column, mu: Column, sigma: Column) -> Column:
    """Closed form of the continuous ranked probability score of a normal forecast."""
    s = F.greatest(sigma, F.lit(1e-9))
    z = (y - mu) / s
    return s * (z * (2 * norm_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


# -- the same in SQL; x is the name of a column


def _ratio_sql(x: str, coefficients: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    top, bottom = (reduce(lambda acc, c: f"({acc} * {x} + {c!r}::DOUBLE)", reversed(p[:-1]), f"{p[-1]!r}::DOUBLE") for p in coefficients)
    return f"({top} / {bottom})"


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    far = f"exp(-{x} * {x} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE"
    upper = f"(CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547::DOUBLE THEN exp(-{x} * {x} / 2) * {_ratio_sql(a, BODY)} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def ppf_sql(x: str) -> str:
    r = f"sqrt(-ln(least({x}, 1 - {x})))"
    outer = f"(CASE WHEN {r} <= 5 THEN {_ratio_sql(f'({r} - 1.6::DOUBLE)', TAIL)} ELSE {_ratio_sql(f'({r} - 5)', FAR)} END)"
    q = f"({x} - 0.5::DOUBLE)"
    return f"(CASE WHEN abs{q} <= 0.425 THEN {q} * {_ratio_sql(f'(0.180625::DOUBLE - {q} * {q})', MIDDLE)} WHEN {q} < 0 THEN -{outer} ELSE {outer} END)"
