"""Tail probabilities that Spark SQL has no function for, as column expressions.

The error function is a rational approximation. Incomplete gamma and beta functions are summed or evaluated as continued
fractions by folding over a sequence, with as many steps as their arguments need. So all run in the JVM, on any number of
rows, and null arguments give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Coefficients of Lanczos' approximation of the gamma function with g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# Cody's rational approximations of the error function, numerators and denominators by rising power of the
# argument's square (near 0), the argument (to 4) and its inverse square (beyond 4).
_NEAR = ((3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560, 1.85777706184603153e-1),
         (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0))
_MIDDLE = ((1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2,
            6.61191906371416295e1, 8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8),
           (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3,
            5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0))
_FAR = ((6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1,
         1.63153871373020978e-2), (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725,
                                   2.56852019228982242, 1.0))
_TINY = 1e-300
_MOST_STEPS = 1_000_000


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for arguments of one half or more."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def _steps(size: Column) -> Column:
    """Numbers from 1 on: enough terms near the middle of a distribution of this many degrees, where most are needed."""
    return F.sequence(F.lit(1), F.least(F.ceil(60 + 10 * F.sqrt(size)), F.lit(_MOST_STEPS)).cast("int"))


def _fraction(first: Column, steps: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """``first + a1 / (b1 + a2 / (b2 + ...))`` from the front; ``term(k)`` gives (a_k, b_k)."""
    off_zero = lambda v: F.when(v == 0, F.lit(_TINY)).otherwise(v)
    start = F.struct(first.alias("value"), first.alias("c"), F.lit(0.0).alias("d"))

    def step(s: Column, k: Column) -> Column:
        a, b = term(k.cast("double"))
        d, c = 1 / off_zero(b + a * s["d"]), off_zero(b + a / s["c"])
        return F.struct((s["value"] * c * d).alias("value"), c.alias("c"), d.alias("d"))

    return F.aggregate(steps, start, step, lambda s: s["value"])


def upper_gamma(s: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(s, x)."""
    front = F.exp(s * F.log(x) - x - log_gamma(s))
    start = F.struct((1 / s).alias("part"), (1 / s).alias("total"))
    series = F.aggregate(_steps(s), start, lambda acc, k: F.struct(
        (acc["part"] * x / (s + k)).alias("part"), (acc["total"] + acc["part"] * x / (s + k)).alias("total")), lambda acc: acc["total"])
    fraction = _fraction(x + 1 - s, _steps(s), lambda k: (-k * (k - s), x + 2 * k + 1 - s))
    return F.when(x <= 0, F.lit(1.0)).when(x < s + 1, 1 - series * front).otherwise(front / fraction)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def term(k: Column) -> tuple[Column, Column]:
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k % 2 == 1, odd).otherwise(even), F.lit(1.0)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return front / (a * _fraction(F.lit(1.0), _steps(a + b), term))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b)."""
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(
        x > (a + 1) / (a + b + 2), 1 - _beta_fraction(b, a, 1 - x)).otherwise(_beta_fraction(a, b, x))


def _ratio(x: Column, of: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    parts = []
    for coefficients in of:
        value = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            value = value * x + F.lit(c)
        parts.append(value)
    return parts[0] / parts[1]


def erfc(x: Column) -> Column:
    """Complementary error function of arguments from 0 on."""
    square = x * x
    inverse = 1 / F.greatest(square, F.lit(1.0))
    far = (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, _FAR)) / F.greatest(x, F.lit(1.0))
    return F.when(x <= 0.46875, 1 - x * _ratio(square, _NEAR)).when(
        x <= 4, F.exp(-square) * _ratio(x, _MIDDLE)).otherwise(F.exp(-square) * far)


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a standard normal score."""
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z.isNotNull(), erfc(F.abs(z) / math.sqrt(2.0)))


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation ``r`` over ``n`` pairs: 1 for two pairs, not a number for fewer."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    free = n - 2
    p = F.when(free > 0, incomplete_beta(free / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r))).when(
        free == 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
    return F.when(r.isNotNull() & n.isNotNull(), p)


def chi_square_p(statistic: Column | str, dof: Column | str) -> Column:
    """Upper tail of a chi-square statistic."""
    x, k = (F.col(c) if isinstance(c, str) else c for c in (statistic, dof))
    return F.when(x.isNotNull() & k.isNotNull(), upper_gamma(k / 2, x / 2))
