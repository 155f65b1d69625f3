"""Column expressions over arrays and scalars.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col) -> Column:
    """Round to six digits without a negative zero.

    The nudge keeps exact halves from depending on the order of a sum.
    """
    rounded = F.round(_c(col) + 1e-10, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nonzero_or_one(col) -> Column:
    return F.when(_c(col) == 0, F.lit(1.0)).otherwise(_c(col))


def clip(col, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), _c(col)))


# ---- hash draws -------------------------------------------------------------

def hash_key(*parts) -> Column:
    """Order key that any engine with SHA-256 can repeat."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def uniform(*parts) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of a SHA-256."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# ---- arrays -----------------------------------------------------------------

def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def array_mean(arr) -> Column:
    return array_sum(arr) / F.size(_c(arr))


def array_std(arr) -> Column:
    """Population standard deviation of one array."""
    arr = _c(arr)
    mean = array_mean(arr)
    return F.sqrt(F.aggregate(
        arr, F.struct(mean.alias("m"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct(acc["m"].alias("m"), (acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s")),
        lambda acc: acc["s"] / F.size(arr)))


def let(value: Column, body) -> Column:
    """Name a value once inside an expression: evaluate, then use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fit(arr: Column, fit: Column, body) -> Column:
    """Apply ``body(x, fit)`` to each element; the fit is evaluated once.

    One lambda level only: Spark does not extract an Arrow function whose input
    holds a lambda that refers to an outer lambda's variable.
    """
    return F.zip_with(arr, F.array_repeat(fit, F.size(arr)), body)


def z_norm(arr) -> Column:
    """(x - mean) / population deviation; a constant series keeps scale 1."""
    arr = _c(arr)
    fit = F.struct(array_mean(arr).alias("m"), nonzero_or_one(array_std(arr)).alias("s"))
    return with_fit(arr, fit, lambda x, f: (x - f["m"]) / f["s"])


def sorted_percentile(sorted_arr, q: float) -> Column:
    """Linear percentile of an already sorted array."""
    arr = _c(sorted_arr)
    pos = (F.size(arr) - 1) * F.lit(float(q))
    low, high = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    low_v, high_v = F.get(arr, low), F.get(arr, high)
    return low_v + (high_v - low_v) * (pos - low)


def array_percentile(arr, q: float) -> Column:
    return let(F.array_sort(_c(arr)), lambda s: sorted_percentile(s, q))


def first_difference(arr) -> Column:
    """Change from the previous point; the first change is zero."""
    arr = _c(arr)
    before = F.concat(F.slice(arr, 1, 1), F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))))
    return F.zip_with(arr, F.slice(before, F.lit(1), F.size(arr)), lambda x, p: x - p)


def min_zero(arr) -> Column:
    arr = _c(arr)
    return with_fit(arr, F.array_min(arr), lambda x, low: x - low)


def resample(arr, target) -> Column:
    """Linear interpolation of an array on ``target`` evenly spaced points."""
    arr = _c(arr)
    target = target if isinstance(target, Column) else F.lit(int(target))
    n = F.size(arr)

    def at(i):
        pos = i * (n - 1) / F.greatest(target - 1, F.lit(1))
        low = F.least(F.floor(pos).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        return F.get(arr, low) + (F.get(arr, high) - F.get(arr, low)) * (pos - low)

    grid = F.transform(F.sequence(F.lit(0), target - 1), at)
    return (F.when(n == 0, F.array_repeat(F.lit(0.0), target))
            .when(n == target, arr).otherwise(grid))


def fixed_width(arr, width: int) -> Column:
    return F.slice(F.concat(_c(arr), F.array_repeat(F.lit(0.0), width)), 1, width)


def crop(arr, start_frac: float, width_frac: float) -> Column:
    """A window given by fractions of the length, at least 8 points wide."""
    n = F.size(_c(arr))
    width = F.least(n, F.greatest(F.lit(8), F.rint(n * F.lit(width_frac)).cast("int")))
    start = F.rint((n - width) * F.lit(start_frac)).cast("int")
    return F.slice(_c(arr), F.greatest(F.lit(0), F.least(start, n - width)) + 1, width)


def slope(arr) -> Column:
    """Least-squares slope of an array against its position."""
    arr = _c(arr)
    n = F.size(arr)
    mid = (n - 1) / F.lit(2.0)
    dots = F.aggregate(F.transform(arr, lambda x, i: (i - mid) * x), F.lit(0.0), lambda a, x: a + x)
    norm = n * (n * n - 1) / F.lit(12.0)
    return F.when(n > 1, dots / norm).otherwise(F.lit(0.0))


def moments(arr) -> Column:
    """struct(mean, std, skew, kurt): population moments, flat segment -> 0."""
    arr = _c(arr)
    n = F.size(arr)

    def central(mean):
        return F.aggregate(
            arr, F.struct(mean.alias("m"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")),
            lambda s, x: F.struct(
                s["m"].alias("m"),
                (s["a"] + F.pow(x - s["m"], F.lit(2))).alias("a"),
                (s["b"] + F.pow(x - s["m"], F.lit(3))).alias("b"),
                (s["c"] + F.pow(x - s["m"], F.lit(4))).alias("c")))

    return let(let(array_mean(arr), central), lambda s: let(F.sqrt(s["a"] / n), lambda std: F.struct(
        s["m"].alias("mean"), std.alias("std"),
        F.when(std > 1e-9, s["b"] / n / F.pow(std, F.lit(3))).otherwise(0.0).alias("skew"),
        F.when(std > 1e-9, s["c"] / n / F.pow(std, F.lit(4)) - 3).otherwise(0.0).alias("kurt"))))


# ---- normal distribution ----------------------------------------------------

# Abramowitz and Stegun 7.1.26 (error function).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
              -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
              3.754408661907416e+00)


def normal_cdf(z) -> Column:
    p, a1, a2, a3, a4, a5 = ERF
    z = _c(z)

    def body(v):
        t, x2 = v["t"], v["z"] * v["z"] / 2
        tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x2)
        return 0.5 + F.signum(v["z"]) * (0.5 - tail / 2)

    # z is named once: the polynomial would repeat a long expression otherwise
    return let(z, lambda w: let(F.struct(w.alias("z"), (1 / (1 + p * F.abs(w) / F.sqrt(F.lit(2.0)))).alias("t")), body))


def normal_quantile_value(p: float) -> float:
    """Quantile of a fixed probability (configuration, not data)."""
    import math

    def poly(cs, x):
        total = 0.0
        for c in cs:
            total = total * x + c
        return total

    if p < 0.02425:
        q = math.sqrt(-2 * math.log(p))
        return poly(QUANTILE_C, q) / (poly(QUANTILE_D, q) * q + 1)
    if p > 1 - 0.02425:
        return -normal_quantile_value(1 - p)
    q = p - 0.5
    r = q * q
    return poly(QUANTILE_A, r) * q / (poly(QUANTILE_B, r) * r + 1)
