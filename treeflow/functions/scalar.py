"""Scalar functions as columns of built-in expressions, with IEEE and Python semantics where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """True division that gives infinities and NaN, as arrays do, instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(NAN))
    return F.when(b != 0, a / b).when(b == 0, F.when(F.isnan(a), F.lit(NAN)).otherwise(at_zero))


def modulo(a: Column, b: Column, whole: bool) -> Column:
    """Remainder with the sign of the divisor; of zero divisors 0 for integers and NaN for floats."""
    safe = F.when(b != 0, b)
    rest = (a % safe + safe) % safe
    return F.when(b == 0, F.lit(0) if whole else F.lit(NAN)).otherwise(rest)


def floor_divide(a: Column, b: Column, whole: bool) -> Column:
    """Quotient rounded down."""
    if whole:
        safe = F.when(b != 0, b)
        return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a - modulo(a, b, True), safe))
    return F.when(b == 0, divide(a, b)).otherwise(F.floor(a / F.when(b != 0, b)).cast("double"))


def log(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(NAN)).when(x > 0, F.log(F.when(x > 0, x))).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def log1p(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(NAN)).when(x > -1, F.log1p(F.when(x > -1, x))).when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN))


def logaddexp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow; equal infinities give themselves."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).when(top == low, top + F.lit(0.6931471805599453)).otherwise(top + F.log1p(F.exp(low - top)))


def truncated(x: Column) -> Column:
    """Towards zero; infinities and NaN stay."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).when(x >= 0, F.floor(x).cast("double")).otherwise(F.ceil(x).cast("double"))


def is_missing(x: Column, floating: bool) -> Column:
    return (x.isNull() | F.isnan(x)) if floating else x.isNull()


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    """Bounded from above, then from below, so the lower bound wins; NaN stays NaN and null stays null."""
    out = x
    if high is not None:
        out = F.when(x > high, F.when(F.isnan(x.cast("double")), x).otherwise(high)).otherwise(x)
    if low is not None:
        below = out
        out = F.when(below < low, low).otherwise(below)
    return out


def piece(x: Column, low: Column | None, high: Column | None) -> Column:
    """The part of x within the bounds, measured from the lower bound (from zero without one)."""
    if low is None:
        return clip(x, None, high)
    return clip(x, low, high) - low


def hard_sigmoid(x: Column, zero: Column, one: Column) -> Column:
    """0 up to ``zero``, 1 from ``one`` on, straight between; falling if the bounds are in the other order."""
    slope = (x - zero) / F.when(one != zero, one - zero)
    return F.when(F.isnan(x.cast("double")), F.lit(NAN)).when(slope <= 0, F.lit(0.0)).when(slope >= 1, F.lit(1.0)).when(slope.isNotNull(), slope).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.when(x < zero, F.lit(0.0)).otherwise(F.lit(1.0)))


def larger(a: Column, b: Column) -> Column:
    return F.when(a < b, b).otherwise(a)


def smaller(a: Column, b: Column) -> Column:
    return F.when(b < a, b).otherwise(a)


def blend(sparse: Column, dense: Column, limit: float | None) -> Column:
    """Dense beyond the limit or without a sparse value; below it a mean whose weight on dense grows with the value."""
    known = sparse.isNotNull() & ~F.isnan(sparse)
    if not limit or limit == INF:
        return F.when(known, sparse).otherwise(dense)
    r = sparse / F.lit(float(limit))
    return F.when(known & (sparse <= F.lit(float(limit))), r * dense + (1 - r) * sparse).otherwise(dense)


#: Functions of two numbers by name.
BINARY = {"hypot": F.hypot, "arctan2": F.atan2, "logaddexp": logaddexp, "copysign": lambda a, b: F.abs(a) * F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0))}
#: Functions of one number by name; those with domains of their own are guarded above.
UNARY = {
    "exp": F.exp, "expm1": F.expm1, "log": log, "log1p": log1p, "sqrt": F.sqrt, "abs": F.abs, "absolute": F.abs, "fabs": F.abs, "floor": F.floor, "ceil": F.ceil,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "sign": F.signum, "degrees": F.degrees, "radians": F.radians, "rint": F.rint, "cbrt": F.cbrt, "square": lambda x: x * x, "negative": lambda x: -x,
    "log10": lambda x: log(x) / F.lit(2.302585092994046), "log2": lambda x: log(x) / F.lit(0.6931471805599453), "trunc": truncated, "fix": truncated, "exp2": lambda x: F.pow(F.lit(2.0), x), "reciprocal": lambda x: divide(F.lit(1.0), x), "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
}
