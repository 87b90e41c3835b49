"""Missing-value rules of the statistical language the inputs come from.

Spark's `greatest`/`least` skip NULLs, `/` raises on zero under ANSI mode, `NOT IN` drops
NULL rows and `sum` of nothing is NULL. The helpers below give the other convention.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_null(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).isNull() for c in cols])


def strict_greatest(*cols: Column | str) -> Column:
    """Largest value, NULL as soon as one input is NULL."""
    return F.when(~any_null(*cols), F.greatest(*[as_col(c) for c in cols]))


def strict_least(*cols: Column | str) -> Column:
    """Smallest value, NULL as soon as one input is NULL."""
    return F.when(~any_null(*cols), F.least(*[as_col(c) for c in cols]))


def ratio(num: Column | str, den: Column | str) -> Column:
    """`num/den` with signed infinity for x/0 and NULL for 0/0."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    at_zero = (
        F.when((d == 0) & (n > 0), F.lit(float("inf")))
        .when((d == 0) & (n < 0), F.lit(float("-inf")))
    )
    return F.coalesce(F.try_divide(n, d), at_zero)


def round_scaled(c: Column | str, digits: int) -> Column:
    """The multiple of 10^-digits nearest to the double, halves away from zero, found by scaling as SQL engines do.

    Spark's `round` goes by the shortest text of the double, so 0.0021874999999999998 times 10^6, a half
    to the last bit, goes up here and down there. Infinity, NaN and what scaling would overflow stay.
    """
    x = as_col(c)
    scaled = F.abs(x) * 10.0**digits
    even = F.rint(scaled)
    out = F.signum(x) * (even + F.when(scaled - even == 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)


def not_in_keep_null(c: Column | str, values) -> Column:
    """True for rows outside `values`, NULL rows included."""
    return ~F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def strict_avg(c: Column | str) -> Column:
    """Mean that is NULL when any row is NULL."""
    x = as_col(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    x = as_col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def is_finite(c: Column | str) -> Column:
    x = as_col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def weighted_avg(x: Column | str, w: Column | str) -> Column:
    """sum(w x)/sum(w) over rows where x is present."""
    xc, wc = as_col(x), as_col(w)
    return F.try_divide(F.sum(xc * wc), F.sum(F.when(xc.isNotNull(), wc)))


def effective_n(w: Column | str) -> Column:
    """(sum w)^2 / sum w^2."""
    wc = as_col(w)
    return F.try_divide(F.pow(F.sum(wc), F.lit(2.0)), F.sum(wc * wc))
