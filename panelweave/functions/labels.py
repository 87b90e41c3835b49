"""Label and number-format expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.nulls import as_col


def stars(p: Column | str) -> Column:
    c = as_col(p)
    return F.when(c < 0.01, "***").when(c < 0.05, "**").when(c < 0.1, "*").otherwise("")


def significance_band(p: Column | str) -> Column:
    c = as_col(p)
    return F.when(c < 0.01, "<0.01").when(c < 0.05, "<0.05").when(c < 0.1, "<0.1").otherwise("≥0.1")


def slope_class(beta: Column | str, p: Column | str, alpha: float = 0.1) -> Column:
    """Sign and significance of a coefficient; NULL when either is missing or beta is zero."""
    b, q = as_col(beta), as_col(p)
    sign = F.when(b > 0, "pos").when(b < 0, "neg")
    sig = F.when(q < alpha, "sig").when(q >= alpha, "nonsig")
    return F.when(sign.isNotNull() & sig.isNotNull(), F.concat_ws("_", sign, sig))


def fixed(c: Column | str, digits: int) -> Column:
    return F.when(as_col(c).isNotNull(), F.format_string(f"%.{digits}f", as_col(c).cast("double")))


def compact_number(c: Column | str, digits: int = 2) -> Column:
    """Fixed notation, scientific with one decimal when the magnitude is non-zero and below 0.01."""
    x = as_col(c).cast("double")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when((x != 0) & (F.abs(x) < 0.01), F.format_string("%.1e", x))
        .otherwise(F.format_string(f"%.{digits}f", x))
    )


def p_text(p: Column | str, digits: int = 3) -> Column:
    x = as_col(p).cast("double")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(x < 0.001, "<0.001")
        .otherwise(F.format_string(f"%.{digits}f", x))
    )


def quartile_text(med: Column, lo: Column, hi: Column, digits: int = 2) -> Column:
    f = f"%.{digits}f"
    return F.when(med.isNotNull(), F.format_string(f"{f} [{f}, {f}]", med, lo, hi))
