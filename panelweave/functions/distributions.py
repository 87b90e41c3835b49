"""Tail probabilities Spark has no function for, as vectorised pandas UDFs.

They run on result rows (one per unit or model term), never on observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta, continued fraction by the modified Lentz rule."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.clip(np.where(flip, 1 - x, x), 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0) | (z >= 1), 0.0, front)
    floor = 1e-300
    frac, c, d = np.ones_like(z), np.ones_like(z), np.zeros_like(z)
    for step in range(400):
        m = step // 2
        if step == 0:
            coef = np.ones_like(z)
        elif step % 2 == 0:
            coef = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            coef = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / np.where(np.abs(1 + coef * d) < floor, floor, 1 + coef * d)
        c = 1 + coef / np.where(np.abs(c) < floor, floor, c)
        c = np.where(np.abs(c) < floor, floor, c)
        frac = frac * c * d
        if step > 4 and np.all(np.abs(1 - c * d) < 1e-15):
            break
    tail = front * (frac - 1)
    tail = np.where(z >= 1, 1.0, tail)
    return np.where(flip, 1 - tail, tail)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    safe_df = np.where(ok, df, 1.0)
    safe_t = np.where(ok, t, 0.0)
    with np.errstate(over="ignore"):
        x = safe_df / (safe_df + safe_t * safe_t)
    return np.where(ok, beta_inc(safe_df / 2, np.full_like(safe_df, 0.5), x), np.nan)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile of Student's t for p > 0.5, by bisection on the two-sided tail."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1.0)
    target = 2 * (1 - p)
    for _ in range(200):
        grow = t_two_sided(hi, df) > target
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(df > 0, (lo + hi) / 2, np.nan)


_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


def studentised_range_tail(q: float, k: int, df: float) -> float:
    """P(range of k normals / independent chi scale > q), double Gauss-Legendre quadrature."""
    if not (np.isfinite(q) and df > 0):
        return float("nan")
    if q <= 0:
        return 1.0
    z = 8.5 * _GL_X
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = 1 - 0.5 * _erfc(z / math.sqrt(2))

    def range_cdf(w: np.ndarray) -> np.ndarray:
        upper = 1 - 0.5 * _erfc((z[None, :] + w[:, None]) / math.sqrt(2))
        inner = np.clip(upper - cdf[None, :], 0, 1) ** (k - 1)
        return k * 8.5 * (inner * phi[None, :] * _GL_W[None, :]).sum(axis=1)

    # scale s = chi/sqrt(df): density concentrated around 1 with spread 1/sqrt(2 df)
    half = min(1.0, 9.0 / math.sqrt(2 * df))
    top = 1 + max(half, 9.0 / math.sqrt(2 * df))
    edges = np.linspace(1 - half, top, 9)
    total = 0.0
    log_c = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    for a, b in zip(edges[:-1], edges[1:]):
        s = (a + b) / 2 + (b - a) / 2 * _GL_X
        with np.errstate(divide="ignore"):
            dens = np.exp(log_c + (df - 1) * np.log(s) - df * s * s / 2)
        total += (b - a) / 2 * float((_GL_W * dens * range_cdf(q * s)).sum())
    return float(min(max(1 - total, 0.0), 1.0))


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    out = pd.Series(normal_two_sided(z.to_numpy(dtype=float, na_value=np.nan)), index=z.index)
    return out.where(z.notna(), None)


@F.pandas_udf(DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    v = t_two_sided(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan))
    out = pd.Series(v, index=t.index)
    return out.where(out.notna(), None)


@F.pandas_udf(DoubleType())
def q_student(p: pd.Series, df: pd.Series) -> pd.Series:
    d = df.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(len(d), np.nan)
    for level in p.dropna().unique():
        sel = (p == level).to_numpy() & np.isfinite(d)
        if sel.any():
            out[sel] = t_quantile(float(level), d[sel])
    s = pd.Series(out, index=p.index)
    return s.where(s.notna(), None)


@F.pandas_udf(DoubleType())
def p_studentised_range(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(
        [
            studentised_range_tail(float(a), int(b), float(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c) else np.nan
            for a, b, c in zip(q, k, df)
        ],
        index=q.index,
        dtype=float,
    )
    return out.where(out.notna(), None)
