"""Regression per unit as grouped moments: least squares with robust errors, and Huber fits.

A unit can hold any share of the rows: rows only ever meet one-row-per-unit tables and
partial sums, and small matrices are solved on the unit rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from panelweave.functions.distributions import p_student
from panelweave.operators.prefix import TASK_ROWS, attach_units, exact_quantiles, null_safe_join
from panelweave.session import cut_lineage

# Leverage counted as one, Huber tuning constant, scale constant, step tolerance.
LEVERAGE_ONE = 0.999999
HUBER_K = 1.345
MAD_SCALE = 0.6745
HUBER_TOL = 1e-4


def unit_trends(df: DataFrame, keys: list[str], y: str, x: str, w: str | None = None, p_values: bool = True) -> DataFrame:
    """Intercept-only mean and slope on x per unit, HC3 errors (HC1 where a leverage is one).

    beta_0 is the mean of the intercept-only model; p_1 is NULL with three or fewer distinct x.
    Weighted sums are taken about the unit's plain means, so a far origin loses no digits.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(
        *keys, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"), (F.col(w) if w else F.lit(1.0)).cast("double").alias("__w")
    )
    if w is None:
        rows = rows.withColumn("__cy", F.lit(0.0))
    else:
        centre = rows.groupBy(*keys).agg(F.avg("__x").alias("__cx"), F.avg("__y").alias("__cy"))
        rows = attach_units(rows, centre, keys).select(*keys, (F.col("__y") - F.col("__cy")).alias("__y"), (F.col("__x") - F.col("__cx")).alias("__x"), "__w", "__cy")
    X, Y, Wt = F.col("__x"), F.col("__y"), F.col("__w")
    n = F.count(F.lit(1))
    if w is None:
        first = [F.avg(X).alias("__xb"), F.avg(Y).alias("__yb"), n.cast("double").alias("__sw"), (F.var_pop(X) * n).alias("__sxx"), (F.covar_pop(X, Y) * n).alias("__sxy")]
    else:
        sw = F.sum(Wt)
        first = [
            (F.sum(Wt * X) / sw).alias("__xb"),
            (F.sum(Wt * Y) / sw).alias("__yb"),
            sw.alias("__sw"),
            (F.sum(Wt * X * X) - F.pow(F.sum(Wt * X), 2) / sw).alias("__sxx"),
            (F.sum(Wt * X * Y) - F.sum(Wt * X) * F.sum(Wt * Y) / sw).alias("__sxy"),
        ]
    per = rows.groupBy(*keys).agg(n.alias("n"), *first, F.min(X).alias("__mn"), F.max(X).alias("__mx"), F.first("__cy").alias("__cy"))
    per = per.withColumn("__b1", F.when(F.col("__mx") > F.col("__mn"), F.col("__sxy") / F.col("__sxx")))
    j = attach_units(rows.drop("__cy"), per, keys)
    e0, h0 = Y - F.col("__yb"), Wt / F.col("__sw")
    dx = X - F.col("__xb")
    e1, h1 = e0 - F.col("__b1") * dx, Wt * (1 / F.col("__sw") + F.try_divide(dx * dx, F.col("__sxx")))
    room = lambda h: F.when(1 - h > 1e-12, 1 - h)
    inner = (X > F.col("__mn")) & (X < F.col("__mx"))
    sums = j.groupBy(*keys, "n", "__sw", "__yb", "__cy", "__b1", "__sxx").agg(
        F.sum(F.pow(Wt * e0 / room(h0), 2)).alias("__a3"),
        F.sum(F.pow(Wt * e0, 2)).alias("__a1"),
        F.max(h0).alias("__h0"),
        F.sum(F.pow(Wt * dx * e1 / room(h1), 2)).alias("__c3"),
        F.sum(F.pow(Wt * dx * e1, 2)).alias("__c1"),
        F.max(h1).alias("__h1"),
        F.min(F.when(inner, X)).alias("__i0"),
        F.max(F.when(inner, X)).alias("__i1"),
    )
    N = F.col("n")
    v0 = F.when(1 - F.col("__h0") > 1e-12, F.col("__a3")).otherwise(F.col("__a1") * F.try_divide(N, N - 1))
    v1 = F.when(1 - F.col("__h1") > 1e-12, F.col("__c3")).otherwise(F.col("__c1") * F.when(N > 2, N / (N - 2)))
    few = F.col("__i0").isNull() | (F.col("__i0") == F.col("__i1"))
    out = sums.select(
        *keys,
        "n",
        (F.col("__yb") + F.col("__cy")).alias("beta_0"),
        (F.sqrt(v0) / F.col("__sw")).alias("se_0"),
        F.col("__b1").alias("beta_1"),
        F.when(F.col("__b1").isNotNull(), F.sqrt(v1) / F.col("__sxx")).alias("se_1"),
        (F.col("__h0") >= LEVERAGE_ONE).alias("warn_hat_0"),
        F.coalesce(F.col("__h1") >= LEVERAGE_ONE, F.lit(False)).alias("warn_hat_1"),
        F.lit(False).alias("warn_singular_0"),
        F.col("__b1").isNull().alias("warn_singular_1"),
        few.alias("few_x"),
    )
    return with_p_values(out, "n", 1, 2) if p_values else out


def with_p_values(out: DataFrame, n: str, k0: int, k1: int) -> DataFrame:
    t = lambda i: F.try_divide(F.col(f"beta_{i}"), F.col(f"se_{i}"))
    return out.withColumn("p_0", p_student(t(0), (F.col(n) - k0).cast("double"))).withColumn(
        "p_1", p_student(F.when(~F.col("few_x"), t(1)), (F.col(n) - k1).cast("double"))
    )


def attach_descriptors(trends: DataFrame, wells: DataFrame, units: DataFrame, keys: list[str], river: str) -> DataFrame:
    """Unit descriptors and the share of river-border rows (missing if any row misses the flag)."""
    from panelweave.functions.nulls import strict_avg

    share = wells.groupBy(*keys).agg(strict_avg(F.col(river).cast("double")).alias(river))
    return null_safe_join(null_safe_join(trends, units, keys, "left"), share, keys, "left")


# ---- general design matrices -----------------------------------------------------------

_SOLVED = StructType(
    [
        StructField("beta", ArrayType(DoubleType())),
        StructField("ginv", ArrayType(DoubleType())),
        StructField("rank", IntegerType()),
    ]
)


@F.pandas_udf(_SOLVED)
def _solve(gram: pd.Series, rhs: pd.Series) -> pd.DataFrame:
    """Solve the (few-by-few) normal equations per unit; dependent later columns get no weight."""
    beta, ginv, rank = [], [], []
    for g, r in zip(gram, rhs):
        b = np.asarray(r, float)
        p = len(b)
        a = np.asarray(g, float).reshape(p, p)
        keep: list[int] = []
        for j in range(p):
            d = a[j, j]
            if not d > 0:
                continue
            if keep:
                s = np.linalg.solve(a[np.ix_(keep, keep)], a[keep, j])
                d = a[j, j] - a[keep, j] @ s
            if d > 1e-10 * a[j, j]:
                keep.append(j)
        inv = np.zeros((p, p))
        if keep:
            inv[np.ix_(keep, keep)] = np.linalg.inv(a[np.ix_(keep, keep)])
        beta.append((inv @ b).tolist())
        ginv.append(inv.ravel().tolist())
        rank.append(len(keep))
    return pd.DataFrame({"beta": beta, "ginv": ginv, "rank": rank})


def moment_fit(rows: DataFrame, keys: list[str], z: list[Column], y: Column, w: Column) -> DataFrame:
    """beta, ginv = (Z'WZ)^-1 (flattened), rank, n per unit, from one grouped pass."""
    p = len(z)
    up = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(w * z[i] * z[j]).alias(f"__g{i}_{j}") for i, j in up],
        *[F.sum(w * z[i] * y).alias(f"__r{i}") for i in range(p)],
    )
    gram = F.array(*[F.col(f"__g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    rhs = F.array(*[F.col(f"__r{i}") for i in range(p)])
    return sums.select(*keys, "n", _solve(gram, rhs).alias("__s")).select(*keys, "n", "__s.beta", "__s.ginv", "__s.rank")


def _dot(z: list[Column], arr: Column, base: int = 0) -> Column:
    out = z[0] * arr[base]
    for i in range(1, len(z)):
        out = out + z[i] * arr[base + i]
    return out


def _prepare(df: DataFrame, keys: list[str], y: str, x: str, covs: list[str], w: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows complete on the usable covariates of their unit, covariates and x standardised.

    A covariate that is absent or constant in a unit is switched off there (set to zero).
    """
    base = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(
        *keys,
        F.col(y).cast("double").alias("__y"),
        F.col(x).cast("double").alias("__x"),
        *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(covs)],
        (F.col(w) if w else F.lit(1.0)).alias("__w"),
    )
    names = ["__x", *[f"__c{i}" for i in range(len(covs))]]
    stats = base.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names],
        *[(F.max(c) > F.min(c)).alias(f"{c}_on") for c in names],
    )
    for c in names:
        stats = stats.withColumn(f"{c}_on", F.coalesce(F.col(f"{c}_on"), F.lit(False)))
    stats = cut_lineage(stats)
    j = attach_units(base, stats, keys, written=True)
    for c in names[1:]:
        j = j.where(~F.col(f"{c}_on") | F.col(c).isNotNull())
    for c in names:
        j = j.withColumn(c, F.when(F.col(f"{c}_on"), (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(0.0))
    return j.drop(*[f"{c}_{t}" for c in names for t in ("m", "s", "on")]), stats


def covariate_trends(df: DataFrame, keys: list[str], y: str, x: str, covs: list[str], w: str | None = None, p_values: bool = True) -> DataFrame:
    """`unit_trends` with extra covariates in both models (per-unit unusable ones left out)."""
    rows, stats = _prepare(df, keys, y, x, covs, w)
    cs = [f"__c{i}" for i in range(len(covs))]
    result = None
    for tag, names in (("0", cs), ("1", ["__x", *cs])):
        z = [F.lit(1.0), *[F.col(c) for c in names]]
        p = len(z)
        fit = moment_fit(rows, keys, z, F.col("__y"), F.col("__w"))
        # the coefficient wanted is `pick . beta`: undo the standardisation
        fit = null_safe_join(fit, stats, keys)
        if tag == "0":
            pick = [F.lit(1.0), *[F.when(F.col(f"{c}_on"), -F.col(f"{c}_m") / F.col(f"{c}_s")).otherwise(0.0) for c in names]]
        else:
            pick = [F.lit(0.0), F.when(F.col("__x_on"), 1 / F.col("__x_s")).otherwise(0.0), *[F.lit(0.0)] * (p - 2)]
        k = F.lit(1) + sum((F.col(f"{c}_on").cast("int") for c in names), F.lit(0))
        fit = fit.select(
            *keys,
            "n",
            "beta",
            "ginv",
            k.alias("__k"),
            _dot(pick, F.col("beta")).alias("__b"),
            F.array(*[_dot(pick, F.col("ginv"), i * p) for i in range(p)]).alias("__g"),
            ((F.lit(True) if tag == "0" else F.col("__x_on") & (F.col("ginv")[p + 1] > 0))).alias("__ok"),
        )
        j = attach_units(rows, fit, keys)
        e = F.col("__y") - _dot(z, F.col("beta"))
        h = F.col("__w") * _dot([_dot(z, F.col("ginv"), i * p) for i in range(p)], F.array(*z))
        j = j.withColumn("__h", h).withColumn("__m", F.col("__w") * e * _dot(z, F.col("__g")))
        agg = j.groupBy(*keys).agg(
            F.first("n").alias(f"n_{tag}"),
            F.first("__k").alias(f"__k_{tag}"),
            F.first("__ok").alias("__ok"),
            F.first("__b").alias("__b"),
            F.sum(F.pow(F.col("__m") / F.when(1 - F.col("__h") > 1e-12, 1 - F.col("__h")), 2)).alias("__v3"),
            F.sum(F.pow("__m", F.lit(2))).alias("__v1"),
            F.max("__h").alias("__hm"),
        )
        N, K = F.col(f"n_{tag}"), F.col(f"__k_{tag}")
        v = F.when(1 - F.col("__hm") > 1e-12, F.col("__v3")).otherwise(F.col("__v1") * F.when(N > K, N / (N - K)))
        part = agg.select(
            *keys,
            N,
            K,
            F.when(F.col("__ok"), F.col("__b")).alias(f"beta_{tag}"),
            F.when(F.col("__ok"), F.sqrt(v)).alias(f"se_{tag}"),
            (F.col("__hm") >= LEVERAGE_ONE).alias(f"warn_hat_{tag}"),
        )
        result = part if result is None else null_safe_join(result, part, keys)
    result = null_safe_join(result, distinct_x_guard(df, keys, y, x), keys)
    out = result.withColumn("n", F.col("n_1"))
    if p_values:
        for i in (0, 1):
            t = F.try_divide(F.col(f"beta_{i}"), F.col(f"se_{i}"))
            t = F.when(~F.col("few_x"), t) if i else t
            out = out.withColumn(f"p_{i}", p_student(t, (F.col("n") - F.col(f"__k_{i}")).cast("double")))
    return out.drop("n_0", "n_1", "__k_0", "__k_1")


def distinct_x_guard(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """few_x: three or fewer distinct x, found from extremes and inner extremes."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    ends = d.groupBy(*keys).agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    inner = (F.col("__x") > F.col("__mn")) & (F.col("__x") < F.col("__mx"))
    g = attach_units(d, ends, keys).groupBy(*keys).agg(
        F.min(F.when(inner, F.col("__x"))).alias("a"), F.max(F.when(inner, F.col("__x"))).alias("b")
    )
    return g.select(*keys, (F.col("a").isNull() | (F.col("a") == F.col("b"))).alias("few_x"))


# ---- Huber -----------------------------------------------------------------------------


def _huber_block(z: np.ndarray, y: np.ndarray, maxit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Iteratively reweighted fit of one small unit: coefficients, errors, convergence."""
    n, p = z.shape
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    res = y - z @ beta
    weight, scale, ok = np.ones(n), 0.0, False
    for _ in range(maxit):
        scale = np.median(np.abs(res)) / MAD_SCALE
        if scale == 0:
            ok = True
            break
        u = np.abs(res) / scale
        weight = np.minimum(1.0, HUBER_K / np.maximum(u, 1e-300))
        sw = np.sqrt(weight)
        beta = np.linalg.lstsq(z * sw[:, None], y * sw, rcond=None)[0]
        new = y - z @ beta
        move = np.sqrt(((res - new) ** 2).sum() / max(1e-20, (res**2).sum()))
        res = new
        if move <= HUBER_TOL:
            ok = True
            break
    if scale == 0 or n <= p:
        return beta, np.full(p, np.nan), ok
    m = np.mean(np.abs(res) / scale <= HUBER_K)
    if m == 0:
        return beta, np.full(p, np.nan), ok
    kappa = 1 + p * (m * (1 - m) * n / (n - 1)) / (n * m * m)
    sd = np.sqrt(((res * weight) ** 2).sum() / (n - p)) * kappa / m
    return beta, sd * np.sqrt(np.diag(np.linalg.inv(z.T @ z))), ok


def huber_trends(
    df: DataFrame, keys: list[str], y: str, x: str, covs: list[str] | None = None, maxit: int = 50, block_rows: int = TASK_ROWS, p_values: bool = True
) -> DataFrame:
    """Robust twin of `unit_trends`.

    Units of at most `block_rows` rows are fitted as blocks inside tasks; larger ones go
    through the same iterations as grouped sums over all their rows, so size is no limit.
    Which columns depend on others is decided for all units alike, from grouped sums.
    `df` is read many times and should be a written table.
    """
    covs = list(covs or [])
    rows, stats = _prepare(df, keys, y, x, covs, None)
    for tag, names in (("0", []), ("1", ["__x"])):
        z = [F.lit(1.0), *[F.col(c) for c in [*names, *[f"__c{i}" for i in range(len(covs))]]]]
        fit = moment_fit(rows, keys, z, F.col("__y"), F.lit(1.0))
        used = F.array(*[(F.col("ginv")[i * len(z) + i] > 0) for i in range(len(z))])
        stats = null_safe_join(stats, fit.select(*keys, used.alias(f"__used_{tag}")), keys)
    stats = cut_lineage(stats)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sizes = cut_lineage(sizes)
    sized = attach_units(rows, sizes, keys, written=True)
    cs = [f"__c{i}" for i in range(len(covs))]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def block(pdf: pd.DataFrame, unit: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[f.split()[0].strip("`") for f in schema.split(", ")])
        out = {k: [unit[k].iloc[0]] for k in keys}
        out["n"] = [len(pdf)]
        yv = pdf["__y"].to_numpy()
        one = np.ones(len(pdf))
        for tag, names in (("0", cs), ("1", ["__x", *cs])):
            full = np.column_stack([one, *[pdf[c].to_numpy() for c in names]])
            keep = [i for i, on in enumerate(unit[f"__used_{tag}"].iloc[0]) if on]
            beta, se, ok = np.zeros(full.shape[1]), np.full(full.shape[1], np.nan), False
            b, s, ok = _huber_block(full[:, keep], yv, maxit)
            beta[keep] = b
            pick = np.zeros(full.shape[1])
            if tag == "0":
                pick[0] = 1.0
                for i, c in enumerate(cs):
                    if unit[f"{c}_on"].iloc[0]:
                        pick[1 + i] = -unit[f"{c}_m"].iloc[0] / unit[f"{c}_s"].iloc[0]
                usable = True
            else:
                usable = bool(unit["__x_on"].iloc[0]) and 1 in keep
                pick[1] = 1 / unit["__x_s"].iloc[0] if usable else 0.0
            zk = full[:, keep]
            inv = np.linalg.inv(zk.T @ zk)
            unit_sd = s[0] / np.sqrt(inv[0, 0])
            se_v = unit_sd * np.sqrt(pick[keep] @ inv @ pick[keep])
            out[f"beta_{tag}"] = [float(pick @ beta) if usable else None]
            out[f"se_{tag}"] = [float(se_v) if usable and np.isfinite(se_v) else None]
            out[f"converged_{tag}"] = [bool(ok)]
            out[f"df_{tag}"] = [len(pdf) - len(keep)]
        return pd.DataFrame(out)

    schema = f"{key_types}, n bigint, beta_0 double, se_0 double, converged_0 boolean, df_0 bigint, beta_1 double, se_1 double, converged_1 boolean, df_1 bigint"
    few = sized.where(F.col("__n") <= block_rows).drop("__n", "__w")  # what a task holds: keys and numbers, a unit's statistics once
    small = few.groupBy(*keys).cogroup(stats.groupBy(*keys)).applyInPandas(block, schema)
    if sizes.where(F.col("__n") > block_rows).isEmpty():
        out = small
    else:
        big = _huber_distributed(sized.where(F.col("__n") > block_rows), stats, keys, cs, maxit)
        out = small.unionByName(big.select(*small.columns))
    out = null_safe_join(out, distinct_x_guard(df, keys, y, x), keys)
    if p_values:
        for i in (0, 1):
            t = F.try_divide(F.col(f"beta_{i}"), F.col(f"se_{i}"))
            t = F.when(~F.col("few_x"), t) if i else t
            out = out.withColumn(f"p_{i}", p_student(t, F.col(f"df_{i}").cast("double")))
    return out.drop("df_0", "df_1")


def _huber_distributed(rows: DataFrame, stats: DataFrame, keys: list[str], cs: list[str], maxit: int) -> DataFrame:
    result = None
    for tag, names in (("0", cs), ("1", ["__x", *cs])):
        z = [F.lit(1.0), *[F.col(c) for c in names]]
        p = len(z)
        ols = moment_fit(rows, keys, z, F.col("__y"), F.lit(1.0))
        state = cut_lineage(
            ols.select(*keys, "n", "rank", "ginv", "beta", F.col("beta").alias("used"), F.lit(0.0).alias("scale"), F.lit(False).alias("done"), F.lit(False).alias("conv"))
        )
        for _ in range(maxit):
            live = state.where(~F.col("done"))
            if live.isEmpty():
                break
            j = attach_units(rows, live.select(*keys, "beta"), keys, written=True).withColumn("__r", F.col("__y") - _dot(z, F.col("beta")))
            med = exact_quantiles(j.withColumn("__ar", F.abs("__r")), keys, "__ar", [0.5]).select(
                *keys, (F.col("q")[0] / MAD_SCALE).alias("__s")
            )
            j = attach_units(j, med, keys)
            wt = F.when(F.col("__s") > 0, F.least(F.lit(1.0), F.try_divide(F.lit(HUBER_K) * F.col("__s"), F.abs("__r")))).otherwise(1.0)
            fit = moment_fit(j.withColumn("__hw", F.coalesce(wt, F.lit(1.0))), keys, z, F.col("__y"), F.col("__hw")).select(
                *keys, F.col("beta").alias("__nb")
            )
            step = null_safe_join(null_safe_join(live.drop("used", "scale"), med, keys), fit, keys)
            gap = attach_units(
                rows, step.select(*keys, "beta", "__nb"), keys
            ).groupBy(*keys).agg(
                F.sum(F.pow(_dot(z, F.col("__nb")) - _dot(z, F.col("beta")), 2)).alias("__d"),
                F.sum(F.pow(F.col("__y") - _dot(z, F.col("beta")), 2)).alias("__t"),
            )
            step = null_safe_join(step, gap, keys)
            flat = F.col("__s") == 0
            close = F.sqrt(F.col("__d") / F.greatest(F.col("__t"), F.lit(1e-20))) <= HUBER_TOL
            new = step.select(
                *keys, "n", "rank", "ginv",
                F.when(flat, F.col("beta")).otherwise(F.col("__nb")).alias("beta"),
                F.col("beta").alias("used"),
                F.col("__s").alias("scale"),
                (flat | close).alias("done"),
                (flat | close).alias("conv"),
            )
            state = cut_lineage(state.where("done").unionByName(new))
        j = attach_units(rows, state, keys, written=True)
        r_new, r_old = F.col("__y") - _dot(z, F.col("beta")), F.col("__y") - _dot(z, F.col("used"))
        wt = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(HUBER_K) * F.col("scale"), F.abs(r_old))), F.lit(1.0))
        sums = j.groupBy(*keys).agg(
            F.sum(F.pow(r_new * wt, 2)).alias("__ss"),
            F.avg((F.abs(r_new) <= F.lit(HUBER_K) * F.col("scale")).cast("double")).alias("__m"),
        )
        f = null_safe_join(null_safe_join(state, sums, keys), stats, keys)
        n, k, m = F.col("n"), F.col("rank"), F.col("__m")
        kappa = 1 + k * (m * (1 - m) * n / (n - 1)) / (n * m * m)
        sd = F.when((F.col("scale") > 0) & (m > 0) & (n > k), F.sqrt(F.col("__ss") / (n - k)) * kappa / m)
        if tag == "0":
            pick = [F.lit(1.0), *[F.when(F.col(f"{c}_on"), -F.col(f"{c}_m") / F.col(f"{c}_s")).otherwise(0.0) for c in cs]]
            usable = F.lit(True)
        else:
            pick = [F.lit(0.0), F.when(F.col("__x_on"), 1 / F.col("__x_s")).otherwise(0.0), *[F.lit(0.0)] * (p - 2)]
            usable = F.col("__x_on") & (F.col("ginv")[p + 1] > 0)
        quad = _dot([_dot(pick, F.col("ginv"), i * p) for i in range(p)], F.array(*pick))
        cols = [
            F.when(usable, _dot(pick, F.col("beta"))).alias(f"beta_{tag}"),
            F.when(usable, sd * F.sqrt(quad)).alias(f"se_{tag}"),
            F.col("conv").alias(f"converged_{tag}"),
            (n - k).cast("bigint").alias(f"df_{tag}"),
        ]
        part = f.select(*keys, *([n.alias("n")] if tag == "0" else []), *cols)
        result = part if result is None else null_safe_join(result, part, keys)
    return result
