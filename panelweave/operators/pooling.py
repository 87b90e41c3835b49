"""Pooled second-stage models from per-cluster moments, for many specs at once.

Observations are reduced to one row per (spec, cluster) by plain sums; the variance
component is then found on those few rows, so the fit costs nothing as the rows grow.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelweave.functions.distributions import p_normal, p_student, t_two_sided
from panelweave.functions.labels import stars
from panelweave.operators.prefix import attach_units, null_safe_join, private_keys
from panelweave.session import cut_lineage

# ---- meta-regression with a random cluster intercept -----------------------------------


def cluster_moments(df: DataFrame, keys: list[str], cluster: str, y: str, v: str, flag: str) -> DataFrame:
    """Sums over one cluster with weights 1/v and regressors (1, flag), y about its mean `y_mid` in the spec."""
    rows = df.where(F.col(y).isNotNull() & (F.col(v) > 0) & F.col(flag).isNotNull())
    rows = attach_units(rows, rows.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("y_mid")), keys)
    w, x, yy = 1 / F.col(v), F.col(flag).cast("double"), F.col(y).cast("double") - F.col("y_mid")
    return rows.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("s0"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * yy).alias("sy"), F.sum(w * x * yy).alias("sxy"), F.sum(w * yy * yy).alias("syy"),
        F.sum(F.log(F.col(v))).alias("slv"), F.first("y_mid").alias("y_mid"),
    )


_FIT = StructType([StructField(c, DoubleType()) for c in ("tau2", "deviance", "b_i", "se_i", "b_f", "se_f")])
_SUMS = ["s0", "sx", "sxx", "sy", "sxy", "syy", "slv"]


def _profile(g: np.ndarray, tau2: np.ndarray, reml: bool) -> tuple[np.ndarray, ...]:
    """Normal equations summed over clusters and -2 log likelihood, for an array of tau2."""
    s0, sx, sxx, sy, sxy, syy, slv = (v[:, None] for v in g)
    c = tau2[None, :] / (1 + tau2[None, :] * s0)
    a00, a01, a11 = (s0 - c * s0 * s0).sum(0), (sx - c * s0 * sx).sum(0), (sxx - c * sx * sx).sum(0)
    b0, b1, q = (sy - c * s0 * sy).sum(0), (sxy - c * sx * sy).sum(0), (syy - c * sy * sy).sum(0)
    det = a00 * a11 - a01 * a01
    fit = (b0 * (a11 * b0 - a01 * b1) + b1 * (a00 * b1 - a01 * b0)) / det
    dev = (slv + np.log1p(tau2[None, :] * s0)).sum(0) + q - fit + (np.log(det) if reml else 0.0)
    return dev, a00, a01, a11, b0, b1, det


def _search(reml: bool):
    @F.pandas_udf(_FIT)
    def run(s0: pd.Series, sx: pd.Series, sxx: pd.Series, sy: pd.Series, sxy: pd.Series, syy: pd.Series, slv: pd.Series) -> pd.DataFrame:
        out = []
        for sums in zip(s0, sx, sxx, sy, sxy, syy, slv):
            g = np.stack([np.asarray(v, float) for v in sums])
            tot = g.sum(1)
            if not tot[0] * tot[2] - tot[1] ** 2 > 1e-12 * tot[0] * tot[2]:
                out.append([None] * 6)
                continue
            scale = max(tot[5] / tot[0] - (tot[3] / tot[0]) ** 2, 1e-12)
            grid = np.concatenate([[0.0], scale * 2.0 ** np.arange(-30, 13)])
            while np.argmin(dev := _profile(g, grid, reml)[0]) == len(grid) - 1 and np.isfinite(dev[-1]) and grid[-1] < 1e300:
                grid = np.append(grid, grid[-1] * 16)  # until the minimum is inside
            for _ in range(10):
                k = int(np.argmin(_profile(g, grid, reml)[0]))
                best, lo, hi = grid[k], grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
                grid = np.linspace(lo, hi, 25)
            dev, a00, a01, a11, b0, b1, det = (v[0] for v in _profile(g, np.array([best]), reml))
            out.append([best, dev, (a11 * b0 - a01 * b1) / det, np.sqrt(a11 / det), (a00 * b1 - a01 * b0) / det, np.sqrt(a00 / det)])
        return pd.DataFrame(out, columns=[f.name for f in _FIT.fields], dtype=float)

    return run


@private_keys
def meta_regression(
    df: DataFrame, keys: list[str], cluster: str, y: str, v: str, flag: str, method: str = "REML", p_values: bool = True
) -> DataFrame:
    """y ~ 1 + flag with known variances v and a random cluster intercept, one row per term.

    A spec becomes one row of cluster sums (as many entries as clusters). tau2 is searched
    there on a grid from zero upwards, narrowed around its best point ten times; it cannot
    fail to converge, so no fallback method is needed. `method="ML"` gives the other
    criterion. Specs whose flag does not vary give no rows.
    """
    mom = cluster_moments(df, keys, cluster, y, v, flag)
    d = mom.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*_SUMS))).alias("g"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k_cluster"), F.first("y_mid").alias("y_mid")
    )
    d = d.select(*keys, "n", "k_cluster", "y_mid", _search(method.upper() == "REML")(*[F.col(f"g.{c}") for c in _SUMS]).alias("s"))
    terms = F.array(
        F.struct(F.lit("(Intercept)").alias("term"), (F.col("s.b_i") + F.col("y_mid")).alias("estimate"), F.col("s.se_i").alias("se")),
        F.struct(F.lit(flag).alias("term"), F.col("s.b_f").alias("estimate"), F.col("s.se_f").alias("se")),
    )
    d = d.where(F.col("s.b_i").isNotNull() & ~F.isnan("s.b_i"))
    return tidy(d.select(*keys, F.inline(terms), F.col("s.tau2").alias("tau2"), "n", "k_cluster", F.col("s.deviance").alias("deviance")), p_values)


def tidy(d: DataFrame, p_values: bool = True) -> DataFrame:
    """p-value (normal) and stars per coefficient row."""
    if not p_values:
        return d
    return d.withColumn("p", p_normal(F.try_divide(F.col("estimate"), F.col("se")))).withColumn("stars", stars("p"))


def one_term(terms: DataFrame, specs: DataFrame, keys: list[str], term: str) -> DataFrame:
    """The named coefficient of every spec, NULL where the model lacks it."""
    return null_safe_join(specs.select(*keys).distinct(), terms.where(F.col("term") == term), keys, "left")


def p_with_fallback(estimate: str, se: str, df: str) -> Column:
    """t tail, else normal tail where the degrees of freedom are missing, else NULL."""
    t = F.try_divide(F.col(estimate), F.col(se))
    return F.coalesce(p_student(t, F.col(df)), p_normal(t))


# ---- fixed cluster effects plus residual heterogeneity ----------------------------------


@private_keys
def fixed_effects(
    df: DataFrame, keys: list[str], cluster: str, y: str, v: str, flag: str, levels: int = 4, points: int = 64, p_values: bool = True
) -> DataFrame:
    """y ~ 1 + flag + cluster dummies, residual variance tau2 by REML; the flag coefficient.

    For a candidate tau2 the dummies are swept out by weighted cluster means. Candidates are
    spread over each row and summed at once per (spec, candidate, cluster), so only partial
    sums are shuffled; the bracket shrinks level by level on one row per spec.
    """
    rows = df.where(F.col(y).isNotNull() & (F.col(v) > 0) & F.col(flag).isNotNull()).select(
        *keys, F.col(cluster).alias("__g"), F.col(y).cast("double").alias("__y"), F.col(v).cast("double").alias("__v"), F.col(flag).cast("double").alias("__x")
    )
    if not keys:
        return fixed_effects(df.withColumn("__spec", F.lit(0)), ["__spec"], cluster, y, v, flag, levels, points, p_values).drop("__spec")
    rows = attach_units(rows, rows.groupBy(*keys).agg(F.avg("__y").alias("__mid")), keys).withColumn("__y", F.col("__y") - F.col("__mid")).drop("__mid")
    spread = rows.groupBy(*keys).agg(F.var_pop("__y").alias("spread"), F.count(F.lit(1)).alias("n"), F.countDistinct("__g").alias("k_cluster"))
    first = F.concat(
        F.array(F.lit(0.0)),
        F.transform(F.sequence(F.lit(-24), F.lit(8)), lambda k: F.greatest("spread", F.lit(1e-12)) * F.pow(F.lit(2.0), k.cast("double"))),
    )
    # stored, so that every branch below sees bit-equal candidates
    grids = cut_lineage(spread.withColumn("grid", first))
    best = None
    for level in range(levels + 1):
        j = null_safe_join(rows, grids.select(*keys, "grid"), keys).withColumn("t", F.explode("grid")).drop("grid")
        w = 1 / (F.col("__v") + F.col("t"))
        per = j.groupBy(*keys, "t", "__g").agg(
            F.sum(w).alias("w"), F.sum(w * F.col("__x")).alias("wx"), F.sum(w * F.col("__y")).alias("wy"),
            F.sum(w * F.col("__x") * F.col("__x")).alias("wxx"), F.sum(w * F.col("__x") * F.col("__y")).alias("wxy"),
            F.sum(w * F.col("__y") * F.col("__y")).alias("wyy"), F.sum(F.log(w)).alias("lw"),
        )
        tot = per.groupBy(*keys, "t").agg(
            F.sum(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")).alias("s"),
            F.sum(F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")).alias("c"),
            F.sum(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")).alias("q"),
            F.sum("lw").alias("lw"), F.sum(F.log("w")).alias("lg"),
        ).where(F.col("s") > 0)
        dev = -F.col("lw") + F.col("lg") + F.log("s") + F.col("q") - F.col("c") * F.col("c") / F.col("s")
        best = tot.groupBy(*keys).agg(F.min(F.struct(dev.alias("d"), F.col("t"), F.col("c"), F.col("s"))).alias("m"))
        best = cut_lineage(null_safe_join(best, grids, keys))
        at = F.size(F.filter("grid", lambda g: g <= F.col("m.t")))
        lo, hi = F.get("grid", F.greatest(at - 2, F.lit(0))), F.get("grid", F.least(at, F.size("grid") - 1))
        if level < levels:
            step = (hi - lo) / points
            grids = best.select(*keys, "spread", "n", "k_cluster", F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: lo + step * k).alias("grid"))
    out = best.select(
        *keys, F.lit(flag).alias("term"), (F.col("m.c") / F.col("m.s")).alias("estimate"), (1 / F.sqrt("m.s")).alias("se"),
        F.col("m.t").alias("tau2"), "n", "k_cluster",
    )
    return tidy(out, p_values)


# ---- cluster-robust errors --------------------------------------------------------------


def _sym_root(m: np.ndarray, power: float) -> np.ndarray:
    val, vec = np.linalg.eigh((m + m.T) / 2)
    keep = val > 1e-12 * max(val.max(), 1e-300)
    return (vec[:, keep] * val[keep] ** power) @ vec[:, keep].T


@private_keys
def cluster_robust(df: DataFrame, keys: list[str], cluster: str, y: str, v: str, flag: str, fit: DataFrame) -> DataFrame:
    """Small-sample (bias-reduced) cluster errors with Satterthwaite degrees of freedom.

    Works on whitened moments: with Phi_g = diag(v) + tau2 11' the adjustment
    Phi^(1/2) (I - Xw M Xw')^(-1/2) Phi^(-1/2) acts on the two-column space of the design
    only, so a cluster of any size is represented by its 2x2 matrix Xw'Xw and the vector
    Xw'ew. `fit` is the output of `meta_regression` for the same specs.
    """
    wide = fit.groupBy(*keys).agg(
        F.max("tau2").alias("tau2"),
        F.max(F.when(F.col("term") == "(Intercept)", F.col("estimate"))).alias("b0"),
        F.max(F.when(F.col("term") == flag, F.col("estimate"))).alias("b1"),
    )
    mom = cluster_moments(df, keys, cluster, y, v, flag)
    d = null_safe_join(mom, wide, keys)
    c = F.col("tau2") / (1 + F.col("tau2") * F.col("s0"))
    s = lambda a, b, ab: F.col(ab) - c * F.col(a) * F.col(b)
    a00, a01, a11 = s("s0", "s0", "s0"), s("s0", "sx", "sx"), s("sx", "sx", "sxx")
    b0 = F.col("b0") - F.col("y_mid")  # the sums are about y_mid
    u0, u1 = s("s0", "sy", "sy") - a00 * b0 - a01 * F.col("b1"), s("sx", "sy", "sxy") - a01 * b0 - a11 * F.col("b1")
    d = d.select(*keys, cluster, a00.alias("a00"), a01.alias("a01"), a11.alias("a11"), u0.alias("u0"), u1.alias("u1"), "b0", "b1")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema.fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack([np.array([[r.a00, r.a01], [r.a01, r.a11]]) for r in pdf.itertuples()])
        u = pdf[["u0", "u1"]].to_numpy()
        total = a.sum(axis=0)
        if not np.linalg.det(total) > 1e-12 * total[0, 0] * total[1, 1]:  # the flag does not vary
            return pd.DataFrame({**{k: [] for k in keys}, "term": [], "estimate": [], "se": [], "df": [], "p": []})
        m = np.linalg.inv(total)
        root, inv_root = [], []
        for g in range(len(a)):
            # nonzero block of I - Xw M Xw' in the basis of the columns of Xw
            h = _sym_root(a[g], 0.5)
            core = np.eye(2) - h @ m @ h
            pinv = _sym_root(a[g], -0.5)
            # Xw'(I - Xw M Xw')^(-1/2) = h core^(-1/2) h^+ Xw'
            t = h @ _sym_root(core, -0.5) @ pinv
            root.append(t)
            inv_root.append(t @ u[g])
        meat = sum(np.outer(q, q) for q in inv_root)
        cov = m @ meat @ m
        out = []
        for j, (name, b) in enumerate((("(Intercept)", pdf.b0.iloc[0]), (flag, pdf.b1.iloc[0]))):
            # quadratic form in whitened errors: p_g = (I-H)' Xw_g t_g' m_j
            # their products are diag(own) - side m side', whose trace and squares need sums only
            vec = np.stack([root[g].T @ m[j] for g in range(len(a))])
            side = np.einsum("gij,gj->gi", a, vec)
            own = np.einsum("gi,gi->g", vec, side)
            cross = m @ (side.T @ side)
            squares = np.sum(own**2) - 2 * np.sum(own * np.einsum("gi,ij,gj->g", side, m, side)) + np.trace(cross @ cross)
            dof = (own.sum() - np.trace(cross)) ** 2 / squares
            se = np.sqrt(cov[j, j])
            out.append((name, b, se, dof, float(t_two_sided(np.array([b / se]), np.array([dof]))[0])))
        res = pd.DataFrame(out, columns=["term", "estimate", "se", "df", "p"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "term", "estimate", "se", "df", "p"]]

    schema = f"{ddl}term string, estimate double, se double, df double, p double"
    return (d.groupBy(*keys) if keys else d.groupBy(F.lit(0))).applyInPandas(solve, schema)


# ---- weighted mixed model ---------------------------------------------------------------


def _mixed_block(a: np.ndarray, b: np.ndarray, q: np.ndarray, s: np.ndarray, sy: np.ndarray, s0: np.ndarray, slv: float, n: int) -> dict:
    """Profile REML of theta = tau2/sigma2 on cluster moments, then errors and t degrees of freedom."""
    p = a.shape[1]

    def at(theta: float):
        c = theta / (1 + theta * s0)
        aa = a.sum(0) - np.einsum("g,gi,gj->ij", c, s, s)
        bb = b.sum(0) - np.einsum("g,gi,g->i", c, s, sy)
        qq = q.sum() - (c * sy * sy).sum()
        beta = np.linalg.solve(aa, bb)
        rss = qq - bb @ beta
        dev = slv + np.log1p(theta * s0).sum() + np.linalg.slogdet(aa)[1] + (n - p) * np.log(max(rss, 1e-300))
        return dev, beta, rss, aa

    base = 1 / max(s0.mean(), 1e-300)
    grid = np.concatenate([[0.0], base * 2.0 ** np.arange(-30, 31)])
    for _ in range(14):
        dev = [at(t)[0] for t in grid]
        k = int(np.argmin(dev))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        best = grid[k]
        grid = np.linspace(lo, hi, 17)
    _, beta, rss, aa = at(best)
    sigma2 = rss / (n - p)
    cov = sigma2 * np.linalg.inv(aa)

    def full_dev(tau2: float, sig2: float) -> float:
        th = tau2 / sig2
        d, _, r, m = at(th)
        # unprofiled criterion
        return d - (n - p) * np.log(max(r, 1e-300)) + (n - p) * np.log(sig2) + r / sig2

    def var_of(tau2: float, sig2: float) -> np.ndarray:
        return np.diag(sig2 * np.linalg.inv(at(tau2 / sig2)[3]))

    par = np.array([best * sigma2, sigma2])
    # a component on the boundary carries no information about the errors
    free = [0, 1] if best > 1e-8 * base else [1]
    h = np.maximum(np.abs(par), 1e-8 * sigma2) * 1e-3

    def shift(i, d, base_par):
        z = base_par.copy()
        z[i] += d
        return z

    hess = np.zeros((len(free), len(free)))
    for x, i in enumerate(free):
        for z, j in enumerate(free):
            f = lambda di, dj: full_dev(*shift(j, dj, shift(i, di, par)))
            hess[x, z] = (f(h[i], h[j]) - f(h[i], -h[j]) - f(-h[i], h[j]) + f(-h[i], -h[j])) / (4 * h[i] * h[j])
    grad = np.stack([(var_of(*shift(i, h[i], par)) - var_of(*shift(i, -h[i], par))) / (2 * h[i]) for i in free], axis=1)
    dof = np.full(p, np.nan)
    try:
        acov = 2 * np.linalg.inv(hess)
        den = np.einsum("ki,ij,kj->k", grad, acov, grad)
        with np.errstate(divide="ignore", invalid="ignore"):
            dof = np.where(den > 0, 2 * np.diag(cov) ** 2 / den, np.nan)
    except np.linalg.LinAlgError:
        pass
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "df": dof, "tau2": best * sigma2, "sigma2": sigma2}


@private_keys
def mixed_model(df: DataFrame, keys: list[str], cluster: str, y: str, terms: list[str], w: str = "weights", p_values: bool = True) -> DataFrame:
    """Weighted y ~ 1 + terms with a random cluster intercept, REML, one row per term.

    The rows are summed per (spec, cluster); a spec's clusters are then solved together. A
    spec that cannot be estimated yields one row with status "failed" and the reason.
    """
    names = ["(Intercept)", *terms]
    p = len(names)
    z = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    wt, yy = F.col(w).cast("double"), F.col(y).cast("double")
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [y, w, *terms]]) & (wt > 0))
    up = [(i, j) for i in range(p) for j in range(i, p)]
    mom = rows.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(wt * yy).alias("sy"), F.sum(wt * yy * yy).alias("syy"), F.sum(-F.log(wt)).alias("slv"),
        F.array(*[F.sum(wt * z[i]) for i in range(p)]).alias("s"),
        F.array(*[F.sum(wt * z[i] * z[j]) for i, j in up]).alias("a"),
        F.array(*[F.sum(wt * z[i] * yy) for i in range(p)]).alias("b"),
    )
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in mom.select(*keys).schema.fields)
    cols = [*keys, "term", "estimate", "se", "df", "tau2", "sigma2", "n", "k_cluster", "status", "error"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        tail = {"n": n, "k_cluster": len(pdf)}
        try:
            a = np.zeros((len(pdf), p, p))
            for g, v in enumerate(pdf["a"]):
                for (i, j), val in zip(up, v):
                    a[g, i, j] = a[g, j, i] = val
            tot = a.sum(0)
            if n <= p or np.linalg.matrix_rank(tot / np.sqrt(np.outer(np.diag(tot), np.diag(tot)) + 1e-300)) < p:
                raise ValueError("design is rank deficient")
            r = _mixed_block(a, np.stack(pdf["b"].to_list()), pdf["syy"].to_numpy(), np.stack(pdf["s"].to_list()), pdf["sy"].to_numpy(), np.array([v[0] for v in pdf["s"]]), float(pdf["slv"].sum()), n)
            out = pd.DataFrame({"term": names, "estimate": r["beta"], "se": r["se"], "df": r["df"], "tau2": r["tau2"], "sigma2": r["sigma2"], **tail, "status": "ok", "error": None})
        except Exception as exc:  # one bad spec must not end the sweep
            out = pd.DataFrame({"term": [None], "estimate": [np.nan], "se": [np.nan], "df": [np.nan], "tau2": [np.nan], "sigma2": [np.nan], **tail, "status": ["failed"], "error": [str(exc)]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[cols]

    schema = f"{ddl}term string, estimate double, se double, df double, tau2 double, sigma2 double, n bigint, k_cluster bigint, status string, error string"
    out = mom.groupBy(*keys).applyInPandas(solve, schema)
    for c in ("estimate", "se", "df", "tau2", "sigma2"):
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return out.withColumn("p", p_with_fallback("estimate", "se", "df")) if p_values else out
