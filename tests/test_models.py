"""Fits against dense textbook formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import matching, pooling, summaries, trends


def dense_lm(X, y, w):
    A = np.linalg.inv((X * w[:, None]).T @ X)
    b = A @ (X.T @ (w * y))
    e = y - X @ b
    h = w * np.einsum("ij,jk,ik->i", X, A, X)
    return b, e, h, A


def hc(X, y, w, kind):
    b, e, h, A = dense_lm(X, y, w)
    n, k = X.shape
    s = (w * e) ** 2 / (1 - h) ** 2 if kind == 3 else (w * e) ** 2 * n / (n - k)
    return b, np.sqrt(np.diag(A @ ((X * s[:, None]).T @ X) @ A))


def test_weighted_fit_and_guards(spark):
    rng = np.random.default_rng(0)
    n = 30
    x, y, w = rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 2, n)
    rows = [("a", float(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    rows += [("lev", 0.0, float(v), 1.0) for v in (1.0, 2.0, 4.0)] + [("lev", 9.0, 5.0, 1.0)]  # one point of leverage one
    rows += [("one", 1.0, 2.0, 1.0), ("gap", None, 1.0, 1.0), ("gap", 1.0, None, 1.0), ("flat", 1.0, 2.0, 1.0), ("flat", 1.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "u string, x double, y double, w double")
    got = {r.u: r for r in trends.unit_trends(df, ["u"], "y", "x", "w").collect()}
    X = np.column_stack([np.ones(n), x])
    b, se = hc(X, y, w, 3)
    b0, se0 = hc(X[:, :1], y, w, 3)
    assert (got["a"].beta_1, got["a"].se_1) == (pytest.approx(b[1]), pytest.approx(se[1]))
    assert (got["a"].beta_0, got["a"].se_0) == (pytest.approx(b0[0]), pytest.approx(se0[0]))
    lx = np.array([[1, 0], [1, 0], [1, 0], [1, 9.0]])
    _, se1 = hc(lx, np.array([1.0, 2, 4, 5]), np.ones(4), 1)
    assert got["lev"].warn_hat_1 and got["lev"].se_1 == pytest.approx(se1[1]) and got["lev"].p_1 is None
    assert got["one"].beta_0 == 2.0 and got["one"].se_0 is None and got["one"].beta_1 is None
    assert got["flat"].beta_1 is None and got["flat"].warn_singular_1
    assert "gap" not in got


def test_covariate_fit(spark):
    rng = np.random.default_rng(4)
    n = 40
    x, c, y = rng.normal(5, 2, n), rng.normal(100, 30, n), rng.normal(size=n)
    rows = [("a", *map(float, v), 7.0) for v in zip(x, y, c)] + [("b", *map(float, v), None) for v in zip(x[:9], y[:9], c[:9])]
    df = spark.createDataFrame(rows, "u string, x double, y double, c double, k double")
    got = {r.u: r for r in trends.covariate_trends(df, ["u"], "y", "x", ["c", "k"]).collect()}  # k is constant or missing: left out
    for u, m in (("a", n), ("b", 9)):
        b, se = hc(np.column_stack([np.ones(m), x[:m], c[:m]]), y[:m], np.ones(m), 3)
        b0, se0 = hc(np.column_stack([np.ones(m), c[:m]]), y[:m], np.ones(m), 3)
        r = got[u]
        assert (r.n, r.beta_1, r.se_1) == (m, pytest.approx(b[1]), pytest.approx(se[1]))
        assert (r.beta_0, r.se_0) == (pytest.approx(b0[0]), pytest.approx(se0[0]))


def meta_data(seed=1, n=80, groups=9):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    t = rng.random(n) < 0.4
    v = rng.uniform(0.2, 2, n)
    y = 1 + 0.7 * t + rng.normal(0, 1, groups)[g] + rng.normal(0, np.sqrt(v))
    return pd.DataFrame({"s": 1, "g": g, "t": t, "v": v, "y": y})


def dense_reml(d, tau2, extra=0.0):
    X = np.column_stack([np.ones(len(d)), d.t.astype(float)])
    Z = (d.g.to_numpy()[:, None] == np.unique(d.g)[None, :]).astype(float)
    V = np.diag(d.v + extra) + tau2 * Z @ Z.T
    W = np.linalg.inv(V)
    M = np.linalg.inv(X.T @ W @ X)
    b = M @ X.T @ W @ d.y.to_numpy()
    r = d.y.to_numpy() - X @ b
    return np.linalg.slogdet(V)[1] - np.linalg.slogdet(M)[1] + r @ W @ r, b, M, V, W, X, r


def test_meta_regression(spark):
    pdf = meta_data()
    rows = {r.term: r for r in pooling.meta_regression(spark.createDataFrame(pdf), ["s"], "g", "y", "v", "t").collect()}
    tau2 = rows["t"].tau2
    best = dense_reml(pdf, tau2)
    assert rows["t"].estimate == pytest.approx(best[1][1]) and rows["t"].se == pytest.approx(np.sqrt(best[2][1, 1]))
    assert rows["(Intercept)"].estimate == pytest.approx(best[1][0])
    assert all(best[0] <= dense_reml(pdf, t)[0] + 1e-9 for t in np.concatenate([[0], tau2 * np.linspace(0.9, 1.1, 41), [tau2 * 4]]))
    assert rows["t"].n == 80 and rows["t"].k_cluster == pdf.g.nunique()


def test_one_armed_spec_gives_no_row(spark):
    pdf = meta_data()
    pdf["t"] = False
    assert pooling.meta_regression(spark.createDataFrame(pdf), ["s"], "g", "y", "v", "t").count() == 0


def test_cluster_robust_against_dense(spark):
    pdf = meta_data(3, 50, 7)
    df = spark.createDataFrame(pdf)
    fit = pooling.meta_regression(df, ["s"], "g", "y", "v", "t")
    got = {r.term: r for r in pooling.cluster_robust(df, ["s"], "g", "y", "v", "t", fit).collect()}
    _, b, M, V, W, X, r = dense_reml(pdf, fit.first().tau2)
    meat, P = np.zeros((2, 2)), []
    n = len(pdf)
    for g in np.unique(pdf.g):
        i = np.flatnonzero(pdf.g == g)
        val, vec = np.linalg.eigh(V[np.ix_(i, i)])
        root, inv = (vec * np.sqrt(val)) @ vec.T, (vec / np.sqrt(val)) @ vec.T
        Xw = inv @ X[i]
        cv, cw = np.linalg.eigh(np.eye(len(i)) - Xw @ M @ Xw.T)
        A = root @ ((cw[:, cv > 1e-12] / np.sqrt(cv[cv > 1e-12])) @ cw[:, cv > 1e-12].T) @ inv
        q = np.zeros((n, 2))
        q[i] = A.T @ W[np.ix_(i, i)] @ X[i] @ M
        u = q.T @ r
        meat += np.outer(u, u)
        P.append(q)
    R = V - X @ M @ X.T
    for j, term in enumerate(("(Intercept)", "t")):
        G = np.array([[a[:, j] @ R @ c[:, j] for c in P] for a in P])
        assert got[term].se == pytest.approx(np.sqrt(meat[j, j]), rel=1e-8)
        assert got[term].df == pytest.approx(np.trace(G) ** 2 / (G * G).sum(), rel=1e-6)


def test_mixed_model_against_dense(spark):
    pdf = meta_data(6, 90, 10)
    pdf["weights"] = 1 / pdf.v
    pdf["type"] = pdf.t.astype(float)
    pdf["z"] = np.random.default_rng(0).normal(size=len(pdf))
    got = {r.term: r for r in pooling.mixed_model(spark.createDataFrame(pdf), ["s"], "g", "y", ["type", "z"]).collect()}
    X = np.column_stack([np.ones(len(pdf)), pdf.type, pdf.z])
    Z = (pdf.g.to_numpy()[:, None] == np.unique(pdf.g)[None, :]).astype(float)
    y = pdf.y.to_numpy()

    def at(theta):
        V = np.diag(1 / pdf.weights) + theta * Z @ Z.T
        W = np.linalg.inv(V)
        A = X.T @ W @ X
        b = np.linalg.solve(A, X.T @ W @ y)
        rss = (y - X @ b) @ W @ (y - X @ b)
        return np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + (len(y) - 3) * np.log(rss), b, rss / (len(y) - 3), A

    theta = got["type"].tau2 / got["type"].sigma2
    dev, b, s2, A = at(theta)
    assert all(dev <= at(t)[0] + 1e-9 for t in theta * np.linspace(0.9, 1.1, 21))
    assert got["type"].estimate == pytest.approx(b[1]) and got["type"].se == pytest.approx(np.sqrt(s2 * np.linalg.inv(A)[1, 1]))
    assert 5 < got["type"].df <= 90 and 0 < got["type"].p < 1


def test_mixed_model_isolates_failures(spark):
    pdf = meta_data(2)
    pdf["weights"], pdf["type"] = 1.0, pdf.t.astype(float)
    bad = pdf.assign(s=2, type=1.0)
    got = pooling.mixed_model(spark.createDataFrame(pd.concat([pdf, bad])), ["s"], "g", "y", ["type"]).collect()
    assert {r.s: r.status for r in got} == {1: "ok", 2: "failed"}


def test_full_matching_is_optimal(spark):
    rng = np.random.default_rng(11)
    parts = []
    for s in range(6):
        n = 60
        parts.append(pd.DataFrame({"spec": s, "u": np.arange(n), "t": rng.random(n) < 0.3, "score": np.round(rng.random(n), 2 if s % 2 else 6)}))
    parts.append(pd.DataFrame({"spec": 99, "u": [1, 2], "t": [True, True], "score": [0.1, 0.2]}))
    pdf = pd.concat(parts)
    got = matching.full_matching(spark.createDataFrame(pdf), ["spec"], "u", "t").toPandas().merge(pdf, on=["spec", "u"])
    assert 99 not in set(got.spec) and len(got) == 360
    for s, part in got.groupby("spec"):
        cost = 0.0
        for _, m in part.groupby("set_id"):
            nt, nc = m.t.sum(), (~m.t).sum()
            assert min(nt, nc) == 1
            a, c = m[m.t].score.to_numpy(), m[~m.t].score.to_numpy()
            cost += np.abs(a[:, None] - c[None, :]).sum()
        a, c = np.sort(part[part.t].score), np.sort(part[~part.t].score)
        whole = sum(abs(a[i] - c[j]) for i, j in matching.cover_line(a, c))
        assert cost == pytest.approx(whole, abs=1e-12)


def test_letters():
    L = summaries.letter_groups(["a", "b", "c"], {frozenset(("a", "c"))})
    assert L == {"a": "a", "b": "ab", "c": "b"}
    assert summaries.letter_groups(["a", "b"], set()) == {"a": "a", "b": "a"}
    assert summaries.letter_groups(["a", "b", "c"], {frozenset(p) for p in (("a", "b"), ("a", "c"), ("b", "c"))}) == {"a": "a", "b": "b", "c": "c"}


def test_flat_density(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 5.0)], "s string, v double")
    rows = summaries.density_grid(df, ["s"], "v").collect()
    assert len(rows) == 6 and all(r.w == 0.0 for r in rows)


def test_declustered_weights_average_one(spark):
    from panelweave.operators import spatial

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 90), "x": rng.random(90), "y": rng.random(90)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": [9, 9], "x": [0.0, 0.1], "y": [0.0, 0.1]})])
    for k in (None, "gaussian", "epanechnikov"):
        w = spatial.decluster_weights(spark.createDataFrame(pdf), ["g"], 0.2, k)
        assert all(r.m == pytest.approx(1.0) for r in w.groupBy("g").agg(F.avg("w").alias("m")).collect())
    zero = spatial.decluster_weights(spark.createDataFrame(pdf), ["g"], 0.0)
    assert {r.w for r in zero.collect()} == {1.0}


def test_line_cover_against_every_choice():
    """Cheapest cover by trying all sets of links, and by the plain quadratic recursion; ties and disjoint arms too."""
    rng = np.random.default_rng(0)

    def recursion(a, b):
        f = np.full((len(a) + 1, len(b) + 1), np.inf)
        f[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                f[i, j] = abs(a[i - 1] - b[j - 1]) + min(f[i - 1, j - 1], f[i - 1, j], f[i, j - 1])
        return f[-1, -1]

    def every(a, b):
        pairs, best = [(i, j) for i in range(len(a)) for j in range(len(b))], np.inf
        for mask in range(1, 1 << len(pairs)):
            chosen = [p for k, p in enumerate(pairs) if mask >> k & 1]
            if len({i for i, _ in chosen}) == len(a) and len({j for _, j in chosen}) == len(b):
                best = min(best, sum(abs(a[i] - b[j]) for i, j in chosen))
        return best

    kinds = [lambda k: rng.normal(0, 1, k), lambda k: rng.integers(0, 6, k).astype(float), lambda k: rng.normal(rng.choice([0, 50]), 1, k)]
    for t in range(600):
        n, m = rng.integers(1, 12, 2)
        a, b = np.sort(kinds[t % 3](n)), np.sort(kinds[t % 3](m))
        links = matching.cover_line(a, b)
        deg_a, deg_b = np.bincount([i for i, _ in links], minlength=n), np.bincount([j for _, j in links], minlength=m)
        assert deg_a.min() > 0 and deg_b.min() > 0 and len(set(links)) == len(links)
        assert all(deg_a[i] == 1 or deg_b[j] == 1 for i, j in links)
        cost = sum(abs(a[i] - b[j]) for i, j in links)
        assert cost == pytest.approx(recursion(a, b), abs=1e-9)
        if n * m <= 10:
            assert cost == pytest.approx(every(a, b), abs=1e-9)
    assert matching.cover_line(np.zeros(0), np.ones(3)) == []
