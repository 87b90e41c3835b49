"""The ways meant for huge groups give what the simple ways give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import matching, prefix, spatial, summaries, tables, trends


def skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n))
    x = np.round(np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(1, 2, n)), 3)
    pdf = pd.DataFrame({"g": g, "id": np.arange(n), "x": x})
    return spark.createDataFrame(pdf), pdf


def test_spread_quantiles(spark):
    df, pdf = skewed(spark)
    ps = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r.g: r.q for r in prefix._spread_quantiles(df, ["g"], "x", ps, "q").collect()}
    one_task = {r.g: r.q for r in prefix.exact_quantiles(df, ["g"], "x", ps).collect()}
    assert got == one_task
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part.x, ps)), rel=1e-12)


def test_spread_quantiles_null_key_and_no_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g int, x double")
    got = {r.g: r.q for r in prefix._spread_quantiles(df, ["g"], "x", [0.5], "q").collect()}
    assert got == {None: [2.0], 1: [2.0]}
    assert prefix._spread_quantiles(df, [], "x", [0.5], "q").first().q == [2.0]


@pytest.mark.parametrize("descending", [False, True])
def test_spread_scan(spark, descending):
    df, _ = skewed(spark)
    items = {
        "s": ("sum", F.col("x"), "upto"), "b": ("max", F.when(F.col("id") % 2 == 0, F.col("x")), "before"),
        "f": ("min", F.when(F.col("id") % 3 == 0, F.col("id")), "from"),
    }
    a = prefix.scan(df, ["g"], "x", ["id"], items, descending, group_rows=1)
    b = prefix.scan(df, ["g"], "x", ["id"], items, descending, group_rows=10**9)
    ra, rb = (sorted(d.select("id", F.round("s", 6).alias("s"), "b", "f").collect()) for d in (a, b))
    assert ra == rb


ODD = [
    ("null order", "x double", [(None,), (3.0,), (1.0,), (2.0,), (None,)]),
    ("text order", "x string", [("b",), ("a",), (None,), ("ü",), ("B",)]),
    ("outlier", "x double", [(float(i),) for i in range(60)] + [(1e12,)]),
    ("ties", "x double", [(5.0,)] * 54 + [(float(i),) for i in range(6)]),
]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("name,schema,rows", ODD, ids=[o[0] for o in ODD])
def test_scan_is_the_same_at_every_size(spark, name, schema, rows, descending):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + schema)
    items = {"n": ("sum", F.lit(1), "upto"), "after": ("sum", F.col("id"), "from"), "m": ("max", F.col("id"), "before")}
    a, b = (prefix.scan(df, [], "x", ["id"], items, descending, group_rows=g) for g in (1, 10**9))
    assert a.columns == b.columns and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_ranges_share_a_tail(spark, tmp_path):
    """One value at 1e12 must not push all others into one task."""
    df = spark.range(4000).select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id").cast("double")).alias("x"))
    d = df.repartitionByRange(8, "x").groupBy(F.spark_partition_id()).count()
    assert d.agg(F.max("count")).first()[0] < 1500


def test_numbering(spark, monkeypatch):
    df, pdf = skewed(spark, 500)
    monkeypatch.setattr(prefix, "TASK_ROWS", 10)
    got = {r.id: r.k for r in prefix.number_rows(df, "x", "k", ["id"]).collect()}
    want = pdf.sort_values(["x", "id"]).reset_index(drop=True)
    assert [got[i] for i in want.id] == list(range(1, 501))


def test_crowded_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 700
    hot = rng.random(n) < 0.5
    xy = np.where(hot[:, None], rng.normal(0, 0.3, (n, 2)), rng.uniform(-20, 20, (n, 2)))
    xy[:100] = xy[0]  # many copies of one place
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]})
    monkeypatch.setattr(spatial, "PAIR_LIMIT", 20)
    df = spark.createDataFrame(pdf)
    got = {r.id: r.k for r in spatial.neighbours_within(df, ["g"], 1.5, "k").collect()}
    dens = {r.id: r.d for r in spatial.kernel_density(df, ["g"], 1.5, "epanechnikov", "d").collect()}
    for _, part in pdf.groupby("g"):
        d = np.hypot(part.x.to_numpy()[:, None] - part.x.to_numpy(), part.y.to_numpy()[:, None] - part.y.to_numpy())
        for i, row in zip(part.id, d):
            assert got[i] == (row <= 1.5).sum()
            assert dens[i] == pytest.approx(np.where(row <= 1.5, 0.75 * (1 - (row / 1.5) ** 2), 0).sum() / (np.pi * 2.25), rel=1e-9)


def units(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in ((1, 60), (2, 45), (3, 7)):
        x = rng.uniform(0, 10, n)
        c = rng.normal(size=n)
        y = 3 + 2 * x - c + rng.standard_t(2, n)
        rows += [(g, float(a), float(b), float(d)) for a, b, d in zip(x, y, c)]
    rows += [(4, 1.0, 2.0, 0.0), (4, 1.0, 3.0, 0.0), (4, 1.0, 7.0, 0.0)]
    return spark.createDataFrame(rows, "g int, x double, y double, c double")


@pytest.mark.parametrize("covs", [[], ["c"]])
def test_huber_both_ways(spark, covs):
    df = units(spark)
    a = {r.g: r for r in trends.huber_trends(df, ["g"], "y", "x", covs).collect()}
    b = {r.g: r for r in trends.huber_trends(df, ["g"], "y", "x", covs, block_rows=10).collect()}
    assert set(a) == set(b) == {1, 2, 3, 4}
    for g in (1, 2):
        for f in ("beta_0", "se_0", "beta_1", "se_1", "p_0", "p_1"):
            assert a[g][f] == pytest.approx(b[g][f], rel=1e-6, abs=1e-12), (g, f)
    assert a[4].beta_1 is None and a[4].p_1 is None


def panel(spark, n=120, seed=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    t = rng.random(n) < 1 / (1 + np.exp(-(z[:, 0] - 0.5)))
    return pd.DataFrame({"spec": rng.integers(0, 2, n), "u": np.arange(n), "t": t, "a": z[:, 0], "b": z[:, 1]})


def test_logit_both_ways(spark, monkeypatch):
    pdf = panel(spark)
    pdf.loc[pdf.spec == 1, "b"] = 4.0  # constant in one spec
    df = spark.createDataFrame(pdf)
    small = {(r.spec, r.u): r.score for r in matching.propensity(df, ["spec"], "t", ["a", "b"]).collect()}
    monkeypatch.setattr(matching, "TASK_ROWS", 1)
    big = {(r.spec, r.u): r.score for r in matching.propensity(df, ["spec"], "t", ["a", "b"]).collect()}
    assert small.keys() == big.keys()
    assert all(small[k] == pytest.approx(big[k], abs=1e-8) for k in small)
    for s, part in pdf.groupby("spec"):
        r = part.t.astype(float).to_numpy() - np.array([small[(s, u)] for u in part.u])
        assert abs(r.sum()) < 1e-7 and abs((r * part.a).sum()) < 1e-7


def test_one_armed_spec_has_no_score(spark):
    df = spark.createDataFrame([(1, 1, True, 0.1), (1, 2, True, 0.4)], "spec int, u int, t boolean, a double")
    assert all(r.score is None and not r.score_ok for r in matching.propensity(df, ["spec"], "t", ["a"]).collect())


def test_nearest_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"spec": [0] * 40 + [1] * 9, "u": np.arange(49), "t": rng.random(49) < 0.45, "score": rng.random(49)})
    df = spark.createDataFrame(pdf)
    key = lambda d: sorted((r.spec, r.treated, r.control, r.pass_no) for r in d.collect())
    small = key(matching.nearest_matching(df, ["spec"], "u", "t", ratio=2))
    monkeypatch.setattr(matching, "TASK_ROWS", 1)
    assert key(matching.nearest_matching(df, ["spec"], "u", "t", ratio=2)) == small
    # the plain sequential rule
    want = []
    for s, part in pdf.groupby("spec"):
        free = part[~part.t].set_index("u").score.to_dict()
        for p in (1, 2):
            for r in part[part.t].sort_values("score", ascending=False).itertuples():
                if free:
                    c = min(free, key=lambda k: (abs(free[k] - r.score), free[k]))
                    free.pop(c)
                    want.append((s, r.u, c, p))
    assert small == sorted(want)


def test_salted_attach(spark, monkeypatch):
    df = units(spark)
    plain = {r.g: r for r in trends.unit_trends(df, ["g"], "y", "x").collect()}
    monkeypatch.setattr(prefix, "BROADCAST_BYTES", -1)
    salted = {r.g: r for r in trends.unit_trends(df, ["g"], "y", "x").collect()}
    assert plain.keys() == salted.keys()
    for g in (1, 2, 3):
        assert salted[g].se_1 == pytest.approx(plain[g].se_1) and salted[g].n == plain[g].n


def test_weighted_trend_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    x = 1e7 + np.arange(200) * 1e-3
    y = 2 * (x - 1e7) + rng.normal(0, 0.01, 200)
    w = rng.uniform(0.5, 2, 200)
    rows = lambda shift: spark.createDataFrame([(1, float(a - shift), float(b), float(c)) for a, b, c in zip(x, y, w)], "g int, x double, y double, w double")
    far, near = (trends.unit_trends(rows(s), ["g"], "y", "x", "w").first() for s in (0.0, 1e7))
    assert far.beta_1 == pytest.approx(near.beta_1, rel=1e-5) and far.se_1 == pytest.approx(near.se_1, rel=1e-5)
    assert near.beta_1 == pytest.approx(np.polyfit(x - 1e7, y, 1, w=np.sqrt(w))[0], rel=1e-8)
    assert near.beta_0 == pytest.approx(np.average(y, weights=w), rel=1e-12)
    ones = trends.unit_trends(rows(0.0).withColumn("w", F.lit(1.0)), ["g"], "y", "x", "w").first()
    assert ones.beta_1 == pytest.approx(trends.unit_trends(rows(0.0), ["g"], "y", "x").first().beta_1, rel=1e-6)


def test_huber_drops_the_same_columns_at_every_size(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, 400)
    c = 3 * x + rng.normal(0, 1e-6, 400)  # nearly collinear
    y = 1 + 2 * x + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(1, float(a), float(b), float(e)) for a, b, e in zip(x, c, y)], "g int, x double, c double, y double")
    a, b = (trends.huber_trends(df, ["g"], "y", "x", ["c"], block_rows=n).first() for n in (100_000, 1))
    assert a.beta_1 == pytest.approx(b.beta_1, rel=1e-4) and a.se_1 == pytest.approx(b.se_1, rel=1e-3)
    assert a.beta_1 == pytest.approx(2, abs=0.05)


def test_nearest_segment_reaches_everything(spark):
    seg = spark.createDataFrame([(7, 0.0, 0.0, 3.0, 40.0)], "g int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 200_000.0, -5.0), (2, 1.0, 20.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id int, x double, y double")
    got = {r.id: (r.dist, r.g) for r in spatial.nearest_segment(pts, seg, "id", ["g"], 1.0).collect()}
    assert got[1][0] == pytest.approx(np.hypot(199_997, 45), rel=1e-9) and got[1][1] == 7
    assert got[2][0] == pytest.approx(abs(1 * 40 - 20 * 3) / np.hypot(3, 40), rel=1e-9)
    assert got[3] == got[4] == (None, None)
    assert {r.id: r.dist for r in spatial.nearest_segment(pts, seg.where("false"), "id", ["g"], 1.0).collect()} == dict.fromkeys((1, 2, 3, 4))


def test_cells_along_a_segment(spark):
    rng = np.random.default_rng(8)
    segs = [(i, *map(float, rng.uniform(-20, 20, 4))) for i in range(40)] + [(98, 1.0, -7.0, 1.0, 9.0), (99, -7.0, 2.0, 9.0, 2.0)]
    df = spark.createDataFrame(segs, "i int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.i, r.cx, r.cy) for r in spatial.along_segment(df, F.lit(1.5)).collect()}
    for i, x1, y1, x2, y2 in segs:
        t = np.linspace(0, 1, 3000)
        for cx, cy in set(zip(np.floor((x1 + t * (x2 - x1)) / 1.5).astype(int).tolist(), np.floor((y1 + t * (y2 - y1)) / 1.5).astype(int).tolist())):
            assert (i, cx, cy) in got
    assert len(got) < 42 * 60


def test_separated_arms_are_told(spark):
    df = spark.createDataFrame([(0, i, i >= 100, float(i)) for i in range(200)] + [(1, i, i % 3 == 0, float(i % 7)) for i in range(200)], "spec int, u int, t boolean, a double")
    got = {r.spec: r.c for r in matching.propensity(df, ["spec"], "t", ["a"]).groupBy("spec").agg(F.bool_and("score_converged").alias("c")).collect()}
    assert got == {0: False, 1: True}


def test_country_totals_ignore_the_code(spark):
    from panelweave.operators import typology

    pairs = spark.createDataFrame([("A", "X", "Y"), ("B", "X", "Z")], "code string, CC_1 string, CC_2 string")
    long = spark.createDataFrame([("A", "X", s, v) for s, v in (("", 10.0), ("_C", 10.0))] + [("B", "X", s, v) for s, v in (("", 20.0), ("_C", 20.0))], "code string, CC string, src string, GW double")
    got = {r.code: (r.GW_1, r.GW_C_1) for r in typology.attach_sources_pivoted(pairs, long, ["", "_C"], ["GW"]).collect()}
    assert got == {"A": (10.0, 30.0), "B": (20.0, 30.0)}


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_previous_and_trapezoid_over_ranges(spark, monkeypatch, limit):
    """The row before is found across range borders too, with NULLs and ties."""
    monkeypatch.setattr(prefix, "TASK_ROWS", limit)
    rng = np.random.default_rng(8)
    rows = [(int(k), float(o), i, None if rng.random() < 0.1 else float(v)) for i, (k, o, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 90, 400), rng.normal(0, 5, 400)))]
    rows += [(9, 1.0, 0, 2.0)]
    df = spark.createDataFrame(rows, "g int, o double, t int, v double")
    want, area = {}, {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for before, r in zip([None, *mine], mine):
            want[r[0], r[2]] = before and before[3]
            if before:
                area.setdefault(g, 0.0)
                if before[3] is not None and r[3] is not None:
                    area[g] += (before[3] + r[3]) / 2 * (r[1] - before[1])
    got = prefix.previous(df, ["g"], "o", ["t"], "v", "b").collect()
    assert {(r.g, r.t): r.b for r in got} == want
    assert {r.g: r.area for r in prefix.trapezoid(df, ["g"], "o", ["t"], "v").collect()} == pytest.approx(area, rel=1e-9)


def test_weighted_se_far_from_zero(spark):
    rng = np.random.default_rng(9)
    x, w = 1e9 + rng.normal(0, 1, 500), rng.uniform(0.1, 3, 500)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, w)], "g int, x double, w double")
    got = tables.with_mean(df, ["g"], "x", "m").groupBy("g").agg(tables.weighted_se("x", "w", "m").alias("se")).first().se
    m = np.sum(w * (x - 1e9)) / w.sum()
    assert got == pytest.approx(np.sqrt(np.sum(w * (x - 1e9 - m) ** 2)) / w.sum(), rel=1e-6)


def test_binned_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(10)
    rows = [("a", float(v)) for v in rng.normal(3, 2, 3000)] + [("b", float(v)) for v in rng.exponential(5, 2000)] + [("c", 1.0), ("d", 2.0), ("d", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "side string, v double")
    exact = {(r.side, r.k): r for r in summaries.density_grid(df, ["side"], "v").collect()}
    got = {(r.side, r.k): r for r in summaries.binned_density(df, ["side"], "v").collect()}
    assert got.keys() == exact.keys()
    for side in "ab":
        top = max(r.dens for r in exact.values() if r.side == side)
        assert all(abs(got[side, k].dens - exact[side, k].dens) < 2e-3 * top and got[side, k].y == pytest.approx(exact[side, k].y) for k in range(256))
    assert [got[side, k].dens for side in "cd" for k in range(3)] == [None] * 6
