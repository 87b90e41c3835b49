"""Table, spatial, curve, store and sweep behaviour on small hand-made rows; plan checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import cells, curves, independent, reports, spatial, sweeps, tables, typology
from panelweave.plans import QUERIES
from panelweave.sources import files, store

SF = "/root/testdata/sf0.001"


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k int, b int")
    assert {(r.k, r.a, r.b) for r in tables.natural_left_join(a, b).collect()} == {(1, "x", None), (None, "y", 5)}
    assert {(r.k, r.a, r.b) for r in tables.full_join_chain([a, b], ["k"]).collect()} == {(1, "x", None), (None, "y", 5), (2, None, 6)}


def test_score_needs_both_sides(spark):
    pairs = spark.createDataFrame([("a", "X", "Y"), ("b", "X", "Y"), ("c", "X", "Y")], "code string, CC_1 string, CC_2 string")
    agr = spark.createDataFrame([("X", "a", 2), ("X", "a", 1), ("Y", "a", 3), ("X", "b", 3)], "CC string, code string, ArrangementScore int")
    got = {r.code: r.ArrangementScore for r in typology.cooperation_scores(pairs, agr).collect()}
    assert got == {"a": 2, "b": 0, "c": 0}


@pytest.mark.parametrize(
    "vals,want",
    [
        (dict(GW_B2_1=0.0, GW_B2_2=0.0, UR_B2_1=0.0, UR_B2_2=0.0), "IU0"),
        (dict(GW_B2_1=0.0, UR_B2_1=0.0), "IU1"),
        (dict(GW_B2_1=0.0), "UB"),
        (dict(GW_B1_1=10.0), "BL"),
        (dict(), "DA"),
        (dict(GW_1=0.0, GW_B1_1=1.0), "BL"),  # x/0 counts as infinite
        (dict(GW_1=0.0, GW_B1_1=0.0, GW_B1_2=10.0), "DA"),  # 0/0 is missing, so no maximum
        (dict(GW_B1_1=None, GW_B1_2=10.0), "DA"),
        (dict(GW_B2_1=None), "DA"),
    ],
)
def test_pair_class(spark, vals, want):
    base = {f"{v}{s}_{i}": 10.0 if s == "" else 5.0 for v in ("GW", "UR", "CR3") for s in ("", "_B1", "_B2") for i in (1, 2)}
    base.update(vals)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))
    assert typology.classify(df).first()["class"] == want


def test_polygon_borders_and_fallback(spark):
    sq = lambda g, x, y: [(g, 0, i, *e) for i, e in enumerate(((x, y, x + 2, y), (x + 2, y, x + 2, y + 2), (x + 2, y + 2, x, y + 2), (x, y + 2, x, y)))]
    edges = spark.createDataFrame([tuple(map(float, r[3:])) + r[:3] for r in sq(1, 0, 0) + sq(2, 1, 1)], "x1 double, y1 double, x2 double, y2 double, geom_id int, part int, seq int")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.0, 0.5), (4, 9.0, 9.0), (5, 1.0, 1.0)], "id int, x double, y double")
    hits = spatial.polygon_hits(pts, edges, "id", 1.0)
    assert {(r.id, r.geom_id) for r in hits.collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (5, 1), (5, 2)}
    near = spatial.with_nearest_fallback(hits, pts, edges, "id", 1.0)
    assert ("nearest", 2) in {(r.by, r.geom_id) for r in near.where("id = 4").collect()}


def test_nearest_attribute(spark):
    rng = np.random.default_rng(0)
    p, e = rng.uniform(0, 100, (60, 2)), rng.uniform(0, 100, (40, 4))
    e[:, 2:] = e[:, :2] + rng.uniform(-3, 3, (40, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    seg = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(e)], "river int, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in spatial.nearest_segment(pts, seg, "id", ["river"], 2.0).collect()}
    assert len(got) == 60
    for i, q in enumerate(p):
        d = e[:, 2:] - e[:, :2]
        t = np.clip(((q - e[:, :2]) * d).sum(1) / (d * d).sum(1), 0, 1)
        dist = np.hypot(*(q - (e[:, :2] + t[:, None] * d)).T)
        assert got[i].river == int(dist.argmin()) and got[i].dist == pytest.approx(dist.min())


def test_filled_triangle_area(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (1, 100.0, 0.0, 0.0, 100.0), (1, 0.0, 100.0, 0.0, 0.0)], "geom_id int, x1 double, y1 double, x2 double, y2 double")
    area = cells.areas(cells.fill_polygons(tri, 0.5), ["geom_id"], 0.25).first().area
    assert area == pytest.approx(5000, rel=0.01)
    line = cells.trace_lines(spark.createDataFrame([(1, 0.1, 0.1, 3.9, 0.1)], "geom_id int, x1 double, y1 double, x2 double, y2 double"), 1.0)
    assert {(r.cx, r.cy) for r in line.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_independent_sets_are_the_greedy_ones(spark):
    rng = np.random.default_rng(1)
    n = 40
    e = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(70)})
    ids, edges = spark.range(n).withColumnRenamed("id", "u"), spark.createDataFrame(e, "a long, b long")
    samples = spark.createDataFrame([(s,) for s in (1, 2, 3)], "sample_id int")
    got = {}
    for r in independent.random_independent_sets(ids, edges, "u", samples, seed=5).collect():
        got.setdefault(r.sample_id, set()).add(r.u)
    ranks = ids.join(samples.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select("sample_id", "u", F.xxhash64(F.lit(5), "sample_id", "u").alias("h")).collect()
    nb = {i: {b if a == i else a for a, b in e if i in (a, b)} for i in range(n)}
    for s in (1, 2, 3):
        keep = set()
        for _, u in sorted((r.h, r.u) for r in ranks if r.sample_id == s):
            if not nb[u] & keep:
                keep.add(u)
        assert got[s] == keep


def test_concentration_edges(spark):
    c = lambda vs: [(float(10 * i), v) for i, v in enumerate(vs)]
    up = [float(v) for v in range(11)]
    two = [1.0, None, 2.0] + [None] * 8
    rows = [("same", c(up), c(up)), ("two", c(up), c(two)), ("none", c(up), c([None] * 11)), ("steps", c([0.0] * 5 + [1.0] * 6), c(up)), ("near", c(up), c([v / 2 for v in up]))]
    t = "array<struct<p: double, v: double>>"
    df = spark.createDataFrame(rows, f"k string, land {t}, act {t}")
    got = {r.k: r.gini for r in curves.concentration(df, "land", "act").collect()}
    assert got["same"] == pytest.approx(0.0, abs=1e-12) and got["two"] is None and got["none"] is None
    assert got["near"] < 0 < abs(got["steps"])


def test_influence_replays_published_row(spark):
    # typed constants: effect and error of the base fit, one left-out effect
    base = spark.createDataFrame([(0, 8.906, 1.6848)], "outcome int, estimate double, se double")
    eff = spark.createDataFrame([("X", 0, 8.906 + 1.5768, 1.7, 0.001)], "drop string, outcome int, estimate double, se double, p double")
    r = sweeps.influence(eff, base).first()
    assert r.delta_b == pytest.approx(1.5768) and r.infl_std == pytest.approx(0.9359, abs=1e-4) and r.sig


def test_leave_k_out(spark):
    rows = [(f"a{i % 7}", i, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, id int, t boolean")
    out = sweeps.leave_k_out(df, "name", "id", "t", [1, 4], draws=3).cache()
    for r in out.groupBy("k", "iter", "left_out").agg(F.collect_set("name").alias("names")).collect():
        gone = r.left_out.split("; ")
        assert len(gone) == r.k and not set(gone) & set(r.names) and set(gone) | set(r.names) == {f"a{i}" for i in range(7)}
    assert out.select("k", "iter").distinct().count() == 6


def test_stores(spark, tmp_path):
    want = spark.createDataFrame([(1,), (2,), (3,)], "sample_id int")
    seen = []

    def make(todo):
        seen.append(sorted(r.sample_id for r in todo.collect()))
        return todo.withColumn("v", F.col("sample_id") * 10)

    p = str(tmp_path / "s")
    store.run_missing(spark, p, want.where("sample_id < 3"), "sample_id", make)
    assert {(r.sample_id, r.v) for r in store.run_missing(spark, p, want, "sample_id", make).collect()} == {(1, 10), (2, 20), (3, 30)}
    store.run_missing(spark, p, want, "sample_id", make)
    assert seen == [[1, 2], [3]]


def test_csv_conventions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"","CC","TB","v"\n"1","NA",TRUE,NA\n"2","FR",FALSE,1.5\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "_c0 string, CC string, TB boolean, v double")
    assert [tuple(r) for r in df.collect()] == [(None, True, None), ("FR", False, 1.5)]
    assert [r.variable for r in files.column_listing(df).collect()] == ["CC", "TB", "v"]


def test_check_stops_the_job(spark):
    with pytest.raises(Exception, match="bad row"):
        tables.check(spark.createDataFrame([(1,), (None,)], "a int"), F.col("a") > 0, "bad row").collect()


def test_sign_shares_all_missing(spark):
    df = spark.createDataFrame([("a", None, None)], "g string, e double, p double")
    assert tuple(reports.sign_shares(df, ["g"], "e", "p").first()) == ("a", 0.0, 1.0, 0.0)


def test_row_rules_run_on_streams(spark, tmp_path):
    from panelweave.functions import labels, nulls

    spark.createDataFrame([("A", 1.0, 0.0), (None, 2.0, 0.02)], "CC string, a double, p double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("CC string, a double, p double").parquet(str(tmp_path / "in"))
    s = tables.drop_listed(s, "CC", ["A"]).select(nulls.ratio("a", "p").alias("r"), labels.stars("p").alias("st"))
    q = s.writeStream.format("memory").queryName("rules").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from rules").collect()] == [(100.0, "**")]


NATIVE = ["unit_trend_ols", "weighted_unit_trend", "points_in_polygons", "nearest_border_distance", "lookalike_candidates", "overlay_split", "shared_borders", "concentration_index", "class_variants", "percentile_curves", "rows_at_maximum", "neighbour_counts", "epanechnikov_density", "match_weights"]


@pytest.mark.parametrize("name", NATIVE)
def test_plan_has_no_python_and_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "FlatMapGroupsInPandas", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["rows_at_maximum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan and "WindowGroupLimit" in plan
