"""Joins of bundles against plain loops, also where one cell holds most rows."""

import math
import re

import numpy as np
import pytest

from panelweave.operators import spatial
from test_lines import POLY, inside, ring, star

SPOT = "id long, x double, y double, area double"


def spots(rng, n, middle):
    """Half of them in one cell, and rows without a place, a size or a positive one."""
    xy = np.concatenate([rng.normal(middle, 0.5, (n // 2, 2)), rng.uniform(0, 60, (n - n // 2, 2))])
    area = rng.choice([1.0, 2.0, 5.0, 9.0, 30.0, 80.0], n)
    out = [(i, float(x), float(y), float(a)) for i, ((x, y), a) in enumerate(zip(xy, area))]
    return [*out, (n, None, 1.0, 2.0), (n + 1, 1.0, 1.0, None), (n + 2, 30.0, 30.0, 0.0), (n + 3, 30.0, 30.0, -4.0), (0, 30.0, 30.0, 2.0)]


@pytest.mark.parametrize("task,spread", [(None, None), (500, 100)])
def test_lookalikes_of_crowded_cells(spark, monkeypatch, task, spread):
    if task:
        monkeypatch.setattr(spatial, "TASK_PAIRS", task)
        monkeypatch.setattr(spatial, "SPREAD_PAIRS", spread)
    rng = np.random.default_rng(8)
    u, c = spots(rng, 30, 22.0), spots(rng, 700, 23.0)
    got = spatial.lookalike_candidates(spark.createDataFrame(u, SPOT), spark.createDataFrame(c, SPOT), radius=6.0, cell=5.0)
    assert got.columns == ["u_id", "u_x", "u_y", "u_area", "c_id", "c_x", "c_y", "c_area", "dist"]
    want = []
    for i, x, y, a in u:
        for k, p, q, b in c:
            if None not in (x, a, p, b) and a > 0 and a / 4 <= b <= a * 4 and math.hypot(x - p, y - q) <= 6 + math.sqrt(a / math.pi):
                want.append((i, k, b, round(math.hypot(x - p, y - q), 9)))
    assert sorted((r.u_id, r.c_id, r.c_area, round(r.dist, 9)) for r in got.collect()) == sorted(want)


def test_lookalikes_copy_units_to_cells_only(spark):
    """The rows shuffled are those of cells that a circle meets, not seven sizes of each, and candidates come in bundles."""
    rng = np.random.default_rng(9)
    u, c = spots(rng, 40, 22.0), spots(rng, 2000, 23.0)
    plan = spatial.lookalike_candidates(spark.createDataFrame(u, SPOT), spark.createDataFrame(c, SPOT), radius=6.0, cell=5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG2" not in plan.upper() and "POWER" not in plan.upper()
    assert "inline(__s" in plan


PLACE = "id long, x double, y double"


def shapes(rng):
    """Stars with many edges a cell, boxes, triangles, one with a hole, over places of which half lie in one cell, also on outlines."""
    polys = [ring(g, star(rng, *rng.uniform(5, 45, 2), int(rng.integers(3, 30)), 12)) for g in range(10)]
    polys += [ring(20 + g, [(a, b), (a + 9, b), (a + 9, b + 6), (a, b + 6)]) for g, (a, b) in enumerate(rng.integers(0, 40, (12, 2)))]
    polys += [ring(40, [(0, 0), (40, 0), (40, 40), (0, 40)]) + [(40, 9, *map(float, e)) for e in ((10, 10, 10, 30), (10, 30, 30, 30), (30, 30, 30, 10), (30, 10, 10, 10))]]
    xy = [*rng.normal(20, 1.5, (400, 2)), *rng.uniform(-5, 50, (200, 2)), *rng.integers(-2, 45, (200, 2))]
    return polys, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]


@pytest.mark.parametrize("task,spread", [(None, None), (300, 100)])
@pytest.mark.parametrize("cell", [3.0, 16.0])
def test_points_of_crowded_cells_in_polygons(spark, monkeypatch, cell, task, spread):
    if task:
        monkeypatch.setattr(spatial, "TASK_PAIRS", task)
        monkeypatch.setattr(spatial, "SPREAD_PAIRS", spread)
    monkeypatch.setattr(spatial, "BUNDLE_ROWS", 16)
    polys, pts = shapes(np.random.default_rng(10))
    p, e = spark.createDataFrame([*pts, (-1, None, 3.0)], PLACE), spark.createDataFrame([e for s in polys for e in s], POLY)
    want = {(i, s[0][0]) for i, x, y in pts for s in polys if inside(x, y, s)}
    assert sorted(map(tuple, spatial.polygon_hits(p, e, "id", cell).collect())) == sorted(want)
    alone = {i for i, _, _ in pts} - {i for i, _ in want} | {-1}
    assert sorted(r.id for r in spatial.outside_points(p, e, cell).collect()) == sorted(alone)
    names = e.select("geom_id").distinct().selectExpr("geom_id", "geom_id % 3 AS owner")
    got = spatial.point_in_polygon(p, names, e, "id", cell)
    assert got.columns == ["id", "x", "y", "geom_id", "owner"]
    assert {(r.id, r.geom_id, r.owner) for r in got.collect()} == {(i, g, g % 3) for i, g in want} | {(i, None, None) for i in alone}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_meet_polygons_in_bundles(spark, how):
    """One row of a cell answers for a bundle; the generated code is short enough to be compiled (8000 bytes)."""
    polys, pts = shapes(np.random.default_rng(11))
    e = spark.createDataFrame([e for s in polys for e in s], POLY)
    out = spatial.point_in_polygon(spark.createDataFrame(pts, PLACE), e.select("geom_id").distinct(), e, "id", 4.0, how)
    assert "inline(__s" in out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.where("geom_id >= 0")._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_fallback_makes_cells_once(spark, monkeypatch, tmp_path):
    from panelweave.plans import QUERIES

    customers = [(k, k % 25, float(k), "A") for k in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 25) for k in range(12)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    made, make = [], spatial.polygon_cells
    monkeypatch.setattr(spatial, "polygon_cells", lambda *a: made.append(1) or make(*a))
    out = QUERIES["nearest_fallback"](spark, str(tmp_path)).collect()
    assert len(made) == 1 and {r.id for r in out} == {-1, *range(40)}
