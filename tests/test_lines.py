"""Line geometry and point location against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import lines, spatial

SEG = "id long, x1 double, y1 double, x2 double, y2 double"


def seg_dist(px, py, s):
    _, x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def random_segments(rng, n, span=100.0, size=12.0, first=0):
    a = rng.uniform(0, span, (n, 2))
    b = a + rng.uniform(-size, size, (n, 2))
    return [(first + i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(a, b))]


@pytest.mark.parametrize("tol", [0.7, 6.0])
def test_pieces_follow_the_buffer(spark, tol):
    rng = np.random.default_rng(1)
    a = random_segments(rng, 60) + [(60, 5.0, 5.0, 95.0, 5.0), (61, 50.0, 2.0, 50.0, 98.0), (62, 30.0, 30.0, 30.0, 30.0), (63, 1e4, 0.0, 1e4 + 1, 0.0)]
    b = random_segments(rng, 40) + [(1, 20.0, 5.0, 30.0, 5.0), (2, 25.0, 5.0, 40.0, 5.0), (3, 70.0, 70.0, 70.0, 70.0)]
    got = lines.split_near(spark.createDataFrame(a, SEG), spark.createDataFrame(b, SEG), "id", tol).orderBy("id", "piece").collect()
    for s in a:
        mine = [r for r in got if r.id == s[0]]
        assert [r.piece for r in mine] == list(range(1, len(mine) + 1))
        assert mine[0].t0 == 0 and mine[-1].t1 == 1 and all(p.t1 == q.t0 and p.near != q.near for p, q in zip(mine, mine[1:]))
        assert (mine[0].x1, mine[0].y1, mine[-1].x2, mine[-1].y2) == s[1:]
        for r in mine:
            for t in np.linspace(r.t0, r.t1, 9)[1:-1] if r.t1 - r.t0 > 1e-6 else []:
                d = min(seg_dist(s[1] + t * (s[3] - s[1]), s[2] + t * (s[4] - s[2]), o) for o in b)
                assert d <= tol + 1e-9 if r.near else d >= tol - 1e-9


def test_split_without_others(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], SEG)
    got = lines.split_near(a, a.where("false"), "id", 1.0).collect()
    assert [(r.near, r.t0, r.t1) for r in got] == [(False, 0.0, 1.0)]
    assert lines.split_near(a.where("false"), a, "id", 1.0).count() == 0


def ring(geom, pts):
    return [(geom, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(pts, [*pts[1:], pts[0]]))]


def star(rng, cx, cy, n, r):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    return [(cx + rng.uniform(0.2, 1) * r * math.cos(t), cy + rng.uniform(0.2, 1) * r * math.sin(t)) for t in angle]


POLY = "geom_id long, seq int, x1 double, y1 double, x2 double, y2 double"


def inside(px, py, edges):
    odd = False
    for _, _, x1, y1, x2, y2 in edges:
        if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return True
        if (y1 > py) != (y2 > py) and px < x1 + (x2 - x1) * (py - y1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [1.0, 4.0, 37.0])
def test_points_in_polygons_of_any_form(spark, cell):
    """Also with vertices, edges and points on the grid's lines and corners, and with a hole."""
    rng = np.random.default_rng(2)
    polys = [ring(g, star(rng, *rng.uniform(10, 90, 2), int(rng.integers(3, 14)), 15)) for g in range(12)]
    grid = [(0, 0), (24, 24), (24, 0)], [(8, 8), (16, 20), (8, 32), (0, 20)], [(40, 40), (60, 40), (60, 60), (40, 60)], [(4, 50), (12, 50), (12, 58), (20, 58), (20, 66), (4, 66)], [(-8, -8), (-2, -4), (-8, 0)]
    polys += [ring(100 + g, p) for g, p in enumerate(grid)]
    polys[14] += [(102, 9, *map(float, e)) for e in ((44, 44, 44, 56), (44, 56, 56, 56), (56, 56, 56, 44), (56, 44, 44, 44))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(-10, 100, (300, 2)), *rng.integers(-10, 70, (500, 2))])]
    got = {tuple(r) for r in spatial.polygon_hits(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame([e for p in polys for e in p], POLY), "id", cell).collect()}
    assert got == {(i, p[0][0]) for i, x, y in pts for p in polys if inside(x, y, p)}


def test_polygons_that_meet_lines(spark):
    rng = np.random.default_rng(3)
    polys = [ring(g, star(rng, *rng.uniform(0, 100, 2), int(rng.integers(3, 9)), 8)) for g in range(60)] + [ring(99, [(0, 0), (100, 0), (100, 100), (0, 100)])]
    rivers = random_segments(rng, 25) + [(77, 50.0, 50.0, 51.0, 50.0)]

    def cross(e, s):
        side = lambda px, py, a: np.sign((a[2] - a[0]) * (py - a[1]) - (a[3] - a[1]) * (px - a[0]))
        a, b = e[2:], s[1:]
        return side(b[0], b[1], a) * side(b[2], b[3], a) < 0 and side(a[0], a[1], b) * side(a[2], a[3], b) < 0

    def meets(p, s, tol):
        near = any(cross(e, s) or min(seg_dist(e[2], e[3], s), seg_dist(e[4], e[5], s), seg_dist(s[1], s[2], (0, *e[2:])), seg_dist(s[3], s[4], (0, *e[2:]))) <= tol for e in p)
        return near or inside(s[1], s[2], p)

    for tol, cell in ((0.0, 3.0), (1.5, 2.0)):
        got = {r.geom_id for r in lines.polygons_meeting_lines(spark.createDataFrame([e for p in polys for e in p], POLY), spark.createDataFrame(rivers, SEG), tol, cell).collect()}
        assert got == {p[0][0] for p in polys if any(meets(p, s, tol) for s in rivers)}


def test_far_points_visit_few_cells(spark):
    """All points far from all segments: few candidate cells a point, and the right distances."""
    rng = np.random.default_rng(4)
    segs = random_segments(rng, 1500, 60.0, 2.0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 60, (300, 2)) + np.array([3000.0, -1500.0]))]
    p, e = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(segs, SEG).withColumnRenamed("id", "g")
    cells = spatial.nearest_cells(p.select(F.col("x").alias("px"), F.col("y").alias("py")), e, 1.0)
    met = cells.join(spatial.along_segment(e, F.lit(1.0)), ["cx", "cy"])
    assert met.count() < 20 * len(pts)  # of 450 000 pairs
    got = {r.id: (r.dist, r.g) for r in spatial.nearest_segment(p, e, "id", ["g"], 1.0).collect()}
    for i, x, y in pts[::10]:
        want = min((seg_dist(x, y, s), s[0]) for s in segs)
        assert got[i][1] == want[1] and got[i][0] == pytest.approx(want[0], rel=1e-12)


def test_piled_up_points_are_counted_without_all_pairs(spark, monkeypatch):
    """Many locations in one cell: exact counts and squares, and far fewer joined rows than pairs."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(50, 0.4, (3000, 2)), rng.uniform(0, 100, (200, 2)), np.full((50, 2), 50.0)])
    df = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, g int, x double, y double")
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    got = {r.id: r.n for r in spatial.neighbours_within(df, ["g"], 1.0, "n").collect()}
    assert got == {i: int(n) for i, n in enumerate((np.sqrt(d2) <= 1.0).sum(axis=1))}
    k = {r.id: r.dens for r in spatial.kernel_density(df, ["g"], 1.0, "epanechnikov").collect()}
    want = (0.75 * np.maximum(0, 1 - d2) * (np.sqrt(d2) <= 1.0)).sum(axis=1) / math.pi
    assert [k[i] for i in range(len(xy))] == pytest.approx(want.tolist(), rel=1e-9)
    # the rows that the circle test looks at, level by level
    looked = []
    store = spatial.cut_lineage

    def counting(frame):
        out = store(frame)
        if "inside" in out.columns:
            cut = out.where("NOT inside")
            looked.append((out.count(), cut.where(F.col("c") <= spatial.LEAF_LOCATIONS).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]))
        return out

    monkeypatch.setattr(spatial, "cut_lineage", counting)
    spatial.neighbours_within(df, ["g"], 1.0, "n")
    assert len(looked) > 1 and sum(a + b for a, b in looked) < 0.35 * 3000**2


@pytest.mark.parametrize("rows", [100_000, 25])
def test_band_join_with_a_hot_value(spark, monkeypatch, rows):
    """One area of 30 percent of the candidates is dealt to several tasks; pairs are all there, once."""
    monkeypatch.setattr(spatial, "BAND_ROWS", rows)
    rng = np.random.default_rng(7)
    u = [(i, float(v)) for i, v in enumerate([*rng.lognormal(3, 2, 40), 5.0, 0.0, -1.0])] + [(99, None)]
    c = [(i, float(v)) for i, v in enumerate([*rng.lognormal(3, 2, 300), *[5.0] * 130, 0.0, 20.0, 1.25])] + [(999, None)]
    us, cs = (spark.createDataFrame(x, "id int, area double") for x in (u, c))
    got = spatial.area_band_join(us, cs)
    want = sorted((i, j) for i, a in u if a and a > 0 for j, b in c if b and b > 0 and a / 4 <= b <= a * 4)
    assert sorted((r.u_id, r.c_id) for r in got.collect()) == want
    if rows == 25:
        spread = cs.where("area = 5").count() / 25
        assert spread > 4 and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()
    assert spatial.area_band_join(us, cs.where("false")).count() == 0
    assert spatial.area_band_join(us.where("false"), cs).count() == 0
