"""Grouped regressions."""

from pyspark.sql import functions as F

from panelweave.operators import spatial, tables, trends
from panelweave.operators.prefix import null_safe_join
from panelweave.plans.registry import query, rounded
from panelweave.plans.standins import TRENDS, UNITS, WELLS, units, wells
from panelweave.session import cut_lineage

_K = ["aquifer", "cc"]


@query(
    "unit_trend_ols",
    f"WITH {WELLS}, {TRENDS} SELECT aquifer, cc, n, round(beta_0, 4) AS beta_0, round(se_0, 4) AS se_0, round(beta_1, 4) + 0.0 AS beta_1, round(se_1, 4) AS se_1 FROM trends",
)
def unit_trend_ols(spark, d):
    t = trends.unit_trends(wells(spark, d), _K, "y", "x", p_values=False)
    return rounded(t.select(*_K, "n", "beta_0", "se_0", "beta_1", "se_1"), 4)


@query("unit_trend_tests")
def unit_trend_tests(spark, d):
    """The same fits with t tests and leverage flags."""
    return trends.unit_trends(wells(spark, d), _K, "y", "x")


@query(
    "unit_trend_with_descriptors",
    f"""WITH {WELLS}, {TRENDS}, {UNITS} SELECT t.aquifer, t.cc, n, round(beta_1, 4) + 0.0 AS beta_1, TB, nW, round(urbkHaKm2, 6) AS urbkHaKm2, round(r.LB_river, 6) AS LB_river
       FROM trends t LEFT JOIN units u ON t.aquifer = u.aquifer AND t.cc = u.cc
       LEFT JOIN (SELECT aquifer, cc, avg(LB_river) AS LB_river FROM wells GROUP BY 1, 2) r ON t.aquifer = r.aquifer AND t.cc = r.cc""",
)
def unit_trend_with_descriptors(spark, d):
    w = wells(spark, d)
    t = trends.unit_trends(w, _K, "y", "x", p_values=False)
    out = trends.attach_descriptors(t, w, units(spark, d), _K, "LB_river")
    return rounded(out.select(*_K, "n", "beta_1", "TB", "nW", "urbkHaKm2", "LB_river"), 6, beta_1=4)


_WEIGHTED = f"""WITH {WELLS}, s AS (SELECT aquifer, cc, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS xb, sum(w * y) / sum(w) AS yb FROM (SELECT *, 1 + tax * 10 AS w FROM wells) GROUP BY 1, 2),
       b AS (SELECT v.aquifer, v.cc, any_value(n) AS n, any_value(sw) AS sw, any_value(yb) AS yb, any_value(xb) AS xb, sum(w * (x - xb) * (x - xb)) AS sxx, sum(w * (x - xb) * (y - yb)) AS sxy
             FROM (SELECT *, 1 + tax * 10 AS w FROM wells) v JOIN s ON v.aquifer = s.aquifer AND v.cc = s.cc GROUP BY 1, 2)
       SELECT v.aquifer, v.cc, any_value(n) AS n, round(any_value(yb), 2) AS beta_0, round(any_value(sxy / sxx), 4) + 0.0 AS beta_1,
         round(sqrt(sum(pow(w * (y - yb) / (1 - w / sw), 2))) / any_value(sw), 4) AS se_0,
         round(sqrt(sum(pow(w * (x - xb) * (y - yb - sxy / sxx * (x - xb)) / (1 - w * (1 / sw + (x - xb) * (x - xb) / sxx)), 2))) / any_value(sxx), 4) AS se_1
       FROM (SELECT *, 1 + tax * 10 AS w FROM wells) v JOIN b ON v.aquifer = b.aquifer AND v.cc = b.cc GROUP BY 1, 2 HAVING any_value(n) > 3"""


@query("weighted_unit_trend", _WEIGHTED)
def weighted_unit_trend(spark, d):
    return _weighted(wells(spark, d))


def _weighted(w):
    t = trends.unit_trends(w.withColumn("w", F.col("tax") * 10 + 1), _K, "y", "x", "w", p_values=False).where("n > 3")
    return rounded(t.select(*_K, "n", "beta_0", "se_0", "beta_1", "se_1"), 4, beta_0=2)


@query("weighted_trend_far_origin", f"SELECT aquifer, cc, n, beta_0, round(beta_1, 2) + 0.0 AS beta_1, round(se_1, 2) AS se_1 FROM ({_WEIGHTED.replace(', 4)', ', 9)')})")
def weighted_trend_far_origin(spark, d):
    """x moved by 1e7, as map coordinates are: slopes and errors stay."""
    w = wells(spark, d).withColumn("x", F.col("x") + 1e7).withColumn("w", F.col("tax") * 10 + 1)
    t = trends.unit_trends(w, _K, "y", "x", "w", p_values=False).where("n > 3")
    return rounded(t.select(*_K, "n", "beta_0", "beta_1", "se_1"), 2)


@query(
    "covariate_unit_trend",
    f"""WITH {WELLS}, m AS (SELECT aquifer, cc, count(*) AS n, avg(x) AS xb, avg(y) AS yb, avg(size) AS sb FROM wells GROUP BY 1, 2),
       s AS (SELECT w.aquifer, w.cc, any_value(n) AS n, sum(pow(x - xb, 2)) AS sxx, sum(pow(size - sb, 2)) AS sss, sum((x - xb) * (size - sb)) AS sxs,
             sum((x - xb) * (y - yb)) AS sxy, sum((size - sb) * (y - yb)) AS ssy FROM wells w JOIN m ON w.aquifer = m.aquifer AND w.cc = m.cc GROUP BY 1, 2)
       SELECT aquifer, cc, n, round((sss * sxy - sxs * ssy) / (sxx * sss - sxs * sxs), 4) + 0.0 AS beta_1 FROM s WHERE n > 10""",
)
def covariate_unit_trend(spark, d):
    t = trends.covariate_trends(wells(spark, d), _K, "y", "x", ["size"], p_values=False)
    return rounded(t.where("n > 10").select(*_K, "n", "beta_1"), 4)


@query("huber_unit_trend")
def huber_unit_trend(spark, d):
    return trends.huber_trends(cut_lineage(wells(spark, d).select(*_K, "y", "x")), _K, "y", "x")


_RADII = [0.0, 50.0, 150.0]


@query(
    "trend_by_decluster_radius",
    f"""WITH {WELLS}, g AS (SELECT *, row_number() OVER () AS rid FROM wells), r AS (SELECT unnest([0.0, 50.0, 150.0]) AS dclust),
       loc AS (SELECT DISTINCT aquifer, cc, px, py FROM wells), cnt AS (SELECT aquifer, cc, px, py, count(*) AS m FROM wells GROUP BY 1, 2, 3, 4),
       nb AS (SELECT a.aquifer, a.cc, a.px, a.py, dclust, CAST(sum(m) AS DOUBLE) AS k FROM loc a JOIN cnt b ON a.aquifer = b.aquifer AND a.cc = b.cc
              JOIN r ON pow(a.px - b.px, 2) + pow(a.py - b.py, 2) <= dclust * dclust GROUP BY 1, 2, 3, 4, 5),
       w0 AS (SELECT g.aquifer, g.cc, dclust, x, y, 1.0 / k AS w FROM g JOIN nb ON g.aquifer = nb.aquifer AND g.cc = nb.cc AND g.px = nb.px AND g.py = nb.py),
       q AS (SELECT aquifer, cc, dclust, count(*) AS n, quantile_cont(w, 0.99) AS cap FROM w0 GROUP BY 1, 2, 3),
       w1 AS (SELECT w0.*, n, CASE WHEN w0.dclust = 0 OR n < 3 THEN 1.0 ELSE least(w, cap) END AS wt FROM w0 JOIN q ON w0.aquifer = q.aquifer AND w0.cc = q.cc AND w0.dclust = q.dclust),
       s AS (SELECT aquifer, cc, dclust, count(*) AS n, sum(wt) AS sw, sum(wt * x) / sum(wt) AS xb, sum(wt * y) / sum(wt) AS yb FROM w1 GROUP BY 1, 2, 3)
       SELECT w1.aquifer, w1.cc, w1.dclust, any_value(s.n) AS n, round(any_value(yb) + 1e-6, 3) AS beta_0, round(sum(wt * (x - xb) * (y - yb)) / sum(wt * pow(x - xb, 2)), 3) + 0.0 AS beta_1
       FROM w1 JOIN s ON w1.aquifer = s.aquifer AND w1.cc = s.cc AND w1.dclust = s.dclust GROUP BY 1, 2, 3 HAVING any_value(s.n) > 3""",
)
def trend_by_decluster_radius(spark, d):
    """Estimation repeated over radii; the radius is one more group key."""
    k = [*_K, "dclust"]
    w = spatial.decluster_by_radius(wells(spark, d).select(*_K, "x", "y", "px", "py"), _K, _RADII, x="px", y="py")
    t = trends.unit_trends(w, k, "y", "x", "w", p_values=False).where("n > 3")
    return rounded(t.select(*k, "n", (F.col("beta_0") + 1e-6).alias("beta_0"), "beta_1"), 3)


@query(
    "river_free_trends",
    f"""WITH all_wells AS (WITH {WELLS} SELECT *, tax = 0.08 AND size > 48 AS flagged FROM wells), wells AS (SELECT * FROM all_wells WHERE aquifer || '-' || cc NOT IN (SELECT aquifer || '-' || cc FROM all_wells WHERE flagged)), {TRENDS}
       SELECT aquifer, cc, n, round(beta_0 + 1e-7, 4) AS beta_0 FROM trends""",
)
def river_free_trends(spark, d):
    """Fits on units without any flagged row."""
    w = tables.drop_flagged_groups(wells(spark, d), _K, (F.col("tax") == 0.08) & (F.col("size") > 48))
    return rounded(trends.unit_trends(w, _K, "y", "x", p_values=False).select(*_K, "n", (F.col("beta_0") + 1e-7).alias("beta_0")), 4)
