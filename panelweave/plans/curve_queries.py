"""Percentile curves, concentration, densities and class comparisons."""

from pyspark.sql import functions as F

from panelweave.operators import curves, summaries
from panelweave.plans.registry import query, rounded, table

_PS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"

# land curve of one nation against the curve of its discounted lines, as (unit, k, p, l, i)
_CURVES = f"""li AS (SELECT s_nationkey AS unit_id, l_extendedprice AS v, l_discount, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  land AS (SELECT unit_id, quantile_cont(v, {_PS}) AS q FROM li GROUP BY 1)"""


def _act(name: str, cond: str) -> str:
    return f"{name} AS (SELECT unit_id, quantile_cont(v, {_PS}) AS q FROM li WHERE {cond} GROUP BY 1)"


def _gini_sql(name: str, act: str) -> str:
    """Long form: points (k, p, l, i) with l, i running maxima (percentiles already increase)."""
    return f"""{name}_c AS (SELECT a.unit_id, k, k * 10.0 - 10.0 AS p, a.q[k] AS l, b.q[k] AS i FROM land a JOIN {act} b USING (unit_id), (SELECT unnest(range(1, 12)) AS k)),
  {name}_r AS (SELECT x.*, (SELECT max(k) FROM {name}_c y WHERE y.unit_id = x.unit_id AND y.i <= x.l) AS ki, (SELECT max(k) FROM {name}_c y WHERE y.unit_id = x.unit_id AND y.l <= x.i) AS kl FROM {name}_c x),
  {name}_p AS (
    SELECT r.unit_id, r.p AS x, CASE WHEN ki IS NULL THEN 0.0 WHEN ki = 11 OR a.i = r.l THEN a.p ELSE a.p + (b.p - a.p) * (r.l - a.i) / (b.i - a.i) END AS y
    FROM {name}_r r LEFT JOIN {name}_c a ON a.unit_id = r.unit_id AND a.k = r.ki LEFT JOIN {name}_c b ON b.unit_id = r.unit_id AND b.k = r.ki + 1
    UNION ALL
    SELECT r.unit_id, CASE WHEN kl IS NULL THEN 0.0 WHEN kl = 11 OR a.l = r.i THEN a.p ELSE a.p + (b.p - a.p) * (r.i - a.l) / (b.l - a.l) END, r.p
    FROM {name}_r r LEFT JOIN {name}_c a ON a.unit_id = r.unit_id AND a.k = r.kl LEFT JOIN {name}_c b ON b.unit_id = r.unit_id AND b.k = r.kl + 1),
  {name}_d AS (SELECT unit_id, min(x) AS x, min(y) AS y FROM {name}_p GROUP BY unit_id, round(x, 6), round(y, 6)),
  {name}_s AS (SELECT unit_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 20000 AS a FROM {name}_d WINDOW w AS (PARTITION BY unit_id ORDER BY x, y)),
  {name} AS (SELECT unit_id, round(1 - 2 * sum(a), 6) + 0.0 AS gini FROM {name}_s GROUP BY 1)"""


def _lines(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return l.join(s, l.l_suppkey == s.s_suppkey).select(
        F.col("s_nationkey").alias("unit_id"), F.col("l_extendedprice").alias("v"), "l_discount", "l_returnflag"
    )


def _curve(df):
    return curves.percentile_curve(df, ["unit_id"], "v")


@query(
    "percentile_curves",
    f"WITH {_CURVES} SELECT unit_id, k * 10.0 - 10.0 AS p, round(q[k], 4) AS v FROM land, (SELECT unnest(range(1, 12)) AS k)",
)
def percentile_curves(spark, d):
    return rounded(_curve(_lines(spark, d)).select("unit_id", F.inline("curve")), 4)


@query("concentration_index", f"WITH {_CURVES}, {_act('act', 'l_discount > 0.05')}, {_gini_sql('g', 'act')} SELECT unit_id, gini FROM g")
def concentration_index(spark, d):
    l = _lines(spark, d)
    land = _curve(l).withColumnRenamed("curve", "land")
    act = _curve(l.where(F.col("l_discount") > 0.05))
    return rounded(curves.concentration(land.join(act, "unit_id"), "land", "curve").select("unit_id", "gini"))


@query(
    "concentration_by_mask",
    f"""WITH {_CURVES}, {_act('a1', "l_discount > 0.05")}, {_act('a2', "l_returnflag = 'R'")}, {_act('a3', "v > 30000")}, {_gini_sql('g1', 'a1')}, {_gini_sql('g2', 'a2')}, {_gini_sql('g3', 'a3')}
       SELECT unit_id, g1.gini AS disc, g2.gini AS returned, g3.gini AS dear FROM g1 LEFT JOIN g2 USING (unit_id) LEFT JOIN g3 USING (unit_id)""",
)
def concentration_by_mask(spark, d):
    l = _lines(spark, d)
    masks = {"disc": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R", "dear": F.col("v") > 30000}
    return rounded(curves.concentration_star(_curve(l), {k: _curve(l.where(m)) for k, m in masks.items()}, ["unit_id"]))


@query(
    "density_grid",
    """WITH s AS (SELECT c_mktsegment AS side, count(*) AS n, stddev_samp(c_acctbal) AS sd, (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34 AS iq,
         min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer GROUP BY 1),
       b AS (SELECT *, 0.9 * least(sd, iq) * pow(n, -0.2) AS bw FROM s),
       g AS (SELECT side, k, mn - 3 * bw + (mx - mn + 6 * bw) * k / 255 AS y, bw, n FROM b, (SELECT unnest(range(256)) AS k)),
       e AS (SELECT side, k, any_value(y) AS y, sum(exp(-0.5 * pow((y - c_acctbal) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS dens
             FROM g JOIN customer ON c_mktsegment = side GROUP BY 1, 2)
       SELECT side, CAST(k AS INTEGER) AS k, round(y, 4) + 0.0 AS y, round(dens, 10) AS dens, round(0.3 * dens / max(dens) OVER (PARTITION BY side), 6) AS w FROM e""",
)
def density_grid(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("side"), "c_acctbal")
    return rounded(summaries.density_grid(c, ["side"], "c_acctbal"), 6, y=4, dens=10)


@query(
    "binned_density_grid",
    """WITH s AS (SELECT c_mktsegment AS side, count(*) AS n, stddev_samp(c_acctbal) AS sd, (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34 AS iq,
         min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer GROUP BY 1),
       b AS (SELECT *, 0.9 * least(sd, iq) * pow(n, -0.2) AS bw FROM s), c AS (SELECT *, mn - 7 * bw AS lo, (mx - mn + 14 * bw) / 511 AS step FROM b),
       x AS (SELECT side, floor((c_acctbal - lo) / step)::INTEGER AS i, (c_acctbal - lo) / step - floor((c_acctbal - lo) / step) AS f FROM customer JOIN c ON c_mktsegment = side),
       h AS (SELECT side, i, sum(w) AS w FROM (SELECT side, i, 1 - f AS w FROM x UNION ALL SELECT side, i + 1, f FROM x) GROUP BY 1, 2),
       d AS (SELECT side, j, sum(w * exp(-0.5 * pow((j - i) * step / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS dens FROM h JOIN c USING (side), (SELECT unnest(range(512)) AS j) GROUP BY 1, 2),
       g AS (SELECT side, k, mn - 3 * bw + (mx - mn + 6 * bw) * k / 255 AS y, (4 * bw + (mx - mn + 6 * bw) * k / 255) / step AS pos FROM c, (SELECT unnest(range(256)) AS k)),
       e AS (SELECT side, k, y, p.dens + (q.dens - p.dens) * (pos - floor(pos)) AS dens FROM g JOIN d p USING (side) JOIN d q USING (side) WHERE p.j = floor(pos) AND q.j = floor(pos) + 1)
       SELECT side, CAST(k AS INTEGER) AS k, round(y, 4) + 0.0 AS y, round(dens, 10) + 0.0 AS dens, round(0.3 * dens / max(dens) OVER (PARTITION BY side), 6) AS w FROM e""",
)
def binned_density_grid(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("side"), "c_acctbal")
    return rounded(summaries.binned_density(c, ["side"], "c_acctbal"), 6, y=4, dens=10)


@query(
    "spread_summary",
    """SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.05), 4) AS p05, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(quantile_cont(c_acctbal, 0.5), 4) AS p50,
       round(quantile_cont(c_acctbal, 0.75), 4) AS p75, round(quantile_cont(c_acctbal, 0.95), 4) AS p95 FROM customer GROUP BY 1""",
)
def spread_summary(spark, d):
    return rounded(summaries.spread_summary(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal"), 4)


@query(
    "normalised_class_means",
    """SELECT l_returnflag, round(avg(l_quantity / m), 6) AS mean, round(stddev_samp(l_quantity / m) / sqrt(count(*)), 8) AS se FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem) GROUP BY 1""",
)
def normalised_class_means(spark, d):
    return rounded(summaries.normalised_class_means(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), 6, se=8)


_MOM = """m AS (SELECT o_orderstatus AS variable, o_orderpriority AS class, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  a AS (SELECT variable, count(*) AS k, sum(n)::BIGINT AS n, sum(n * mean * mean) - pow(sum(n * mean), 2) / sum(n) AS ssb, sum((n - 1) * v) AS ssw FROM m GROUP BY 1)"""


@query(
    "class_mean_errors",
    """SELECT o_orderpriority AS class, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se FROM orders GROUP BY 1""",
)
def class_mean_errors(spark, d):
    """Means and errors; the t interval around them is compared by the tests."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), "o_totalprice")
    return rounded(summaries.class_means(o, [], "class", "o_totalprice").select("class", "mean", "se"), 4)


@query(
    "one_way_anova",
    f"WITH {_MOM} SELECT variable, k, n, round(ssw / (n - k), 0) AS mse, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_value FROM a",
)
def one_way_anova(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variable"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("value"))
    return rounded(summaries.anova(o, ["variable"], "class", "value").drop("ss_between", "ss_within"), 6, mse=0)


@query(
    "pairwise_class_ranges",
    f"""WITH {_MOM} SELECT l.variable, l.class AS class_1, r.class AS class_2, round(r.mean - l.mean, 4) + 0.0 AS diff,
       round(abs(r.mean - l.mean) / sqrt(ssw / (a.n - k) / 2 * (1.0 / l.n + 1.0 / r.n)), 6) AS q FROM m l JOIN m r ON l.variable = r.variable AND l.class < r.class JOIN a ON a.variable = l.variable""",
)
def pairwise_class_ranges(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variable"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("value"))
    p = summaries.pairwise_ranges(o, ["variable"], "class", "value", p_values=False)
    return rounded(p.select("variable", "class_1", "class_2", "diff", "q"), 6, diff=4)


@query("class_letters")
def class_letters(spark, d):
    """Tukey comparison at 90% with compact letters and t intervals per class."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variable"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("value"))
    lets = summaries.compact_letters(summaries.pairwise_ranges(o, ["variable"], "class", "value"), "variable", 0.1)
    return summaries.class_means(o, ["variable"], "class", "value").join(lets, ["variable", "class"], "left")
