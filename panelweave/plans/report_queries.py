"""Aggregates behind tables and figures."""

from pyspark.sql import functions as F

from panelweave.functions.distributions import p_normal, p_student
from panelweave.operators import reports
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import WELLS, wells

_E = "SELECT l_suppkey % 10 AS grp, l_quantity - 25 AS eff, CASE WHEN l_linenumber <> 2 THEN l_discount END AS p, l_returnflag = 'R' AS TB, l_tax AS w FROM lineitem"


def _effects(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("grp"), (F.col("l_quantity") - 25).alias("eff"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("p"),
        (F.col("l_returnflag") == "R").alias("TB"), F.col("l_tax").alias("w"),
    )


@query(
    "median_quartiles",
    """WITH l AS (SELECT l_returnflag, 'l_quantity' AS Variable, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem),
       q AS (SELECT l_returnflag, Variable, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l GROUP BY 1, 2)
       SELECT l_returnflag, Variable, round(a, 3) AS q25, round(b, 3) AS median, round(c, 3) AS q75 FROM q""",
)
def median_quartiles(spark, d):
    q = reports.quartile_rows(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return rounded(q.drop("text"), 3)


@query(
    "weighted_quartiles",
    """WITH t AS (SELECT l_returnflag AS g, l_quantity AS x, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
       c AS (SELECT g, x, sum(w) OVER (PARTITION BY g ORDER BY x) AS cum, sum(w) OVER (PARTITION BY g) AS s FROM t),
       p AS (SELECT unnest([0.25, 0.5, 0.75]) AS p), h AS (SELECT c.*, p, 1 + (s - 1) * CAST(p AS DOUBLE) AS pos FROM c, p),
       r AS (SELECT g, p, min(x) FILTER (cum >= least(greatest(floor(pos), 1), s)) AS a, min(x) FILTER (cum >= least(floor(pos) + 1, s)) AS b, any_value(pos - floor(pos)) AS f FROM h GROUP BY 1, 2)
       SELECT g AS l_returnflag, 'l_quantity' AS Variable, round(max((1 - f) * a + f * b) FILTER (p = 0.25), 4) AS q25, round(max((1 - f) * a + f * b) FILTER (p = 0.5), 4) AS median,
       round(max((1 - f) * a + f * b) FILTER (p = 0.75), 4) AS q75 FROM r GROUP BY 1""",
)
def weighted_quartiles(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.col("l_linenumber").cast("double").alias("w"))
    return rounded(reports.quartile_rows(l, ["l_returnflag"], ["l_quantity"], "w").drop("text"), 4)


@query(
    "mixed_summary",
    """WITH p AS (SELECT quantile_cont(v * 100, 0.25) AS a, quantile_cont(v * 100, 0.5) AS b, quantile_cont(v * 100, 0.75) AS c FROM (SELECT l_discount AS v FROM lineitem WHERE l_discount > 0)),
       g AS (SELECT count(*) FILTER (x IS NULL) AS nas, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM (SELECT CASE WHEN l_quantity > 5 THEN l_tax END AS x FROM lineitem))
       SELECT 'l_discount' AS Variable, (SELECT count(*) FILTER (l_discount = 0) FROM lineitem)::DOUBLE AS Zeros, NULL::DOUBLE AS NAs, round(a, 6) AS Q25, round(b, 6) AS Median, round(c, 6) AS Q75, NULL::DOUBLE AS Count FROM p
       UNION ALL SELECT 'tax', NULL, nas::DOUBLE, round(a, 6), round(b, 6), round(c, 6), NULL FROM g
       UNION ALL SELECT 'l_returnflag=' || l_returnflag, NULL, NULL, NULL, NULL, NULL, count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag
       UNION ALL SELECT 'l_suppkey (unique categories)', NULL, NULL, NULL, NULL, NULL, count(DISTINCT l_suppkey)::DOUBLE FROM lineitem
       UNION ALL SELECT 'Total rows', NULL, NULL, NULL, NULL, NULL, count(*)::DOUBLE FROM lineitem""",
)
def mixed_summary(spark, d):
    l = table(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_quantity") > 5, F.col("l_tax")))
    return rounded(reports.mixed_summary(l, ["l_discount"], ["tax"], ["l_returnflag"], ["l_suppkey"]))


@query(
    "effect_counts",
    f"""WITH e AS ({_E}) SELECT grp, count(*) AS total, count(*) FILTER (p < 0.1) AS n_signif, count(*) FILTER (eff > 0) AS n_pos, count(*) FILTER (eff < 0) AS n_neg,
       count(*) FILTER (p < 0.1 AND eff > 0) AS n_pos_signif, count(*) FILTER (p < 0.1 AND eff < 0) AS n_neg_signif FROM e GROUP BY 1""",
)
def effect_counts(spark, d):
    return reports.effect_counts(_effects(spark, d), ["grp"], "eff", "p")


@query(
    "response_shares",
    f"""WITH e AS ({_E}), c AS (SELECT *, CASE WHEN p > 0.05 AND eff < 0 THEN 'neg_ns' WHEN p > 0.05 THEN 'pos_ns' WHEN eff < 0 THEN 'neg' WHEN eff > 0 THEN 'pos' END AS Res FROM e),
       g AS (SELECT TB, Res, count(*) AS n, sum(w) AS w_sum, avg(CASE WHEN p IS NOT NULL THEN CASE WHEN eff > 0 THEN 1.0 WHEN eff < 0 THEN -1.0 ELSE 0.0 END * (1 - least(p / 0.3, 1.0)) END) AS mc FROM c WHERE Res IS NOT NULL GROUP BY 1, 2)
       SELECT TB, Res, n, round(w_sum, 4) AS w_sum, round(mc, 6) AS mean_color, round(n / sum(n) OVER (PARTITION BY TB), 6) AS prop_unweighted,
       round(w_sum / sum(w_sum) OVER (PARTITION BY TB), 6) AS prop_weighted, CAST(sum(n) OVER (PARTITION BY TB) AS BIGINT) AS total_n FROM g""",
)
def response_shares(spark, d):
    return rounded(reports.response_shares(_effects(spark, d), "TB", "eff", "p", "w", 0.05), 6, w_sum=4)


@query(
    "sign_shares",
    f"""WITH e AS ({_E}), s AS (SELECT grp, avg(CAST(coalesce(p < 0.05 AND eff > 0, false) AS DOUBLE)) AS a, avg(CAST(coalesce(p >= 0.05 OR (p < 0.05 AND eff = 0), false) AS DOUBLE)) AS b,
       avg(CAST(coalesce(p < 0.05 AND eff < 0, false) AS DOUBLE)) AS c FROM e GROUP BY 1)
       SELECT grp, round(a / (a + b + c), 6) AS share_pos, round(b / (a + b + c), 6) AS share_ns, round(c / (a + b + c), 6) AS share_neg FROM s""",
)
def sign_shares(spark, d):
    return rounded(reports.sign_shares(_effects(spark, d), ["grp"], "eff", "p", 0.05))


@query(
    "sweep_summary",
    f"WITH e AS ({_E}) SELECT grp, count(*) AS n, round(avg(eff), 6) + 0.0 AS mean, round(stddev_samp(eff), 6) AS sd, round(avg(CAST(p < 0.05 AS DOUBLE)), 6) AS share_significant FROM e GROUP BY 1",
)
def sweep_summary(spark, d):
    return rounded(reports.sweep_summary(_effects(spark, d), ["grp"], "eff", "p", 0.05))


@query(
    "binned_means",
    f"""WITH {WELLS}, d AS (SELECT TB, floor(px / 200) * 200.0 AS bin, y, tax + 0.01 AS w FROM wells WHERE px < 3000), m AS (SELECT TB, bin, count(*) AS n, sum(w) AS w_sum, sum(w * y) / sum(w) AS mean FROM d GROUP BY 1, 2),
       s AS (SELECT m.TB, m.bin, any_value(n) AS n, any_value(w_sum) AS w_sum, any_value(mean) AS mean, sqrt(sum(w * pow(y - mean, 2))) / sqrt(any_value(n)) AS se FROM d JOIN m ON d.TB = m.TB AND d.bin = m.bin GROUP BY 1, 2)
       SELECT TB, bin, n, round(w_sum, 4) AS w_sum, round(mean, 4) AS mean, round(se, 4) AS se, round(mean - 1.645 * se, 3) AS ci_low, round(mean + 1.645 * se, 3) AS ci_high,
       round((w_sum - min(w_sum) OVER (PARTITION BY TB)) / (max(w_sum) OVER (PARTITION BY TB) - min(w_sum) OVER (PARTITION BY TB)), 6) AS w_rel FROM s""",
)
def binned_means(spark, d):
    w = wells(spark, d).withColumn("w", F.col("tax") + 0.01)
    return rounded(reports.binned_means(w, "TB", "px", "y", "w", 200.0, 3000.0), 4, ci_low=3, ci_high=3, w_rel=6)


@query(
    "cumulative_shares",
    """WITH s AS (SELECT l_partkey, sum(l_quantity) AS wells FROM lineitem GROUP BY 1)
       SELECT l_partkey, wells, round(wells / sum(wells) OVER (), 8) AS share, round(sum(wells) OVER (ORDER BY wells DESC, l_partkey ROWS UNBOUNDED PRECEDING) / sum(wells) OVER (), 8) AS cum_share FROM s""",
)
def cumulative_shares(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("wells"))
    return rounded(reports.concentration_of_rows(s, "wells", "wells", "l_partkey"), 8)


@query(
    "top_shares",
    """WITH s AS (SELECT l_suppkey, sum(l_quantity) AS wells FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY wells DESC, l_suppkey) AS r FROM s)
       SELECT CAST(t AS INTEGER) AS top, round(sum(wells) FILTER (r <= t) / sum(wells), 6) AS share FROM r, (SELECT unnest([1, 3, 5]) AS t) GROUP BY 1""",
)
def top_shares(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("wells"))
    return rounded(reports.top_shares(s, "wells", "l_suppkey"))


@query(
    "overlap_totals",
    """WITH u AS (SELECT l_orderkey, l_returnflag = 'R' AS TB, count(*) AS n, l_linestatus FROM lineitem GROUP BY 1, 2, 4), b AS (SELECT l_orderkey FROM u GROUP BY 1 HAVING bool_or(TB) AND bool_or(NOT TB))
       SELECT count(*) AS n_units, sum(n)::BIGINT AS n_rows, count(*) FILTER (l_orderkey IN (SELECT l_orderkey FROM b)) AS n_units_in, coalesce(sum(n) FILTER (l_orderkey IN (SELECT l_orderkey FROM b)), 0)::BIGINT AS n_rows_in,
       round(avg(CAST(l_orderkey IN (SELECT l_orderkey FROM b) AS INTEGER)) * 100, 6) AS pct_units_in, round(coalesce(sum(n) FILTER (l_orderkey IN (SELECT l_orderkey FROM b)), 0) / sum(n) * 100, 6) AS pct_rows_in FROM u""",
)
def overlap_totals(spark, d):
    from panelweave.operators.tables import both_arms

    u = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_returnflag") == "R").alias("TB"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(reports.overlap_totals(u, both_arms(u, "l_orderkey", F.col("TB")), "l_orderkey", "n"))


_W = """wide AS (SELECT s_nationkey AS lab, 'TBTRUE' AS nm_0, avg(s_acctbal) AS b_0, stddev_pop(s_acctbal) AS se_0, CASE WHEN s_nationkey % 2 = 0 THEN 'intrcpt' ELSE 'other' END AS nm_1, min(s_acctbal) AS b_1, max(s_acctbal) AS se_1 FROM supplier GROUP BY 1)"""


@query(
    "stacked_terms",
    f"""WITH {_W}, l AS (SELECT lab, 'Mean depletion' AS model, nm_0 AS term, b_0 AS est, se_0 AS se FROM wide UNION ALL SELECT lab, 'Distance trend', nm_1, b_1, se_1 FROM wide)
       SELECT lab, model, CASE term WHEN 'intrcpt' THEN '(Intercept)' ELSE term END AS term, round(est, 4) AS est, round(se, 4) AS se, round(est - 1.64 * se, 3) AS ci_low, round(est + 1.64 * se, 3) AS ci_high FROM l WHERE term IN ('intrcpt', 'TBTRUE')""",
)
def stacked_terms(spark, d):
    b = F.col("s_acctbal")
    w = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("lab")).agg(F.avg(b).alias("b_0"), F.stddev_pop(b).alias("se_0"), F.min(b).alias("b_1"), F.max(b).alias("se_1"))
    w = w.withColumn("nm_0", F.lit("TBTRUE")).withColumn("nm_1", F.when(F.col("lab") % 2 == 0, "intrcpt").otherwise("other"))
    out = reports.stack_terms(w, ["lab"], {"0": "Mean depletion", "1": "Distance trend"}, {"intrcpt": "(Intercept)", "TBTRUE": "TBTRUE"})
    return rounded(out, 4, ci_low=3, ci_high=3)


@query(
    "regression_table_body",
    """WITH t AS (SELECT o_orderstatus AS label, CASE WHEN o_orderpriority LIKE '1%' THEN 'intrcpt' ELSE 'TBTRUE' END AS term, avg(o_totalprice) / 1000 AS b, count(*) / 1e7 AS se FROM orders GROUP BY 1, 2),
       s AS (SELECT *, CASE WHEN abs(b) < 0.001 THEN '<0.001' ELSE printf('%.3f', b) END || ' (' || CASE WHEN abs(se) < 0.001 THEN '<0.001' ELSE printf('%.3f', se) END || ')' AS e FROM t)
       SELECT CAST("row" AS INTEGER) AS "row", term_out, max(e) FILTER (label = 'F') AS F, max(e) FILTER (label = 'O') AS O, max(e) FILTER (label = 'P') AS P FROM (
         SELECT CASE term WHEN 'intrcpt' THEN 0 ELSE 2 END AS "row", CASE term WHEN 'intrcpt' THEN 'Intercept' ELSE 'Transboundary' END AS term_out, label, e FROM s
         UNION ALL SELECT CASE term WHEN 'intrcpt' THEN 1 ELSE 3 END, '', label, '[]' FROM s
         UNION ALL SELECT 4, 'Tau^2', label, '' FROM s UNION ALL SELECT 5, 'Observations', label, CAST(n AS VARCHAR) FROM (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
         UNION ALL SELECT 6, 'Clusters', label, NULL FROM s) GROUP BY 1, 2""",
)
def regression_table_body(spark, d):
    o = table(spark, d, "orders").withColumn("label", F.col("o_orderstatus"))
    n = o.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    t = o.groupBy("label", F.when(F.col("o_orderpriority").like("1%"), "intrcpt").otherwise("TBTRUE").alias("term")).agg(
        (F.avg("o_totalprice") / 1000).alias("estimate"), (F.count(F.lit(1)) / 1e7).alias("se")
    )
    return reports.regression_table(t.join(n, "label"), "label", ["F", "O", "P"], {"intrcpt": "Intercept", "TBTRUE": "Transboundary"})


@query("tail_probabilities")
def tail_probabilities(spark, d):
    """Normal and t tails of standardised order totals per customer."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    z = (F.col("m") - 250000) / (F.col("s") / F.sqrt("n"))
    return o.where(F.col("s") > 0).select("o_custkey", p_normal(z).alias("p_z"), p_student(z, (F.col("n") - 1).cast("double")).alias("p_t"))
