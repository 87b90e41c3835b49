"""Column rules, filters, aggregates, windows and reshaping."""

from pyspark.sql import functions as F

from panelweave.functions import labels, nulls
from panelweave.operators import prefix, tables
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import TRENDS, UNITS, WELLS, units, wells
from panelweave.operators.trends import unit_trends

# ---- columns and filters ---------------------------------------------------------------


@query(
    "publication_renames",
    "SELECT s_suppkey AS Supplier_Code, s_name AS Supplier, round(s_acctbal * 1000, 2) AS balance_mm FROM supplier",
)
def publication_renames(spark, d):
    s = table(spark, d, "supplier").withColumn("balance_mm", F.round(F.col("s_acctbal") * 1000, 2))
    return tables.rename_map(s, {"s_suppkey": "Supplier_Code", "s_name": "Supplier", "balance_mm": "balance_mm"})


@query(
    "suffixed_columns",
    "SELECT n_nationkey, n_name AS n_name_B1_2, n_regionkey AS n_regionkey_B1_2 FROM nation",
)
def suffixed_columns(spark, d):
    return tables.suffix_columns(table(spark, d, "nation"), ["n_name", "n_regionkey"], "_B1", 2)


@query(
    "dynamic_selection",
    "SELECT p_partkey, p_size, p_retailprice, p_name FROM part",
)
def dynamic_selection(spark, d):
    p = table(spark, d, "part")
    cols = tables.pick_columns(p, numeric=True) + tables.pick_columns(p, names=["p_name", "absent"])
    return p.select(*cols)


@query(
    "valid_unit_filter",
    f"WITH {WELLS}, {TRENDS}, {UNITS} SELECT t.aquifer, t.cc, n, TB FROM trends t JOIN units u ON t.aquifer = u.aquifer AND t.cc = u.cc WHERE n > 20 AND beta_1 IS NOT NULL AND se_0 > 0 AND se_1 > 0",
)
def valid_unit_filter(spark, d):
    t = unit_trends(wells(spark, d), ["aquifer", "cc"], "y", "x", p_values=False)
    u = tables.natural_left_join(t, units(spark, d).select("aquifer", "cc", "TB"))
    return tables.valid_units(u, 20).select("aquifer", "cc", "n", "TB")


_GAPS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN l_quantity END AS q, CASE WHEN l_discount > 0 THEN l_discount END AS disc, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS flag FROM lineitem"


def _gaps(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("disc"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"),
    )


@query("complete_cases", f"WITH g AS ({_GAPS}) SELECT flag, count(*) AS n FROM g WHERE q IS NOT NULL AND disc IS NOT NULL AND flag IS NOT NULL GROUP BY flag")
def complete_cases(spark, d):
    return tables.complete_cases(_gaps(spark, d), ["q", "disc", "flag", "absent"]).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("exclusion_list", f"WITH g AS ({_GAPS}) SELECT flag, count(*) AS n FROM g WHERE flag IS NULL OR flag NOT IN ('A', 'X') GROUP BY flag")
def exclusion_list(spark, d):
    return tables.drop_listed(_gaps(spark, d), "flag", ["A", "X"]).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flagged_group_exclusion",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
)
def flagged_group_exclusion(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return tables.drop_flagged_groups(l, ["l_orderkey"], F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("listing_mismatches", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE NOT contains(o_orderpriority, o_orderstatus)")
def listing_mismatches(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return tables.not_listed_in(o, "o_orderpriority", "o_orderstatus")


@query(
    "conditional_recode",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
       coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' END, c_mktsegment) AS seg FROM customer""",
)
def conditional_recode(spark, d):
    b, s = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"),
        F.coalesce(F.when(s == "BUILDING", "B"), s).alias("seg"),
    )


@query(
    "manual_overrides",
    """SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 3 ELSE CAST(c_custkey % 3 AS INTEGER) END AS score FROM customer""",
)
def manual_overrides(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 3).cast("int").alias("score"))
    t = table(spark, d, "nation").where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("c_nationkey"), F.lit(3).alias("new_score"))
    return tables.override_values(c, "score", "c_nationkey", t, "new_score").select("c_custkey", "score")


@query("surrogate_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id FROM orders")
def surrogate_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return prefix.number_rows(o, "o_totalprice", "id", ["o_orderkey"]).select("o_orderkey", "id")


@query("composite_key", f"WITH {WELLS} SELECT aquifer || '_' || CAST(cc AS VARCHAR) AS unit_id, count(*) AS n FROM wells GROUP BY 1")
def composite_key(spark, d):
    return wells(spark, d).select(F.concat_ws("_", "aquifer", F.col("cc").cast("string")).alias("unit_id")).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clamp_and_units",
    "SELECT c_custkey, greatest(least(c_acctbal / 50, 100.0), 0.0) AS pct, round(c_acctbal * 1000, 1) AS mm, round(c_acctbal / 1e6, 8) AS km2 FROM customer",
)
def clamp_and_units(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", nulls.clamp(F.col("c_acctbal") / 50, 0.0, 100.0).alias("pct"), F.round(F.col("c_acctbal") * 1000, 1).alias("mm"),
        F.round(F.col("c_acctbal") / 1e6, 8).alias("km2"),
    )


_P = "CASE WHEN l_linenumber <> 2 THEN l_discount END"


@query(
    "significance_labels",
    f"""SELECT stars, band, slope, count(*) AS n FROM (
      SELECT CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars,
             CASE WHEN p < 0.01 THEN '<0.01' WHEN p < 0.05 THEN '<0.05' WHEN p < 0.1 THEN '<0.1' ELSE '≥0.1' END AS band,
             CASE WHEN b > 0 AND p < 0.1 THEN 'pos_sig' WHEN b > 0 AND p >= 0.1 THEN 'pos_nonsig'
                  WHEN b < 0 AND p < 0.1 THEN 'neg_sig' WHEN b < 0 AND p >= 0.1 THEN 'neg_nonsig' END AS slope
      FROM (SELECT {_P} AS p, l_quantity - 25 AS b FROM lineitem)) GROUP BY 1, 2, 3""",
)
def significance_labels(spark, d):
    l = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("p"), (F.col("l_quantity") - 25).alias("b"))
    return (
        l.select(labels.stars("p").alias("stars"), labels.significance_band("p").alias("band"), labels.slope_class("b", "p").alias("slope"))
        .groupBy("stars", "band", "slope")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "checked_rows",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def checked_rows(spark, d):
    o = tables.check(table(spark, d, "orders"), F.col("o_orderkey").isNotNull() & (F.col("o_totalprice") > 0), "order without key or price")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "nested_shares",
    """WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (l_returnflag <> 'N') AS DOUBLE) AS part,
         CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS sub FROM lineitem)
       SELECT 'total' AS bar, 'rest' AS component, total - part AS area, round((total - part) / total, 6) AS share FROM t
       UNION ALL SELECT 'total', 'part', part, round(part / total, 6) FROM t
       UNION ALL SELECT 'part', 'other', part - sub, round((part - sub) / part, 6) FROM t
       UNION ALL SELECT 'part', 'sub', sub, round(sub / part, 6) FROM t""",
)
def nested_shares(spark, d):
    f = F.col("l_returnflag")
    t = table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).cast("double").alias("total"), F.count_if(f != "N").cast("double").alias("part"), F.count_if(f == "R").cast("double").alias("sub")
    )
    return rounded(tables.nested_shares(t, "total", "part", "sub"))


@query(
    "null_rules",
    f"""WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber,
       CASE WHEN q IS NOT NULL AND disc IS NOT NULL THEN greatest(q / 100, disc) END AS hi,
       CASE WHEN q IS NOT NULL AND disc IS NOT NULL THEN least(q / 100, disc) END AS lo,
       round(CASE WHEN disc IS NULL OR q IS NULL THEN NULL WHEN q - 25 <> 0 THEN (disc - 0.05) / (q - 25)
            WHEN disc - 0.05 > 0 THEN CAST('inf' AS DOUBLE) WHEN disc - 0.05 < 0 THEN CAST('-inf' AS DOUBLE) END, 6) + 0.0 AS r
       FROM g""",
)
def null_rules(spark, d):
    g = _gaps(spark, d)
    q100, disc = F.col("q") / 100, F.col("disc")
    r = nulls.ratio(disc - 0.05, F.col("q") - 25)
    return g.select(
        "l_orderkey", "l_linenumber", nulls.strict_greatest(q100, disc).alias("hi"), nulls.strict_least(q100, disc).alias("lo"),
        (nulls.round_scaled(r, 6) + 0.0).alias("r"),
    )


@query(
    "text_functions",
    r"""SELECT p_partkey, CAST(regexp_extract(p_brand, '#(\d+)', 1) AS INTEGER) AS brand_no, regexp_replace(p_name, '[aeiou]', '', 'g') AS squeezed,
       regexp_matches(p_type, '^[A-Z]+') AS upper_type, p_brand || '/' || p_type AS joined, printf('%.2f', p_retailprice) AS price_text FROM part""",
)
def text_functions(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("brand_no"), F.regexp_replace("p_name", "[aeiou]", "").alias("squeezed"),
        F.col("p_type").rlike("^[A-Z]+").alias("upper_type"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), labels.fixed("p_retailprice", 2).alias("price_text"),
    )


@query(
    "list_text",
    "SELECT c_nationkey, string_agg(c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1",
)
def list_text(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_mktsegment")), "; ").alias("segments"))


@query(
    "number_text",
    """SELECT l_orderkey, l_linenumber, CASE WHEN v <> 0 AND abs(v) < 0.01 THEN printf('%.1e', v) ELSE printf('%.2f', v) END AS txt,
       CASE WHEN l_tax < 0.001 THEN '<0.001' ELSE printf('%.3f', l_tax) END AS p_txt
       FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN l_discount / 64 ELSE l_quantity END AS v FROM lineitem)""",
)
def number_text(spark, d):
    l = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") == 1, F.col("l_discount") / 64).otherwise(F.col("l_quantity")))
    return l.select("l_orderkey", "l_linenumber", labels.compact_number("v").alias("txt"), labels.p_text("l_tax").alias("p_txt"))


@query(
    "math_functions",
    """SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln_v, round(sqrt(o_totalprice), 6) AS root, floor(o_totalprice / 1000) AS thousands,
       round(exp(-o_totalprice / 100000), 6) AS decay FROM orders""",
)
def math_functions(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(F.log(v), 6).alias("ln_v"), F.round(F.sqrt(v), 6).alias("root"), F.floor(v / 1000).cast("double").alias("thousands"),
        F.round(F.exp(-v / 100000), 6).alias("decay"),
    )


# ---- aggregates ------------------------------------------------------------------------


@query(
    "grouped_means",
    f"""WITH g AS ({_GAPS}) SELECT l_linenumber, count(*) AS n, round(avg(q), 6) AS mean_q,
       CASE WHEN count(disc) = count(*) THEN round(avg(disc), 6) END AS strict_disc, round(coalesce(sum(disc), 0), 4) AS sum_disc FROM g GROUP BY 1""",
)
def grouped_means(spark, d):
    return _gaps(spark, d).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("mean_q"), F.round(nulls.strict_avg("disc"), 6).alias("strict_disc"),
        F.round(nulls.sum_or_zero("disc"), 4).alias("sum_disc"),
    )


@query(
    "typed_summary",
    """SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, arg_min(p_type, p_partkey) AS p_type, round(avg(p_size), 6) AS p_size,
       round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1""",
)
def typed_summary(spark, d):
    return rounded(tables.typed_summary(table(spark, d, "part"), ["p_brand"], "p_partkey"), 6, p_retailprice=4)


@query(
    "null_safe_sums",
    "SELECT c_nationkey, round(coalesce(sum(CASE WHEN c_acctbal > 9000 THEN c_acctbal END), 0), 2) AS hi, round(coalesce(sum(CASE WHEN c_acctbal < -5000 THEN c_acctbal END), 0), 2) AS lo FROM customer GROUP BY 1",
)
def null_safe_sums(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.round(nulls.sum_or_zero(F.when(b > 9000, b)), 2).alias("hi"), F.round(nulls.sum_or_zero(F.when(b < -5000, b)), 2).alias("lo")
    )


@query("grouped_median", "SELECT p_brand, p_size % 5 AS level, median(p_retailprice) AS med FROM part GROUP BY 1, 2")
def grouped_median(spark, d):
    p = table(spark, d, "part").withColumn("level", F.col("p_size") % 5)
    q = prefix.exact_quantiles(p, ["p_brand", "level"], "p_retailprice", [0.5])
    return q.select("p_brand", "level", F.col("q")[0].alias("med"))


@query(
    "best_level",
    """WITH s AS (SELECT p_brand, p_size % 5 AS level, round(median(p_retailprice), 4) AS med FROM part GROUP BY 1, 2),
       o AS (SELECT p_brand, round(avg(p_retailprice), 4) AS own FROM part GROUP BY 1),
       r AS (SELECT s.p_brand, level, med, row_number() OVER (PARTITION BY s.p_brand ORDER BY round(abs(med - own), 4), level) AS rn FROM s JOIN o USING (p_brand))
       SELECT p_brand, level, med FROM r WHERE rn = 1""",
)
def best_level(spark, d):
    p = table(spark, d, "part").withColumn("level", F.col("p_size") % 5)
    s = prefix.exact_quantiles(p, ["p_brand", "level"], "p_retailprice", [0.5]).select("p_brand", "level", F.round(F.col("q")[0], 4).alias("med"))
    o = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("own"))
    j = s.join(o, "p_brand").withColumn("diff", F.round(F.abs(F.col("med") - F.col("own")), 4))
    return tables.top_rows(j, ["p_brand"], [F.col("diff"), F.col("level")], 1).select("p_brand", "level", "med")


@query(
    "rows_at_maximum",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1",
)
def rows_at_maximum(spark, d):
    return tables.rows_at_max(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], "l_quantity")


@query(
    "distinct_forms",
    """SELECT c_nationkey, c_custkey AS first_key, c_mktsegment, n_seg FROM (
       SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) a
       JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_seg FROM customer GROUP BY 1) b USING (c_nationkey) WHERE rn = 1""",
)
def distinct_forms(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    first = tables.distinct_first(c, ["c_nationkey"], [F.col("c_custkey")]).withColumnRenamed("c_custkey", "first_key")
    return first.join(c.groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("n_seg")), "c_nationkey")


@query("key_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def key_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cross_tab",
    """SELECT s.v AS l_returnflag, t.v AS l_linestatus, count(l.l_orderkey) AS Freq FROM (SELECT unnest(['A', 'N', 'R', 'Z']) AS v) s
       CROSS JOIN (SELECT unnest(['O', 'F']) AS v) t LEFT JOIN lineitem l ON l.l_returnflag = s.v AND l.l_linestatus = t.v GROUP BY 1, 2""",
)
def cross_tab(spark, d):
    return tables.cross_tab(table(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R", "Z"], "l_linestatus", ["O", "F"])


@query(
    "groups_with_both_arms",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.09) AS n_flag, count(*) FILTER (NOT (l_returnflag = 'R' AND l_discount > 0.09)) AS n_rest, sum(l_quantity) AS weight FROM lineitem GROUP BY 1 HAVING n_flag > 0 AND n_rest > 0",
)
def groups_with_both_arms(spark, d):
    return tables.both_arms(table(spark, d, "lineitem"), "l_suppkey", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "l_quantity")


@query(
    "weighted_means",
    f"""WITH g AS ({_GAPS}) SELECT l_linenumber, round(sum(q * l_linenumber * disc) / sum(CASE WHEN q IS NOT NULL THEN disc END), 6) AS wm_scaled,
       round(sum(q * disc) / sum(CASE WHEN q IS NOT NULL THEN disc END), 6) AS wm,
       round(sum(disc) * sum(disc) / sum(disc * disc), 6) AS ess,
       round(sqrt(sum(disc * q * q) - pow(sum(disc * q), 2) / sum(CASE WHEN q IS NOT NULL THEN disc END)) / sum(CASE WHEN q IS NOT NULL THEN disc END), 6) AS wse
       FROM g GROUP BY 1""",
)
def weighted_means(spark, d):
    g = tables.with_mean(_gaps(spark, d), ["l_linenumber"], "q", "centre")
    return rounded(
        g.groupBy("l_linenumber").agg(
            nulls.weighted_avg(F.col("q") * F.col("l_linenumber"), "disc").alias("wm_scaled"), nulls.weighted_avg("q", "disc").alias("wm"),
            nulls.effective_n("disc").alias("ess"), tables.weighted_se("q", "disc", "centre").alias("wse"),
        )
    )


@query(
    "member_counts",
    """SELECT p_partkey, p_brand, n, CASE WHEN n > 20 THEN 'treat' ELSE 'ctrl' END AS type FROM part
       JOIN (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1) USING (p_brand)""",
)
def member_counts(spark, d):
    return tables.distinct_members(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type", "n", 20).drop("p_type")


# ---- windows, quantiles, top-k ----------------------------------------------------------


@query(
    "winsorised",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders)
       SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 4) AS w FROM orders, q""",
)
def winsorised(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("w"))
    return rounded(prefix.winsorise(o, ["w"]), 4)


@query(
    "winsorised_rescaled_by_group",
    """WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer GROUP BY 1),
       w AS (SELECT c_custkey, c.c_nationkey, least(greatest(c_acctbal, a), b) AS w FROM customer c JOIN q ON c.c_nationkey = q.c_nationkey)
       SELECT c_custkey, round(w, 4) AS w, round(CASE WHEN mx = mn THEN 0.5 ELSE (w - mn) / (mx - mn) END, 6) AS r
       FROM w JOIN (SELECT c_nationkey, min(w) AS mn, max(w) AS mx FROM w GROUP BY 1) e USING (c_nationkey)""",
)
def winsorised_rescaled_by_group(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("w"))
    out = prefix.rescale01(prefix.winsorise(c, ["w"], ["c_nationkey"], (0.05, 0.95)), "w", ["c_nationkey"], "r")
    return rounded(out.select("c_custkey", "w", "r"), 6, w=4)


@query(
    "exact_group_quantiles",
    """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1""",
)
def exact_group_quantiles(spark, d):
    q = prefix.exact_quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.01, 0.5, 0.99])
    return rounded(q.select("l_suppkey", *[F.col("q")[i].alias(n) for i, n in enumerate(("q01", "q50", "q99"))]), 4)


@query(
    "running_maximum",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS m FROM lineitem",
)
def running_maximum(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return prefix.scan(l, ["l_orderkey"], "l_linenumber", ["l_extendedprice"], {"m": ("max", F.col("l_quantity"), "upto")}).drop("l_quantity")


@query(
    "trapezoid_area",
    """SELECT l_orderkey, round(sum((l_quantity + pq) / 2), 4) AS area FROM (
       SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS pq FROM lineitem) WHERE pq IS NOT NULL GROUP BY 1""",
)
def trapezoid_area(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(prefix.trapezoid(l, ["l_orderkey"], "l_linenumber", ["l_extendedprice"], "l_quantity", width=F.lit(1.0)), 4)


@query(
    "first_flagged_in_set",
    """SELECT o_orderkey, t.cc FROM orders LEFT JOIN (SELECT l_orderkey, first(l_suppkey ORDER BY l_extendedprice, l_linenumber) AS cc FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t
       ON o_orderkey = t.l_orderkey""",
)
def first_flagged_in_set(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_linenumber", "l_suppkey", "l_returnflag")
    rep = l.where(F.col("l_returnflag") == "R").groupBy("o_orderkey").agg(F.min_by("l_suppkey", F.struct("l_extendedprice", "l_linenumber")).alias("cc"))
    return table(spark, d, "orders").select("o_orderkey").join(rep, "o_orderkey", "left")


@query(
    "global_sort_by_gap",
    "SELECT s_suppkey, round(abs(s_acctbal - 4000), 2) AS gap FROM supplier ORDER BY abs(s_acctbal - 4000), s_suppkey",
)
def global_sort_by_gap(spark, d):
    s = table(spark, d, "supplier")
    gap = F.abs(F.col("s_acctbal") - 4000)
    return s.orderBy(gap, "s_suppkey").select("s_suppkey", F.round(gap, 2).alias("gap"))


@query(
    "two_tier_top_k",
    """SELECT l_suppkey, l_orderkey, l_linenumber, same FROM (
       SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag = 'R' AS same,
              row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag = 'R') DESC, l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 40""",
)
def two_tier_top_k(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("same"), "l_extendedprice")
    order = [F.col("same").desc(), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return tables.top_rows(l, ["l_suppkey"], order, 40).drop("l_extendedprice")


@query(
    "top_k_with_ties",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem) WHERE r <= 3",
)
def top_k_with_ties(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return tables.top_rows(l, ["l_suppkey"], [F.col("l_quantity")], 3, ties=True).drop("l_quantity")


@query(
    "row_at_rank",
    "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 2",
)
def row_at_rank(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return tables.row_at_rank(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 2).drop("c_acctbal")


# ---- sets and shapes --------------------------------------------------------------------


@query(
    "union_with_fill",
    "SELECT c_custkey AS id, 'c' AS kind, c_acctbal AS bal, NULL AS nat FROM customer UNION ALL SELECT s_suppkey, 's', s_acctbal, s_nationkey FROM supplier",
)
def union_with_fill(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))
    return tables.stack_rows([a, b])


@query(
    "id_difference_and_union",
    """SELECT 'only_customers' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
       UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)""",
)
def id_difference_and_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    only = tables.without_ids(c, o, "id").agg(F.lit("only_customers").alias("what"), F.count(F.lit(1)).alias("n"))
    return only.unionByName(tables.distinct_ids([c, o], "id").agg(F.lit("either").alias("what"), F.count(F.lit(1)).alias("n")))


@query(
    "wide_to_long",
    "SELECT p_partkey, 'p_size' AS Variable, CAST(p_size AS DOUBLE) AS Value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
)
def wide_to_long(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return tables.to_long(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "long_to_wide",
    """SELECT o_orderpriority, max(n) FILTER (o_orderstatus = 'F') AS F, max(n) FILTER (o_orderstatus = 'O') AS O, max(n) FILTER (o_orderstatus = 'P') AS P
       FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def long_to_wide(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return tables.to_wide(g, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "n")


@query(
    "transposed_summary",
    """WITH g AS (SELECT l_returnflag, round(avg(l_quantity), 4) AS qty, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1)
       SELECT 'qty' AS Variable, max(qty) FILTER (l_returnflag = 'A') AS A, max(qty) FILTER (l_returnflag = 'N') AS N, max(qty) FILTER (l_returnflag = 'R') AS R FROM g
       UNION ALL SELECT 'tax', max(tax) FILTER (l_returnflag = 'A'), max(tax) FILTER (l_returnflag = 'N'), max(tax) FILTER (l_returnflag = 'R') FROM g""",
)
def transposed_summary(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("qty"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return tables.transpose_small(g, "l_returnflag", ["A", "N", "R"])
