"""Join forms."""

from pyspark.sql import functions as F

from panelweave.operators import tables
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import PAIRS, pairs

_C = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS nat, c_acctbal AS bal FROM customer"
_N = "SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS nat, n_name AS name FROM nation"


def _c(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("nat"), F.col("c_acctbal").alias("bal")
    )


def _n(spark, d):
    return table(spark, d, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("nat"), F.col("n_name").alias("name"))


@query("natural_left_join", f"WITH c AS ({_C}), n AS ({_N}) SELECT id, c.nat, bal, name FROM c LEFT JOIN n ON c.nat IS NOT DISTINCT FROM n.nat")
def natural_left_join(spark, d):
    return tables.natural_left_join(_c(spark, d), _n(spark, d))


@query("keyed_left_join", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def keyed_left_join(spark, d):
    return tables.keyed_left_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation"), {"s_nationkey": "n_nationkey"})


@query(
    "full_join_chain",
    """WITH a AS (SELECT o_custkey AS id, o_orderstatus AS type, round(sum(o_totalprice), 2) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
       b AS (SELECT o_custkey AS id, o_orderstatus AS type, count(*) AS b FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2),
       c AS (SELECT c_custkey AS id, 'F' AS type, c_acctbal AS c FROM customer WHERE c_acctbal > 5000)
       SELECT coalesce(a.id, b.id, c.id) AS id, coalesce(a.type, b.type, c.type) AS type, a, b, c FROM a
       FULL JOIN b ON a.id = b.id AND a.type = b.type FULL JOIN c ON coalesce(a.id, b.id) = c.id AND coalesce(a.type, b.type) = c.type""",
)
def full_join_chain(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("type"), "o_totalprice", "o_orderpriority")
    a = o.where(F.col("type") != "P").groupBy("id", "type").agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    b = o.where(F.col("o_orderpriority").like("1%")).groupBy("id", "type").agg(F.count(F.lit(1)).alias("b"))
    c = table(spark, d, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("id"), F.lit("F").alias("type"), F.col("c_acctbal").alias("c"))
    return tables.full_join_chain([a, b, c], ["id", "type"])


@query(
    "inner_join_suffixed",
    "SELECT nat, a.bal AS bal_x, b.bal AS bal_y FROM (SELECT c_nationkey AS nat, max(c_acctbal) AS bal FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS nat, max(s_acctbal) AS bal FROM supplier GROUP BY 1) b USING (nat)",
)
def inner_join_suffixed(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nat")).agg(F.max("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nat")).agg(F.max("s_acctbal").alias("bal"))
    return tables.inner_join_suffixed(a, b, ["nat"])


@query(
    "right_join_flag",
    "SELECT c_custkey AS id, n AS vi, CASE WHEN n IS NOT NULL THEN c_acctbal > 0 END AS TB FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def right_join_flag(spark, d):
    left = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("vi"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("TB"))
    return tables.right_join_flag(left, right, ["id"], "vi", "TB")


@query(
    "metric_star",
    """SELECT l_suppkey AS id, round(sum(l_quantity), 2) AS qty, round(max(l_discount), 4) AS disc, round(sum(CASE WHEN l_returnflag = 'R' THEN l_tax END), 4) AS tax_r
       FROM lineitem GROUP BY 1""",
)
def metric_star(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "id")
    m = {
        "qty": l.groupBy("id").agg(F.sum("l_quantity").alias("v")),
        "disc": l.groupBy("id").agg(F.max("l_discount").alias("v")),
        "tax_r": l.where(F.col("l_returnflag") == "R").groupBy("id").agg(F.sum("l_tax").alias("v")),
    }
    return rounded(tables.metric_star(m, ["id"], "v"), 4, qty=2)


@query(
    "two_sided_attach",
    f"""WITH {PAIRS}, s AS (SELECT c_nationkey AS CC, round(coalesce(sum(c_acctbal), 0), 2) AS GW, round(coalesce(sum(CASE WHEN c_acctbal < 0 THEN c_acctbal END), 0), 2) AS UR FROM customer GROUP BY 1)
       SELECT code, CC_1, CC_2, a.GW AS GW_B1_1, a.UR AS UR_B1_1, b.GW AS GW_B1_2, b.UR AS UR_B1_2 FROM pairs LEFT JOIN s a ON CC_1 = a.CC LEFT JOIN s b ON CC_2 = b.CC""",
)
def two_sided_attach(spark, d):
    b = F.col("c_acctbal")
    src = table(spark, d, "customer").select(F.col("c_nationkey").alias("CC"), b.alias("GW"), F.when(b < 0, b).alias("UR"))
    return rounded(tables.attach_both_sides(pairs(spark, d), src, {}, "CC", ["GW", "UR"], "_B1"), 2)


@query("anti_join_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.without_ids(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("customers_without_urgent_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P')")
def customers_without_urgent_orders(spark, d):
    """An anti join that leaves rows and drops some."""
    o = table(spark, d, "orders").where(F.col("o_orderpriority").like("1%") & (F.col("o_orderstatus") == "P"))
    return tables.without_ids(table(spark, d, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("semi_join_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_ids(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return tables.with_ids(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query(
    "group_representative",
    """SELECT l_orderkey, l_linenumber, l_suppkey, t.rep, l_suppkey = t.rep AS same FROM lineitem LEFT JOIN
       (SELECT l_orderkey AS k, first(l_suppkey ORDER BY l_extendedprice, l_linenumber) AS rep FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) t ON l_orderkey = t.k""",
)
def group_representative(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_extendedprice")
    out = tables.group_representative(l, "l_orderkey", F.col("l_returnflag") == "A", "l_suppkey", F.struct("l_extendedprice", "l_linenumber"), "rep")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "rep", (F.col("l_suppkey") == F.col("rep")).alias("same"))
