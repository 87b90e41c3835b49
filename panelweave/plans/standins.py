"""The driver's tables seen as the panel's inputs, as DataFrames and as SQL text.

wells: one per order line; unit = (brand, supplier nation); y price, x quantity; TB from both.
points: customers, with coordinates derived from the key. frames: one rectangle per nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.plans.registry import table


def wells(spark: SparkSession, d: str) -> DataFrame:
    l, p, s = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    return (
        l.join(p.select("p_partkey", "p_brand", "p_size"), l.l_partkey == F.col("p_partkey"))
        .join(s.select("s_suppkey", "s_nationkey", "s_acctbal"), l.l_suppkey == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("well_id"),
            F.col("p_brand").alias("aquifer"),
            F.col("s_nationkey").alias("cc"),
            ((F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") + F.col("s_nationkey")) % 3 == 0).alias("TB"),
            F.col("l_extendedprice").alias("y"),
            F.col("l_quantity").alias("x"),
            F.col("l_discount").alias("disc"),
            F.col("l_tax").alias("tax"),
            F.col("p_size").cast("double").alias("size"),
            F.col("s_acctbal").alias("acct"),
            (F.col("l_discount") > 0.05).cast("int").alias("LB_river"),
            ((F.col("l_orderkey") * 7919) % 3600).cast("double").alias("px"),
            ((F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 31) % 1700).cast("double").alias("py"),
        )
    )


WELLS = r"""wells AS (
  SELECT l_orderkey * 8 + l_linenumber AS well_id, p_brand AS aquifer, s_nationkey AS cc, (CAST(regexp_extract(p_brand, '\d+') AS INTEGER) + s_nationkey) % 3 = 0 AS TB,
         l_extendedprice AS y, l_quantity AS x, l_discount AS disc, l_tax AS tax, CAST(p_size AS DOUBLE) AS size,
         s_acctbal AS acct, CAST(l_discount > 0.05 AS INTEGER) AS LB_river,
         CAST((l_orderkey * 7919) % 3600 AS DOUBLE) AS px,
         CAST((l_orderkey * 104729 + l_linenumber * 31) % 1700 AS DOUBLE) AS py
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"),
        ((k * 7919 % 36000) / 100.0 - 180.0).alias("lon"),
        ((k * 104729 % 17000) / 100.0 - 85.0).alias("lat"),
        F.col("c_acctbal").alias("value"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )


POINTS = """points AS (
  SELECT c_custkey AS id, CAST(c_custkey * 7919 % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon,
         CAST(c_custkey * 104729 % 17000 AS DOUBLE) / 100.0 - 85.0 AS lat, c_acctbal AS value,
         c_nationkey AS nation, c_mktsegment AS segment FROM customer)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles around one point per supplier: geom_id, x0, y0, x1, y1, nation."""
    k = F.col("s_suppkey")
    x, y = k * 611 % 340 - 170, k * 397 % 150 - 75
    w, h = 6 + k % 17, 5 + k % 11
    return table(spark, d, "supplier").select(
        k.alias("geom_id"), F.col("s_nationkey").alias("nation"),
        (x - w).cast("double").alias("x0"), (y - h).cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"),
    )


BOXES = """boxes AS (
  SELECT s_suppkey AS geom_id, s_nationkey AS nation,
         CAST(s_suppkey * 611 % 340 - 170 - (6 + s_suppkey % 17) AS DOUBLE) AS x0,
         CAST(s_suppkey * 397 % 150 - 75 - (5 + s_suppkey % 11) AS DOUBLE) AS y0,
         CAST(s_suppkey * 611 % 340 - 170 + (6 + s_suppkey % 17) AS DOUBLE) AS x1,
         CAST(s_suppkey * 397 % 150 - 75 + (5 + s_suppkey % 11) AS DOUBLE) AS y1 FROM supplier)"""


def box_edges(b: DataFrame, diamond: bool = False) -> DataFrame:
    """Closed outline of each box (or of the diamond through its side middles)."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    c = (
        [(mx, F.col("y0")), (F.col("x1"), my), (mx, F.col("y1")), (F.col("x0"), my)]
        if diamond
        else [(F.col(a), F.col(b_)) for a, b_ in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    )
    segs = F.array(
        *[
            F.struct(
                F.lit(0).alias("part"), F.lit(i).alias("seq"),
                c[i][0].alias("x1"), c[i][1].alias("y1"), c[(i + 1) % 4][0].alias("x2"), c[(i + 1) % 4][1].alias("y2"),
            )
            for i in range(4)
        ]
    )
    return b.select("geom_id", F.inline(segs))


BOX_EDGES = """box_edges AS (
  SELECT geom_id, 0 AS seq, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM boxes UNION ALL
  SELECT geom_id, 1, x1, y0, x1, y1 FROM boxes UNION ALL
  SELECT geom_id, 2, x1, y1, x0, y1 FROM boxes UNION ALL
  SELECT geom_id, 3, x0, y1, x0, y0 FROM boxes)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """Unit descriptors: one row per (aquifer, cc)."""
    return wells(spark, d).groupBy("aquifer", "cc").agg(
        F.max("TB").alias("TB"), F.count(F.lit(1)).alias("nW"), F.avg("py").alias("lat_c"), F.avg("px").alias("lon_c"),
        F.avg("size").alias("urbkHaKm2"), F.avg("tax").alias("CS_max"), F.sum("y").alias("area_km2"),
    )


UNITS = """units AS (
  SELECT aquifer, cc, bool_or(TB) AS TB, count(*) AS nW, avg(py) AS lat_c, avg(px) AS lon_c, avg(size) AS urbkHaKm2,
         avg(tax) AS CS_max, sum(y) AS area_km2 FROM wells GROUP BY aquifer, cc)"""

TRENDS = """m AS (
  SELECT aquifer, cc, count(*) AS n, avg(x) AS xb, avg(y) AS yb, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
  FROM wells GROUP BY aquifer, cc),
r AS (
  SELECT w.aquifer, w.cc, m.n, m.yb, m.sxx, CASE WHEN m.sxx > 0 THEN m.sxy / m.sxx END AS b1, w.x - m.xb AS dx, w.y - m.yb AS e0,
         1.0 / m.n AS h0, 1.0 / m.n + (w.x - m.xb) * (w.x - m.xb) / nullif(m.sxx, 0) AS h1
  FROM wells w JOIN m ON w.aquifer = m.aquifer AND w.cc = m.cc),
trends AS (
  SELECT aquifer, cc, any_value(n) AS n, any_value(yb) AS beta_0,
         CASE WHEN any_value(n) > 1 THEN sqrt(sum((e0 / (1 - h0)) * (e0 / (1 - h0)))) / any_value(n) END AS se_0,
         any_value(b1) AS beta_1,
         CASE WHEN max(h1) < 1 - 1e-12 THEN sqrt(sum(pow(dx * (e0 - b1 * dx) / (1 - h1), 2))) / any_value(sxx) END AS se_1
  FROM r GROUP BY aquifer, cc)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nation pairs of one region: code, CC_1 < CC_2 (nations stand for countries, regions for aquifers)."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_regionkey").alias("code"), F.col("n_nationkey").alias("CC_1"))
    b = n.select(F.col("n_regionkey").alias("code"), F.col("n_nationkey").alias("CC_2"))
    return a.join(b, "code").where(F.col("CC_1") < F.col("CC_2"))


PAIRS = """pairs AS (
  SELECT a.n_regionkey AS code, a.n_nationkey AS CC_1, b.n_nationkey AS CC_2
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"""
