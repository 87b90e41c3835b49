"""Readers, writers and stores on the driver's tables."""

from pyspark.sql import functions as F

from panelweave.plans.registry import query, rounded, scratch, table
from panelweave.sources import files, store


@query(
    "column_listing",
    """SELECT ordinal_position::INTEGER AS position, column_name AS variable, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(split_part(data_type, '(', 1)) END AS type
       FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
def column_listing(spark, d):
    return files.column_listing(table(spark, d, "lineitem"))


@query(
    "csv_round_trip",
    "SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS acct, s_acctbal > 0 AS positive FROM supplier",
)
def csv_round_trip(spark, d):
    df = table(spark, d, "supplier").select(
        "s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("acct"),
        F.upper((F.col("s_acctbal") > 0).cast("string")).alias("positive"),
    )
    path = scratch(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, "s_suppkey bigint, s_nationkey int, acct double, positive boolean")


@query("keyed_csv_scan", "SELECT p_partkey, p_retailprice, CAST(p_size % 4 AS INTEGER) AS level FROM part")
def keyed_csv_scan(spark, d):
    path = scratch(spark, "levels")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") % 4).alias("lev"))
    for lv in range(4):  # four folders lev0..lev3, one write each
        files.write_csv(p.where(F.col("lev") == lv).drop("lev"), f"{path}/basins_lev{lv}")
    return files.read_keyed_csv(spark, f"{path}/basins_lev*", "p_partkey bigint, p_retailprice double", r"basins_lev(\d+)", "level")


@query(
    "column_stitch",
    "SELECT c_custkey, c_nationkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
def column_stitch(spark, d):
    c = table(spark, d, "customer")
    parts = [c.select("c_custkey", "c_nationkey", col, F.lit("x").alias(".geo")) for col in ("c_name", "c_acctbal", "c_mktsegment")]
    return files.stitch(parts, drop=["`.geo`", ".geo"])


@query(
    "pruned_level_scan",
    "SELECT p_partkey, p_retailprice, CAST(p_size % 8 AS INTEGER) AS level, p_brand AS part FROM part WHERE p_size % 8 IN (2, 5) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')",
)
def pruned_level_scan(spark, d):
    path = scratch(spark, "layer")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") % 8).cast("int").alias("level"), F.col("p_brand").alias("part"))
    p.repartition("level").write.partitionBy("level", "part").parquet(path)
    return files.read_levels(spark, path, [2, 5], ["Brand#11", "Brand#12", "Brand#13"])


@query(
    "curve_column_scan",
    """WITH q AS (SELECT o_custkey % 50 AS unit_id, max(o_orderstatus) AS country, max(o_totalprice) AS p100, min(o_totalprice) AS p0,
                count(*) + 0.0 AS p50 FROM orders GROUP BY 1)
       SELECT unit_id, country, CAST(p AS DOUBLE) AS p, round(CAST(v AS DOUBLE), 4) AS v FROM (
         SELECT unit_id, country, 0 AS p, p0 AS v FROM q UNION ALL SELECT unit_id, country, 50, p50 FROM q
         UNION ALL SELECT unit_id, country, 100, p100 FROM q)""",
)
def curve_column_scan(spark, d):
    w = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("id")).agg(
        F.max("o_orderstatus").alias("CntryNm"), F.max("o_totalprice").alias("p100"), F.min("o_totalprice").alias("p0"), F.count(F.lit(1)).alias("p50")
    )
    return rounded(files.curve_columns(w, "id", "CntryNm").select("unit_id", "country", F.inline("curve")), 4)


@query(
    "edge_layer_scan",
    """SELECT s_suppkey AS geom_id, count(*) AS n_edges, sum(abs(x2 - x1) + abs(y2 - y1)) AS perimeter FROM (
         SELECT s_suppkey, u.i, CAST(s_suppkey % 90 AS DOUBLE) + CASE WHEN u.i IN (1, 2) THEN 2 ELSE 0 END AS x1,
                CAST(s_suppkey % 45 AS DOUBLE) + CASE WHEN u.i IN (2, 3) THEN 3 ELSE 0 END AS y1,
                CAST(s_suppkey % 90 AS DOUBLE) + CASE WHEN u.i IN (0, 1) THEN 2 ELSE 0 END AS x2,
                CAST(s_suppkey % 45 AS DOUBLE) + CASE WHEN u.i IN (1, 2) THEN 3 ELSE 0 END AS y2
         FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS i) u) GROUP BY 1""",
)
def edge_layer_scan(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("geom_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("seq"))
    x, y, i = (F.col("geom_id") % 90).cast("double"), (F.col("geom_id") % 45).cast("double"), F.col("seq")
    e = s.select(
        "geom_id", F.lit(0).alias("part"), "seq",
        (x + F.when(i.isin(1, 2), 2).otherwise(0)).alias("x1"), (y + F.when(i.isin(2, 3), 3).otherwise(0)).alias("y1"),
        (x + F.when(i.isin(0, 1), 2).otherwise(0)).alias("x2"), (y + F.when(i.isin(1, 2), 3).otherwise(0)).alias("y2"),
    )
    path = scratch(spark, "edges")
    e.write.parquet(path)
    return files.read_edges(spark, path).groupBy("geom_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("perimeter")
    )


@query(
    "resumed_batch",
    "SELECT CAST(s_nationkey AS INTEGER) AS sample_id, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1",
)
def resumed_batch(spark, d):
    """First run stores part of the samples, the second only what is missing."""
    s = table(spark, d, "supplier").withColumn("sample_id", F.col("s_nationkey").cast("int"))
    wanted = s.select("sample_id").distinct()
    path = scratch(spark, "samples")

    def make(todo):
        return s.join(todo, "sample_id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))

    store.run_missing(spark, path, wanted.where(F.col("sample_id") < 10), "sample_id", make)
    return store.run_missing(spark, path, wanted, "sample_id", make)


@query(
    "labelled_results",
    "SELECT CAST(o_orderstatus AS VARCHAR) AS label, o_orderpriority AS term, count(*) AS n, round(avg(o_totalprice), 4) AS est FROM orders GROUP BY 1, 2",
)
def labelled_results(spark, d):
    o = table(spark, d, "orders")
    path = scratch(spark, "results")
    o.groupBy(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("est")
    ).repartition("label").write.partitionBy("label").parquet(path)
    again = o.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_orderpriority").alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("est")
    )
    store.save_result(again, path, "F")
    return store.load_results(spark, path)


@query(
    "review_decisions",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 1 THEN 'N' || CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS country
       FROM customer WHERE c_custkey % 7 <> 0""",
)
def review_decisions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("country"))
    path = scratch(spark, "review")
    flagged = c.where(F.col("c_custkey") % 7 < 2).select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("new_country"),
        F.when(F.col("c_custkey") % 7 == 0, "drop").otherwise("rename").alias("comment"),
    )
    flagged.write.parquet(path)
    return store.apply_decisions(c, spark.read.parquet(path), ["c_custkey"]).select("c_custkey", "country")
