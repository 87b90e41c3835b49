"""Random maximal independent sets, many at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.prefix import scan
from panelweave.session import cut_lineage


def random_independent_sets(ids: DataFrame, edges: DataFrame, key: str, samples: DataFrame, seed: int = 1, order=None) -> DataFrame:
    """(sample_id, key): per sample the set a sequential greedy pass in random order keeps.

    The random order is the hash of (seed, sample, key), or `order(sample column, key column)`. Per round every live node whose
    rank is below all its live neighbours is kept and its neighbours leave; this gives the
    greedy set itself, in a number of rounds that grows with log(nodes), and at least the
    smallest live node settles in each. `edges` holds a, b. The state is the live nodes and the
    live links (lo, hi) by rank, which shrink round by round.
    """
    nodes = ids.select(F.col(key).alias("a")).distinct()
    numbers = sorted(r.sample_id for r in samples.select("sample_id").distinct().collect())  # the declared list, not data
    if not numbers:
        return nodes.select(F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"), F.col("a").alias(key)).where("false")
    each = F.array(*[F.lit(n) for n in numbers]).cast(f"array<{samples.schema['sample_id'].dataType.simpleString()}>")
    live = cut_lineage(nodes.select(F.explode(each).alias("sample_id"), "a"))
    place = order or (lambda sample, k: F.xxhash64(F.lit(seed), sample, k))
    rank = lambda c: F.struct(place(F.col("sample_id"), F.col(c)).alias("h"), F.col(c).alias("k"))
    pair = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    links = live.withColumnRenamed("a", "x").join(pair, "x").join(live.select("sample_id", F.col("a").alias("y")), ["sample_id", "y"], "left_semi")
    first = rank("x") < rank("y")
    links = links.select("sample_id", F.when(first, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("hi"))
    links = cut_lineage(links)
    kept: list[DataFrame] = []
    while True:
        win = cut_lineage(live.join(links.select("sample_id", F.col("hi").alias("a")).distinct(), ["sample_id", "a"], "left_anti"))
        kept.append(win)
        if links.isEmpty():
            break
        lost = links.join(win.withColumnRenamed("a", "lo"), ["sample_id", "lo"], "left_semi").select("sample_id", F.col("hi").alias("a")).distinct()
        gone = cut_lineage(lost.unionByName(win))
        live = cut_lineage(live.join(gone, ["sample_id", "a"], "left_anti"))
        for end in ("lo", "hi"):
            links = links.join(gone.withColumnRenamed("a", end), ["sample_id", end], "left_anti")
        links = cut_lineage(links)
    return reduce(lambda x, y: x.unionByName(y), kept).withColumnRenamed("a", key)


def independent_sets_of_cells(ids: DataFrame, cells: DataFrame, key: str, samples: DataFrame, seed: int = 1, order=None) -> DataFrame:
    """`random_independent_sets` of areas that conflict where they share a cell (key, cx, cy), without their pairs.

    Per round and sample a cell belongs to the first live area that covers it. An area that owns all
    its cells comes before all it overlaps and is kept; areas on a cell of a kept one leave. Each
    area meets its cells, not its neighbours, so the rows grow with the areas however they crowd.
    """
    place = order or (lambda sample, k: F.xxhash64(F.lit(seed), sample, k))
    xy = ["cx", "cy"]
    nodes = ids.select(F.col(key).alias("a")).where("a IS NOT NULL").distinct()
    at = cut_lineage(cells.select(F.col(key).alias("a"), *xy).distinct().join(nodes.hint("merge"), "a", "left_semi"))
    n = at.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    ranked = nodes.join(n.hint("merge"), "a", "left").crossJoin(F.broadcast(samples.select("sample_id").distinct()))
    ranked = cut_lineage(ranked.withColumn("h", place(F.col("sample_id"), F.col("a"))))
    live = cut_lineage(scan(ranked, ["sample_id"], "h", ["a"], {"rank": ("sum", F.lit(1), "upto")}).drop("h"))
    kept = [live.where("n IS NULL").select("sample_id", "a")]
    live = live.where("n IS NOT NULL")
    while True:
        owners = at.join(live.hint("merge"), "a").groupBy("sample_id", *xy).agg(F.min("rank").alias("rank"))
        owners = cut_lineage(owners)
        whole = owners.groupBy("sample_id", "rank").agg(F.count(F.lit(1)).alias("n"))
        win = cut_lineage(live.join(whole.hint("merge"), ["sample_id", "rank", "n"]).select("sample_id", "a", "rank"))
        kept.append(win.select("sample_id", "a"))
        taken = owners.join(win.select("sample_id", "rank").hint("merge"), ["sample_id", "rank"], "left_semi").groupBy(*xy).agg(F.collect_set("sample_id").alias("s"))
        gone = at.join(cut_lineage(taken).hint("merge"), xy).select("a", F.explode("s").alias("sample_id")).distinct()
        live = cut_lineage(live.join(gone.hint("merge"), ["sample_id", "a"], "left_anti"))
        if live.isEmpty():
            break
        at = cut_lineage(at.join(live.select("a").distinct().hint("merge"), "a", "left_semi"))
    return reduce(lambda x, y: x.unionByName(y), kept).withColumnRenamed("a", key)
