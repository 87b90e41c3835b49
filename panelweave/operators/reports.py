"""Aggregates behind tables and figures; every result is rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.labels import compact_number, quartile_text
from panelweave.functions.nulls import is_finite
from panelweave.operators.prefix import attach_group, attach_units, exact_quantiles, running_total
from panelweave.operators.tables import to_long, weighted_quantiles


def quartile_rows(df: DataFrame, keys: list[str], cols: list[str], w: str | None = None) -> DataFrame:
    """Median and quartiles per variable, plain or weighted, with the display text."""
    long = to_long(df.select(*keys, *([w] if w else []), *[F.col(c).cast("double").alias(c) for c in cols]), [*keys, *([w] if w else [])], cols)
    ks = [*keys, "Variable"]
    q = weighted_quantiles(long, ks, "Value", w, [0.25, 0.5, 0.75]) if w else exact_quantiles(long, ks, "Value", [0.25, 0.5, 0.75])
    return q.select(*ks, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))]).withColumn(
        "text", quartile_text(F.col("median"), F.col("q25"), F.col("q75"))
    )


def mixed_summary(df: DataFrame, positive: list[str], plain: list[str], categories: list[str], distinct: list[str]) -> DataFrame:
    """One table of blocks: zero counts and quartiles of positives x100, missing counts and
    quartiles, category counts, distinct counts, total rows."""
    nul = F.lit(None).cast("double")
    pos = to_long(df.select(*[(F.col(c).cast("double") * 100).alias(c) for c in positive]), [], positive)
    pq = exact_quantiles(pos.where(F.col("Value") > 0), ["Variable"], "Value", [0.25, 0.5, 0.75])
    pz = pos.groupBy("Variable").agg(F.count_if(F.col("Value") == 0).cast("double").alias("Zeros"))
    a = pz.join(pq, "Variable", "left").select("Variable", "Zeros", nul.alias("NAs"), F.col("q")[0].alias("Q25"), F.col("q")[1].alias("Median"), F.col("q")[2].alias("Q75"), nul.alias("Count"))
    pl = to_long(df.select(*[F.col(c).cast("double").alias(c) for c in plain]), [], plain)
    qq = exact_quantiles(pl, ["Variable"], "Value", [0.25, 0.5, 0.75])
    na = pl.groupBy("Variable").agg(F.count_if(F.col("Value").isNull()).cast("double").alias("NAs"))
    b = na.join(qq, "Variable", "left").select("Variable", nul.alias("Zeros"), "NAs", F.col("q")[0].alias("Q25"), F.col("q")[1].alias("Median"), F.col("q")[2].alias("Q75"), nul.alias("Count"))
    count_row = lambda d, name, n: d.select(name.alias("Variable"), *[nul.alias(c) for c in ("Zeros", "NAs", "Q25", "Median", "Q75")], n.cast("double").alias("Count"))
    cats = [
        count_row(df.groupBy(c).count(), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))), F.col("count"))
        for c in categories
    ]
    tots = df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(c) for c in distinct])
    names = [F.struct(F.lit(f"{c} (unique categories)").alias("v"), F.col(c).alias("n")) for c in distinct]
    names.append(F.struct(F.lit("Total rows").alias("v"), F.col("rows").alias("n")))
    tail = count_row(tots.select(F.inline(F.array(*names))), F.col("v"), F.col("n"))
    return reduce(lambda x, y: x.unionByName(y), [a, b, *cats, tail])


def formatted(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    return df.select(*[F.coalesce(compact_number(c, digits), F.lit("")).alias(c) if c in cols else F.col(c) for c in df.columns])


def effect_counts(df: DataFrame, keys: list[str], effect: str, p: str, alpha: float = 0.1) -> DataFrame:
    """Totals by sign and significance."""
    sig, pos, neg = F.col(p) < alpha, F.col(effect) > 0, F.col(effect) < 0
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(sig).alias("n_signif"),
        F.count_if(pos).alias("n_pos"),
        F.count_if(neg).alias("n_neg"),
        F.count_if(sig & pos).alias("n_pos_signif"),
        F.count_if(sig & neg).alias("n_neg_signif"),
    )


def response_shares(df: DataFrame, flag: str, beta: str, p: str, w: str, alpha: float = 0.1, p_color: str | None = None) -> DataFrame:
    """Plain and weighted share of each response class within the arm."""
    b, q = F.col(beta), F.col(p)
    res = F.when((q > alpha) & (b < 0), "neg_ns").when(q > alpha, "pos_ns").when(b < 0, "neg").when(b > 0, "pos")
    sign = F.when(b > 0, 1.0).when(b < 0, -1.0).otherwise(0.0)
    pc = F.col(p_color or p)
    shade = F.when(pc.isNotNull(), sign * (1 - F.least(pc / 0.3, F.lit(1.0))))
    g = (
        df.withColumn("Res", res)
        .where(F.col("Res").isNotNull())
        .groupBy(flag, "Res")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("w_sum"), F.avg(shade).alias("mean_color"))
    )
    arm = W.partitionBy(flag)  # a handful of classes per arm
    return g.select(
        flag, "Res", "n", "w_sum", "mean_color",
        (F.col("n") / F.sum("n").over(arm)).alias("prop_unweighted"),
        F.try_divide(F.col("w_sum"), F.sum("w_sum").over(arm)).alias("prop_weighted"),
        F.sum("n").over(arm).alias("total_n"),
    )


def sign_shares(df: DataFrame, keys: list[str], effect: str, p: str, alpha: float = 0.1) -> DataFrame:
    """Shares positive, not significant, negative, adding up to one; all missing gives (0, 1, 0)."""
    okp, oke = is_finite(p), is_finite(effect)
    sig = okp & oke & F.coalesce(F.col(p) < alpha, F.lit(False))
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    d = df.groupBy(*keys).agg(
        share(sig & (F.col(effect) > 0)).alias("a"),
        (share(okp & (F.col(p) >= alpha)) + share(sig & (F.col(effect) == 0))).alias("b"),
        share(sig & (F.col(effect) < 0)).alias("c"),
    )
    tot = F.col("a") + F.col("b") + F.col("c")
    return d.select(
        *keys,
        F.when(tot > 0, F.col("a") / tot).otherwise(0.0).alias("share_pos"),
        F.when(tot > 0, F.col("b") / tot).otherwise(1.0).alias("share_ns"),
        F.when(tot > 0, F.col("c") / tot).otherwise(0.0).alias("share_neg"),
    )


def sweep_summary(df: DataFrame, keys: list[str], value: str, p: str, alpha: float = 0.1) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg((F.col(p) < alpha).cast("double")).alias("share_significant"),
    )


def binned_means(df: DataFrame, flag: str, x: str, y: str, w: str, width: float, x_max: float, normalise_se: bool = False) -> DataFrame:
    """Weighted mean of y per bin of x and arm, with the 1.645 band.

    The standard error is sqrt(sum w (y-m)^2)/sqrt(n) as published; `normalise_se` divides
    the sum by the weight total as well.
    """
    bin_ = F.floor(F.col(x) / width) * F.lit(float(width))
    d = df.where((F.col(x) < x_max) & F.col(w).isNotNull()).select(flag, bin_.alias("bin"), F.col(y).alias("__y"), F.col(w).alias("__w"))
    m = d.groupBy(flag, "bin").agg(
        F.count("__y").alias("n"), F.sum("__w").alias("w_sum"),
        F.try_divide(F.sum(F.col("__w") * F.col("__y")), F.sum(F.when(F.col("__y").isNotNull(), F.col("__w")))).alias("mean"),
    )
    ss = attach_units(d, m, [flag, "bin"]).groupBy(flag, "bin").agg(F.sum(F.col("__w") * F.pow(F.col("__y") - F.col("mean"), 2)).alias("ss"))
    out = attach_group(m, ss, [flag, "bin"])
    core = F.col("ss") / F.col("w_sum") if normalise_se else F.col("ss")
    out = out.withColumn("se", F.when(F.col("n") > 0, F.sqrt(core) / F.sqrt("n")))
    arm = W.partitionBy(flag)  # one row per bin from here on
    lo, hi = F.min("w_sum").over(arm), F.max("w_sum").over(arm)
    return out.select(
        flag, "bin", "n", "w_sum", "mean", "se",
        (F.col("mean") - 1.645 * F.col("se")).alias("ci_low"),
        (F.col("mean") + 1.645 * F.col("se")).alias("ci_high"),
        F.try_divide(F.col("w_sum") - lo, hi - lo).alias("w_rel"),
    )


def concentration_of_rows(df: DataFrame, order: str, value: str, id_col: str) -> DataFrame:
    """Rows by descending value with their share and cumulative share of the total."""
    tot = df.agg(F.sum(value).alias("__tot"))
    d = running_total(df, [], order, [id_col], F.col(value), "__cum", descending=True)
    d = attach_group(d, tot, [])
    return d.withColumn("share", F.col(value) / F.col("__tot")).withColumn("cum_share", F.col("__cum") / F.col("__tot")).drop("__cum", "__tot")


def top_shares(df: DataFrame, value: str, id_col: str, tops=(1, 3, 5)) -> DataFrame:
    """Share of the total held by the largest 1, 3 and 5 rows."""
    tot = df.agg(F.sum(value).alias("__tot"))
    n = max(tops)
    head = df.orderBy(F.col(value).desc(), F.col(id_col)).limit(n).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(id_col).alias("i"))), asc=False).alias("h")
    )
    j = attach_group(head, tot, [])
    rows = F.array(*[
        F.struct(F.lit(k).alias("top"), (F.aggregate(F.slice("h", 1, k), F.lit(0.0), lambda a, s: a + s["v"]) / F.col("__tot")).alias("share"))
        for k in tops
    ])
    return j.select(F.inline(rows))


def overlap_totals(units: DataFrame, both: DataFrame, key: str, w: str) -> DataFrame:
    """Units and wells inside the overlap set against all: counts and percent."""
    flagged = units.join(both.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    inside = F.col("__in").isNotNull()
    return flagged.agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum(w).alias("n_rows"),
        F.count_if(inside).alias("n_units_in"),
        F.coalesce(F.sum(F.when(inside, F.col(w))), F.lit(0)).alias("n_rows_in"),
        (F.avg(inside.cast("double")) * 100).alias("pct_units_in"),
        (F.try_divide(F.sum(F.when(inside, F.col(w)).otherwise(0)).cast("double"), F.sum(w)) * 100).alias("pct_rows_in"),
    )


def stack_terms(df: DataFrame, keys: list[str], models: dict[str, str], terms: dict[str, str], z: float = 1.64) -> DataFrame:
    """Wide b_/se_/nm_ columns per model to long term rows with a z band; terms filtered and recoded."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("model"), F.col(f"nm_{i}").alias("term"), F.col(f"b_{i}").alias("est"), F.col(f"se_{i}").alias("se"))
        for i, label in models.items()
    ])
    d = df.select(*keys, F.inline(rows)).where(F.col("term").isin(list(terms)))
    name = reduce(lambda acc, kv: acc.when(F.col("term") == kv[0], kv[1]), terms.items(), F)
    return d.select(
        *keys, "model", name.alias("term"), "est", "se", (F.col("est") - z * F.col("se")).alias("ci_low"), (F.col("est") + z * F.col("se")).alias("ci_high")
    )


def regression_table(terms: DataFrame, label: str, labels: list[str], term_names: dict[str, str]) -> DataFrame:
    """Table body: a coefficient and a p row per term, then tau2, observations, clusters.

    `terms` has (label, term, estimate, se, p, stars, tau2, n, k_cluster); columns a model
    lacks are taken as missing.
    """
    need = {"estimate": "double", "se": "double", "p": "double", "tau2": "double", "stars": "string", "n": "bigint", "k_cluster": "bigint"}
    d = terms
    for c, t in need.items():
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(t))
    num = lambda c: F.when(F.col(c).isNull(), "").when(F.abs(F.col(c)) < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.col(c)))
    body = d.where(F.col("term").isin(list(term_names)))
    name = reduce(lambda acc, kv: acc.when(F.col("term") == kv[0], kv[1]), term_names.items(), F)
    order = reduce(lambda acc, kv: acc.when(F.col("term") == kv[1], kv[0]), enumerate(term_names), F)
    cells = F.array(
        F.struct((order * 2).alias("row"), name.alias("term_out"), F.concat(num("estimate"), F.lit(" ("), num("se"), F.lit(")")).alias("entry")),
        F.struct((order * 2 + 1).alias("row"), F.lit("").alias("term_out"), F.concat(F.lit("["), num("p"), F.lit("]"), F.coalesce("stars", F.lit(""))).alias("entry")),
    )
    main = body.select(F.col(label).alias("__label"), F.inline(cells))
    base = 2 * len(term_names)
    one = d.select(label, "tau2", "n", "k_cluster").distinct()
    stats = F.array(
        F.struct(F.lit(base).alias("row"), F.lit("Tau^2").alias("term_out"), F.when(F.col("tau2").isNull(), "").otherwise(F.format_string("%.1f", "tau2")).alias("entry")),
        F.struct(F.lit(base + 1).alias("row"), F.lit("Observations").alias("term_out"), F.col("n").cast("string").alias("entry")),
        F.struct(F.lit(base + 2).alias("row"), F.lit("Clusters").alias("term_out"), F.col("k_cluster").cast("string").alias("entry")),
    )
    allrows = main.unionByName(one.select(F.col(label).alias("__label"), F.inline(stats)))
    return allrows.groupBy("row", "term_out").pivot("__label", labels).agg(F.first("entry", ignorenulls=True)).orderBy("row")
