"""Table verbs: column rules, joins, aggregates, top-k and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.nulls import as_col, not_in_keep_null, sum_or_zero
from panelweave.operators.prefix import attach_group, attach_units, null_safe_join

# ---- columns and filters ---------------------------------------------------------------


def rename_map(df: DataFrame, mapping: dict[str, str], keep_rest: bool = False) -> DataFrame:
    """Select and rename by {old: new}; with `keep_rest` the other columns follow unchanged."""
    picked = [F.col(o).alias(n) for o, n in mapping.items()]
    rest = [F.col(c) for c in df.columns if c not in mapping] if keep_rest else []
    return df.select(*picked, *rest)


def suffix_columns(df: DataFrame, cols: list[str], src: str, side: int | str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{src}_{side}") if c in cols else F.col(c) for c in df.columns])


def pick_columns(df: DataFrame, prefix: str | None = None, names: list[str] | None = None, numeric: bool = False) -> list[str]:
    """Column names chosen from the schema by prefix, by list (absent names ignored) or by type."""
    out = []
    for f in df.schema.fields:
        hit = (
            (prefix is not None and f.name.startswith(prefix))
            or (names is not None and f.name in names)
            or (numeric and isinstance(f.dataType, T.NumericType))
        )
        if hit:
            out.append(f.name)
    return out


def valid_units(df: DataFrame, n_min: int, flag: str = "TB") -> DataFrame:
    """Units with enough rows, both coefficients, positive standard errors and a known flag."""
    return df.where(
        (F.col("n") > n_min)
        & F.col("beta_0").isNotNull()
        & F.col("beta_1").isNotNull()
        & (F.col("se_0") > 0)
        & (F.col("se_1") > 0)
        & F.col(flag).isNotNull()
    )


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=[c for c in cols if c in df.columns])


def drop_listed(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(not_in_keep_null(col, values))


def drop_flagged_groups(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Remove every row of a group in which any row is flagged."""
    bad = df.where(flag).select(*keys).distinct()
    return null_safe_join(df, bad.withColumn("__bad", F.lit(True)), keys, "left").where(F.col("__bad").isNull()).drop("__bad")


def not_listed_in(df: DataFrame, listed: str, name: str) -> DataFrame:
    """Rows whose `name` does not occur inside the text of `listed`."""
    return df.where(~F.contains(F.col(listed), F.col(name)))


def override_values(df: DataFrame, target: str, key: str, table: DataFrame, value: str) -> DataFrame:
    """Replace `target` where `key` is in the decision table; of repeated keys the largest value counts."""
    t = table.groupBy(key).agg(F.max(value).alias("__ov"))
    return df.join(t, key, "left").withColumn(target, F.coalesce(F.col("__ov"), F.col(target))).drop("__ov")


def check(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """Fail the job at the first row breaking `rule` (NULL counts as broken)."""
    ok = F.coalesce(rule, F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def nested_shares(df: DataFrame, total: str, part: str, sub: str) -> DataFrame:
    """One row (total >= part >= sub) to long bars: the total, its split, and the split of the part."""
    d = check(df, (F.col(total) >= F.col(part)) & (F.col(part) >= F.col(sub)), "shares are not nested")
    bars = F.array(
        F.struct(F.lit("total").alias("bar"), F.lit("rest").alias("component"), (F.col(total) - F.col(part)).alias("area")),
        F.struct(F.lit("total").alias("bar"), F.lit("part").alias("component"), F.col(part).alias("area")),
        F.struct(F.lit("part").alias("bar"), F.lit("other").alias("component"), (F.col(part) - F.col(sub)).alias("area")),
        F.struct(F.lit("part").alias("bar"), F.lit("sub").alias("component"), F.col(sub).alias("area")),
    )
    return d.select(F.inline(bars)).withColumn("share", F.try_divide(F.col("area"), F.sum("area").over(W.partitionBy("bar"))))


# ---- joins -----------------------------------------------------------------------------


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared name; missing keys match each other."""
    shared = [c for c in left.columns if c in right.columns]
    return null_safe_join(left, right, shared, "left")


def keyed_left_join(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on {left name: right name}."""
    r = right.withColumnsRenamed({rk: lk for lk, rk in keys.items()})
    return null_safe_join(left, r, list(keys), "left")


def full_join_chain(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several tables on one key set.

    The key set of all tables is built once; each table is then attached to it, so the
    chain keeps a single partitioning instead of re-hashing coalesced keys at every step.
    """
    spine = reduce(lambda a, b: a.unionByName(b), [f.select(*keys) for f in frames]).distinct()
    return reduce(lambda acc, f: null_safe_join(acc, f, keys, "left"), frames, spine)


def inner_join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix=("_x", "_y")) -> DataFrame:
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.withColumnsRenamed({c: c + suffix[0] for c in clash})
    r = right.withColumnsRenamed({c: c + suffix[1] for c in clash})
    return null_safe_join(l, r, keys, "inner")


def right_join_flag(left: DataFrame, right: DataFrame, keys: list[str], probe: str, flag: str) -> DataFrame:
    """Keep all right rows; `flag` becomes NULL where the left side (seen through `probe`) is missing."""
    j = null_safe_join(right, left, keys, "left")
    return j.withColumn(flag, F.when(F.col(probe).isNotNull(), F.col(flag)))


def metric_star(metrics: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Many (keys, value) tables to one wide table with a single shuffle."""
    long = reduce(
        lambda a, b: a.unionByName(b),
        [d.select(*keys, F.lit(m).alias("__m"), F.col(value).alias("__v")) for m, d in metrics.items()],
    )
    return long.groupBy(*keys).pivot("__m", list(metrics)).agg(F.first("__v", ignorenulls=True))


def attach_both_sides(
    pairs: DataFrame, source: DataFrame, keys: dict[str, str], side_key: str, cols: list[str], src: str = ""
) -> DataFrame:
    """Sum `cols` of `source` by key and attach them to side 1 and side 2 of each pair.

    `keys` are extra shared keys {pair name: source name}; `side_key` is the source column
    that meets `<side_key>_1` and `<side_key>_2` of the pair.
    """
    agg = source.groupBy(*keys.values(), side_key).agg(*[sum_or_zero(c).alias(c) for c in cols])
    out = pairs
    for side in (1, 2):
        s = agg.select(
            *[F.col(r).alias(l) for l, r in keys.items()],
            F.col(side_key).alias(f"{side_key}_{side}"),
            *[F.col(c).alias(f"{c}{src}_{side}") for c in cols],
        )
        out = null_safe_join(out, s, [*keys, f"{side_key}_{side}"], "left")
    return out


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def group_representative(df: DataFrame, group: str, keep: Column, value: str, order: Column | str, name: str) -> DataFrame:
    """First `value` (by `order`) among the kept rows of each group, joined back to all rows."""
    rep = df.where(keep).groupBy(group).agg(F.min_by(value, order).alias(name))
    return df.join(rep, group, "left")


# ---- aggregates ------------------------------------------------------------------------


def typed_summary(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean of every numeric column, first (by `order`) of every other one."""
    aggs = []
    for f in df.schema.fields:
        if f.name in keys or f.name == order:
            continue
        aggs.append(
            F.avg(f.name).alias(f.name) if isinstance(f.dataType, T.NumericType) else F.min_by(f.name, order).alias(f.name)
        )
    return df.groupBy(*keys).agg(*aggs)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, ties: bool = False) -> DataFrame:
    """First n rows per group. Spark applies the rank filter before the shuffle as well, so a
    crowded group sends n rows per input partition, not all of its rows."""
    fn = F.rank() if ties else F.row_number()
    return df.withColumn("__r", fn.over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def rows_at_max(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows holding the group maximum, ties kept."""
    return top_rows(df, keys, [F.col(by).desc()], 1, ties=True)


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1)


def row_at_rank(df: DataFrame, keys: list[str], order: list[Column], rank: int = 1) -> DataFrame:
    return (
        df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .where(F.col("__r") <= rank)
        .where(F.col("__r") == rank)
        .drop("__r")
    )


def cross_tab(df: DataFrame, a: str, a_levels: list, b: str, b_levels: list, name: str = "Freq") -> DataFrame:
    """Long contingency table over declared levels; empty cells count zero."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias(name))
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(v) for v in a_levels])).alias(a))
        .select(a, F.explode(F.array(*[F.lit(v) for v in b_levels])).alias(b))
    )
    return grid.join(counts, [a, b], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def both_arms(df: DataFrame, key: str, flag: Column, weight: str | None = None) -> DataFrame:
    """Counts per arm for the keys that hold both arms."""
    aggs = [F.count_if(flag).alias("n_flag"), F.count_if(~flag).alias("n_rest")]
    if weight:
        aggs.append(F.sum(weight).alias("weight"))
    return df.groupBy(key).agg(*aggs).where((F.col("n_flag") > 0) & (F.col("n_rest") > 0))


def distinct_members(df: DataFrame, group: str, member: str, name: str, threshold: int = 1) -> DataFrame:
    """Attach the distinct member count of the group and the arm it implies."""
    n = df.groupBy(group).agg(F.countDistinct(member).alias(name))
    return null_safe_join(df, n, [group]).withColumn(
        "type", F.when(F.col(name) > threshold, "treat").otherwise("ctrl")
    )


def weighted_se(x: Column | str, w: Column | str, centre: Column | str | None = None) -> Column:
    """sqrt(sum w (x-m)^2) / sum w, from one pass of moments about `centre`.

    A value of the group's own size, such as its mean (`with_mean`), keeps the moments from
    cancelling where x lies far from zero.
    """
    wc = as_col(w)
    xc = as_col(x) if centre is None else as_col(x) - as_col(centre)
    both = F.when(xc.isNotNull(), wc)
    sw, sx, sxx = F.sum(both), F.sum(wc * xc), F.sum(wc * xc * xc)
    return F.sqrt(F.greatest(sxx - sx * sx / sw, F.lit(0.0))) / sw


def with_mean(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """`df` with the mean of `x` in its group."""
    return attach_units(df, df.groupBy(*keys).agg(F.avg(x).alias(name)), keys)


def weighted_quantiles(df: DataFrame, keys: list[str], x: str, w: str, probs: list[float], name: str = "q") -> DataFrame:
    """Interpolated quantiles of the weighted order statistics.

    With total weight S the quantile sits at position 1 + (S-1)p of the cumulative weight:
    the order statistic at floor(position) is mixed with the one at the next whole position.
    """
    from panelweave.operators.prefix import running_total

    d = (
        df.where(F.col(x).isNotNull() & (F.col(w) > 0))
        .groupBy(*keys, F.col(x).cast("double").alias("__x"))
        .agg(F.sum(w).alias("__w"))
    )
    c = running_total(d, keys, "__x", [], F.col("__w"), "__cum")
    c = attach_group(c, d.groupBy(*keys).agg(F.sum("__w").alias("__s")), keys)
    parts = []
    for i, p in enumerate(probs):
        pos = 1 + (F.col("__s") - 1) * F.lit(float(p))
        lo = F.least(F.greatest(F.floor(pos), F.lit(1)), F.col("__s"))
        hi = F.least(lo + 1, F.col("__s"))
        parts += [
            F.min(F.when(F.round("__cum", 9) >= lo, F.col("__x"))).alias(f"__a{i}"),
            F.min(F.when(F.round("__cum", 9) >= F.round(hi, 9), F.col("__x"))).alias(f"__b{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
    g = c.groupBy(*keys).agg(*parts)
    return g.select(
        *keys,
        F.array(
            *[(1 - F.col(f"__f{i}")) * F.col(f"__a{i}") + F.col(f"__f{i}") * F.col(f"__b{i}") for i in range(len(probs))]
        ).alias(name),
    )


# ---- set operations and shapes ---------------------------------------------------------


def stack_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_ids(frames: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(key) for f in frames]).distinct()


def to_long(df: DataFrame, ids: list[str], cols: list[str], var: str = "Variable", val: str = "Value") -> DataFrame:
    return df.unpivot(ids, cols, var, val)


def to_wide(df: DataFrame, ids: list[str], names: str, levels: list, value: str) -> DataFrame:
    return df.groupBy(*ids).pivot(names, levels).agg(F.first(value, ignorenulls=True))


def transpose_small(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Rows become columns: one output row per former column, one column per label."""
    cols = [c for c in df.columns if c != label]
    return to_wide(to_long(df, [label], cols), ["Variable"], label, labels, "Value")
