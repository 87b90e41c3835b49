"""Ordered scans and exact quantiles for groups of any size.

Groups small enough for one task (checked by count) use Spark's own window or `percentile`.
Beyond that rows are dealt by ranges of the full sort key, each range is scanned on its own,
and the (few) range totals are scanned to give every range its offset. Both ways sort alike.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.nulls import as_col
from panelweave.session import cut_lineage

_B = "__range"

# Rows of one group a single task may sort or keep distinct values of.
TASK_ROWS = 1_000_000


def private_keys(fn):
    """Let a `(df, keys, ...)` operator use short column names inside: its key columns are
    renamed on the way in (in every frame passed) and back on the way out."""

    @wraps(fn)
    def run(df: DataFrame, keys: list[str], *args, **kw) -> DataFrame:
        names = {k: f"__key{i}" for i, k in enumerate(keys)}
        inside = lambda a: a.withColumnsRenamed(names) if isinstance(a, DataFrame) else a
        out = fn(inside(df), list(names.values()), *[inside(a) for a in args], **{k: inside(v) for k, v in kw.items()})
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group; one small number comes back."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", plain: tuple = ()) -> DataFrame:
    """Equi-join on `keys` where NULL matches NULL; the right copies of the keys are dropped.

    Keys in `plain` cannot be NULL and use ordinary equality (one sort key instead of two).
    """
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        r = renamed[f"__r_{k}"]
        cond = cond & ((left[k] == r) if k in plain else left[k].eqNullSafe(r))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


_FNS = {"sum": F.sum, "max": F.max, "min": F.min}
_FRAMES = {"upto": (W.unboundedPreceding, 0), "before": (W.unboundedPreceding, -1), "from": (0, W.unboundedFollowing)}


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str],
    items: dict[str, tuple],
    descending: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Running aggregates along (order, ties) in each group.

    `items` maps a new column to (fn, value, side) with fn one of sum/max/min and side
    `upto` (rows up to and including this one), `before` (rows before it) or `from` (this
    one and all later rows). `group_rows` is the size of the largest group if already known.
    Both ways below sort by the same columns of any type, NULL first (last if descending).
    """
    ordered = [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in ties]]
    if (largest_group(df, keys) if group_rows is None else group_rows) <= TASK_ROWS:
        w = W.partitionBy(*keys).orderBy(*ordered)
        return df.select("*", *[_FNS[fn](v).over(w.rowsBetween(*_FRAMES[side])).alias(n) for n, (fn, v, side) in items.items()])
    return spread_scan(df, keys, ordered, items)


def spread_scan(df: DataFrame, keys: list[str], ordered: list[Column], items: dict[str, tuple], partitions: int | None = None) -> DataFrame:
    """`scan` for groups of any size, without counting them first.

    Rows are dealt by ranges of (keys, order) and written, which fixes who lies where. Each
    (group, range) is scanned on its own. Only the first and last group of a range can go on in
    another one, so at most two carried values per range are added by a broadcast join.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    specs = [(i, name, fn, side) for i, (name, (fn, _, side)) in enumerate(items.items())]
    d = df.select("*", *[v.alias(f"__v{i}") for i, (_, v, _) in enumerate(items.values())])
    d = cut_lineage(d.repartitionByRange(n, *[F.col(k).asc() for k in keys], *ordered).withColumn(_B, F.spark_partition_id()))
    totals = d.groupBy(*keys, _B).agg(*[_FNS[fn](f"__v{i}").alias(f"__t{i}") for i, _, fn, _ in specs])
    across = W.partitionBy(*keys).orderBy(_B)  # a row per range that the group reaches
    sides = {"from": across.rowsBetween(1, W.unboundedFollowing)}
    carried = [_FNS[fn](f"__t{i}").over(sides.get(side, across.rowsBetween(W.unboundedPreceding, -1))).alias(f"__o{i}") for i, _, fn, side in specs]
    carry = totals.select(*keys, _B, F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__ranges"), *carried).where("__ranges > 1").drop("__ranges")
    inside = W.partitionBy(*keys, _B).orderBy(*ordered)
    d = d.select("*", *[_FNS[fn](f"__v{i}").over(inside.rowsBetween(*_FRAMES[side])).alias(f"__i{i}") for i, _, fn, side in specs])
    out = null_safe_join(d, F.broadcast(carry), [*keys, _B], "left", plain=(_B,))
    joined = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
    new = [joined[fn](F.col(f"__i{i}"), F.col(f"__o{i}")).alias(name) for i, name, fn, _ in specs]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in items], *new)


def running_total(
    df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, descending: bool = False
) -> DataFrame:
    """`sum(value)` over rows up to and including the current one in (order, ties)."""
    return scan(df, keys, order, ties, {name: ("sum", value, "upto")}, descending)


def _before(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str) -> DataFrame:
    # of all rows before, the last one is the greatest in the order of the scan
    last = F.struct(F.col(order).alias("o"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)], F.col(value).alias("v"))
    return scan(df, keys, order, ties, {"__before": ("max", last, "before")})


def previous(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str) -> DataFrame:
    """`value` of the row before in (order, ties), NULL at the first row, for groups of any size."""
    return _before(df, keys, order, ties, value).withColumn(name, F.col("__before.v")).drop("__before")


def trapezoid(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str = "area", width: Column | None = None) -> DataFrame:
    """Area below `value` along `order` per group; steps are as wide as `order` says, or `width`.

    Steps with a NULL end add nothing; groups without a step have no row.
    """
    d = _before(df, keys, order, ties, value).where("__before IS NOT NULL")
    step = F.col(order) - F.col("__before.o") if width is None else width
    return d.groupBy(*keys).agg(F.sum((F.col(value) + F.col("__before.v")) / 2 * step).alias(name))


def number_rows(df: DataFrame, order: str, name: str = "id", ties: list[str] | None = None) -> DataFrame:
    """1..n in the declared order, as a distributed scan."""
    return running_total(df, [], order, ties or [], F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    name: str = "q",
    group_rows: int | None = None,
) -> DataFrame:
    """Type-7 quantiles per group, as an array column, for groups of any size."""
    d = df.where(F.col(value).isNotNull())
    if (largest_group(d, keys) if group_rows is None else group_rows) <= TASK_ROWS:
        return d.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(name))
    return _spread_quantiles(d, keys, value, probs, name)


def _spread_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str) -> DataFrame:
    """Distinct values are counted first (copies collapse map-side) and stored once; cumulative
    counts then locate the two order statistics each quantile interpolates between. Positions
    and weights are those of Spark's `percentile`."""
    d = cut_lineage(df.groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c")))
    c = spread_scan(d, keys, [F.col("__x")], {"__last": ("sum", F.col("__c"), "upto")})
    ranked = attach_group(c, d.groupBy(*keys).agg(F.sum("__c").alias("__n")), keys)
    at = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    # `__last` copies are at or below a value, so it holds positions last - c .. last - 1
    holds = lambda r: (F.col("__last") > r) & (F.col("__last") - F.col("__c") <= r)
    parts = [F.max("__n").alias("__n")]
    for i, p in enumerate(probs):
        parts += [F.max(F.when(holds(f(at(p))), F.col("__x"))).alias(f"__{a}{i}") for a, f in (("a", F.floor), ("b", F.ceil))]
    one = lambda i, p: F.when(F.col(f"__a{i}") == F.col(f"__b{i}"), F.col(f"__a{i}")).otherwise(
        (F.ceil(at(p)) - at(p)) * F.col(f"__a{i}") + (at(p) - F.floor(at(p))) * F.col(f"__b{i}")
    )
    return ranked.groupBy(*keys).agg(*parts).select(*keys, F.array(*[one(i, p) for i, p in enumerate(probs)]).alias(name))


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row, as a scalar subquery."""
    cols = one_row.columns
    d = df.withColumn("__single", one_row.select(F.struct(*cols)).scalar())
    return d.select(*df.columns, *[F.col("__single")[c].alias(c) for c in cols])


def attach_group(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Join one-row-per-group values back to the rows (a single row when there are no keys)."""
    return null_safe_join(df, per_group, keys) if keys else attach_single(df, per_group)


# Bytes (as JSON text) of a per-group table that may be broadcast, and the spread of a crowded key beyond that.
BROADCAST_BYTES = 64_000_000
SALTS = 32


def text_bytes(df: DataFrame) -> int:
    """Size of a written table as JSON text; one number comes back."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def attach_units(rows: DataFrame, per_group: DataFrame, keys: list[str], written: bool = False) -> DataFrame:
    """`attach_group` for row tables with crowded keys.

    The per-group table is written first and measured: up to BROADCAST_BYTES it is broadcast and
    the rows are not shuffled at all; beyond that both sides carry a salt and a key holding a
    large share of the rows is spread over SALTS tasks.
    """
    if not keys:
        return attach_single(rows, per_group)
    per = per_group if written else cut_lineage(per_group)
    if text_bytes(per) <= BROADCAST_BYTES:
        return null_safe_join(rows, F.broadcast(per), keys)
    left = rows.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int"))
    right = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe_join(left, right, [*keys, "__salt"], plain=("__salt",)).drop("__salt")


def winsorise(df: DataFrame, cols: list[str], keys: list[str] | None = None, probs=(0.01, 0.99), suffix: str = "") -> DataFrame:
    """Pull values outside the two group quantiles back to them."""
    keys = list(keys or [])
    ps = [float(p) for p in probs]
    size = largest_group(df, keys)
    if size <= TASK_ROWS:  # all columns in one pass
        per = df.groupBy(*keys).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in ps])).alias(f"__q_{c}") for c in cols])
        out = attach_group(df, per, keys)
    else:
        out = df
        for c in cols:
            out = attach_group(out, exact_quantiles(df, keys, c, ps, name=f"__q_{c}", group_rows=size), keys)
    for c in cols:
        x = as_col(c)
        bounded = F.when(x.isNotNull(), F.least(F.greatest(x, F.col(f"__q_{c}")[0]), F.col(f"__q_{c}")[1]))
        out = out.withColumn(c + suffix, bounded)
    return out.drop(*[f"__q_{c}" for c in cols])


def rescale01(df: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
    """(x - min)/(max - min) per group; a constant group gives 0.5."""
    per = df.groupBy(*keys).agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    span = F.col("__mx") - F.col("__mn")
    return (
        attach_group(df, per, keys)
        .withColumn(
            name, F.when(as_col(col).isNotNull(), F.when(span == 0, 0.5).otherwise((F.col(col) - F.col("__mn")) / span))
        )
        .drop("__mn", "__mx")
    )
