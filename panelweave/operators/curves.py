"""Percentile curves and the concentration index between two of them, row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.prefix import exact_quantiles, null_safe_join

# The percentiles of a curve.
CURVE_PERCENTILES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]


def percentile_curve(df: DataFrame, keys: list[str], value: str, name: str = "curve") -> DataFrame:
    """`array<struct<p, v>>` of the exact 0..100 percentiles of `value` per group."""
    q = exact_quantiles(df, keys, value, [p / 100 for p in CURVE_PERCENTILES])
    pts = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("q")[i].alias("v")) for i, p in enumerate(CURVE_PERCENTILES)])
    return q.select(*keys, pts.alias(name))


def running_max(values: Column) -> Column:
    return F.transform(values, lambda _, i: F.array_max(F.slice(values, F.lit(1), i + 1)))


def interpolate(xs: Column, ys: Column, at: Column) -> Column:
    """Linear interpolation on nondecreasing `xs`, constant beyond the ends, rightmost y at ties."""
    r = F.size(F.filter(xs, lambda x: x <= at))  # points at or left of `at`
    n = F.size(xs)
    x0, x1 = F.get(xs, r - 1), F.get(xs, r)
    y0, y1 = F.get(ys, r - 1), F.get(ys, r)
    return (
        F.when(r == 0, F.get(ys, F.lit(0)))
        .when((r == n) | (x0 == at), y0)
        .otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))
    )


def concentration(df: DataFrame, land: str, activity: str, name: str = "gini") -> DataFrame:
    """Add the Lorenz-type index of `activity` against `land`, both `array<struct<p, v>>`.

    Fewer than three points present in both curves give NULL.
    """
    act = F.map_from_entries(F.col(activity))
    both = F.filter(
        F.transform(
            F.array_sort(F.col(land)), lambda s: F.struct(s["p"].alias("p"), s["v"].alias("l"), F.try_element_at(act, s["p"]).alias("i"))
        ),
        lambda s: s["l"].isNotNull() & s["i"].isNotNull(),
    )
    d = df.withColumn("__b", both)
    d = (
        d.withColumn("__p", F.col("__b.p"))
        .withColumn("__l", running_max(F.col("__b.l")))
        .withColumn("__i", running_max(F.col("__b.i")))
    )
    p, l, i = F.col("__p"), F.col("__l"), F.col("__i")
    pct = lambda c: F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0))
    by_land = F.zip_with(p, l, lambda a, b: F.struct(a.alias("x"), interpolate(i, p, b).alias("y")))
    by_act = F.zip_with(i, p, lambda a, b: F.struct(interpolate(l, p, a).alias("x"), b.alias("y")))
    d = d.withColumn("__c", F.transform(F.array_sort(F.concat(by_land, by_act)), lambda s: F.struct(pct(s["x"]).alias("x"), pct(s["y"]).alias("y"))))
    c = F.col("__c")
    same = lambda a, b: (F.round(a["x"], 6) == F.round(b["x"], 6)) & (F.round(a["y"], 6) == F.round(b["y"], 6))
    d = d.withColumn("__c", F.filter(c, lambda s, k: ~F.exists(F.slice(c, F.lit(1), k), lambda e: same(e, s))))
    steps = F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1),
        F.slice(c, F.lit(2), F.size(c) - 1),
        lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 20000,
    )
    area = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)
    return d.withColumn(name, F.when(F.size("__b") >= 3, 1 - 2 * area)).drop("__b", "__p", "__l", "__i", "__c")


def concentration_star(land: DataFrame, masks: dict[str, DataFrame], keys: list[str], curve: str = "curve") -> DataFrame:
    """One index per mask curve against the same land curve: one join, one pivot."""
    long = reduce(
        lambda a, b: a.unionByName(b), [m.select(*keys, F.lit(k).alias("metric"), F.col(curve).alias("act")) for k, m in masks.items()]
    )
    j = null_safe_join(long, land.select(*keys, F.col(curve).alias("land")), keys)
    g = concentration(j, "land", "act")
    return g.groupBy(*keys).pivot("metric", list(masks)).agg(F.first("gini", ignorenulls=True))
