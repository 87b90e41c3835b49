"""Class comparisons, densities and distribution summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.distributions import p_studentised_range, q_student
from panelweave.functions.nulls import is_finite
from panelweave.operators.prefix import attach_group, attach_units, exact_quantiles, null_safe_join
from panelweave.session import cut_lineage


def class_moments(df: DataFrame, keys: list[str], cls: str, value: str) -> DataFrame:
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*keys, cls).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var")
    )


def class_means(df: DataFrame, keys: list[str], cls: str, value: str, level: float = 0.95) -> DataFrame:
    """Mean, standard error and t interval per class; se divides by the rows of the class."""
    m = df.groupBy(*keys, cls).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.stddev_samp(value).alias("__sd"),
        F.count(value).alias("__n"),
    )
    q = q_student(F.lit(1 - (1 - level) / 2), F.when(F.col("__n") > 1, F.col("__n") - 1).cast("double"))
    half = q * F.col("__sd") / F.sqrt("__n")
    return (
        m.withColumn("__h", half)
        .withColumn("ci_low", F.col("mean") - F.col("__h"))
        .withColumn("ci_high", F.col("mean") + F.col("__h"))
        .drop("__h", "__sd", "__n")
    )


def anova(df: DataFrame, keys: list[str], cls: str, value: str) -> DataFrame:
    """One-way table per key: groups, rows, between and within sums of squares, F."""
    m = class_moments(df, keys, cls, value)
    g = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("mean")).alias("s1"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("s2"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    )
    g = g.withColumn("ss_between", F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"))
    msw = F.try_divide(F.col("ss_within"), F.col("n") - F.col("k"))
    return g.select(
        *keys,
        "k",
        "n",
        "ss_between",
        "ss_within",
        msw.alias("mse"),
        F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), msw).alias("f_value"),
    )


def pairwise_ranges(df: DataFrame, keys: list[str], cls: str, value: str, p_values: bool = True) -> DataFrame:
    """All class pairs with the difference, the studentised range statistic and its p-value.

    Classes are a handful of labels, so the pair table stays small whatever the rows.
    """
    m = class_moments(df, keys, cls, value)
    a = anova(df, keys, cls, value).select(*keys, "k", F.col("n").alias("total"), "mse")
    l = m.select(*keys, F.col(cls).alias("class_1"), F.col("n").alias("n_1"), F.col("mean").alias("mean_1"))
    r = m.select(*keys, F.col(cls).alias("class_2"), F.col("n").alias("n_2"), F.col("mean").alias("mean_2"))
    j = null_safe_join(null_safe_join(l, r, keys).where(F.col("class_1") < F.col("class_2")), a, keys)
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("n_1") + 1 / F.col("n_2")))
    out = j.select(
        *keys,
        "class_1",
        "class_2",
        "mean_1",
        "mean_2",
        (F.col("mean_2") - F.col("mean_1")).alias("diff"),
        F.try_divide(F.abs(F.col("mean_2") - F.col("mean_1")), se).alias("q"),
        F.col("k").cast("int").alias("k"),
        (F.col("total") - F.col("k")).cast("double").alias("df"),
    )
    return out.withColumn("p", p_studentised_range("q", "k", "df")) if p_values else out


def letter_groups(labels: list[str], differ: set[frozenset]) -> dict[str, str]:
    """Compact letter display by inserting and absorbing columns; labels come best first."""
    columns = [set(labels)]
    for pair in sorted(differ, key=lambda s: sorted(labels.index(v) for v in s)):
        i, j = sorted(pair, key=labels.index)
        nxt: list[set] = []
        for col in columns:
            nxt += [col - {i}, col - {j}] if i in col and j in col else [col]
        columns = []
        for c in sorted(nxt, key=len, reverse=True):
            if not any(c <= kept for kept in columns):
                columns.append(c)
    columns.sort(key=lambda c: sorted(labels.index(v) for v in c))
    return {v: "".join(chr(97 + k) for k, c in enumerate(columns) if v in c) for v in labels}


def compact_letters(pairs: DataFrame, key: str, alpha: float = 0.1) -> DataFrame:
    """Letters per class from the pair table (one small group of class pairs per key)."""
    kt = pairs.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        means = {**dict(zip(pdf.class_1, pdf.mean_1)), **dict(zip(pdf.class_2, pdf.mean_2))}
        order = sorted(means, key=lambda c: (-means[c], c))
        differ = {frozenset((a, b)) for a, b, p in zip(pdf.class_1, pdf.class_2, pdf.p) if p is not None and p < alpha}
        got = letter_groups(order, differ)
        return pd.DataFrame({key: pdf[key].iloc[0], "class": list(got), "letters": list(got.values())})

    return pairs.groupBy(key).applyInPandas(run, f"`{key}` {kt}, class string, letters string")


def density_grid(df: DataFrame, keys: list[str], value: str, n: int = 256, adjust: float = 1.0, half_width: float = 0.30) -> DataFrame:
    """Gaussian density on n points from min-3bw to max+3bw, with the peak-scaled width.

    A group with fewer than two values or no spread gives three points of zero width.
    """
    d = df.where(is_finite(value)).select(*keys, F.col(value).cast("double").alias("__x"))
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp("__x").alias("__sd"),
        F.min("__x").alias("__mn"),
        F.max("__x").alias("__mx"),
    )
    s = attach_group(s, exact_quantiles(d, keys, "__x", [0.25, 0.75], name="__q"), keys)
    iqr = (F.col("__q")[1] - F.col("__q")[0]) / 1.34
    spread = F.when(iqr > 0, F.least("__sd", iqr)).otherwise(F.col("__sd"))
    s = s.withColumn("__bw", spread * 0.9 * F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * adjust)
    flat = (F.col("__n") < 2) | (F.coalesce(F.col("__sd"), F.lit(0.0)) < 1.5e-8)
    copies = d.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__m"))
    j = null_safe_join(copies, s.where(~flat), keys).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.col("__mn") - 3 * F.col("__bw"), F.col("__mx") + 3 * F.col("__bw")
    y = lo + (hi - lo) * F.col("k") / (n - 1)
    u = (y - F.col("__x")) / F.col("__bw")
    g = j.groupBy(*keys, "k").agg(
        F.first(y).alias("y"),
        (F.sum(F.col("__m") * F.exp(u * u * -0.5)) / (F.first("__n") * F.first("__bw") * math.sqrt(2 * math.pi))).alias("dens"),
    )
    peak = g.groupBy(*keys).agg(F.max("dens").alias("__pk"))
    main = null_safe_join(g, peak, keys).withColumn("w", F.col("dens") / F.col("__pk") * half_width).drop("__pk")
    dots = (
        s.where(flat)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .select(*keys, "k", (F.col("__mn") + (F.col("k") - 1) * 1e-6).alias("y"), F.lit(None).cast("double").alias("dens"), F.lit(0.0).alias("w"))
    )
    return main.unionByName(dots)


def binned_density(df: DataFrame, keys: list[str], value: str, n: int = 256, adjust: float = 1.0, half_width: float = 0.30, bins: int = 512) -> DataFrame:
    """`density_grid` by linear binning and one fast transform per group.

    Each value splits its weight between the two grid points around it, in one aggregate; a group
    is then a row of `bins` weights, whatever its size. Their convolution with the kernel is
    read off at n points by linear interpolation.
    """
    d = df.where(is_finite(value)).select(*keys, F.col(value).cast("double").alias("__x"))
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"), F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    s = attach_group(s, exact_quantiles(d, keys, "__x", [0.25, 0.75], name="__q"), keys)
    iqr = (F.col("__q")[1] - F.col("__q")[0]) / 1.34
    spread = F.when(iqr > 0, F.least("__sd", iqr)).otherwise(F.col("__sd"))
    s = cut_lineage(s.withColumn("__bw", spread * 0.9 * F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * adjust))
    flat = (F.col("__n") < 2) | (F.coalesce(F.col("__sd"), F.lit(0.0)) < 1.5e-8)
    lo, hi = F.col("__mn") - 7 * F.col("__bw"), F.col("__mx") + 7 * F.col("__bw")
    at = (F.col("__x") - lo) / ((hi - lo) / (bins - 1))
    j = attach_units(d, s.where(~flat), keys, written=True).withColumn("__at", at).withColumn("__i", F.floor("__at"))
    share = F.explode(F.array(*[F.struct((F.col("__i") + k).alias("bin"), w.alias("w")) for k, w in ((0, 1 - (F.col("__at") - F.col("__i"))), (1, F.col("__at") - F.col("__i")))]))
    binned = j.select(*keys, "__n", "__mn", "__mx", "__bw", share.alias("__b")).groupBy(*keys, "__b.bin").agg(F.sum("__b.w").alias("w"), *[F.first(c).alias(c) for c in ("__n", "__mn", "__mx", "__bw")])

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        count, low, high, bw = (float(pdf[c].iloc[0]) for c in ("__n", "__mn", "__mx", "__bw"))
        weight = np.zeros(2 * bins)
        at = pdf["bin"].to_numpy()
        weight[at[at < bins]] = pdf["w"].to_numpy()[at < bins]
        grid = np.linspace(low - 7 * bw, high + 7 * bw, bins)
        step = grid[1] - grid[0]
        away = np.concatenate([np.arange(bins + 1), np.arange(bins - 1, 0, -1)]) * step
        kernel = np.exp(-0.5 * (away / bw) ** 2) / (count * bw * math.sqrt(2 * math.pi))
        dens = np.fft.irfft(np.fft.rfft(weight) * np.fft.rfft(kernel), 2 * bins)[:bins]
        y = np.linspace(low - 3 * bw, high + 3 * bw, n)
        dens = np.maximum(0.0, np.interp(y, grid, dens))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "k": np.arange(n), "y": y, "dens": dens, "w": dens / dens.max() * half_width})

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*keys).schema.fields) + "k int, y double, dens double, w double"
    main = (binned.groupBy(*keys) if keys else binned.groupBy(F.lit(0))).applyInPandas(convolve, schema)
    dots = s.where(flat).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        *keys, "k", (F.col("__mn") + (F.col("k") - 1) * 1e-6).alias("y"), F.lit(None).cast("double").alias("dens"), F.lit(0.0).alias("w")
    )
    return main.unionByName(dots)


def spread_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and the 5/25/50/75/95% points."""
    d = df.select(*keys, F.when(is_finite(value), F.col(value)).alias("__x"))
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    q = exact_quantiles(d, keys, "__x", list(probs.values()), name="__q")
    means = d.groupBy(*keys).agg(F.avg("__x").alias("mean"))
    both = null_safe_join(means, q, keys, "left") if keys else attach_group(means, q, keys)
    return both.select(*keys, "mean", *[F.col("__q")[i].alias(k) for i, k in enumerate(probs)])


def normalised_class_means(df: DataFrame, cls: str, value: str) -> DataFrame:
    """Value over its overall mean, then mean and sd/sqrt(n) per class."""
    per = df.groupBy(cls).agg(
        F.sum(value).alias("__s"), F.count(value).alias("__n"), F.avg(value).alias("__m"),
        F.stddev_samp(value).alias("__sd"), F.count(F.lit(1)).alias("__rows"),
    )
    # one row per class from here on
    total = F.sum("__s").over(W.partitionBy()) / F.sum("__n").over(W.partitionBy())
    return per.select(
        cls, (F.col("__m") / total).alias("mean"), (F.col("__sd") / total / F.sqrt("__rows")).alias("se")
    )
