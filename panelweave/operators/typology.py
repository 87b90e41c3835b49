"""Pairs of countries over one aquifer: scores, two-sided indicators, classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.nulls import ratio, strict_greatest, strict_least
from panelweave.operators.cells import border_pairs
from panelweave.operators.prefix import null_safe_join
from panelweave.operators.tables import attach_both_sides, override_values

# Class labels in order, and the distance classes.
CLASSES = ["IU0", "IU1", "UB", "BL", "DA"]
DISTANCE_CLASSES = ["0-10km", "10-100km", "100+km"]


@dataclass(frozen=True)
class Rule:
    """Which columns and cuts one classification run uses."""

    label: str = "main"
    eps: float = 1e-3
    thresh: float = 0.99
    near: str = "_B1"
    far: str = "_B2"
    metric: str = "GW"
    potential: str = "CR3"


# The parameter variants reported next to the main run.
VARIANTS = [
    Rule(),
    Rule(label="far_200km", far="_B22"),
    Rule(label="near_5km", near="_B11"),
    Rule(label="all_irrigation", metric="IR"),
    Rule(label="small_eps", eps=1e-5),
    Rule(label="half_threshold", thresh=0.5),
]


def country_pairs(segments: DataFrame, names: DataFrame, size: float, code: str = "code", country: str = "CC") -> DataFrame:
    """Country pairs that share a border inside an aquifer, with the aquifer's name."""
    p = border_pairs(segments, code, country, size)
    return p.join(names, code, "left")


def cooperation_scores(pairs: DataFrame, agreements: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Lower of the two sides' best agreement scores, 0 unless both sides have one."""
    best = agreements.groupBy("CC", "code").agg(F.max("ArrangementScore").alias("__s"))
    out = pairs
    for side in (1, 2):
        s = best.select("code", F.col("CC").alias(f"CC_{side}"), F.col("__s").alias(f"__s{side}"))
        out = null_safe_join(out, s, ["code", f"CC_{side}"], "left")
    out = out.withColumn("ArrangementScore", F.coalesce(strict_least("__s1", "__s2"), F.lit(0))).drop("__s1", "__s2")
    return override_values(out, "ArrangementScore", "code", overrides, "score") if overrides is not None else out


def attach_sources(pairs: DataFrame, sources: dict[str, tuple[DataFrame, bool]], cols: list[str]) -> DataFrame:
    """Indicators of every source on both sides; {suffix: (table, joined by code as well?)}."""
    out = pairs
    for src, (table, by_code) in sources.items():
        have = [c for c in cols if c in table.columns]
        out = attach_both_sides(out, table, {"code": "code"} if by_code else {}, "CC", have, src)
    return out


def attach_sources_pivoted(pairs: DataFrame, long: DataFrame, sources: list[str], cols: list[str], by_country: tuple[str, ...] = ("_C",)) -> DataFrame:
    """Same, from one long table (code, CC, src, cols): one aggregate and two joins for each key set.

    Sources in `by_country` are totals of the country over all codes and joined by country alone.
    """
    out = pairs
    for keys, own in ((["code"], [s for s in sources if s not in by_country]), ([], [s for s in sources if s in by_country])):
        if not own:
            continue
        wide = long.where(F.col("src").isin(own)).groupBy(*keys, "CC").pivot("src", own).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
        for side in (1, 2):
            ren = [F.col(f"`{s}_{c}`" if len(cols) > 1 else f"`{s}`").alias(f"{c}{s}_{side}") for s in own for c in cols]
            out = null_safe_join(out, wide.select(*keys, F.col("CC").alias(f"CC_{side}"), *ren), [*keys, f"CC_{side}"], "left")
    return out


def type_class(rule: Rule, current: bool = True) -> Column:
    """Class of a pair; the future class replaces the metric by the larger of current and potential."""
    m, near, far, eps = rule.metric, rule.near, rule.far, rule.eps

    def val(src: str, side: int) -> Column:
        c = F.col(f"{m}{src}_{side}")
        return c if current else strict_greatest(c, F.col(f"{rule.potential}{src}_{side}"))

    far1, far2 = val(far, 1), val(far, 2)
    u1, u2 = F.col(f"UR{far}_1"), F.col(f"UR{far}_2")
    near_share = strict_greatest(ratio(val(near, 1), val("", 1)), ratio(val(near, 2), val("", 2)))
    return (
        F.when((strict_greatest(far1, far2) < eps) & (strict_greatest(u1, u2) < eps), "IU0")
        .when(((far1 < eps) & (u1 < eps)) | ((far2 < eps) & (u2 < eps)), "IU1")
        .when(strict_least(far1, far2) < eps, "UB")
        .when(near_share > rule.thresh, "BL")
        .otherwise("DA")
    )


def classify(pairs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    return pairs.withColumn("class", type_class(rule)).withColumn("classF", type_class(rule, current=False))


def classify_variants(pairs: DataFrame, rules: list[Rule] = VARIANTS) -> DataFrame:
    """All parameter variants in one pass: (pair columns, label, class, classF)."""
    ids = [c for c in ("code", "name", "CC_1", "CC_2") if c in pairs.columns]
    runs = F.array(
        *[
            F.struct(F.lit(r.label).alias("label"), type_class(r).alias("class"), type_class(r, current=False).alias("classF"))
            for r in rules
        ]
    )
    return pairs.select(*ids, F.inline(runs))


def transitions(classified: DataFrame, keys: list[str] = ()) -> DataFrame:
    return classified.groupBy(*keys, "class", "classF").agg(F.count(F.lit(1)).alias("n"))


def derived_shares(pairs: DataFrame) -> DataFrame:
    """Aquifer share of national use (FGW) and blue-water share (FBW), long form, used pairs only."""
    both = lambda a, b="": F.col(f"{a}{b}_1") + F.col(f"{a}{b}_2")
    d = (
        pairs.withColumn("FGW", ratio(both("GW"), both("GW", "_C")))
        .withColumn("FBW", ratio(both("GW3"), both("GW")))
        .withColumn("GW", both("GW") * 1000)
        .where(F.col("GW") > 0)
    )
    keep = [c for c in ("code", "CC_1", "CC_2") if c in d.columns]
    return d.select(*keep, "class", "FGW", "FBW").unpivot([*keep, "class"], ["FGW", "FBW"], "Variable", "Value")


def distance_class(thresh: float = 0.99, near: str = "_B1", far: str = "_B2") -> Column:
    share = lambda s: strict_greatest(ratio(f"Area{s}_1", "Area_1"), ratio(f"Area{s}_2", "Area_2"))
    return F.when(share(near) >= thresh, "0-10km").when(share(far) >= thresh, "10-100km").otherwise("100+km")

