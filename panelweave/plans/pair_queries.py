"""Country pairs: building, scores, indicators, classes."""

from pyspark.sql import functions as F

from panelweave.operators import tables, typology
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import PAIRS, pairs
from panelweave.plans.area_queries import SEGMENTS, _segments

_SRC = {"": "bal > -2000", "_B1": "bal BETWEEN 0 AND 2500", "_B2": "bal BETWEEN 0 AND 7000", "_B11": "bal BETWEEN 0 AND 1200", "_B22": "bal BETWEEN 0 AND 9000", "_C": "bal > -999999"}
_VARS = {
    "GW": "seg = 'BUILDING' AND NOT (nat % 5 = 1 AND bal > 0 AND bal < 9500)",
    "GW3": "seg = 'BUILDING' AND bal > 4000",
    "CR3": "seg IN ('BUILDING', 'HOUSEHOLD') AND NOT (nat % 7 = 3 AND bal > 0)",
    "UR": "seg = 'MACHINERY' AND NOT (nat % 3 = 1 AND bal > 0 AND bal < 9500)",
    "IR": "seg IN ('BUILDING', 'MACHINERY')",
    "Area": "bal > -999999",
}
COLS = list(_VARS)
_CODE = "CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 2 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END"


def indicators(spark, d):
    """Customer balances as areas: (code, CC, src, GW, GW3, CR3, UR, IR, Area), one row per customer and source.

    Half the customers of every fourth nation lie in a second code, so country totals differ from code totals.
    """
    c = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.expr(_CODE).alias("code"), F.col("c_nationkey").alias("CC"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    srcs = F.filter(F.array(*[F.when(F.expr(cond), F.lit(s)) for s, cond in _SRC.items()]), lambda s: s.isNotNull())
    vals = [F.when(F.expr(cond), F.abs("bal") / 1000).alias(v) for v, cond in _VARS.items()]
    return c.select("code", "CC", F.explode(srcs).alias("src"), *vals)


_IND = (
    f"cust AS (SELECT {_CODE} AS code, c_nationkey AS CC, c_nationkey AS nat, c_acctbal AS bal, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    + "".join(
        f"{name} AS (SELECT {keys}, "
        + ", ".join(
            f"CASE WHEN count(*) FILTER ({sc}) > 0 THEN coalesce(sum(abs(bal) / 1000) FILTER (({sc}) AND ({vc})), 0) END AS {v}{s}"
            for s, sc in _SRC.items() if (s == "_C") == (name == "nations") for v, vc in _VARS.items()
        )
        + f" FROM cust GROUP BY {keys}), "
        for name, keys in (("wide", "code, CC"), ("nations", "CC"))
    )
    + "dyads AS (SELECT p.code, p.CC_1, p.CC_2, "
    + ", ".join(f"{w if s != '_C' else 'n' + w}.{v}{s} AS {v}{s}_{i}" for i, w in ((1, "a"), (2, "b")) for s in _SRC for v in _VARS)
    + " FROM pairs p LEFT JOIN wide a ON a.code = p.code AND a.CC = p.CC_1 LEFT JOIN wide b ON b.code = p.code AND b.CC = p.CC_2 LEFT JOIN nations na ON na.CC = p.CC_1 LEFT JOIN nations nb ON nb.CC = p.CC_2)"
)
DYADS = f"{PAIRS}, {_IND}"


def dyads(spark, d):
    return typology.attach_sources_pivoted(pairs(spark, d), indicators(spark, d), list(_SRC), COLS)


def _smax(a, b):
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE greatest({a}, {b}) END"


def _smin(a, b):
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE least({a}, {b}) END"


def _ratio(a, b):
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) END ELSE {a} / {b} END"


def _class_sql(rule, current=True):
    def val(src, side):
        c = f"{rule.metric}{src}_{side}"
        return c if current else f"({_smax(c, f'CR3{src}_{side}')})"

    f1, f2, u1, u2 = val(rule.far, 1), val(rule.far, 2), f"UR{rule.far}_1", f"UR{rule.far}_2"
    near = _smax(f"({_ratio(val(rule.near, 1), val('', 1))})", f"({_ratio(val(rule.near, 2), val('', 2))})")
    e = rule.eps
    return f"""CASE WHEN ({_smax(f1, f2)}) < {e} AND ({_smax(u1, u2)}) < {e} THEN 'IU0' WHEN ({f1} < {e} AND {u1} < {e}) OR ({f2} < {e} AND {u2} < {e}) THEN 'IU1'
      WHEN ({_smin(f1, f2)}) < {e} THEN 'UB' WHEN ({near}) > {rule.thresh} THEN 'BL' ELSE 'DA' END"""


@query("bordering_pairs", f"WITH {SEGMENTS} SELECT segment AS code, nation_1 AS CC_1, nation_2 AS CC_2, count(*) * 10.0 AS border_length, n.name FROM contact JOIN (SELECT c_mktsegment, lower(c_mktsegment) AS name FROM customer GROUP BY 1) n ON n.c_mktsegment = segment GROUP BY 1, 2, 3, 5")
def bordering_pairs(spark, d):
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("code")).distinct().withColumn("name", F.lower("code"))
    seg = _segments(spark, d).withColumnsRenamed({"segment": "code", "nation": "CC"})
    return typology.country_pairs(seg, names, 10.0)


@query(
    "cooperation_scores",
    f"""WITH {PAIRS}, s AS (SELECT c_nationkey AS CC, n_regionkey AS code, max(c_custkey % 4) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 6 <> 2 GROUP BY 1, 2)
       SELECT p.code, p.CC_1, p.CC_2, CASE WHEN p.code = 4 THEN 3 ELSE coalesce(CASE WHEN a.s IS NULL OR b.s IS NULL THEN NULL ELSE least(a.s, b.s) END, 0) END AS ArrangementScore
       FROM pairs p LEFT JOIN s a ON a.CC = CC_1 AND a.code = p.code LEFT JOIN s b ON b.CC = CC_2 AND b.code = p.code""",
)
def cooperation_scores(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("code"))
    agr = table(spark, d, "customer").where(F.col("c_nationkey") % 6 != 2).join(n, "c_nationkey").select(F.col("c_nationkey").alias("CC"), "code", (F.col("c_custkey") % 4).alias("ArrangementScore"))
    over = table(spark, d, "region").where(F.col("r_regionkey") == 4).select(F.col("r_regionkey").alias("code"), F.lit(3).cast("bigint").alias("score"))
    return typology.cooperation_scores(pairs(spark, d), agr, over).select("code", "CC_1", "CC_2", "ArrangementScore")


@query(
    "two_sided_indicators",
    f"WITH {DYADS} SELECT code, CC_1, CC_2, " + ", ".join(f"round({v}{s}_{i}, 5) AS {v}{s}_{i}" for i in (1, 2) for s in _SRC for v in _VARS) + " FROM dyads",
)
def two_sided_indicators(spark, d):
    return rounded(dyads(spark, d), 5)


@query(
    "two_sided_indicators_by_source",
    f"WITH {DYADS}, own AS (SELECT CC, "
    + ", ".join(f"CASE WHEN count(*) FILTER ({_SRC['_B2']}) > 0 THEN coalesce(sum(abs(bal) / 1000) FILTER (({_SRC['_B2']}) AND ({_VARS[v]})), 0) END AS {v}" for v in ("GW", "UR"))
    + " FROM cust GROUP BY 1) SELECT d.code, d.CC_1, d.CC_2, "
    + ", ".join(f"round(d.{v}_B1_{i}, 5) AS {v}_B1_{i}, round(o{i}.{v}, 5) AS {v}_B2_{i}" for i in (1, 2) for v in ("GW", "UR"))
    + " FROM dyads d LEFT JOIN own o1 ON o1.CC = d.CC_1 LEFT JOIN own o2 ON o2.CC = d.CC_2",
)
def two_sided_indicators_by_source(spark, d):
    """Source tables joined one after the other, with and without the aquifer key."""
    i = indicators(spark, d)
    src = {s: (i.where(F.col("src") == s), s == "_B1") for s in ("_B1", "_B2")}
    return rounded(typology.attach_sources(pairs(spark, d), src, ["GW", "UR", "absent"]), 5)


_MAIN = typology.VARIANTS[0]
_CLS = f"cls AS (SELECT *, {_class_sql(_MAIN)} AS class, {_class_sql(_MAIN, False)} AS classF FROM dyads)"


@query("pair_classes", f"WITH {DYADS}, {_CLS} SELECT code, CC_1, CC_2, class, classF FROM cls")
def pair_classes(spark, d):
    return typology.classify(dyads(spark, d)).select("code", "CC_1", "CC_2", "class", "classF")


@query("class_transitions", f"WITH {DYADS}, {_CLS} SELECT class, classF, count(*) AS n FROM cls GROUP BY 1, 2")
def class_transitions(spark, d):
    return typology.transitions(typology.classify(dyads(spark, d)))


@query(
    "class_variants",
    f"WITH {DYADS} "
    + " UNION ALL ".join(f"SELECT code, CC_1, CC_2, '{r.label}' AS label, {_class_sql(r)} AS class, {_class_sql(r, False)} AS classF FROM dyads" for r in typology.VARIANTS),
)
def class_variants(spark, d):
    return typology.classify_variants(dyads(spark, d))


@query(
    "derived_pair_shares",
    f"""WITH {DYADS}, {_CLS}, x AS (SELECT * FROM cls WHERE GW_1 + GW_2 > 0)
       SELECT code, CC_1, CC_2, class, 'FGW' AS Variable, round({_ratio('(GW_1 + GW_2)', '(GW_C_1 + GW_C_2)')}, 6) AS Value FROM x
       UNION ALL SELECT code, CC_1, CC_2, class, 'FBW', round({_ratio('(GW3_1 + GW3_2)', '(GW_1 + GW_2)')}, 6) FROM x""",
)
def derived_pair_shares(spark, d):
    return rounded(typology.derived_shares(typology.classify(dyads(spark, d))))


def _dist_sql():
    def share(s):
        return _smax(f"({_ratio(f'Area{s}_1', 'Area_1')})", f"({_ratio(f'Area{s}_2', 'Area_2')})")

    return f"CASE WHEN ({share('_B1')}) >= 0.3 THEN '0-10km' WHEN ({share('_B2')}) >= 0.6 * 0.5 THEN '10-100km' ELSE '100+km' END"


@query("pair_distance_classes", f"WITH {DYADS} SELECT code, CC_1, CC_2, {_dist_sql()} AS maxD FROM dyads")
def pair_distance_classes(spark, d):
    return dyads(spark, d).select("code", "CC_1", "CC_2", typology.distance_class(0.3).alias("maxD"))


@query(
    "class_cross_tab",
    f"""WITH {DYADS}, {_CLS}, t AS (SELECT class, {_dist_sql()} AS maxD, count(*) AS n FROM cls GROUP BY 1, 2)
       SELECT a.class, b.maxD, coalesce(n, 0) AS Freq FROM (SELECT unnest(['IU0', 'IU1', 'UB', 'BL', 'DA']) AS class) a CROSS JOIN (SELECT unnest(['0-10km', '10-100km', '100+km']) AS maxD) b
       LEFT JOIN t ON t.class = a.class AND t.maxD = b.maxD""",
)
def class_cross_tab(spark, d):
    c = typology.classify(dyads(spark, d)).withColumn("maxD", typology.distance_class(0.3))
    return tables.cross_tab(c, "class", typology.CLASSES, "maxD", typology.DISTANCE_CLASSES)


def _tab_sql(col, values, cls=f"WITH {DYADS}, {_CLS}"):
    return f"""{cls}, m AS (SELECT class, {col} FROM cls), t AS (SELECT class, v, count(*) AS n FROM m GROUP BY 1, 2)
       SELECT a.class, b.v, coalesce(n, 0) AS Freq FROM (SELECT unnest(['IU0', 'IU1', 'UB', 'BL', 'DA']) AS class) a CROSS JOIN (SELECT unnest({values}) AS v) b
       LEFT JOIN t ON t.class = a.class AND t.v = b.v"""


@query("class_cooperation_tab", _tab_sql("CASE WHEN (CC_1 + CC_2) % 4 = 0 THEN 'none' ELSE 'some' END AS v", "['none', 'some']"))
def class_cooperation_tab(spark, d):
    """Classes against whether the pair has an agreement (score 0 or more)."""
    score = (F.col("CC_1") + F.col("CC_2")) % 4
    c = typology.classify(dyads(spark, d)).withColumn("v", F.when(score == 0, "none").otherwise("some"))
    return tables.cross_tab(c, "class", typology.CLASSES, "v", ["none", "some"])


@query("class_river_tab", _tab_sql("CASE WHEN CC_1 % 3 = 0 AND CC_2 % 2 = 0 THEN 'river' ELSE 'land' END AS v", "['land', 'river']"))
def class_river_tab(spark, d):
    """Classes against the river flag of the pair's border."""
    c = typology.classify(dyads(spark, d)).withColumn("v", F.when((F.col("CC_1") % 3 == 0) & (F.col("CC_2") % 2 == 0), "river").otherwise("land"))
    return tables.cross_tab(c, "class", typology.CLASSES, "v", ["land", "river"])
