"""Matching, balance, pooled models and sweeps on the unit trends."""

from pyspark.sql import functions as F

from panelweave.operators import matching, pooling, sweeps
from panelweave.operators.prefix import attach_group
from panelweave.operators.tables import valid_units
from panelweave.operators.trends import unit_trends
from panelweave.plans.registry import query, rounded, table
from panelweave.plans.standins import TRENDS, UNITS, WELLS, units, wells
from panelweave.session import cut_lineage

COVS = ["lat_c", "lon_c", "urbkHaKm2", "CS_max"]


def panel(spark, d, n_min=0):
    """Unit estimates with descriptors, valid ones only, written once."""
    t = unit_trends(wells(spark, d), ["aquifer", "cc"], "y", "x", p_values=False).select("aquifer", "cc", "n", "beta_0", "se_0", "beta_1", "se_1")
    u = attach_group(t, units(spark, d), ["aquifer", "cc"])
    u = valid_units(u, n_min).withColumn("unit_id", F.concat_ws("_", "aquifer", F.col("cc").cast("string")))
    return cut_lineage(u)


_PANEL = f"""{WELLS}, {TRENDS}, {UNITS}, panel AS MATERIALIZED (SELECT t.*, TB, nW, lat_c, lon_c, urbkHaKm2, CS_max, t.aquifer || '_' || t.cc AS unit_id
  FROM trends t JOIN units u ON t.aquifer = u.aquifer AND t.cc = u.cc WHERE n > 0 AND beta_1 IS NOT NULL AND se_0 > 0 AND se_1 > 0)"""


def _meta_sql(src: str, keys: str, reml: bool = True) -> str:
    """REML (or ML) of the two-term model on a zooming grid, from `src` (keys, g, y, v, x)."""
    k = f"{keys}, "
    dev = """sum(slv + ln(1 + t * s0)) + ln(A00 * A11 - A01 * A01) + q - (b0 * (A11 * b0 - A01 * b1) + b1 * (A00 * b1 - A01 * b0)) / (A00 * A11 - A01 * A01)"""
    if not reml:
        dev = dev.replace("+ ln(A00 * A11 - A01 * A01) ", "")
    sums = """sum(s0 - t / (1 + t * s0) * s0 * s0) AS A00, sum(sx - t / (1 + t * s0) * s0 * sx) AS A01, sum(sxx - t / (1 + t * s0) * sx * sx) AS A11,
      sum(sy - t / (1 + t * s0) * s0 * sy) AS b0, sum(sxy - t / (1 + t * s0) * sx * sy) AS b1, sum(syy - t / (1 + t * s0) * sy * sy) AS q, sum(slv + ln(1 + t * s0)) AS ld"""
    out = [
        f"""mom AS MATERIALIZED (SELECT {k}g, count(*) AS n, sum(1 / v) AS s0, sum(x / v) AS sx, sum(x * x / v) AS sxx, sum(y / v) AS sy, sum(x * y / v) AS sxy, sum(y * y / v) AS syy, sum(ln(v)) AS slv FROM {src} GROUP BY {k}g)""",
        f"""sp AS (SELECT {k}sum(syy) / sum(s0) - pow(sum(sy) / sum(s0), 2) AS spread FROM mom GROUP BY {keys})""",
        f"""g0 AS (SELECT {k}0.0 AS t, 0.0 AS lo, spread * pow(2.0, -30) AS hi FROM sp UNION ALL SELECT {k}spread * pow(2.0, i), CASE WHEN i = -30 THEN 0.0 ELSE spread * pow(2.0, i - 1) END,
          spread * pow(2.0, least(i + 1, 12)) FROM sp, (SELECT unnest(range(-30, 13)) AS i))""",
    ]
    levels = 9
    for i in range(levels + 1):
        out.append(f"s{i} AS (SELECT {', '.join('g.' + c.strip() for c in keys.split(','))}, t, any_value(lo) AS lo, any_value(hi) AS hi, {sums} FROM g{i} g JOIN mom USING ({keys}) GROUP BY {', '.join('g.' + c.strip() for c in keys.split(','))}, t)")
        d = dev.replace("sum(slv + ln(1 + t * s0))", "ld")
        out.append(f"b{i} AS MATERIALIZED (SELECT {k}arg_min(t, {d}) AS t, arg_min(lo, {d}) AS lo, arg_min(hi, {d}) AS hi FROM s{i} GROUP BY {keys})")
        if i < levels:
            out.append(
                f"""g{i + 1} AS (SELECT {k}b.lo + (b.hi - b.lo) * i / 24 AS t, b.lo + (b.hi - b.lo) * greatest(i - 1, 0) / 24 AS lo, b.lo + (b.hi - b.lo) * least(i + 1, 24) / 24 AS hi FROM b{i} b, (SELECT unnest(range(25)) AS i))"""
            )
    out.append(
        f"""fit AS (SELECT {k}s.t AS tau2, (A11 * b0 - A01 * b1) / (A00 * A11 - A01 * A01) AS e0, sqrt(A11 / (A00 * A11 - A01 * A01)) AS se0, (A00 * b1 - A01 * b0) / (A00 * A11 - A01 * A01) AS e1,
          sqrt(A00 / (A00 * A11 - A01 * A01)) AS se1 FROM s{levels} s JOIN b{levels} b USING ({keys}) WHERE s.t = b.t)"""
    )
    return ",\n".join(out)


_TWO = """two AS (SELECT *, 0 AS outcome, beta_0 AS y, v0 AS v FROM w UNION ALL SELECT *, 1, beta_1, v1 FROM w), src AS (SELECT *, cc AS g, CAST(TB AS DOUBLE) AS x FROM two)"""
_WINS = """q AS (SELECT quantile_cont(se_0 * se_0, 0.01) AS a0, quantile_cont(se_0 * se_0, 0.99) AS z0, quantile_cont(se_1 * se_1, 0.01) AS a1, quantile_cont(se_1 * se_1, 0.99) AS z1 FROM panel),
  w AS (SELECT panel.*, least(greatest(se_0 * se_0, a0), z0) AS v0, least(greatest(se_1 * se_1, a1), z1) AS v1 FROM panel, q)"""
_TERMS = """SELECT {keys}, term, round(CASE WHEN term = 'TB' THEN e1 ELSE e0 END, 3) + 0.0 AS estimate, round(CASE WHEN term = 'TB' THEN se1 ELSE se0 END, 3) AS se FROM fit, (SELECT unnest(['(Intercept)', 'TB']) AS term)"""


def _terms(df, *keys):
    return rounded(df.select(*keys, "term", "estimate", "se"), 3)


# ---- pooled models ----------------------------------------------------------------------


@query("pooled_meta_regression", f"WITH {_PANEL}, {_WINS}, {_TWO}, {_meta_sql('src', 'outcome')} {_TERMS.format(keys='outcome').replace(', 3)', ', 2)')}")
def pooled_meta_regression(spark, d):
    """All units with weight one: the unmatched second stage."""
    u = sweeps.matched_units(panel(spark, d), [], "unit_id", "TB", COVS, None)
    s = matching.sampling_variances(u, [])
    both = F.array(*[F.struct(F.lit(i).alias("outcome"), F.col(f"beta_{i}").alias("yi"), F.col(f"vi_{i}").alias("vi")) for i in (0, 1)])
    fit = pooling.meta_regression(s.select("cc", "TB", F.inline(both)), ["outcome"], "cc", "yi", "vi", "TB", p_values=False)
    return rounded(fit.select("outcome", "term", "estimate", "se"), 2)


@query(
    "min_rows_sweep",
    f"""WITH {_PANEL}, cuts AS (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90, 100]) AS n_min), p2 AS (SELECT panel.*, n_min FROM panel JOIN cuts ON n > n_min),
        q AS (SELECT n_min, quantile_cont(se_1 * se_1, 0.01) AS a1, quantile_cont(se_1 * se_1, 0.99) AS z1 FROM p2 GROUP BY 1),
        src AS (SELECT p2.n_min, cc AS g, CAST(TB AS DOUBLE) AS x, beta_1 AS y, least(greatest(se_1 * se_1, a1), z1) AS v FROM p2 JOIN q ON p2.n_min = q.n_min), {_meta_sql('src', 'n_min')} {_TERMS.format(keys='n_min')}""",
)
def min_rows_sweep(spark, d):
    u = sweeps.by_min_rows(panel(spark, d))
    s = matching.sampling_variances(u, ["n_min"], None)
    return _terms(pooling.meta_regression(s, ["n_min"], "cc", "beta_1", "vi_1", "TB", p_values=False), "n_min")


_LOCO = f"""{_PANEL}, arms AS (SELECT cc AS dropped FROM panel GROUP BY 1 HAVING bool_or(TB) AND bool_or(NOT TB)), p2 AS (SELECT panel.*, dropped FROM panel JOIN arms ON cc <> dropped UNION ALL SELECT panel.*, -1 FROM panel),
        q AS (SELECT dropped, quantile_cont(se_1 * se_1, 0.01) AS a1, quantile_cont(se_1 * se_1, 0.99) AS z1 FROM p2 GROUP BY 1),
        src AS (SELECT p2.dropped, cc AS g, CAST(TB AS DOUBLE) AS x, beta_1 AS y, least(greatest(se_1 * se_1, a1), z1) AS v FROM p2 JOIN q ON p2.dropped = q.dropped)"""


@query(
    "leave_one_country_out",
    f"""WITH {_LOCO}, {_meta_sql('src', 'dropped')} SELECT f.dropped AS "drop", round(f.e1, 3) + 0.0 AS estimate, round(f.e1 - b.e1, 3) + 0.0 AS delta_b, round((f.e1 - b.e1) / b.se1, 3) + 0.0 AS infl_std
       FROM fit f, fit b WHERE b.dropped = -1 AND f.dropped <> -1""",
)
def leave_one_country_out(spark, d):
    p = panel(spark, d)
    out = sweeps.leave_one_group_out(p, "cc", "TB").unionByName(p.withColumn("drop", F.lit(-1)))
    s = matching.sampling_variances(out, ["drop"], None)
    fit = pooling.meta_regression(s, ["drop"], "cc", "beta_1", "vi_1", "TB").where(F.col("term") == "TB").withColumn("outcome", F.lit(1))
    fit = cut_lineage(fit)
    got = sweeps.influence(fit.where(F.col("drop") != -1), fit.where(F.col("drop") == -1))
    return rounded(got.select("drop", "estimate", "delta_b", "infl_std"), 3)


@query(
    "maximum_likelihood_fit",
    f"""WITH {_PANEL}, {_WINS}, src AS (SELECT 1 AS outcome, cc AS g, CAST(TB AS DOUBLE) AS x, beta_1 AS y, v1 AS v FROM w), {_meta_sql('src', 'outcome', False)}
       SELECT outcome, term, round(CASE WHEN term = 'TB' THEN e1 ELSE e0 END, 3) + 0.0 AS estimate, round(CASE WHEN term = 'TB' THEN se1 ELSE se0 END, 3) AS se,
         (SELECT count(*) FROM src) AS n, (SELECT count(DISTINCT g) FROM src) AS k_cluster FROM fit, (SELECT unnest(['(Intercept)', 'TB']) AS term)""",
)
def maximum_likelihood_fit(spark, d):
    s = matching.sampling_variances(panel(spark, d), [], None).withColumn("outcome", F.lit(1))
    fit = pooling.meta_regression(s, ["outcome"], "cc", "beta_1", "vi_1", "TB", method="ML", p_values=False)
    return rounded(fit.select("outcome", "term", "estimate", "se", "n", "k_cluster"), 3)


def _fe_sql() -> str:
    out = [
        "sp AS (SELECT var_pop(y) AS spread FROM src)",
        "g0 AS (SELECT 0.0 AS t, 0.0 AS lo, spread * pow(2.0, -24) AS hi FROM sp UNION ALL SELECT spread * pow(2.0, i), CASE WHEN i = -24 THEN 0.0 ELSE spread * pow(2.0, i - 1) END, spread * pow(2.0, least(i + 1, 8)) FROM sp, (SELECT unnest(range(-24, 9)) AS i))",
    ]
    for i in range(5):
        out.append(f"""p{i} AS (SELECT t, any_value(lo) AS lo, any_value(hi) AS hi, g, sum(1 / (v + t)) AS w, sum(x / (v + t)) AS wx, sum(y / (v + t)) AS wy, sum(x * x / (v + t)) AS wxx, sum(x * y / (v + t)) AS wxy, sum(y * y / (v + t)) AS wyy, sum(-ln(v + t)) AS lw FROM g{i}, src GROUP BY t, g)""")
        out.append(f"t{i} AS (SELECT t, any_value(lo) AS lo, any_value(hi) AS hi, sum(wxx - wx * wx / w) AS s, sum(wxy - wx * wy / w) AS c, sum(wyy - wy * wy / w) AS q, sum(lw) AS lw, sum(ln(w)) AS lg FROM p{i} GROUP BY t)")
        out.append(f"b{i} AS MATERIALIZED (SELECT arg_min(t, d) AS t, arg_min(lo, d) AS lo, arg_min(hi, d) AS hi, arg_min(c, d) AS c, arg_min(s, d) AS s FROM (SELECT *, -lw + lg + ln(s) + q - c * c / s AS d FROM t{i}))")
        if i < 4:
            out.append(f"g{i + 1} AS (SELECT b.lo + (b.hi - b.lo) * i / 64 AS t, b.lo + (b.hi - b.lo) * greatest(i - 1, 0) / 64 AS lo, b.lo + (b.hi - b.lo) * least(i + 1, 64) / 64 AS hi FROM b{i} b, (SELECT unnest(range(65)) AS i))")
    return ",\n".join(out)


@query(
    "country_fixed_effects",
    f"WITH {_PANEL}, {_WINS}, src AS (SELECT cc AS g, CAST(TB AS DOUBLE) AS x, beta_1 AS y, v1 AS v FROM w), {_fe_sql()} SELECT 1 AS outcome, 'TB' AS term, round(c / s, 3) + 0.0 AS estimate, round(1 / sqrt(s), 3) AS se FROM b4",
)
def country_fixed_effects(spark, d):
    s = matching.sampling_variances(panel(spark, d), [], None).withColumn("outcome", F.lit(1))
    return _terms(pooling.fixed_effects(s, ["outcome"], "cc", "beta_1", "vi_1", "TB", p_values=False), "outcome")


@query("cluster_robust_errors")
def cluster_robust_errors(spark, d):
    u = sweeps.matched_units(panel(spark, d), [], "unit_id", "TB", COVS, None)
    return sweeps.pooled_effects(u, [], "cc", "TB", model="robust")


@query("weighted_mixed_model")
def weighted_mixed_model(spark, d):
    """Per brand: price level on the TB flag with a nation intercept, weights n."""
    u = panel(spark, d).withColumn("type", F.col("TB").cast("double")).withColumn("weights", F.col("n").cast("double"))
    return pooling.mixed_model(u, ["aquifer"], "cc", "beta_0", ["type"])


# ---- matching ---------------------------------------------------------------------------


@query(
    "propensity_score_equations",
    f"""WITH {_PANEL} SELECT term, CAST(0.0 AS DOUBLE) AS residual, (SELECT count(*) FROM panel) AS n FROM (SELECT unnest(['1', 'lat_c', 'lon_c', 'urbkHaKm2', 'CS_max']) AS term)""",
)
def propensity_score_equations(spark, d):
    """At the optimum the residuals are orthogonal to every term (relative to the term's size)."""
    s = matching.propensity(panel(spark, d), [], "TB", COVS)
    r = F.col("TB").cast("double") - F.col("score")
    z = {"1": F.lit(1.0), **{c: F.col(c) for c in COVS}}
    rows = F.array(*[F.struct(F.lit(k).alias("term"), (F.abs(F.col(f"r_{k}")) / F.col(f"s_{k}")).alias("residual")) for k in z])
    g = s.agg(F.count("score").alias("n"), *[F.sum(r * c).alias(f"r_{k}") for k, c in z.items()], *[F.sum(F.abs(c)).alias(f"s_{k}") for k, c in z.items()])
    return rounded(g.select(F.inline(rows), "n"), 6)


@query("propensity_scores")
def propensity_scores(spark, d):
    return matching.propensity(panel(spark, d), [], "TB", COVS).select("unit_id", "TB", "score")


def _full(spark, d):
    return cut_lineage(sweeps.matched_units(panel(spark, d), [], "unit_id", "TB", COVS, "full"))


@query("full_matching_sets")
def full_matching_sets(spark, d):
    return _full(spark, d).select("unit_id", "TB", "score", "set_id", "weights")


@query(
    "full_matching_check",
    f"""WITH {_PANEL} SELECT count(*) AS matched_units, count(*) FILTER (NOT TB) AS control_weight, CAST(0 AS BIGINT) AS malformed_sets FROM panel""",
)
def full_matching_check(spark, d):
    """Nobody is discarded, control weights sum to the controls, sets are 1:k or k:1."""
    m = _full(spark, d)
    sets = m.groupBy("set_id").agg(F.count_if("TB").alias("t"), F.count_if(~F.col("TB")).alias("c"), F.count(F.lit(1)).alias("k"), F.sum(F.when(~F.col("TB"), F.col("weights"))).alias("w"))
    return sets.agg(
        F.sum("k").alias("matched_units"), F.round(F.sum("w")).cast("bigint").alias("control_weight"), F.count_if(F.least("t", "c") != 1).alias("malformed_sets")
    )


@query("nearest_matching_pairs")
def nearest_matching_pairs(spark, d):
    """Two passes without replacement."""
    s = matching.propensity(panel(spark, d), [], "TB", COVS).withColumn("spec", F.lit(0))
    return matching.nearest_matching(s, ["spec"], "unit_id", "TB", ratio=2).select("treated", "control", "pass_no")


_SETS = """c AS (SELECT c_custkey AS id, c_nationkey AS set_no, c_mktsegment = 'BUILDING' AS t, c_acctbal AS bal, c_custkey % 5 AS country, CAST(c_custkey % 97 AS DOUBLE) AS z FROM customer),
  ps AS (SELECT set_no, count(*) FILTER (t) AS nt, count(*) FILTER (NOT t) AS nc FROM c GROUP BY 1),
  tot AS (SELECT sum(nt) FILTER (nc > 0) AS raw, sum(nc) FILTER (nt > 0) AS allc FROM ps),
  m AS (SELECT c.*, CASE WHEN t THEN 1.0 ELSE nt / nc * allc / raw END AS w FROM c JOIN ps USING (set_no), tot)"""


def _sets(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("t"), F.col("c_acctbal").alias("bal"),
        (F.col("c_custkey") % 5).alias("country"), (F.col("c_custkey") % 97).cast("double").alias("z"),
    )
    sets = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("set_id"))
    return matching.match_weights(c, sets, [], "id", "t")


@query("match_weights", f"WITH {_SETS} SELECT id, t, round(w, 8) AS weights FROM m")
def match_weights(spark, d):
    return rounded(_sets(spark, d).select("id", "t", "weights"), 8)


@query(
    "balance_table",
    f"""WITH {_SETS}, l AS (SELECT 'bal' AS covariate, t, w, bal AS x FROM m UNION ALL SELECT 'z', t, w, z FROM m)
       SELECT covariate, round((avg(x) FILTER (t) - avg(x) FILTER (NOT t)) / stddev_samp(x) FILTER (t), 6) + 0.0 AS smd_before,
       round((avg(x) FILTER (t) - sum(x * w) FILTER (NOT t) / sum(w) FILTER (NOT t)) / stddev_samp(x) FILTER (t), 6) + 0.0 AS smd_after FROM l GROUP BY 1""",
)
def balance_table(spark, d):
    m = _sets(spark, d).withColumn("spec", F.lit(0))
    return rounded(matching.balance_table(m, ["spec"], "t", ["bal", "z"]).drop("spec"))


@query(
    "matched_country_share",
    f"""WITH {_SETS}, r AS (SELECT set_no, arg_min(country, id) AS tc FROM m WHERE t GROUP BY 1)
       SELECT count(*) AS n_control, count(*) FILTER (country = tc) AS n_same, round(avg(CAST(country = tc AS DOUBLE)), 6) AS same_country_unweighted,
       round(sum(CASE WHEN country = tc THEN w ELSE 0 END) / sum(w), 6) AS same_country_weighted FROM m JOIN r USING (set_no) WHERE NOT t""",
)
def matched_country_share(spark, d):
    return rounded(matching.same_group_share(_sets(spark, d), [], "t", "country", "id"))


@query(
    "sampling_variances",
    f"WITH {_PANEL}, {_WINS} SELECT unit_id, round(v0, 2) AS vi_0, round(v1, 2) AS vi_1 FROM w",
)
def sampling_variances(spark, d):
    return rounded(matching.sampling_variances(panel(spark, d), [], None).select("unit_id", "vi_0", "vi_1"), 2)


@query("score_histogram")
def score_histogram(spark, d):
    return matching.score_histogram(_full(spark, d), [], "TB")


# ---- sweeps -----------------------------------------------------------------------------


@query("matched_second_stage")
def matched_second_stage(spark, d):
    """The preferred pipeline: full matching, winsorised variances, both outcomes pooled."""
    return sweeps.second_stage(panel(spark, d, 20), [], "unit_id", "cc", "TB", COVS)


@query("nearest_ratio_sweep")
def nearest_ratio_sweep(spark, d):
    return sweeps.ratio_sweep(panel(spark, d, 20), "unit_id", "cc", "TB", COVS, list(range(1, 11)))


@query("covariate_set_sweep")
def covariate_set_sweep(spark, d):
    return sweeps.covariate_set_sweep(panel(spark, d, 20), "unit_id", "cc", "TB", {"main": COVS, "short": COVS[:2]})


@query("leave_k_out_sweep")
def leave_k_out_sweep(spark, d):
    """All draws of 1 to 40 treated rows, refitted without the drawn names."""
    u = cut_lineage(sweeps.leave_k_out(cut_lineage(panel(spark, d, 20)), "aquifer", "unit_id", "TB", sweeps.LEAVE_OUT_SIZES))
    k = ["k", "iter", "left_out"]
    return pooling.meta_regression(matching.sampling_variances(u, k, None), k, "cc", "beta_1", "vi_1", "TB")


@query("option_record_run")
def option_record_run(spark, d):
    """One option record end to end, river groups dropped, no matching."""
    spec = sweeps.Spec(label="no_match", covs=tuple(COVS), method=None, islands=(3, 7), drop_list=("Brand#11",))
    return sweeps.run_spec(wells(spark, d), units(spark, d), spec, "aquifer", "cc", "y", "x")


@query("control_set_sweep")
def control_set_sweep(spark, d):
    """Three control sets of non-treated units: match, balance, fit, rank."""
    p = panel(spark, d, 20)
    sets = p.where(~F.col("TB")).select("unit_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("sample_id"))
    sets = sets.where(F.xxhash64("sample_id", "unit_id") % 3 != 0).select("sample_id", "unit_id")
    return sweeps.ranked_runs(sweeps.control_set_sweep(p, sets, "unit_id", "cc", "TB", "beta_0", COVS, label="beta_0"))
