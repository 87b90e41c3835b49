"""Second-stage pipelines over spec tables: one Spark job per sweep, not one per spec."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.labels import significance_band
from panelweave.functions.nulls import effective_n, strict_avg
from panelweave.operators import matching as M
from panelweave.operators import pooling as R
from panelweave.operators.prefix import attach_group, attach_single, null_safe_join
from panelweave.operators.tables import both_arms, complete_cases, drop_flagged_groups, drop_listed, top_rows, valid_units
from panelweave.operators.trends import huber_trends, unit_trends
from panelweave.session import cut_lineage

# Default covariates, nations left out as islands, minimum rows, sweep levels, draws and sizes of leaving out.
DEFAULT_COVARIATES = ["lat_c", "lon_c", "urbkHaKm2", "CS_max", "LB_river"]
ISLAND_NATIONS = ["AUS", "NZL", "TWN", "JPN", "IRL", "GBR"]
DEFAULT_N_MIN = 20
N_MIN_LEVELS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
RADII_KM = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
LEAVE_OUT_DRAWS = 250
LEAVE_OUT_SIZES = [1, 5, 10, 15, 20, 25, 30, 35, 40]


# ---- spec keys --------------------------------------------------------------------------


def by_min_rows(units: DataFrame, cuts: list[int] = N_MIN_LEVELS, n: str = "n") -> DataFrame:
    """Repeat a unit for every cut it passes (column n_min)."""
    cuts_ = F.array(*[F.lit(c) for c in cuts])
    return units.withColumn("n_min", F.explode(F.filter(cuts_, lambda c: F.col(n) > c)))


def leave_one_group_out(units: DataFrame, group: str, flag: str) -> DataFrame:
    """One copy per left-out group (drop), over the groups that hold both arms.

    The group list is one small row; each unit is repeated for the groups it is not in.
    """
    groups = both_arms(units, group, F.col(flag).cast("boolean")).agg(F.collect_set(group).alias("__gs"))
    d = attach_single(units, groups)
    return d.withColumn("drop", F.explode(F.filter("__gs", lambda g: ~g.eqNullSafe(F.col(group))))).drop("__gs")


def leave_k_out(units: DataFrame, name: str, row_id: str, flag: str, ks: list[int], draws: int = LEAVE_OUT_DRAWS, seed: int = 1) -> DataFrame:
    """Copies of the units per draw (k, iter) with the drawn names removed; `left_out` lists them.

    k treated rows are drawn in hash order, so names may repeat within a draw. The draw is
    a top-k per spec; the removal an anti join.
    """
    specs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("iter")) for k in ks for i in range(1, draws + 1)])
    treated = units.where(F.col(flag).cast("boolean")).select(name, row_id, F.explode(specs).alias("s")).select(name, row_id, "s.k", "s.iter")
    h = F.xxhash64(F.lit(seed), F.col("k"), F.col("iter"), F.col(row_id))
    drawn = top_rows(treated.withColumn("__h", h), ["k", "iter"], [F.col("__h"), F.col(row_id)], max(ks))
    drawn = (
        drawn.withColumn("__r", F.row_number().over(W.partitionBy("k", "iter").orderBy("__h", row_id)))
        .where(F.col("__r") <= F.col("k"))
        .select("k", "iter", name)
    )
    listed = drawn.groupBy("k", "iter").agg(F.array_join(F.sort_array(F.collect_list(F.col(name).cast("string"))), "; ").alias("left_out"))
    every = units.withColumn("s", F.explode(specs)).select(*units.columns, "s.k", "s.iter")
    kept = null_safe_join(every, drawn.distinct().withColumn("__x", F.lit(True)), ["k", "iter", name], "left").where(F.col("__x").isNull()).drop("__x")
    return kept.join(listed, ["k", "iter"])


# ---- the second stage -------------------------------------------------------------------


def matched_units(units: DataFrame, keys: list[str], unit: str, flag: str, covs: list[str], method: str | None = "full", ratio: int = 1) -> DataFrame:
    """Score, match and weight units; `method` is "full", "nearest" or None (weights 1)."""
    if method is None:
        return units.withColumn("weights", F.lit(1.0))
    scored = M.propensity(complete_cases(units, covs), keys, flag, covs)
    if method == "full":
        sets = M.full_matching(scored, keys, unit, flag)
    else:
        sets = M.pair_sets(M.nearest_matching(scored, keys, unit, flag, ratio=ratio), keys, unit)
    return M.match_weights(scored, sets, keys, unit, flag)


def pooled_effects(matched: DataFrame, keys: list[str], cluster: str, flag: str, divisor: str | None = "weights", model: str = "meta") -> DataFrame:
    """Both outcomes (0: mean, 1: slope) pooled in one fit; rows (keys, outcome, term, ...)."""
    d = M.sampling_variances(matched, keys, divisor)
    both = F.array(*[F.struct(F.lit(i).alias("outcome"), F.col(f"beta_{i}").alias("yi"), F.col(f"vi_{i}").alias("vi")) for i in (0, 1)])
    long = d.select(*keys, cluster, flag, F.inline(both))
    ks = [*keys, "outcome"]
    if model == "fixed":
        return R.fixed_effects(long, ks, cluster, "yi", "vi", flag)
    fit = R.meta_regression(long, ks, cluster, "yi", "vi", flag)
    return R.cluster_robust(long, ks, cluster, "yi", "vi", flag, fit) if model == "robust" else fit


def second_stage(
    units: DataFrame, keys: list[str], unit: str, cluster: str, flag: str, covs: list[str], method: str | None = "full", ratio: int = 1, model: str = "meta"
) -> DataFrame:
    m = matched_units(units, keys, unit, flag, covs, method, ratio)
    return pooled_effects(m, keys, cluster, flag, model=model)


def ratio_sweep(units: DataFrame, unit: str, cluster: str, flag: str, covs: list[str], ratios: list[int], model: str = "meta") -> DataFrame:
    """Nearest matching with every ratio: pass i serves all ratios >= i, so passes run once."""
    scored = M.propensity(complete_cases(units, covs), [], flag, covs).withColumn("__s", F.lit(0))
    pairs = M.nearest_matching(scored, ["__s"], unit, flag, ratio=max(ratios))
    rs = F.array(*[F.lit(r) for r in ratios])
    pairs = pairs.withColumn("ratio", F.explode(F.filter(rs, lambda r: r >= F.col("pass_no")))).drop("__s")
    sets = M.pair_sets(pairs, ["ratio"], unit)
    every = scored.drop("__s").withColumn("ratio", F.explode(rs))
    return pooled_effects(M.match_weights(every, sets, ["ratio"], unit, flag), ["ratio"], cluster, flag, model=model)


def covariate_set_sweep(units: DataFrame, unit: str, cluster: str, flag: str, cov_sets: dict[str, list[str]], method: str = "full") -> DataFrame:
    """One run per covariate set (the sets differ in columns, so scores are made per set)."""
    runs = [
        matched_units(units, [], unit, flag, covs, method).withColumn("cov_set", F.lit(name)) for name, covs in cov_sets.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    return pooled_effects(stacked, ["cov_set"], cluster, flag)


def influence(effects: DataFrame, baseline: DataFrame, drop: str = "drop", alpha: float = 0.1, weights: DataFrame | None = None) -> DataFrame:
    """Change against the baseline fit, in units of its standard error.

    `effects` has (drop, outcome, estimate, se, p) of the effect term; `baseline` the same
    without `drop`.
    """
    b = baseline.select("outcome", F.col("estimate").alias("base_b"), F.col("se").alias("base_se"))
    out = effects.join(b, "outcome").select(
        drop, "outcome", "estimate", "se", "p", (F.col("p") < alpha).alias("sig"), "base_b",
        (F.col("estimate") - F.col("base_b")).alias("delta_b"),
        ((F.col("estimate") - F.col("base_b")) / F.col("base_se")).alias("infl_std"),
    )
    return out.join(weights, drop, "left") if weights is not None else out


# ---- control-set sweep ------------------------------------------------------------------


def control_set_sweep(
    data: DataFrame, sets: DataFrame, unit: str, cluster: str, arm: str, outcome: str, covs: list[str], regressors: list[str] | None = None, label: str = "label"
) -> DataFrame:
    """Match and fit once per control set; one ranked row per set (smallest mean SMD first).

    `data` holds treated and control units (`arm` boolean); `sets` is (sample_id, unit).
    Every step is grouped by sample, so all sets run as one job. Sets that cannot be
    estimated come out with status "failed" and NULL figures.
    """
    regressors = list(regressors or [])
    cols = list(dict.fromkeys([unit, cluster, arm, outcome, *covs, *regressors]))
    d = complete_cases(data.select(*cols), cols)
    ids = sets.select("sample_id").distinct()
    samples = ids.agg(F.collect_set("sample_id").alias("__ids"))  # sample numbers only
    treated = attach_single(d.where(F.col(arm)), samples).withColumn("sample_id", F.explode("__ids")).drop("__ids")
    controls = d.where(~F.col(arm)).join(sets.select("sample_id", unit), unit)
    work = treated.unionByName(controls)
    key = ["sample_id"]
    scored = cut_lineage(M.propensity(work, key, arm, covs))
    matched = cut_lineage(M.match_weights(scored, M.full_matching(scored, key, unit, arm), key, unit, arm))
    smd = M.balance(matched, key, arm, ["score", *covs]).groupBy(*key).agg(F.avg(F.abs("smd")).alias("mean_smd"), F.max(F.abs("smd")).alias("max_smd"))
    w = lambda c: F.when(c, F.col("weights"))
    size = matched.groupBy(*key).agg(
        F.count_if(F.col(arm)).alias("n_treat"), F.count_if(~F.col(arm)).alias("n_control"), F.count(F.lit(1)).alias("n_total"),
        (effective_n(w(~F.col(arm))) / effective_n(w(F.col(arm)))).alias("ess_ratio"),
    )
    same = M.same_group_share(matched, key, arm, cluster, unit).select(*key, "same_country_unweighted", "same_country_weighted")
    matched = matched.withColumn("type", F.col(arm).cast("double"))
    fit = R.mixed_model(matched, key, cluster, outcome, ["type", *regressors])
    pick = lambda t, p: fit.where(F.col("term") == t).select(*key, F.col("estimate").alias(f"{p}_eff"), F.col("se").alias(f"{p}_se"), F.col("p").alias(f"{p}_p"))
    why = fit.groupBy(*key).agg(F.max("status").alias("status"), F.max("error").alias("error"))
    scores = scored.groupBy(*key).agg(F.bool_and("score_converged").alias("score_converged"))
    out = ids.withColumn("label", F.lit(label))
    for part in (scores, smd, size, same, pick("type", "treat"), pick("(Intercept)", "int"), why):
        out = null_safe_join(out, part, key, "left")
    ok = F.col("mean_smd").isNotNull() & F.col("max_smd").isNotNull() & F.col("ess_ratio").isNotNull()
    out = out.withColumn("status", F.when(ok & F.col("treat_eff").isNotNull(), "ok").otherwise("failed"))
    return out.withColumn("sig_cat", significance_band("treat_p")).withColumn("sig_cat_int", significance_band("int_p"))


def ranked_runs(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("status") == "ok").orderBy("mean_smd", "sample_id")


# ---- one record for all options ---------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """Options of one full run, first stage to pooled effects."""

    label: str = "main"
    covs: tuple[str, ...] = tuple(DEFAULT_COVARIATES)
    robust: bool = False
    method: str | None = "full"
    ratio: int = 1
    n_min: int = DEFAULT_N_MIN
    weight_variance: bool = True
    leave_out: tuple = ()
    drop_list: tuple = ()
    drop_river_rows: bool = False
    drop_river_groups: bool = False
    shapes: tuple = ()
    islands: tuple = tuple(ISLAND_NATIONS)
    model: str = "meta"
    extra: dict = field(default_factory=dict)


def run_spec(wells: DataFrame, units: DataFrame, spec: Spec, aquifer: str, country: str, y: str, x: str, river: str = "LB_river", flag: str = "TB") -> DataFrame:
    """Wells and unit descriptors to pooled effects under one set of options."""
    w = drop_listed(wells, country, spec.islands) if spec.islands else wells
    if spec.drop_river_rows:
        w = w.where(~F.col(river).cast("boolean"))
    if spec.drop_river_groups:
        w = drop_flagged_groups(w, [aquifer], F.col(river).cast("boolean"))
    keys = [aquifer, country]
    w = cut_lineage(w.select(*dict.fromkeys([*keys, y, x, river])))  # the first stage reads its rows many times
    first = huber_trends(w, keys, y, x) if spec.robust else unit_trends(w, keys, y, x)
    share = w.groupBy(*keys).agg(strict_avg(F.col(river).cast("double")).alias(river))
    u = attach_group(attach_group(first, units, keys), share, keys)
    u = valid_units(u, spec.n_min, flag)
    u = complete_cases(u, list(spec.covs))
    if spec.shapes:
        u = u.where(F.col("shape").isin(list(spec.shapes)))
    for gone in (spec.leave_out, spec.drop_list):
        if gone:
            u = drop_listed(u, aquifer, gone)
    u = u.withColumn("unit_id", F.concat_ws("_", F.col(aquifer).cast("string"), F.col(country).cast("string")))
    u = cut_lineage(u)  # else every pass of the second stage repeats the first
    m = matched_units(u, [], "unit_id", flag, list(spec.covs), spec.method, spec.ratio)
    out = pooled_effects(m, [], country, flag, "weights" if spec.weight_variance else None, spec.model)
    return out.withColumn("label", F.lit(spec.label))
