"""Sweeps as they are used: matched again for every spec, both outcomes pooled."""

from functools import reduce

from pyspark.sql import functions as F

from panelweave.operators import cells, independent, pooling, spatial, sweeps
from panelweave.operators.prefix import attach_group
from panelweave.operators.tables import valid_units
from panelweave.operators.trends import unit_trends
from panelweave.plans.pooling_queries import COVS, panel
from panelweave.plans.registry import query
from panelweave.plans.standins import units, wells
from panelweave.session import cut_lineage


@query("min_rows_sweep_matched")
def min_rows_sweep_matched(spark, d):
    """Every minimum-row cut matched anew, both outcomes."""
    return sweeps.second_stage(sweeps.by_min_rows(panel(spark, d)), ["n_min"], "unit_id", "cc", "TB", COVS)


@query("leave_one_country_out_matched")
def leave_one_country_out_matched(spark, d):
    """Matched and pooled without each country in turn; change against the fit on all."""
    p = panel(spark, d, 20)
    every = sweeps.leave_one_group_out(p, "cc", "TB").unionByName(p.withColumn("drop", F.lit(-1)))
    fit = cut_lineage(sweeps.second_stage(every, ["drop"], "unit_id", "cc", "TB", COVS).where(F.col("term") == "TB"))
    return sweeps.influence(fit.where("drop <> -1"), fit.where("drop = -1"))


@query("leave_k_out_matched")
def leave_k_out_matched(spark, d):
    """Draws of 1 to 9 treated rows, matched and pooled without the drawn names."""
    u = cut_lineage(sweeps.leave_k_out(panel(spark, d, 20), "aquifer", "unit_id", "TB", list(range(1, 10)), draws=4))
    return sweeps.second_stage(u, ["k", "iter", "left_out"], "unit_id", "cc", "TB", COVS)


@query("radius_pooled_effects")
def radius_pooled_effects(spark, d):
    """Declustered first stages at all radii and one pooled fit for each, both outcomes."""
    k = ["aquifer", "cc", "dclust"]
    w = wells(spark, d).select("aquifer", "cc", "x", "y", "px", "py")
    w = spatial.decluster_by_radius(w, ["aquifer", "cc"], [r / 10 for r in sweeps.RADII_KM], x="px", y="py")
    t = unit_trends(w, k, "y", "x", "w", p_values=False).select(*k, "n", "beta_0", "se_0", "beta_1", "se_1")
    u = cut_lineage(valid_units(attach_group(t, units(spark, d), ["aquifer", "cc"]), 20))
    u = u.withColumn("unit_id", F.concat_ws("_", "aquifer", F.col("cc").cast("string")))
    return sweeps.pooled_effects(sweeps.matched_units(u, ["dclust"], "unit_id", "TB", COVS, None), ["dclust"], "cc", "TB")


@query("robust_second_stage")
def robust_second_stage(spark, d):
    """Huber first stage, full matching, pooled effects."""
    spec = sweeps.Spec(label="robust", covs=tuple(COVS), robust=True, islands=())
    return sweeps.run_spec(wells(spark, d), units(spark, d), spec, "aquifer", "cc", "y", "x")


@query("river_option_run")
def river_option_run(spark, d):
    """Rows along rivers dropped, nearest matching at two to one, variances not divided by weights."""
    spec = sweeps.Spec(label="river", covs=tuple(COVS), method="nearest", ratio=2, drop_river_rows=True, weight_variance=False, islands=())
    return sweeps.run_spec(wells(spark, d), units(spark, d), spec, "aquifer", "cc", "y", "x")


def _control_sets(spark, d):
    """Panel and random non-overlapping control sets: controls in one map cell overlap."""
    p = panel(spark, d, 20)
    at = p.where(~F.col("TB")).select("unit_id", F.floor(F.col("lon_c") * 2).alias("cx"), F.floor(F.col("lat_c") * 2).alias("cy"))
    at = cut_lineage(at)
    samples = spark.range(1, 6).withColumnRenamed("id", "sample_id")
    sets = independent.random_independent_sets(at.select("unit_id"), cells.overlap_edges(at, "unit_id"), "unit_id", samples, seed=3)
    return p, cut_lineage(sets)


def _outcomes(spark, d, regressors=None):
    p, sets = _control_sets(spark, d)
    runs = [sweeps.control_set_sweep(p, sets, "unit_id", "cc", "TB", y, COVS, regressors, label=y) for y in ("beta_0", "beta_1")]
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), runs))


@query("control_set_outcomes")
def control_set_outcomes(spark, d):
    """Every outcome on every control set, failed runs with their reason."""
    return _outcomes(spark, d)


@query("control_set_counts")
def control_set_counts(spark, d):
    """Runs by outcome and significance, and the best balanced run of each outcome."""
    runs = _outcomes(spark, d)
    best = sweeps.ranked_runs(runs).groupBy("label").agg(F.min_by("sample_id", F.struct("mean_smd", "sample_id")).alias("best_sample"))
    counts = runs.groupBy("label", "status", "sig_cat").agg(F.count(F.lit(1)).alias("runs"))
    return counts.join(best, "label", "left")


@query("double_robust_sets")
def double_robust_sets(spark, d):
    """Covariates in the outcome model as well as in the match."""
    return _outcomes(spark, d, COVS[:2])


@query("single_control_set")
def single_control_set(spark, d):
    """One set of all controls, and a spec that cannot be estimated next to it."""
    p = panel(spark, d, 20)
    one = p.where(~F.col("TB")).select(F.lit(1).alias("sample_id"), "unit_id")
    none = p.where(~F.col("TB")).groupBy(F.lit(2).alias("sample_id")).agg(F.min("unit_id").alias("unit_id"))
    return sweeps.control_set_sweep(p, one.unionByName(none), "unit_id", "cc", "TB", "beta_1", COVS, label="all controls")


@query("named_term_per_spec")
def named_term_per_spec(spark, d):
    """The flag's coefficient for every spec asked for, NULL where a fit has none."""
    u = sweeps.matched_units(panel(spark, d), [], "unit_id", "TB", COVS, None)
    fits = sweeps.pooled_effects(u, [], "cc", "TB")
    asked = spark.range(3).select(F.col("id").cast("int").alias("outcome"))
    return pooling.one_term(fits, asked, ["outcome"], "TB")
