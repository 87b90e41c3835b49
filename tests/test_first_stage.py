"""The first stage is computed once, and a task holds no more of a unit than its numbers."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import sweeps, trends


def panel(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{u % 4}", int(u), float(x), float(2 * x + u + e), int(x > 5)) for u in range(12) for x, e in zip(rng.uniform(0, 10, 40), rng.normal(size=40))]
    wells = spark.createDataFrame(rows, "aq string, cc int, x double, y double, riv int")
    units = wells.groupBy("aq", "cc").agg((F.col("cc") % 2 == 0).alias("TB"), F.avg("x").alias("c1"))
    return wells, units


@pytest.mark.parametrize("robust", [False, True])
def test_the_second_stage_reads_a_written_table(spark, monkeypatch, robust):
    seen, matched = [], sweeps.matched_units
    monkeypatch.setattr(sweeps, "matched_units", lambda u, *a, **k: (seen.append(u), matched(u, *a, **k))[1])
    wells, units = panel(spark)
    spec = sweeps.Spec(covs=("c1",), robust=robust, islands=(), drop_river_rows=True, method=None, n_min=5)
    out = sweeps.run_spec(wells, units, spec, "aq", "cc", "y", "x", river="riv")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and not re.search("Join|Aggregate|Exchange|Python|Pandas", plan)
    assert {(r.outcome, r.term) for r in out.collect()} == {(o, t) for o in (0, 1) for t in ("(Intercept)", "TB")}


def test_statistics_of_a_unit_are_not_repeated_on_its_rows(spark):
    wells, _ = panel(spark)
    wells = wells.unionByName(wells.where("cc = 1").withColumns({"cc": F.lit(None).cast("int"), "aq": F.lit(None).cast("string")}))
    fit = trends.huber_trends(wells, ["aq", "cc"], "y", "x")
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    big = {(r.aq, r.cc): r for r in trends.huber_trends(wells, ["aq", "cc"], "y", "x", block_rows=1).collect()}
    got = {(r.aq, r.cc): r for r in fit.collect()}
    assert len(got) == 13 and set(got) == set(big)
    for k, r in got.items():
        assert (r.n, r.beta_1, r.se_1) == pytest.approx((big[k].n, big[k].beta_1, big[k].se_1), rel=1e-6)
    assert got[None, None].beta_1 == pytest.approx(got["a1", 1].beta_1, rel=1e-9)
