"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (median of,
default 1), BENCH_ONLY (comma-separated names).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans import QUERIES  # noqa: E402
from panelweave.session import get_session  # noqa: E402

HEADLINE = [
    "unit_trend_ols",
    "unit_trend_tests",
    "weighted_unit_trend",
    "covariate_unit_trend",
    "huber_unit_trend",
    "trend_by_decluster_radius",
    "pooled_meta_regression",
    "min_rows_sweep",
    "leave_one_country_out",
    "country_fixed_effects",
    "matched_second_stage",
    "nearest_matching_pairs",
    "control_set_sweep",
    "points_in_polygons",
    "nearest_border_distance",
    "lookalike_candidates",
    "best_lookalikes",
    "neighbour_counts",
    "decluster_weights",
    "overlay_split",
    "shared_borders",
    "overlapping_pairs",
    "random_independent_sets",
    "percentile_curves",
    "concentration_by_mask",
    "exact_group_quantiles",
    "winsorised",
    "density_grid",
    "class_variants",
    "class_cross_tab",
    "two_tier_top_k",
    "rows_at_maximum",
    "flagged_group_exclusion",
    "metric_star",
    "full_join_chain",
    "mixed_summary",
    "binned_means",
    "cumulative_shares",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm the JVM
    times: dict[str, float] = {}
    for n in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(took), 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "panel_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
