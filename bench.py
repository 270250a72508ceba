"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is built and drained (a no-op sink, so nothing is collected) ``BENCH_REPS`` times after one untimed round;
the median counts. ``BENCH_ALL=1`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rasterloom.plans import QUERIES  # noqa: E402
from rasterloom.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_area_by_zone", "medoid_composite", "annual_series", "temporal_segmentation", "fitted_series", "lt_stack", "harmonize_oli",
    "join_point_box", "join_point_polygon", "join_set_members", "join_rect_overlap", "pixel_set_stack", "unique_combos", "lookup_pixel", "lookup_kernel",
    "zonal_stats", "ens_mean", "ens_median", "ens_pct_vote", "tile_aggregate", "oob_map", "elev_band_means", "area_by_year", "zone_change",
    "classification_report", "threshold_sweep", "roc_auc", "agree_coef", "bootstrap_oob", "stratified_sample", "split_locations", "kfold",
    "slope", "resample", "flow_direction", "watershed", "polygonize", "stem_train_stump", "stem_predict", "task_ready_stream", "progress_counts",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    keys = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    times = {}
    for key in keys:
        runs = []
        for i in range(reps + 1):
            start = time.perf_counter()
            drain(QUERIES[key](spark, sf_dir))
            if i:
                runs.append(time.perf_counter() - start)
        times[key] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
