"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
``python bench.py all`` times every registered query and lists them on stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

from signalframe.plans import QUERIES
from signalframe.session import build_session

HEADLINE = [
    "flagship_band_energy_by_split",
    "layout_to_signals",
    "windows_tail_drop",
    "windows_tail_keep",
    "segments_run_length",
    "segments_windows",
    "join_interval_label",
    "join_epochs",
    "normalize_zscore_add",
    "normalize_recording_scope",
    "labels_multi_hot_codes",
    "labels_priority_superclass",
    "channels_align_montage",
    "split_records_by_subject",
    "split_ratio_ceil",
    "rank_cap_rest_class",
    "rank_weighted_sample",
    "rank_best_epoch",
    "rank_pareto_front",
    "stats_per_file_and_total",
    "wavelet_dwt_bior_reflect",
    "spectral_band_filter",
    "mask_importance",
    "corrupt_saturation_dropout",
    "filters_preprocess_chain",
    "filters_polyphase_resample",
    "spatial_apply_operator",
    "spatial_surface_laplacian_invariance",
    "pairs_correlation_shrunk",
    "pairs_wpli_debiased",
    "metrics_multilabel",
    "metrics_auroc_ovo",
    "results_paired_delta",
    "results_stale_runs",
]


def run(spark, name, sf_dir) -> float:
    start = time.perf_counter()
    QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "layout_to_signals", sf_dir)
    names = list(QUERIES) if "all" in sys.argv[1:] else HEADLINE
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf_dir), 3)
        if "all" in sys.argv[1:]:
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
