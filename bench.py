"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from inkwell.plans.registry import QUERIES
from inkwell.session import local_session

HEADLINE = [
    "student_page_profile", "robust_z_cells", "tool_calibration", "sample_weights", "word_gaps", "gap_islands", "conf_slope", "midrank_fusion",
    "auroc", "average_precision", "sens_at_spec", "threshold_search", "alpha_sweep", "spearman_matrix", "clean_text", "vector_pool", "balanced_folds", "logistic_oof", "nested_cv", "forest_oof",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
