"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default: all) the local cores.
Each query runs to a sink that keeps nothing; the first query warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import REGISTRY  # noqa: E402
from scorekit.session import local_session  # noqa: E402

HEADLINE = [
    "convert_to_numeric",
    "cap_outliers",
    "sentinel_median",
    "narrow_types",
    "code_map_education",
    "label_encode",
    "cross_features",
    "nunique_1",
    "count_cross",
    "share_feature",
    "feature_table",
    "bins_quantile",
    "psi_by_feature",
    "iv",
    "vif",
    "ranking_metrics",
    "topn_report",
    "threshold_report",
    "score_bands",
    "prob_to_score",
    "loss_focal_a",
    "weighted_blend",
    "cv_scores_a",
    "newton_boost",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    _run(spark, sf_dir, "kfold")
    seconds = {name: _run(spark, sf_dir, name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cores,
                # One-file test tables are dealt over the cores before they are read on; see sources/tables.py.
                "spread_over_cores": True,
            }
        )
    )
    spark.stop()


def _run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


if __name__ == "__main__":
    main()
