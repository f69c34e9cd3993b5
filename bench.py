"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local
threads (default 8). Every query runs once to warm up and is then timed to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from propensia.catalog import QUERIES  # noqa: E402
from propensia.session import get_session  # noqa: E402

HEADLINE = (
    "build_dataset_final", "clean_train_set", "src_parquet_scan", "stream_ingest_files",
    "join_left_chain", "join_duplicate_rows", "join_key_overlap", "agg_balance", "agg_rfm", "agg_cardinality", "agg_crosstab_margins",
    "agg_quantiles_disc", "agg_quantiles_approx", "agg_boxplot_by_class", "agg_histogram", "win_first_per_key", "win_latest_snapshot",
    "win_rank_average_ties", "fit_iqr_bounds", "prune_flags_lift", "corr_pairs_ranked", "assoc_cramers_v", "profile_outliers",
    "eval_weighted_metrics", "eval_roc_auc", "eval_threshold_grid", "ml_random_forest", "ml_batch_score", "resample_tomek_links", "resample_smotenc",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in wanted:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
