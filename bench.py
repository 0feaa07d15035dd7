"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose tables and cores. Every query
is run to the end into a sink that keeps nothing; one untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from kappaframe.plans.catalogue import QUERIES

HEADLINE = [
    "item_kappa", "item_metrics_pooled", "item_metrics_regime", "item_scores_long", "parsed_score_agreement",
    "distribution_loss", "best_epoch", "best_epoch_window", "best_window_rows", "epoch_pivot", "uncertain_coverage",
    "group_stats", "group_bias_pairs", "group_bias_overall", "bias_offset_scenarios", "group_split",
    "stratified_folds", "random_split", "sample_per_item", "training_table", "recode_div", "recode_8card", "recode_age",
    "selection_profile", "few_shot_large_items", "oversample", "mine_pairs", "prompt_text", "batch_infer",
    "upsert_by_id", "dedup_rows", "csv_roundtrip", "run_outputs", "cosine_topk", "sampled_topk", "reduce_by_label",
    "density_clusters", "cluster_top_tokens", "kmeans", "embed_text", "pool_tokens", "fair_thresholds", "fair_predict",
    "spell_correct", "language_score",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["batch_infer"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
