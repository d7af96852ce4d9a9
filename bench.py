"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated, optional).
Every query writes its whole result to the no-op sink, so nothing is pruned and nothing is collected.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketlake.plans.catalog import QUERIES
from ticketlake.session import build_session

HEADLINE = [
    "daily_total", "daily_by_category", "daily_sentiment", "retrieval_daily", "category_counts", "class_weights_per_row",
    "volume_spikes", "category_spikes", "sentiment_shift", "retrieval_failure", "anomaly_scan", "anomaly_scan_defaults",
    "densify_daily", "schema_violations", "dq_checks", "split_profile", "text_concat_train", "text_concat_compact",
    "text_concat_separated", "text_concat_normalized", "content_fingerprint", "online_features", "sentiment_normalize_text",
    "kb_project", "grouped_split", "grouped_split_exact", "stratified_temporal_split", "leakage_overlap", "label_shuffle",
    "classification_report", "f1_weighted", "tokenize", "ngrams", "vocabulary", "tfidf", "one_hot_long", "scale_numeric",
    "label_encode", "center_scale", "kb_index", "retrieve_topk", "graph_nodes", "graph_edges", "run_summary",
    "registry_state", "latest_production", "registry_pointer", "stream_daily_counts", "extractive_summary",
    "train_eval_structured",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for warm_up in ("daily_by_category", "tokenize", "online_features"):
        run(spark, warm_up, sf_dir)
    timings: dict[str, float] = {}
    for name in names:
        first = run(spark, name, sf_dir)
        # Queries that train or index are timed once; short ones again, warm.
        again = [run(spark, name, sf_dir) for _ in range(repeats)] if first < 10 else []
        timings[name] = round(statistics.median(again) if again else first, 3)
        print(f"{name}: first {first:.2f}s, reported {timings[name]:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_query_seconds_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
