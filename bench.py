"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of RUNS runs. Prints one JSON line."""

import importlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = [
    "sum_ifs",
    "group_by_sum",
    "group_by_median",
    "xlookup_exact",
    "xlookup_floor",
    "moving_average",
    "moving_median",
    "regex_count_documents",
    "distance_euclidean",
    "flagship_segment_bands",
    "batched_ifs",
    "percentile_ifs",
    "weighted_median",
    "remove_duplicate_rows",
    "running_sum",
    "rank_avg",
    "workday_add_orders",
    "parse_json",
    "op1_dart_minhash",
    "op2_bpe_automaton",
    "op3_debruijn_substrings",
    "op4_language_mixture",
    "op5_page_differencing",
    "op6_spotsigs",
    "op7_compression_quality",
    "op8_chat_formatting",
    "op9_best_fit_packing",
    "op10_winnowing",
    "pipeline",
]


def main() -> None:
    from pyspark.sql import SparkSession

    entry = importlib.import_module("__spark_entry__")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = entry.queries(), {}
    for name in HEADLINES:
        if name not in queries:
            continue
        times = []
        for run in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
