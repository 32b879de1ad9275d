"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Every query is run once to warm the JVM up and once for the clock; the time
covers building the plan and delivering the whole result to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "trending_boards", "trending_window_7d", "trending_sector_window", "ticker_detail", "ticker_news_7d",
    "sentiment_timeline_7d", "timeline_interpolate", "ticker_scores", "latest_per_url", "keyword_search",
    "search_tickers", "search_news", "knn_articles", "minhash_signature", "near_dup_kept", "near_duplicates",
    "extract_symbols", "normalize_gdelt", "union_feed", "response_parse", "weight_backfill", "retention",
    "stream_hourly", "stream_board",
)


def main() -> None:
    from pyspark.sql import SparkSession

    import workload

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
