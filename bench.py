"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (folder of the tables) and BENCH_CPUS (cores) choose data and parallelism. Each
query runs once to warm up, the second run counts. Results go to the noop sink, so every row
of every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from lotledger import build_session  # noqa: E402
from lotledger.plans.catalog import all_queries  # noqa: E402

HEADLINE = [
    "market_summary",
    "market_summary_of_make",
    "price_history",
    "price_trend_by_make",
    "price_histogram",
    "market_facets",
    "filter_all_criteria",
    "lots_page_by_ended_at_desc",
    "lots_page_deep",
    "upsert_lots",
    "first_seen_per_run",
    "source_health",
    "register_raw_pages",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="bench", master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="16g",
        spark_ui_enabled="false", spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = all_queries(), {}
    for name in asked:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(times[-1], 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
