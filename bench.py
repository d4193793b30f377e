"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads, BENCH_QUERIES an optional
comma-separated list of query names. Each query runs in full, from building its plan to its last
row; one untimed run of the flagship query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hearthstat.plans.queries import QUERIES
from hearthstat.session import build_session
from hearthstat.sources.stored import drop_stored, stored_tables


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["weighted_distribution"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        with stored_tables(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    drop_stored(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
