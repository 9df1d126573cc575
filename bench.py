"""Times every catalogue query; prints one JSON line.

One warm-up run, then the median of ``BENCH_RUNS`` timed runs per query
(default 3; queries over ``LONG`` seconds are timed once). Results are computed
in full and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallybook.plans.catalogue import CATALOGUE  # noqa: E402
from tallybook.session import local_session  # noqa: E402


LONG = 4.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    wanted = names.split(",") if names else list(CATALOGUE)
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        CATALOGUE[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in wanted:
        once(name)
        first = once(name)
        more = [once(name) for _ in range(runs - 1)] if first < LONG else []
        times[name] = round(statistics.median([first, *more]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of all catalogue queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
