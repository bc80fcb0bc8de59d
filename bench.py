"""Benchmark: every registered query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver). A warm-up pass over the
smallest scale runs first so JVM start-up and code generation are not
charged to the first query; then each query runs ``$BENCH_REPEATS`` times
(default 2) at the target scale and the best time is reported, which damps
the noise of a shared machine. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import get_session  # noqa: E402

# Every registered query is timed, in catalogue order.
HEADLINE = list(QUERIES)


def run(spark, name: str, sf_dir: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = get_session(f"local[{cpus}]", app_name="quire-bench",
                        shuffle_partitions=max(8, int(cpus) * 2),
                        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for n in names:
            run(spark, n, warm)
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times = {n: round(min(run(spark, n, sf_dir) for _ in range(repeats)), 3) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
