"""Per-stage times of one registered query, read from Spark's event log.

Usage: python tools/stage_times.py <query> [sf_dir]

The event log is written to a fresh scratch folder (no UI, no server). After
a warm-up run at sf0.001, the summary lists every stage of the measured run with its wall time, task count, summed executor
run time, shuffle read/write and spill, so shuffles and skew show up.
"""
from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import get_session  # noqa: E402


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="quire-eventlog-")
    spark = get_session("local[8]", shuffle_partitions=16, extra_conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false"})
    # warm-up at the smallest scale (code generation, Python workers), then
    # the measured run under its own job group
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", "measured run")
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    measured = set()
    stages, tasks = {}, defaultdict(lambda: defaultdict(float))
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageSubmitted":
                    props = ev.get("Properties") or {}
                    if props.get("spark.jobGroup.id") == "measured":
                        info = ev["Stage Info"]
                        measured.add((info["Stage ID"], info["Stage Attempt ID"]))
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    stages[(info["Stage ID"], info["Stage Attempt ID"])] = info
                elif kind == "SparkListenerTaskEnd" and ev.get("Task Metrics"):
                    key = (ev["Stage ID"], ev["Stage Attempt ID"])
                    m = ev["Task Metrics"]
                    t = tasks[key]
                    t["run_ms"] += m.get("Executor Run Time", 0)
                    t["max_ms"] = max(t["max_ms"], m.get("Executor Run Time", 0))
                    t["spill"] += m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0)
                    sr = m.get("Shuffle Read Metrics", {})
                    t["read"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                    t["write"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    print(f"{'stage':>6} {'wall ms':>8} {'tasks':>5} {'run ms':>8} {'max task':>8} "
          f"{'shuf rd':>9} {'shuf wr':>9} {'spill':>7}  name")
    for key in sorted(k for k in stages if k in measured):
        info, t = stages[key], tasks[key]
        wall = (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0)
        print(f"{key[0]:>6} {wall:>8} {info['Number of Tasks']:>5} {int(t['run_ms']):>8} "
              f"{int(t['max_ms']):>8} {int(t['read']):>9} {int(t['write']):>9} {int(t['spill']):>7}  "
              f"{info['Stage Name'][:60]}")


if __name__ == "__main__":
    main()
