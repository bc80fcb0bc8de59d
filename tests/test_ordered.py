"""Positions and running sums over range partitions, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import capacity
from quire.operators.ordered import numbered, running_sums
from quire.sources import files
from test_plans import plan_text


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 100).alias("v"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("u"))
    rows = numbered(df, F.col("v").desc(), "u", name="n", partitions=6).collect()
    got = [(r.v, r.u) for r in sorted(rows, key=lambda r: r.n)]
    assert sorted(r.n for r in rows) == list(range(1000))
    assert got == sorted(got, key=lambda t: (-t[0], t[1] is not None, t[1] or 0))
    assert numbered(df.where("v < 0"), "v").count() == 0


@pytest.mark.parametrize("seed,share", [(1, 0.3), (2, 0.0), (3, 1.0)])
def test_running_sums_equal_a_loop(spark, seed, share):
    """One group holds ``share`` of the rows and spans partitions; NULL is a group."""
    r = random.Random(seed)
    rows = [("hot" if r.random() < share else r.choice([None, "a", "b", f"g{r.randint(0, 200)}"]), i, r.randint(-5, 9), "keep")
            for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, v int, sums string")
    got = running_sums(df, "g", ["t"], {"n": F.lit(1), "before": F.col("v")}, partitions=7).collect()
    want, state = {}, {}
    for g, t, v, _ in sorted(rows, key=lambda x: x[1]):
        n, s = state.get(g, (0, 0))
        want[t] = (g, n, s)
        state[g] = (n + 1, s + v)
    assert {x.t: (x.g, x.n, x.before) for x in got} == want and len(got) == len(rows)
    assert got[0].sums == "keep"


def test_a_hot_conversation_spans_tasks(spark):
    rows = [(0 if i % 3 == 0 else i, i, "user", "x" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = files.transcript_positions(df)
    hot = {r.turn: (r.position, r.chars_before) for r in got.where("conv_id = 0").collect()}
    chars = 0
    for k, i in enumerate(range(0, 3000, 3)):
        assert hot[i] == (k, chars)
        chars += i % 5
    sizes = sorted(r["count"] for r in files.transcripts(df, 8).groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and len(sizes) == 8


def test_transcript_positions_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, "b", "ab"), (None, 5, "x", "abc"), (None, None, "y", "d"), (2, None, None, "é")]
    got = files.transcript_positions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, 0, "user", 0, 0), (1, 1, None, 1, 0), (1, 1, "b", 2, 0), (None, None, "y", 0, 0), (None, 5, "x", 1, 1),
        (2, None, None, 0, 0)], key=repr)
    assert files.transcript_positions(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_all_hosts_equal_every_pair(spark):
    r = random.Random(4)
    reqs = [(i, str(r.choice([1, 5, 20, 20, 80, 300])), None) for i in range(30)] + [(90, None, None), (91, "x", "MACE")]
    jobs = [(i, r.choice([*range(30), 90, 91, 77, None]), 0) for i in range(400)]
    requests = spark.createDataFrame(reqs, "request_id long, num_atoms string, method_type string")
    needs = {x.request_id: (x.mace_gb, x.dft_gb) for x in capacity.estimate_memory(requests).collect()}
    exact = [v for pair in needs.values() for v in pair]          # capacities that equal a need: strictly less is asked
    hosts = [(i, v, i % 2 == 0) for i, v in enumerate(exact)] + [
        (100, None, True), (101, 0.0, None), (102, 1e9, True), (103, 1e9, False), (103, 0.0, True), (None, 2.0, False)]
    got = capacity.route_all_hosts(spark.createDataFrame(jobs, "job_id long, request_id long, host_id long"), requests,
                                   spark.createDataFrame(hosts, "host_id long, vram_gb double, mace_registered boolean"))
    want = {}
    for host, vram, mace in hosts:
        for _, req, _ in jobs:
            need_mace, need_dft = needs.get(req, needs[90])       # 90: no atoms given, that is one
            tier = "GPU_MACE" if mace and need_mace < (vram or 0) else "GPU_DFT" if need_dft < (vram or 0) else "CPU_ORCA"
            want[host, tier] = want.get((host, tier), 0) + 1
    assert {(x.host_id, x.hw_tier): x.n_jobs for x in got.collect()} == want
    plan = plan_text(got, "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
