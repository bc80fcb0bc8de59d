"""Streams under replay and silence, the collection laid out by id, mergeable
sketches and the search by a table of filters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import ingest, report, sinks
from quire.streaming import jobs
from test_plans import plan_text
from test_streams_sinks import write_files

METRICS = "ts timestamp, host string, cpu_pct double, is_active boolean"


def samples(spark, rows):
    """(second, host, cpu, active)"""
    df = spark.createDataFrame(rows, "s long, host string, cpu_pct double, is_active boolean")
    return df.select(F.timestamp_seconds("s").alias("ts"), "host", "cpu_pct", "is_active")


def plain(df):
    return sorted((r.window_start.timestamp(), r.window_end.timestamp(), r.host, r.n_samples, r.cpu_pct, r.is_active, r.status)
                  for r in df.collect())


HOSTS = [(5, "a", 10.0, True), (15, "a", 90.0, True), (65, "a", 0.5, False), (250, "a", 95.0, True), (900, "a", 1.0, True),
         (30, "b", 99.0, True), (61, "c", None, None), (310, "c", 12.5, True), (1500, "d", 50.0, True)]


def test_silent_windows_by_hand(spark):
    got = {(r[0], r[2]): (r[3], r[6]) for r in plain(jobs.pulse_status_silent(samples(spark, HOSTS), "1 minute", 3))}
    idle, active, busy = jobs.fixed.STATUS_IDLE, jobs.fixed.STATUS_ACTIVE, jobs.fixed.STATUS_BUSY
    assert {w: got[w, "a"] for w, h in got if h == "a"} == {
        0: (2, active), 60: (1, idle), 120: (0, idle), 180: (0, idle), 240: (1, busy), 300: (0, idle), 360: (0, idle), 420: (0, idle),
        900: (1, active), 960: (0, idle), 1020: (0, idle), 1080: (0, idle)}
    assert [w for w, h in sorted(got) if h == "b"] == [0, 60, 120, 180]
    assert [w for w, h in sorted(got) if h == "d"] == [1500]       # nothing beyond the last window of all hosts
    assert jobs.pulse_status_silent(samples(spark, []), "1 minute", 3).count() == 0


@pytest.mark.parametrize("split", [1, 3])
def test_silent_status_stream_equals_batch(spark, tmp_dir, split):
    src = os.path.join(tmp_dir, "m")
    rows = sorted(HOSTS + [(4000, "z", 1.0, True)])
    step = -(-len(rows) // split)
    for i in range(split):                                          # one file a micro-batch
        samples(spark, rows[i * step:(i + 1) * step]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ck = os.path.join(tmp_dir, "ck")
    q = jobs.silent_status_stream(stream, f"silent_{split}", 60, "1 minute", 3, ck)
    q.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = [r for r in plain(jobs.pulse_status_silent(samples(spark, rows), "1 minute", 3)) if r[1] <= 4000 - 60]
    assert plain(spark.table(f"silent_{split}")) == want
    # every host but the last is forgotten: its state is gone
    state = spark.read.format("statestore").option("stateVarName", "told").load(ck)
    assert [r.host for r in state.select("key.host").collect()] == ["z"]


def test_replayed_logs_count_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "logs")
    rows = [(i, 86400 + i * 60, "ValueError: x" if i % 2 else "KeyError: y") for i in range(40)]
    df = spark.createDataFrame(rows, "log_id long, s long, traceback string") \
        .select("log_id", F.timestamp_seconds("s").alias("ts"), "traceback")
    for _ in range(2):                                              # delivered twice
        df.coalesce(1).write.mode("append").parquet(src)
    df.where("log_id = 39").select(F.lit(99).cast("long").alias("log_id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), "traceback") \
        .coalesce(1).write.mode("append").parquet(src)              # later by far: closes all windows
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.start_memory_sink(jobs.error_stream(stream, "10 minutes", "1 hour", once_by="log_id"), "replayed", "append")
    q.awaitTermination()
    want = jobs.error_stream(df, "10 minutes")
    got = spark.table("replayed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, jobs.error_stream(df.union(df), "10 minutes", once_by="log_id").collect())) == sorted(map(tuple, want.collect()))
    dedupe = [s for s in q.lastProgress["stateOperators"] if "dedup" in s["operatorName"].lower()]
    assert dedupe and dedupe[0]["numRowsTotal"] <= 1                # ids behind the watermark are forgotten


def chunk_rows(spark, ids):
    return spark.createDataFrame([(f"f_{i:04d}", f"f{i}", 0, f"text {i}", [], "none") for i in ids], sinks.COLLECTION_SCHEMA)


def test_bucketed_collection(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "coll")
    assert sinks.write_corpus(chunk_rows(spark, range(50)), path, buckets=8) == 50
    assert sinks.write_corpus(chunk_rows(spark, range(40, 70)), path, buckets=8) == 20
    assert sinks.write_corpus(chunk_rows(spark, range(70)), path, buckets=8) == 0
    assert sinks.write_corpus(chunk_rows(spark, []), path, buckets=8) == 0
    spark.sql(f"DROP TABLE {sinks.collection_name(path)}")          # another session: only the files are left
    whole = sinks.bucketed_collection(spark, path, 8)
    assert sorted(r[0] for r in whole.select("chunk_id").collect()) == [f"f_{i:04d}" for i in range(70)]
    assert sinks.read_collection(spark, path).count() == 70
    few = plan_text(sinks.missing_chunks(whole, chunk_rows(spark, [3])), "formatted")
    assert "SelectedBucketsCount: 1 out of 8" in few
    monkeypatch.setattr(sinks, "FEW_IDS", 0)
    many = plan_text(sinks.missing_chunks(whole, chunk_rows(spark, range(60, 90))), "simple")
    scan = many[:many.index("FileScan")].splitlines()[-1]
    collection_side = many[many.rindex("SortMergeJoin"):]
    assert "Bucketed: true" in collection_side and collection_side.count("Exchange") == 1 and scan is not None
    assert sinks.missing_chunks(whole, chunk_rows(spark, range(60, 90))).count() == 20


def test_bucketed_sync_is_replay_safe(spark, tmp_dir):
    src, coll = os.path.join(tmp_dir, "kb"), os.path.join(tmp_dir, "collection")
    write_files(src, 5)
    for ck in ("ck1", "ck2"):                                       # a fresh checkpoint replays every file
        jobs.sync_stream(spark, src, coll, os.path.join(tmp_dir, ck), buckets=4).awaitTermination()
        assert sinks.read_collection(spark, coll).count() == 10


def test_sketches_merge_to_those_of_one_pass(spark):
    r = random.Random(2)
    rows = [(f"f{r.randint(0, 3000)}", "x" * int(r.expovariate(0.01)), r.sample(["a", "b", "c"], r.randint(0, 2)), r.choice("pq")) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "file string, text string, tags array<string>, source string")
    cuts = [df.where(F.pmod(F.xxhash64("text"), F.lit(3)) == i) for i in range(3)]
    merged = ingest.merge_tag_sketches(ingest.merge_tag_sketches(*map(ingest.tag_sketches, cuts[:2])), ingest.tag_sketches(cuts[2]))
    one = {x.tag: (x.n_chunks, x.n_files) for x in ingest.estimated_tag_index(ingest.tag_sketches(df)).collect()}
    added = {x.tag: (x.n_chunks, x.n_files) for x in ingest.estimated_tag_index(merged).collect()}
    for x in ingest.tag_index(df).collect():
        for state in (one, added):                                  # united sketches have an estimator of their own
            assert state[x.tag][0] == x.n_chunks and abs(state[x.tag][1] - x.n_files) <= 0.02 * x.n_files
    merged = report.merge_length_sketches("source", *(report.length_sketches(c, "source") for c in cuts))
    errors = report.rank_errors(report.length_quantiles(merged, "source", [0.01, 0.5, 0.9, 0.99]), df, "source").collect()
    assert len(errors) == 8 and all(x.rank_error <= report.RANK_ERROR for x in errors)
    assert sum(x.n_chunks for x in errors) == 4 * 20_000


def test_tag_search_equals_contains(spark):
    r = random.Random(3)
    tags = ["en", "setup", "troubleshooting", "x", "gpu_1", "GPU"]
    rows = [(f"c{i}", ",".join(sorted(r.sample(tags, r.randint(1, 4)))) if i % 5 else "none") for i in range(300)] + [("n", None), ("e", "")]
    filters = ["en", "#en", "set", "up,", "shoot", "absent", "", "#", "x", ",", "gpu", "GPU", "none", "##en", None, "e", "troubleshooting,x", "oo"]
    chunks = spark.createDataFrame(rows, "chunk_id string, tags_joined string")
    got = ingest.tag_search(chunks, spark.createDataFrame([(f,) for f in filters + ["en"]], "tag string"))
    want = sorted((f, c) for f in set(filters) - {None} for c, joined in rows
                  if joined is not None and (f[1:] if f.startswith("#") else f) in joined)
    assert sorted(map(tuple, got.collect())) == want
    plan = plan_text(got, "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tag_search_summary_counts_per_joined_tags(spark):
    rows = [(f"c{i:04d}", "en,part,troubleshooting" if i % 7 else None if i % 2 else "en") for i in range(2_000)]
    rows += [("c0001", "en,part,troubleshooting")] * 2 + [(None, "en"), (None, "lonely")]
    chunks = spark.createDataFrame(rows, "chunk_id string, tags_joined string")
    filters = [a + b for a in ("", "#") for b in ("en", "part", "t", "r", "oo", "shoot", "absent", "lonely", "")]
    got = ingest.tag_search(chunks, spark.createDataFrame([(f,) for f in filters + [None]], "tag string"), summary=True).collect()
    held = {f: [c for c, joined in rows if joined is not None and f.removeprefix("#") in joined] for f in filters}
    want = [(f, len(c), min((x for x in c if x is not None), default=None)) for f, c in held.items() if c]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
