import gzip
import glob
import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.operators import ingest, redact, sinks
from quire.sources import derived as D
from quire.streaming import jobs


def write_files(folder, n, start=0):
    os.makedirs(folder, exist_ok=True)
    for i in range(start, start + n):
        with open(os.path.join(folder, f"f{i}.md"), "w") as f:
            f.write(f"# File {i} header that is long enough to be kept #doc\nbody {i}\n"
                    f"## Second part of file {i} that also passes the rule\nmore {i}\n")


def test_sync_stream_replay_safe(spark, tmp_dir):
    src, coll = os.path.join(tmp_dir, "kb"), os.path.join(tmp_dir, "collection")
    write_files(src, 5)
    jobs.sync_stream(spark, src, coll, checkpoint=os.path.join(tmp_dir, "ck1")).awaitTermination()
    first = spark.read.parquet(coll).count()
    assert first == 10
    # a fresh checkpoint replays every file: nothing new is appended
    jobs.sync_stream(spark, src, coll, checkpoint=os.path.join(tmp_dir, "ck2")).awaitTermination()
    assert spark.read.parquet(coll).count() == 10
    write_files(src, 2, start=5)
    jobs.sync_stream(spark, src, coll, checkpoint=os.path.join(tmp_dir, "ck1")).awaitTermination()
    assert spark.read.parquet(coll).count() == 14


def test_write_corpus_counts_new_only(spark, tmp_dir):
    coll = os.path.join(tmp_dir, "c")
    files = spark.createDataFrame([("a.md", "# A header that is long enough to be kept by the length rule\nx")],
                                  "file string, text string")
    chunks = ingest.build_chunks(files)
    assert sinks.write_corpus(chunks, coll) == 1
    assert sinks.write_corpus(chunks, coll) == 0


def test_scrub_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "msgs")
    chat = D.chat(spark, SF_SMALL)
    chat.write.parquet(src)
    stream = spark.readStream.schema(chat.schema).parquet(src)
    out = os.path.join(tmp_dir, "scrubbed")
    jobs.scrub_stream(stream, out, checkpoint=os.path.join(tmp_dir, "ck")).awaitTermination()
    got = spark.read.parquet(out)
    want = redact.scrub_conversations(spark.read.parquet(src))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pulse_and_error_streams_equal_batch(spark, tmp_dir):
    m_src = os.path.join(tmp_dir, "metrics")
    D.metrics(spark, SF_SMALL).write.parquet(m_src)
    m = spark.read.parquet(m_src)
    want = jobs.pulse_status(m, "1 hour")
    stream = spark.readStream.schema(m.schema).parquet(m_src)
    # complete mode: every window, equal to the batch twin
    jobs.start_memory_sink(jobs.pulse_status(stream, "1 hour", watermark="1 day"),
                           "pulse_c", mode="complete").awaitTermination()
    got = spark.table("pulse_c")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # append mode: only windows closed by the watermark, each equal to the batch row
    jobs.start_memory_sink(jobs.pulse_status(stream, "1 hour", watermark="1 day"),
                           "pulse_a", mode="append").awaitTermination()
    closed = spark.table("pulse_a")
    assert closed.count() > 0
    assert closed.exceptAll(want).count() == 0
    max_ts = m.agg(F.max("ts")).first()[0]
    open_rows = want.where(F.col("window_end") > F.lit(max_ts) - F.expr("INTERVAL 1 DAY"))
    assert closed.count() + open_rows.count() == want.count()

    e_src = os.path.join(tmp_dir, "errors")
    D.error_logs(spark, SF_SMALL).write.parquet(e_src)
    e = spark.read.parquet(e_src)
    jobs.start_memory_sink(jobs.error_stream(spark.readStream.schema(e.schema).parquet(e_src),
                                             "1 day", watermark="2 days"), "errors_c",
                           mode="complete").awaitTermination()
    got = spark.table("errors_c")
    want = jobs.error_stream(e, "1 day")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_export_round_trip(spark, tmp_dir):
    out = os.path.join(tmp_dir, "export")
    msgs = spark.createDataFrame(
        [(1, 0, "user", "Smiles C1=CC=C(C=C1)O here"), (1, 1, "oracle", "fine"), (2, 0, None, None)],
        "conv_id long, turn long, role string, text string")
    sinks.export_scrubbed(msgs, out, "20260101_000000")

    def read(sub):
        rows = []
        for p in sorted(glob.glob(os.path.join(out, sub, "*.json.gz"))):
            with gzip.open(p, "rt") as f:
                rows += [json.loads(x) for x in f if x.strip()]
        return rows

    manifest = read("manifest")
    assert manifest == [{"export_timestamp": "20260101_000000", "version": "2026.1",
                         "privacy_guarantee": manifest[0]["privacy_guarantee"],
                         "n_conversations": 2, "n_messages": 3}]
    msgs_out = read("chat_data")
    assert [(m["conv_id"], m["turn"]) for m in msgs_out] == [(1, 0), (1, 1), (2, 0)]
    assert [m["content"] for m in msgs_out[:2]] == ["Smiles [REDACTED_SMILES_STRING] here", "fine"]
    assert (msgs_out[2]["role"], msgs_out[2]["content"]) == ("unknown", "")
    assert F is not None
