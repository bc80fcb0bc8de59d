"""Structured Streaming jobs and their batch twins.

Every stream job is the batch operator applied to a streaming DataFrame;
the batch twin (same function on a static DataFrame) is what the tests and
the oracle compare against. Checkpoints go to the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import fixed
from quire.operators import ingest, redact, sinks
from quire.operators.triage import signature_col
from quire.session import checkpoint_dir
from quire.sources.files import kb_scan_stream


def _own_checkpoint(spark: SparkSession, job: str, *names: str) -> str:
    """A checkpoint folder per job, source and target: another source or target
    must not continue from these offsets."""
    key = hashlib.sha256("\0".join(names).encode()).hexdigest()[:16]
    return os.path.join(checkpoint_dir(spark), f"{job}-{key}")


# ------------------------------------------------------------------ S1 corpus sync
def sync_stream(spark: SparkSession, source_path: str, collection_path: str,
                checkpoint: str | None = None, available_now: bool = True,
                processing_time: str = "60 minutes",
                max_files_per_trigger: int | None = None, buckets: int | None = None) -> StreamingQuery:
    """New knowledge files -> chunks -> insert-if-absent into the collection.

    Each micro-batch runs the batch pipeline; the insert is keyed on the
    content-addressed id, so replaying a batch after a failure appends nothing.
    With ``buckets`` the collection is laid out by id (``sinks.write_corpus``).
    """
    # bounded micro-batches when a large backlog of files arrives at once
    files = kb_scan_stream(spark, source_path, max_files_per_trigger)
    ckpt = checkpoint or _own_checkpoint(spark, "sync_stream", source_path, collection_path)

    def upsert(batch: DataFrame, _epoch: int) -> None:
        sinks.write_corpus(ingest.build_chunks(batch), collection_path, buckets)

    w = files.writeStream.foreachBatch(upsert).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


# ------------------------------------------------------------------ S2 scrub
def scrub_stream(messages: DataFrame, out_path: str, checkpoint: str | None = None,
                 fmt: str = "parquet") -> StreamingQuery:
    """Stateless redaction of a message stream, appended to ``out_path``."""
    spark = messages.sparkSession
    # what the stream reads is part of its plan
    source = messages._jdf.queryExecution().analyzed().toString() if checkpoint is None else ""
    ckpt = checkpoint or _own_checkpoint(spark, "scrub_stream", re.sub(r"#\d+L?", "", source), out_path)
    return (redact.scrub_conversations(messages).writeStream.format(fmt)
            .option("path", out_path).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(availableNow=True).start())


def _event_time(df: DataFrame, watermark: str | None, col: str = "ts") -> tuple[DataFrame, str]:
    """Event time ready for windowing. A watermark needs TIMESTAMP, so a
    TIMESTAMP_NTZ column is converted for streams (and window bounds are
    given back in the input's type); batch twins window the column as is."""
    if df.isStreaming and not watermark:
        raise ValueError("a stream needs a watermark, or its state grows without bound")
    kind = df.schema[col].dataType.simpleString()
    if watermark and kind == "timestamp_ntz":
        df = df.withColumn(col, F.col(col).cast("timestamp"))
    return (df.withWatermark(col, watermark) if watermark else df), kind


# ------------------------------------------------------------------ S3 status
def pulse_status(metrics: DataFrame, window: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """S3: per host and tumbling window, mean CPU, whether active, and the
    status colour: inactive -> green; active and CPU < 80 -> orange; else red."""
    src, kind = _event_time(metrics, watermark)
    agg = src.groupBy(F.window("ts", window).alias("w"), "host").agg(
        F.avg("cpu_pct").alias("cpu_pct"),
        F.max(F.col("is_active").cast("int")).alias("active"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    status = (F.when(F.col("active") == 0, F.lit(fixed.STATUS_IDLE))
              .when(F.col("cpu_pct") < fixed.BUSY_CPU_PCT, F.lit(fixed.STATUS_ACTIVE))
              .otherwise(F.lit(fixed.STATUS_BUSY)))
    return agg.select(F.col("w.start").cast(kind).alias("window_start"),
                      F.col("w.end").cast(kind).alias("window_end"), "host", "n_samples", "cpu_pct", (F.col("active") == 1).alias("is_active"),
                      status.alias("status"))


# ------------------------------------------------------------------ S3 with silent hosts
STATUS_DDL = ("window_start timestamp, window_end timestamp, host string, n_samples long, cpu_pct double, "
              "is_active boolean, status string")


def pulse_status_silent(metrics: DataFrame, window: str = "1 minute", expire: int = 3) -> DataFrame:
    """S3, batch twin of ``silent_status_stream``: besides a row for each window
    with samples, one for each of up to ``expire`` windows after it in which the
    host stayed silent (no samples, inactive), none beyond the last window of all
    hosts. One small window per host runs over its windows, not its samples."""
    seen = pulse_status(metrics, window)
    kind = seen.schema["window_start"].dataType.simpleString()
    at, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("window_start", "window_end"))
    placed = seen.withColumn("__at", at).withColumn("__w", end - at)
    # the start of the last window of all hosts: one value
    last = placed.agg(F.max("__at")).first()[0]
    by_host = Window.partitionBy("host").orderBy("__at")
    gaps = placed.select("host", "__at", "__w", F.lead("__at").over(by_host).alias("__next"))
    free = F.coalesce(F.col("__next") - F.col("__w"), F.lit(last).cast("long")) - F.col("__at")
    n = F.least(F.lit(expire).cast("long"), (free / F.col("__w")).cast("long"))
    silent = gaps.withColumn("__n", n).where("__n > 0") \
        .select("host", "__w", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("__n")),
                                                     lambda i: F.col("__at") + i * F.col("__w"))).alias("__at"))
    return seen.unionByName(silent.select(
        F.timestamp_micros("__at").cast(kind).alias("window_start"), F.timestamp_micros(F.col("__at") + F.col("__w")).cast(kind).alias("window_end"),
        "host", F.lit(0).cast("long").alias("n_samples"), F.lit(None).cast("double").alias("cpu_pct"),
        F.lit(False).alias("is_active"), F.lit(fixed.STATUS_IDLE).alias("status")))


def _status_processor(width_ms: int, expire: int):
    """Keyed state of a host: its open windows, and the next one to be told."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    idle, active, busy, limit = fixed.STATUS_IDLE, fixed.STATUS_ACTIVE, fixed.STATUS_BUSY, fixed.BUSY_CPU_PCT

    class Status(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getMapState("open", "at long", "n long, known long, total double, active int")
            self.told = handle.getValueState("told", "next long, sampled long")      # sampled: last window with samples that was told

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for pdf in rows:
                at = pdf["ts"].astype("datetime64[ms]").astype("int64") // width_ms * width_ms
                for w, part in pdf.groupby(at):
                    w = int(w)
                    n, known, total, on = self.open.getValue((w,)) if self.open.containsKey((w,)) else (0, 0, 0.0, -1)
                    cpu, flags = part["cpu_pct"].dropna(), part["is_active"].dropna()
                    on = max(on, max(map(int, flags), default=-1))      # -1: not known
                    self.open.updateValue((w,), (n + len(part), known + len(cpu), total + float(cpu.sum()), on))
                    first = w if first is None else min(first, w)
            if first is not None:
                told = self.told.get() if self.told.exists() else None
                if told is None or first < told[0]:
                    self.told.update((first, told[1] if told else first - width_ms * (expire + 1)))
                    self.handle.registerTimer(first + width_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.told.exists():
                return
            at, sampled = self.told.get()
            now, out = timerValues.getCurrentWatermarkInMs(), []
            waiting = sorted(k[0] for k in self.open.keys())
            while at + width_ms <= now:
                if waiting and waiting[0] == at:
                    n, known, total, on = self.open.getValue((at,))
                    self.open.removeKey((at,))
                    waiting.pop(0)
                    mean = total / known if known else None
                    status = idle if on == 0 else active if mean is not None and mean < limit else busy
                    out.append((at, n, mean, None if on < 0 else on == 1, status))
                    sampled = at
                elif at - sampled <= expire * width_ms:
                    out.append((at, 0, None, False, idle))
                elif waiting:
                    at = waiting[0]
                    continue
                else:
                    break
                at += width_ms
            if not waiting and at - sampled > expire * width_ms:
                self.told.clear()                            # silent for too long: the host is forgotten
            else:
                self.told.update((at, sampled))
                self.handle.registerTimer(at + width_ms)
            if out:
                yield pd.DataFrame({
                    "window_start": pd.to_datetime([o[0] for o in out], unit="ms"),
                    "window_end": pd.to_datetime([o[0] + width_ms for o in out], unit="ms"), "host": key[0],
                    "n_samples": [o[1] for o in out], "cpu_pct": pd.Series([o[2] for o in out], dtype="object"),
                    "is_active": pd.Series([o[3] for o in out], dtype="object"), "status": [o[4] for o in out]})

        def close(self):
            pass

    return Status()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def silent_status_stream(metrics: DataFrame, name: str, window_seconds: int, watermark: str, expire: int = 3,
                         checkpoint: str | None = None) -> StreamingQuery:
    """S3 as a stream that also tells of silent hosts, into the in-memory table
    ``name``: event-time timers emit every window of a host once the watermark
    passes it, with samples or without; a host silent for more than ``expire``
    windows loses its state. Samples later than the watermark are dropped."""
    spark = metrics.sparkSession
    src = metrics.select(F.col("ts").cast("timestamp").alias("ts"), F.col("host").cast("string").alias("host"),
                         F.col("cpu_pct").cast("double").alias("cpu_pct"), "is_active").withWatermark("ts", watermark)
    told = src.groupBy("host").transformWithStateInPandas(
        statefulProcessor=_status_processor(window_seconds * 1000, expire), outputStructType=STATUS_DDL,
        outputMode="Append", timeMode="EventTime")
    # keyed state with timers needs this store; only this query takes it
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return start_memory_sink(told, name, "append", checkpoint)
    finally:
        spark.conf.set(key, before)


# ------------------------------------------------------------------ C4 error counts
def error_stream(logs: DataFrame, window: str = "1 hour", watermark: str | None = None,
                 prefix: str = "app_", once_by: str | None = None) -> DataFrame:
    """C4: error signature counts per tumbling window (late rows up to the
    watermark are still counted). With ``once_by`` rows of one log id count once,
    as when a source replays them: a stream remembers an id until the watermark
    passes it, so replays within the watermark's delay are dropped."""
    src, kind = _event_time(logs, watermark)
    if once_by:
        src = src.dropDuplicatesWithinWatermark([once_by]) if logs.isStreaming else src.dropDuplicates([once_by])
    return (src.withColumn("signature", signature_col("traceback", prefix))
            .groupBy(F.window("ts", window).alias("w"), "signature")
            .agg(F.count(F.lit(1)).alias("n_errors"))
            .select(F.col("w.start").cast(kind).alias("window_start"),
                    F.col("w.end").cast(kind).alias("window_end"), "signature", "n_errors"))


def start_memory_sink(df: DataFrame, name: str, mode: str = "append",
                      checkpoint: str | None = None) -> StreamingQuery:
    """Run a streaming aggregate into an in-memory table (tests and demos)."""
    spark = df.sparkSession
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), f"mem_{name}_{uuid.uuid4().hex}")
    return (df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
