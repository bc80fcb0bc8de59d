"""Sinks: the chunk collection (Parquet, insert-if-absent) and the scrubbed
conversation export (compressed JSON, one line per message)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quire.functions import fixed
from quire.operators import ingest, redact
from quire.session import cut_tables
from quire.sources.files import transcripts

COLLECTION_SCHEMA = ("chunk_id string, file string, pos int, text string, "
                     "tags array<string>, tags_joined string")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection; empty only where nothing has been written yet. A folder
    that cannot be read as a collection is an error."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COLLECTION_SCHEMA)
    return found.select(*ingest.CHUNK_COLUMNS)


def bucketed_collection(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The collection as a table bucketed and sorted by ``chunk_id``, whose files
    lie under ``path``. The session's catalog learns of it here, so any session
    may go on with it, with the same number of buckets."""
    name = collection_name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({COLLECTION_SCHEMA}) USING parquet CLUSTERED BY (chunk_id) SORTED BY (chunk_id) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name).select(*ingest.CHUNK_COLUMNS)


def collection_name(path: str) -> str:
    return "quire_collection_" + hashlib.sha256(path.encode()).hexdigest()[:16]


FEW_IDS = 1000       # ids of a small batch that are pushed into the scan of the collection


def missing_chunks(existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that a bucketed collection lacks. The join takes the buckets as
    they lie: only the batch is shuffled. A batch of up to ``FEW_IDS`` ids names
    them in the scan, which then opens their buckets only."""
    fresh = ingest.dedupe_chunks(chunks)
    ids = fresh.select("chunk_id").limit(FEW_IDS + 1).collect()
    if len(ids) <= FEW_IDS:
        existing = existing.where(F.col("chunk_id").isin([r[0] for r in ids]))
    return fresh.join(existing.select("chunk_id").hint("merge"), "chunk_id", "left_anti")


def write_corpus(chunks: DataFrame, path: str, buckets: int | None = None) -> int:
    """H1: append the chunks the collection does not hold yet; returns how many.

    The ids are content addressed, so a replay of the same input appends
    nothing. Parquet has no transactions: one writer per collection. With
    ``buckets`` the collection is laid out by id, and a sync neither shuffles it
    nor, for a small batch, opens the buckets that the batch does not touch.
    """
    spark = chunks.sparkSession
    if buckets:
        # written once: the batch is read for its ids, for the join and for the count
        with cut_tables(spark) as cut:
            chunks = cut(chunks)
            fresh = cut(missing_chunks(bucketed_collection(spark, path, buckets), chunks))
            n = fresh.count()
            if n:
                fresh.repartition(int(buckets), "chunk_id").sortWithinPartitions("chunk_id") \
                    .write.insertInto(collection_name(path))
            return n
    # Materialise once: the count and the write read the same rows.
    with cut_tables(spark) as cut:
        fresh = cut(ingest.new_chunks(read_collection(spark, path), chunks))
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n


def export_scrubbed(messages: DataFrame, path: str, export_timestamp: str,
                    compression: str = "gzip") -> None:
    """H2: the scrubbed conversations as compressed JSON.

    ``<path>/manifest``: one object ``{export_timestamp, version,
    privacy_guarantee, n_conversations, n_messages}``; ``<path>/chat_data``:
    one object ``{conv_id, turn, role, content}`` per message, in
    conversation and turn order. The time is a parameter so an export is
    repeatable; no conversation is gathered into one task.
    """
    # ordered as raw rows, whose sampling and shuffle are sized by bytes, then
    # redacted once, while they are written; the manifest needs no text
    kept = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    manifest = kept.agg(F.countDistinct("conv_id").alias("n_conversations"),
                        F.count(F.lit(1)).alias("n_messages")).select(
        F.lit(export_timestamp).alias("export_timestamp"),
        F.lit(fixed.EXPORT_VERSION).alias("version"),
        F.lit(fixed.PRIVACY_NOTE).alias("privacy_guarantee"),
        "n_conversations", "n_messages")
    manifest.coalesce(1).write.mode("overwrite").option("compression", compression) \
        .json(os.path.join(path, "manifest"))
    redact.scrub_conversations(transcripts(kept)).write.mode("overwrite").option("compression", compression) \
        .json(os.path.join(path, "chat_data"))
