"""Knowledge-file sources: one row per ``*.md`` / ``*.txt`` file, whole text.

Only the files directly in the folder are read (no recursion). Line ends are
normalised to ``\\n`` as text-mode reading does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordered import running_sums

FILE_GLOB = "*.{md,txt}"


def _files(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_name").alias("file"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
    )


def kb_scan(spark: SparkSession, path: str) -> DataFrame:
    """A1: ``files(file, text)`` for the knowledge folder.

    ``wholetext`` must be passed as an argument: set through ``.option`` it
    is overridden and the files are split by line.
    """
    df = spark.read.text(path, wholetext=True, pathGlobFilter=FILE_GLOB, recursiveFileLookup=False)
    return _files(df)


def kb_scan_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A2: the same as a stream; each new file arrives once."""
    reader = spark.readStream.option("pathGlobFilter", FILE_GLOB)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _files(reader.text(path, wholetext=True))


def transcripts(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """A3: the messages of every conversation in turn order.

    Range partitioning on (conv_id, turn) keeps each conversation's messages
    together and in order while still letting a conversation that holds a
    large share of all messages span several partitions; nothing is
    collected into one value. Without a number of partitions Spark's shuffle
    settings and AQE size them by bytes.
    """
    by = ("conv_id", "turn")
    ranged = messages.repartitionByRange(partitions, *by) if partitions else messages.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def transcript_positions(messages: DataFrame) -> DataFrame:
    """A3 as rows: ``conv_id, turn, role, position, chars_before`` -- each message's
    place in its conversation from 0 and the characters of the ones before it.

    Sums run along range partitions and are carried over their boundaries
    (``ordered.running_sums``), so a conversation with a third of all messages
    is summed by several tasks. Ties of a turn are ordered by role and text."""
    narrow = messages.select("conv_id", "turn", "role", F.xxhash64("text").alias("__tie"),
                             F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__n"))
    return running_sums(narrow, "conv_id", ["turn", "role", "__tie"],
                        {"position": F.lit(1).cast("long"), "chars_before": F.col("__n")}).drop("__tie", "__n")


def transcript_stats(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, characters, first and last role, roles seen.
    Every aggregate combines per partition before the shuffle."""
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length("text")).alias("n_chars"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_user"),
        F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("n_assistant"),
        F.sum(F.when(F.col("role") == "system", 1).otherwise(0)).alias("n_system"),
    )
