"""Corpus reports: per-file sync counts and a corpus profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import ingest
from quire.session import cut_lineage


def sync_report(files: DataFrame, existing: DataFrame) -> DataFrame:
    """H3: per file, pieces produced, short pieces dropped, chunks kept, distinct
    ids, ids inserted and ids already in the collection; ROLLUP adds the total
    row (``file`` NULL).

    Two plain aggregations and no distinct aggregate: first per (file, id)
    -- every group is one id, short pieces share the NULL id -- then the
    ROLLUP of sums. Both combine before their shuffles, so a file or an id
    with a large share of the rows is cheap. The collection's ids are joined
    once (AQE broadcasts them when small, else a sort-merge join on the id).
    """
    pieces = ingest.chunk_documents(files, min_chars=None)
    kept = F.length("text") >= fixed.MIN_CHUNK_CHARS
    flagged = (
        pieces.select("file", kept.alias("kept"),
                      F.when(kept, ingest.chunk_id_col("file", "text")).alias("chunk_id"))
        .join(existing.select("chunk_id").distinct().withColumn("present", F.lit(True)),
              "chunk_id", "left")
    )
    per_id = flagged.groupBy("file", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(~F.col("kept"), 1).otherwise(0)).alias("n_short"),
        F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("n_kept"),
        F.max(F.coalesce(F.col("present"), F.lit(False))).alias("present"),
    )
    is_id = F.col("chunk_id").isNotNull()
    return per_id.rollup("file").agg(
        F.sum("n").alias("n_pieces"),
        F.sum("n_short").alias("n_short"),
        F.sum("n_kept").alias("n_chunks"),
        F.count("chunk_id").alias("n_ids"),
        F.sum(F.when(is_id & ~F.col("present"), 1).otherwise(0)).cast("long").alias("n_inserted"),
        F.sum(F.when(is_id & F.col("present"), 1).otherwise(0)).cast("long").alias("n_existing"),
    )


def nearest_rank(hist: DataFrame, value: str, count: str, ps: list[float]) -> DataFrame:
    """Exact nearest-rank quantiles from a (value, count) histogram.

    The histogram has one row per distinct value, so the running sum over it
    is small even when the data is large.
    """
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum(count).over(w)).withColumn(
        "total", F.sum(count).over(Window.partitionBy()))
    aggs = [F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(p)), F.col(value)))
            .alias(f"p{int(round(p * 100))}") for p in ps]
    return cum.agg(*aggs)


def _long(df: DataFrame) -> DataFrame:
    """One-row aggregate -> (metric, value) rows."""
    pairs = ", ".join(f"'{c}', CAST({c} AS BIGINT)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (metric, value)")


def corpus_report(chunks: DataFrame) -> DataFrame:
    """H4: the chunk collection profiled as ``(metric, value)`` rows: files,
    chunks, characters, length extremes and exact quantiles, tags.

    One pass: every chunk emits (kind, key) items -- its length, its file,
    each tag, and an untagged marker -- grouped once. All metrics come from
    that grouped table, whose size is the number of distinct lengths, files
    and tags, so the scan and the shuffle happen once.
    """
    items = chunks.select(F.explode(F.concat(
        F.array(
            F.struct(F.lit("len").alias("kind"), F.length("text").cast("string").alias("key")),
            F.struct(F.lit("file").alias("kind"), F.col("file").alias("key")),
            F.struct(F.lit("untagged").alias("kind"),
                     F.when(F.size("tags") == 0, F.lit("1")).alias("key")),
        ),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key"))),
    )).alias("it")).select("it.kind", "it.key").where(F.col("key").isNotNull())
    # Checkpointed: the branches below filter it differently, which would
    # otherwise push each filter under the aggregate and rescan the corpus.
    g = cut_lineage(items.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")))
    hist = g.where(F.col("kind") == "len").select(F.col("key").cast("long").alias("n_chars"), "n")
    basic = hist.agg(
        F.sum("n").alias("n_chunks"),
        F.sum(F.col("n_chars") * F.col("n")).alias("total_chars"),
        F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"),
    )
    others = g.where(F.col("kind") != "len").agg(
        F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).alias("n_files"),
        F.sum(F.when(F.col("kind") == "untagged", F.col("n")).otherwise(0)).alias("n_untagged"),
        F.sum(F.when(F.col("kind") == "tag", 1).otherwise(0)).alias("n_tags"),
    )
    q = nearest_rank(hist, "n_chars", "n", [0.5, 0.9, 0.99])
    return _long(basic).unionByName(_long(others)).unionByName(_long(q))


LENGTH_SKETCH_K = 400      # size of a length sketch: normalised rank error about 0.7 %
RANK_ERROR = 0.01          # the bound that is promised


def length_sketches(chunks: DataFrame, by: str) -> DataFrame:
    """H4 as mergeable state: per ``by`` its chunks, characters and a quantile
    sketch of the lengths."""
    n = F.length("text").cast("long")
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(n).alias("n_chars"),
                                  F.kll_sketch_agg_bigint(n, LENGTH_SKETCH_K).alias("lengths"))


def merge_length_sketches(by: str, *increments: DataFrame) -> DataFrame:
    """The state of all increments, per ``by``."""
    both = increments[0]
    for more in increments[1:]:
        both = both.unionByName(more)
    return both.groupBy(by).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_chars").alias("n_chars"),
                                F.kll_merge_agg_bigint("lengths").alias("lengths"))


def length_quantiles(sketches: DataFrame, by: str, ps: list[float]) -> DataFrame:
    """``by, n_chunks, n_chars, p, n_at`` with the estimated length at each share ``p``."""
    return sketches.select(by, "n_chunks", "n_chars", F.explode(F.array(*(
        F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(p))).alias("n_at"))
        for p in ps))).alias("q")).select(by, "n_chunks", "n_chars", "q.p", "q.n_at")


def rank_errors(quantiles: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """Each estimated quantile with how far its true rank is off ``p``: none
    where ``p`` lies between the shares of shorter and of not longer chunks."""
    lengths = chunks.groupBy(by, F.length("text").cast("long").alias("n_at_len")).agg(F.count(F.lit(1)).alias("c"))
    below = F.sum(F.when(F.col("n_at_len") < F.col("n_at"), F.col("c")).otherwise(0)) / F.first("n_chunks")
    upto = F.sum(F.when(F.col("n_at_len") <= F.col("n_at"), F.col("c")).otherwise(0)) / F.first("n_chunks")
    counted = quantiles.join(lengths, by).groupBy(by, "p").agg(
        F.first("n_chunks").alias("n_chunks"), F.first("n_chars").alias("n_chars"), below.alias("below"), upto.alias("upto"))
    return counted.select(by, "n_chunks", "n_chars", "p",
                          F.greatest(F.col("below") - F.col("p"), F.col("p") - F.col("upto"), F.lit(0.0)).alias("rank_error"))
