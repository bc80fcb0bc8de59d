"""7. Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are laid end to end and cut into blocks
of equal size; a document belongs to the block it starts in. Block i (from 1)
of a source of weight w is released at slot floor((i-1)/w) and due by slot
ceil(i/w). Each slot goes to the released block that is due first (ties: by
source name). The weights add up to one, so every block meets its deadline, and
after t slots a source has less than one block more or less than w*t, until a
source has no blocks left. The mix is the slots up to there; later blocks are
scheduled on, at their own pace, but are marked as outside the mix.

The schedule needs the number of blocks per source only. There are at most
about ``MAX_BLOCKS`` of them, since blocks grow with the corpus, so it is made on
the driver in integers, and joined to the documents as a table. Sources are
never gathered in one task: a document's place is the running size within a
small hash bucket of its source plus the sizes of the buckets before, which are
summed across range partitions. The hash is of the doc_id, and of the text
where there is none, so that many rows without an id are spread.

Contract: a NULL source is the source ``''``; a NULL text has size 0; rows with
equal hash and doc_id are laid by size; rows with a NULL doc_id are placed too;
an empty table gives an empty result; ``select_mix`` returns the rows of the
mix in slot order with all their columns as they are, ``place`` ignores other
columns. A
source named in the weights that has no documents is left out, and one that
the weights do not name gets no slots and lies outside the mix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordered import running_sums
from quire.session import cut_lineage

MIN_BLOCK = 8_192      # characters
MAX_BLOCKS = 50_000
BUCKET_ROWS = 4_000
LARGEST_SHARE = 0.25   # of one source, with capped weights
SCALE = 10_000


def capped_weights(sizes: dict[str, int], largest: float = LARGEST_SHARE) -> dict[str, int]:
    """Target weights in proportion to the sources' sizes, but with no source
    above ``largest`` of the mix (as far as their number allows)."""
    sizes = {s: n for s, n in sizes.items() if n > 0}
    if len(sizes) * largest <= 1:
        return {s: 1 for s in sizes}
    capped: set[str] = set()
    while True:
        rest = sum(n for s, n in sizes.items() if s not in capped)
        room = SCALE - len(capped) * int(largest * SCALE)
        over = {s for s, n in sizes.items() if s not in capped and n * room > rest * int(largest * SCALE)}
        if not over:
            # integers in the ratios (largest : ... ) of the final shares
            return {s: int(largest * SCALE) * rest if s in capped else n * room for s, n in sizes.items()}
        capped |= over


def edf(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block from 0, slot) in slot order; slots nobody can use are skipped."""
    total = sum(weights[s] for s in blocks)
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in sorted(blocks) if blocks[s] and weights[s]]
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, slot
        slot += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))


def mix_length(blocks: dict[str, int], weights: dict[str, int]) -> int:
    """Slots until the first source has none of the blocks it is due."""
    total = sum(weights[s] for s in blocks)
    return min((blocks[s] * total // weights[s] for s in blocks if blocks[s] and weights[s]), default=0)


def _sized(docs: DataFrame, *held: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias("h"), *held)


def _placed(docs: DataFrame, weights: dict[str, int] | None, *held: str) -> DataFrame:
    """The rows of ``place`` with the columns ``held`` of ``docs`` besides."""
    spark = docs.sparkSession
    rows = cut_lineage(_sized(docs))
    bits = max(0, (max(1, rows.count()) // BUCKET_ROWS).bit_length())
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    # unsigned order of the hashes is the order of buckets and within them
    dealt = lambda x: x.withColumn("bucket", bucket).withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    sums = cut_lineage(dealt(rows).groupBy("source", "bucket").agg(F.sum("size").alias("total")))
    sizes = {r["source"]: r["total"] for r in sums.groupBy("source").agg(F.sum("total").alias("total")).collect()}
    block = max(MIN_BLOCK, -(-sum(sizes.values()) // MAX_BLOCKS))
    blocks = {s: max(1, -(-n // block)) for s, n in sizes.items()}
    target = blocks if weights is None else weights
    blocks_due = {s: n for s, n in blocks.items() if target.get(s)}
    length = mix_length(blocks_due, target)
    plan = spark.createDataFrame([(s, i, t, t < length) for s, i, t in edf(blocks_due, target)],
                                 "source string, block long, slot long, in_mix boolean")
    bases = running_sums(sums, "source", ["bucket"], {"base": F.col("total")}).drop("total")
    inside = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # columns that are held are read again: only the sizes are written
    laid = dealt(_sized(docs, *held) if held else rows)
    placed = laid.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .join(bases, ["source", "bucket"]) \
        .withColumn("block", F.floor((F.col("base") + F.col("inside")) / F.lit(block)).cast("long"))
    # a document of size 0 at the very end starts where the last block ends
    last = spark.createDataFrame([(s, n - 1) for s, n in blocks.items()], "source string, last long")
    return placed.join(F.broadcast(last), "source").withColumn("block", F.least("block", "last")) \
        .join(F.broadcast(plan), ["source", "block"], "left") \
        .select("doc_id", "source", "block", "slot", F.coalesce("in_mix", F.lit(False)).alias("in_mix"), "u", *held)


def place(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, source, block, slot, in_mix`` of every row; ``slot`` is NULL
    for a source without weight. ``weights``: relative, by source; by default
    the sources' own numbers of blocks, with which every row is in the mix."""
    return _placed(docs, weights)


def select_mix(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of the mix, in the order of their slots."""
    row = docs.select("*", F.struct(*(docs[c] for c in docs.columns)).alias("__mix_row"))
    return _placed(row, weights, "__mix_row").where("in_mix").orderBy("slot", "u", "doc_id") \
        .select(*(F.col("__mix_row")[c].alias(c) for c in docs.columns))
