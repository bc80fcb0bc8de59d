"""9. Document fingerprints: SpotSigs.

A spot signature is an anchor, a very common word, with the next content words
after it. A document's fingerprint is the set of its signatures, written as
sorted 32-bit hashes in base64. Running text holds anchors everywhere, lists
and junk few, so every content word whose hash falls on one of sixteen cells is
an anchor too, and so is the start of the text; both depend on nearby words
only, so an edit changes the signatures around it and no others. A text without
words is its own one signature.

Fingerprints are compared by Jaccard similarity. ``similar_pairs`` finds all
pairs of a table that reach a similarity: sets are partitioned by length, as the
ratio of two lengths bounds the similarity, so that a set meets its own
partition and the next one only; inside these an inverted index of each set's
rarest signatures (as many as a similar pair cannot all differ in) gives the
pairs that are counted. ``compare_neighbours`` counts given pairs as they are.

Contract: a NULL text is the empty text; equal texts have equal fingerprints;
texts are read whole, in time linear in their length (but for sorting);
documents are ordered by doc_id, then a hash of the text, NULL ids first, and
every row has its own place in that order, equal rows included; the next document after the
last one is the first (a lone document is its own next); rows with equal
fingerprints are one class, whatever their ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WordCache, per_process, ship, slices
from quire.session import cut_lineage

ship(__name__)

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of and to in is it that was are for on as with be by this from at or "
    "der die das und ein eine ist den von zu mit im auf sich nicht für des dem "
    "le la les de du des un une et est que qui pour dans en sur avec pas au "
    "el los las del y se por con una para al es lo"
).split()
_PUNCT = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_START = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _classes() -> WordCache:
    """word -> 64-bit hash whose last bit tells an anchor."""
    anchors = {a.encode() for a in ANCHORS}
    return WordCache(lambda w: xxhash.xxh64_intdigest(w) & (_MASK - 1) | (w in anchors), 500_000)


def _chain(anchor, first, second) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = anchor * np.uint64(0x9E3779B97F4A7C15) ^ first * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) ^ second * np.uint64(0x165667B19E3779F9)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)).astype(np.uint32)


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit spot signatures, one at least."""
    raw = text.encode()
    words = raw.lower().translate(None, _PUNCT).split()
    if not words:
        return np.array([xxhash.xxh32_intdigest(raw)], np.uint32)
    known = per_process("spot classes", _classes)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    common = h & np.uint64(1) == 1
    content = h[~common]
    if not len(content):
        content = h
    after = np.cumsum(~common)[common]  # of the content words, the first one after each anchor
    own = np.flatnonzero((content >> np.uint64(20)) & np.uint64(15) == 0)
    anchor = np.concatenate([h[common], content[own]])
    first = np.concatenate([after, own + 1])
    whole = first + 1 < len(content)
    anchor, first = anchor[whole], first[whole]
    start = np.array([_START], np.uint64)
    none = np.zeros(1, np.uint64)
    parts = [_chain(anchor, content[first], content[first + 1]), _chain(start, content[:1], none)]
    if len(content) > 1:
        parts.append(_chain(start, content[:1], content[1:2]))
    return np.unique(np.concatenate(parts))


def write(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def parse(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the next one."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _row(doc_id, text: str, sigs: np.ndarray, following: str, next_sigs: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_sigs = signatures(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), write(sigs), write(changed_sigs),
            likeness(sigs, changed_sigs), likeness(sigs, next_sigs))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def kernel(batches):
        for b in slices(batches):
            prints = [write(signatures(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, fingerprint string")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of every row: a digest of its fingerprint, shared by
    the rows of equal fingerprints."""
    return fingerprints(docs).select("doc_id", F.md5("fingerprint").alias("class_id"))


def length_bounds(percent: int, most: int = 1 << 31) -> list[int]:
    """Least set lengths of the partitions: of two sets whose lengths are within
    ``percent`` of each other the larger is in the smaller one's partition or the
    next. No partition is narrower than for 80, which keeps them few."""
    bounds, widest = [1], min(percent, 80)
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 100 // widest + 1)
    return bounds


def similar_pairs(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``class_a, class_b, n_both, n_either`` of every two different classes (see
    ``classes``; ``class_a`` < ``class_b``) that share at least ``percent`` of the
    signatures of both."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is from 1 to 100: {percent}")

    def kernel(batches):
        for b in slices(batches):
            sets = [signatures(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(write(s).encode()).hexdigest() for s in sets], pa.string()),
                 pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["c", "sigs"])

    known = cut_lineage(docs.select("text").mapInArrow(kernel, "c string, sigs array<long>")
                        .groupBy("c").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs").cast("long")))
    each = known.select("c", "n", F.explode("sigs").alias("sig"))
    # two sets of at least percent in common share one of these many rarest signatures
    prefix = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    rarest = Window.partitionBy("c").orderBy("held_by", "sig")
    part = F.size(F.filter(F.array(*map(F.lit, length_bounds(percent))), lambda b: b <= F.col("n")))
    index = cut_lineage(each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1"), "sig")
                        .withColumn("lonely", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("c")))
                        .withColumn("at", F.row_number().over(rarest) + F.col("lonely"))
                        .where(F.col("at") <= prefix).select("c", "n", "sig", part.alias("part")))
    probes = index.select(F.col("c").alias("small"), F.col("n").alias("m"), "sig",
                          F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = probes.join(index, ["sig", "part"]) \
        .where(((F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("small") < F.col("c"))) & (100 * F.col("m") >= percent * F.col("n"))) \
        .select(F.least("small", "c").alias("class_a"), F.greatest("small", "c").alias("class_b")).distinct()
    both = F.size(F.array_intersect("a", "b")).cast("long")
    counted = met.join(known.select(F.col("c").alias("class_a"), F.col("sigs").alias("a")), "class_a") \
        .join(known.select(F.col("c").alias("class_b"), F.col("sigs").alias("b")), "class_b") \
        .select("class_a", "class_b", both.alias("n_both"), (F.size("a") + F.size("b")).cast("long").alias("sum"))
    return counted.withColumn("n_either", F.col("sum") - F.col("n_both")) \
        .where(100 * F.col("n_both") >= percent * F.col("n_either")).drop("sum")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document.

    The texts are dealt once, by ranges of the order. A range's last document
    needs the first one of the next range: ranges start at documents that are
    there, so the first document of each is sent to the range before as well.
    The starts are found on the narrow order columns alone; one is kept for
    each partition of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # a number of its own: the narrow rows alone would be coalesced into few ranges
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = cut_lineage(rows.select("doc_id", "tie").repartitionByRange(n, *order)
                         .groupBy(F.spark_partition_id().alias("p"))
                         .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("s"))) \
        .select("s.doc_id", "s.tie").orderBy(*order).collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    # equal rows never straddle a start, as a range begins at all rows equal to it
    n, least = len(starts), -(1 << 63)
    ids = np.array([least if r[0] is None else r[0] for r in starts], np.int64)
    ties = np.array([r[1] for r in starts], np.int64)
    known = np.array([r[0] is not None for r in starts])
    bounds = spark.sparkContext.broadcast((known, ids, ties))

    def route(batches):
        """A row's range; and the range before, for a range's first document."""
        known, ids, ties = bounds.value
        table = list(zip(known.tolist(), ids.tolist(), ties.tolist()))
        for b in batches:
            at, row, extra = [], [], []
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                key = (d is not None, least if d is None else d, t)
                p = bisect.bisect_right(table, key) - 1
                at.append(max(p, 0)), row.append(i), extra.append(False)
                if p >= 0 and table[p] == key:
                    at.append((p - 1) % len(table)), row.append(i), extra.append(True)
            got = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(extra), *got.columns],
                                             names=["at", "extra", "doc_id", "text", "tie"])

    def kernel(batches):
        held = at = None  # the document that waits for its next one
        for b in slices(batches):
            out = []
            for p, extra, d, t in zip(*(b.column(c).to_pylist() for c in ("at", "extra", "doc_id", "text"))):
                if p != at:
                    held, at = None, p
                if held == "done":
                    continue
                sigs = signatures(t)
                if held is not None:
                    out.append(_row(*held, t, sigs))
                held = "done" if extra else (d, t, sigs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _TYPES)],
                                                 names=[c.split()[0] for c in RESULT.split(", ")])

    dealt = rows.mapInArrow(route, "at long, extra boolean, doc_id long, text string, tie long")
    return dealt.repartition(n, "at").sortWithinPartitions("at", "extra", F.col("doc_id").asc_nulls_first(), "tie") \
        .mapInArrow(kernel, RESULT)
