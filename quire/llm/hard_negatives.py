"""Hard-negative mining with Kronecker-packed inner products.

A component x counts as the integer floor(256 x); the score of a row with an
anchor is their integer inner product (a shorter vector is filled up with
zeros), higher first, ties by smaller id (NULL last). An anchor's positives are
its first other rows of the same label; for each, the hard negatives are the
first rows of other labels whose score lies between 50 and 95 percent of the
positive's.

Products (``products``): the components of several candidates are biased to be
non-negative and put into separate fields of one wide integer, wide enough that
a whole inner product cannot leave its field. One multiplication per anchor
component then serves all these candidates; after the sum a second bias makes
every field non-negative, and shifts and masks give the exact scores. The wide
integers are doubles that hold integers below 2^53, which a matrix product keeps
exact in any order of summation; vectors too large for that go through Python's
unbounded integers in the same way.

Jobs: rows are packed into blocks inside their partitions (bounded rows); the
anchors' blocks are written once. Every pair of an anchor block and a row block
is a cell, formed by a join on (anchor partition, row partition) to which each
side is dealt out beforehand, so that no side is broadcast or collected and no
task holds more than a few blocks. Cells of a first pass compare equal labels
only and give the positives, a second pass all others against the positives'
bounds; every cell keeps the few best rows of each anchor, and a window ranks
these. All anchors meet all rows, as the search is stated: the work grows with
rows times anchors.

Edge cases: rows with a NULL label or vector, or a NULL, NaN or infinite
component, take no part. Of rows equal to the anchor in id, label and vector one
is the anchor itself, the others count. Repeated anchors give repeated results.
A negative positive score admits no negative, zero admits zero. No anchors or no
rows: no result. Scores beyond 38 digits are an error, and beyond 64 bits they
rank exactly but are NULL in the long columns.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ship
from quire.session import cut_lineage

ship(__name__)

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
BLOCK_ROWS, MIN_BLOCK_ROWS, BLOCK_BYTES = 8192, 1024, 4 << 20
ANCHOR_ROWS = 2048
LANE_BITS = 53                       # integers below 2^53 are exact in a double
ANCHORS_AT_ONCE = 128
GROUP = 16                           # candidates to one unbounded integer
SCORE = "decimal(38,0)"
BLOCK_DDL = "part int, n int, dim int, width int, ids array<long>, labels array<long>, data binary"


# -- scores -----------------------------------------------------------------

def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles where they are exact and scaled without loss, else Python integers."""
    with np.errstate(over="ignore"):
        got = np.floor(SCALE * x)
    if got.size == 0 or np.abs(got).max() < 2.0 ** LANE_BITS:
        return got
    exact = [int(math.floor(SCALE * v)) if math.isfinite(SCALE * v) else int(v) * int(SCALE) for v in x.ravel()]
    return np.array(exact, object).reshape(x.shape)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(anchors x rows) exact inner products of integer-valued matrices."""
    n, dim = rows.shape
    if not n or not len(anchors) or not dim:
        return np.zeros((len(anchors), n), np.int64)
    if rows.dtype != object and anchors.dtype != object:
        low = rows.min()
        most = rows.max() - low                              # biased components: 0 .. most
        against = np.abs(anchors).sum(axis=1).max()
        bits = max(1, math.frexp(max(1.0, most * against))[1])
        fields = LANE_BITS // bits
        if fields and abs(low) * against < 2.0 ** 48:
            return _lanes(rows, anchors, low, most, bits, min(fields, n))
    return _unbounded(rows, anchors)


def _lanes(rows, anchors, low, most, bits, fields):
    n, dim = rows.shape
    groups = -(-n // fields)
    biased = np.zeros((groups * fields, dim))
    biased[:n] = rows - low
    wide = np.zeros((groups, dim))
    for k in range(fields):                                  # candidate k * groups + i in field k of integer i
        wide += np.ldexp(biased[k * groups:(k + 1) * groups], bits * k)
    raise_by = most * np.maximum(-anchors, 0).sum(axis=1)    # no field is below minus this
    sums = anchors @ wide.T + (raise_by * sum(2.0 ** (bits * k) for k in range(fields)))[:, None]
    sums = sums.astype(np.int64)
    back = (low * anchors.sum(axis=1) - raise_by).astype(np.int64)[:, None]
    mask = (1 << bits) - 1
    out = np.empty((len(anchors), groups * fields), np.int64)
    for k in range(fields):
        out[:, k * groups:(k + 1) * groups] = ((sums >> (bits * k)) & mask) + back
    return out[:, :n]


def _unbounded(rows, anchors):
    """The same with Python integers as the wide ones, ``GROUP`` candidates in each."""
    rows = [[int(v) for v in r] for r in rows]
    out = np.empty((len(anchors), len(rows)), object)
    low = min(min(r) for r in rows)
    most = max(max(r) for r in rows) - low
    wanted = [[int(v) for v in a] for a in anchors]
    bits = max(1, (most * max(sum(map(abs, a)) for a in wanted)).bit_length() + 1)
    mask = (1 << bits) - 1
    for at in range(0, len(rows), GROUP):
        some = rows[at:at + GROUP]
        wide = [sum((r[d] - low) << (bits * k) for k, r in enumerate(some)) for d in range(len(some[0]))]
        ones = sum(1 << (bits * k) for k in range(len(some)))
        for j, a in enumerate(wanted):
            up = most * sum(-v for v in a if v < 0)
            total = sum(w * v for w, v in zip(wide, a)) + up * ones
            back = low * sum(a) - up
            for k in range(len(some)):
                out[j, at + k] = ((total >> (bits * k)) & mask) + back
    return out


# -- blocks -----------------------------------------------------------------

def _pack(ids, labels, vectors, part: int) -> tuple:
    """Rows in order of id (NULL last), which is the order of ties."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    dim = max((len(v) for v in vectors), default=0)
    x = np.zeros((len(ids), dim))
    for at, i in enumerate(order):
        x[at, :len(vectors[i])] = vectors[i]
    x = x + 0.0                                              # minus zero is zero
    half = x.astype(np.float32)
    with np.errstate(over="ignore"):
        small = bool((half == x).all())
    return (part, len(ids), dim, 4 if small else 8, [ids[i] for i in order], [labels[i] for i in order],
            (half if small else x).tobytes())


def _packer(most_rows: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        ids, labels, vectors, held = [], [], [], 0
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        names = [c.split()[0] for c in BLOCK_DDL.split(", ")]

        def block():
            row = _pack(ids, labels, vectors, part)
            ids.clear(), labels.clear(), vectors.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (vid, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                v = flat[ends[i]:ends[i + 1]]
                if ids and (len(ids) >= most_rows or held + 8 * len(v) > BLOCK_BYTES):
                    yield block()
                    held = 0
                ids.append(vid), labels.append(label), vectors.append(v)
                held += 8 * len(v)
        if ids:
            yield block()

    return run


def _matrix(n: int, dim: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if width == 4 else "<f8").reshape(n, dim).astype(np.float64)


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both filled up with zero columns to one width."""
    dim = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (a, b))


def taking_part(vectors: DataFrame, vec: str, label: str) -> Column:
    def finite(x: Column) -> Column:
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    return F.col(label).isNotNull() & F.col(vec).isNotNull() & F.forall(vec, finite)


# -- cells ------------------------------------------------------------------

def _keys(scores: np.ndarray, n: int) -> np.ndarray | None:
    """Distinct keys in the order of (score, smaller position first); None for
    scores that leave no room for the position."""
    if scores.dtype == object or (scores.size and np.abs(scores).max() >= 1 << 48):
        return None
    return scores * n + (n - 1 - np.arange(n))


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, position) of each anchor's k best positions."""
    q, n = scores.shape
    k = min(k, n)
    keys = _keys(scores, n)
    if keys is None:
        at = [sorted(range(n), key=lambda i: (-scores[j, i], i))[:k] for j in range(q)]
        return np.repeat(np.arange(q), k), np.array(at, np.int64).reshape(-1)
    at = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (q, 1))
    return np.repeat(np.arange(q), k), at.reshape(-1)


def _decimals(values) -> pa.Array:
    if getattr(values, "dtype", None) != object:
        return pa.array(np.asarray(values, np.int64)).cast(pa.decimal128(38, 0))
    return pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _cells(batches):
    """The (anchor block, row block) cells of joined rows."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            yield {c: b.column(j)[i].as_py() for j, c in enumerate(names)}


def _nullable(ids: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([0 if v is None else v for v in ids], np.int64), np.array([v is None for v in ids], bool)


def _positive_kernel(batches):
    """Per cell and anchor its best rows of the same label, one more than asked
    for as the anchor itself may be among them."""
    for c in _cells(batches):
        x, a = _fit(_matrix(c["n"], c["dim"], c["width"], c["data"]), _matrix(c["a_n"], c["a_dim"], c["a_width"], c["a_data"]))
        rows, anchors = whole(x), whole(a)
        ids, nulls = _nullable(c["ids"])
        a_ids, labels, a_labels = np.array(c["a_ids"], np.int64), np.array(c["labels"]), np.array(c["a_labels"])
        out = []
        for label in np.intersect1d(labels, a_labels):
            r = np.flatnonzero(labels == label)
            for q in np.array_split(mine := np.flatnonzero(a_labels == label), -(-len(mine) // ANCHORS_AT_ONCE)):
                scores = products(rows[r], anchors[q])
                j, at = _best(scores, POSITIVES + 1)
                itself = (ids[r[at]] == a_ids[q[j]]) & ~nulls[r[at]] & (x[r[at]] == a[q[j]]).all(axis=1)
                out.append((q[j], scores[j, at], r[at], itself))
        if not out:
            continue
        q, s, r, itself = (np.concatenate([o[k] for o in out]) for k in range(4))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(q), c["ab"], np.int64)), pa.array(q.astype(np.int32)), _decimals(s),
            pa.array(ids[r], pa.int64(), mask=nulls[r]), pa.array(itself)], names=["ab", "row", "score", "id", "itself"])


def _negative_kernel(batches):
    """Per cell, anchor and positive the best rows of other labels in its bounds."""
    for c in _cells(batches):
        x, a = _fit(_matrix(c["n"], c["dim"], c["width"], c["data"]), _matrix(c["a_n"], c["a_dim"], c["a_width"], c["a_data"]))
        rows, anchors, n = whole(x), whole(a), c["n"]
        ids, nulls = _nullable(c["ids"])
        labels, a_labels = np.array(c["labels"]), np.array(c["a_labels"])
        bounds = {}
        for p in c["positives"]:
            score = int(p["score"])
            if score >= 0:
                bounds.setdefault(p["row"], []).append(
                    (p["p"], p["id"], score, -(-score * LEAST_PERCENT // 100), score * MOST_PERCENT // 100))
        q_all = np.array(sorted(bounds), np.int64)
        out = []                                             # (row, p, positive, its score, position, score)
        for q in np.array_split(q_all, -(-len(q_all) // ANCHORS_AT_ONCE)) if len(q_all) else ():
            scores = products(rows, anchors[q])
            keys = _keys(scores, n)
            if keys is None:
                for j, row in enumerate(q):
                    order = sorted((i for i in range(n) if labels[i] != a_labels[row]), key=lambda i: (-scores[j, i], i))
                    for p, pid, ps, low, high in bounds[row]:
                        some = [i for i in order if low <= scores[j, i] <= high][:NEGATIVES]
                        out += [(row, p, pid, ps, i, scores[j, i]) for i in some]
                continue
            keys[labels[None, :] == a_labels[q][:, None]] = -1
            for k in range(POSITIVES):
                have = [j for j, row in enumerate(q) if len(bounds[row]) > k]
                if not have:
                    break
                mine = [bounds[q[j]][k] for j in have]
                top, low = (np.array([min(m[i], 1 << 48) for m in mine], np.int64) for i in (4, 3))
                some = keys if len(have) == len(q) else keys[have]
                left = np.where(some < ((top + 1) * n)[:, None], some, -1)
                for _ in range(NEGATIVES):
                    at = left.argmax(axis=1)
                    best = left[np.arange(len(have)), at]
                    for j in np.flatnonzero(best >= low * n):
                        if best[j] >= 0:
                            p, pid, ps, _, _ = mine[j]
                            out.append((q[have[j]], p, pid, ps, at[j], int(best[j]) // n))
                    left[np.arange(len(have)), at] = -1
        if not out:
            continue
        row, p, pid, ps, at, s = zip(*out)
        at = np.array(at, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(row), c["ab"], np.int64)), pa.array(np.array(row, np.int32)), pa.array(p, pa.int32()),
            pa.array([c["a_ids"][i] for i in row], pa.int64()), pa.array(pid, pa.int64()),
            _decimals(np.array(ps, object)), pa.array(ids[at], pa.int64(), mask=nulls[at]), _decimals(np.array(s, object))],
            names=["ab", "row", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec: str = "embedding",
         label: str = "label") -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds (rows without an
    id are never anchors): ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score`` and ``positive_rank``."""
    rows = vectors.where(taking_part(vectors, vec, label)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vec).cast("array<double>").alias("vec"), (F.col(id_col).isNotNull() & anchors).alias("asks"))
    n, n_asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    # blocks fit for the number of rows: some dozens at least, of bounded size
    size = min(BLOCK_ROWS, max(MIN_BLOCK_ROWS, n // 32))
    slots, bands = max(1, -(-n // size)), max(1, -(-n_asking // ANCHOR_ROWS))
    blocks = rows.select("id", "label", "vec").coalesce(slots).mapInArrow(_packer(size), BLOCK_DDL)
    asking = rows.where("asks").select("id", "label", "vec").coalesce(bands).mapInArrow(_packer(ANCHOR_ROWS), BLOCK_DDL)
    asking = cut_lineage(asking.select(F.col("part").alias("band"), F.monotonically_increasing_id().alias("ab"), *(
        F.col(c).alias(f"a_{c}") for c in ("n", "dim", "width", "ids", "labels", "data"))))

    def cells(anchor_blocks: DataFrame) -> DataFrame:
        """Each side dealt to every partition number of the other, then joined."""
        left = anchor_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        right = blocks.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        return left.join(right.hint("shuffle_hash"), ["band", "part"]).drop("band", "part")

    found = cells(asking).mapInArrow(_positive_kernel, f"ab long, row int, score {SCORE}, id long, itself boolean")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    anchor = Window.partitionBy("ab", "row")
    ranked = found.withColumn("r", F.row_number().over(anchor.orderBy(*order))).where(F.col("r") <= POSITIVES + 1)
    # the anchor itself is the first row equal to it; those after it move up by one
    passed = F.sum(F.col("itself").cast("int")).over(anchor.orderBy("r"))
    positives = ranked.withColumn("passed", passed).where(~(F.col("itself") & (F.col("passed") == 1))) \
        .withColumn("p", F.col("r") - (F.col("passed") > 0).cast("int")).where(F.col("p") <= POSITIVES) \
        .groupBy("ab").agg(F.array_sort(F.collect_list(F.struct("row", "p", "score", "id"))).alias("positives"))
    bounded = cut_lineage(asking.join(positives, "ab"))
    near = cells(bounded).mapInArrow(_negative_kernel, f"ab long, row int, p int, anchor_id long, positive_id long, "
                                                       f"positive_score {SCORE}, negative_id long, negative_score {SCORE}")
    best = Window.partitionBy("ab", "row", "p").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").try_cast("long").alias("positive_score"),
        F.col("negative_score").try_cast("long").alias("negative_score"), F.col("p").alias("positive_rank"))
