"""4. N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Two sets of Jaccard
similarity t or more differ in at most (1-t)/(1+t) * (|A|+|B|) elements.
Documents are compared per size band: a document takes part in its own band
and, if it may have partners there, in the next larger one. A band's largest
size gives the most elements, D, in which two linked sets of it can differ.

Each band hashes elements to M > D blocks and XORs the hashes of a block's
elements. An element in one of the sets only changes one block, so linked sets
agree in M - D blocks at least, and it is enough to join on (band, block, XOR).
Agreement in empty blocks says nothing and is not joined on: a set with M - D
or more empty blocks is hashed again with another seed, and so is every set
that could agree with it in empty blocks alone. No link is lost.

Within a bucket of equal keys the first document is compared with every other
one. Verified links are joined to components, and only buckets that still hold
several components are looked at again: all pairs of different components in
small ones. Large ones hold documents that share a passage and little else, or
several groups of near copies; their members are dealt anew by their rarest
shingles, of which linked sets share one, so that a common passage brings
nobody together. Buckets that are still large and hold several components, as
of copies that differ by a little more than a link allows, are cut into cells
of at most ``CELL`` members a side. A cell's sketches are compared inside a
task, and only pairs that these allow to be linked are written: first those
that would join the cell's components, nearest first, then, once these are
verified, all between components left. Copies of a text, or of nearly one, cost
a pair each and not a pair for every two.

A pair's parity sketches (one bit per element, XOR-ed) are compared first:
their Hamming distance is a lower bound of the symmetric difference. What is
left is verified on the texts' whole shingle sets.

Contract: words are runs of non-space bytes after lower-casing A-Z; a text of
fewer words than a shingle has their whole sequence as its one shingle; a NULL
text, or one without words, has the empty set and is linked with nothing. Rows
are documents: rows with a repeated doc_id are compared like any others, and
rows with a NULL doc_id take part but never name a component. Equal sets are
one node, known by a 64-bit hash; so are shingles. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordCache, per_process, ship, slices
from quire.llm.graph import components
from quire.session import cut_lineage

ship(__name__)

WIDTH = 4           # words per shingle
PERCENT = 85        # least similarity
GROWTH = 1.6        # of band limits
SMALL = 24          # nodes of a bucket whose pairs are compared at once
CELL = 2048         # nodes on each side of a cell of a larger bucket
CELL_BYTES = 4 << 20    # of sketches on each side
SEEDS = 8           # times a set with many empty blocks is hashed again
CELLS = 1 << 20     # counters of frequent shingles
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = per_process("shingle words", lambda: WordCache(xxhash.xxh64_intdigest, 500_000))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, len(h) if len(h) < width else width, np.uint64)
        for k in range(min(width, len(h))):
            x = _mix(x * _ODD[1] + h[k:k + n])
    return np.unique(x)


def bands(largest: int, percent: int = PERCENT, growth: float = GROWTH) -> list[tuple[int, int, int]]:
    """(least size, largest size, most differing elements of a linked pair)."""
    out, low = [], 1
    high = max(1, (100 + percent) // (2 * (100 - percent)))  # up to here linked sets are equal
    while True:
        out.append((low, high, 2 * (100 - percent) * high // (100 + percent)))
        if high >= largest:
            return out
        low, high = high + 1, max(high + 1, int(high * max(growth, 101 / percent)))


def block_keys(items: np.ndarray, band: int, differ: int) -> np.ndarray:
    """Join keys of a set in a band; none where linked sets are equal."""
    if not differ or not len(items):
        return np.empty(0, np.uint64)
    spare = 1 + differ // 8
    blocks, out = differ + spare, []
    for seed in range(SEEDS):
        x = np.sort(_mix(items, band * SEEDS + seed + 1))
        block = (x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(block, prepend=np.uint64(1 << 40)) != 0)
        xor = np.bitwise_xor.reduceat(x, starts)
        with np.errstate(over="ignore"):
            out.append(_mix(xor * _ODD[2] + block[starts] * _ODD[3], band * SEEDS + seed + 1))
        if blocks - len(starts) < spare:  # agreement in empty blocks alone is not enough to be linked
            return np.concatenate(out)
    out.append(_mix(np.array([band], np.uint64), 1 << 20))
    return np.concatenate(out)


def keys_of(items: np.ndarray, limits: list[tuple[int, int, int]], percent: int = PERCENT) -> np.ndarray:
    n, out = len(items), []
    for band, (low, high, differ) in enumerate(limits):
        if low <= n <= high or (n < low and 100 * n >= percent * low):
            out.append(block_keys(items, band, differ))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch_of(items: np.ndarray) -> bytes:
    """One parity bit per cell; cells are a power of two, twice the set or more."""
    cells = max(64, 1 << int(2 * len(items) - 1).bit_length()) if len(items) else 64
    parity = np.bincount((items & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two sketches; the longer one is folded, which XORs its cells."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def describe(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, row, n, node, sketch, keys`` of every row. Of equal sets met
    in one task only the first one carries sketch and keys."""
    limits = bands(1 << 40, percent)

    def kernel(batches):
        met: set[int] = set()
        for b in slices(batches):
            n, nodes, sketches, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                items = shingle_set(t, width)
                node = xxhash.xxh3_64_intdigest(items.tobytes())
                n.append(len(items)), nodes.append(node if len(items) else None)
                if node in met or not len(items):
                    sketches.append(None), keys.append(None)
                    continue
                if len(met) >= 1_000_000:
                    met.clear()
                met.add(node)
                sketches.append(sketch_of(items)), keys.append(keys_of(items, limits, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()),
                 pa.array([None if x is None else x - (1 << 64) * (x >> 63) for x in nodes], pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "node", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key().alias("row"))
    return cut_lineage(rows.mapInArrow(
        kernel, "doc_id long, row long, n long, node long, sketch binary, keys array<long>"))


def _known(table: DataFrame) -> DataFrame:
    """``node, s, n, row``: sketch, size and one row of each distinct set."""
    return table.where("sketch is not null").groupBy("node") \
        .agg(F.first("sketch").alias("s"), F.first("n").alias("n"), F.min("row").alias("row"))


def _texts(docs: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = known.join(nodes, "node").select("node", "row")
    return docs.select(_row_key().alias("row"), "text").join(rows, "row").dropDuplicates(["node"]).select("node", "text")


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, percent: int, width: int) -> DataFrame:
    """The linked ones of the pairs ``a, b``."""
    most = 100 - percent, 100 + percent

    def near(batches):
        for b in batches:
            ok = [hamming(x, y) * most[1] <= most[0] * (m + n) for x, y, m, n in
                  zip(*(b.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(batches):
        for b in slices(slices(batches, "ta", 8 << 20), "tb", 8 << 20):
            sets, ok = {}, []
            for x, y, ta, tb in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                for k, t in ((x, ta), (y, tb)):
                    if k not in sets:
                        sets[k] = shingle_set(t, width)
                ok.append(linked(sets[x], sets[y], percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: known.select(F.col("node").alias(x), F.col("s").alias("s" + x), F.col("n").alias("n" + x))
    close = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    close = cut_lineage(close.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(near, "a long, b long"))
    texts = _texts(docs, known, close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias("t" + x))
    # the pair's other document first: only the first one of a bucket can be in very many pairs
    return cut_lineage(close.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb")
                       .mapInArrow(verify, "a long, b long"))


def _sketch_pairs(sketches: list[bytes], sizes: np.ndarray, comps: np.ndarray, one: np.ndarray, other: np.ndarray,
                  percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, distance`` of the pairs of an index in ``one`` and one in
    ``other``, in different components, that sizes and sketches allow to be
    linked. A pair that lies in both orders is given once, ``i < j``."""
    widths = np.array([len(x) for x in sketches])
    found = [], [], []
    for w in np.unique(widths[one]):
        left = one[widths[one] == w]
        for v in np.unique(widths[other]):
            right, least = other[widths[other] == v], min(w, v)

            def folded(at, width):
                x = np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), width // least, least // 8)
                return np.bitwise_xor.reduce(x, axis=1)

            b = folded(right, v)
            for i, a in zip(left, folded(left, w)):
                m, n = np.minimum(sizes[i], sizes[right]), np.maximum(sizes[i], sizes[right])
                fit = np.flatnonzero((comps[right] != comps[i]) & (100 * m >= percent * n))
                d = np.bitwise_count(b[fit] ^ a).sum(axis=1, dtype=np.int64)
                ok = d * (100 + percent) <= (100 - percent) * (sizes[i] + sizes[right[fit]])
                j = right[fit[ok]]
                found[0].append(np.minimum(i, j)), found[1].append(np.maximum(i, j)), found[2].append(d[ok])
    i, j, d = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in found)
    _, first = np.unique(i * len(sketches) + j, return_index=True)
    return i[first], j[first], d[first]


def _joining(i: np.ndarray, j: np.ndarray, d: np.ndarray, comps: np.ndarray) -> list[int]:
    """Positions of the pairs that join components, nearest first: a forest."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for k in np.argsort(d, kind="stable"):
        x, y = top(int(comps[i[k]])), top(int(comps[j[k]]))
        if x != y:
            up[x] = y
            out.append(int(k))
    return out


def _cell_pairs(members: DataFrame, known: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``a, b`` of the members ``key, node, comp`` of one bucket each in
    different components whose sketches allow a link; with ``forest`` only
    those that would join the components of a cell. A bucket's members are
    dealt into parts, and each two parts meet in a cell."""
    sized = cut_lineage(members.select("key", "node", "comp").join(known.select("node", "s", F.col("n").alias("size")), "node"))
    parts = sized.groupBy("key").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(CELL), F.sum(F.octet_length("s")) / F.lit(CELL_BYTES))).cast("int").alias("parts"))
    dealt = sized.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                "part", "node", "comp", "s", "size")

    def compare(cell: pa.Table) -> pa.Table:
        part, node, comp, size, lo, hi = (cell.column(c).to_numpy() for c in ("part", "node", "comp", "size", "lo", "hi"))
        i, j, d = _sketch_pairs(cell.column("s").to_pylist(), size, comp, np.flatnonzero(part == lo[0]),
                                np.flatnonzero(part == hi[0]), percent)
        if forest:
            best = _joining(i, j, d, comp)
            i, j = i[best], j[best]
        a, b = node[i], node[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def _rare_keys(docs: DataFrame, known: DataFrame, nodes: DataFrame, percent: int, width: int) -> DataFrame:
    """``node, key``: the rarest shingles of each of the ``nodes``, one more
    than a linked set may lack. In any order that is the same for all sets,
    linked sets share one of these. Shingles are ordered by whether their cell
    of ``CELLS`` is met often, then by hash: what a task has met thrice is
    counted over all tasks, and a fixed number of cells comes to the driver."""
    texts = cut_lineage(_texts(docs, known, nodes))

    def count(batches):
        cells = np.zeros(CELLS, np.int32)
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                cells[(shingle_set(t, width) >> np.uint64(20)) % np.uint64(CELLS)] += 1
        often = np.flatnonzero(cells >= 3)
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(cells[often], pa.int64())], names=["cell", "n"])

    common = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(CELLS, np.uint32)
    for cell, n in common:
        weight[cell] = min(n, 1 << 30)
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def prefixes(batches):
        for b in slices(batches):
            keys = []
            for t in b.column("text").to_pylist():
                items = shingle_set(t, width)
                order = np.lexsort((items, shared.value[(items >> np.uint64(20)) % np.uint64(CELLS)]))
                most = len(items) - (-(-percent * len(items) // 100)) + 1
                keys.append(_mix(items[order[:most]], 1 << 21).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    return texts.mapInArrow(prefixes, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _buckets(occurs: DataFrame) -> DataFrame:
    """``key, head, node``: members of the keys of several nodes."""
    crowded = occurs.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")) \
        .where("head <> tail").select("key", "head")
    return cut_lineage(occurs.join(crowded, "key").select("key", "head", "node").distinct())


def link(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest doc_id
    that links lead to, its own included."""
    return _named(*_linked(docs, percent, width))


def keep_first(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows, all columns as they are, with one of each component only: the
    one of least doc_id (NULL last), of these the one of least row key, of rows
    equal in doc_id and text any. Rows without words are linked with nothing
    and all stay."""
    table, found = _linked(docs, percent, width)
    rows = table.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("node").alias("node"), F.count("*").alias("same"))
    comps = rows.where("node is not null").withColumn("comp", F.col("node")) if found is None else \
        rows.where("node is not null").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = comps.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "same")).alias("first"))
    kept = cut_lineage(first.select(F.col("first.row").alias("__row"), F.col("first.same").alias("__same")).union(
        rows.where("node is null").select("row", F.lit(1).cast("long"))))
    held = docs.withColumn("__row", _row_key()).join(kept, "__row")
    return held.where("__same = 1").union(held.where("__same > 1").dropDuplicates(["__row"])).select(*docs.columns)


def _linked(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame | None]:
    """The table of ``describe`` and the components of its nodes."""
    table = describe(docs, percent, width)
    known = cut_lineage(_known(table))
    buckets = _buckets(table.where("keys is not null").select("node", F.explode("keys").alias("key")))
    links, found = None, None
    for last in (False, True):
        stars = buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        new = _verified(_between(stars.distinct(), found), docs, known, percent, width)
        links = new if links is None else links.union(new)
        found = components(links)
        open_ = _open(buckets, found)
        part = open_.where(f"n <= {SMALL}")
        left, right = (part.select("key", F.col("node").alias(x), F.col("comp").alias("c" + x)) for x in "ab")
        pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
        new = _verified(pairs, docs, known, percent, width)
        if not new.isEmpty():
            links = links.union(new)
            found = components(links)
        large = open_.where(f"n > {SMALL}")
        if large.isEmpty():
            break
        if not last:
            # the heads of large buckets have been compared with all members
            buckets = _buckets(_rare_keys(docs, known, large.select("node").distinct(), percent, width))
            continue
        for forest in (True, False):
            large = _open(buckets, found).where(f"n > {SMALL}")
            new = _verified(_cell_pairs(large, known, percent, forest), docs, known, percent, width)
            if not new.isEmpty():
                links = links.union(new)
                found = components(links)
    return table, found


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    if found is None:
        return pairs
    side = lambda x: found.select(F.col("node").alias(x), F.col("comp").alias("c" + x))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left") \
        .where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _open(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members, heads aside, of the buckets where these are in several
    components: ``key, node, comp, n``. A head has been compared with all."""
    rest = buckets.where("node <> head").select("key", "node")
    if found is not None:
        rest = rest.join(found, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    else:
        rest = rest.withColumn("comp", F.col("node"))
    several = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")) \
        .where("lo <> hi").select("key", "n")
    return cut_lineage(rest.join(several, "key").select("key", "node", "comp", "n"))


def _named(table: DataFrame, found: DataFrame | None) -> DataFrame:
    rows = table.select("doc_id", "n", "node")
    if found is not None:
        rows = rows.join(found, "node", "left").select("doc_id", "n", "node", F.coalesce("comp", "node").alias("comp"))
    else:
        rows = rows.withColumn("comp", F.col("node"))
    rows = rows.select("doc_id", "n", "comp")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                   F.coalesce("first", "doc_id").alias("component_id"))
