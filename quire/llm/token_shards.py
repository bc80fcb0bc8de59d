"""1. Token ids as binary shards with a minimal perfect hash index.

``write_shards`` sorts the documents by key, encodes them with the tokenizers
library, appends an end id and writes each range of keys as one shard:

* ``.bin``: the raw ids of its documents one after the other, little-endian,
  two bytes each when the vocabulary allows it, else four;
* ``.idx``: a JSON header and raw arrays: the keys and id offsets in file
  order, and a minimal perfect hash of the distinct keys (levels of bit sets:
  keys alone in their cell of a level stop there, the others go on to the next
  one; a key's slot is the rank of its bit) with a 32-bit fingerprint, the
  first document and the number of documents of each slot.

A lookup costs a constant number of probes whatever the shard holds; a key
that is not there fails the fingerprint (and the stored key).

A shard's file names carry the task attempt. The manifest (one row per shard,
written by Spark's own committer) names the attempts that count, so a lost or
repeated task leaves files that nothing refers to. Files go through
``pyarrow.fs``, to whatever store the folder's URI names.

Contract: a NULL text is the empty text and gives the end id alone; rows with
equal keys are kept, ordered by a hash of their text, and a lookup returns all
of them; rows with a NULL key come first, count in the offsets and are found
by no key; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import per_process, ship, slices
from quire.llm.pretokens import pieces
from quire.session import checkpoint_dir, cut_lineage

ship(__name__)

MANIFEST_DDL = ("shard int, path string, n_docs long, n_null long, n_tokens long, "
                "min_key long, max_key long, id_bytes int")
END_ID = 0
_GAMMA, _LEVELS = 2.0, 64


# -- encoding ---------------------------------------------------------------

class Encoder:
    """The tokenizers library over the pieces of texts, which are independent of
    each other (see ``pretokens``); ids of frequent pieces are kept."""

    KEPT = 600_000      # pieces; beyond it those of the present slice stay
    GLUED = 16_384      # pieces in one call of the library

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(spec)
        pre, model = conf.get("pre_tokenizer") or {}, conf.get("model") or {}
        self.added = [t["content"] for t in conf.get("added_tokens", [])]
        self.cut = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not conf.get("normalizer")
                    and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                    and not any(" " in t for t in self.added))
        vocab = self.tokenizer.get_vocab()
        self.dtype = "<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        # byte-level tokens are written with one character a byte
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.dtype).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _glued(self, texts: list[str]) -> list[bytes]:
        """Pieces that start with a space and a word, as one text: its ids are cut
        where the bytes of their tokens reach the end of a piece."""
        ids = np.array(self.tokenizer.encode("".join(texts), add_special_tokens=False).ids
                       if not hasattr(self.tokenizer, "encode_batch_fast")
                       else self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int64)
        ends, reached = np.cumsum([len(t.encode()) for t in texts]), np.cumsum(self.width[ids])
        cuts = np.searchsorted(reached, ends)
        if cuts[-1] >= len(ids) or (reached[cuts] != ends).any():
            return self._each(texts)
        raw, at, width, out = ids.astype(self.dtype).tobytes(), 0, int(self.dtype[-1]), []
        for end in ((cuts + 1) * width).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def _learn(self, missing: list[str]) -> None:
        """Ids of pieces not known yet."""
        glue = [p for p in missing if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        rest = [p for p in missing if not (len(p) > 1 and p[0] == " " and not p[1].isspace())]
        for a in range(0, len(glue), self.GLUED):
            part = glue[a:a + self.GLUED]
            self.known.update(zip(part, self._glued(part)))
        self.known.update(zip(rest, self._each(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self._each(texts)
        plain = [not any(s in t for s in self.added) for t in texts]
        if not all(plain):  # special tokens inside a text: the library takes these texts whole
            whole = iter(self._each([t for t, p in zip(texts, plain) if not p]))
            rest = iter(self.encode([t for t, p in zip(texts, plain) if p])) if any(plain) else iter(())
            return [next(rest) if p else next(whole) for p in plain]
        split = [pieces(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) > self.KEPT:
            self.known = {p: self.known[p] for p in distinct.intersection(self.known)}
        missing = list(distinct.difference(self.known))
        self._learn(missing)
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for p in missing:
            if len(p) > 64:
                del self.known[p]
        return out


# -- minimal perfect hash ---------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1; about three bits a key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, self.bases, n = levels, rest, [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.bases.append(n + np.concatenate([[0], np.cumsum(ones)]))
            n += int(ones.sum())
        self.n = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left) and len(levels) < _LEVELS:
            words = max(1, int(np.ceil(_GAMMA * len(left) / 64)))
            cell = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(cell, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[cell]]
        return cls(levels, np.sort(left))  # what no level could place, looked up by its rank

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for a key that was not built in."""
        h = keys.astype(np.int64).view(np.uint64)
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, (bits, base) in enumerate(zip(self.levels, self.bases)):
            cell = (_mix(h[left], k) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = cell >> 6, (cell & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (base[word] + below)[hit]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, h[left]), len(self.rest) - 1)
            hit = self.rest[at] == h[left]
            out[left[hit]] = self.n + at[hit]
        return out


# -- files ------------------------------------------------------------------

def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _index_bytes(keys: np.ndarray, n_null: int, counts: np.ndarray) -> bytes:
    """``keys`` ascending after ``n_null`` rows without key; ``counts`` ids per row."""
    distinct, first, many = np.unique(keys[n_null:], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    prints, firsts, numbers = (np.zeros(len(distinct), t) for t in ("<u4", "<u8", "<u8"))
    prints[slot], firsts[slot], numbers[slot] = fingerprint(distinct), first + n_null, many
    arrays = [("keys", keys.astype("<i8")), ("offsets", np.concatenate([[0], np.cumsum(counts)]).astype("<u8")),
              ("prints", prints), ("firsts", firsts), ("numbers", numbers), ("rest", mph.rest.astype("<u8")),
              *((f"level{i}", bits.astype("<u8")) for i, bits in enumerate(mph.levels))]
    head = json.dumps({"n_null": n_null, "arrays": [[n, a.dtype.str, len(a)] for n, a in arrays]}).encode()
    return b"".join([b"QTI1", len(head).to_bytes(4, "little"), head, *(a.tobytes() for _, a in arrays)])


class Shard:
    """Keyed access to one shard's files."""

    def __init__(self, path: str, id_bytes: int):
        self.fs, at = _store(path)
        with self.fs.open_input_stream(at + ".idx") as f:
            raw = f.read()
        if raw[:4] != b"QTI1":
            raise ValueError(f"not an index: {path}.idx")
        end = 8 + int.from_bytes(raw[4:8], "little")
        head, arrays = json.loads(raw[8:end]), {}
        for name, kind, n in head["arrays"]:
            arrays[name] = np.frombuffer(raw, kind, n, end)
            end += arrays[name].nbytes
        self.n_null, self.keys, self.offsets = head["n_null"], arrays["keys"], arrays["offsets"].astype(np.int64)
        self.prints, self.firsts, self.numbers = arrays["prints"], arrays["firsts"], arrays["numbers"]
        self.mph = PerfectHash([arrays[f"level{i}"] for i in range(len(arrays) - 6)], arrays["rest"])
        self.bin = self.fs.open_input_file(at + ".bin")
        self.dtype, self.width = ("<u2" if id_bytes == 2 else "<u4"), id_bytes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows where it is not there."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        safe = np.maximum(slot, 0)
        first = self.firsts[safe].astype(np.int64)
        there = (slot >= 0) & (self.prints[safe] == fingerprint(keys)) & (self.keys[first] == keys)
        return np.where(there, first, 0), np.where(there, self.numbers[safe].astype(np.int64), 0)

    def ids(self, row: int) -> np.ndarray:
        a, b = self.offsets[row], self.offsets[row + 1]
        return np.frombuffer(self.bin.read_at(int(b - a) * self.width, int(a) * self.width), self.dtype)

    def runs(self, rows: np.ndarray, most: int = 4 << 20):
        """(row, ids) of rows in file order, read in long pieces."""
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j] == rows[j - 1] + 1 and self.offsets[rows[j] + 1] - self.offsets[rows[i]] <= most:
                j += 1
            a, b = int(self.offsets[rows[i]]), int(self.offsets[rows[j - 1] + 1])
            got = np.frombuffer(self.bin.read_at((b - a) * self.width, a * self.width), self.dtype)
            for r in rows[i:j]:
                yield int(r), got[int(self.offsets[r]) - a:int(self.offsets[r + 1]) - a]
            i = j


# -- jobs -------------------------------------------------------------------

def write_shards(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Write ``doc_id, text`` as shards under ``folder`` (a new one in the shared
    checkpoint folder if none is named); returns the manifest."""
    spark = docs.sparkSession
    folder = folder or os.path.join(checkpoint_dir(spark), "token_shards", uuid.uuid4().hex)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def kernel(batches):
        task = TaskContext.get()
        shard = task.partitionId()
        coder = per_process(("encoder", len(spec.value), hash(spec.value)), partial(Encoder, spec.value))
        keys, counts, out, path = [], [], None, f"{folder}/shard-{shard:07d}-{task.taskAttemptId()}"
        end = np.array([END_ID], coder.dtype).tobytes()
        for b in slices(batches):
            if out is None:
                store, at = _store(folder)
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/{path.rpartition('/')[2]}.bin")
            coded = coder.encode([t or "" for t in b.column(1).to_pylist()])
            keys += b.column(0).to_pylist()
            counts += [len(c) // len(end) + 1 for c in coded]
            out.write(b"".join(x for c in coded for x in (c, end)))
        if out is None:
            return
        out.close()
        n_null = sum(k is None for k in keys)
        known = np.array([0 if k is None else k for k in keys], np.int64)
        with store.open_output_stream(f"{at}/{path.rpartition('/')[2]}.idx") as f:
            f.write(_index_bytes(known, n_null, np.array(counts, np.int64)))
        some = n_null < len(keys)
        row = (shard, path, len(keys), n_null, sum(counts), int(known[n_null]) if some else None,
               int(known[-1]) if some else None, len(end))
        names = [c.split()[0] for c in MANIFEST_DDL.split(",")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 5, pa.int32()))], names=names)

    # sorted with NULL first; equal keys may span shards, told apart by their text
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")) \
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(kernel, MANIFEST_DDL))


def _shard_tasks(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each shard, dealt one shard to a task.
    One row per shard: the running sum is over shards, not over documents."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    n = max(1, manifest.count())
    return manifest.withColumn("before", F.coalesce(before, F.lit(0))).repartition(n, "shard")


def scan_shards(manifest: DataFrame) -> DataFrame:
    """Every document read back from the files: ``doc_id, start, n_tokens,
    ids_crc32``. Each key is looked up in its shard's hash, which says where its
    documents are; those without a key are the first ones of the file."""

    def kernel(batches):
        for b in batches:
            for task in b.to_pylist():
                shard = Shard(task["path"], task["id_bytes"])
                keys = np.unique(shard.keys[shard.n_null:])
                first, many = shard.find(keys)
                if not many.all() or many.sum() != len(shard.keys) - shard.n_null:
                    raise ValueError(f"index and keys disagree: {task['path']}")
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows = np.concatenate([np.arange(shard.n_null), np.repeat(first, many) + step])
                names = [None] * shard.n_null + np.repeat(keys, many).tolist()
                out = [(name, task["before"] + int(shard.offsets[r]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                       for name, (r, ids) in zip(names, shard.runs(rows))]
                for a in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a:a + 50_000])],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _shard_tasks(manifest).select("path", "id_bytes", "before") \
        .mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: ``doc_id, start, ids`` of every document whose key is in
    ``keys`` (one row per document; repeated keys are looked up once). The key
    ranges of the shards (two integers a shard) go to the tasks; a key is sent
    to each shard whose range holds it."""
    spark = manifest.sparkSession
    tasks = _shard_tasks(manifest).where("min_key is not null").select(
        "shard", "path", "id_bytes", "before", "min_key", "max_key").orderBy("shard").collect()
    if not tasks:
        return spark.createDataFrame([], "doc_id long, start long, ids array<int>")
    table = spark.sparkContext.broadcast([t.asDict() for t in tasks])

    def route(batches):
        lows, highs = (np.array([t[c] for t in table.value], np.int64) for c in ("min_key", "max_key"))
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, z = np.searchsorted(highs, k, "left"), np.searchsorted(lows, k, "right")
            at = np.repeat(np.arange(len(k)), np.maximum(z - a, 0))
            step = np.arange(len(at)) - np.repeat(np.cumsum(np.maximum(z - a, 0)) - np.maximum(z - a, 0), np.maximum(z - a, 0))
            yield pa.RecordBatch.from_arrays([pa.array(a[at] + step, pa.int32()), pa.array(k[at])], names=["at", "k"])

    def read(batches):
        shard, opened = None, None
        for b in batches:
            for at in np.unique(b.column(0).to_numpy()):
                if opened != at:
                    shard, opened = Shard(table.value[at]["path"], table.value[at]["id_bytes"]), at
                k = b.filter(pa.compute.equal(b.column(0), int(at))).column(1).to_numpy()
                first, many = shard.find(k)
                for i in np.argsort(first, kind="stable"):
                    for r in range(int(first[i]), int(first[i] + many[i])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(k[i])]), pa.array([table.value[at]["before"] + int(shard.offsets[r])]),
                             pa.array([shard.ids(r).astype(np.int32).tolist()], pa.list_(pa.int32()))],
                            names=["doc_id", "start", "ids"])

    asked = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    return asked.mapInArrow(route, "at int, k long").repartition("at").sortWithinPartitions("at") \
        .mapInArrow(read, "doc_id long, start long, ids array<int>")
