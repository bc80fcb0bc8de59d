"""8. BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over token labels
that accepts exactly the token sequences the merges produce. It starts as one
state with an arc for every byte and takes the merges in order. The gadget of
a merge (u, v): where the state entered by u has an arc v, that arc is taken
away from it (u may no longer be followed by v), and every state with an arc u
gets an arc uv, which enters the state that v enters. All arcs of one label
enter the same state, so a state is named by its label, and a merge adds one
state at most. Two facts decide whether a state has an arc, and both are kept
as tables instead of copies of arc lists:

* the state entered by uv is the one v entered when uv was made, so it lacks
  the arcs taken from v before that (the right spine of a label);
* an arc uv was added only where an arc u still was when uv was made (the left
  spine of a label).

Encoding walks a pre-split word through the transition tables. Every prefix of
the word has exactly one accepted token sequence, so there is one state per
position and no more than one visit to each. Decoding emits the arc labels'
bytes.

Contract: a NULL text is the empty text; a special token's string in a text is
that token (as the tokenizers library takes it); texts of any length are
encoded whole, in memory linear in the text; equal texts give equal rows, and
rows with a NULL or repeated doc_id are kept as they are; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import WordCache, per_process, ship, slices
from quire.llm.pretokens import PATTERN, byte_alphabet, pieces, without_newer

ship(__name__)

START = -1
_NEVER = 1 << 60


class Automaton:
    """Token automaton of a merge list; ``labels[id]`` are the bytes of a token."""

    def __init__(self, vocab: dict[str, int], merges: list):
        alphabet = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()
                                         if all(c in alphabet for c in s)}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.taken: dict[int, int] = {}
        arcs = {i for s, i in vocab.items() if len(s) == 1 and s in alphabet}
        for rank, pair in enumerate(merges):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            if u in vocab and v in vocab and (u + v) in vocab:
                self._gadget(rank, vocab[u], vocab[v], vocab[u + v], arcs)
        self._steps: dict[int, bool] = {}
        self._trie(arcs)

    def _gadget(self, rank: int, u: int, v: int, uv: int, arcs: set[int]) -> None:
        if u not in arcs or v not in arcs or not self._arc(u, v) or uv in arcs:
            return  # no accepted sequence holds u, v next to each other any more
        self.taken[u << 20 | v] = rank
        self.left[uv], self.right[uv], self.made[uv] = u, v, rank
        arcs.add(uv)

    def _arc(self, state: int, label: int) -> bool:
        """Whether the state entered by ``state`` has an arc ``label``."""
        a, before_a = state, _NEVER
        while True:
            b, before_b = label, _NEVER
            while True:
                rank = self.taken.get(a << 20 | b)
                if rank is not None and rank < before_a and rank <= before_b:
                    return False
                if b not in self.made:
                    break
                b, before_b = self.left[b], self.made[b]
            if a not in self.made:
                return True
            a, before_a = self.right[a], self.made[a]

    def _trie(self, arcs: set[int]) -> None:
        """Transition table (node, byte) -> node over the labels, and the label
        that ends at each node."""
        self.lengths = {token: len(self.labels[token]) for token in arcs}
        self.next: dict[int, int] = {}
        self.ends: list[int] = [START]
        for token in arcs:
            node = 0
            for byte in self.labels[token]:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    self.ends.append(START)
                node = self.next[key]
            self.ends[node] = token

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted label sequence of ``word``: from a state the longest
        matching label with an arc is followed first. Each position has one
        accepted sequence leading to it, so a position found to lead nowhere is
        never entered again and every position is expanded once at most."""
        n, table, ends, lengths = len(word), self.next, self.ends, self.lengths
        out, choices, dead, at, state = [], [], set(), 0, START
        while at < n:
            node, fits = 0, []
            for j in range(at, n):
                node = table.get(node << 8 | word[j])
                if node is None:
                    break
                if ends[node] != START:
                    fits.append(ends[node])
            choices.append(fits)
            while True:
                fits = choices[-1]
                while fits:
                    token = fits.pop()
                    if at + lengths[token] not in dead and (state == START or self.step(state, token)):
                        break
                else:  # a dead end: take the last label back
                    dead.add(at)
                    choices.pop()
                    at -= lengths[out.pop()]
                    state = out[-1] if out else START
                    continue
                break
            out.append(token)
            at, state = at + lengths[token], token
        return out

    def step(self, state: int, label: int) -> bool:
        key = state << 20 | label
        ok = self._steps.get(key)
        if ok is None:
            if len(self._steps) > 2_000_000:
                self._steps.clear()
            ok = self._steps[key] = self._arc(state, label)
        return ok


class Codec:
    """A tokenizer file's added tokens, pre-splitting and automaton."""

    def __init__(self, spec: str):
        import regex

        conf = json.loads(spec)
        model, pre = conf["model"], conf.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or conf.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is expected")
        self.automaton = Automaton(model["vocab"], model["merges"])
        self.added = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        self.labels = dict(self.automaton.labels) | {i: s.encode() for s, i in self.added.items()}
        self._split = regex.compile(PATTERN).findall
        self._split_wide = regex.compile(without_newer(PATTERN), regex.V1).findall
        self._special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) \
            if self.added else None
        self._words = WordCache(self._word)
        self._pieces = WordCache(self._piece)

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.encode_word(word.encode()), dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        words = self._split(piece) if piece.isascii() else self._split_wide(piece)
        return b"".join(map(self._words.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._special is None or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        labels = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return labels.decode("utf-8", "replace")


def codec(spec: str) -> Codec:
    return per_process(("codec", hashlib.md5(spec.encode()).digest()), partial(Codec, spec))


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) of every text."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer_file))

    def kernel(batches):
        coder = codec(spec.value)
        for b in slices(batches):
            rows = [(d, coder.encode(t or "")) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ENCODED)], schema=ENCODED)

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, text`` of ``encode``'s rows."""
    spec = encoded.sparkSession.sparkContext.broadcast(_spec(tokenizer_file))

    def kernel(batches):
        coder = codec(spec.value)
        for b in slices(batches, "ids"):
            texts = [coder.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_file: str, *held: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, per row, and
    the columns ``held`` of ``docs`` as they are."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer_file))

    def kernel(batches):
        coder = codec(spec.value)
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.encode(t or "")
                rows.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
            own = [pa.array(x, f.type) for x, f in zip(zip(*rows), ROUND_TRIP)]
            yield pa.RecordBatch.from_arrays([*own, *b.columns[2:]], names=[*ROUND_TRIP.names, *held])

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*held).schema) if held else ""
    return docs.select("doc_id", "text", *held).mapInArrow(
        kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def _spec(tokenizer_file: str) -> str:
    """The vocabulary file; its size is the vocabulary's, whatever the data."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return f.read()
