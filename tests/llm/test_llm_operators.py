"""Operators of quire.llm against brute force, round trips and held-out
labels, with null, empty, long, tied, repeated and clashing input rows."""

import bisect
import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from quire.llm import (bpe_automaton, catalog, common, fuzzy_lines, parity_join, pfair_mix, quality_rules, secret_scan, spotsigs,
                       token_shards, toxicity, url_rules)
from quire.llm.graph import components

DDL = "doc_id long, text string, source string, row string, node long, sketch string, u long, `__x` int"


def odd_docs(spark):
    """NULLs, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (None, "no id here at all", "b"),
            (4, long_text, "b"), (5, long_text + " end", "c"), (6, " \t\n\x0b ", "c"), (7, "one\none\none", "a")]
    return spark.createDataFrame([(*r, "x", 0, "s", 1, 2) for r in rows], DDL)


def empty_docs(spark):
    return odd_docs(spark).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(catalog.TOKENIZER)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 8 ------------------------------------------------------------------------

def test_automaton_equals_the_library(library):
    codec = bpe_automaton.Codec(open(catalog.TOKENIZER, encoding="utf-8").read())
    rnd = random.Random(5)
    parts = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'", "s", "re", "the", "Ing", "0", "12", "é", "中", "😀", "́", "½",
             "!", "##", "<|endoftext|>", "<|endo", "\x00", "-----", "    ", "\r\n", "aaaa", "  ", "\U0001b169", "ꟍ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000 + "x", "<|endoftext|>" * 9]
    for t in texts:
        ids = codec.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, ascii(t)
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_round_trip_rows(spark, docs, library):
    for df in (docs, odd_docs(spark), empty_docs(spark)):
        want = []
        for d, t in texts_of(df):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in bpe_automaton.round_trip(df, catalog.TOKENIZER).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    back = bpe_automaton.decode(bpe_automaton.encode(docs, catalog.TOKENIZER), catalog.TOKENIZER)
    assert sorted(texts_of(back)) == sorted(texts_of(docs))


# 1 ------------------------------------------------------------------------

def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    mph = token_shards.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))


def test_shards_hold_every_document(spark, docs, library):
    for df in (docs, odd_docs(spark), empty_docs(spark)):
        manifest = token_shards.write_shards(df, catalog.TOKENIZER)
        got = sorted((tuple(r) for r in token_shards.scan_shards(manifest).collect()), key=lambda r: r[1])
        coded = {t: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for _, t in texts_of(df)}
        want = sorted(((d, len(coded[t]), zlib.crc32(coded[t].tobytes())) for d, t in texts_of(df)), key=repr)
        assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == want
        assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()][:len(got)]
        ids = [r[0] for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_rows_come_through_the_index(spark, docs, tmp_path):
    manifest = token_shards.write_shards(docs, catalog.TOKENIZER, f"file://{tmp_path}")
    whole = sorted(map(tuple, token_shards.scan_shards(manifest).collect()))
    shard = token_shards.Shard(manifest.first()["path"], 2)
    n = len(shard.prints)
    assert n > 2 and len(shard.keys) == n + shard.n_null
    at = f"{tmp_path}/{manifest.first()['path'].rpartition('/')[2]}.idx"
    raw = open(at, "rb").read()
    firsts = raw.index(shard.firsts.tobytes())

    def scanned(place, array):
        with open(at, "wb") as f:
            f.write(raw[:place] + array.tobytes() + raw[place + array.nbytes:])
        return sorted(map(tuple, token_shards.scan_shards(manifest).collect()))

    assert scanned(firsts, shard.firsts) == whole
    # a key sent to another's place, a wrong fingerprint, a wrong number of documents
    for place, array in ((firsts, np.roll(shard.firsts, 1)), (raw.index(shard.prints.tobytes()), shard.prints + np.uint32(1)),
                         (raw.index(shard.numbers.tobytes(), firsts + 8 * n), shard.numbers + np.uint64(1))):
        with pytest.raises(Exception, match="index and keys disagree"):
            scanned(place, array)


def test_glued_pieces_equal_the_library(library):
    coder = token_shards.Encoder(open(catalog.TOKENIZER, encoding="utf-8").read())
    rnd = random.Random(4)
    marks = ["", " ", "  ", "\n", " \n ", "\t", "\u00a0", "'s", "'ll", ".", "<|endoftext|>", "\x00", "7", "é", "日本", "\u200b", "🙂"]
    texts = ["".join(rnd.choice(marks) + rnd.choice([" ", "", "a", " the", "Über"]) for _ in range(rnd.randrange(40)))
             for _ in range(2_000)]
    for kept in (token_shards.Encoder.KEPT, 10):
        coder.KEPT = kept
        for a in range(0, len(texts), 500):
            part = texts[a:a + 500]
            want = [np.array(library.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in part]
            assert coder.encode(part) == want


def test_lookup_by_key(spark, library):
    df = odd_docs(spark)
    manifest = token_shards.write_shards(df, catalog.TOKENIZER)
    asked = spark.createDataFrame([(3,), (4,), (99,), (3,), (None,)], "doc_id long")
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_shards.lookup(manifest, asked).collect())
    want = Counter((d, (*library.encode(t, add_special_tokens=False).ids, 0)) for d, t in texts_of(df) if d in (3, 4))
    assert got == want


# 2 ------------------------------------------------------------------------

def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_quality_statistics(spark, docs):
    for df in (docs, odd_docs(spark), empty_docs(spark)):
        got = sorted((tuple(r) for r in quality_rules.judge(df).collect()), key=repr)
        want = []
        for d, t in texts_of(df):
            s = brute_quality(t)
            want.append((d, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
        assert [r[:7] for r in got] == sorted(want, key=repr)
        assert not any(r[7] for r in got if r[6])


def test_cascade_order_changes_no_verdict(docs):
    stats = quality_rules.with_statistics(docs)
    rules = quality_rules.default_rules()
    a = stats.select("doc_id", quality_rules.cascade(rules).alias("k"))
    b = stats.select("doc_id", quality_rules.cascade(rules[::-1]).alias("k"))
    assert a.exceptAll(b).isEmpty()
    measured = [(rules[0], 1.0, 0.1), (rules[1], 0.1, 0.1), (rules[2], 0.1, 0.0)]
    assert [r.name for r in quality_rules.order_rules(measured)] == [rules[1].name, rules[0].name, rules[2].name]


def test_quality_verdict_follows_labels(spark, docs):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


# 3 ------------------------------------------------------------------------

URLS = ["https://a.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/a?b=://c/de/",
        "x.com/de/", None, "", "http://COM/de/", "http://notcom/de/", "ftp://example.org", "http://example.com/de", "a://b://c/d",
        "http://m.bad-seller.example.net/en/7?ref=x#y", "http://m.bad-seller.example.net/fr/9", "http://fine.example.net/en/7"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = re.split(r"[?#]", rest[cut:])[0]
    fits = [r for _, r in url_rules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_long_common_paths_are_mined_as_one_item(spark):
    """30 segments that always come together, and one that goes with the label."""
    import time

    path = "/".join(f"s{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    train = [(f"http://h{i}.org/{path}/p{i}", i % 2 == 0) for i in range(40)] + \
        [(f"http://k{i}.org/{path}/spam/q{i}", True) for i in range(40)] + [(f"http://m{i}.org/fine/r{i}", False) for i in range(160)]
    labelled = spark.createDataFrame(train, "url string, blocked boolean")
    began = time.perf_counter()
    rules = url_rules.mine(labelled).collect()
    assert time.perf_counter() - began < 30
    sure = {tuple(r.antecedent): (round(r.confidence, 6), round(r.support, 6)) for r in rules}
    assert sure[("path:spam",)] == (1.0, round(40 / 240, 6))
    # brute force over the items that FP-growth may see: no other single token implies the label
    tokens = {u: set(r) for u, r in labelled.select("url", url_rules.tokens_of(F.col("url"))).collect()}
    for token in set().union(*tokens.values()):
        mine = [b for u, b in train if token in tokens[u]]
        if len(mine) >= url_rules.MIN_COUNT and sum(mine) / len(mine) >= url_rules.MIN_CONFIDENCE:
            assert {u for u in tokens if token in tokens[u]} == {u for u in tokens if "path:spam" in tokens[u]}


def test_url_rules_and_mined_rules(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)] + [(None, URLS[0], 0), (0, URLS[0], 0)],
                                  "page_id long, url string, verdict int")
    train = [(f"http://m.bad-seller.example.net/en/{i}", True) for i in range(60)]
    train += [(f"http://fine.example.net/en/{i}", i % 7 == 0) for i in range(200)] + [(None, True), ("http://x/", None)]
    labelled = spark.createDataFrame(train, "url string, blocked boolean")
    got = url_rules.judge(pages, labelled).collect()
    assert len(got) == len(URLS) + 2
    verdicts = {r: v for v, r in url_rules.RULES}
    for r in got:
        url = URLS[0] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path, r.rule) == brute_url(url)
        want = verdicts[r.rule] if r.rule else "block" if url and "bad-seller" in url else "allow"
        assert r.verdict == want, url
    nothing = spark.createDataFrame([], "url string, blocked boolean")
    assert {r.verdict for r in url_rules.judge(pages.where("page_id = 14"), nothing).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), labelled).count() == 0


# 4 ------------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_rows(rnd):
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 160))]
        for _ in range(6):
            t = list(base)
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t))
        rows += [" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(5, 30))]) for _ in range(4)]
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [24, 1])
def test_parity_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(parity_join, "SMALL", small)
    rows = near_rows(random.Random(small))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in parity_join.link(df).collect()), key=repr) == brute_components(rows)


def apart_rows(rnd, copies):
    """Copies of a text that mostly differ by more than a link allows, some in groups that do not."""
    base, rows = [f"w{rnd.randrange(500)}" for _ in range(200)], []
    while len(rows) < copies:
        t = list(base)
        for at in rnd.sample(range(len(t)), 5):
            t[at] = f"x{rnd.randrange(10**6)}"
        rows.append(" ".join(t))
        for _ in range(rnd.choice((0, 0, 0, 2))):
            u = list(t)
            u[rnd.randrange(len(u))] = f"y{rnd.randrange(10**6)}"
            rows.append(" ".join(u))
    return list(enumerate(rows))


@pytest.mark.parametrize("cell", [2048, 16])
def test_parity_join_of_copies_a_little_too_far_apart(spark, monkeypatch, cell):
    monkeypatch.setattr(parity_join, "CELL", cell, raising=False)
    verified, compared = parity_join._verified, []

    def counting(pairs, *rest):
        pairs = pairs.localCheckpoint()
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(parity_join, "_verified", counting)
    rows = apart_rows(random.Random(cell), 240)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in parity_join.link(df).collect()), key=repr) == brute_components(rows)
    assert len(compared) > 2 and sum(compared[2:]) < 5 * len(rows), compared    # of the last pass: stars, then what the sketches leave


def test_sketch_pairs_are_those_hamming_and_sizes_allow():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.random(120) > 0.06], rnd.integers(0, 1 << 63, rnd.integers(0, 30), dtype=np.uint64)]))
            for _ in range(60)]
    sketches, sizes, comps = [parity_join.sketch_of(x) for x in sets], np.array([len(x) for x in sets]), rnd.integers(0, 40, 60)
    assert len({len(x) for x in sketches}) > 1
    one, other = np.arange(0, 45), np.arange(20, 60)
    i, j, d = parity_join._sketch_pairs(sketches, sizes, comps, one, other, parity_join.PERCENT)
    want = {(min(a, b), max(a, b)): parity_join.hamming(sketches[a], sketches[b]) for a in one for b in other if comps[a] != comps[b]
            and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])
            and 185 * parity_join.hamming(sketches[a], sketches[b]) <= 15 * (sizes[a] + sizes[b])}
    assert {(a, b): h for a, b, h in zip(i.tolist(), j.tolist(), d.tolist())} == want and len(i) == len(want)
    joined = parity_join._joining(i, j, d, comps)
    near = {k: k for k in set(comps.tolist())}
    for a, b in want:
        x, y = near[comps[a]], near[comps[b]]
        near = {k: x if v == y else v for k, v in near.items()}
    assert len(joined) == len(near) - len(set(near.values()))   # a forest that spans what the pairs connect


def test_parity_join_odd_rows(spark):
    df = odd_docs(spark)
    assert sorted((tuple(r) for r in parity_join.link(df).collect()), key=repr) == brute_components(texts_of(df))
    assert parity_join.link(empty_docs(spark)).count() == 0


def test_sketches_bound_the_difference_and_blocks_lose_no_link():
    rnd = np.random.default_rng(4)
    limits = parity_join.bands(1 << 20)
    for n in (7, 12, 40, 333, 2500):
        for _ in range(60):
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            most = max(1, int(0.08 * n))
            b = np.unique(np.concatenate([a[rnd.permutation(len(a))[most:]], rnd.integers(0, 1 << 63, most - 1, dtype=np.uint64)]))
            differ = len(np.setxor1d(a, b))
            assert parity_join.hamming(parity_join.sketch_of(a), parity_join.sketch_of(b)) <= differ
            if parity_join.linked(a, b):
                assert np.intersect1d(parity_join.keys_of(a, limits), parity_join.keys_of(b, limits)).size


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 100), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")) is None


# 5 ------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("Th1s іs an 1D10T!!  сlown\u200b, 42 days") == " this is an idiot clown 42 days "
    assert toxicity.fold(None) == "  " or toxicity.fold(None).strip() == ""


def test_exceptions_and_longest_match():
    lex = toxicity.Lexicon({" scum ": 3.0, " sc": 1.0}, {" pond scum ": " scum "}, (-2.0, 1.0, 1.0))
    assert [e for _, e in lex.matches(toxicity.fold("you SCUM and pond scum"))] == [" scum "]
    assert lex.score("you scum") > lex.score("pond scum") == lex.score("")


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out()).collect()
    toxic = [r.score >= toxicity.THRESHOLD for r in rows if r.toxic == 1]
    clean = [r.score >= toxicity.THRESHOLD for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    odd = odd_docs(spark)
    assert toxicity.score(odd, lexicon).count() == odd.count()
    assert toxicity.reject(odd, lexicon).columns == odd.columns
    nothing = toxicity.learn(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_repeated_ids_weigh_once_in_learning(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    often = docs.join(labels.where("toxic = 0").where(~toxicity.held_out()).orderBy("doc_id").limit(1).select("doc_id"), "doc_id")
    hot = docs.union(often.crossJoin(spark.range(400)).select("doc_id", "text"))
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(x, labels)).collect()} for x in (docs, hot)]
    assert any(scores[0].values()) and scores[0].keys() == scores[1].keys()
    assert all(abs(v - scores[1][k]) < 1e-6 for k, v in scores[0].items())


# 6 ------------------------------------------------------------------------

def test_fuzzy_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while many other animals look on from the far side of a green field today"
    rows = [(1, f"{base}\nshort"), (2, f"short\n{base.upper()}!\nonly this document has this line"), (3, None), (None, base),
            (5, f"{base}\n{base}"), (6, base.replace("green", "grean")), (7, "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, line int")
    got = {r.doc_id: (r.text, r["__n_removed"], r.line) for r in fuzzy_lines.dedupe(df).collect()}
    assert got[1] == (rows[0][1], 0, 9)
    assert got[2] == ("short\nonly this document has this line", 1, 9)
    assert got[3] == (None, 0, 9) and got[7] == ("", 0, 9)
    assert got[None] == ("", 1, 9) and got[5] == ("", 2, 9)
    assert fuzzy_lines.dedupe(df.limit(0)).count() == 0


def test_long_lines_are_compared_word_by_word(spark):
    words = [f"word{i}" for i in range(3000)]
    few, many = list(words), list(words)
    few[7] = few[1500] = "other"
    many[::5] = ["else"] * 600
    rows = [(i, " ".join(w)) for i, w in enumerate((words, few, many))] + [(3, "")]
    coded = spark.createDataFrame(rows, "i int, t string").select("i", fuzzy_lines._coded(F.col("t")).alias("w"))
    got = {r.i: r.w for r in coded.collect()}
    assert [len(got[i]) for i in range(4)] == [3000, 3000, 3000, 1]
    assert sum(x != y for x, y in zip(got[0], got[1])) == 2
    assert sum(x != y for x, y in zip(got[0], got[2])) >= 599
    left = {r.doc_id: r.text for r in fuzzy_lines.dedupe(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()}
    assert left == {0: rows[0][1], 1: "", 2: rows[2][1]}


def test_exactly_repeated_lines_go(spark, docs):
    got = {r.doc_id: r.text for r in fuzzy_lines.dedupe(docs).collect()}
    first = {}
    for d, t in sorted(texts_of(docs)):
        for line in t.split("\n"):
            key = " ".join(w for w in re.split(r"[\W_]+", line.lower()) if w)
            if len(key) >= 40:
                first.setdefault(key, d)
    kept = Counter()
    for d, t in got.items():
        for line in (t or "").split("\n"):
            key = " ".join(w for w in re.split(r"[\W_]+", line.lower()) if w)
            if len(key) >= 40:
                kept[key] += 1
                assert first[key] == d
    assert max(kept.values()) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def groups_of(lines, linked):
    comp = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if comp[i] != comp[j] and linked(lines[i], lines[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return sorted(Counter(comp).values())


def test_large_buckets_of_lines_are_compared_whole(spark, monkeypatch):
    # all in the same buckets, singletons first: pairs in the rest are no heads
    monkeypatch.setattr(fuzzy_lines, "_block_keys", lambda sim: [F.lit(1).cast("long")])
    monkeypatch.setattr(fuzzy_lines, "MAX_DISTANCE", 64)
    monkeypatch.setattr(fuzzy_lines, "CELL", 64, raising=False)
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    lines = [letters(40) for _ in range(250)]
    lines += [x[:20] + "xyz"[:k] + x[20 + k:] for x in lines[:25] for k in (1, 3)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = [r.text for r in fuzzy_lines.dedupe(df).collect() if r.text]
    want = len(groups_of(lines, lambda a, b: distance(a, b) * 10 <= max(len(a), len(b))))
    assert want == 250 and len(kept) == want


def changed_lines(n_words, pairs, edit, seed=5):
    """Lines of ``n_words`` and a copy of each within a tenth in characters."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.choice((2, 3, 4, 5, 5, 6, 7, 8)))) for _ in range(5000)]
    out = []
    while len(out) < pairs:
        words = rnd.choices(vocabulary, k=n_words)
        a, b = " ".join(words), " ".join(edit(rnd, list(words), vocabulary))
        if a != b and distance(a, b) * 10 <= max(len(a), len(b)):
            out.append((a, b))
    return out


def one_word(rnd, words, vocabulary):
    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return words


def typing_errors(rnd, words, vocabulary):
    for i in rnd.sample(range(len(words)), max(1, len(words) // 5)):
        k = rnd.randrange(len(words[i]))
        words[i] = words[i][:k] + "z" + words[i][k + 1:]
    return words


def recall(spark, pairs):
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    left = {r.doc_id for r in fuzzy_lines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text}
    assert all(2 * i in left for i in range(len(pairs)))
    return 1 - sum(d % 2 for d in left) / len(pairs)


@pytest.mark.parametrize("n_words,edit,least", [(10, one_word, 0.9), (20, one_word, 0.95), (40, one_word, 0.97),
                                                (15, typing_errors, 0.85), (40, typing_errors, 0.85)])
def test_recall_of_near_lines_against_brute_force(spark, n_words, edit, least):
    got = recall(spark, changed_lines(n_words, 250, edit))
    print("recall", n_words, edit.__name__, got)
    assert got >= least


def test_long_lines_are_compared_in_characters(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(200)]
    typing = [w[:4] + "z" + w[5:] if i % 8 == 0 else w for i, w in enumerate(words)]  # an eighth of the words, 1.3 % of the characters
    rows = [(0, " ".join(words)), (1, " ".join(typing)), (2, " ".join(["quite"] + words[3:]))]
    left = {r.doc_id: r.text for r in fuzzy_lines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0: rows[0][1], 1: "", 2: ""}


def test_pairs_meet_their_texts_a_bounded_number_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "ROUND", 40)
    monkeypatch.setattr(fuzzy_lines, "PER_LINE", 0)
    judged, sizes = fuzzy_lines._judged, []
    monkeypatch.setattr(fuzzy_lines, "_judged", lambda pairs, texts: (sizes.append(pairs.count()), judged(pairs, texts))[1])
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    lines = []
    for n in (8, 30, 60):
        for _ in range(3):
            base = rnd.choices(words, k=n)
            text = " ".join(base)
            shifted = base[:n // 2] + ["new"] * (n // 20) + base[n // 2:]
            spelt = "".join("z" if rnd.random() < 0.07 else c for c in text)
            far = " ".join(rnd.sample(base, n))
            lines += [text, " ".join(shifted), spelt, far, text[3:] + text[:3], text.replace(" ", "", n // 10)]
    lines = [x for x in dict.fromkeys(lines) if len(x) >= fuzzy_lines.MIN_CHARS]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = fuzzy_lines._distinct(fuzzy_lines.occurrences(df))
    at = {r.row: r.line for r in found.collect()}
    line = [at[r.k] for r in df.orderBy("doc_id").select(fuzzy_lines.row_key().alias("k")).collect()]
    norm = [" ".join(x.split()) for x in lines]
    near = lambda a, b: distance(a, b) <= max(len(a), len(b)) // 10
    pairs = [(i, j) for i in range(len(lines)) for j in range(max(0, i - 4), i)]
    got = fuzzy_lines._verified(spark.createDataFrame([(line[i], line[j]) for i, j in pairs], "a long, b long"), df, found).collect()
    want = {frozenset((line[i], line[j])) for i, j in pairs if near(norm[i], norm[j])}
    assert {frozenset(r) for r in got} <= want and len(want) > 9
    joined = lambda links: sorted(map(sorted, components_of(line, links)))
    assert joined(map(tuple, got)) == joined(map(tuple, want))
    assert len(sizes) > 3 and sum(sizes) == len(pairs) and max(sizes) < 100


def components_of(nodes, links):
    group = {x: {x} for x in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {frozenset(g) for g in group.values()}


def test_unlike_lines_of_one_bucket_do_not_meet_their_texts(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "_block_keys", lambda sim: [F.lit(1).cast("long")])
    monkeypatch.setattr(fuzzy_lines, "MAX_DISTANCE", 64)
    verified, sizes = fuzzy_lines._verified, []
    monkeypatch.setattr(fuzzy_lines, "_verified", lambda pairs, *more: (sizes.append(pairs.count()), verified(pairs, *more))[1])
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    lines = [rnd.choices(words, k=40) for _ in range(60)]
    lines += [x[:9] + ["others"] + x[10:] for x in lines[:20]]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    left = {r.doc_id for r in fuzzy_lines.dedupe(df).collect() if r.text}
    assert left == set(range(60))
    assert 20 <= sum(sizes) < 60, sizes     # of 3,160 pairs in the bucket


def test_agreement_of_least_hashes_loses_no_near_lines():
    def found(pairs, least, alike):
        chances = Counter({(0, False): 1.0})     # by hashes that agree, and whether two of a pair do
        for _ in range(pairs):
            step = Counter()
            for (n, both), p in chances.items():
                for k, q in enumerate(((1 - alike) ** 2, 2 * alike * (1 - alike), alike ** 2)):
                    step[n + k, both or k == 2] += p * q
            chances = step
        return sum(p for (n, both), p in chances.items() if both and n >= least)

    assert sorted(k for pair in fuzzy_lines.BANDS for k in pair) == list(range(fuzzy_lines.ORDERS))
    for alike in (0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9):  # six pairs before, without a least number
        assert found(len(fuzzy_lines.BANDS), fuzzy_lines.AGREE, alike) >= found(6, 0, alike), alike


def test_line_ids_do_not_depend_on_outer_separators(spark):
    rows = [(1, "one two three four five six"), (2, "  *One two-three, four five six.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fuzzy_lines.occurrences(df).select("line").distinct().count() == 1


# 7 ------------------------------------------------------------------------

def test_edf_keeps_within_one_block():
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    blocks = {s: 40 * w for s, w in weights.items()}
    plan = list(pfair_mix.edf(blocks, weights))
    assert [t for _, _, t in plan] == list(range(400))
    seen = Counter()
    for s, i, t in plan:
        assert i == seen[s]
        seen[s] += 1
        for x, w in weights.items():
            assert abs(seen[x] - w * (t + 1) / 10) < 1


def test_capped_weights():
    w = pfair_mix.capped_weights({"big": 900, **{f"s{i}": 10 for i in range(10)}})
    assert w["big"] * 4 == sum(w.values()) and len({w[f"s{i}"] for i in range(10)}) == 1


def test_mix_places_every_document(spark, docs):
    placed = pfair_mix.place(docs)
    rows = placed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in rows if r.in_mix) == sorted(r.doc_id for r in pfair_mix.select_mix(docs).select("doc_id").collect())
    odd = odd_docs(spark)
    assert pfair_mix.place(odd).count() == odd.count() and pfair_mix.select_mix(odd).columns == odd.columns
    assert pfair_mix.place(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("shares", [(40, 30, 29, 1), (90, 4, 3, 2, 1), (33, *[4] * 16, 3), (300, 1), (50, 25, 0)])
def test_default_mix_drops_nothing(spark, monkeypatch, shares):
    import corpus_pipeline as P

    monkeypatch.setattr(pfair_mix, "MIN_BLOCK", 64)
    rows = [(s * 1000 + i, "x" * 40, f"s{s}" if s else None) for s, n in enumerate(shares) for i in range(n)]
    rows += [(90_000 + i, "", "only empty texts") for i in range(5)] + [(None, None, "s1"), (7, "twice", None), (7, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = {(r.doc_id, r.source): r for r in pfair_mix.place(df).collect()}
    assert pfair_mix.place(df).where("not in_mix or slot is null").count() == 0
    got = [tuple(r) for r in P.mix_sources(spark, df, SF_SMALL).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    slots = [placed[d, s or ""].slot for d, _, s in got if d not in (None, 7)]
    assert slots == sorted(slots)
    # a source's share holds all along the order, within a block
    chars = Counter()
    for _, text, s in rows:
        chars[s or ""] += len(text or "")
    blocks = {s: max(1, -(-n // 64)) for s, n in chars.items()}
    for s, n in blocks.items():
        at = sorted({p.slot for p in placed.values() if p.source == s})
        assert all(abs(k - n * t / sum(blocks.values())) < 1 for k, t in enumerate(at))


def test_rows_without_id_are_spread_and_laid_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "MIN_BLOCK", 64)
    monkeypatch.setattr(pfair_mix, "BUCKET_ROWS", 20)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " + "x" * (i % 50), "hot" if i % 4 else "other")
            for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of_id = Counter(r.h >> 57 for r in pfair_mix._sized(df).where("doc_id is null").collect())
    assert len(of_id) > 64 and max(of_id.values()) < 30
    # each source's rows in hash order, as a plain running sum
    place, want = Counter(), Counter()
    for r in sorted(pfair_mix._sized(df).collect(), key=lambda r: (r.source, r.h % (1 << 64), r.size)):
        want[r.source, place[r.source] // 64] += 1
        place[r.source] += r.size
    assert Counter((r.source, r.block) for r in pfair_mix.place(df).collect()) == want


def test_stated_weights_hold(spark):
    df = spark.createDataFrame([(i, "x" * 9000, "ab"[i % 3 == 0]) for i in range(60)], "doc_id long, text string, source string")
    got = Counter(r.source for r in pfair_mix.select_mix(df, {"a": 1, "b": 1}).collect())
    assert abs(got["a"] - got["b"]) <= 1


# 9 ------------------------------------------------------------------------

def spots_of(text):
    """The signatures of a text word by word, apart from the operator's arrays."""
    words = [w for w in ("".join(c for c in text if not ("!" <= c <= "~") or c.isalnum()).encode().lower().split())]
    if not words:
        return {xxhash.xxh32_intdigest(text.encode())}
    anchors = {a.encode() for a in spotsigs.ANCHORS}
    number = lambda w: xxhash.xxh64_intdigest(w) // 2 * 2 + (w in anchors)
    content = [number(w) for w in words if w not in anchors] or [number(w) for w in words]
    spots, seen = {(spotsigs._START, content[0], 0)}, 0
    if len(content) > 1:
        spots.add((spotsigs._START, content[0], content[1]))
    for w in words:
        if w in anchors:
            spots.add((number(w), *content[seen:seen + 2]))
        else:
            seen += 1
    spots |= {(c, *content[i + 1:i + 3]) for i, c in enumerate(content) if (c >> 20) % 16 == 0}

    def mixed(anchor, first, second):
        m = (1 << 64) - 1
        x = (anchor * 0x9E3779B97F4A7C15 & m) ^ (first * 0xC2B2AE3D27D4EB4F & m)
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m) ^ (second * 0x165667B19E3779F9 & m)
        return ((x ^ x >> 32) * 0x94D049BB133111EB & m) >> 32

    return {mixed(*s) for s in spots if len(s) == 3}


def share(a, b):
    return len(a & b) / len(a | b)


def test_spotsigs_neighbours(spark, docs):
    for df in (docs, odd_docs(spark), empty_docs(spark)):
        tie = {r.text or "": r.tie for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
        want = []
        for i, (d, t) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            changed = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
            own, other, after = spots_of(t), spots_of(changed), spots_of(following)
            want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), sorted(own), sorted(other),
                         share(own, other), share(own, after)))
        got = [(r.doc_id, r.n_chars, r.edited_sha256, spotsigs.parse(r.fingerprint).tolist(),
                spotsigs.parse(r.edited_fingerprint).tolist(), r.near_edited, r.near_next)
               for r in spotsigs.compare_neighbours(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_small_likeness_is_reported():
    assert spotsigs.likeness(np.arange(1), np.arange(1_000)) == 0.001


@pytest.mark.parametrize("percent", [30, 80, 100])
def test_similar_pairs_equal_brute_force(spark, docs, percent):
    rnd = random.Random(percent)
    texts = [t for _, t in texts_of(docs)[:60]]
    for t in texts[:30]:        # copies, shorter and changed ones; thirty of one text
        words = t.split(" ")
        texts += [t, " ".join(words[:rnd.randrange(len(words) // 2, len(words)) + 1]),
                  " ".join(w if rnd.random() < 0.98 else "changed" for w in words)]
    words = texts[0].split(" ")
    texts += [" ".join([*words[:i], "other", *words[i + 1:]]) for i in range(0, len(words), max(1, len(words) // 30))]
    texts += [None, "", " ", "one", "the", "the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in spotsigs.classes(df).collect()}
    assert len(of) == len(texts)
    sets = {of[i]: spots_of(t or "") for i, t in enumerate(texts)}
    assert len({frozenset(s) for s in sets.values()}) == len(sets)
    want = {(a, b, len(x & y), len(x | y)) for a, x in sets.items() for b, y in sets.items()
            if a < b and 100 * len(x & y) >= percent * len(x | y)}
    got = [tuple(r) for r in spotsigs.similar_pairs(df, percent).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want or percent == 100
    assert spotsigs.similar_pairs(empty_docs(spark), percent).count() == 0


def test_length_partitions_lose_no_pair():
    for percent in (1, 30, 80, 99, 100):
        bounds = spotsigs.length_bounds(percent, 5_000)
        part = [bisect.bisect_right(bounds, n) for n in range(2_000)]
        for n in range(1, 2_000):
            most = min(n * 100 // percent, 1_999)
            assert part[most] - part[n] in (0, 1)


# 10 -----------------------------------------------------------------------

def test_secret_structures():
    import base64
    import json
    import struct

    b64 = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(json.dumps({'sub': 'x'}).encode())}.{'s' * 20}"
    fake = f"{b64(b'not json at all')}.{b64(b'{}')}.abc"
    inner = b"\x02\x01\x00" + b"\x06\x03\x2a\x03\x04" + b"\x04\x20" + bytes(32)
    der = b"\x30" + bytes([len(inner)]) + inner
    field = lambda x: struct.pack(">I", len(x)) + x
    ssh = base64.b64encode(field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(bytes(64))).decode()
    pem = f"-----BEGIN KEY-----\n{base64.b64encode(der).decode()}\n-----END KEY-----"
    kinds = lambda t: {k for _, _, k in secret_scan.scan_text(t)[1]}
    assert "jwt" in kinds(f"a {jwt} b") and "jwt" not in kinds("a eyJ" + fake)
    assert "der" in kinds(f"x {der.hex()} y") and "der" in kinds(f"x {base64.b64encode(der).decode()} y")
    assert "der" not in kinds(f"x {(der[:-1] + b'x' * 9).hex()} y")
    assert "ssh" in kinds(f"ssh-rsa {ssh} me@host") and "pem" in kinds(pem)
    assert kinds("sha " + "ab" * 32) == {"hex"}


def test_secret_forms_of_settings_files():
    import base64
    import struct

    inner = b"\x02\x01\x00" + b"\x06\x03\x2a\x03\x04" + b"\x04\x20" + bytes(32)
    der = b"\x30" + bytes([len(inner)]) + inner
    field = lambda x: struct.pack(">I", len(x)) + x
    ssh = base64.b64encode(field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(bytes(64))).decode()
    b64, sealed = base64.b64encode(der).decode(), base64.b64encode(bytes(range(64))).decode()
    spans = lambda t: {(t[a:b], k) for a, b, k in secret_scan.scan_text(t)[1]}
    kinds = lambda t: {k for _, k in spans(t)}
    assert (b64, "der") in spans(f"KEY={b64}\n") and (ssh, "ssh") in spans(f"ssh_key={ssh}")
    assert (der.hex(), "der") in spans(f"x = 0x{der.hex()};") and "der" not in kinds(f"a0x{der.hex()}")
    pem = lambda body: f"-----BEGIN KEY-----\n{body}\n-----END KEY-----"
    assert "pem" in kinds(pem(f"Comment: made-by-hand\n\n{b64}"))
    assert "pem" in kinds("k = '" + pem(f"{b64[:40]}\n{b64[40:]}").replace("\n", "\\n") + "'")
    heads = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n"
    assert "pem" in kinds(pem(heads.format("0F" * 16) + sealed))
    assert "pem" not in kinds(pem(heads.format("0F" * 16) + sealed[:-12])) and "pem" not in kinds(pem(sealed))
    long = "-----BEGIN KEY-----\na-b " * 50_000
    assert "pem" not in kinds(long)


def test_secret_base_spans(spark, docs):
    def brute(text):
        out = [(m.start(), m.end(), "assign") for m in re.finditer(
            r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6]
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))

    extra = [(1, 'é PassWord" : "abcdefgh12" AKIA' + "A1" * 9), (2, "token=short token = longer_value"), (2, None), (None, "f" * 30)]
    for df in (docs, odd_docs(spark), spark.createDataFrame(extra, "doc_id long, text string"), empty_docs(spark)):
        want = []
        for d, t in texts_of(df):
            spans = brute(t)
            kinds = Counter(s[2] for s in spans)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
            want.append((d, kinds["assign"], kinds["access"], kinds["hex"], digest))
        got = [tuple(r)[:5] for r in secret_scan.scan(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# pipeline -------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    kept = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, kept, SF_SMALL)
        assert after.columns == kept.columns, name
        before, kept = kept, spark.createDataFrame(after.collect(), after.schema)
        assert 0 < kept.count() <= before.count(), name
    last = P.STAGES[-1][1](spark, kept, SF_SMALL)
    assert last.count() == kept.count()
    odd = odd_docs(spark).withColumnRenamed("row", "lang").withColumnRenamed("node", "n_chars")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, SF_SMALL).columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF_SMALL).count() == 0, name


def test_line_keys_are_dealt_once(spark, docs, monkeypatch):
    import re

    from test_plans import plan_text

    plans = []
    cut = fuzzy_lines.cut_lineage
    monkeypatch.setattr(fuzzy_lines, "cut_lineage", lambda df: (plans.append(plan_text(df, "simple")), cut(df))[1])
    fuzzy_lines.dedupe(docs.limit(50))
    dealt = [p for p in plans if re.search(r"hashpartitioning\(key#\d+L?, \d+\), REPARTITION", p)]
    assert dealt and not re.search(r"hashpartitioning\(key#\d+L?, \d+\), ENSURE", dealt[0])


def test_mix_order_reaches_the_output(spark, monkeypatch, tmp_dir):
    import corpus_pipeline as P

    monkeypatch.setattr(pfair_mix, "MIN_BLOCK", 64)
    rows = [(i, f"text {i} " + "x" * (i * 37 % 300), f"s{i % 3}") for i in range(400)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    mixed = P.mix_sources(spark, df, SF_SMALL)
    want = [r.doc_id for r in mixed.collect()]
    mixed.write.parquet(f"{tmp_dir}/mix")
    for stored in (spark.read.parquet(f"{tmp_dir}/mix"), mixed):
        got = P.tokenize(spark, stored, SF_SMALL).collect()
        assert [r.mix_position for r in sorted(got, key=lambda r: r.mix_position)] == list(range(len(rows)))
        assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_position)] == want
    slot = {r.doc_id: r.slot for r in pfair_mix.place(df).collect()}
    slots = [slot[d] for d in want]
    assert slots == sorted(slots) and len(set(slots)) > 100


def test_near_duplicates_are_decided_by_row(spark):
    import corpus_pipeline as P

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, 0), (1, a, 0), (1, a + " more", 0),        # copies under one id
            (2, a, 0), (2, b, 1),                             # a copy and a clean row under one id
            (None, c, 0), (None, c, 0), (None, c + " end", 0),  # copies without an id
            (None, b, 0), (3, d, 1), (4, "", 1), (4, "", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = sorted((tuple(r) for r in P.drop_near_duplicates(spark, df, SF_SMALL).collect()), key=repr)
    clean = sorted((r for r in rows if r[2]), key=repr)
    assert [r for r in got if r[2]] == clean
    rest = [r for r in got if not r[2]]
    assert len(rest) == 2 and {r[0] for r in rest} == {1, None}
    assert [r[1][:2] for r in rest if r[0] is None] == ["c0"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, name):
    import duckdb

    from quire.sources.tables import TABLES, table_path

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    cur = con.execute(catalog.ORACLE[name])
    cols = [d[0] for d in cur.description]
    got = catalog.QUERIES[name](spark, SF_SMALL).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cur.fetchall(), key=repr)


def test_learning_lets_go_of_what_an_earlier_stage_kept():
    class Train:
        def mapInArrow(self, kernel, schema):
            list(kernel(iter([])))
            raise StopIteration

    common.per_process("an earlier stage", lambda: bytes(10))
    with pytest.raises(StopIteration):
        toxicity._counted(Train(), toxicity._prefix_entries, 1)
    assert not sys.__dict__["_quire_llm_memo"]


def test_fuzzy_lines_buckets_go_before_later_pairs_are_verified(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "SMALL", 2)
    monkeypatch.setattr(fuzzy_lines, "HEADS", 2)
    cut, verified, buckets, there = fuzzy_lines.cut_lineage, fuzzy_lines._verified, [], []

    def cutting(df):
        out = cut(df)
        if {"key", "head", "members"} <= set(out.columns):
            buckets.extend(f.removeprefix("file://") for f in out.inputFiles())
        return out

    def verifying(*args):
        there.append(sum(map(os.path.exists, buckets)))
        return verified(*args)

    monkeypatch.setattr(fuzzy_lines, "cut_lineage", cutting)
    monkeypatch.setattr(fuzzy_lines, "_verified", verifying)
    rnd = random.Random(6)
    base = [f"word{rnd.randrange(90)}" for _ in range(24)]
    rows = []
    for i in range(60):
        line = list(base)
        for at in rnd.sample(range(24), 4):
            line[at] = f"other{rnd.randrange(10**6)}"
        rows.append((i, " ".join(line)))
    fuzzy_lines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert buckets and there[0] and len(there) > 1 and not any(there[1:]), there
