import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import ingest, retrieve, triage


def vectors(spark, n=300, d=8, labels=5, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.normal(size=d).astype(np.float32)], int(i % labels))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_dense(rows, queries, k, metric="l2sq"):
    out = {}
    for qid, qv in queries:
        q = np.asarray(qv)
        scored = []
        for vid, v, _ in rows:
            e = np.asarray(v, dtype=np.float64)
            d = float(((e - q) ** 2).sum()) if metric == "l2sq" else \
                float(1 - e @ q / (np.linalg.norm(e) * np.linalg.norm(q)))
            scored.append((d, vid))
        out[qid] = [vid for _, vid in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_dense_topk_equals_brute_force(spark, metric):
    rows, corpus = vectors(spark)
    rnd = random.Random(3)
    queries = [(100 + j, [rnd.gauss(0, 1) for _ in range(8)]) for j in range(7)]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = retrieve.dense_topk(qdf, corpus.repartition(5), k=4, metric=metric).collect()
    want = brute_dense(rows, queries, 4, metric)
    by_q = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_q.setdefault(r.query_id, []).append(r.vec_id)
    assert by_q == want


def test_dense_topk_query_batches_stay_exact(spark, monkeypatch):
    rows, corpus = vectors(spark)
    rnd = random.Random(5)
    queries = [(j, [rnd.gauss(0, 1) for _ in range(8)]) for j in range(11)]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<double>")
    whole = sorted(tuple(r) for r in retrieve.dense_topk(qdf, corpus, k=3).collect())
    monkeypatch.setattr(retrieve, "MAX_BLOCKS", 0)           # no broadcast: both sides dealt to cells
    monkeypatch.setattr(retrieve, "BAND_BYTES", 500)
    batched = sorted(tuple(r) for r in retrieve.dense_topk(qdf, corpus, k=3).collect())
    assert whole == batched


def test_filtered_topk_hot_label_many_queries(spark):
    # label 0 holds two thirds of the rows and 30 of the 32 queries ask for it
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)], 0 if i % 3 else 1 + i % 2)
            for i in range(600)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    qs = [(j, [float(x) for x in rnd.normal(size=6)], 0 if j < 30 else j - 29) for j in range(32)]
    qdf = spark.createDataFrame(qs, "query_id long, vector array<double>, label int")
    got = {}
    for r in sorted(retrieve.filtered_topk(qdf, corpus, k=3).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for qid, vec, lab in qs:
        same = [(v, e, l) for v, e, l in rows if l == lab]
        assert got[qid] == brute_dense(same, [(qid, vec)], 3)[qid]


def test_filtered_and_fallback(spark):
    rows, corpus = vectors(spark, labels=3)
    cents = retrieve.label_centroids(corpus).withColumnRenamed("label", "query_id") \
        .withColumn("label", F.when(F.col("query_id") == 2, F.lit(99)).otherwise(F.col("query_id")))
    hits = retrieve.topk_with_fallback(cents, corpus, k=3).collect()
    labels = {r[0]: r[2] for r in rows}
    for h in hits:
        if h.query_id == 2:
            assert h.used_fallback
        else:
            assert not h.used_fallback and labels[h.vec_id] == h.query_id
    assert len(hits) == 9


def tok(t):
    return [w for w in re.split(r"[^\w]+|[\d_]+", t.lower()) if w]


def brute_lexical(queries, docs, k):
    out = {}
    for qid, qt in queries:
        qc = Counter(tok(qt))
        nq = sum(v * v for v in qc.values())
        scored = []
        for did, dt in docs:
            dc = Counter(tok(dt))
            dot = sum(qc[w] * dc[w] for w in qc)
            if dot > 0:
                scored.append((1 - dot / math.sqrt(nq * sum(v * v for v in dc.values())), did))
        out[qid] = sorted(scored)[:k]
    return out


def test_lexical_topk_batches_stay_exact(spark, monkeypatch):
    rnd = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(9))) for i in range(60)],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(j, " ".join(rnd.choice(words) for _ in range(3))) for j in range(9)],
                              "query_id long, text string")
    whole = sorted(tuple(r) for r in retrieve.lexical_topk(q, docs, k=4).collect())
    monkeypatch.setattr(retrieve, "MAX_BLOCKS", 0)
    monkeypatch.setattr(retrieve, "BAND_BYTES", 700)
    assert sorted(tuple(r) for r in retrieve.lexical_topk(q, docs, k=4).collect()) == whole


def test_lexical_topk_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(200)]
    queries = [(1000 + j, " ".join(rnd.choice(words[:6]) for _ in range(5))) for j in range(9)]
    queries.append((2000, "nothing matches here"))
    qdf = spark.createDataFrame(queries, "query_id long, text string")
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = retrieve.lexical_topk(qdf, ddf, k=3).collect()
    want = brute_lexical(queries, docs, 3)
    by_q = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_q.setdefault(r.query_id, []).append((r.distance, r.doc_id))
    assert 2000 not in by_q
    for qid, lst in by_q.items():
        assert [d for _, d in lst] == [d for _, d in want[qid]]
        assert all(abs(a - b) < 1e-12 for (a, _), (b, _) in zip(lst, want[qid]))


def test_approx_topk_recall(spark):
    rows, corpus = vectors(spark, n=500, d=6, labels=4)
    cents = retrieve.label_centroids(corpus).withColumnRenamed("label", "query_id")
    exact = {(r.query_id, r.vec_id) for r in retrieve.dense_topk(cents, corpus, k=5).collect()}
    approx = retrieve.approx_topk(cents, corpus, k=5).collect()
    got = {(r.query_id, r.vec_id) for r in approx}
    assert len(got) == len(approx)                      # a vector counted once per query
    assert len(exact & got) / len(exact) >= 0.9


def test_context_and_chat_render(spark):
    docs = spark.createDataFrame([(1, "src1", "alpha beta text"), (2, "src2", "gamma only [D] accuracy")],
                                 "doc_id long, source string, text string")
    q = spark.createDataFrame([(10, "alpha gamma"), (11, "nothing")], "query_id long, text string")
    hits = retrieve.lexical_topk(q, docs, k=3)
    ctx = {r.query_id: r.context for r in retrieve.assemble_context(q, hits, docs).collect()}
    assert ctx[11] == ""
    blocks = ctx[10].split("--- Context (Source: ")
    assert len(blocks) == 3
    assert "[Section 12.5 Verified: Compliant]" in ctx[10] and fixed.WARNING_PREFIX in ctx[10]
    chat = {r.query_id: r.response for r in retrieve.render_chat(q, retrieve.assemble_context(q, hits, docs)).collect()}
    assert fixed.CHAT_NONE.split("{query}")[1] in chat[11]
    assert chat[10].startswith(fixed.CHAT_HEADER) and "### Chunks found" in chat[10]


SIG_CASES = [
    (None, ""), ("", ""), ("   \n  ", ""),
    ('Traceback (most recent call last):\n  File "app_engine.py", line 42, in ask\n'
     '    raise ValueError("Invalid configuration for ORCA track")\n'
     'ValueError: Invalid configuration for ORCA track',
     "app_engine ValueError: Invalid configuration for ORCA track"),
    ('  File "/x/app_a.py", line 1\n  File "/y/lib.py", line 2\n  File "/z/app_a.py", line 3\n'
     '  File "/w/app_b.tar.gz", line 4\nKeyError: k', "app_a app_b.tar KeyError: k"),
    ("Traceback (most recent call last):\n  File \"/q/other.py\", line 1", None),
]


def test_error_signatures(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SIG_CASES)], "log_id long, traceback string")
    got = {r.log_id: r.signature for r in triage.error_signatures(df).collect()}
    for i, (tb, want) in enumerate(SIG_CASES):
        if want is None:
            want = tb[-200:]
        assert got[i] == want


def test_prompts_and_summaries(spark):
    files = spark.createDataFrame(
        [("doc_1.md", "# Fix guide #troubleshooting\nValueError bad value means the input file is wrong."),
         ("doc_2.md", "# Other notes that are long enough to keep #misc\nnothing about errors here at all")],
        "file string, text string")
    chunks = ingest.build_chunks(files)
    logs = spark.createDataFrame(
        [(1, None, 1, 'File "/a/app_x.py", line 3\nValueError: bad value 3', "How?"),
         (2, None, 2, "", None)],
        "log_id long, ts timestamp, user_id long, traceback string, question string")
    p = {r.log_id: r.prompt for r in triage.build_prompts(logs, chunks).collect()}
    assert fixed.PROMPT_CONTEXT_HEAD + "\n### Source 1: doc_1.md (Confidence: " in p[1]
    assert "## Question\nHow?\n" in p[1] and fixed.PROMPT_INSTRUCTIONS in p[1]
    assert fixed.PROMPT_NO_CONTEXT in p[2] and "## Question" not in p[2]
    s = {r.log_id: r.summary for r in triage.render_summaries(logs, chunks).collect()}
    assert "**Signature:** `app_x ValueError: bad value 3`" in s[1]
    assert "**1. doc_1.md** (Confidence: " in s[1]
    assert fixed.SUMMARY_NONE in s[2]
    d = {r.log_id: r for r in triage.diagnose_errors(logs, chunks).collect()}
    assert d[1].n_hits == 1 and d[1].sources == "doc_1.md" and not d[1].used_fallback
    assert d[2].n_hits == 0


def test_lexical_kernel_slices_do_not_change_results(spark, monkeypatch):
    from quire.operators import kernels
    rnd = random.Random(21)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))))
                                  for i in range(150)], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(j, " ".join(rnd.choice(words) for _ in range(4))) for j in range(7)],
                              "query_id long, text string")
    whole = sorted(tuple(r) for r in retrieve.lexical_topk(q, docs, k=5).collect())
    monkeypatch.setattr(kernels, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(kernels, "BLOCK_TOKENS", 5)
    monkeypatch.setattr(kernels, "PACK_ROWS", 3)
    sliced = sorted(tuple(r) for r in retrieve.lexical_topk(q, docs, k=5).collect())
    assert sliced == whole


def test_null_vectors_are_not_candidates(spark):
    rows = [(1, [0.0, 0.0], 0), (2, None, 0), (3, [1.0, 1.0], 0), (4, [5.0, 5.0, 5.0], 0)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(7, [0.1, 0.1], 0), (8, None, 0)], "query_id long, vector array<double>, label int")
    got = [(r.query_id, r.vec_id) for r in retrieve.dense_topk(q, corpus, k=5).orderBy("rank").collect()]
    assert got == [(7, 1), (7, 3)]
    got_f = [(r.query_id, r.vec_id) for r in retrieve.filtered_topk(q, corpus, k=5).orderBy("rank").collect()]
    assert got_f == [(7, 1), (7, 3)]


def test_approx_topk_does_not_depend_on_scale_and_fills_k(spark):
    rnd = np.random.default_rng(3)
    vecs = rnd.normal(size=(300, 8))
    for scale in (1.0, 20.0):
        corpus = spark.createDataFrame([(i, [float(x) * scale for x in v]) for i, v in enumerate(vecs)],
                                       "vec_id long, embedding array<double>")
        queries = corpus.where("vec_id < 12").selectExpr("vec_id as query_id", "embedding as vector")
        rows = retrieve.approx_topk(queries, corpus, k=4).collect()
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in rows)
        assert len(got) == 48
        if scale == 1.0:
            first = got
    assert got == first


def test_vectors_without_a_distance_are_no_candidates(spark):
    nan = float("nan")
    corpus = spark.createDataFrame([(i, [nan, 1.0]) for i in range(4)] + [(8, [0.0, 0.0]), (9, [1.0, 1.0])],
                                   "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>")
    assert [r.vec_id for r in retrieve.dense_topk(queries, corpus, 3).orderBy("rank").collect()] == [9, 8]
    assert [r.vec_id for r in retrieve.dense_topk(queries, corpus, 3, "cosine").collect()] == [9]


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d)) * 20
    return centres[r.integers(0, 12, n)] + r.normal(size=(n, d))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_bounds_prune_pairs_and_keep_results(monkeypatch, metric):
    """One kernel over many blocks: most pairs are never scored, the hits are exact."""
    import pyarrow as pa
    from quire.operators import kernels

    monkeypatch.setattr(kernels, "BLOCK_CELLS", 64 * 40)
    x, q = clustered(6000, 8, 1), clustered(40, 8, 1)
    queries = kernels.DenseQueries(pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(q.tolist())], names=["q", "v"]), metric)
    schema = pa.schema([("id", pa.int64())])
    top = kernels.TopK(3, 40, schema)
    for s in range(0, 6000, 2000):
        ids = pa.array(range(s, s + 2000))
        queries.process(pa.RecordBatch.from_arrays([ids, pa.array(x[s:s + 2000].tolist())], names=["id", "v"]), top,
                        pa.Table.from_arrays([ids], schema=schema))
    top.settle()
    if metric == "l2sq":
        far = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    else:
        far = 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    want = np.argsort(far, axis=1, kind="stable")[:, :3]
    got = [top.rows.column(0).to_numpy()[top.q == i].tolist() for i in range(40)]
    assert got == want.tolist()
    assert queries.scored < 0.4 * queries.seen


def test_lexical_bound_skips_queries_without_losing_hits(spark):
    rnd = random.Random(5)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(400)]
    queries = [(f"q{j}", " ".join(rnd.choices(words, k=3))) for j in range(30)]
    got = retrieve.lexical_topk(spark.createDataFrame(queries, "query_id string, text string"),
                                spark.createDataFrame(docs, "doc_id long, text string").repartition(2), k=4).collect()
    want = brute_lexical(queries, docs, 4)
    for qid, hits in want.items():
        mine = sorted((r["rank"], r.doc_id, r.distance) for r in got if r.query_id == qid)
        assert [m[1] for m in mine] == [h[1] for h in hits]


@pytest.mark.parametrize("limit", [0, 16])
def test_ids_of_any_type_and_tags(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieve, "MAX_BLOCKS", limit)
    rows = [("b_1", "alpha beta", "en,setup"), ("a_1", "alpha beta", "none"), ("a_1", "alpha beta", "none"), ("c", "alpha", "setup"),
            (None, "alpha beta", "en"), ("d", None, "en"), ("e", "", None), ("f", "alpha beta gamma", None)]
    docs = spark.createDataFrame(rows, "chunk_id string, text string, tags_joined string")
    q = spark.createDataFrame([("q1", "Alpha beta", None), ("q2", "alpha beta", "#setup"), ("q3", "alpha", "absent"), ("q4", "", "en"),
                               ("q5", None, None)], "query_id string, text string, tag string")
    hits = retrieve.lexical_topk(q, docs, 3, id_col="chunk_id", query_tag="tag", distinct=True).collect()
    by = {}
    for r in sorted(hits, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.chunk_id)
    assert by == {"q1": [None, "a_1", "b_1"], "q2": ["b_1", "c"]}
    twice = retrieve.lexical_topk(q.where("query_id = 'q1'"), docs, 3, id_col="chunk_id").collect()
    assert [r.chunk_id for r in sorted(twice, key=lambda r: r["rank"])] == [None, "a_1", "a_1"]
    full = {r.query_id: (r.chunk_id, r.used_fallback) for r in retrieve.search_with_fallback(
        q, docs, 1, id_col="chunk_id", distinct=True).collect()}
    assert full == {"q1": (None, False), "q2": ("b_1", False), "q3": ("c", True)}
    vecs = spark.createDataFrame([("z", [1.0, 0.0]), ("y", [1.0, 0.0]), ("x", [0.0, 5.0])], "vec_id string, embedding array<double>")
    vq = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r.vec_id for r in retrieve.dense_topk(vq, vecs, 2).orderBy("rank").collect()] == ["y", "z"]
    assert [r.vec_id for r in retrieve.approx_topk(vq, vecs, 2).orderBy("rank").collect()] == ["y", "z"]


def test_approx_topk_of_odd_rows(spark):
    ddl = "vec_id long, embedding array<double>"
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])], "query_id long, vector array<double>")
    rows = [(1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [2.0, 2.0])]
    got = [(r.query_id, r.vec_id) for r in retrieve.approx_topk(q, spark.createDataFrame(rows, ddl), 3).collect()]
    assert sorted(got) == [(1, 1), (1, 5), (1, 6), (3, 3)]
    assert retrieve.approx_topk(q, spark.createDataFrame([], ddl), 3).count() == 0
    assert retrieve.approx_topk(q.where("query_id = 9"), spark.createDataFrame(rows, ddl), 3).count() == 0


def test_short_prompts_and_top_module(spark):
    q = spark.createDataFrame([(1, "Why?"), (2, "How?"), (3, None)], "query_id long, text string")
    ctx = spark.createDataFrame([(1, "block"), (2, "")], "query_id long, context string")
    got = {r.query_id: r.prompt for r in retrieve.short_prompts(q, ctx).collect()}
    assert got == {1: "Context:\nblock\n\nQuestion:\nWhy?", 2: "How?", 3: ""}
    tb = 'File "/a/{}.py", line 1\nFile "/a/{}.py", line 2\nKeyError: k'
    logs = spark.createDataFrame([("s", tb.format("m", "b")), ("s", tb.format("b", "c")), ("s", tb.format("c", "c")), ("t", None)],
                                 "signature string, traceback string").withColumn("user_id", F.lit(1)).withColumn("ts", F.lit(None).cast("timestamp"))
    assert {r.signature: r.top_module for r in triage.error_triage(logs).collect()} == {"s": "b", "t": None}


def test_nothing_of_the_signatures_passes_the_driver(spark, monkeypatch):
    """Beyond the bound the query side is a table from end to end."""
    monkeypatch.setattr(retrieve, "MAX_BLOCKS", 0)
    sig = spark.range(3000).selectExpr("concat('error value', cast(id as string), ' app_', char(97 + id % 26)) AS signature")
    chunks = spark.createDataFrame([(f"f{i}.md_{i:016x}", f"app_{chr(97 + i % 26)} error notes", "none") for i in range(60)],
                                   "chunk_id string, text string, tags_joined string")
    hits = triage.signature_hits(sig, chunks, 2)
    assert hits.count() == 6000 and hits.where("NOT used_fallback").count() == 0


def test_lexical_kernel_works_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from quire.operators import kernels

    words = [f"w{i}" for i in range(40)]
    queries = pa.RecordBatch.from_arrays(
        [pa.array(range(150)), pa.array([words[i % 20:i % 20 + 20] for i in range(150)]), pa.array([[1] * 20] * 150, pa.list_(pa.int64()))],
        names=["query_id", "terms", "tfs"])
    rows = pa.RecordBatch.from_arrays([pa.array(range(6_000)), pa.array([words] * 6_000)], names=["id", "tokens"])
    asked = kernels.LexicalQueries(queries)
    top = kernels.TopK(3, 150, pa.schema([("id", pa.int64())]))
    tracemalloc.start()
    asked.process(rows, top, pa.Table.from_batches([rows.select(["id"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    top.settle()
    assert len(top.q) == 450
    assert peak < 100 << 20
