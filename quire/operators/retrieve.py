"""Retrieval: exact dense and lexical top-k per query, filters, fallback,
score intervals, context blocks, prompts and summaries.

Top-k plan (B1-B4, B6)
----------------------
The queries are packed into blocks of bounded size inside their tasks. If there
are no more than ``MAX_BLOCKS`` (one more is asked for, to know) they are
broadcast: every corpus partition scores its rows where they lie and emits its k
best rows per query, and a window ranks these. Beyond the bound the queries'
blocks are a written table: corpus rows are packed into blocks, too, both sides
are dealt out to (query band, corpus partition) and joined on it, and every cell
of the join emits its k best. Either way the same kernels score the same pairs, the memory of a task is that of a few
blocks, and no query x row pairs are formed as rows.

Ids of queries and rows may be of any type that has an order. Losing candidates
carry ids only: texts of the winners are fetched after the ranking
(``assemble_context``), unless a caller asks for ``payload``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.columns import fill, half_up, with_interval
from quire.operators import kernels
from quire.operators.audit import audit_struct
from quire.session import cut_lineage

MAX_BLOCKS = 16                  # query blocks (kernels.PACK_BYTES each) that are broadcast together
BAND_BYTES = 16 << 20            # query blocks of one band, beyond that
CELLS, SAMPLE, SAMPLE_QUERIES, ROUNDS = 32, 8192, 256, 6
RECALL = 0.97                    # share of the sample's neighbours that the probed cells must hold


def tokens(text: str | Column) -> Column:
    """Lower-cased letter runs of a text (whole text, JVM-side)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+", -1), lambda t: t != "")


def search(queries: DataFrame, corpus: DataFrame, prepare, k: int, payload=(), distinct: bool = False) -> DataFrame:
    """The k best rows of ``corpus`` (id first) for each of ``queries`` (query_id
    first): ``query_id, rank, id, distance`` and the payload columns. ``prepare``
    makes the kernel of a query block from its Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = corpus.sparkSession
    id_col = corpus.columns[0]
    found = StructType([queries.schema[0], corpus.schema[0], StructField("distance", DoubleType()),
                        *(corpus.schema[c] for c in payload)])
    schema = to_arrow_schema(found)
    blocks = queries.mapInArrow(kernels.pack(), "part int, n long, data binary")
    probe = blocks.select("data").limit(MAX_BLOCKS + 1).collect()
    if not probe:                    # no query: the corpus is not read
        return spark.createDataFrame([], found).select(
            "query_id", F.lit(0).alias("rank"), id_col, "distance", *payload)
    if len(probe) <= MAX_BLOCKS:
        asked = spark.sparkContext.broadcast([bytes(r[0]) for r in probe])
        hits = corpus.mapInArrow(kernels.broadcast_search(asked, prepare, k, schema, distinct), found)
    else:
        packed = corpus.mapInArrow(kernels.pack(), "part int, n long, data binary")
        blocks = cut_lineage(blocks)
        size = blocks.agg(F.sum(F.octet_length("data"))).first()[0]
        slots, bands = max(1, corpus.rdd.getNumPartitions()), -(-size // BAND_BYTES)
        left = blocks.select(F.pmod(F.xxhash64("data"), F.lit(bands)).cast("int").alias("band"), F.col("data").alias("asked"),
                             F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("part"))
        right = packed.select("part", "data", F.explode(F.sequence(F.lit(0), F.lit(int(bands) - 1))).alias("band"))
        cells = left.join(right, ["band", "part"]).select("asked", "data")
        hits = cells.mapInArrow(kernels.cell_search(prepare, k, schema, distinct), found)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    rank = F.dense_rank() if distinct else F.row_number()
    out = hits.withColumn("rank", rank.over(w)).where(F.col("rank") <= k)
    if distinct:                     # rows of one id are equal: one of them
        out = out.dropDuplicates(["query_id", "rank"])
    return out.select("query_id", "rank", id_col, "distance", *payload)


def _dense_queries(queries: DataFrame, key: str, vec: str, *more: Column) -> DataFrame:
    return queries.select(F.col(key).alias("query_id"), F.col(vec).cast("array<double>").alias("vector"), *more) \
        .where(F.col("vector").isNotNull())


def _rows(corpus: DataFrame, id_col: str, *values, payload=()) -> DataFrame:
    """Id, what is scored, and payload; an id may be payload's only under another name."""
    return corpus.select(F.col(id_col), *(v.alias(f"__{i}") for i, v in enumerate(values)),
                         *(c for c in payload if c != id_col))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2sq",
               query_key: str = "query_id", query_vec: str = "vector",
               id_col: str = "vec_id", vec_col: str = "embedding", payload=()) -> DataFrame:
    """B1: the k nearest corpus vectors per query (``l2sq`` or ``cosine``).

    Output ``query_id, rank, <id_col>, distance``; ties broken by id. NULL
    vectors, vectors of another length and those without a distance (a NULL or
    NaN component; no length under cosine) are no candidates.
    """
    return search(_dense_queries(queries, query_key, query_vec), _rows(corpus, id_col, F.col(vec_col), payload=payload),
                  partial(kernels.DenseQueries, metric=metric), k, payload)


def query_terms(queries: DataFrame, query_key: str = "query_id", text: str = "text", tag: str | None = None) -> DataFrame:
    """``query_id, terms, tfs`` (and ``tag``) of the query set; queries without a term drop out."""
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(tokens(text)).alias("term"),
                       (F.col(tag) if tag else F.lit(None).cast("string")).alias("tag"))
    counted = q.groupBy("query_id", "tag", "term").agg(F.count(F.lit(1)).alias("tf"))
    per = counted.groupBy("query_id", "tag").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("t"))
    out = per.select("query_id", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs"),
                     F.regexp_replace("tag", "^#", "").alias("tag"))
    return out if tag else out.drop("tag")


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int = 3,
                 query_key: str = "query_id", query_text: str = "text",
                 id_col: str = "doc_id", text_col: str = "text", payload=(), query_tag: str | None = None,
                 tags_col: str = "tags_joined", distinct: bool = False) -> DataFrame:
    """B2: the k corpus texts closest to each query text by term-count cosine.

    distance = 1 - dot / sqrt(|q|^2 |c|^2) over whole texts, with integer
    counts; candidates share at least one term with the query.
    Output ``query_id, rank, <id_col>, distance`` (+ payload columns).

    With ``query_tag`` (B3 for texts) a query with a tag, a leading ``#`` aside,
    finds only rows whose joined tags contain it; one with NULL finds all.
    With ``distinct`` rows of one id, which must then be equal, count once.
    """
    scored = [tokens(text_col)] + ([F.col(tags_col)] if query_tag else [])
    return search(query_terms(queries, query_key, query_text, query_tag), _rows(corpus, id_col, *scored, payload=payload),
                  partial(kernels.LexicalQueries, tagged=bool(query_tag)), k, payload, distinct)


def filtered_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2sq",
                  filter_key: str = "label", query_key: str = "query_id",
                  query_vec: str = "vector", id_col: str = "vec_id",
                  vec_col: str = "embedding", payload=()) -> DataFrame:
    """Per query, the k nearest corpus vectors among those whose
    ``filter_key`` equals the query's ``filter_key`` (filter, then top-k; NULL
    equals nothing). A row is scored only against the queries that ask for its
    value, however many queries share a value or rows have it.
    """
    return search(_dense_queries(queries, query_key, query_vec, F.col(filter_key).alias("_fk")),
                  _rows(corpus, id_col, F.col(vec_col), F.col(filter_key), payload=payload),
                  partial(kernels.DenseQueries, metric=metric, filtered=True), k, payload)


def with_fallback(queries: DataFrame, query_key: str, first: DataFrame, again) -> DataFrame:
    """``first``'s hits, and ``again(queries)`` for the queries it has none for; adds ``used_fallback``."""
    first = cut_lineage(first)       # queries x k rows at most, read twice below
    missing = queries.join(first.select(F.col("query_id").alias(query_key)).distinct(), query_key, "left_anti")
    return first.withColumn("used_fallback", F.lit(False)) \
        .unionByName(again(missing).withColumn("used_fallback", F.lit(True)))


def topk_with_fallback(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2sq",
                       filter_key: str = "label", **kw) -> DataFrame:
    """Filtered top-k; queries it finds nothing for are searched again
    without the filter. The filter only applies when ``k <= 3``.
    Output adds ``used_fallback``."""
    if k > 3:
        return dense_topk(queries, corpus, k, metric, **kw).withColumn("used_fallback", F.lit(False))
    return with_fallback(queries, kw.get("query_key", "query_id"), filtered_topk(queries, corpus, k, metric, filter_key, **kw),
                         lambda missing: dense_topk(missing, corpus, k, metric, **kw))


def search_with_fallback(queries: DataFrame, corpus: DataFrame, k: int = 3, query_tag: str = "tag",
                         query_key: str = "query_id", **kw) -> DataFrame:
    """B4 for texts: lexical top-k under each query's tag; queries that find
    nothing under it are searched again without. The tags only apply when
    ``k <= 3``. Output adds ``used_fallback``."""
    if k > 3:
        return lexical_topk(queries, corpus, k, query_key, **kw).withColumn("used_fallback", F.lit(False))
    return with_fallback(queries, query_key, lexical_topk(queries, corpus, k, query_key, query_tag=query_tag, **kw),
                         lambda missing: lexical_topk(missing, corpus, k, query_key, **kw))


def score_intervals(hits: DataFrame, distance: str = "distance", level: float = 0.95) -> DataFrame:
    """Interval struct plus the confidence text per hit."""
    out = with_interval(hits, distance, "interval", level)
    return out.withColumn("confidence", confidence_text(F.col("interval")))


def confidence_text(interval: Column) -> Column:
    return fill(fixed.CONFIDENCE_TEXT, lower=interval["lower_bound"].cast("string"), upper=interval["upper_bound"].cast("string"))


def context_block(source: Column, interval: Column, doc: Column, level: float = 0.95,
                  verdict: Column | None = None) -> Column:
    """One retrieved block: source, interval bounds, audit tag, then the text.
    Pass ``verdict`` (an ``audit_struct`` column computed earlier) to avoid
    auditing the text twice."""
    verdict = audit_struct(doc) if verdict is None else verdict
    tag = F.when(verdict["compliant"], F.lit(fixed.COMPLIANT_TAG)).otherwise(verdict["warning"])
    return fill(fixed.CONTEXT_BLOCK, source=source, level=F.lit(str(int(level * 100))),
                lower=interval["lower_bound"].cast("string"), upper=interval["upper_bound"].cast("string"), tag=tag, doc=doc)


def ordered_join(items: Column, sep: str) -> Column:
    """Join the ``text`` of collected (rank, text) structs in rank order."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), sep)


def assemble_context(queries: DataFrame, hits: DataFrame, docs: DataFrame | None = None,
                     query_key: str = "query_id", id_col: str = "doc_id",
                     source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per query, its hit blocks joined by newlines in rank order; empty
    string when the query has no hits. Each group holds at most k blocks.

    ``docs`` is joined for the source and text of the hits, whose table is
    written first: its size is known then, and where it is small the texts are
    fetched by a broadcast of the hits. Pass ``None`` when the hits already
    carry them (top-k with ``payload=[source, text]``)."""
    if docs is not None:
        hits = cut_lineage(hits).join(docs.select(F.col(id_col), F.col(source_col).alias("_src"), F.col(text_col).alias("_doc")), id_col)
    else:
        hits = hits.withColumnRenamed(source_col, "_src").withColumnRenamed(text_col, "_doc")
    scored = score_intervals(hits)
    blocks = (scored.withColumn("_verdict", audit_struct("_doc"))
              .select("query_id", F.struct(F.col("rank"), context_block(
                  F.col("_src"), F.col("interval"), F.col("_doc"),
                  verdict=F.col("_verdict")).alias("text")).alias("b")))
    per_query = blocks.groupBy("query_id").agg(ordered_join(F.collect_list("b"), "\n").alias("context"))
    return (queries.select(F.col(query_key).alias("query_id")).distinct()
            .join(per_query, "query_id", "left")
            .withColumn("context", F.coalesce(F.col("context"), F.lit(""))))


def render_chat(queries: DataFrame, contexts: DataFrame, query_key: str = "query_id",
                query_text: str = "text") -> DataFrame:
    """B9 (chat form): the retrieval-only answer for a question and its context,
    with the audit warning appended when the answer is not compliant."""
    j = queries.select(F.col(query_key).alias("query_id"), F.col(query_text).alias("question")).join(
        contexts, "query_id", "left")
    ctx = F.coalesce(F.col("context"), F.lit(""))
    none = (ctx == "") | ctx.startswith(fixed.VAULT_ERROR_PREFIX)
    q = F.col("question")
    none_text = F.concat(F.lit(fixed.CHAT_HEADER), fill(fixed.CHAT_NONE, query=q))
    found_text = F.concat(F.lit(fixed.CHAT_HEADER), fill(fixed.CHAT_FOUND, query=q, context=ctx))
    # staged: the answer text and its verdict are each computed once
    staged = (j.withColumn("resp", F.when(none, none_text).otherwise(found_text))
              .withColumn("verdict", audit_struct("resp")))
    ok = F.col("verdict.compliant") | (F.col("verdict.warning") == "")
    return staged.select("query_id", F.when(ok, F.col("resp")).otherwise(
        F.concat(F.col("resp"), F.lit("\n\n"), F.col("verdict.warning"))).alias("response"))


def short_prompts(queries: DataFrame, contexts: DataFrame, query_key: str = "query_id",
                  query_text: str = "text") -> DataFrame:
    """B8 (short form): the question behind its context blocks, or the question
    alone where nothing was found: ``query_id, prompt``."""
    j = queries.select(F.col(query_key).alias("query_id"), F.col(query_text).alias("question")).join(contexts, "query_id", "left")
    ctx, q = F.coalesce(F.col("context"), F.lit("")), F.coalesce(F.col("question"), F.lit(""))
    return j.select("query_id", F.when(ctx == "", q).otherwise(fill(fixed.SHORT_PROMPT, context=ctx, question=q)).alias("prompt"))


def rounded(c: str, digits: int = 6) -> Column:
    """Distances reported to fixed decimals (same rule in the oracle SQL)."""
    return half_up(F.col(c), digits).alias(c)


def label_centroids(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label: (label, vector array<double>).

    Exploding to (label, position, value) lets the mean be combined per
    partition before the shuffle, so a label holding most rows is cheap.
    """
    per_dim = (vectors.select(label, F.posexplode(vec_col).alias("pos", "x"))
               .groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return per_dim.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def _sample(rows: DataFrame, vec: str, n: int, seed: int) -> list:
    """At most ``n`` usable vectors, the first in the order of a hash."""
    usable = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                               & (F.abs(x.cast("double")) < float("inf")))
    return [r[0] for r in rows.where(usable).select(F.col(vec).cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), vec).alias("h"))
            .orderBy("h").limit(n).collect()]


def train_cells(corpus: DataFrame, queries: DataFrame, k: int, vec_col: str, query_vec: str, cells: int = CELLS,
                probes: int | None = None, seed: int = 7) -> dict | None:
    """Centroids of at most ``cells`` cells by k-means on ``SAMPLE`` vectors at
    most, the mean square of their members' residuals, and how many cells a query
    is to probe: the fewest that hold ``RECALL`` of the k nearest sampled vectors
    of ``SAMPLE_QUERIES`` queries at most. None without a usable vector."""
    rows = _sample(corpus, vec_col, SAMPLE, seed)
    if not rows:
        return None
    lens = [len(r) for r in rows]
    dim = max(sorted(set(lens)), key=lens.count)
    x = np.array([r for r in rows if len(r) == dim], np.float64)
    start = np.unique(x, axis=0)
    centroids = start[np.random.default_rng(seed).permutation(len(start))[:max(1, min(cells, len(start) // 8))]]
    for _ in range(ROUNDS):
        mine = kernels.nearest(x, centroids)
        n = np.bincount(mine, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    mine = kernels.nearest(x, centroids)
    n = np.bincount(mine, minlength=len(centroids))
    spread = np.bincount(mine, weights=((x - centroids[mine]) ** 2).sum(axis=1), minlength=len(centroids)) / np.maximum(n, 1)
    q = [v for v in _sample(queries, query_vec, SAMPLE_QUERIES, seed) if len(v) == dim] if probes is None else []
    if q:
        q = np.array(q, np.float64)
        order = kernels.cell_order(q, centroids, spread)
        near = np.argsort(kernels._square(q, x), axis=1)[:, :k]
        place = np.sort(np.argsort(order, axis=1)[np.arange(len(q))[:, None], mine[near]].ravel())
        probes = int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)]) + 1
    return {"centroids": centroids, "spread": spread, "probes": probes or len(centroids)}


def approx_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, cells: int = CELLS, probes: int | None = None, seed: int = 7,
                metric: str = "l2sq", query_key: str = "query_id", query_vec: str = "vector",
                id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate nearest neighbours by trained cells.

    k-means on a bounded sample gives the cells; every corpus vector belongs to
    the cell of its nearest centroid (one copy of each vector, assigned where it
    is scored). A query probes cells in the order of their members' mean distance,
    as many as the sample shows to be needed (``train_cells``) or as stated. A
    query that finds fewer than k rows so is searched exactly, so NULL and short
    vectors and an empty corpus give what ``dense_topk`` gives. Recall is checked
    against ``dense_topk``.
    """
    trained = train_cells(corpus, queries, k, vec_col, query_vec, cells, probes, seed)
    exact = partial(dense_topk, corpus=corpus, k=k, metric=metric, query_key=query_key, query_vec=query_vec,
                    id_col=id_col, vec_col=vec_col)
    if trained is None:
        return exact(queries)
    asked = _dense_queries(queries, query_key, query_vec)
    probed = cut_lineage(search(asked, _rows(corpus, id_col, F.col(vec_col)),
                                partial(kernels.DenseQueries, metric=metric, **trained), k))
    full = probed.where(F.col("rank") == k).select("query_id")
    short = queries.join(full.withColumnRenamed("query_id", query_key), query_key, "left_anti")
    return probed.join(full, "query_id", "left_semi").unionByName(exact(short))
