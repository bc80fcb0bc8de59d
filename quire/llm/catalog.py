"""Registered queries of this subpackage and their oracle SQL.

Each query applies its operator, with production parameters, to the whole
table and returns the whole result. Where SQL cannot express a result (a
tokenizer's ids, file contents, mined or learned rules, SimHash, a sequential
schedule, spans) there is no oracle and the tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (bpe_automaton, collocations, fuzzy_lines, hard_negatives, parity_join, pfair_mix, quality_rules, secret_scan, spotsigs,
                       token_shards, toxicity, url_rules, warc)
from quire.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_shards.scan_shards(token_shards.write_shards(docs, TOKENIZER))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", bad.alias("blocked"))
    return url_rules.judge(pages, labelled)


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fuzzy_lines.dedupe(read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"),
                       F.col("__n_removed").cast("long").alias("n_removed"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.place(read(spark, sf_dir, "documents", "doc_id", "text", "source")) \
        .select("doc_id", "source", "block", "slot", "in_mix")


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.pages_of(spark, folder).select(
        F.col("page_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0).drop("positive_rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents", "text", "lang"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_shards, op2_quality_rules, op3_url_rules, op4_parity_join, op5_toxicity, op6_fuzzy_lines,
    op7_pfair_mix, op8_bpe_automaton, op9_spotsigs, op10_secret_scan, op11_warc, op12_hard_negatives, op13_collocations,
    pipeline)}

_SPACE = r"[\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"

ORACLE = {
    "op2_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS x
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, sum(least(8, gap)) AS n FROM (
    SELECT r, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8) AS gap FROM rep) GROUP BY r
), s AS (
  SELECT doc_id, t, ws, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)
), b AS (
  SELECT *, coalesce(wc, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols * 10 > n_words * 3
    OR n_dup_lines * 10 > len(string_split(t, chr(10))) * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 20
    OR (length(t) - length(replace(t, '!', ''))) * 10 > n_words * 3
    OR (length(t) - length(regexp_replace(t, '[{_UPPER}]', '', 'g'))) * 2 > word_chars
    OR length(regexp_replace(t, '[^\pL]+', '', 'g')) * 2 < word_chars
    OR len(list_distinct(ws)) * 20 < n_words) AS kept
FROM b""",
    "op4_parity_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'),
           lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: list_slice(ws, i, i + 3))) END AS items FROM d
), e AS (
  SELECT doc_id, unnest(items) AS x FROM s
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_have JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.items) + len(y.items) - n)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, k.b FROM reach r JOIN sides k ON k.a = r.other
)
SELECT s.doc_id, any_value(len(items))::BIGINT AS n_shingles, min(other) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id""",
    "op11_warc": """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(encode(t)) AS payload_digest,
         row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS r,
         max(page_id) OVER (PARTITION BY t) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND r > 1 THEN top END AS refers_to
FROM d""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER w AS k
  FROM s WHERE same WINDOW w AS (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br)
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same
  WHERE k <= 5 AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_collocations": r"""
WITH p AS (
  SELECT row_number() OVER () AS r, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), t AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, s, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: list_slice(ws, i, i + s - 1))) AS x
  FROM w CROSS JOIN (VALUES (1), (2), (3)) v(s) WHERE len(ws) >= s
), f AS (
  SELECT lang, x, count(*)::BIGINT AS a FROM g GROUP BY lang, x HAVING count(*) >= 10
), c AS (
  SELECT * FROM f WHERE len(x) > 1
), inner_parts AS (
  SELECT lang, y, max(a) AS around FROM (
    SELECT lang, a, unnest([list_slice(x, 1, 2), list_slice(x, 2, 3)]) AS y FROM c WHERE len(x) = 3) GROUP BY lang, y
), kept AS (
  SELECT c.* FROM c LEFT JOIN inner_parts i ON i.lang = c.lang AND i.y = c.x
  WHERE around IS NULL OR 100 * around < 50 * a
), cuts AS (
  SELECT k.lang, k.x, k.a, l.a AS l, r.a AS r, cut,
         ((k.a::HUGEINT * k.a::HUGEINT * 1000000) // (l.a::HUGEINT * r.a::HUGEINT))::BIGINT AS score
  FROM kept k CROSS JOIN (VALUES (1), (2)) v(cut)
  JOIN f l ON l.lang = k.lang AND l.x = list_slice(k.x, 1, cut)
  JOIN f r ON r.lang = k.lang AND r.x = list_slice(k.x, cut + 1, len(k.x))
  WHERE cut < len(k.x)
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) AS b FROM cuts
), ranked AS (
  SELECT lang, list_aggregate(x, 'string_agg', ' ') AS phrase, a, l, r, score FROM lowest WHERE b = 1
), top AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN t USING (lang) WHERE rank <= 2000""",
}
