"""Registered queries: one callable per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole input
tables (or inputs Spark derives from them). Column names equal the names in
``quire.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import audit, capacity, ingest, redact, report, retrieve, route, triage
from quire.session import cut_lineage
from quire.sources import derived as D
from quire.sources import files
from quire.sources.tables import read_table
from quire.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.build_chunks(D.md_docs(spark, sf_dir))


@register("chunk_documents")
def q_chunk_documents(spark, sf_dir):
    c = corpus_chunks(spark, sf_dir)
    return c.select("chunk_id", "file", "pos", "text", "tags_joined",
                    F.length("text").cast("long").alias("n_chars"))


@register("tag_index")
def q_tag_index(spark, sf_dir):
    return ingest.tag_index(corpus_chunks(spark, sf_dir))


# ---------------------------------------------------------------- corpus set steps
def existing_collection(spark, sf_dir):
    """The collection before the sync: chunks of the English documents."""
    return ingest.build_chunks(D.md_docs(spark, sf_dir).where(F.col("lang") == "en"))


@register("upsert_chunks")
def q_upsert_chunks(spark, sf_dir):
    existing = ingest.dedupe_chunks(existing_collection(spark, sf_dir))
    incoming = corpus_chunks(spark, sf_dir)
    out = ingest.upsert_chunks(existing, incoming)
    return out.select("chunk_id", "file", "pos", "tags_joined", "origin")


@register("filter_by_tag")
def q_filter_by_tag(spark, sf_dir):
    return ingest.filter_by_tag(corpus_chunks(spark, sf_dir), "#incode").select(
        "chunk_id", "file", "pos", "tags_joined")


@register("filter_by_tag_exact")
def q_filter_by_tag_exact(spark, sf_dir):
    return ingest.filter_by_tag(corpus_chunks(spark, sf_dir), "en", mode="exact").select(
        "chunk_id", "file", "pos", "tags_joined")


@register("sync_report")
def q_sync_report(spark, sf_dir):
    existing = existing_collection(spark, sf_dir)
    return report.sync_report(D.md_docs(spark, sf_dir), existing)


@register("corpus_report")
def q_corpus_report(spark, sf_dir):
    return report.corpus_report(corpus_chunks(spark, sf_dir))


@register("corpus_quantiles")
def q_corpus_quantiles(spark, sf_dir):
    """Length quantiles per source from the sketches of two increments (English
    texts, then all others), and whether their true ranks are within the bound."""
    docs = read_table(spark, sf_dir, "documents", balance=False).select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"))
    early = F.col("lang") == "en"
    merged = report.merge_length_sketches("source", report.length_sketches(docs.where(early), "source"),
                                          report.length_sketches(docs.where(~early), "source"))
    errors = report.rank_errors(report.length_quantiles(merged, "source", [0.5, 0.9, 0.99]), docs, "source")
    return errors.select("source", "n_chunks", "n_chars", "p", (F.col("rank_error") <= report.RANK_ERROR).alias("within_bound"))


@register("tag_index_merged")
def q_tag_index_merged(spark, sf_dir):
    """The tag index from the sketches of two increments that share files, beside
    the exact counts: whether the estimate is within 2 %."""
    c = corpus_chunks(spark, sf_dir)
    early = F.col("pos") % 2 == 0
    merged = ingest.merge_tag_sketches(ingest.tag_sketches(c.where(early)), ingest.tag_sketches(c.where(~early)))
    both = ingest.estimated_tag_index(merged).withColumnRenamed("n_files", "estimate") \
        .join(ingest.tag_index(c).select("tag", "n_files"), "tag")
    near = F.abs(F.col("estimate") - F.col("n_files")) <= 0.02 * F.col("n_files")
    return both.select("tag", "n_chunks", "n_files", near.alias("within_bound"))


@register("tag_search")
def q_tag_search(spark, sf_dir):
    """Every distinct word of up to six characters in the benchmark texts, with and
    without '#', as a filter of the chunks' joined tags, and the tags themselves."""
    c = stored_chunks(spark, sf_dir)
    return ingest.tag_search(c, D.tag_filters(spark, sf_dir, c), summary=True)


# ---------------------------------------------------------------- audit
def audited_claims(spark, sf_dir):
    return audit.audit_claims(D.claims(spark, sf_dir))


@register("audit_claims")
def q_audit_claims(spark, sf_dir):
    return audited_claims(spark, sf_dir).select(
        "claim_id", "source", *[c for c in audit.AUDIT_COLUMNS])


@register("compliance_report")
def q_compliance_report(spark, sf_dir):
    return audit.compliance_report(audited_claims(spark, sf_dir), "source")


@register("annotate_noncompliant")
def q_annotate(spark, sf_dir):
    a = audit.annotate_noncompliant(audited_claims(spark, sf_dir))
    return a.select("claim_id", F.length("annotated").cast("long").alias("n_chars"),
                    F.sha2("annotated", 256).alias("sha256"))


# ---------------------------------------------------------------- routing
def decided(spark, sf_dir):
    return route.with_decisions(D.requests(spark, sf_dir))


@register("product_class")
def q_product_class(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", F.col("decided_class").alias("product_class"))


@register("size_bucket")
def q_size_bucket(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", "n_atoms", "size_bucket")


@register("select_track")
def q_select_track(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", "vdw", F.col("decided_track").alias("track"))


@register("recommend_tier")
def q_recommend_tier(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", F.col("decided_tier").alias("recommended_tier"))


@register("provenance")
def q_provenance(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", F.col("decided_provenance").alias("provenance_tag"))


def routed(spark, sf_dir):
    return route.route_requests(D.requests(spark, sf_dir))


def flat_route(df):
    return df.select(
        "request_id", "query", "recommended_tier", "product_class", "track", "provenance_tag",
        "section_12_5_compliant", "answer",
        F.col("conformal_interval.lower_bound").alias("lower_bound"),
        F.col("conformal_interval.upper_bound").alias("upper_bound"),
        F.col("conformal_interval.confidence_level").alias("confidence_level"),
        F.col("conformal_interval.point_estimate").alias("point_estimate"),
        F.size("spend_priority_sequence").alias("n_priorities"),
        F.element_at("spend_priority_sequence", 1).alias("first_priority"),
    )


@register("route_requests")
def q_route_requests(spark, sf_dir):
    return flat_route(routed(spark, sf_dir))


@register("route_summary")
def q_route_summary(spark, sf_dir):
    return route.route_summary(routed(spark, sf_dir))


@register("enrich_class")
def q_enrich_class(spark, sf_dir):
    return route.enrich_class(routed(spark, sf_dir)).select(
        "request_id", "product_class", "description", "window_low_pct", "window_high_pct",
        "floppy_low_pct", "floppy_high_pct")


def faulted_responses(spark, sf_dir):
    """Routed responses with seeded contract faults (bad enum, missing field)."""
    r = routed(spark, sf_dir)
    rid = F.col("request_id")
    return (
        r.withColumn("recommended_tier", F.when(rid % 53 == 0, F.lit("T9-bad")).otherwise(F.col("recommended_tier")))
        .withColumn("track", F.when(rid % 59 == 0, F.lit(None).cast("string")).otherwise(F.col("track")))
        .withColumn("provenance_tag", F.when(rid % 61 == 0, F.lit("[X]")).otherwise(F.col("provenance_tag")))
        .withColumn("product_class", F.when(rid % 71 == 0, F.lit("PRODUCT_Z")).otherwise(F.col("product_class")))
        .withColumn("answer", F.when(rid % 73 == 0, F.lit(None).cast("string")).otherwise(F.col("answer")))
        .withColumn("conformal_interval", F.when(
            rid % 67 == 0, F.col("conformal_interval").withField("upper_bound", F.lit(None).cast("double")))
            .otherwise(F.col("conformal_interval")))
    )


@register("contract_check")
def q_contract_check(spark, sf_dir):
    return audit.contract_check(faulted_responses(spark, sf_dir))


# ---------------------------------------------------------------- capacity
@register("estimate_memory")
def q_estimate_memory(spark, sf_dir):
    return capacity.estimate_memory(D.requests(spark, sf_dir))


@register("route_hardware")
def q_route_hardware(spark, sf_dir):
    return capacity.route_hardware(D.jobs(spark, sf_dir), D.requests(spark, sf_dir),
                                   D.hosts(spark, sf_dir))


@register("route_all_hosts")
def q_route_all_hosts(spark, sf_dir):
    return capacity.route_all_hosts(D.jobs(spark, sf_dir), D.requests(spark, sf_dir), D.hosts(spark, sf_dir))


# ---------------------------------------------------------------- retrieval
def centroid_queries(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return retrieve.label_centroids(emb).withColumnRenamed("label", "query_id") \
        .withColumn("label", F.col("query_id"))


def out_hits(df, id_col):
    return df.select("query_id", "rank", id_col, retrieve.rounded("distance"))


@register("dense_topk")
def q_dense_topk(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return out_hits(retrieve.dense_topk(centroid_queries(spark, sf_dir), emb, k=5), "vec_id")


@register("dense_topk_cosine")
def q_dense_topk_cosine(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return out_hits(retrieve.dense_topk(centroid_queries(spark, sf_dir), emb, k=5,
                                        metric="cosine"), "vec_id")


@register("filtered_topk")
def q_filtered_topk(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return out_hits(retrieve.filtered_topk(centroid_queries(spark, sf_dir), emb, k=5), "vec_id")


@register("topk_with_fallback")
def q_topk_with_fallback(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    q = centroid_queries(spark, sf_dir).withColumn("label", F.col("query_id") * 2)
    hits = retrieve.topk_with_fallback(q, emb, k=3)
    return hits.select("query_id", "rank", "vec_id", retrieve.rounded("distance"), "used_fallback")


def lexical_hits(spark, sf_dir, k=3):
    bench = read_table(spark, sf_dir, "benchmark")
    docs = read_table(spark, sf_dir, "documents")
    return retrieve.lexical_topk(bench, docs, k=k, query_key="item_id")


@register("lexical_topk")
def q_lexical_topk(spark, sf_dir):
    return lexical_hits(spark, sf_dir)


@register("score_intervals")
def q_score_intervals(spark, sf_dir):
    s = retrieve.score_intervals(lexical_hits(spark, sf_dir))
    return s.select("query_id", "rank", "doc_id",
                    F.col("interval.lower_bound").alias("lower_bound"),
                    F.col("interval.upper_bound").alias("upper_bound"),
                    F.col("interval.point_estimate").alias("point_estimate"),
                    "confidence")


def bench_contexts(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark")
    docs = read_table(spark, sf_dir, "documents")
    hits = retrieve.lexical_topk(bench, docs, k=3, query_key="item_id")
    return retrieve.assemble_context(bench, hits, docs, query_key="item_id")


@register("assemble_context")
def q_assemble_context(spark, sf_dir):
    c = bench_contexts(spark, sf_dir)
    return c.select("query_id", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("sha256"))


@register("render_chat")
def q_render_chat(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark")
    r = retrieve.render_chat(bench, bench_contexts(spark, sf_dir), query_key="item_id")
    return r.select("query_id", F.length("response").cast("long").alias("n_chars"), F.sha2("response", 256).alias("sha256"))


@register("chat_prompts")
def q_chat_prompts(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark")
    r = retrieve.short_prompts(bench, bench_contexts(spark, sf_dir), query_key="item_id")
    return r.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("sha256"))


# ---- the chunk collection searched by its own string key
def tagged_queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").withColumn("tag", F.expr(D.QUERY_TAG))


@register("chunk_search")
def q_chunk_search(spark, sf_dir):
    return retrieve.lexical_topk(read_table(spark, sf_dir, "benchmark"), corpus_chunks(spark, sf_dir), 3, "item_id",
                                 id_col="chunk_id", distinct=True)


@register("filtered_search")
def q_filtered_search(spark, sf_dir):
    return retrieve.lexical_topk(tagged_queries(spark, sf_dir), corpus_chunks(spark, sf_dir), 3, "item_id",
                                 id_col="chunk_id", query_tag="tag", distinct=True)


@register("search_with_fallback")
def q_search_with_fallback(spark, sf_dir):
    return retrieve.search_with_fallback(tagged_queries(spark, sf_dir), corpus_chunks(spark, sf_dir), 3, "tag", "item_id",
                                         id_col="chunk_id", distinct=True)


# ---------------------------------------------------------------- triage
def stored_chunks(spark, sf_dir):
    """The chunks as a written collection, which the searches read several times."""
    return cut_lineage(corpus_chunks(spark, sf_dir).select("chunk_id", "text", "tags_joined"))


def logs_with_signatures(spark, sf_dir):
    return triage.error_signatures(D.error_logs(spark, sf_dir))


@register("error_signatures")
def q_error_signatures(spark, sf_dir):
    return logs_with_signatures(spark, sf_dir).select("log_id", "signature")


@register("error_triage")
def q_error_triage(spark, sf_dir):
    return triage.error_triage(logs_with_signatures(spark, sf_dir))


@register("diagnose_errors")
def q_diagnose_errors(spark, sf_dir):
    return triage.diagnose_errors(D.error_logs(spark, sf_dir), stored_chunks(spark, sf_dir))


@register("build_prompts")
def q_build_prompts(spark, sf_dir):
    p = triage.build_prompts(D.error_logs(spark, sf_dir), stored_chunks(spark, sf_dir))
    return p.select("log_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("sha256"))


@register("render_summaries")
def q_render_summaries(spark, sf_dir):
    s = triage.render_summaries(D.error_logs(spark, sf_dir), stored_chunks(spark, sf_dir))
    return s.select("log_id", F.length("summary").cast("long").alias("n_chars"), F.sha2("summary", 256).alias("sha256"))


# ---------------------------------------------------------------- redaction
def _digest(df, key_cols, col):
    return df.select(*key_cols, F.length(col).cast("long").alias("n_chars"), F.sha2(col, 256).alias("sha256"))


def chat_step(spark, sf_dir, fn):
    c = D.chat(spark, sf_dir)
    return _digest(c.withColumn("r", fn("text")), ["conv_id", "turn"], "r")


@register("redact_blocks")
def q_redact_blocks(spark, sf_dir):
    return chat_step(spark, sf_dir, redact.redact_blocks)


@register("redact_coords")
def q_redact_coords(spark, sf_dir):
    return chat_step(spark, sf_dir, redact.redact_coords)


@register("redact_matrices")
def q_redact_matrices(spark, sf_dir):
    return chat_step(spark, sf_dir, redact.redact_matrices)


@register("redact_smiles")
def q_redact_smiles(spark, sf_dir):
    return chat_step(spark, sf_dir, redact.redact_smiles)


@register("redact_text")
def q_redact_text(spark, sf_dir):
    return chat_step(spark, sf_dir, redact.redact_text)


@register("scrub_conversations")
def q_scrub_conversations(spark, sf_dir):
    s = redact.scrub_conversations(D.chat(spark, sf_dir))
    return _digest(s, ["conv_id", "turn", "role"], "content")


@register("redaction_report")
def q_redaction_report(spark, sf_dir):
    return redact.redaction_report(D.chat(spark, sf_dir))


# ---------------------------------------------------------------- streams (batch twins), sources
@register("transcripts")
def q_transcripts(spark, sf_dir):
    return files.transcript_stats(read_table(spark, sf_dir, "conversations"))


@register("transcript_positions")
def q_transcript_positions(spark, sf_dir):
    return files.transcript_positions(read_table(spark, sf_dir, "conversations", balance=False))


@register("pulse_status")
def q_pulse_status(spark, sf_dir):
    p = jobs.pulse_status(D.metrics(spark, sf_dir), window="1 hour")
    return p.withColumn("cpu_pct", retrieve.rounded("cpu_pct"))


@register("pulse_status_silent")
def q_pulse_status_silent(spark, sf_dir):
    p = jobs.pulse_status_silent(D.metrics(spark, sf_dir), window="1 hour", expire=3)
    return p.withColumn("cpu_pct", retrieve.rounded("cpu_pct"))


@register("error_stream_replayed")
def q_error_stream_replayed(spark, sf_dir):
    """A source that delivers every log twice: each counts once."""
    logs = D.error_logs(spark, sf_dir)
    return jobs.error_stream(logs.unionByName(logs), window="1 day", once_by="log_id")


@register("error_stream")
def q_error_stream(spark, sf_dir):
    return jobs.error_stream(D.error_logs(spark, sf_dir), window="1 day")


@register("approx_topk")
def q_approx_topk(spark, sf_dir):
    """Per query the hits and whether 95 % of all exact hits were found."""
    emb = read_table(spark, sf_dir, "embeddings")
    queries = cut_lineage(centroid_queries(spark, sf_dir))
    exact = retrieve.dense_topk(queries, emb, k=5).select("query_id", "vec_id", F.lit(1).alias("hit"))
    found = retrieve.approx_topk(queries, emb, k=5).join(exact, ["query_id", "vec_id"], "left")
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count("hit").alias("n_right"))
    # over all queries; partial sums, one row to the window's task for each query
    share = F.sum("n_right").over(Window.partitionBy()) / F.sum("n_hits").over(Window.partitionBy())
    return per.select("query_id", "n_hits", (share >= 0.95).alias("recall_reached"))
