"""Deterministic inputs derived from the driver tables.

The driver's text tables hold no headings, code fences, tags, tracebacks,
claims, coordinates or matrices, so the corpus, triage, audit, routing and
redaction jobs read inputs derived from them. Each input is a projection of
one table written as plain SQL expressions that mean the same in Spark SQL
and in DuckDB (``||``, ``chr(10)``, ``CAST(... AS STRING)``, ``%``, ``CASE``),
so the oracle SQL uses literally the same text (see ``derived_sql``).

Every derived input reads its whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import read_table, spread

NL = "chr(10)"

# The tag under which a benchmark text is searched in the chunk collection: one
# of a leading '#', one that some chunks have, one that none has, and none.
QUERY_TAG = "CASE item_id % 4 WHEN 0 THEN '#incode' WHEN 1 THEN 'troubleshooting' WHEN 2 THEN 'absent' END"

# name -> (table, filter or None, [select expressions])
DERIVED: dict[str, tuple[str, str | None, list[str]]] = {
    # Markdown files: a title header with the language tag, a header with a
    # tag before every original line, and by doc_id % 3 a closed code fence
    # holding a '#' comment plus a troubleshooting section, or an unclosed
    # fence holding a header.
    "md_docs": (
        "documents",
        None,
        [
            "'doc_' || CAST(doc_id AS STRING) || '.md' AS file",
            "lang",
            "'# Doc ' || CAST(doc_id AS STRING) || ' #' || lang || " + NL + " || "
            "replace(text, " + NL + ", " + NL + " || '## Part #part' || " + NL + ") || "
            "CASE doc_id % 3 "
            "WHEN 0 THEN " + NL + " || '```python' || " + NL + " || '# comment #incode' || "
            + NL + " || 'x = 1  # keep #setup' || " + NL + " || '```' || " + NL + " || "
            "'## Notes #troubleshooting' || " + NL + " || "
            "'If the step fails with ValueError: bad value ' || CAST(doc_id % 11 AS STRING) || "
            "', check the input of app_mod_' || CAST(doc_id % 7 AS STRING) || ' and run it again.' "
            "WHEN 1 THEN " + NL + " || '```' || " + NL + " || '## Unclosed #open' || " + NL + " || "
            "'text inside a fence that is never closed, so the header above still splits' "
            "ELSE '' END AS text",
        ],
    ),
    # Python tracebacks from error events: one to three File lines, some
    # blank or empty logs, some without a final exception line.
    "error_logs": (
        "events",
        "event_type = 'error'",
        [
            "event_id AS log_id",
            "ts",
            "user_id",
            "CASE WHEN event_id % 50 = 0 THEN '' "
            "WHEN event_id % 50 = 1 THEN '   ' || " + NL + " || '  ' "
            "ELSE 'Traceback (most recent call last):' || " + NL + " || "
            "'  File \"/srv/app/app_mod_' || CAST(user_id % 7 AS STRING) || '.py\", line ' || "
            "CAST(event_id % 97 AS STRING) || ', in run' || " + NL + " || "
            "CASE WHEN event_id % 3 >= 1 THEN '  File \"/usr/lib/helper_' || "
            "CAST(event_id % 5 AS STRING) || '.py\", line 12, in call' || " + NL + " ELSE '' END || "
            "CASE WHEN event_id % 3 = 2 THEN '  File \"/srv/app/app_mod_' || "
            "CAST((user_id + 1) % 7 AS STRING) || '.py\", line 7, in inner' || " + NL + " ELSE '' END || "
            "'    raise ValueError(x)' || " + NL + " || "
            "CASE WHEN event_id % 13 = 0 THEN '' "
            "ELSE 'ValueError: bad value ' || CAST(event_id % 11 AS STRING) END "
            "END AS traceback",
            "CASE WHEN event_id % 4 = 0 THEN 'How do I fix this?' END AS question",
        ],
    ),
    # Claims with provenance tags: sentence by event_id % 6, tags by % 5.
    "claims": (
        "events",
        None,
        [
            "event_id AS claim_id",
            "event_type AS source",
            "CASE WHEN event_id % 97 = 0 THEN NULL ELSE "
            "CASE event_id % 6 "
            "WHEN 0 THEN 'The accuracy of method M' || CAST(event_id % 9 AS STRING) || "
            "' is within 0.' || CAST(event_id % 5 AS STRING) || ' kcal/mol' "
            "WHEN 1 THEN 'GPU path excluded for system S' || CAST(event_id % 13 AS STRING) "
            "WHEN 2 THEN 'This engine is unsupported on CPU-only nodes' "
            "WHEN 3 THEN 'Calculation completed at tier T2-3h' "
            "WHEN 4 THEN 'Estimated error bound of ' || CAST(event_id % 7 AS STRING) || ' cm^-1 per mode' "
            "ELSE 'We exclude the no GPU path option' END || "
            "CASE event_id % 5 WHEN 0 THEN ' [D]' WHEN 1 THEN ' [E]' WHEN 2 THEN ' [D] [E]' "
            "WHEN 3 THEN ' [D] [M]' ELSE '' END "
            "END AS text",
        ],
    ),
    # Compute requests: raw fields kept as the loosely typed values a request
    # carries (strings for numbers, some NULL or unparsable).
    "requests": (
        "part",
        None,
        [
            "p_partkey AS request_id",
            "p_name || CASE WHEN p_partkey % 17 = 0 THEN ' van der Waals complex' "
            "WHEN p_partkey % 19 = 0 THEN ' vdW dimer' ELSE ' conformer study' END AS query",
            "CASE p_partkey % 7 WHEN 0 THEN 'PRODUCT_A' WHEN 1 THEN 'PRODUCT_B' "
            "WHEN 2 THEN 'PRODUCT_C' WHEN 3 THEN 'INVALID_CLASS' WHEN 4 THEN '' END AS product_class",
            "p_partkey % 5 = 0 AS has_experimental_reference",
            "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 3 = 0 END AS has_template",
            "p_partkey % 4 = 1 AS is_difference_calc",
            "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'many' "
            "WHEN p_partkey % 31 = 0 THEN '12.5' "
            "ELSE CAST(p_size * (1 + p_partkey % 4) AS STRING) END AS num_atoms",
            "p_partkey % 2 = 0 AS gpu_available",
            "p_partkey % 3 = 1 AS require_anharmonic_vpt2",
            "CASE p_partkey % 6 WHEN 0 THEN 'dft' WHEN 1 THEN 'coupled_cluster' "
            "WHEN 2 THEN 'CCSD(T)' WHEN 3 THEN 'mp2' WHEN 4 THEN 'MACE' END AS method_type",
            "CASE p_partkey % 5 WHEN 0 THEN 'orca' WHEN 1 THEN 'CFOUR' WHEN 2 THEN 'pyscf' "
            "WHEN 3 THEN 'mace' END AS engine",
            "p_partkey % 37 = 0 AS is_vdw_complex",
            "CASE p_partkey % 13 WHEN 0 THEN 'T4-1w' WHEN 1 THEN 'BAD_TIER' END AS recommended_tier",
            "CASE WHEN p_partkey % 41 = 0 THEN 'NOT_A_FLOAT' WHEN p_partkey % 43 = 0 THEN NULL "
            "WHEN p_partkey % 47 = 0 THEN 'inf' "
            "ELSE CAST(p_partkey % 40 - 5 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) END "
            "AS chroma_distance",
        ],
    ),
    # Chat messages with, by conv_id % 5, a geometry block, a coordinate
    # line, a float matrix, SMILES strings or nothing appended.
    "chat": (
        "conversations",
        None,
        [
            "conv_id",
            "turn",
            "role",
            "text || CASE conv_id % 5 "
            "WHEN 0 THEN " + NL + " || '* xyz 0 1' || " + NL + " || 'C 0.0000 0.0000 0.0000' || "
            + NL + " || 'O 0.0000 0.0000 1.' || CAST(1000 + turn % 9000 AS STRING) || " + NL + " || '*' "
            "WHEN 1 THEN " + NL + " || 'Atom C  -1.' || CAST(100000 + conv_id % 900000 AS STRING) || "
            "'  0.123456  2.' || CAST(200 + turn % 700 AS STRING) || ' done' "
            "WHEN 2 THEN " + NL + " || '   0.1234 -1.2345 2.3456 3.4567' || " + NL + " || "
            "'   4.5678 -5.6789 6.7891 7.' || CAST(8000 + turn % 1000 AS STRING) || " + NL + " "
            "WHEN 3 THEN ' with SMILES C1=CC=C(C=C1)O and CC(=O)O, charged [NH4+].[Cl-]' "
            "ELSE '' END AS text",
        ],
    ),
    # Host metrics from events, for the status-colour job.
    "metrics": (
        "events",
        None,
        [
            "ts",
            "CAST(user_id % 8 AS STRING) AS host",
            "value / 5.0 AS cpu_pct",
            "event_type <> 'view' AS is_active",
        ],
    ),
    # Compute hosts from suppliers: VRAM from the account balance and a
    # MACE registration flag.
    "hosts": (
        "supplier",
        None,
        [
            "s_suppkey AS host_id",
            "greatest(s_acctbal, 0.0) / 250.0 AS vram_gb",
            "s_nationkey % 3 = 0 AS mace_registered",
        ],
    ),
    # Job submissions: one per line item, a part (the request) run on a
    # supplier (the host).
    "jobs": (
        "lineitem",
        None,
        [
            "l_orderkey * 8 + l_linenumber AS job_id",
            "l_partkey AS request_id",
            "l_suppkey AS host_id",
        ],
    ),
}


# Derived inputs that carry whole texts, so per-row work dominates and a
# single-split scan is worth spreading over the task slots.
TEXT_INPUTS = {"md_docs", "error_logs", "claims", "chat"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, where, exprs = DERIVED[name]
    df = read_table(spark, sf_dir, table, balance=False)
    if where:
        df = df.where(where)
    if name in TEXT_INPUTS:
        # spread the (pruned, filtered) scan before building the texts, so the
        # text expressions run on every slot
        df = spread(df)
    return df.selectExpr(*exprs)


def derived_sql(name: str) -> str:
    """The same derived input as a DuckDB SELECT over the registered views."""
    table, where, exprs = DERIVED[name]
    sql = "SELECT " + ", ".join(exprs) + f" FROM {table}"
    if where:
        sql += f" WHERE {where}"
    return sql


def tag_filters(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Filters for the tag search: the distinct words of up to six letters of the
    benchmark texts, these with a leading '#', and the distinct joined tags."""
    from pyspark.sql import functions as F

    words = read_table(spark, sf_dir, "benchmark", balance=False) \
        .select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("tag")).where("length(tag) BETWEEN 1 AND 6")
    return words.union(words.select(F.concat(F.lit("#"), "tag"))).union(chunks.select("tags_joined")).distinct()


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "md_docs")


def error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "error_logs")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "claims")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "requests")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "chat")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "metrics")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "hosts")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "jobs")
