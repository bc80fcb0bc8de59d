"""Request routing: a decision table evaluated per row, and its summaries.

A request table (one row per request, loosely typed fields) goes through
product class, size bucket, track, tier and provenance, then a score interval,
an answer sentence and the audit flag. It is one narrow stage: no shuffle.
Missing fields are NULL and take the same defaults as absent keys.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.columns import py_int, with_interval
from quire.operators.audit import audit_struct

ROUTE_COLUMNS = [
    "request_id", "query", "recommended_tier", "product_class", "track",
    "provenance_tag", "section_12_5_compliant", "conformal_interval",
    "spend_priority_sequence", "answer",
]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def product_class() -> Column:
    """Explicit valid class, else difference -> C, else reference/template -> B, else A."""
    explicit = F.col("product_class")
    return (
        F.when(explicit.isin(fixed.PRODUCT_CLASSES), explicit)
        .when(_flag("is_difference_calc"), F.lit("PRODUCT_C"))
        .when(_flag("has_experimental_reference") | _flag("has_template"), F.lit("PRODUCT_B"))
        .otherwise(F.lit("PRODUCT_A"))
    )


def atoms() -> Column:
    """Atom count: NULL or unparsable gives the default of 10."""
    return F.coalesce(py_int(F.col("num_atoms")), F.lit(fixed.DEFAULT_NUM_ATOMS))


def size_bucket(n: Column) -> Column:
    """Small (<= 10), medium (<= 50), large."""
    return (F.when(n <= fixed.SMALL_MAX_ATOMS, F.lit("small"))
            .when(n <= fixed.MEDIUM_MAX_ATOMS, F.lit("medium"))
            .otherwise(F.lit("large")))


def is_vdw() -> Column:
    q = F.lower(F.coalesce(F.col("query"), F.lit(fixed.DEFAULT_QUERY)))
    return _flag("is_vdw_complex") | q.contains("van der waals") | q.contains("vdw")


def select_track(vdw: Column) -> Column:
    """MPQC for vdW, CFOUR for VPT2 coupled-cluster, PYSCF on GPU, else ORCA."""
    engine = F.lower(F.coalesce(F.col("engine"), F.lit(fixed.DEFAULT_ENGINE)))
    method = F.lower(F.coalesce(F.col("method_type"), F.lit(fixed.DEFAULT_METHOD)))
    cc = method.contains("coupled_cluster") | method.contains("cc") | engine.contains("cfour")
    return (
        F.when(vdw, F.lit("MPQC"))
        .when(_flag("require_anharmonic_vpt2") & cc, F.lit("CFOUR"))
        .when(_flag("gpu_available") & engine.contains("pyscf"), F.lit("PYSCF"))
        .otherwise(F.lit("ORCA"))
    )


def recommend_tier(cls: Column, size: Column, vdw: Column) -> Column:
    """Explicit valid tier, else vdW tier, else the (class, size) table."""
    table = F.create_map(*chain.from_iterable(
        (F.lit(f"{c}/{s}"), F.lit(t)) for (c, s), t in fixed.TIER_TABLE.items()))
    explicit = F.col("recommended_tier")
    return (
        F.when(explicit.isin(fixed.VALID_TIERS), explicit)
        .when(vdw, F.lit(fixed.VDW_TIER))
        .otherwise(F.element_at(table, F.concat(cls, F.lit("/"), size)))
    )


def provenance(cls: Column) -> Column:
    """E5: measured with an experimental reference, derived for B/C, else estimated."""
    return (F.when(_flag("has_experimental_reference"), F.lit(fixed.TAG_MEASURED))
            .when(cls.isin("PRODUCT_B", "PRODUCT_C"), F.lit(fixed.TAG_DERIVED))
            .otherwise(F.lit(fixed.TAG_ESTIMATED)))


def request_distance() -> Column:
    raw = F.col("chroma_distance")
    return F.when(raw.isNull(), F.lit(fixed.DEFAULT_DISTANCE)).otherwise(
        F.coalesce(F.when(~raw.rlike(r"[0-9.][dDfF]\s*$"), F.trim(raw)).try_cast("double"),
                   F.lit(fixed.DEFAULT_DISTANCE)))  # a type suffix is no Python number


def answer_text(tier: Column, cls: Column, track: Column, tag: Column, vdw: Column) -> Column:
    head = F.format_string(fixed.ANSWER_HEAD.replace("{tier}", "%s").replace("{cls}", "%s")
                           .replace("{track}", "%s").replace("{tag}", "%s"), tier, cls, track, tag)
    tail = F.when(vdw & (track == "MPQC"), F.lit(fixed.ANSWER_VDW)).otherwise(
        F.format_string(fixed.ANSWER_TRACK.replace("{track}", "%s"), track))
    return F.concat(head, tail)


def with_decisions(requests: DataFrame) -> DataFrame:
    """E1-E5 as columns ``decided_class, size_bucket, vdw, track, tier, provenance``."""
    return (
        requests
        .withColumn("decided_class", product_class())
        .withColumn("n_atoms", atoms())
        .withColumn("size_bucket", size_bucket(F.col("n_atoms")))
        .withColumn("vdw", is_vdw())
        .withColumn("decided_track", select_track(F.col("vdw")))
        .withColumn("decided_tier", recommend_tier(F.col("decided_class"), F.col("size_bucket"), F.col("vdw")))
        .withColumn("decided_provenance", provenance(F.col("decided_class")))
    )


def route_requests(requests: DataFrame, level: float = 0.95) -> DataFrame:
    """The full response per request (the response-contract fields)."""
    d = with_decisions(requests)
    cls, track, tier, tag = (F.col("decided_class"), F.col("decided_track"),
                             F.col("decided_tier"), F.col("decided_provenance"))
    answer = answer_text(tier, cls, track, tag, F.col("vdw"))
    d = with_interval(d.withColumn("_distance", request_distance()), "_distance",
                      "conformal_interval", level)
    return d.select(
        "request_id",
        F.coalesce(F.col("query"), F.lit(fixed.DEFAULT_QUERY)).alias("query"),
        tier.alias("recommended_tier"),
        cls.alias("product_class"),
        track.alias("track"),
        tag.alias("provenance_tag"),
        answer.alias("answer"),
        "conformal_interval",
        F.array(*[F.lit(s) for s in fixed.SPEND_PRIORITY_SEQUENCE]).alias("spend_priority_sequence"),
    ).withColumn("section_12_5_compliant", audit_struct("answer")["compliant"]).select(*ROUTE_COLUMNS)


def route_summary(routed: DataFrame) -> DataFrame:
    """Request counts over every combination of class, track and tier (CUBE)."""
    return (
        routed.cube("product_class", "track", "recommended_tier")
        .agg(F.count(F.lit(1)).alias("n_requests"),
             (F.grouping("product_class") * 4 + F.grouping("track") * 2
              + F.grouping("recommended_tier")).cast("long").alias("grouping_level"))
    )


def class_config(spark) -> DataFrame:
    """Product-class dimension (3 rows) with accuracy windows parsed to percent."""
    rows = [(c, d, w, f) for c, d, w, f in fixed.CLASS_CONFIG]
    df = spark.createDataFrame(rows, "product_class string, description string, window string, window_floppy string")
    pat = r"^([0-9.]+)-([0-9.]+)%$"
    return df.select(
        "product_class", "description",
        F.regexp_extract("window", pat, 1).cast("double").alias("window_low_pct"),
        F.regexp_extract("window", pat, 2).cast("double").alias("window_high_pct"),
        F.regexp_extract("window_floppy", pat, 1).try_cast("double").alias("floppy_low_pct"),
        F.regexp_extract("window_floppy", pat, 2).try_cast("double").alias("floppy_high_pct"),
    )


def enrich_class(routed: DataFrame) -> DataFrame:
    """Class description and accuracy windows joined on (3-row broadcast dimension)."""
    dim = class_config(routed.sparkSession)
    return routed.join(F.broadcast(dim), "product_class", "left")
