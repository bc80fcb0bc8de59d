"""Claim audit: a provenance rule over text, its report and annotation.

A text violates the rule when it states a hardware exclusion or an accuracy
claim, carries a derived ``[D]`` or estimated ``[E]`` tag, and no measured
``[M]`` tag. Everything is a column expression; the report is one grouped
aggregate (partial aggregation before the shuffle, so a hot source is fine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.columns import let

AUDIT_COLUMNS = ["has_hw_exclusion", "has_accuracy_claim", "compliant",
                 "claim_type", "violation", "warning"]


def audit_struct(text: str | Column) -> Column:
    """STRUCT of the audit verdict for one text column (NULL/empty text is compliant).

    The text and its five flags are each computed once (``let``); every
    field of the verdict is derived from the bound flags.
    """
    head, tail = fixed.VIOLATION_TEMPLATE.split("{claim}")
    mid, end = tail.split("{tags}")

    def verdict(f: Column) -> Column:
        hw, acc, d, e, m = f["hw"], f["acc"], f["d"], f["e"], f["m"]
        violated = (hw | acc) & (d | e) & ~m
        claim = F.when(violated, F.when(hw, F.lit(fixed.CLAIM_HARDWARE))
                       .otherwise(F.lit(fixed.CLAIM_ACCURACY)))
        used = F.concat(F.when(d, F.lit(fixed.TAG_DERIVED)).otherwise(F.lit("")),
                        F.when(e, F.lit(fixed.TAG_ESTIMATED)).otherwise(F.lit("")))
        violation = F.when(violated, F.concat(F.lit(head), claim, F.lit(mid), used, F.lit(end)))
        warning = F.when(violated, F.concat(F.lit(fixed.WARNING_PREFIX), violation)).otherwise(F.lit(""))
        return F.struct(hw.alias("has_hw_exclusion"), acc.alias("has_accuracy_claim"),
                        (~violated).alias("compliant"), claim.alias("claim_type"),
                        violation.alias("violation"), warning.alias("warning"))

    def flags(t: Column) -> Column:
        return F.struct(
            F.coalesce(t.rlike(fixed.HARDWARE_EXCLUSION_JAVA), F.lit(False)).alias("hw"),
            F.coalesce(t.rlike(fixed.ACCURACY_CLAIM_JAVA), F.lit(False)).alias("acc"),
            F.coalesce(t.contains(fixed.TAG_DERIVED), F.lit(False)).alias("d"),
            F.coalesce(t.contains(fixed.TAG_ESTIMATED), F.lit(False)).alias("e"),
            F.coalesce(t.contains(fixed.TAG_MEASURED), F.lit(False)).alias("m"),
        )

    return let(let(text, flags), verdict)


def audit_claims(df: DataFrame, text: str = "text") -> DataFrame:
    """Audit columns appended to every row."""
    return df.withColumn("_audit", audit_struct(text)).select(
        *df.columns, *[F.col(f"_audit.{c}").alias(c) for c in AUDIT_COLUMNS])


def compliance_report(audited: DataFrame, by: str = "source") -> DataFrame:
    """Rows, violations by claim type and violation rate per ``by``, plus a total row."""
    return (
        audited.rollup(by)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(~F.col("compliant"), 1).otherwise(0)).alias("n_violations"),
            F.sum(F.when(F.col("claim_type") == fixed.CLAIM_HARDWARE, 1).otherwise(0)).alias("n_hw_exclusion"),
            F.sum(F.when(F.col("claim_type") == fixed.CLAIM_ACCURACY, 1).otherwise(0)).alias("n_accuracy"),
            F.sum(F.when(F.col("has_hw_exclusion") | F.col("has_accuracy_claim"), 1).otherwise(0)).alias("n_claims"),
        )
        .withColumn("violation_rate", F.col("n_violations").cast("double") / F.col("n_rows").cast("double"))
    )


def annotate_noncompliant(audited: DataFrame, text: str = "text") -> DataFrame:
    """D3: a non-compliant text gets a blank line and the warning appended."""
    return audited.withColumn(
        "annotated",
        F.when(~F.col("compliant"), F.concat(F.col(text), F.lit("\n\n"), F.col("warning")))
        .otherwise(F.col(text)),
    )


def contract_rules() -> list[tuple[str, Column]]:
    """(rule name, failure condition) for every rule of the response contract."""
    checks = []
    for f in fixed.RESPONSE_REQUIRED:
        checks.append((f"required:{f}", F.col(f).isNull()))
    enums = {
        "recommended_tier": fixed.VALID_TIERS,
        "product_class": fixed.PRODUCT_CLASSES,
        "track": fixed.TRACKS,
        "provenance_tag": fixed.PROVENANCE_TAGS,
    }
    for f, values in enums.items():
        checks.append((f"enum:{f}", F.col(f).isNotNull() & ~F.col(f).isin(values)))
    for f in fixed.INTERVAL_REQUIRED:
        checks.append((f"interval:{f}", F.col("conformal_interval").isNotNull()
                       & F.col(f"conformal_interval.{f}").isNull()))
    return checks


def contract_check(responses: DataFrame) -> DataFrame:
    """Rows failing each contract rule (every rule listed, zero included).
    One aggregate over all rules (combined before the shuffle), then
    unpivoted to one row per rule."""
    rules = contract_rules()
    counts = responses.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"r{i}")
                             for i, (_, c) in enumerate(rules)])
    pairs = ", ".join(f"'{n}', r{i}" for i, (n, _) in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, n_failed)")
