"""Redaction of sensitive structures in text: geometry blocks, coordinate
lines, float matrices and SMILES strings, applied in that order.

All steps are ``regexp_replace`` / ``split`` / ``regexp_extract_all`` column
expressions. The patterns (``quire.functions.fixed``) are written so the JVM
regex engine iterates rather than recursing per repetition: a plain
repeated group overflows the thread stack on long inputs and takes the
executor down, which no task retry can fix.

The SMILES step replaces a candidate only when it holds a structural
character or digit *and* an organic element, so it is a conditional replace:
the text is split at the candidates, each candidate is mapped, and the two
arrays are zipped back together — no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.columns import col_

def _smiles_pattern() -> str:
    a, p, w = fixed.SMILES_ATOM, fixed.SMILES_PUNCT, fixed.WORD_CHAR
    run = f"{a}++(?!{w})"                     # maximal atom run ending at a non-word char
    block = f"(?:{run}|{p}(?!{w})|{p}(?={run}))"  # a block after which the match may end
    return f"(?<!{w})(?:{a}{{2,}}+(?!{w}){block}*+|{block}{block}++)"


SMILES_JAVA = _smiles_pattern()


def redact_blocks(text: str | Column) -> Column:
    """G1: body of a ``* xyz`` block replaced; header line and closing ``*`` kept."""
    return F.regexp_replace(col_(text), F.lit(fixed.GEOMETRY_BLOCK_JAVA), F.lit(fixed.GEOMETRY_BLOCK_REPL))


def redact_coords(text: str | Column) -> Column:
    """Element symbol kept, its three coordinates replaced."""
    return F.regexp_replace(col_(text), F.lit(fixed.COORD_LINE_JAVA), F.lit(fixed.COORD_LINE_REPL))


def redact_matrices(text: str | Column) -> Column:
    """Runs of four or more long floats replaced by one label line."""
    return F.regexp_replace(col_(text), F.lit(fixed.FLOAT_MATRIX_JAVA), F.lit(fixed.FLOAT_MATRIX_REPL))


def smiles_valid(candidate: Column) -> Column:
    return candidate.rlike(fixed.SMILES_STRUCTURAL_JAVA) & candidate.rlike(fixed.SMILES_ORGANIC_JAVA)


def redact_smiles(text: str | Column) -> Column:
    """SMILES-like candidates that pass the structural + organic test are
    replaced by the label; other candidates stay as they are.

    The text and its candidate list are each bound once through one-element
    ``transform`` calls, so an input that is itself an expression (the
    earlier redaction steps) is evaluated once per row.
    """
    pat = F.lit(SMILES_JAVA)

    def with_text(v: Column) -> Column:
        def with_cands(cands: Column) -> Column:
            pieces = F.split(v, SMILES_JAVA, -1)
            mapped = F.transform(cands, lambda c: F.when(smiles_valid(c), F.lit(fixed.SMILES_LABEL))
                                 .otherwise(c))
            joined = F.array_join(
                F.zip_with(pieces, F.concat(mapped, F.array(F.lit(""))),
                           lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit("")))), "")
            return F.when(F.size(cands) == 0, v).otherwise(joined)

        found = F.element_at(F.transform(F.array(F.regexp_extract_all(v, pat, 0)), with_cands), 1)
        return F.when(v.isNull(), v).otherwise(found)

    return F.element_at(F.transform(F.array(col_(text)), with_text), 1)


def redact_text(text: str | Column) -> Column:
    """All four steps in order on any text column (NULL stays NULL)."""
    return redact_smiles(redact_matrices(redact_coords(redact_blocks(text))))


def scrub_conversations(messages: DataFrame, text: str = "text") -> DataFrame:
    """NULL role -> ``unknown``, NULL content -> ``""``, rows without a
    conversation or position dropped, content redacted."""
    return (
        messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn",
                F.coalesce(F.col("role"), F.lit(fixed.UNKNOWN_ROLE)).alias("role"),
                redact_text(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    )


def smiles_count(text: str | Column) -> Column:
    """How many candidates of a text ``redact_smiles`` would replace."""
    return F.size(F.filter(F.regexp_extract_all(col_(text), F.lit(SMILES_JAVA), 0), smiles_valid))


PATTERNS = ("geometry", "coords", "matrix", "smiles")


def redaction_report(messages: DataFrame, text: str = "text", by: str = "role") -> DataFrame:
    """Per ``by`` value and pattern (geometry, coords, matrix, smiles): rows
    hit, matches and the net change in characters, plus the rows whose final text
    leaks: a block with another body than its label, or, the labels aside, a
    coordinate line, a float matrix or a SMILES string."""
    # One projection per stage: each stage's text is computed once and read
    # by the next stage and the counts (no nested re-evaluation). The counts
    # are aggregated per group first (combined before the shuffle) and the
    # small result is unpivoted to one row per pattern.
    counted = (
        messages.select(F.coalesce(F.col(by), F.lit(fixed.UNKNOWN_ROLE)).alias(by),
                        F.coalesce(F.col(text), F.lit("")).alias("s0"))
        .withColumn("s1", redact_blocks("s0"))
        .withColumn("s2", redact_coords("s1"))
        .withColumn("s3", redact_matrices("s2"))
        .withColumn("s4", redact_smiles("s3"))
        .withColumn("rest", F.regexp_replace("s4", F.lit(fixed.ANY_LABEL), F.lit(" ")))
        .select(
            by,
            F.regexp_count("s0", F.lit(fixed.GEOMETRY_BLOCK_JAVA)).alias("n_geometry"),
            (F.length("s1") - F.length("s0")).alias("d_geometry"),
            F.regexp_count("s1", F.lit(fixed.COORD_LINE_JAVA)).alias("n_coords"),
            (F.length("s2") - F.length("s1")).alias("d_coords"),
            F.regexp_count("s2", F.lit(fixed.FLOAT_MATRIX_JAVA)).alias("n_matrix"),
            (F.length("s3") - F.length("s2")).alias("d_matrix"),
            smiles_count("s3").alias("n_smiles"),
            (F.length("s4") - F.length("s3")).alias("d_smiles"),
            (F.col("rest").rlike(fixed.COORD_LINE_JAVA) | F.col("rest").rlike(fixed.FLOAT_MATRIX_JAVA) | (smiles_count("rest") > 0)
             | (F.regexp_count("s4", F.lit(fixed.GEOMETRY_BLOCK_JAVA)) != F.regexp_count("s4", F.lit(fixed.REDACTED_BLOCK)))).alias("leak"),
        )
    )
    aggs = [F.sum(F.when(F.col("leak"), 1).otherwise(0)).alias("n_leaks")]
    for p in PATTERNS:
        aggs += [F.sum(F.when(F.col(f"n_{p}") > 0, 1).otherwise(0)).alias(f"hit_{p}"),
                 F.sum(f"n_{p}").cast("long").alias(f"cnt_{p}"),
                 F.sum(f"d_{p}").cast("long").alias(f"del_{p}")]
    per_group = counted.groupBy(by).agg(*aggs)
    rows = ", ".join(f"'{p}', hit_{p}, cnt_{p}, del_{p}, n_leaks" for p in PATTERNS)
    return per_group.selectExpr(
        by, f"stack({len(PATTERNS)}, {rows}) AS (pattern, n_rows_hit, n_matches, chars_delta, n_leaks)")
