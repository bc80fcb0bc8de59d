"""2. Quality rules as a short-circuit cascade.

Every document gets the base statistics and the base verdict. Documents that
pass it go through further rules, each a condition on the text that rejects.
What a rule costs and what it rejects is measured on a sample; the rules are
then ordered by rejection per cost and put into one conditional expression, so
that a later rule is computed only for rows no earlier one has rejected. The
order changes the time a verdict takes, never the verdict.

All of it is DataFrame functions. The sample is a written table of about
``SAMPLE`` rows; only the rules' measurements come to the driver.

Contract: a NULL or empty text has no words and fails the base rule; texts are
read whole; rows with a NULL or repeated doc_id are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

SAMPLE = 2_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# White space and symbols of the statistics.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects``: a condition on the columns of ``with_statistics``."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    text, n_words, chars = F.col("text"), F.col("n_words"), F.col("word_chars")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n_words * 3),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > F.size(F.split(text, "\n")) * 3),
        Rule("word_length", (chars < n_words * 2) | (chars > n_words * 20)),
        Rule("exclamations", count_chars(text, "!") * 10 > n_words * 3),
        Rule("capitals", count_chars(text, upper) * 2 > chars),
        Rule("no_letters", F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) * 2 < chars),
        Rule("few_words", F.size(F.array_distinct("words")) * 20 < n_words),
    ]


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once. A plain
    column read inside a lambda could be inlined there, once per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words covered by windows that occur twice or more among the words ``ws``.

    Windows are hashed; only where some hash occurs twice are they sorted with
    their positions, so that equal ones are neighbours. The sorted starts of
    repeated windows cover their gaps, of a window's width at most, and one
    width for the first.
    """
    windows = (f"if(size(ws) < {WINDOW}, cast(array() as array<bigint>), "
               f"transform(sequence(1, size(ws) - {WINDOW - 1}), i -> xxhash64(slice(ws, i, {WINDOW}))))")
    covered = f"aggregate(transform(p, (q, k) -> if(k = 0, {WINDOW}, least({WINDOW}, q - p[k - 1]))), 0L, (s, x) -> s + x)"
    twice = "(k > 0 and t[k - 1].h = x.h) or (k < size(t) - 1 and t[k + 1].h = x.h)"
    starts = f"sort_array(transform(filter(t, (x, k) -> {twice}), x -> x.i))"
    pairs = "sort_array(transform(w, (h, i) -> named_struct('h', h, 'i', i)))"
    slow = _bind(pairs, "t", _bind(starts, "p", covered))
    return _bind(windows, "w", f"if(size(array_distinct(w)) = size(w), 0L, {slow})")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, text, words`` and the base statistics."""
    trimmed = F.btrim("text", F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    repeats = "size(ls) - size(array_distinct(ls))"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .select("doc_id", "text", words.alias("split"), lines.alias("lines")) \
        .select("doc_id", "text", F.expr(_bind("lines", "ls", repeats)).cast("long").alias("n_dup_lines"),
                F.expr(_bind("split", "ws", f"named_struct('words', ws, 'repeated', {_repeated_words()})")).alias("s")) \
        .select("doc_id", "text", F.col("s.words").alias("words"), F.size("s.words").cast("long").alias("n_words"),
                F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
                count_chars(F.col("text"), SYMBOLS).alias("n_symbols"), "n_dup_lines",
                F.col("s.repeated").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def measure(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of about ``rows`` rows that
    pass the base verdict. Each rule is timed alone, twice, against an empty
    one; a rule that takes no measurable time costs a millisecond."""
    total = docs.count()
    if not total:
        return [(r, 1e-3, 0.0) for r in rules]
    part = docs if total <= rows else docs.sample(fraction=rows / total, seed=7)
    sample = cut_lineage(with_statistics(part).where(~base_failed()))
    size = max(1, sample.count())

    def timed(condition: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(condition)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, rejected

    idle, _ = timed(F.lit(False) & (F.length("text") < 0))
    out = []
    for rule in rules:
        took, rejected = timed(rule.rejects)
        out.append((rule, max(took - idle, 1e-3), rejected / size))
    return out


def order_rules(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, most first; ties by name."""
    return [r for r, cost, share in sorted(measured, key=lambda m: (-m[2] / m[1], m[1], m[0].name))]


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; stops at the first one that does."""
    verdict = F.when(base_failed(), False)
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed`` and ``kept`` of every row."""
    ordered = order_rules(measure(docs, default_rules() if rules is None else rules))
    return with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), cascade(ordered).alias("kept"))
