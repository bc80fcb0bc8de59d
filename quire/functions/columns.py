"""Column-expression helpers.

Each helper returns a ``Column`` built only from built-in Spark functions, so
it stays inside whole-stage code generation and can be used in any
``select``/``withColumn``/``filter``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed



def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: str | Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A one-element ``transform`` binds the value to a lambda variable, so a
    formula that reads it several times does not copy (and re-evaluate) its
    expression tree.
    """
    return F.element_at(F.transform(F.array(col_(value)), body), 1)


def fill(template: str, **values: Column) -> Column:
    """A text template with its ``{names}`` replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x))


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(col_(c), F.lit(fixed.PY_WHITESPACE))


def path_stem(path: str | Column) -> Column:
    """``pathlib.Path(path).stem`` for POSIX paths."""
    name = F.regexp_extract(col_(path), r"([^/]*)/*$", 1)
    with_suffix = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(with_suffix == "", name).otherwise(with_suffix)


def half_up(x: str | Column, digits: int) -> Column:
    """Round half away from zero for non-negative values, in DOUBLE.

    ``floor(x * 10^d + 0.5) / 10^d``. The same expression is used in the
    oracle SQL, so both engines agree bit for bit. Callers clamp ``x`` so
    the BIGINT returned by ``floor`` cannot overflow.
    """
    scale = float(10 ** digits)
    return F.floor(col_(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def py_round(x: str | Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` for finite doubles, exactly.

    Python rounds the exact binary value of ``x`` half-to-even. Here
    ``|x| * 10^d`` is computed exactly as ``p + e`` (Dekker's two-product with
    a Veltkamp split; every step is an exact IEEE operation), the fraction
    of ``p`` and the sign of ``e`` decide the rounding, and exact ties go to
    the even neighbour. The oracle SQL uses the same arithmetic.

    The formula reads its input about thirty times, so the input is bound
    once with ``let``: without it, nesting roundings -- or a filter that the
    optimizer pushes through the projections and inlines -- copies the
    input's expression tree at every level and the plan grows exponentially.
    """
    scale = float(10 ** digits)

    def body(v: Column) -> Column:
        a = F.abs(v)
        p = a * F.lit(scale)
        t = a * F.lit(134217729.0)          # 2^27 + 1
        ah = t - (t - a)
        al = a - ah
        e = (ah * F.lit(scale) - p) + al * F.lit(scale)
        f = F.floor(p).cast("double")
        frac = p - f
        up = ((frac > 0.5)
              | ((frac == 0.5) & (e > 0))
              | ((frac == 0.5) & (e == 0) & (F.pmod(f, F.lit(2.0)) == 1.0)))
        r = F.when(up, f + 1.0).otherwise(f) / F.lit(scale)
        return F.when(v < 0, -r).otherwise(r)

    return let(col_(x).cast("double"), body)


def py_int(raw: str | Column) -> Column:
    """Python ``int(str)``: optional sign and digits, surrounding whitespace allowed.

    Anything else (``"12.5"``, ``"many"``) gives NULL, as the reference's
    ``except ValueError`` branch would.
    """
    s = col_(raw)
    ok = s.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(ok, F.trim(s).try_cast("bigint"))


def clean_distance(d: str | Column) -> Column:
    """Distance cleaned as the interval rule wants: bad, NaN, inf, negative -> 0."""
    x = col_(d).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (x == float("inf")) | (x == float("-inf")) | (x < 0)
    # Clamp so floor() stays inside BIGINT; every d above 1e6 already gives
    # point 0.0 and bounds 0/100, so the clamp does not change results.
    return F.when(bad, F.lit(0.0)).otherwise(F.least(x, F.lit(1.0e6)))


def with_interval(df: DataFrame, distance: str | Column, out: str = "interval",
                  level: float = 0.95) -> DataFrame:
    """Add the score interval of a retrieval distance as STRUCT column ``out``.

    point = r1(100 / (1 + d)); margin = r1(5 (1 + d));
    lower = max(0, r1(point - margin)); upper = min(100, r1(point + margin)),
    with r1 = Python's round(., 1). Each rounding input is staged as a column
    first, so nested roundings never nest their formulas.
    """
    tmp = [f"__iv_{k}" for k in ("d", "pr", "mr", "p", "m", "lr", "hr")]
    d, pr, mr, p, m, lr, hr = tmp
    staged = (
        df.withColumn(d, clean_distance(distance))
        .withColumn(pr, F.lit(100.0) * (F.lit(1.0) / (F.lit(1.0) + F.col(d))))
        .withColumn(mr, F.lit(5.0) * (F.lit(1.0) + F.col(d)))
        .withColumn(p, py_round(pr, 1))
        .withColumn(m, py_round(mr, 1))
        # clamping first equals max(0, round(...)) and never yields -0.0
        .withColumn(lr, F.greatest(F.col(p) - F.col(m), F.lit(0.0)))
        .withColumn(hr, F.col(p) + F.col(m))
    )
    return staged.withColumn(out, F.struct(
        F.greatest(F.lit(0.0), py_round(lr, 1)).alias("lower_bound"),
        F.least(F.lit(100.0), py_round(hr, 1)).alias("upper_bound"),
        F.lit(float(level)).alias("confidence_level"),
        F.col(p).alias("point_estimate"),
    )).drop(*tmp)
