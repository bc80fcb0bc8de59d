"""Positions and running sums over a total order, without one task that sees it all.

Rows are range partitioned and sorted inside the partitions, so a group with a
third of all rows spans several. What a partition adds to the ones after it is
one row per (partition, group open at its end); only these few rows are summed
in one place, and every row adds its partition's offset to its own running sum.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

_LOW_BITS = 33      # monotonically_increasing_id: partition above, position in it below


def _ordered(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    """``df`` written once in order, with each row's partition ``__p`` and its
    position ``__i`` in it. Written, so that all readers see the same places."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    return placed.withColumn("__p", F.shiftright("__at", _LOW_BITS)) \
        .withColumn("__i", F.col("__at").bitwiseAND((1 << _LOW_BITS) - 1)).drop("__at")


def numbered(df: DataFrame, *order: str | Column, name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's position from 0 in the order; equal rows are put
    in some order, once."""
    rows = _ordered(df, list(order), partitions)
    # one row per partition
    per = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = per.select("__p", F.coalesce(F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i")) \
        .drop("__p", "__i", "__before")


def stored_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """``df``, a table as it was read, with each row's position from 0 in the
    order it was written in, file after file; rows of no file are written first. A scan hands
    out files by size, so the order of its rows says nothing. One row per file
    is summed in one place."""
    try:
        at = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__i"))
    except AnalysisException:
        return stored_positions(cut_lineage(df), name)
    per = at.groupBy("__file").agg((F.max("__i") + 1).alias("__n"))
    # part numbers have five digits or more
    earlier = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return at.join(F.broadcast(before), "__file").withColumn(name, F.col("__before") + F.col("__i")) \
        .select(*df.columns, name)


def running_sums(df: DataFrame, group: str, order: list[str], sums: dict[str, Column],
                 partitions: int | None = None) -> DataFrame:
    """For each new column, the sum of its expression over the rows of the same
    ``group`` that come earlier in ``order`` (ties in some order, once).

    Inside a partition a window runs over the group's rows there, which are
    bounded by the partition. A group that a partition boundary cuts takes an
    offset from the partitions before: one row per partition and group that is
    cut, at most one group open at each boundary.
    """
    valued = df
    for name, value in sums.items():
        valued = valued.withColumn(f"__v_{name}", value)
    rows = _ordered(valued, [group, *order], partitions)
    # NULL is a group of its own
    edge = rows.groupBy("__p", group).agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums))
    ends = edge.groupBy("__p").agg(F.min(F.struct(group)).alias("__lo"), F.max(F.struct(group)).alias("__hi"))
    # a group that is neither first nor last of its partition lies in it whole
    cut = edge.join(F.broadcast(ends), "__p").where(
        F.struct(group).eqNullSafe(F.col("__lo")) | F.struct(group).eqNullSafe(F.col("__hi"))).drop("__lo", "__hi")
    earlier = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.select("__p", F.col(group).alias("__g"),
                        *(F.sum(f"__s_{n}").over(earlier).alias(f"__b_{n}") for n in sums)) \
        .where(F.coalesce(*(F.col(f"__b_{n}") for n in sums)).isNotNull())
    here = Window.partitionBy("__p", group).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *(F.sum(f"__v_{n}").over(here).alias(f"__o_{n}") for n in sums))
    joined = own.join(F.broadcast(before.withColumnRenamed("__p", "__bp")),
                      (F.col("__p") == F.col("__bp")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    zero = F.lit(0)
    out = joined.select(*df.columns, *((F.coalesce(F.col(f"__o_{n}"), zero) + F.coalesce(F.col(f"__b_{n}"), zero)).alias(n)
                                       for n in sums))
    return out
