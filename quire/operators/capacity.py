"""Capacity: memory estimate per request and hardware tier per job.

``route_hardware`` routes each job against the host it was submitted to:
two equi-joins (job -> request, job -> host) that AQE plans as broadcast
when a side is small and as sort-merge otherwise, then a grouped count.
No job x host pairs are formed.

``route_all_hosts`` counts, for every host, what it would do with every job. A
tier depends on how many jobs need less than the host has, so the distinct needs
and the distinct capacities are put in one order and the needs summed along it
(``ordered.running_sums``, no single-task window): each capacity finds its counts
at its own place, and the hosts fetch them by an equi-join. The work is that of
sorting the distinct values, not jobs x hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.columns import py_int, py_round
from quire.operators.ordered import running_sums


def memory_atoms(raw: Column) -> Column:
    """Atom count as the estimate reads it: empty/NULL/0 -> 1, unparsable -> 10, else >= 1."""
    n = py_int(raw)
    return (F.when(raw.isNull() | (raw == ""), F.lit(1))
            .when(n.isNull(), F.lit(fixed.DEFAULT_NUM_ATOMS))
            .otherwise(F.greatest(n, F.lit(1))))


def with_memory(df: DataFrame, raw: str = "num_atoms") -> DataFrame:
    """Add ``n_atoms``, ``mace_gb`` and ``dft_gb`` (3 decimals, Python rounding).
    The unrounded values are staged as columns so the rounding reads attributes."""
    per_sq = float(fixed.MATRIX_COPIES * fixed.BASIS_PER_ATOM ** 2 * fixed.BYTES_PER_DOUBLE)
    nd = F.col("n_atoms").cast("double")
    return (
        df.withColumn("n_atoms", memory_atoms(F.col(raw)))
        .withColumn("__mace", F.lit(fixed.MACE_BASE_GB) + nd * F.lit(fixed.MACE_PER_ATOM_GB))
        .withColumn("__dft", F.lit(fixed.DFT_BASE_GB) + F.lit(per_sq) * (nd * nd) / F.lit(float(fixed.GIB)))
        .withColumn("mace_gb", py_round("__mace", 3))
        .withColumn("dft_gb", py_round("__dft", 3))
        .drop("__mace", "__dft")
    )


def estimate_memory(requests: DataFrame) -> DataFrame:
    """estimated GB for the request's method, plus both model estimates."""
    is_mace = F.upper(F.coalesce(F.col("method_type"), F.lit(""))).contains("MACE")
    return with_memory(requests).select(
        "request_id", "n_atoms", "mace_gb", "dft_gb",
        F.when(is_mace, F.col("mace_gb")).otherwise(F.col("dft_gb")).alias("vram_gb"),
    )


def hardware_tier(mace: Column, dft: Column, vram: Column, registered: Column) -> Column:
    """MACE registered and fits -> GPU_MACE; DFT fits -> GPU_DFT; else CPU. Fits is strict."""
    return (F.when(F.coalesce(registered, F.lit(False)) & (mace < vram), F.lit(fixed.HW_MACE))
            .when(dft < vram, F.lit(fixed.HW_DFT))
            .otherwise(F.lit(fixed.HW_CPU)))


def _with_needs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs with ``mace_gb, dft_gb``; those of an unknown request need one atom's."""
    est = estimate_memory(requests).select("request_id", "mace_gb", "dft_gb")
    mace = round(fixed.MACE_BASE_GB + fixed.MACE_PER_ATOM_GB, 3)
    dft = round(fixed.DFT_BASE_GB + fixed.MATRIX_COPIES * fixed.BASIS_PER_ATOM ** 2 * fixed.BYTES_PER_DOUBLE / fixed.GIB, 3)
    return jobs.join(est, "request_id", "left").fillna({"mace_gb": mace, "dft_gb": dft})


def route_jobs(jobs: DataFrame, requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per job: the hardware tier on its host. A job whose host is unknown runs
    on CPU; one whose request is unknown is estimated as one atom."""
    j = _with_needs(jobs, requests).join(hosts, "host_id", "left")
    return j.withColumn("hw_tier", hardware_tier(F.col("mace_gb"), F.col("dft_gb"),
                                                 F.coalesce(F.col("vram_gb"), F.lit(0.0)),
                                                 F.col("mace_registered")))


def route_hardware(jobs: DataFrame, requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """jobs per host and hardware tier."""
    return (route_jobs(jobs, requests, hosts)
            .groupBy("host_id", "hw_tier").agg(F.count(F.lit(1)).alias("n_jobs")))


def needs_below(needs: DataFrame, capacities: DataFrame, capacity: str, columns: list[str]) -> DataFrame:
    """For every distinct capacity, how many of the ``count`` jobs of ``needs``
    have each of ``columns`` strictly below it: a column ``below_<name>`` each.

    Capacities come before equal needs in the order, so the sum before one is
    exactly that of the smaller needs. NULL needs are below nothing."""
    points = capacities.select(F.col(capacity).cast("double").alias("at")).distinct() \
        .select("at", F.lit(0).alias("is_need"), *(F.lit(0).cast("long").alias(f"__{c}") for c in columns))
    for c in columns:
        points = points.unionByName(needs.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("at"))
                                    .agg(F.sum("count").alias(f"__{c}")).withColumn("is_need", F.lit(1)), allowMissingColumns=True)
    values = {f"below_{c}": F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in columns}
    summed = running_sums(points.withColumn("__all", F.lit(0)), "__all", ["at", "is_need"], values)
    return summed.where("is_need = 0").select(F.col("at").alias(capacity), *values)


def route_all_hosts(jobs: DataFrame, requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """F2 over all pairs: per host and tier, how many of all jobs the host would
    run in that tier (tiers without a job give no row). A host without a known
    capacity has none."""
    per_request = jobs.groupBy("request_id").agg(F.count(F.lit(1)).alias("count"))
    needs = _with_needs(per_request, requests).select(
        "count", "mace_gb", "dft_gb", F.least("mace_gb", "dft_gb").alias("least_gb"))
    needs = needs.groupBy("mace_gb", "dft_gb", "least_gb").agg(F.sum("count").alias("count")) \
        .withColumn("any", F.lit(float("-inf")))        # below every capacity: all jobs
    known = hosts.select("host_id", F.coalesce(F.col("vram_gb").cast("double"), F.lit(0.0)).alias("vram_gb"),
                         F.coalesce("mace_registered", F.lit(False)).alias("mace"))
    below = needs_below(needs, known, "vram_gb", ["mace_gb", "dft_gb", "least_gb", "any"])
    on_mace = F.when(F.col("mace"), F.col("below_mace_gb")).otherwise(0)
    fits = F.when(F.col("mace"), F.col("below_least_gb")).otherwise(F.col("below_dft_gb"))
    tiers = known.join(below, "vram_gb").select("host_id", F.explode(F.array(
        F.struct(F.lit(fixed.HW_MACE).alias("hw_tier"), on_mace.alias("n")),
        F.struct(F.lit(fixed.HW_DFT).alias("hw_tier"), (fits - on_mace).alias("n")),
        F.struct(F.lit(fixed.HW_CPU).alias("hw_tier"), (F.col("below_any") - fits).alias("n")))).alias("t"))
    return tiers.groupBy("host_id", "t.hw_tier").agg(F.sum("t.n").alias("n_jobs")).where("n_jobs > 0")
