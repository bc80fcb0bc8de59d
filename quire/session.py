"""Spark session and shared-folder helpers.

Every job in the package is a plain DataFrame transformation; this module only
builds a session with the settings the jobs assume (UTC, AQE on, UI off) and
resolves the shared checkpoint folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins (broadcast vs sort-merge)
# from runtime sizes, coalesces small shuffle partitions and splits skewed ones.
_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_CUT_TABLES: list[str] = []
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch tables", default=None)
# shuffle files go when their query ends, not when the driver's next garbage collection finds them
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# rows go to Python workers in batches of so many bytes at most; 10,000 texts at a time would be held by both sides
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_MOST_BATCH_BYTES = 4 << 20


def get_session(
    master: str | None = None,
    app_name: str = "quire",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the package defaults.

    On a cluster ``master`` stays ``None`` and the submitter's settings win;
    locally (tests, bench) pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and (n := re.fullmatch(r"local\[(\d+)\]", master)):
        conf["spark.quire.minScanSplits"] = n[1]          # one small file: a task for each local thread
    if extra_conf:
        conf.update(extra_conf)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset on
    a local master (a test run) is a scratch folder created and registered;
    on a cluster an unset setting is an error, since a machine-local folder
    would not survive the loss of that machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a "
                             "shared folder that every executor and the driver can reach")
        current = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a table written once to the shared
    checkpoint folder and read back.

    Like a reliable checkpoint it survives the loss of executors; unlike
    ``Dataset.checkpoint`` on an unpersisted plan it computes the rows once
    (the RDD checkpoint recomputes them to write the files). The shuffle files
    of the write are deleted when it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    scratch = _SCRATCH.get()
    (_CUT_TABLES if scratch is None else scratch).append(path)
    write_out(df, path)
    return spark.read.parquet(path)


def write_out(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and let its shuffle files go. Batches for Python
    workers are bounded by bytes meanwhile."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH_BYTES)}
    own = {_CLEANUP: "true", _BATCH_BYTES: before[_BATCH_BYTES] or str(_MOST_BATCH_BYTES)}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def cut_tables(spark: SparkSession):
    """``cut_lineage`` for a job that ends inside: its tables go when it does,
    and only its own."""
    mine: list[str] = []

    def cut(df: DataFrame) -> DataFrame:
        n = len(_CUT_TABLES)
        out = cut_lineage(df)
        mine.extend(_CUT_TABLES[n:])
        del _CUT_TABLES[n:]
        return out

    try:
        yield cut
    finally:
        _drop(spark, mine)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that ``cut_lineage`` writes inside, wherever it is called, go when
    the block ends. Gives ``keep(df)``, which writes a table that stays."""
    outer, mine = _SCRATCH.get(), []

    def keep(df: DataFrame) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _SCRATCH.reset(inner)

    token = _SCRATCH.set(mine)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        _drop(spark, mine)


def drop_cut_tables(spark: SparkSession) -> None:
    """Remove the tables ``cut_lineage`` has written in this process, once no
    DataFrame that reads them is needed any more."""
    _drop(spark, _CUT_TABLES)
