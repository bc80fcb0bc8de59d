"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import table_path


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value, so that executors need not
    have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table, scanned as it is."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*cols)


def per_process(key, make: Callable):
    """``make()`` once per Python worker process. Functions shipped by value
    get fresh globals in every task; what is dear to build is kept on ``sys``,
    which outlives the task. One thing at a time: another key takes the place of
    the one before, so a worker holds what its present stage needs."""
    memo = sys.__dict__.setdefault("_quire_llm_memo", {})
    if key not in memo:
        memo.clear()
        memo[key] = make()
    return memo[key]


def forget() -> None:
    """Let go of what an earlier stage kept with ``per_process``."""
    sys.__dict__.get("_quire_llm_memo", {}).clear()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class WordCache(dict):
    """word -> ``make(word)``, in two generations of at most ``limit`` entries
    each: when the young one is full it becomes the old one, and words still in
    use are taken over again. Memory is bounded, whatever the vocabulary."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= 64:
            self.put(word, got)
        return got

    def put(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value


def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row slices of about ``max_bytes`` of text (one
    row at least), which bounds what a kernel holds at a time."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
