"""What the text operators share: reading, Arrow batches in small slices, bounded memos, written tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.session import scratch_path, ship_package

#: Rows that a Python task works on at once.
SLICE = 512
#: Rows of an Arrow batch between Spark and a Python task.
BATCH = 2_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects of few texts live at a time.

    The tasks build many lists and no cycles, so the search for cycles runs seldom.
    """
    gc.set_threshold(500_000, 20, 100)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def in_tasks(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """`mapInArrow` in batches that suit whole texts: a batch of ten thousand of them would need much memory on both sides.

    The session keeps the smaller batches. The executors get this package with the first task.
    """
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df.mapInArrow(function, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that nothing is learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends in files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: list[dict] = []


def worker_cache() -> dict:
    """A dictionary for what an operator keeps in a worker process, such as a loaded model."""
    _KEPT.append({})
    return _KEPT[-1]


def keep_only(cache: dict | None = None) -> None:
    """Called where a task begins: what other operators left in this worker process is dropped."""
    for other in _KEPT:
        if other is not cache:
            other.clear()


class Memo(dict):
    """Results by key: each key has a place in `values`. Two generations of about `most` keys are kept.

    It only saves work; a forgotten key is computed again. Keys longer than `longest` are forgotten at once.
    """

    def __init__(self, most: int, longest: int = 64):
        super().__init__()
        self.values_, self.old, self.new, self.long = [], {}, [], []
        self.most, self.longest = most, longest

    def __missing__(self, key):
        at = self[key] = len(self.values_)
        value = self.old.get(key) if self.old else None
        self.values_.append(value)
        if value is None:
            self.new.append(key)
        return at

    def look_up(self, rows: list[list], compute: Callable[[list], list]) -> list[list]:
        """The results of each row's keys; `compute` gets the list of the unknown ones."""
        values = self.values_
        for key in self.long:
            values[self.pop(key)] = None
        self.long = []
        if len(self) > self.most:
            self.old = {key: values[at] for key, at in self.items()}
            self.clear()
            values = self.values_ = []
        places = [[self[key] for key in keys] for keys in rows]
        new, self.new = self.new, []
        if new:
            for key, value in zip(new, compute(new), strict=True):
                values[self[key]] = value
            self.long = [key for key in new if len(key) > self.longest]
        return [[values[at] for at in row] for row in places]
