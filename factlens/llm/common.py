"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

from factlens.sources.scratch import shared_folder

#: Spark deletes a query's shuffle files when it ends, where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """An operator's intermediate tables, by name, as Parquet in the shared folder: their lineage ends there, so they survive
    lost executors and plans stay small. What isn't dropped goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/factlens-{uuid.uuid4().hex}"
        self.turn: dict[str, int] = {}
        self._path("").getFileSystem(self._conf()).deleteOnExit(self._path(""))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """df written under a name and read again; what had the name before goes once df is written."""
        turn = self.turn.get(name, 0) + 1
        path = f"{self.folder}/{name}-{turn}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        self.drop(name)
        self.turn[name] = turn
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            if turn := self.turn.get(name):
                path = self._path(f"{name}-{turn}")
                path.getFileSystem(self._conf()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    return Scratch(df.sparkSession).save("rows", df)


class Kept:
    """What a Python worker has built from a broadcast value, for its next tasks. The value is held beside it and compared as
    an object, so another value at the same address isn't taken for it."""

    def __init__(self):
        self.of: Any = None
        self.options: tuple = ()
        self.built: Any = None

    def get(self, value: Any, build: Callable[..., Any], *options: Any) -> Any:
        """build(value, *options), or what it gave last time for the same object and options."""
        if self.of is not value or self.options != options or self.built is None:
            self.of, self.options, self.built = value, options, build(value, *options)
        return self.built


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of the column (a single longer row stays whole)."""
    for batch in batches:
        offset, size, rows = 0, 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for n in sizes:
            if rows and size + n > limit:
                yield batch.slice(offset, rows)
                offset, size, rows = offset + rows, 0, 0
            size, rows = size + n, rows + 1
        if rows:
            yield batch.slice(offset, rows)
