"""Shared folder, stored intermediate tables and text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[list[str]] = []  # paths made inside open ``scratch`` blocks


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="countloom-llm-"))


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    for made in _MADE:
        made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables stored inside, at its end, but those handed to the function it yields."""
    made: list[str] = []
    kept: list[str] = []
    _MADE.append(made)
    try:
        yield lambda df: kept.append(df.stored_at) or df
    finally:
        _MADE.remove(made)
        for path in made:
            if path not in kept:
                drop_path(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hand Python at most ``rows`` rows at a time in the jobs run inside; for tables whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose ``column`` holds about ``most`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(sizes.searchsorted(before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give freed memory back to the system: a Python worker goes on to other stages after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns of the input cannot clash with those an operator makes."""
    return df.select(*[df[n] for n in names])
