"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize as shared_table  # noqa: F401  written once to spark.checkpoint.dir, read back
from tidemark.session import work_dir  # noqa: F401

#: A word is a run of anything but these six ASCII white-space characters (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it and wherever the plan moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that is not pushed below the projection that made its columns, which would compute them twice."""
    at = fresh("at")
    return df.withColumn(at, F.monotonically_increasing_id()).filter((F.col(at) >= 0) & condition).drop(at)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast where a count shows that it has at most ``most`` (short) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def few_tasks(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` of at most ``rows`` short rows in tasks of about ``each``, one per core at least: a stage over a small table
    that a shuffle has dealt out thinly costs its number of tasks. Never more tasks than there are."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def fresh(stem: str) -> str:
    """A column name that no input column can clash with."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job run inside go when it ends, not whenever the driver next collects its garbage. For jobs that
    write a table which later ones read: none of them reads the shuffles of another."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def give_back() -> None:
    """Hand memory that a task no longer uses back to the machine: Python workers go on to other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
