"""Small helpers the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathlift import session

__all__ = ["cut_lineage", "crc_fold", "text_of", "table", "unused", "sliced", "small_batches", "shuffles_dropped"]

#: Rows per Arrow batch handed back by the Python operators; keeps a batch of long texts small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo the number of folds; null where the value is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def unused(name: str, taken: list[str]) -> str:
    """The name, with underscores in front until no column has it (column names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def sliced(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches cut into batches of at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """What is run inside hands texts to the Python workers in Arrow batches of so many rows instead of Spark's 10,000, which
    count several times against an executor: in the JVM outside its heap, and in each worker."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files behind. Otherwise those of every step stay on the executors' disks until the
    driver happens to collect its garbage. For results that are had once: to run the same DataFrame again repeats its shuffles."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``session.cut_lineage``; the shuffles that made the step are not needed once it is written."""
    with shuffles_dropped(df.sparkSession):
        return session.cut_lineage(df)
