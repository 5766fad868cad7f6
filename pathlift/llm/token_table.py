"""Token ids in parquet: list columns with chosen encoding, row groups and pages, written in document order.

``write`` orders texts by document: bounds of the ranges come from a pass over the ids alone, each row is dealt to its
range by number, so texts are read, moved and encoded once. It encodes each partition and writes one file per range.
``pos`` numbers the rows in file order. ``read`` takes the columns asked for and a range of documents; statistics of row
groups and pages leave out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import crc32, sliced, small_batches, text_of
from .words import packed_id, word_tokenizer

ENCODINGS = ("dictionary", "delta")
#: Rows wanted in a file, files for each core at least, and ids sampled to bound the ranges.
ROWS_A_FILE, FILES_A_CORE = 65_536, 4
SAMPLED_A_RANGE, SAMPLED_AT_MOST = 100, 1_000_000


def encoded(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, ids, n_tokens) in the order given; the end id closes each document."""
    kind, end = df.schema[id_col].dataType, packed_id(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer).encode
        for batch in sliced(batches):
            ids = [encode(text) + end for text in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(sizes)],
                names=["doc_id", "ids", "n_tokens"],
            )

    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, ids array<int>, n_tokens int"
    )


def range_bounds(ids: DataFrame, files: int, seed: int = 7) -> list:
    """Ids that part the rows into about equal ranges, from a sample of the one column; an id may bound several."""
    n = ids.where("doc_id is not null").count()
    wanted = min(SAMPLED_A_RANGE * files, SAMPLED_AT_MOST)
    if files < 2 or not n:
        return []
    sample = sorted(r.doc_id for r in ids.where("doc_id is not null").sample(min(1.0, wanted / n), seed).collect())
    return [sample[len(sample) * i // files] for i in range(1, files)] if sample else []


def dealt_to_ranges(rows: DataFrame, bounds: list) -> DataFrame:
    """Rows (doc_id, text) with ``range``: how many bounds lie below the id, found by halving; null ids come first.

    Rows whose id is itself a bound may lie in any range that it bounds, by the size of a hash of the text: so an id
    that is repeated very often fills several ranges.
    """
    if not bounds:
        return rows.withColumn("range", F.lit(0))
    listed, n, doc_id = F.array(*[F.lit(b) for b in bounds]), len(bounds), F.col("doc_id")
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])

    def passed(meets) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= n) & meets(F.get(listed, at + step - 1)), at + step).otherwise(at))

    share = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    spread = F.floor(share * (F.col("_last") - F.col("_first") + 1)).cast("int")
    found = rows.withColumns({"_first": passed(lambda b: b < doc_id), "_last": passed(lambda b: b <= doc_id)})
    place = F.when(F.col("_first") == F.col("_last"), F.col("_last")).otherwise(F.col("_first") + spread)
    return found.withColumn("range", place).drop("_first", "_last")


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary",
          row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, files: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, ids, n_tokens and pos in ascending order of the id.

    A null text counts as empty and holds the end id alone; a text of any length is one row. Null ids come first; rows
    with equal ids stay apart and follow each other in an order that depends on their texts alone, if need be over
    several files. Other columns are left out; an empty table gives a table without rows.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = df.sparkSession
    ids = df.select(F.col(id_col).alias("doc_id"))
    if files is None:
        cores = spark.sparkContext.defaultParallelism
        files = max(1, -(-ids.count() // ROWS_A_FILE), FILES_A_CORE * cores)
    taken = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    dealt = dealt_to_ranges(taken, range_bounds(ids, files))
    ranged = dealt.repartitionById(files, F.col("range")).drop("range")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = encoded(ordered, tokenizer, end_id, "doc_id", "text")
    writer = (
        rows.withColumn("pos", F.monotonically_increasing_id())
        .write.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
    )
    with small_batches(spark):
        writer.parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, first_id=None, last_id=None) -> DataFrame:
    """Chosen columns of the documents in a closed range of ids; without ``ids`` no token page is read."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows.select(*columns) if columns else rows


def ids_crc32(column: str = "ids") -> Column:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def digest(ids: pa.Array) -> pa.Array:
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        return pa.array([crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return digest(column)


def starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before, in file order.

    Running sums stay within one file, whose size is bounded; files add one row each to the sums before them.
    """
    rows = rows.withColumn("file", F.shiftrightunsigned("pos", 33))
    within = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens")).select(
        "file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start")
    )
    return (
        rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(files, "file")
        .withColumn("start", F.col("file_start") + F.col("in_file"))
        .drop("file", "in_file", "file_start")
    )
