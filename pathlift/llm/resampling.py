"""Importance resampling of documents towards a target text collection, by hashed word n-grams.

Each document is normalised (words joined by one separator) and scanned once. The scan stores the running CRC-32 and
the byte offset at the end of every word. The CRC of any n-gram follows from two prefixes: the prefix before it is
shifted over the n-gram's length, a linear map over GF(2), and cancelled from the prefix that ends with it. No
n-gram is ever cut out or hashed by itself; counting and weighing both derive from the stored scan.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, functions as F

from pathlift.operators.ranking import numbered

from .common import cut_lineage, sliced, text_of

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Bytes of words: digits, lower-case letters (A-Z become these) and all bytes of characters beyond ASCII.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))
WORD_AND_SPACE = re.compile(rb" ?[^ ]+")
#: Words handled at once when n-grams are derived, so that work arrays stay in the cache.
AT_ONCE = 1 << 16
DIGIT = 128


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


def _by_bytes(table: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits as four look-ups, one for each byte; ``at`` is where the map's tables start."""
    out = table.take((crc & np.uint32(255)) + at)
    out ^= table.take((crc >> np.uint32(8) & np.uint32(255)) + (at + 256))
    out ^= table.take((crc >> np.uint32(16) & np.uint32(255)) + (at + 512))
    out ^= table.take((crc >> np.uint32(24)) + (at + 768))
    return out


@functools.lru_cache(maxsize=8)
def _shift_table(level: int) -> np.ndarray:
    """Tables of the shifts by 0, 1, ... 127 times 128**level zero bytes, four times 256 values each, in one array."""
    table = np.empty((DIGIT, 1024), np.uint32)
    table[0] = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()
    if level:
        below = _shift_table(level - 1)

        def step(crc):  # 127 units of the level below, and one more
            return _by_bytes(below, 1024, _by_bytes(below, (DIGIT - 1) * 1024, crc))
    else:
        def step(crc):
            return _byte_table()[crc & 0xFF] ^ (crc >> np.uint32(8))
    for digit in range(1, DIGIT):
        table[digit] = step(table[digit - 1])
    return table.ravel()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes: what the prefix before a substring adds to the CRC at its end."""
    out = _by_bytes(_shift_table(0), (length % DIGIT) * 1024, crc)
    level, rest = 1, length // DIGIT
    while rest.any():
        far = np.flatnonzero(rest)
        out[far] = _by_bytes(_shift_table(level), (rest[far] % DIGIT) * 1024, out[far])
        level, rest = level + 1, rest // DIGIT
    return out


def after_separator(crc: np.ndarray) -> np.ndarray:
    """The running CRC one separator further."""
    state = ~crc
    return ~(_byte_table()[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def scan(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and running CRC at the end of every word of the normalised text."""
    normal = b" ".join(text.encode().translate(WORD_BYTES).split())
    words = WORD_AND_SPACE.findall(normal)
    ends = np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), dtype=np.int32)
    running = accumulate(words, lambda crc, word: zlib.crc32(word, crc), initial=0)
    next(running)
    return ends, np.fromiter(running, np.uint32, len(words))


def _chunks(ends: np.ndarray, crcs: np.ndarray, last: np.ndarray, longest: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(n, words, places, CRCs): n-grams of all documents of a batch, by the words they start with.

    ``last`` is, for every word, the number of the first word behind its document.
    """
    first = np.empty(len(ends), bool)
    if len(ends):
        first[0] = True
        first[1:] = last[1:] != last[:-1]
    for begin in range(0, len(ends), AT_ONCE):
        here = slice(begin, min(begin + AT_ONCE, len(ends)))
        words = np.arange(here.start, here.stop)
        before = np.where(first[here], 0, ends[words - 1] + 1)
        prefix = np.where(first[here], np.uint32(0), after_separator(crcs[words - 1]))
        for n in range(1, longest + 1):
            whole = np.flatnonzero(words + (n - 1) < last[here])
            end = words[whole] + (n - 1)
            length = (ends[end] - before[whole]).astype(np.int64)
            yield n, here, whole, crcs[end] ^ shifted(prefix[whole], length)


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ends and crcs of its words; the stored form from which n-grams are derived."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            both = [scan(text) for text in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(e) for e, _ in both])]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x).view(np.int32)))
                for x in (([e for e, _ in both]), ([c for _, c in both]))]
            yield pa.record_batch([batch.column(0), *lists], names=["doc_id", "ends", "crcs"])

    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col)).mapInArrow(
        run, f"doc_id {kind.simpleString()}, ends array<int>, crcs array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ends, crcs, last (see ``_chunks``) and the bounds of the rows, for a batch of the stored scan."""
    ends, crcs = batch.column("ends"), batch.column("crcs")
    bounds = ends.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    last = np.repeat(bounds[1:], np.diff(bounds))
    return (ends.flatten().to_numpy(zero_copy_only=False), crcs.flatten().to_numpy(zero_copy_only=False).view(np.uint32),
            last, bounds)


def counted(scan_rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many n-grams of all documents fall into each bucket; buckets without any are left out.

    Each task adds up its documents first and gives one row per bucket, so the shuffle holds no n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            ends, crcs, last, _ = _flat(batch)
            for _, _, _, found in _chunks(ends, crcs, last, longest):
                total += np.bincount(found % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    parts = scan_rows.select("ends", "crcs").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the target's share over the source's, each with one n-gram more in every bucket."""
    many, few = sum(source.values()), sum(target.values())
    return np.array([
        math.floor(1000 * math.log(
            float((target.get(b, 0) + 1) * (many + buckets)) / float((source.get(b, 0) + 1) * (few + buckets))))
        for b in range(buckets)], np.int64)


def weighed(scan_rows: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight (sum of the gains of all its n-grams)."""
    kind = scan_rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ends, crcs, last, bounds = _flat(batch)
            gain = np.zeros(len(ends), np.int64)
            for _, here, whole, found in _chunks(ends, crcs, last, longest):
                gain[here.start + whole] += gains[found % np.uint32(len(gains))]
            sums = np.concatenate([[0], np.cumsum(gain)])
            words = np.diff(bounds)
            features = sum(np.maximum(words - n, 0) for n in range(longest))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"])

    return scan_rows.mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Add score (weight plus Gumbel noise from the id's digest) and rank among the drawn, null for the others.

    Sampling without replacement by weight: the highest scores of the documents with enough words are drawn. Ties go
    to the smaller id, a null id (hashed as an empty one) comes last. Ranks are exact over any number of documents.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = weights.withColumns({"score": F.col("weight") + noise, "_may": F.col("n_words") >= least_words})
    placed = numbered(rows, [F.desc("_may"), F.desc("score"), F.col("doc_id").asc_nulls_last()], into="_place")
    wanted = placed.agg(F.floor(F.count_if("_may") * percent / 100).cast("long")).scalar()
    rank = F.when(F.col("_may") & (F.col("_place") < wanted), F.col("_place") + 1)
    return placed.withColumn("rank", rank.cast("long")).drop("_may", "_place")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT,
              least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null where not drawn).

    Null and empty texts and texts without words have no n-grams and weigh 0; a text of any length is scanned whole.
    Repeated rows are documents of their own. Without documents there are no rows; without target texts the target
    counts as one n-gram in every bucket. Other columns are ignored. Only the counts of the buckets, a fixed number,
    reach the driver and go back to the tasks.
    """
    rows = cut_lineage(scanned(docs, id_col, text_col))
    goal = target.select(F.lit(0).alias("item"), F.col(target_col).alias("text"))
    source_n = {r.bucket: r.n for r in counted(rows, buckets, longest).collect()}
    target_n = {r.bucket: r.n for r in counted(scanned(goal, "item", "text"), buckets, longest).collect()}
    gains = bucket_gains(source_n, target_n, buckets)
    return drawn(weighed(rows, gains, longest), percent, least_words, seed)
