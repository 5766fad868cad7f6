"""Packing of documents into fixed windows: counts of length combinations by non-negative least squares.

1. One pass encodes each document and cuts it into whole windows and a tail. Kept are lengths, checksums of every whole
   window and of the tail, and the ids of the tail, which only the tails that are cut later read again.
2. The histogram of tail lengths (fewer than ``window`` numbers, however many documents) goes to the driver, which
   enumerates shallow combinations of lengths that fill a window exactly, solves their repeat counts against the
   histogram by non-negative least squares, rounds them and repeats what still fits.
3. The lengths left over are packed greedily by best fit, still as counts: the largest length that fits goes next into a
   window, and where none fits one document is cut at the window's border; its rest is a length of its own. Only what
   remains at the very end, less than a window, is laid out in sequences of powers of two, so nothing is padded.
4. Every tail has a rank within its length. The plan gives ranges of ranks to slots (sequence, offset, part of the tail).

Positions are arithmetic on ranks; no group of documents ever meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import crc32, cut_lineage, sliced, small_batches, text_of
from .words import packed_id, word_tokenizer

DEPTH = 8
OFFSETS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
SWEEPS = 6


# --- lengths and checksums -------------------------------------------------------------------------------------------

_MEASURED = (
    "part int, doc {id}, n_ids long, full_first long, full_crcs array<long>, tail_len int, tail_rank long, "
    "tail_crc long, tail binary"
)


def measured(df: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its length, checksums of its parts, the ids of its tail, and its rank among equal tails of its
    partition."""
    kind, end = df.schema[id_col].dataType, packed_id(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer).encode
        part, full_seen, ranks = TaskContext.get().partitionId(), 0, defaultdict(int)
        for batch in sliced(batches):
            rows: dict[str, list] = {k: [] for k in ("n", "first", "full", "size", "rank", "crc", "tail")}
            for text in batch.column(1).to_pylist():
                ids = encode(text) + end
                n = len(ids) // 4
                whole, size = divmod(n, window)
                tail = ids[whole * window * 4 :]
                rows["n"].append(n)
                rows["first"].append(full_seen)
                rows["full"].append([crc32(ids[i * window * 4 : (i + 1) * window * 4]) for i in range(whole)])
                rows["size"].append(size)
                rows["rank"].append(ranks[size])
                rows["crc"].append(crc32(tail))
                rows["tail"].append(tail)
                full_seen += whole
                ranks[size] += 1
            yield pa.record_batch(
                [
                    pa.array([part] * batch.num_rows, pa.int32()), batch.column(0),
                    pa.array(rows["n"], pa.int64()), pa.array(rows["first"], pa.int64()),
                    pa.array(rows["full"], pa.list_(pa.int64())), pa.array(rows["size"], pa.int32()),
                    pa.array(rows["rank"], pa.int64()), pa.array(rows["crc"], pa.int64()), pa.array(rows["tail"], pa.binary()),
                ],
                names=["part", "doc", "n_ids", "full_first", "full_crcs", "tail_len", "tail_rank", "tail_crc", "tail"],
            )

    plain = df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    return plain.mapInArrow(run, _MEASURED.format(id=kind.simpleString()))


# --- the plan: bounded by the window, not by the data ----------------------------------------------------------------


def combinations(lengths: set[int], window: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of present lengths that fill the window: (length, times) pairs.

    One length repeated up to ``DEPTH`` times with one other, and three lengths of which two lie near each other.
    """
    found: dict[tuple[tuple[int, int], ...], None] = {}
    for a in sorted(lengths):
        for times in range(1, min(DEPTH, window // a) + 1):
            left = window - times * a
            if left == 0:
                found[((a, times),)] = None
            elif left == a:
                found[((a, times + 1),)] = None
            elif left in lengths:
                found[tuple(sorted(((a, times), (left, 1))))] = None
        for gap in OFFSETS:
            b, c = a + gap, window - 2 * a - gap
            if gap and b in lengths and c in lengths and c >= b:
                parts: dict[int, int] = defaultdict(int)
                for length in (a, b, c):
                    parts[length] += 1
                found[tuple(sorted(parts.items()))] = None
    return list(found)


def repeat_counts(columns: list, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the combinations against the histogram, by coordinate descent."""
    rest = histogram.astype(float).copy()
    x = np.zeros(len(columns))
    order = sorted(range(len(columns)), key=lambda j: -min(histogram[length] / times for length, times in columns[j]))
    norms = [float(sum(times * times for _, times in column)) for column in columns]
    for _ in range(SWEEPS):
        for j in order:
            step = sum(rest[length] * times for length, times in columns[j]) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for length, times in columns[j]:
                    rest[length] -= step * times
    return x


def solved(histogram: np.ndarray, window: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
    """Rounded repeat counts that fit the histogram, and what they leave over."""
    columns = combinations({int(n) for n in np.flatnonzero(histogram)}, window)
    x = repeat_counts(columns, histogram)
    left = histogram.copy()
    counts = np.zeros(len(columns), dtype=np.int64)
    order = np.argsort(-x, kind="stable")
    for rounded in (True, False):  # the rounded counts first, then whatever still fits
        for j in order:
            fits = min(int(left[length]) // times for length, times in columns[j])
            n = min(int(x[j] + 0.5), fits) if rounded else fits
            if n > 0:
                counts[j] += n
                for length, times in columns[j]:
                    left[length] -= n * times
    return [(columns[j], int(counts[j])) for j in order if counts[j]], left


@dataclass
class _Source:
    """Equal pieces to pack: ``n`` tails of ``length`` from rank ``first`` on, each without its first ``start`` ids."""

    length: int
    first: int
    n: int
    start: int = 0

    @property
    def size(self) -> int:
        return self.length - self.start


class _Pool:
    """Sources by size."""

    def __init__(self, sources: list[_Source]):
        self.sizes: list[int] = []
        self.by_size: dict[int, list[_Source]] = {}
        for source in sources:
            self.add(source)

    def add(self, source: _Source) -> None:
        if source.size not in self.by_size:
            insort(self.sizes, source.size)
            self.by_size[source.size] = []
        self.by_size[source.size].append(source)

    def drop_empty(self, sources: list[_Source]) -> None:
        for source in sources:
            if not source.n:
                kept = self.by_size[source.size]
                kept.remove(source)
                if not kept:
                    del self.by_size[source.size]
                    self.sizes.remove(source.size)

    def largest(self, room: int, uses: dict[int, int], whole: bool = False) -> _Source | None:
        """Of the sources with something left, one of the largest size up to ``room``; ``whole``: never cut before."""
        for at in range(bisect_right(self.sizes, room) - 1, -1, -1):
            for source in self.by_size[self.sizes[at]]:
                if source.n > uses.get(id(source), 0) and not (whole and source.start):
                    return source
        return None


def best_fit(sources: list[_Source], window: int, sequence: int) -> list[tuple]:
    """Slots for all sources, from the given sequence on: windows filled by the largest piece that fits, many at once.

    A window is composed once and repeated as often as its sources allow, so every step uses up a source; cutting
    leaves a new one of at most half as many pieces, which bounds the steps by the lengths times the logarithm of
    their counts. The cut prefers tails that are still whole.
    """
    pool, rows = _Pool(sources), []
    while pool.sizes:
        room, uses, parts, cut = window, {}, [], None
        while room:
            source = pool.largest(room, uses)
            size = source.size if source else room
            if source is None:  # nothing fits: the rest of the window is the beginning of a larger piece
                source = cut = pool.largest(window, uses, whole=True) or pool.largest(window, uses)
                if source is None:
                    break
            parts.append((source, uses.get(id(source), 0), window - room, size))
            uses[id(source)] = uses.get(id(source), 0) + 1
            room -= size
        used = list({id(source): source for source, *_ in parts}.values())
        n = min(source.n // uses[id(source)] for source in used)
        rest = None
        for source, turn, offset, size in parts:
            first = source.first + turn * n
            rows.append((source.length, first, first + n, sequence, offset, source.start, size))
            if source is cut and size < source.size:
                rest = _Source(source.length, first, n, source.start + size)
        for source in used:
            source.first += uses[id(source)] * n
            source.n -= uses[id(source)] * n
        pool.drop_empty(used)
        if rest:
            pool.add(rest)
        if room:  # the last pieces of all: less than a window
            rows, sequence = _in_powers(rows, sequence, window - room), sequence
            break
        sequence += n
    return rows


def _in_powers(rows: list[tuple], sequence: int, total: int) -> list[tuple]:
    """The slots of the last sequence, ``total`` ids, dealt anew to sequences whose lengths are powers of two."""
    borders, at = [], 0
    for power in range(total.bit_length() - 1, -1, -1):
        if total >> power & 1:
            borders.append((at, at + (1 << power)))
            at += 1 << power
    out = [row for row in rows if row[3] != sequence]
    for length, first, last, _, offset, start, size in (row for row in rows if row[3] == sequence):
        for number, (low, high) in enumerate(borders):
            a, b = max(offset, low), min(offset + size, high)
            if a < b:
                out.append((length, first, last, sequence + number, a - low, start + a - offset, b - a))
    return out


def _slots(histogram: np.ndarray, window: int, first_sequence: int) -> list[tuple]:
    """Rows (length, first rank, last rank, sequence, offset, start in the tail, size) for all tails."""
    plan, left = solved(histogram, window)
    used = np.zeros(len(histogram), dtype=np.int64)
    rows, sequence = [], first_sequence
    for column, n in plan:
        offset = 0
        for length, times in column:
            for _ in range(times):
                rows.append((length, int(used[length]), int(used[length]) + n, sequence, offset, 0, length))
                used[length] += n
                offset += length
        sequence += n
    return rows + best_fit([_Source(int(n), int(used[n]), int(left[n])) for n in np.flatnonzero(left)], window, sequence)


_SLOT_SCHEMA = "s_len int, s_first long, s_last long, s_sequence long, s_offset int, s_start int, s_size int"


# --- the operator ----------------------------------------------------------------------------------------------------


def packed(df: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Pieces of documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two. Every id, the end id included, lies in exactly one piece. A null text counts as
    empty and packs as the end id alone; repeated rows (and rows with equal or null ids) are packed each for itself;
    an empty table gives no piece; other columns are ignored.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = df.sparkSession
    with small_batches(spark):
        docs = cut_lineage(measured(df, tokenizer, end_id, window, id_col, text_col))

    by_length = docs.where("tail_len > 0").groupBy("part", "tail_len").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("tail_len").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_length = cut_lineage(by_length.withColumn("rank_base", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    parts = docs.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("full"))  # a row for each input partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("full_base", F.coalesce(F.sum("full").over(before), F.lit(0))))

    full = parts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    histogram = np.zeros(window, dtype=np.int64)
    for row in by_length.groupBy("tail_len").agg(F.sum("n").alias("n")).collect():  # fewer rows than the window
        histogram[row.tail_len] = row.n
    rows = _slots(histogram, window, int(full))
    # Bounded by the combinations of the window and the steps of the greedy packing, not by the documents.
    slots = F.broadcast(spark.createDataFrame(rows, _SLOT_SCHEMA))

    ranked = docs.where("tail_len > 0").join(by_length.select("part", "tail_len", "rank_base"), ["part", "tail_len"]).withColumn(
        "rank", F.col("rank_base") + F.col("tail_rank"))
    meets = (F.col("tail_len") == F.col("s_len")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_last"))
    placed = ranked.join(slots, meets)
    tail_start, sequence = F.col("n_ids") - F.col("tail_len"), F.col("s_sequence") + F.col("rank") - F.col("s_first")

    def piece(start, length, crc, sequence_id, offset) -> list[Column]:
        return [
            F.col("doc").alias(id_col), start.cast("long").alias("start"), length.cast("long").alias("length"),
            crc.alias("ids_crc32"), F.col("n_ids").alias("doc_tokens"), sequence_id.cast("long").alias("sequence_id"),
            offset.cast("long").alias("offset")]

    uncut = placed.where("s_size = s_len").select(
        *piece(tail_start, F.col("s_size"), F.col("tail_crc"), sequence, F.col("s_offset")))
    part_crc = F.crc32(F.substr("tail", F.col("s_start") * 4 + 1, F.col("s_size") * 4))
    cut = placed.where("s_size < s_len").select(
        *piece(tail_start + F.col("s_start"), F.col("s_size"), part_crc, sequence, F.col("s_offset")))
    whole = docs.where(F.size("full_crcs") > 0).join(parts.select("part", "full_base"), "part").select(
        "doc", "n_ids", (F.col("full_base") + F.col("full_first")).alias("base"), F.posexplode("full_crcs").alias("i", "crc"))
    whole = whole.select(*piece(F.col("i") * window, F.lit(window), F.col("crc"), F.col("base") + F.col("i"), F.lit(0)))
    return uncut.union(cut).union(whole)


def sequences(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Per sequence: ids in it, its pieces, and its length after padding (its own length at a power of two)."""
    used = F.sum("length")
    return pieces.groupBy("sequence_id").agg(used.alias("n_ids"), F.count("*").alias("n_pieces")).withColumn(
        "padded", F.when(F.bit_count(F.col("n_ids")) == 1, F.col("n_ids")).otherwise(F.lit(window).cast("long"))
    )
