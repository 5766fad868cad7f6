"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, one per dimension.

Vectors are dealt to shards of bounded size and queries to lanes of bounded size; every (shard, lane) cell is one
task. A task reads its vectors, sorts every dimension once and answers its queries one after another: depth by depth
it reads the lists from the end that suits the sign of the query's component, scores vectors it hasn't met by random
access, and stops as soon as the kth score is above the threshold, the highest score a vector not yet met can have.
The answers of the shards are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage

SCALE, TOP = 256, 5
SHARD_ROWS, LANE_ROWS = 8_192, 16_384
FIRST_DEPTH = 16


class SortedLists:
    """The vectors of a shard with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.up, axis=0)
        self.largest = float(np.abs(vectors).max(initial=0))
        # Products in floating point are exact up to 2**53 and much faster.
        self.floats = vectors.astype(np.float64)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(query).sum()) < 2.0**53:
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[at] @ query

    def search(self, query: np.ndarray, row: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best, ties to the smaller id, and the depth reached; never the query's own row."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weights = query[used]
        rising = weights > 0
        met = self.rows == row
        unmet = n - int(met.sum())
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        begin, depth = 0, 0
        while unmet and depth < n:
            begin, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            if len(used):
                low, high = self.up[begin:depth, used], self.up[n - depth : n - begin, used]
                at = np.where(rising, high, low).ravel()
            else:  # every score is 0
                at = np.arange(begin, depth)
            fresh = np.zeros(n, bool)
            fresh[at] = True
            fresh &= ~met
            at = np.flatnonzero(fresh)
            met |= fresh
            unmet -= len(at)
            ids, scores = best(np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.scores(at, query)]), top)
            edge = np.where(rising, self.sorted[n - depth, used], self.sorted[depth - 1, used])
            # At equal scores a vector not yet met might have the smaller id.
            if len(ids) == top and int(scores[-1]) > int((edge * weights).sum()):
                break
        return ids, scores, depth


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        may = scores >= least
        ids, scores = ids[may], scores[may]
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    ends = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _searcher(width: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, lists = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            # Rows come sorted by cell, and within a cell the vectors before the queries.
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, waiting, lists = cells[a], [], None
                ids, rows = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                vectors = _padded(part.column("x"), width)
                if not asks[a]:
                    waiting.append((ids, rows, vectors))
                    continue
                if lists is None and waiting:
                    lists = SortedLists(*map(np.concatenate, zip(*waiting)))
                    waiting = []
                if lists is None:
                    continue
                found = [lists.search(v, r, top)[:2] for v, r in zip(vectors, rows)]
                sizes = [len(i) for i, _ in found]
                yield pa.record_batch(
                    [pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(ids, sizes)),
                     pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                    names=["row", "query_id", "vec_id", "score"])

    return run


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, row, x): each usable vector as floor(scale * component), with a number of its own."""
    x = F.col(vec_col)
    usable = x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))
    return rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "x")


def top_k(df: DataFrame, every: int = 50, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, lane_rows: int = LANE_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of the best other rows.

    Null vectors, vectors with null, NaN or infinite components and rows without id neither ask nor answer. Shorter
    vectors count as ending in zeros, an empty one as zero. Rows repeated with one id are rows of their own: each
    asks, and the others answer. Ties go to the smaller id; fewer rows than ``top`` give what there is, an empty
    table gives no rows. Other columns are ignored. Scores must fit 63 bits.

    A shard holds about ``shard_rows`` vectors and a lane about ``lane_rows`` queries, so memory and time of a task
    are bounded; each query goes to every shard once, each vector to every lane once.
    """
    rows = cut_lineage(whole_numbers(df, id_col, vec_col, scale))
    asked = F.col("vec_id") % every == 0
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q"), F.max(F.size("x")).alias("width")).first()
    shards, lanes = -(-size.n // shard_rows) or 1, -(-size.q // lane_rows) or 1
    shard, lane = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(lanes))
    held = rows.select("*", F.lit(False).alias("asks"), shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    asks = rows.where(asked).select("*", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), lane.alias("lane"))
    cells = held.unionByName(asks).withColumn("cell", (F.col("shard") * lanes + F.col("lane")).cast("int")).drop("shard", "lane")
    found = cells.repartitionById(shards * lanes, F.col("cell")).sortWithinPartitions("cell", "asks").mapInArrow(
        _searcher(size.width or 0, top), "row long, query_id long, vec_id long, score long")
    w = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
