"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed to buckets. A document is the mean of the vectors of all
its n-grams; a linear softmax reads the mean. Vectors and softmax are trained together, so a misspelling that was
never seen still shares most of its vectors with the word. Once trained, the softmax of a mean is the mean of one
number per bucket, so scoring needs a single number per bucket and remembers it per word.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, cut_lineage, text_of, unused
from .words import _Memory, held

#: At most so many labelled documents of each class are learnt from (those with the smallest hash of their id).
SAMPLE_PER_CLASS = 2_000
BUCKETS = 1 << 17
SHORTEST, LONGEST = 3, 5
DIMENSIONS = 8
#: N-grams of nothing that every mean counts in, so that a text of few words stays near the bias.
PRIOR = 120.0
SPREAD = 0.01
#: Documents shown in training, over and over for a small sample.
SHOWN = 12_000
BATCH = 16
RATE = 0.3
#: Words remembered, with their buckets while learning and with one number when scoring, in a generation of the memory.
GRAMS_KEPT, WORDS_KEPT = 100_000, 300_000
#: Bags made before they are handed on, and texts taken out of an Arrow batch.
BAGS_AT_ONCE, TEXTS_AT_ONCE = 64, 256
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def grams(word: str) -> array:
    """Buckets of a word: its n-grams between markers, and itself; none for a word of punctuation only."""
    core = word.strip(PUNCTUATION)
    if not core:
        return array("i")
    marked = f"<{core}>"
    parts = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return array("i", [zlib.crc32(p.encode()) % BUCKETS for p in (*parts, marked + "w")])


def damped(n: int) -> float:
    """Weight of a word that occurs so often: a word repeated all over counts a little more than once."""
    return 1 + math.log(n)


def bag(text: str, known) -> tuple[list[int], list[float]]:
    """Buckets of a text and their shares."""
    counts: dict[int, float] = defaultdict(float)
    for word, n in Counter(text.lower().split()).items():
        for bucket in known[word]:
            counts[bucket] += damped(n)
    total = sum(counts.values()) + PRIOR
    return list(counts), [n / total for n in counts.values()]


@dataclass
class ToxicityModel:
    """One number per bucket and a bias: the difference of the two logits of the softmax."""

    buckets: np.ndarray
    bias: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> ToxicityModel:
    """Train vectors and softmax together by adaptive gradient steps over small batches.

    Both classes weigh the same. Without documents of both classes every score is the share of label 1.
    """
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if n else 0.0, 1e-6, 1 - 1e-6))
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-SPREAD, SPREAD, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = random.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8), np.full(2, 1e-8)
    weight = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    for _ in range(math.ceil(SHOWN / n)):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(bags[r][0]) for r in rows])
            if not sizes.sum():
                continue
            ids = np.concatenate([bags[r][0] for r in rows])
            shares = np.concatenate([bags[r][1] for r in rows]).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), sizes)
            picked = vectors[ids]
            mean = np.stack([np.bincount(row, shares * picked[:, k], len(rows)) for k in range(DIMENSIONS)], 1)
            logits = mean @ linear + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            error = p * weight[rows][:, None]
            to_linear, to_bias, to_mean = mean.T @ error, error.sum(0), error @ linear.T
            buckets, inverse = np.unique(ids, return_inverse=True)
            to_vectors = np.stack(
                [np.bincount(inverse, shares * to_mean[row, k], len(buckets)) for k in range(DIMENSIONS)], 1
            )
            seen_v[buckets] += (to_vectors**2).mean(1)
            seen_l += to_linear**2
            seen_b += to_bias**2
            vectors[buckets] -= (RATE * to_vectors / np.sqrt(seen_v[buckets])[:, None]).astype(np.float32)
            linear -= (RATE * to_linear / np.sqrt(seen_l)).astype(np.float32)
            bias -= (RATE * to_bias / np.sqrt(seen_b)).astype(np.float32)
    return ToxicityModel((vectors @ (linear[:, 1] - linear[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int) -> DataFrame:
    """Bags of the bounded sample: labelled documents outside the held-out fold, whole texts.

    A document is toxic if any of its label rows says 1; rows without a label or an id are not learnt from.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & (crc_fold(id_col, folds) != 0))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    )
    ids = None
    for value in (0, 1):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
        ids = chosen if ids is None else ids.unionByName(chosen)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(ids), "id").select("label", "text")  # at most 2 * SAMPLE_PER_CLASS ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_grams = held(grams, lambda: _Memory(grams, GRAMS_KEPT))
        for frame in batches:
            for at in range(0, len(frame), BAGS_AT_ONCE):
                part = frame.iloc[at : at + BAGS_AT_ONCE]
                bags = [bag(text, known_grams) for text in part.text]
                yield pd.DataFrame({"label": part.label.to_numpy(), "ids": [b[0] for b in bags], "shares": [b[1] for b in bags]})

    return rows.mapInPandas(run, "label int, ids array<int>, shares array<float>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = 5) -> ToxicityModel:
    """Learn from the bounded sample in one task; the driver gets one number per bucket."""
    bags = cut_lineage(training_bags(docs, labels, id_col, text_col, label_col, folds))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(size=[len(x) for x in frame.ids], sum=[float(np.sum(x[:9])) for x in frame.ids])
        frame = frame.sort_values(["label", "size", "sum"], kind="stable")  # the same order whoever made the rows
        model = fit(list(zip(frame.ids, frame.shares)), frame.label.to_numpy(np.int64))
        return pd.DataFrame({"buckets": [model.buckets.tobytes()], "bias": [model.bias]})

    # A few thousand documents by the bound above: one group on purpose.
    done = bags.groupBy(F.lit(0).alias("all")).applyInPandas(run, "buckets binary, bias double").collect()
    if not done:
        return fit([], np.zeros(0, np.int64))
    return ToxicityModel(np.frombuffer(bytes(done[0].buckets), np.float32), done[0].bias)


class _Scorer:
    """Logits of texts; the sums of words met before are remembered."""

    def __init__(self, buckets: bytes, bias: float):
        self.values = np.frombuffer(buckets, np.float32).astype(np.float64)
        self.bias = bias
        self.words = _Memory(self.word, WORDS_KEPT)

    def word(self, text: str) -> complex:
        ids = grams(text)
        return complex(float(self.values[ids].sum()), len(ids)) if ids else 0j

    def logit(self, text: str) -> float:
        total = complex(0, PRIOR)  # sum of bucket values, and number of n-grams
        value = self.words.__getitem__
        for word, n in Counter(text.lower().split()).items():
            total += value(word) * damped(n)
        return total.real / total.imag + self.bias


def score(model: ToxicityModel, column: Column) -> Column:
    """Probability of label 1 for a whole text; null counts as empty, an empty text gets what the bias says."""
    buckets, bias = model.buckets.tobytes(), model.bias
    name = hashlib.sha256(buckets).hexdigest(), bias

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        scorer = held((_Scorer, name), lambda: _Scorer(buckets, bias))
        parts = (texts.slice(at, TEXTS_AT_ONCE).to_pylist() for at in range(0, len(texts), TEXTS_AT_ONCE))
        logits = [scorer.logit(text) for part in parts for text in part]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -50, 50))))

    return run(F.coalesce(column.cast("string"), F.lit("")))


def scored(df: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns and the score; where ``into`` is taken, the new column has underscores in front."""
    return df.withColumn(unused(into, df.columns), score(model, F.col(text_col)))


def kept(df: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows scored below the threshold, columns as they came."""
    return df.where(score(model, F.col(text_col)) < threshold)
