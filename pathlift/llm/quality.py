"""Quality by empirical Bayes: evidence of a document with the posteriors of its host and path.

A logistic classifier over text statistics gives each document its evidence. Hosts and paths get posterior rates of
good documents: labels count fully, the classifier's expectation for unlabelled documents with a small weight. A path
shrinks towards its host and a host towards the whole, the more the fewer documents it has; how strongly follows from
the spread of the rates (method of moments). All of it is grouped sums; nothing gathers the documents of a site.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, cut_lineage, text_of

#: At most so many labelled documents are learnt from (those with the smallest hash of their id).
SAMPLE = 20_000
#: How much an unlabelled document's expectation counts against a label.
SOFT_WEIGHT = 0.1
RIDGE, STEPS = 1e-2, 25
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000.0
FEATURES = ("symbols", "capitals", "digits", "repeats", "word_length", "log_words", "sentence_ends", "bars")


def features(text: Column) -> Column:
    """Statistics of a whole text; zeros for an empty one."""
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.split(F.trim(text), r"\s+")
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: (F.length(F.regexp_replace(text, pattern, "")) / chars)
    next_word = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    repeated = F.size(F.filter(F.zip_with(words, next_word, lambda a, b: a == b), lambda x: x))
    return F.array(
        share(r"[\p{L}\p{N}\s.,;:'\"()-]+"), share(r"[^\p{Lu}]+"), share(r"[^\p{N}]+"), repeated / n,
        F.least(chars / n, F.lit(50)) / 10.0, F.log1p(F.size(words)) / 10.0,
        F.least((F.length(text) - F.length(F.translate(text, ".", ""))) / n, F.lit(2)), share(r"[^|!]+"))


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Ridge logistic regression by Newton steps; without both labels, a constant."""
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        zero = (0.0,) * len(FEATURES)
        return QualityModel(zero, float(np.log(rate / (1 - rate))), zero, (1.0,) * len(FEATURES))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = RIDGE * len(y) * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(tuple(map(float, w[:-1])), float(w[-1]), tuple(map(float, mean)), tuple(map(float, scale)))


def evidence(model: QualityModel, values: Column) -> Column:
    """Log odds of label 1 from the statistics."""
    out = F.lit(model.bias)
    for i, (w, m, s) in enumerate(zip(model.weights, model.mean, model.scale)):
        out = out + F.lit(w) * F.least(F.greatest((values[i] - m) / s, F.lit(-8.0)), F.lit(8.0))
    return out


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sites(rows: DataFrame, by: list[str], prior: Column) -> DataFrame:
    """Posterior rate per group of rows (n, k: documents and good ones), shrunk towards ``prior``.

    The strength is that of a Beta prior whose variance matches the spread of the groups' rates around their priors.
    """
    kept = rows.withColumn("prior", prior)
    rate = F.col("k") / F.col("n")
    spread = kept.where("n >= 2").agg(
        F.avg("prior").alias("m"), F.avg((rate - F.col("prior")) ** 2 - rate * (1 - rate) / F.col("n")).alias("v")).first()
    strength = LEAST_STRENGTH
    if spread.m is not None:
        strength = spread.m * (1 - spread.m) / max(spread.v or 0.0, 1e-9) - 1
    strength = float(min(max(strength, LEAST_STRENGTH), MOST_STRENGTH))
    return kept.select(*by, ((F.col("k") + strength * F.col("prior")) / (F.col("n") + strength)).alias("rate"))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
           text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """Per document: id, held_out, evidence, host_rate, path_rate, score (0 to 1) and kept.

    Labels of the held-out fold (crc32 of the id as text, modulo the folds, is 0) are never used; a document with
    several labels is good if most say so. Null texts count as empty. A document without host (or path) stands under
    the global (or host's) rate. Repeated rows are scored each; an empty table gives no rows; other columns are
    ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & (crc_fold(id_col, folds) != 0)).groupBy(
        F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    values = cut_lineage(docs.select(
        F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
        features(text_of(text_col)).alias("x")).join(known, "id", "left"))
    sample = values.where("label is not null").select("id", "x", "label").orderBy(F.xxhash64("id"), "x").limit(SAMPLE).collect()
    model = fit(np.array([r.x for r in sample], float).reshape(-1, len(FEATURES)), np.array([r.label for r in sample], float))

    doc = cut_lineage(values.select("id", "host", "path", "label", evidence(model, F.col("x")).alias("evidence")))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    weight = F.when(F.col("label").isNull(), F.lit(SOFT_WEIGHT)).otherwise(F.lit(1.0))
    counts = [F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("label").cast("double"), p)).alias("k")]
    by_path = cut_lineage(doc.groupBy("host", "path").agg(*counts))
    whole = by_path.agg(F.sum("k") / F.sum("n")).first()[0]
    overall = F.lit(float(min(max(whole if whole is not None else 0.5, 1e-4), 1 - 1e-4)))
    by_host = by_path.where("host is not null").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = cut_lineage(sites(by_host, ["host"], overall).withColumnRenamed("rate", "host_rate"))
    in_host = by_path.where("host is not null and path is not null").join(hosts, "host")
    paths = sites(in_host, ["host", "path", "host_rate"], F.col("host_rate")).withColumnRenamed("rate", "path_rate")
    known_hosts = hosts.withColumnRenamed("host", "h")
    known_paths = paths.select(F.col("host").alias("ph"), F.col("path").alias("pp"), "path_rate")
    joined = doc.join(known_hosts, F.col("host") == F.col("h"), "left").join(
        known_paths, (F.col("host") == F.col("ph")) & (F.col("path") == F.col("pp")), "left")
    host_rate = F.coalesce("host_rate", overall)
    path_rate = F.coalesce(F.col("path_rate"), host_rate)
    rates = joined.select(
        "id", "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"),
        F.coalesce(crc_fold("id", folds) == 0, F.lit(False)).alias("held_out"),
        (1 / (1 + F.exp(-(F.col("evidence") + logit(path_rate) - logit(overall))))).alias("score"))
    return rates.select(
        F.col("id").alias(id_col), "held_out", "evidence", "host_rate", "path_rate", "score",
        (F.col("score") >= threshold).alias("kept"))
