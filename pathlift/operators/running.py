"""Running totals that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

BANDS = 256
SALTS = 16


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], band_keys: Sequence[str], bands: int = BANDS
) -> DataFrame:
    """Per (keys, value): ``<m>_before`` (sum over smaller values) and ``<m>_total`` (sum of the group).

    ``df`` has one row per (keys, value). The values of each ``band_keys`` group (a few model names) are cut at
    their quantiles, from a mergeable sketch, so that bands hold about as many rows each however the values lie;
    running sums are taken inside a band and over the band totals of a group, at most ``bands`` rows. A group with
    a third of all rows is therefore spread over many tasks. Wherever the cuts fall, the result is exact.
    """
    shares = F.array(*[F.lit(i / bands) for i in range(1, bands)])
    cuts = df.groupBy(*band_keys).agg(F.percentile_approx(value, shares, F.lit(40 * bands)).alias("_cuts"))
    banded = df.join(cuts, list(band_keys), "left").withColumn(
        "_band", F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col(value))), F.lit(0))).drop("_cuts")
    by = [*keys, "_band"]
    over_bands = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    table = banded.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
    table = table.select(
        *by,
        *[F.coalesce(F.sum(m).over(over_bands), F.lit(0)).alias(f"_b_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = banded.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}") for m in measures]
    )
    joined = local.join(table, by)
    return joined.withColumns({f"{m}_before": F.col(f"_b_{m}") + F.col(f"_i_{m}") for m in measures}).drop(
        "_band", *[f"_b_{m}" for m in measures], *[f"_i_{m}" for m in measures]
    )


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, salts: int = SALTS) -> DataFrame:
    """Left join on ``keys`` with the big side's hot keys spread over ``salts`` tasks.

    ``spread`` is a column of the big side that varies within a key. The small side is repeated per salt.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "_salt"], "left").drop("_salt")
