"""Day-level base of an attribution run: range, facts, totals and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pathlift.config import AttributionConfig
from pathlift.functions.scalars import normalize_value
from pathlift.session import cut_lineage


#: Days a comparison needs: one to observe, one to compare with.
TWO_DAYS = 2


def check_columns(raw: DataFrame, cfg: AttributionConfig) -> None:
    """Refuse dimensions the table does not have, before any expression is built from them."""
    missing = [c for c in (*cfg.dimensions, cfg.date_field, *cfg.measures) if c not in raw.columns]
    if missing:
        raise ValueError(f"fact table lacks columns: {missing}")


def partition_slice(raw: DataFrame, cfg: AttributionConfig, pt: str | None) -> DataFrame:
    return raw if pt is None else raw.where(F.col(cfg.partition_field) == F.lit(pt))


def window_range(raw: DataFrame, cfg: AttributionConfig, pt: str | None = None, offset: int = 0) -> DataFrame:
    """One row: data range, and half-open scan ranges of the alert scan and of the longer trend.

    The end is the newest day moved back by ``offset``; two spare days are read before the look-back because
    only days with data count.
    """
    one = partition_slice(raw, cfg, pt).agg(
        F.to_date(F.min(cfg.date_field)).alias("table_date_min"),
        F.to_date(F.max(cfg.date_field)).alias("table_date_max"),
    )
    end = F.date_sub("table_date_max", max(0, int(offset)))
    return one.select(
        "table_date_min",
        "table_date_max",
        F.date_sub(end, cfg.lookback_days + 2).alias("scan_start"),
        F.date_sub(end, cfg.trend_days + 2).alias("trend_start"),
        F.date_add(end, 1).alias("end_exclusive"),
    )


def facts_in_range(
    raw: DataFrame, cfg: AttributionConfig, pt: str | None = None, offset: int = 0, trend: bool = False
) -> DataFrame:
    """Facts of one partition and range: normalised dimensions, ``day``, measures.

    The range is looked up first (one row, one column read) and compared as literals of the date column's own
    type: the scan then skips row groups outside it, which a filter known only at run time would not reach.
    """
    check_columns(raw, cfg)
    rows = partition_slice(raw, cfg, pt)
    bounds = window_range(raw, cfg, pt, offset).first()
    if bounds is None or bounds["table_date_max"] is None:
        raise ValueError(f"no dates in {cfg.date_field} of the partition {pt}")
    when, kind = F.col(cfg.date_field), raw.schema[cfg.date_field].dataType
    start = F.lit(bounds["trend_start" if trend else "scan_start"]).cast(kind)
    rows = rows.where((when >= start) & (when < F.lit(bounds["end_exclusive"]).cast(kind)))
    return rows.select(
        F.to_date(cfg.date_field).alias("day"),
        *[normalize_value(d).alias(d) for d in cfg.dimensions],
        *[F.col(m).cast("double").alias(m) for m in cfg.measures],
    )


def trend_facts(raw: DataFrame, base: "Base", pt: str | None = None, offset: int = 0) -> DataFrame:
    """Facts of the trend range; those of the base serve where they reach back as far, so facts are read once."""
    cfg = base.cfg
    if cfg.trend_days > cfg.lookback_days:
        return facts_in_range(raw, cfg, pt, offset, trend=True)
    start = window_range(raw, cfg, pt, offset).select("trend_start").scalar()
    return base.facts.where(F.col("day") >= start)


def collapse(facts: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """One row per dimension combination and day. Partial sums shrink the data before the only shuffle."""
    return facts.groupBy("day", *cfg.dimensions).agg(
        *[F.sum(m).alias(m) for m in cfg.measures], F.count(F.lit(1)).alias("source_rows")
    )


def daily_totals(facts: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """Measures per day, all days of the range."""
    rows = F.sum("source_rows") if "source_rows" in facts.columns else F.count(F.lit(1))
    return facts.groupBy("day").agg(
        *[F.sum(m).alias(m) for m in cfg.measures], rows.cast("bigint").alias("aggregate_row_count")
    )


def kept_days(totals: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """The last ``lookback_days`` days that have data (not calendar days)."""
    return totals.orderBy(F.desc("day")).limit(cfg.lookback_days)


def window_frame(totals: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """One row with the kept days and, per window, its day bounds and totals.

    The arrays hold at most ``lookback_days`` entries, so the row can travel as a scalar subquery. Fewer than two days
    stop the query that reads it: without a baseline there is nothing to compare.
    """
    entry = F.struct(F.col("day").alias("day"), F.coalesce(F.col(cfg.count_field), F.lit(0.0)).alias("total"))
    one = kept_days(totals, cfg).agg(F.sort_array(F.collect_list(entry), asc=False).alias("days"))
    days = F.col("days")
    size = F.size(days)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, e: acc + e["total"])

    def window(n: int) -> Column:
        observed = F.slice(days, 1, n)
        base = F.when(size > n, F.slice(days, n + 1, cfg.lookback_days)).otherwise(F.slice(days, 1, 0))
        return F.struct(
            F.get(observed, F.size(observed) - 1)["day"].alias("observation_start"),
            F.get(days, F.lit(0))["day"].alias("observation_end"),
            F.get(base, F.size(base) - 1)["day"].alias("baseline_start"),
            F.get(base, F.lit(0))["day"].alias("baseline_end"),
            F.size(observed).alias("observation_days"),
            F.size(base).alias("baseline_days"),
            total(observed).alias("observation_total"),
            total(base).alias("baseline_total"),
        )

    enough = F.assert_true(size >= TWO_DAYS, F.format_string(
        "at least %d days with data are needed in the range, found %d", F.lit(TWO_DAYS), size))
    return one.where(enough.isNull()).select(
        F.struct(
            F.get(days, size - 1)["day"].alias("first_day"),
            F.get(days, F.lit(0))["day"].alias("last_day"),
            size.alias("day_count"),
            F.array(*[window(w.observation_days) for w in cfg.windows]).alias("windows"),
        ).alias("frame")
    )


def window_table(totals: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """Windows as rows: bounds, totals and person-level approval of the observed days."""
    kept = kept_days(totals, cfg)
    meta = F.array(
        *[
            F.struct(
                F.lit(w.key).alias("window_key"), F.lit(w.label).alias("label"),
                F.lit(w.purpose).alias("purpose"), F.lit(w.color).alias("color"), F.lit(i).alias("ord"),
            )
            for i, w in enumerate(cfg.windows)
        ]
    )
    frame = window_frame(totals, cfg).select("frame", F.explode(meta).alias("m"))
    spec = frame.select("m.*", F.get(F.col("frame.windows"), F.col("m.ord")).alias("w")).select(
        "window_key", "label", "purpose", "color", "ord", "w.*"
    )
    inside = (F.col("day") >= F.col("observation_start")) & (F.col("day") <= F.col("observation_end"))
    # Both sides are bounded: at most one row per configured window and per kept day.
    joined = spec.join(F.broadcast(kept), inside, "left")
    keys = [c for c in spec.columns]
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum(cfg.person_field), F.lit(0.0)).alias(cfg.person_field),
        F.coalesce(F.sum(cfg.person_approval_field), F.lit(0.0)).alias(cfg.person_approval_field),
    ).withColumn(
        "cid_approval_rate_pct",
        F.when(F.col(cfg.person_field) != 0, F.col(cfg.person_approval_field) / F.col(cfg.person_field) * 100)
        .otherwise(F.lit(0.0)),
    )


def fact_overview(raw: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """One row: first and last day of a fact table, its rows, and the totals of the counts and approvals."""
    day = F.to_date(cfg.date_field)
    return raw.agg(
        F.min(day).alias("min_day"), F.max(day).alias("max_day"), F.count(F.lit(1)).alias("aggregate_rows"),
        *[F.sum(m).alias(m) for m in (cfg.count_field, *cfg.approval_fields)])


def last_days(raw: DataFrame, cfg: AttributionConfig, n: int = 31) -> DataFrame:
    """Totals of the newest days that have data."""
    daily = raw.groupBy(F.to_date(cfg.date_field).alias("day")).agg(F.sum(cfg.count_field).alias(cfg.count_field))
    return daily.orderBy(F.desc("day")).limit(n)


@dataclass
class Base:
    """What every step of a run shares."""

    cfg: AttributionConfig
    facts: DataFrame
    totals: DataFrame
    frame: DataFrame

    @classmethod
    def of(cls, raw: DataFrame, cfg: AttributionConfig, pt: str | None = None, offset: int = 0) -> "Base":
        facts = facts_in_range(raw, cfg, pt, offset)
        totals = daily_totals(facts, cfg)
        return cls(cfg, facts, totals, window_frame(totals, cfg))

    def materialised(self) -> "Base":
        """Collapse to (combination, day) once and store it with the day totals; the depths of a drilldown then
        read the small tables."""
        facts = cut_lineage(collapse(self.facts, self.cfg))
        totals = cut_lineage(daily_totals(facts, self.cfg))
        return Base(self.cfg, facts, totals, window_frame(totals, self.cfg))

    def with_frame(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_frame", self.frame.scalar())
