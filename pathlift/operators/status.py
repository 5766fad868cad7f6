"""Manual rule status: current state, intervals, overlays and tracked rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pathlift.config import AttributionConfig
from pathlift.operators.daily import Base
from pathlift.operators.metrics import as_records, window_sums, with_amounts, with_windows
from pathlift.operators.panel import path_sums

OPEN = (1, 2)


def status_changes(log: DataFrame) -> DataFrame:
    """Log entries that change a path's status, with the entry that follows.

    A path's log is split by day, so a path with very many updates is worked on by many tasks. What crosses a day
    (last status before, next change after) is carried by a table with one row per path and day.
    """
    bucketed = log.withColumn("_day", F.to_date("updated_at"))
    key = F.struct("updated_at", "id")
    inside = W.partitionBy("canonical_path", "_day").orderBy("updated_at", "id")
    over_days = W.partitionBy("canonical_path").orderBy("_day")

    lasts = (
        bucketed.groupBy("canonical_path", "_day").agg(F.max_by("status", key).alias("_last"))
        .select("canonical_path", "_day", F.lag("_last").over(over_days).alias("_before"))
    )
    changes = (
        bucketed.withColumn("_prev_in", F.lag("status").over(inside))
        .join(lasts, ["canonical_path", "_day"])
        .withColumn("_prev", F.coalesce("_prev_in", "_before"))
        .where("_prev is null or _prev <> status")
    )
    entry = F.struct("updated_at", "action_date", "updated_by")
    firsts = (
        changes.groupBy("canonical_path", "_day").agg(F.min_by(entry, key).alias("_first"))
        .select("canonical_path", "_day", F.lead("_first").over(over_days).alias("_after"))
    )
    return (
        changes.withColumn("_next_in", F.lead(entry).over(inside))
        .join(firsts, ["canonical_path", "_day"])
        .withColumn("_next", F.coalesce("_next_in", "_after"))
        .drop("_prev_in", "_before", "_next_in", "_after", "_day")
    )


def status_intervals(log: DataFrame) -> DataFrame:
    """Intervals of status 1 and 2; repeating a status keeps the first entry, any other status closes."""
    return status_changes(log).where(F.col("status").isin(*OPEN)).select(
        "id",
        "canonical_path",
        "status",
        F.col("updated_at").alias("entered_at"),
        F.col("action_date").alias("entered_pt"),
        F.col("updated_by").alias("entered_by"),
        F.col("_next.updated_at").alias("exited_at"),
        F.col("_next.action_date").alias("exited_pt"),
        F.col("_next.updated_by").alias("exited_by"),
        F.col("_next").isNull().alias("is_active"),
    )


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per path; the action date is that of the entry that opened it, NULL for status 0."""
    key = F.struct("updated_at", "id")
    latest = log.groupBy("canonical_path").agg(
        F.max_by(F.struct("status", "updated_by", "updated_at"), key).alias("_c")
    )
    opened = status_changes(log).groupBy("canonical_path").agg(F.max_by("action_date", key).alias("_opened"))
    return latest.join(opened, "canonical_path").select(
        "canonical_path",
        "_c.status",
        "_c.updated_by",
        "_c.updated_at",
        F.when(F.col("_c.status").isin(*OPEN), F.col("_opened")).alias("action_date"),
    )


def active_rules(current: DataFrame, intervals: DataFrame) -> DataFrame:
    """Paths in status 1 or 2 with the start of their open interval; rows older than the history fall back to
    their action date."""
    latest = (
        intervals.where("is_active")
        .groupBy("canonical_path")
        .agg(F.max_by("entered_pt", F.struct("entered_at", "id")).alias("_entered"))
    )
    return (
        current.where(F.col("status").isin(*OPEN))
        .join(latest, "canonical_path", "left")
        .withColumn("entered_pt", F.coalesce("_entered", "action_date"))
        .drop("_entered")
    )


def tagged_rules(current: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every path that was ever in status 1 or 2: the current state first, else its newest interval."""
    now = current.where(F.col("status").isin(*OPEN)).select("canonical_path", "status", F.lit("current").alias("seen_in"))
    past = (
        intervals.groupBy("canonical_path")
        .agg(F.max_by("status", F.struct("entered_at", "id")).alias("status"))
        .select("canonical_path", "status", F.lit("history").alias("seen_in"))
    )
    return now.unionByName(past.join(now, "canonical_path", "left_anti"))


def overlay_status(records: DataFrame, current: DataFrame, active: DataFrame) -> DataFrame:
    """Put the manual status next to every record, 0 where nobody set one."""
    s = current.select(
        "canonical_path", F.col("status").alias("_status"), F.col("updated_at").alias("status_updated_at"),
        F.col("updated_by").alias("status_updated_by"), "action_date",
    )
    a = active.select("canonical_path", F.col("entered_pt").alias("tracking_start_pt"))
    return (
        records.join(s, "canonical_path", "left")
        .join(a, "canonical_path", "left")
        .withColumn("status", F.coalesce("_status", F.lit(0)))
        .drop("_status")
    )


#: What a rule keeps of the alert it was made from.
DEFINITION = ("source", "is_expert_forced", "rule_note", "drilldown_rule", "enters_next_level", "path", "conditions")


def definition_history(alerts: DataFrame, pt_col: str = "pt") -> DataFrame:
    """Definitions of all paths over time: one row whenever a path's definition changes, valid from that partition on.

    ``alerts``: canonical_path, the columns of DEFINITION and the partition each alert was published for. A path has
    at most one row per partition, which bounds the ordered window.
    """
    own = F.struct(*DEFINITION)
    w = W.partitionBy("canonical_path").orderBy(pt_col)
    rows = alerts.select("canonical_path", F.col(pt_col), own.alias("_own"), F.to_json(own).alias("_text"))
    rows = rows.withColumn("_before", F.lag("_text").over(w)).where("_before is null or _before <> _text")
    return rows.select("canonical_path", F.col(pt_col).alias("valid_from"), "_own.*")


def with_definitions(rules: DataFrame, history: DataFrame) -> DataFrame:
    """Each rule with the definition that was valid when it was tagged; the first later one if there was none yet.

    ``valid_from`` is a partition id of the form of the day. A path without any definition gets NULL.
    """
    own = F.struct(*DEFINITION)
    entered = F.date_format("entered_day", "yyyyMMdd")
    joined = rules.select("canonical_path", "entered_day").join(history, "canonical_path")
    before = F.col("valid_from") <= entered
    chosen = joined.groupBy("canonical_path", "entered_day").agg(
        F.max_by(F.when(before, own), F.when(before, F.col("valid_from"))).alias("_asof"),
        F.min_by(own, F.col("valid_from")).alias("_first"))
    chosen = chosen.select(
        F.col("canonical_path").alias("_path"), F.col("entered_day").alias("_day"), F.coalesce("_asof", "_first").alias("_own"))
    same = (F.col("canonical_path") == F.col("_path")) & F.col("entered_day").eqNullSafe(F.col("_day"))
    plain = rules.drop(*[c for c in DEFINITION if c in rules.columns])
    return plain.join(chosen, same, "left").select(*plain.columns, *[F.col(f"_own.{c}").alias(c) for c in DEFINITION])


def tracked_records(base: Base, rules: DataFrame) -> DataFrame:
    """Rebuild tracked rules from the day they were tagged, measured against the full totals.

    ``rules``: canonical_path, entered_day, dimension columns, and optionally the columns of DEFINITION, which the
    records then keep (source, forced flag, note, order of the conditions). A rule without data still gets a record
    of zeros.
    """
    cfg, dims = base.cfg, base.cfg.dimensions
    rows = with_amounts(base.facts, base)
    amounts = [c for c in rows.columns if c not in base.facts.columns]
    wanted = rules.select(F.col("canonical_path").alias("_rule"), "entered_day", *dims)
    rows = path_sums(rows, wanted, amounts, cfg)
    later = rows.where("entered_day is null or day >= entered_day")
    sums = later.groupBy("_rule").agg(*window_sums(base))
    figures = [c for c in sums.columns if c != "_rule"]
    filled = rules.join(sums, rules["canonical_path"] == sums["_rule"], "left").select(
        *dims, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in figures]
    )
    records = as_records(with_windows(filled, base), cfg, source="已跟踪规则")
    known = [c for c in DEFINITION if c in rules.columns]
    starts = rules.select(
        F.col("canonical_path").alias("_rule"), F.col("entered_day").alias("tracking_start"),
        *[F.col(c).alias(f"_d_{c}") for c in known])
    kept = records.join(starts, F.col("canonical_path") == F.col("_rule"), "left")
    return kept.select(
        *[F.coalesce(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in known else F.col(c) for c in records.columns], "tracking_start")


def apply_tracked(merged: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracked rules replace the alert of the same path; the others are added and flagged.

    Matched before the output cut, so a tracked rule far down the ranking still counts as hit.
    """
    plain = merged.join(tracked.select("canonical_path"), "canonical_path", "left_anti").withColumns(
        {"tracking_start": F.lit(None).cast("date"), "is_tracked_only": F.lit(False)}
    )
    hit = merged.select("canonical_path", F.lit(True).alias("_hit"))
    kept = tracked.join(hit, "canonical_path", "left").withColumn(
        "is_tracked_only", F.col("_hit").isNull()
    ).drop("_hit")
    return plain.unionByName(kept)
