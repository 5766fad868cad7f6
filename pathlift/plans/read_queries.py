"""Seven fixed read queries over published results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pathlift.functions.scalars import partition_day
from pathlift.operators.panel import approval_ratios, trend_figures
from pathlift.plans.publish import long_form
from pathlift.sources.store import RunStore

ALLOWED_DAYS = (7, 15, 30, 60)
RECORD_ID = re.compile("[0-9a-f]{12}")
# Names of the statuses; users may type a name or its number.
STATUS_LABELS = {0: "不需要处理", 1: "已上策略", 2: "持续观察"}
STATUS_WORDS = {word: n for n, label in STATUS_LABELS.items() for word in (str(n), label)}


def latest_partition(store: RunStore, offset: int = 0) -> DataFrame:
    return store.latest_partition(offset)


def chosen_pt(store: RunStore, pt: str | None, offset: int = 0) -> str:
    """The partition asked for, or the newest published one."""
    found = pt or store.newest_pt(offset)
    if not found:
        raise ValueError("nothing was published yet")
    return found


def dashboard_summary(store: RunStore, pt: str | None = None, offset: int = 0) -> DataFrame:
    """Overview figures of a partition, of the newest published one by default."""
    rows = store.snapshot("summary", chosen_pt(store, pt, offset), offset)
    return approval_ratios(rows, "approval_count", "total_application_count", "approval_cid_cnt", "cid_cnt")


def keyword_filter(keyword: str) -> Column:
    """Case-insensitive substring over the searchable fields of a rule; empty matches all."""
    needle = keyword.strip().lower()
    text = F.lower(F.concat_ws(" ", "id", "canonical_path", "path", "level_label"))
    return F.lit(True) if not needle else text.contains(needle)


def level_filter(level: str) -> Column:
    needle = level.strip().lower()
    if not needle:
        return F.lit(True)
    number = F.col("level").cast("string")
    return (number == needle) | (F.concat(F.lit("level"), number) == needle) | (F.lower("level_label") == needle)


def status_filter(status: str) -> Column:
    word = status.strip()
    if not word:
        return F.lit(True)
    if word in STATUS_WORDS:
        return F.col("status") == STATUS_WORDS[word]
    return F.lower(F.col("status").cast("string")) == word.lower()


def with_status(alerts: DataFrame, statuses: DataFrame | None) -> DataFrame:
    if statuses is None:
        return alerts.withColumn("status", F.lit(0))
    s = statuses.select("canonical_path", F.col("status").alias("_s"))
    return alerts.join(s, "canonical_path", "left").withColumn("status", F.coalesce("_s", F.lit(0))).drop("_s")


def find_rules(
    store: RunStore, pt: str | None = None, keyword: str = "", level: str = "", status: str = "",
    statuses: DataFrame | None = None,
) -> DataFrame:
    rows = with_status(store.snapshot("alerts", chosen_pt(store, pt)), statuses)
    return rows.where(keyword_filter(keyword) & level_filter(level) & status_filter(status))


def filter_rules(
    rules: DataFrame, status: int | None = None, level: int | None = None, source: str | None = None,
    anomaly: str | None = None, window: str | None = None, layer: str | None = None,
) -> DataFrame:
    """Table filters; None leaves a column open."""
    wanted = {"status": status, "level": level, "source": source, "anomaly_type": anomaly,
              "primary_window": window, "layer": layer}
    for name, value in wanted.items():
        if value is not None:
            rules = rules.where(F.col(name) == value)
    return rules


def rule_matches(text: str) -> Column:
    needle = text.strip().lower()
    return (F.lower("id") == needle) | (F.lower("canonical_path") == needle) | (F.lower("path") == needle)


def rule_detail(store: RunStore, pt: str | None, id_or_path: str) -> DataFrame:
    """First rule by id, canonical or display path, in report order."""
    rows = store.snapshot("alerts", chosen_pt(store, pt))
    return rows.where(rule_matches(id_or_path)).orderBy("sort_rank").limit(1)


def path_trend(store: RunStore, pt: str | None, record_id: str, days: int = 60) -> DataFrame:
    """Daily figures of one record: one pointer, one file of the clustered panel, which also holds the tracking start."""
    if days not in ALLOWED_DAYS:
        raise ValueError(f"days must be one of {ALLOWED_DAYS}")
    record_id = record_id.strip()
    if not RECORD_ID.fullmatch(record_id):
        raise ValueError("a record id has twelve hexadecimal digits")
    panel = store.lookup("path_daily", record_id, chosen_pt(store, pt))
    seen = panel.where("tracking_start is null or date >= tracking_start")
    rows = trend_figures(seen.orderBy(F.desc("date")).limit(days))
    return approval_ratios(rows, "approval_count", "application_count", "approval_cid_cnt", "cid_cnt")


def tracked_rule_followup(store: RunStore, path: str, start_pt: str, end_pt: str | None = None) -> DataFrame:
    """One row per calendar day of the range: was the day published, did the rule appear, with which figures.

    The range ends with the newest published partition by default. Only the days' published attempts are read.
    """
    end_pt = chosen_pt(store, end_pt)
    if start_pt > end_pt:
        raise ValueError("start_pt must not be after end_pt")
    one = store.spark.range(1)
    days = one.select(
        F.explode(F.sequence(partition_day(F.lit(start_pt)), partition_day(F.lit(end_pt)))).alias("d")
    ).select(F.date_format("d", "yyyyMMdd").alias("pt"))
    index = store.pointers().where("offset_days = 0").select("pt", "run_id")
    hits = store.snapshots("alerts", start_pt, end_pt).where(rule_matches(path)).select(
        "run_id", "id", "canonical_path", "level", "observation_count", "growth_factor", "z_score",
        "is_tracked_only",
    )
    return days.join(index, "pt", "left").join(hits, "run_id", "left").select(
        "pt", F.col("run_id").isNotNull().alias("available"), F.col("id").isNotNull().alias("matched"),
        "id", "canonical_path", "level", "observation_count", "growth_factor", "z_score", "is_tracked_only",
    )


def compare_partitions(store: RunStore, pt_a: str, pt_b: str) -> DataFrame:
    """Numeric summary fields of two partitions side by side with their difference."""
    a = long_form(dashboard_summary(store, pt_a)).withColumnRenamed("value", "value_a")
    b = long_form(dashboard_summary(store, pt_b)).withColumnRenamed("value", "value_b")
    return a.join(b, "field", "inner").where("value_a is not null and value_b is not null").withColumn(
        "delta", F.bround(F.col("value_b") - F.col("value_a"), 12)
    )


def digest(alerts: DataFrame, summary: DataFrame) -> DataFrame:
    """Daily digest figures: level counts, tracked hits and misses, focus path, share of level 2 and above."""
    tracked = F.col("status").isin(1, 2)
    missed = F.coalesce(F.col("is_tracked_only"), F.lit(False))
    per = alerts.agg(
        F.count_if(tracked & ~missed).alias("tracked_hits"),
        F.count_if(tracked & missed).alias("tracked_misses"),
        F.expr("max_by(path, struct(level, z_score, -sort_rank))").alias("focus_path"),
        F.expr("max_by(path, struct(z_score, -sort_rank)) filter (where level >= 3)").alias("level3_focus_path"),
    )
    return summary.select(
        "merged_alert_count", "level1_count", "level2_count", "level3_count", "latest_day_change_pct",
        per.select(F.struct("*")).scalar().alias("_p"),
    ).selectExpr(
        "merged_alert_count", "level1_count", "level2_count", "level3_count", "latest_day_change_pct",
        "_p.tracked_hits", "_p.tracked_misses", "_p.focus_path", "_p.level3_focus_path",
        "(level2_count + level3_count) / greatest(merged_alert_count, 1) * 100 as level2_plus_share_pct",
    )


def digest_rules(alerts: DataFrame) -> DataFrame:
    """The tagged rules of a digest: hits by falling level and path, then misses by path, each with its place.

    A person tags these rules one by one, and a digest is read by people; numbering them needs one ordered list.
    """
    miss = F.coalesce(F.col("is_tracked_only"), F.lit(False))
    labels = F.create_map(*[F.lit(x) for n, label in STATUS_LABELS.items() for x in (n, label)])
    rows = alerts.where(F.col("status").isin(1, 2)).select(
        F.when(miss, F.lit("miss")).otherwise(F.lit("hit")).alias("kind"),
        F.coalesce("path", "canonical_path").alias("path"), "level", "level_label", "status",
        F.try_element_at(labels, F.col("status")).alias("status_label"), "tracking_start", "hit_windows", "canonical_path",
    )
    w = W.partitionBy("kind").orderBy(F.when(F.col("kind") == "hit", -F.col("level")), "path", "canonical_path")
    return rows.withColumn("place", F.row_number().over(w) - 1).drop("canonical_path")


def alerts_with_seeds(alerts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Alerts and level-0 seeds in one list; the alert wins where both exist."""
    columns = [c for c in alerts.columns if c in seeds.columns]
    extra = seeds.select(*columns).where("level = 0").dropDuplicates(["canonical_path"])
    return alerts.select(*columns).unionByName(
        extra.join(alerts.select("canonical_path"), "canonical_path", "left_anti").select(*columns)
    )
