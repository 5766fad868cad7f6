"""Path x day panel, approval enrichment and path trend."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window as W, functions as F

from pathlift.config import AttributionConfig
from pathlift.functions.paths import path_depth
from pathlift.functions.scalars import ratio_or_null
from pathlift.operators.daily import daily_totals


def field_sets(paths: DataFrame, cfg: AttributionConfig) -> list[tuple[str, ...]]:
    """The sets of fields that paths have conditions on: at most the subsets of the dimensions up to the paths' depth."""
    used = paths.select(F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in cfg.dimensions])).alias("s"))
    return sorted(tuple(r.s) for r in used.distinct().collect())


def path_sums(facts: DataFrame, paths: DataFrame, measures: list[str], cfg: AttributionConfig) -> DataFrame:
    """Sums per path and day, with all columns of ``paths``; no row for a day on which a path has no facts.

    Facts are summed once to (fields, day) for every set of fields that paths use, as grouping sets whose partial sums
    combine before the exchange. Each sum then stands for exactly one path: one equality on all dimensions, null
    where a field is open, finds it. No fact row meets a path, and no value becomes a hot key.
    """
    dims = list(cfg.dimensions)
    sets = [["day", *s] for s in field_sets(paths, cfg)] or [["day"]]
    sums = facts.groupingSets([[F.col(c) for c in s] for s in sets], "day", *dims).agg(
        *[F.sum(m).alias(m) for m in measures])
    wanted = paths.withColumnsRenamed({d: f"_s_{d}" for d in dims})
    same = functools.reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"_s_{d}")) for d in dims])
    return sums.join(wanted, same).drop(*[f"_s_{d}" for d in dims])


def day_list(totals: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """One row: ascending array of (day, total). Bounded by the trend range."""
    entry = F.struct(F.col("day").alias("date"), F.col(cfg.count_field).alias("total_application_count"))
    return totals.agg(F.array_sort(F.collect_list(entry)).alias("days"))


def path_daily(facts: DataFrame, paths: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """Every path on every day that has data, zeros where the path has none; ``paths`` holds each id once."""
    measures = [cfg.count_field, cfg.approval_fields[0], cfg.person_field, cfg.person_approval_field]
    names = ["application_count", "approval_count", "cid_cnt", "approval_cid_cnt"]
    sums = path_sums(facts, paths.select("id", *cfg.dimensions), measures, cfg).select(
        "id", "day", *[F.col(m).alias(n) for m, n in zip(measures, names)])
    days = day_list(daily_totals(facts, cfg), cfg)
    grid = paths.select("id").distinct().select("id", F.explode(days.scalar()).alias("d")).select("id", "d.*")
    filled = grid.join(sums.withColumnRenamed("day", "date"), ["id", "date"], "left")
    zero = F.lit(0.0)
    return filled.select(
        F.col("id").alias("alert_id"),
        "date",
        F.coalesce("application_count", zero).alias("application_count"),
        F.coalesce("total_application_count", zero).alias("total_application_count"),
        F.coalesce("approval_count", zero).alias("approval_count"),
        F.coalesce("cid_cnt", zero).alias("cid_cnt"),
        F.coalesce("approval_cid_cnt", zero).alias("approval_cid_cnt"),
    )


def exact_daily(facts: DataFrame, path: dict[str, str], cfg: AttributionConfig) -> DataFrame:
    """Daily measures of one exact path."""
    from pathlift.functions.scalars import normalize_value

    rows = facts
    for name, value in path.items():
        if name not in cfg.dimensions:
            raise ValueError(f"unsupported field name: {name}")
        rows = rows.where(F.col(name) == normalize_value(F.lit(value)))
    return rows.groupBy("day").agg(
        F.sum(cfg.count_field).alias("application_count"),
        F.sum(cfg.approval_fields[0]).alias("approval_count"),
        F.sum(cfg.person_field).alias("cid_cnt"),
        F.sum(cfg.person_approval_field).alias("approval_cid_cnt"),
    )


def window_approvals(records: DataFrame, panel: DataFrame) -> DataFrame:
    """Approvals of every record in every window's observed days; rates are NULL on a zero denominator."""
    spec = records.select(F.col("id").alias("alert_id"), "primary_window", F.explode("windows").alias("w")).select(
        "alert_id", "primary_window", "w.window_key", "w.observation_start", "w.observation_end",
        "w.observation_count",
    )
    inside = (F.col("p.date") >= F.col("s.observation_start")) & (F.col("p.date") <= F.col("s.observation_end"))
    joined = spec.alias("s").join(panel.alias("p"), (F.col("s.alert_id") == F.col("p.alert_id")) & inside, "left")
    sums = joined.groupBy(
        F.col("s.alert_id").alias("alert_id"), "s.window_key", "s.primary_window", "s.observation_count"
    ).agg(
        F.sum("p.approval_count").alias("approval_count"),
        F.sum("p.cid_cnt").alias("cid_cnt"),
        F.sum("p.approval_cid_cnt").alias("approval_cid_cnt"),
    )
    return sums.select(
        "alert_id",
        "window_key",
        (F.col("window_key") == F.col("primary_window")).alias("is_primary"),
        "approval_count",
        F.when(F.col("observation_count") > 0, F.col("approval_count") / F.col("observation_count") * 100).alias(
            "approval_rate_pct"
        ),
        "cid_cnt",
        "approval_cid_cnt",
        F.when(F.col("cid_cnt") > 0, F.col("approval_cid_cnt") / F.col("cid_cnt") * 100).alias(
            "cid_approval_rate_pct"
        ),
    )


def trend_context(panel: DataFrame, days: int = 60) -> DataFrame:
    """Overall count per day (largest one seen), last ``days`` days."""
    return (
        panel.groupBy("date").agg(F.max("total_application_count").alias("application_count"))
        .where("application_count is not null").orderBy(F.desc("date")).limit(days)
    )


def trend_rows(panel: DataFrame, days: int = 60, starts: DataFrame | None = None) -> DataFrame:
    """Daily rows of every path: shares and rates in percent, 0.0 on a zero denominator.

    ``starts`` (alert_id, tracking_start) cuts a tracked path's history at the day it was tagged.
    """
    rows = panel
    if starts is not None:
        rows = rows.join(starts.select("alert_id", "tracking_start"), "alert_id", "left").where(
            "tracking_start is null or date >= tracking_start"
        )
    w = W.partitionBy("alert_id").orderBy(F.desc("date"))
    return trend_figures(rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= days).drop("_rn"))


def trend_figures(rows: DataFrame) -> DataFrame:
    """Shares and rates of daily rows in percent, 0.0 on a zero denominator."""
    return rows.selectExpr(
        "alert_id", "date", "application_count", "total_application_count",
        "if(total_application_count <> 0, application_count / total_application_count * 100, 0D)"
        " as application_share_pct",
        "approval_count",
        "case when approval_count is null then null when application_count > 0"
        " then approval_count / application_count * 100 else 0D end as approval_rate_pct",
        "cid_cnt", "approval_cid_cnt",
        "case when cid_cnt is null or approval_cid_cnt is null then null when cid_cnt > 0"
        " then approval_cid_cnt / cid_cnt * 100 else 0D end as cid_approval_rate_pct",
    )


def trend_summary(rows: DataFrame) -> DataFrame:
    """Latest, previous, change, peak (first day on a tie) and period sum of every path."""
    entry = "named_struct('date', date, 'n', application_count, 's', application_share_pct, " \
            "'a', approval_rate_pct, 'c', cid_approval_rate_pct)"
    per = rows.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("period_days"),
        F.sum("application_count").alias("period_application_count"),
        F.max("application_count").alias("peak_application_count"),
        F.expr("max_by(date, struct(application_count, -unix_date(date)))").alias("peak_date"),
        F.expr(f"slice(sort_array(collect_list({entry}), false), 1, 2)").alias("_last"),
    )
    return per.selectExpr(
        "alert_id", "period_days", "period_application_count",
        "_last[0].n as latest_application_count",
        "get(_last, 1).n as previous_application_count",
        "if(get(_last, 1).n > 0, (_last[0].n / get(_last, 1).n - 1) * 100, 0D) as latest_day_change_pct",
        "peak_application_count", "peak_date",
        "_last[0].s as latest_application_share_pct",
        "_last[0].a as latest_approval_rate_pct",
        "_last[0].c as latest_cid_approval_rate_pct",
    )


def approval_ratios(df: DataFrame, item_pass: str, items: str, persons_pass: str, persons: str) -> DataFrame:
    """Named approval ratios (fractions) with a warning text per missing or zero input, never an error."""

    def warnings(name: str, num: str, den: str) -> list[str]:
        return [
            f"if({num} is null, '{name}: {num} missing', null)",
            f"if({den} is null, '{name}: {den} missing', null)",
            f"if({den} = 0, '{name}: {den} is 0', null)",
        ]

    notes = warnings("person_approval_ratio", persons_pass, persons) + warnings("item_approval_ratio", item_pass, items)
    return df.withColumns(
        {
            "person_approval_ratio": ratio_or_null(F.col(persons_pass), F.col(persons)),
            "item_approval_ratio": ratio_or_null(F.col(item_pass), F.col(items)),
            "warnings": F.expr(f"array_distinct(array_compact(array({', '.join(notes)})))"),
        }
    )


def with_path_columns(rules: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """Rules with a ``conditions`` array get one column per dimension and their id."""
    from pathlift.functions.paths import from_conditions

    return rules.withColumns(from_conditions("conditions", cfg.dimensions)).withColumn(
        "depth", path_depth(cfg.dimensions)
    )
