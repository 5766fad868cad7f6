"""Dashboard of one partition: summary, trend, windows, alert lists and the nested document."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pathlift.config import AttributionConfig
from pathlift.functions.paths import matches
from pathlift.functions.scalars import normalize_value
from pathlift.operators.daily import Base, kept_days, window_range, window_table
from pathlift.operators.drill import (
    Drilldown, ExpertChain, expert_chain, highlight, merge_alerts, merge_suppressed, ranked, topk_drilldown,
)
from pathlift.session import cut_lineage


#: Settings that the document repeats, and their form in it.
RULES = {
    "thresholds": "array<struct<level:int,min_observation_count:double,min_growth_factor:double,"
                  "min_structure_lift_factor:double,min_z_score:double,label:string>>",
    "suppression_rules": "array<struct<field:string,value:string,reason:string>>",
    "expert_path": "array<struct<field:string,value:string,label:string>>",
    "field_labels": "map<string,string>",
}


@dataclass
class Dashboard:
    cfg: AttributionConfig
    pt: str | None
    offset: int
    base: Base
    ranges: DataFrame
    topk: Drilldown
    expert: ExpertChain | None
    merged: DataFrame
    suppressed: DataFrame

    @property
    def highlight(self) -> DataFrame:
        return highlight(self.merged, self.expert)

    @property
    def alerts(self) -> DataFrame:
        """Ranked alerts up to the output limit."""
        return ranked(self.merged, self.cfg.output_limit)

    @property
    def suppressed_alerts(self) -> DataFrame:
        return ranked(self.suppressed, self.cfg.output_limit)

    @property
    def windows(self) -> DataFrame:
        return window_table(self.base.totals, self.cfg)

    def daily_trend(self) -> DataFrame:
        """Kept days with totals, the expert seed's count and the highlighted path's count."""
        cfg, dims = self.cfg, self.cfg.dimensions
        days = kept_days(self.base.totals, cfg)
        facts = self.base.facts
        seed = F.lit(0.0)
        if cfg.expert_path:
            first = cfg.expert_path[0]
            seed = F.when(F.col(first.field) == normalize_value(F.lit(first.value)), F.col(cfg.count_field)).otherwise(F.lit(0.0))
        focus = self.highlight.selectExpr("named_struct(" + ", ".join(f"'{d}', {d}" for d in dims) + ") as p")
        rows = facts.withColumn("_focus", focus.scalar())
        on_focus = F.col("_focus").isNotNull() & matches(dims, path="_focus.")
        counts = rows.groupBy("day").agg(
            F.sum(seed).alias("expert_seed_count"),
            F.sum(F.when(on_focus, F.col(cfg.count_field)).otherwise(F.lit(0.0))).alias("focus_path_count"),
        )
        return days.join(counts, "day", "left").select(
            F.col("day").alias("date"),
            F.col(cfg.count_field).alias("application_count"),
            F.col(cfg.approval_fields[0]).alias("approval_count"),
            F.col(cfg.person_field).alias("cid_cnt"),
            F.col(cfg.person_approval_field).alias("approval_cid_cnt"),
            F.coalesce("expert_seed_count", F.lit(0.0)).alias("expert_seed_count"),
            F.coalesce("focus_path_count", F.lit(0.0)).alias("focus_path_count"),
        )

    def summary(self) -> DataFrame:
        """One row with the overview figures."""
        return summary(self.base, self.merged, self.suppressed, self.expert, self.highlight)

    def meta(self) -> DataFrame:
        cfg = self.cfg
        days = kept_days(self.base.totals, cfg).agg(
            F.min("day").alias("date_start"), F.max("day").alias("date_end"),
            F.count(F.lit(1)).alias("date_count"), F.sum("aggregate_row_count").alias("aggregate_row_count"),
        )
        bounds = self.ranges.select(F.struct("table_date_min", "table_date_max").alias("b"))
        return days.withColumn("_b", bounds.scalar()).select(
            F.lit(cfg.table).alias("table"), F.lit(self.pt).alias("partition"), F.lit(cfg.version).alias("version"),
            "date_start", "date_end", "date_count", "aggregate_row_count",
            F.lit(len(cfg.dimensions)).alias("dimension_count"), "_b.*",
        )

    def rules(self) -> DataFrame:
        """One row: the settings a reader needs to understand the figures, with the bounds of the windows."""
        settings = {k: v for k, v in self.cfg.to_dict().items() if k in RULES}
        text = json.dumps(settings, ensure_ascii=False, default=str)
        schema = ", ".join(f"{name} {kind}" for name, kind in RULES.items())
        return self.windows.agg(_rows(self.windows, "ord", self.cfg).alias("windows")).select(
            "windows", F.from_json(F.lit(text), schema).alias("r")).select("windows", "r.*")

    def document(self) -> DataFrame:
        """One row, one JSON text. Every list in it is cut to the output limit before it is collected; the totals
        beside the lists count what there was before the cut."""
        limit, topk, expert = self.cfg.output_limit, self.topk, self.expert

        def listed(df: DataFrame, order: str = "sort_rank") -> DataFrame:
            return df.agg(_rows(df, order, self.cfg).alias("rows"))

        def one(df: DataFrame) -> DataFrame:
            return df.select(F.struct(*[c for c in df.columns if c not in self.cfg.dimensions]).alias("row"))

        def total(df: DataFrame) -> DataFrame:
            return df.agg(F.count(F.lit(1)).alias("n"))

        def found(df: DataFrame) -> DataFrame:
            return df.where("not is_suppressed and level > 0")

        parts = {
            "summary": one(self.summary()),
            "daily_trend": listed(self.daily_trend(), "date"),
            "windows": listed(self.windows, "ord"),
            "highlight": one(self.highlight),
            "merged_alerts": listed(self.alerts),
            "merged_alert_total": total(self.merged),
            "suppressed_alerts": listed(self.suppressed_alerts),
            "suppressed_alert_total": total(self.suppressed),
            "counts": one(topk.counts),
            "rules": one(self.rules()),
        }
        nested = {"top_k": {
            "single_downstream": listed(ranked(topk.single_seeds, self.cfg.single_limit)),
            "pair_downstream": listed(ranked(topk.pair_seeds, self.cfg.pair_limit)),
            "third_alerts": listed(ranked(found(topk.third), limit)),
            "third_alert_total": total(found(topk.third)),
            "counts": one(topk.counts),
        }}
        if expert is not None:
            calculated = expert.third.where("not is_suppressed")
            nested["expert"] = {
                "single": one(expert.single), "pair": one(expert.pair),
                "third_alerts": listed(ranked(found(expert.third), limit)),
                "third_calculated": listed(ranked(calculated, limit)),
                "third_calculated_total": total(expert.third), "alert_total": total(expert.alerts),
            }
        columns = [p.scalar().alias(n) for n, p in parts.items()]
        columns += [F.struct(*[p.scalar().alias(n) for n, p in group.items()]).alias(name) for name, group in nested.items()]
        row = self.meta().select(F.struct("*").alias("meta"), *columns)
        return row.select(F.to_json(F.struct("*")).alias("payload"))


def _rows(df: DataFrame, order: str, cfg: AttributionConfig) -> Column:
    """All rows of a short table as an ordered array of structs, without the dimension columns."""
    entry = F.struct(order, F.struct(*[c for c in df.columns if c not in cfg.dimensions]).alias("r"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"])


def summary(
    base: Base, merged: DataFrame, suppressed: DataFrame, expert: ExpertChain | None, head: DataFrame
) -> DataFrame:
    cfg = base.cfg
    a0, a1 = cfg.approval_fields[0], cfg.approval_fields[-1]
    entry = F.struct("day", F.col(cfg.count_field).alias("n"), F.col(a0).alias("a"),
                     F.col(cfg.person_field).alias("c"), F.col(cfg.person_approval_field).alias("ca"))
    daily = kept_days(base.totals, cfg).agg(
        F.sum(cfg.count_field).alias("total_application_count"),
        F.sum(a0).alias("approval_count"),
        F.sum(cfg.person_field).alias("cid_cnt"),
        F.sum(cfg.person_approval_field).alias("approval_cid_cnt"),
        F.sum(a1).alias("approval_jy0_count"),
        F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, 2).alias("_d"),
    )
    levels = merged.agg(
        F.count(F.lit(1)).alias("merged_alert_count"),
        *[F.count_if(F.col("level") == n).alias(f"level{n}_count") for n in (3, 2, 1)],
    )
    n_expert = expert.alerts.agg(F.count(F.lit(1))).scalar() if expert is not None else F.lit(0).cast("bigint")
    row = daily.select(
        "*",
        levels.select(F.struct("*")).scalar().alias("_l"),
        n_expert.alias("expert_alert_count"),
        suppressed.agg(F.count(F.lit(1))).scalar().alias("suppressed_alert_count"),
        head.select("path").scalar().alias("highlight_path"),
    )
    return row.selectExpr(
        "total_application_count",
        "_d[0].n as latest_application_count",
        "get(_d, 1).n as previous_application_count",
        "if(get(_d, 1).n <> 0, bround((_d[0].n / get(_d, 1).n - 1) * 100, 4), 0D) as latest_day_change_pct",
        "if(_d[0].n <> 0, bround(_d[0].a / _d[0].n * 100, 4), 0D) as latest_approval_rate",
        "if(_d[0].c <> 0, bround(_d[0].ca / _d[0].c * 100, 4), 0D) as latest_cid_approval_rate_pct",
        "approval_count", "cid_cnt", "approval_cid_cnt", "approval_jy0_count",
        "_l.merged_alert_count", "_l.level3_count", "_l.level2_count", "_l.level1_count",
        "expert_alert_count", "suppressed_alert_count", "highlight_path",
    )


def build(
    raw: DataFrame, cfg: AttributionConfig, pt: str | None = None, offset: int = 0, store_steps: bool = True
) -> Dashboard:
    """Run both searches over one partition. With ``store_steps`` shared intermediate tables are written once."""
    base = Base.of(raw, cfg, pt, offset)
    if store_steps:
        base = base.materialised()
    topk = topk_drilldown(base, store_steps)
    expert = expert_chain(base, store_steps)
    merged = merge_alerts(topk.alerts, expert.alerts if expert else None)
    suppressed = merge_suppressed(topk.suppressed, expert.suppressed if expert else None)
    if store_steps:
        merged = cut_lineage(merged)
    return Dashboard(cfg, pt, offset, base, window_range(raw, cfg, pt, offset), topk, expert, merged, suppressed)
