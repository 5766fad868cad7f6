"""Window metrics of paths, levels, and the roll-up to one alert record per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathlift.config import LEVEL_COLORS, AttributionConfig
from pathlift.functions.paths import (
    canonical_path, conditions, display_path, layer_name, path_depth, quoted, record_id,
)
from pathlift.functions.scalars import MISSING
from pathlift.operators.daily import Base

# Names of the anomaly types and of the record sources.
SUSTAINED = "持续高位"
SPIKE_BY_WINDOW = {"1d": "单日尖峰", "3d": "短期放量", "7d": "趋势抬升"}
QUIET = "无预警"
SOURCE_TOPK = "Top-K"
SOURCE_EXPERT = "专家规则"


def with_amounts(rows: DataFrame, base: Base) -> DataFrame:
    """Split each row's count into observed and baseline amounts per window, once, before rows are multiplied by
    dimensions or seeds."""
    out: list[str] = []
    count = f"coalesce({base.cfg.count_field}, 0D)"
    for i, _ in enumerate(base.cfg.windows):
        start = f"_frame.windows[{i}].observation_start"
        out.append(f"if(day >= {start} and day <= _frame.last_day, {count}, 0D) as _o{i}")
        out.append(f"if(day >= _frame.first_day and day < {start}, {count}, 0D) as _b{i}")
    return base.with_frame(rows).selectExpr(*rows.columns, *out)


def combined_amounts(base: Base) -> DataFrame:
    """Window amounts per dimension combination: the day is gone, so a combination is one row however long the range."""
    rows = with_amounts(base.facts, base)
    amounts = [c for c in rows.columns if c not in base.facts.columns]
    return rows.groupBy(*base.cfg.dimensions).agg(
        *[F.sum(c).alias(c) for c in amounts], F.max(F.col(base.cfg.count_field) != 0).alias("_any")
    )


def window_sums(base: Base) -> list[Column]:
    """Sums of the amounts; the aggregate runs map-side first, so no value or day becomes a hot task."""
    out: list[Column] = []
    for i, _ in enumerate(base.cfg.windows):
        out.append(F.expr(f"coalesce(sum(_o{i}), 0D) as _obs{i}"))
        out.append(F.expr(f"coalesce(sum(_b{i}), 0D) as _base{i}"))
    return out


def level_sql(obs: str, growth: str, lift: str, z: str, cfg: AttributionConfig) -> str:
    """Highest level whose four minimums all hold, on unrounded figures."""
    rules = " ".join(
        f"when {obs} >= {float(t.min_observation_count)}D and {growth} >= {float(t.min_growth_factor)}D"
        f" and {lift} >= {float(t.min_structure_lift_factor)}D and {z} >= {float(t.min_z_score)}D then {t.level}"
        for t in reversed(cfg.levels_ascending)
    )
    return f"case {rules} else 0 end"


def label_sql(level: str, cfg: AttributionConfig) -> str:
    names = {0: cfg.level_label(0), **{t.level: t.label for t in cfg.thresholds}}
    return f"case {level} " + " ".join(f"when {n} then {quoted(t)}" for n, t in names.items()) + " end"


def color_sql(level: str) -> str:
    return f"case {level} " + " ".join(f"when {n} then '{c}'" for n, c in LEVEL_COLORS.items()) + " end"


def ratio_sql(n: str, d: str) -> str:
    """0 where the denominator is not positive; with that, no figure below can be NaN or infinite."""
    return f"if({d} > 0, {n} / {d}, 0D)"


WINDOW_FIELDS = (
    "window_key", "label", "color", "purpose", "baseline_start", "baseline_end", "observation_start",
    "observation_end", "baseline_days", "observation_days", "baseline_count", "observation_count",
    "baseline_daily", "observation_daily", "baseline_share", "observation_share", "growth_factor",
    "structure_lift_factor", "structure_change", "expected_count", "excess_count", "z_score", "level",
    "level_label", "severity",
)


def with_windows(sums: DataFrame, base: Base) -> DataFrame:
    """One row per path and window: counts, shares, factors, z and level.

    Raw (unrounded) figures decide the level; the output carries the rounded ones. The figures build on each
    other layer by layer, and windows are rows, so the generated code does not grow with their number.
    """
    cfg = base.cfg
    rows = []
    for i, w in enumerate(cfg.windows):
        texts = {"window_key": w.key, "label": w.label, "color": w.color, "purpose": w.purpose}
        fields = [f"'{name}', {quoted(text)}" for name, text in texts.items()]
        rows.append(f"named_struct('ord', {i}, {', '.join(fields)}, 's', _frame.windows[{i}], "
                    f"'o', _obs{i}, 'b', _base{i})")
    keep = [c for c in sums.columns if not c.startswith("_")]
    df = base.with_frame(sums).selectExpr(*keep, f"explode(array({', '.join(rows)})) as w").selectExpr(
        *keep, "w.ord", "w.window_key", "w.label", "w.color", "w.purpose", "w.s.*", "w.o", "w.b"
    )
    layers = [
        ["b / greatest(baseline_days, 1) as bd", "o / greatest(observation_days, 1) as od",
         ratio_sql("b", "baseline_total") + " as bs", ratio_sql("o", "observation_total") + " as os"],
        [ratio_sql("od", "bd") + " as g", ratio_sql("os", "bs") + " as l",
         "if(baseline_total > 0, observation_total * bs, 0D) as e"],
        ["o - e as x"],
        ["if(e > 0, x / sqrt(e), 0D) as z"],
        [level_sql("o", "g", "l", "z", cfg) + " as level"],
    ]
    for layer in layers:
        df = df.selectExpr("*", *layer)
    rounded = {
        "baseline_count": ("b", 4), "observation_count": ("o", 4), "baseline_daily": ("bd", 4),
        "observation_daily": ("od", 4), "baseline_share": ("bs", 8), "observation_share": ("os", 8),
        "growth_factor": ("g", 4), "structure_lift_factor": ("l", 4), "structure_change": ("os - bs", 8),
        "expected_count": ("e", 4), "excess_count": ("x", 4), "z_score": ("z", 4),
    }
    plain = ("ord", "window_key", "label", "color", "purpose", "baseline_start", "baseline_end",
             "observation_start", "observation_end", "baseline_days", "observation_days", "level")
    return df.selectExpr(
        *keep, *plain, *[f"bround({x}, {n}) as {name}" for name, (x, n) in rounded.items()],
        f"{label_sql('level', cfg)} as level_label", f"{color_sql('level')} as severity",
    )


def anomaly_sql() -> str:
    named = " ".join(f"when array_join(hit_windows, ',') = '{k}' then '{n}'" for k, n in SPIKE_BY_WINDOW.items())
    return f"case when size(hit_windows) >= 2 then '{SUSTAINED}' {named} else '{QUIET}' end"


def suppression_sql(cfg: AttributionConfig) -> str:
    """Reasons of every rule whose (field, value) is a condition of the path, in rule order."""
    parts = ", ".join(
        f"if({r.field} = {quoted((r.value or '').strip() or MISSING)}, {quoted(r.reason)}, null)"
        for r in cfg.suppression_rules
    )
    return f"array_compact(array({parts}))" if parts else "cast(array() as array<string>)"


def as_records(
    windows: DataFrame,
    cfg: AttributionConfig,
    *,
    source: str | Column,
    order: tuple[str, ...] | None = None,
    forced: bool | Column = False,
    rule_note: str | Column = "",
    drilldown_rule: str | Column = "",
    enters_next_level: bool | Column = False,
) -> DataFrame:
    """Roll the windows of a path up to one alert record.

    Only windows with a positive (rounded) baseline compete for primary, all of them if none has one; ties keep
    the earlier window. A group has as many rows as there are windows.
    """
    dims = cfg.dimensions
    shown = order or dims

    def as_col(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    fields = ", ".join(f"'{f}', {f}" for f in WINDOW_FIELDS)
    best = (
        "named_struct('eligible', int(baseline_daily > 0), 'level', level,"
        " 'strength', least(growth_factor, structure_lift_factor), 'z', z_score, 'obs', observation_count,"
        " 'neg_ord', -ord)"
    )
    rolled = windows.groupBy(*dims).agg(
        F.expr(f"array_sort(collect_list(named_struct('ord', ord, 'w', named_struct({fields})))) as _all"),
        F.expr("max(level) as level"),
        F.expr(f"max_by(named_struct('window_key', window_key, 'label', label, 'observation_count',"
               " observation_count, 'growth_factor', growth_factor, 'structure_lift_factor',"
               f" structure_lift_factor, 'z_score', z_score, 'excess_count', excess_count), {best}) as _primary"),
    )
    df = rolled.select(
        *dims,
        F.expr("transform(_all, x -> x.w) as windows"),
        canonical_path(dims).alias("canonical_path"),
        display_path(shown).alias("path"),
        path_depth(dims).alias("depth"),
        F.expr(suppression_sql(cfg)).alias("suppression_reasons"),
        F.expr("transform(filter(_all, x -> x.w.level > 0), x -> x.w.window_key)").alias("hit_windows"),
        "level",
        "_primary",
    )
    primary = ("observation_count", "growth_factor", "structure_lift_factor", "z_score", "excess_count")
    return df.select(
        record_id(F.col("canonical_path")).alias("id"),
        as_col(source).alias("source"),
        layer_name("depth").alias("layer"),
        "depth",
        "path",
        "canonical_path",
        *dims,
        conditions(shown, cfg).alias("conditions"),
        "level",
        F.expr(label_sql("level", cfg)).alias("level_label"),
        F.expr(color_sql("level")).alias("severity"),
        F.expr(anomaly_sql()).alias("anomaly_type"),
        F.expr("_primary.window_key as primary_window"),
        F.expr("_primary.label as primary_window_label"),
        "hit_windows",
        F.expr("size(hit_windows) as hit_window_count"),
        *[F.expr(f"_primary.{name} as {name}") for name in primary],
        F.expr("least(_primary.growth_factor, _primary.structure_lift_factor) as relative_strength"),
        as_col(forced).cast("boolean").alias("is_expert_forced"),
        as_col(rule_note).alias("rule_note"),
        F.expr("size(suppression_reasons) > 0 as is_suppressed"),
        "suppression_reasons",
        as_col(enters_next_level).cast("boolean").alias("enters_next_level"),
        as_col(drilldown_rule).alias("drilldown_rule"),
        "windows",
    )


def rank_order() -> list[Column]:
    """Report order of records; the canonical path makes it total."""
    return [
        F.desc("level"),
        F.desc("hit_window_count"),
        F.desc("relative_strength"),
        F.desc("z_score"),
        F.desc("observation_count"),
        F.asc("canonical_path"),
    ]
