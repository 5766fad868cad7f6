"""Single scan, top-k drilldown, forced expert path and merging."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pathlift.functions.scalars import normalize_value
from pathlift.operators.daily import Base
from pathlift.operators.metrics import (
    SOURCE_EXPERT, SOURCE_TOPK, as_records, combined_amounts, rank_order, window_sums, with_amounts, with_windows,
)
from pathlift.session import cut_lineage

# Notes carried by records.
NOTE_SINGLE_SEED = "单维 Top10 进入二级下钻"
NOTE_PAIR_SEED = "二级 Top5 进入三级下钻"
NOTE_EXPERT = ("强制单维进入专家二级下钻", "强制双维进入专家三级下钻", "专家三级终止层")
SOURCE_BOTH = "Top-K + 专家规则"
NOTE_JOINER = "；"


def single_sums(base: Base, amounts: DataFrame | None = None) -> DataFrame:
    """Every dimension in one pass: one grouping set per dimension, NULL marks the others as open.

    ``amounts``: the stored ``combined_amounts`` of the base, made on the way if there is none.
    """
    dims = base.cfg.dimensions
    rows = combined_amounts(base) if amounts is None else amounts
    return rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(*window_sums(base))


def value_daily(base: Base) -> DataFrame:
    """(field, value, day) counts of all dimensions, one pass."""
    cfg = base.cfg
    pairs = F.array(*[F.struct(F.lit(d).alias("field"), F.col(d).alias("value")) for d in cfg.dimensions])
    return (
        base.facts.select("day", cfg.count_field, F.explode(pairs).alias("p"))
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"), "day")
        .agg(F.sum(cfg.count_field).alias(cfg.count_field))
    )


def single_records(base: Base) -> DataFrame:
    return as_records(with_windows(single_sums(base), base), base.cfg, source=SOURCE_TOPK)


def extended_sums(base: Base, seeds: DataFrame, fields: tuple[str, ...] | None = None,
                  amounts: DataFrame | None = None) -> DataFrame:
    """Extend each seed path by every value of every open dimension (or of ``fields``), one scan for all seeds.

    ``seeds`` must be cut to the configured top-k before the call: they travel as one array, a scalar subquery.
    Each row meets only the seeds it lies on, in place, and the sums combine before the exchange. Reaching a path
    from two seeds gives equal sums; one of them is kept. ``amounts`` as in ``single_sums``.
    """
    dims = base.cfg.dimensions
    targets = fields or dims
    rows = combined_amounts(base) if amounts is None else amounts
    listed = seeds.agg(F.collect_list(F.struct(*[F.col(d).alias(f"_s_{d}") for d in dims])).alias("s"))

    def lies_on(s: Column) -> Column:
        return functools.reduce(lambda a, b: a & b, [s[f"_s_{d}"].isNull() | (s[f"_s_{d}"] == F.col(d)) for d in dims])

    joined = rows.withColumn("_seeds", listed.scalar()).select("*", F.inline(F.filter("_seeds", lies_on)))
    seed = [F.col(f"_s_{d}") for d in dims]
    # One grouping set per extension dimension; the seed's own conditions are part of every key.
    sums = joined.groupingSets([[*seed, F.col(t)] for t in targets], *[f"_s_{d}" for d in dims], *targets).agg(
        *window_sums(base), F.max("_any").alias("_any")
    )
    open_only = " and ".join(f"({t} is null or _s_{t} is null)" for t in targets)
    path = [f"coalesce(_s_{d}, {d}) as {d}" if d in targets else f"_s_{d} as {d}" for d in dims]
    figures = [c for c in sums.columns if c.startswith(("_obs", "_base"))]
    return sums.where(f"_any and {open_only}").selectExpr(*path, *figures).dropDuplicates(list(dims))


def eligible(records: DataFrame, floor: float | None) -> DataFrame:
    """Not suppressed, and either an alert or with enough observations (``None``: no floor)."""
    keep = ~F.col("is_suppressed")
    if floor is not None:
        keep = keep & ((F.col("level") > 0) | (F.col("observation_count") >= floor))
    return records.where(keep)


def top(records: DataFrame, k: int) -> DataFrame:
    return records.orderBy(*rank_order()).limit(k)


def as_seeds(records: DataFrame, k: int, note: str) -> DataFrame:
    return top(records, k).withColumns({"enters_next_level": F.lit(True), "drilldown_rule": F.lit(note)})


def dedupe(records: DataFrame) -> DataFrame:
    """Best-ranked record per canonical path."""
    w = W.partitionBy("canonical_path").orderBy(*rank_order()[:-1])
    return records.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@dataclass
class Drilldown:
    single: DataFrame
    pair: DataFrame
    third: DataFrame
    single_seeds: DataFrame
    pair_seeds: DataFrame
    alerts: DataFrame
    suppressed: DataFrame
    counts: DataFrame


def topk_drilldown(base: Base, store_steps: bool = True) -> Drilldown:
    """Depth 1, best seeds, depth 2, best seeds, depth 3.

    The depths read window amounts per combination. With ``store_steps`` these and every depth are written once to the shared folder and read back by the seeds, the
    alerts, the suppressed list and the counters; without it the whole chain is one lazy plan.
    """
    cfg = base.cfg
    keep = cut_lineage if store_steps else (lambda df: df)
    floor = cfg.level0_min_observation

    def records(sums: DataFrame) -> DataFrame:
        return keep(as_records(with_windows(sums, base), cfg, source=SOURCE_TOPK))

    amounts = keep(combined_amounts(base))
    single = records(single_sums(base, amounts))
    single_ok = eligible(single, floor)
    single_seeds = as_seeds(single_ok, cfg.single_limit, NOTE_SINGLE_SEED)
    pair = records(extended_sums(base, single_seeds, amounts=amounts))
    pair_ok = eligible(pair, floor)
    pair_seeds = as_seeds(pair_ok, cfg.pair_limit, NOTE_PAIR_SEED)
    third = records(extended_sums(base, pair_seeds, amounts=amounts))
    third_ok = eligible(third, None)

    # Paths of different depths differ, so the union holds each path once.
    alerts = single_ok.unionByName(pair_ok).unionByName(third_ok).where("level > 0")
    suppressed = single.unionByName(pair).unionByName(third).where("is_suppressed and level > 0")
    return Drilldown(
        single, pair, third, single_seeds, pair_seeds, alerts, suppressed, counters(single, pair, third, floor)
    )


def counters(single: DataFrame, pair: DataFrame, third: DataFrame, floor: float) -> DataFrame:
    """Eight counters in one row."""
    allr = (
        single.select("depth", "is_suppressed", "level", "observation_count")
        .unionByName(pair.select("depth", "is_suppressed", "level", "observation_count"))
        .unionByName(third.select("depth", "is_suppressed", "level", "observation_count"))
    )
    pool = ~F.col("is_suppressed") & ((F.col("level") > 0) | (F.col("observation_count") >= floor))
    alert = ~F.col("is_suppressed") & (F.col("level") > 0)

    def n(depth: int, cond) -> Column:
        return F.count_if((F.col("depth") == depth) & cond)

    yes = F.lit(True)
    return allr.agg(
        n(1, yes).alias("single_scanned"),
        n(1, pool).alias("single_pool"),
        n(2, yes).alias("pair_scanned"),
        n(2, pool).alias("pair_pool"),
        n(3, yes).alias("third_scanned"),
        n(1, alert).alias("single_alerts"),
        n(2, alert).alias("pair_alerts"),
        n(3, alert).alias("third_alerts"),
    )


@dataclass
class ExpertChain:
    single: DataFrame
    pair: DataFrame
    third: DataFrame
    alerts: DataFrame
    suppressed: DataFrame


def forced_sums(base: Base, first: tuple[str, str], second: tuple[str, str], third: str) -> DataFrame:
    """Window sums of the forced path, of its second step, and of every value of the third field: one pass.

    The two forced paths get a row of zeros when they have no data.
    """
    cfg, dims = base.cfg, base.cfg.dimensions
    (f1, v1), (f2, v2) = ((f, normalize_value(F.lit(v))) for f, v in (first, second))
    rows = base.facts.where(F.col(f1) == v1).select(
        "day", cfg.count_field, v1.alias("_p1"), F.when(F.col(f2) == v2, v2).alias("_p2"), F.col(third).alias("_p3")
    )
    rows = with_amounts(rows, base)
    steps = ["_p1", "_p2", "_p3"]
    sets = [[F.col(c) for c in steps[:n]] for n in (1, 2, 3)]
    sums = rows.groupingSets(sets, *steps).agg(
        F.grouping_id().alias("_g"), *window_sums(base), F.max(F.col(cfg.count_field) != 0).alias("_any")
    ).where("_g = 3 or (_p2 is not null and (_g = 1 or _any))")
    figures = [c for c in sums.columns if c.startswith(("_obs", "_base"))]
    zeros = base.frame.select(
        v1.alias("_p1"), F.explode(F.array(F.lit(None).cast("string"), v2)).alias("_p2"),
        F.lit(None).cast("string").alias("_p3"), *[F.lit(0.0).alias(c) for c in figures],
    )
    both = sums.select(*steps, *figures).unionByName(zeros).groupBy(*steps).agg(*[F.sum(c).alias(c) for c in figures])
    placed = {f1: "_p1", f2: "_p2", third: "_p3"}
    path = [f"{placed[d]} as {d}" if d in placed else f"cast(null as string) as {d}" for d in dims]
    return both.selectExpr(*path, *figures)


def expert_chain(base: Base, store_steps: bool = True) -> ExpertChain | None:
    """Forced single, forced pair, then every value of the third field; None with fewer than three steps."""
    cfg = base.cfg
    if len(cfg.expert_path) < 3:
        return None
    steps = cfg.expert_path[:3]
    order = tuple(dict.fromkeys([*[s.field for s in steps], *cfg.dimensions]))
    sums = forced_sums(base, (steps[0].field, steps[0].value), (steps[1].field, steps[1].value), steps[2].field)
    every = as_records(with_windows(sums, base), cfg, source=SOURCE_EXPERT, order=order, forced=True)
    depth = F.col("depth")

    def by_depth(texts) -> Column:
        return F.when(depth == 1, F.lit(texts[0])).when(depth == 2, F.lit(texts[1])).otherwise(F.lit(texts[2]))

    every = every.withColumns(
        {
            "rule_note": by_depth([s.label for s in steps]),
            "drilldown_rule": by_depth(NOTE_EXPERT),
            "enters_next_level": depth < 3,
        }
    )
    if store_steps:
        every = cut_lineage(every)
    single, pair, last = (every.where(depth == n) for n in (1, 2, 3))
    return ExpertChain(
        single, pair, last,
        alerts=every.where("not is_suppressed and level > 0"),
        suppressed=every.where("is_suppressed and level > 0"),
    )


def merge_alerts(topk: DataFrame, expert: DataFrame | None) -> DataFrame:
    """One record per canonical path: best rank wins, the Top-K one on a tie; sources, flags and notes combine."""
    if expert is None:
        return topk
    both = topk.withColumn("_ord", F.lit(0)).unionByName(expert.withColumn("_ord", F.lit(1)))
    every = W.partitionBy("canonical_path")
    best = every.orderBy(*rank_order()[:-1], F.asc("_ord"))
    notes = F.transform(
        F.array_sort(F.collect_set(F.when(F.col("rule_note") != "", F.struct("_ord", "rule_note"))).over(every)),
        lambda n: n["rule_note"],
    )
    return (
        both.withColumns(
            {
                "_rn": F.row_number().over(best),
                "_sources": F.size(F.collect_set("source").over(every)),
                "_forced": F.max("is_expert_forced").over(every),
                "_notes": F.array_join(F.array_distinct(notes), NOTE_JOINER),
            }
        )
        .where("_rn = 1")
        .withColumns(
            {
                "source": F.when(F.col("_sources") > 1, F.lit(SOURCE_BOTH)).otherwise(F.col("source")),
                "is_expert_forced": F.col("_forced"),
                "rule_note": F.col("_notes"),
            }
        )
        .drop("_rn", "_sources", "_forced", "_notes", "_ord")
    )


def merge_suppressed(topk: DataFrame, expert: DataFrame | None) -> DataFrame:
    """Suppressed records of both searches, best-ranked one per path."""
    return topk if expert is None else dedupe(topk.unionByName(expert))


def highlight(merged: DataFrame, expert: ExpertChain | None) -> DataFrame:
    """First merged alert, the forced single if there is none (one row, or none)."""
    first = top(merged, 1).withColumn("_ord", F.lit(0))
    if expert is None:
        return first.drop("_ord")
    both = first.unionByName(expert.single.withColumn("_ord", F.lit(1)))
    return both.orderBy("_ord").limit(1).drop("_ord")


def ranked(records: DataFrame, limit: int) -> DataFrame:
    """Cut to ``limit`` first, then number: the numbering window never holds more rows than the limit."""
    cut = top(records, limit)
    return cut.withColumn("sort_rank", F.row_number().over(W.orderBy(*rank_order())) - 1)
