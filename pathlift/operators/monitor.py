"""Monitoring tables: funnel, vintage, retention, migration, roll rates, channel quality, rule hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def funnel(df: DataFrame, stage: str, stages: Sequence[str], user: str | None = None) -> DataFrame:
    """Volume per stage in order, and the share of the stage before. One row per stage."""
    order = "case " + stage + " " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(stages)) + " end"
    n = F.count_distinct(user) if user else F.count(F.lit(1))
    rows = df.where(F.col(stage).isin(*stages)).groupBy(stage).agg(n.alias("value"))
    w = W.orderBy("stage_no")
    return rows.select(F.col(stage).alias("stage"), F.expr(order).alias("stage_no"), "value").withColumn(
        "conversion", F.expr("value") / F.lag("value").over(w)
    )


def vintage(loans: DataFrame, outcome: DataFrame, months: int, lag_months: int = 0) -> DataFrame:
    """Cohort month x months on book: cumulative bad share, NULL while the cohort has not matured.

    ``loans``: id, start; ``outcome``: id, event (first bad day). ``lag_months`` delays maturity (a stage that
    needs two more months to show).
    """
    cohort = loans.select("id", F.trunc("start", "month").alias("cohort"))
    as_of = outcome.agg(F.trunc(F.max("event"), "month")).scalar()
    first = outcome.groupBy("id").agg(F.min("event").alias("event"))
    bad = cohort.join(first, "id", "left").withColumn(
        "mob", F.expr("int(months_between(trunc(event, 'month'), cohort))")
    )
    sized = bad.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("loans"),
        *[F.expr(f"count_if(mob >= 0 and mob <= {m}) as _m{m}") for m in range(1, months + 1)],
    ).withColumn("_as_of", as_of)
    cells = [
        f"if(months_between(_as_of, cohort) - {lag_months} >= {m}, _m{m} / loans, null) as mob{m}"
        for m in range(1, months + 1)
    ]
    return sized.selectExpr("cohort", "loans", *cells)


def retention(events: DataFrame, user: str, day: str, periods: int, unit_days: int = 7) -> DataFrame:
    """Share of a cohort's users seen again n periods after their first one."""
    seen = events.select(user, F.expr(f"int(floor(unix_date({day}) / {unit_days})) as period")).distinct()
    start = seen.groupBy(user).agg(F.min("period").alias("cohort"))
    joined = seen.join(start, user).withColumn("n", F.col("period") - F.col("cohort")).where(F.col("n") <= periods)
    counted = joined.groupBy("cohort", "n").agg(F.count(F.lit(1)).alias("users"))
    size = counted.where("n = 0").select("cohort", F.col("users").alias("cohort_users"))
    return counted.join(size, "cohort").selectExpr("cohort", "n", "users", "users / cohort_users as retention")


def migration(before: DataFrame, after: DataFrame, key: str, bins: Sequence[int]) -> DataFrame:
    """Share of each base bin that moved to each current bin; rows add up to 1."""
    pairs = before.select(key, F.col("bin").alias("base_bin")).join(
        after.select(key, F.col("bin").alias("current_bin")), key
    )
    wide = pairs.groupBy("base_bin").pivot("current_bin", list(bins)).count()
    total = " + ".join(f"coalesce(`{b}`, 0)" for b in bins)
    return wide.selectExpr("base_bin", *[f"coalesce(`{b}`, 0) / ({total}) as to_{b}" for b in bins])


def roll_rates(states: DataFrame, key: str, period: str, bucket: str) -> DataFrame:
    """Cure, stay and worse shares per bucket, from each key's state to its next one (few periods per key)."""
    w = W.partitionBy(key).orderBy(period)
    moves = states.withColumn("_next", F.lead(bucket).over(w)).where("_next is not null")
    return moves.groupBy(F.col(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("moves"),
        F.expr(f"avg(if(_next < {bucket}, 1D, 0D)) as cure"),
        F.expr(f"avg(if(_next = {bucket}, 1D, 0D)) as stay"),
        F.expr(f"avg(if(_next > {bucket}, 1D, 0D)) as worse"),
    )


def channel_quality(df: DataFrame, channel: str, passed: str, matured: str, bad: str, days: str) -> DataFrame:
    """Volume per active day, pass rate and early default per channel, with the plain average of the rates."""
    per = df.groupBy(F.col(channel).alias("channel")).agg(
        F.count(F.lit(1)).alias("volume"), F.expr(f"count(1) / count(distinct {days}) as daily_volume"),
        F.expr(f"avg(if({passed}, 1D, 0D)) as pass_rate"),
        F.expr(f"try_divide(count_if({bad}), count_if({matured})) as default_rate"),
    )
    mean = per.agg(F.avg("pass_rate").alias("p"), F.avg("default_rate").alias("d")).select(F.struct("p", "d"))
    return per.withColumn("_m", mean.scalar()).selectExpr(
        "channel", "volume", "daily_volume", "pass_rate", "default_rate",
        "_m.p as average_pass_rate", "_m.d as average_default_rate",
    )


def rule_hits(df: DataFrame, rules: dict[str, str], blocked: str, fraud: str) -> DataFrame:
    """Hits, blocks and precision per rule; a rule is a condition over the columns."""
    tags = ", ".join(f"if({cond}, '{name}', null)" for name, cond in rules.items())
    hit = df.select("*", F.expr(f"explode(array_compact(array({tags}))) as rule"))
    return hit.groupBy("rule").agg(
        F.count(F.lit(1)).alias("hits"), F.expr(f"count_if({blocked}) as blocks"),
        F.expr(f"count_if({fraud}) / count(1) as precision"),
    )


def clusters(df: DataFrame, device: str, user: str, passed: str, at_least: int) -> DataFrame:
    """Devices shared by many users: applications, users and passes."""
    return df.groupBy(F.col(device).alias("device")).agg(
        F.count_distinct(user).alias("users"), F.count(F.lit(1)).alias("applications"),
        F.expr(f"count_if({passed}) as passes"),
    ).where(F.col("users") >= at_least)
