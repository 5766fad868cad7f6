"""Impact of a strategy: increments against policy and plans, segments, timing, daily and effect reports."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, functions as F

from pathlift.functions.paths import quoted
from pathlift.functions.scalars import normalized_code, with_absent
from pathlift.operators.execution import CELL, KEYS, SAME_RATE, CodeBook, loan_count, valid_population


def with_plan(joined: DataFrame, plan: DataFrame) -> DataFrame:
    """Third table: planned rates per policy cell (one row per cell)."""
    p = plan.select(*CELL, F.col("eligible").alias("plan_eligible"), "plan_a_rate", "plan_b_rate")
    return joined.join(p, list(CELL), "left").withColumns(
        {
            "score_code": normalized_code(KEYS[3]),
            "direction": F.expr(
                "case when expected_rate is null then 'no_lookup' when actual_rate is null then 'missing_actual_rate'"
                " when rate_matches then 'match' when actual_rate < expected_rate then 'actual_rate_lower_than_table'"
                " else 'actual_rate_higher_than_table' end"),
        }
    )


def impact(planned: DataFrame) -> DataFrame:
    """Actual, uncapped, table and plan increments: overall, by flag, by score and by direction, in one pass."""
    differs = f"expected_rate is not null and actual_rate is not null and abs(expected_rate - actual_rate) >= {SAME_RATE}"
    sums = {
        "cnt": "sum(cnt)",
        "before_sum": "sum(before_sum)",
        "after_sum": "sum(after_sum)",
        "actual_increment": "sum(increment_sum)",
        "uncapped_increment": "coalesce(sum(before_sum * actual_rate), 0D)",
        "table_increment": "coalesce(sum(before_sum * expected_rate), 0D)",
        "plan_a_increment": "coalesce(sum(if(plan_eligible, before_sum * plan_a_rate, 0D)), 0D)",
        "plan_b_increment": "coalesce(sum(if(plan_eligible, before_sum * plan_b_rate, 0D)), 0D)",
        "positive_config_no_raise_cnt": "sum(if(flag = '0' and actual_rate > 0, cnt, 0))",
        "coefficient_match_cnt": "sum(if(rate_matches, cnt, 0))",
        "coefficient_mismatch_cnt": f"sum(if({differs}, cnt, 0))",
        "no_lookup_cnt": "sum(if(expected_rate is null, cnt, 0))",
        "actual_below_table_cnt": f"sum(if({differs} and actual_rate < expected_rate, cnt, 0))",
        "actual_above_table_cnt": f"sum(if({differs} and actual_rate > expected_rate, cnt, 0))",
        "table_shortfall": "coalesce(sum(before_sum * (expected_rate - actual_rate)), 0D)",
        "plan_a_vs_table_gap":
            "coalesce(sum(if(plan_eligible, before_sum * (plan_a_rate - expected_rate), 0D)), 0D)",
    }
    axes = ("flag", "score_code", "direction")
    df = planned.groupingSets([*[[F.col(a)] for a in axes], []], *axes).agg(
        F.grouping_id().alias("_g"), *[F.expr(f"{sql} as {name}") for name, sql in sums.items()]
    )
    money = ("actual_increment", "uncapped_increment", "table_increment", "plan_a_increment", "plan_b_increment",
             "table_shortfall", "plan_a_vs_table_gap")
    return df.selectExpr(
        "case _g when 3 then 'flag' when 5 then 'score' when 6 then 'direction' else 'all' end as axis",
        "coalesce(flag, score_code, direction, 'all') as axis_value",
        *[s for s in sums if s not in money],
        *[f"{m} / 100 as {m}_yuan" for m in money],
        "try_divide(before_sum, cnt * 100) as before_avg_yuan",
        "try_divide(after_sum, cnt * 100) as after_avg_yuan",
        "try_divide(actual_increment, cnt * 100) as increment_per_customer_yuan",
        "try_divide(after_sum, before_sum) - 1 as raise_rate_by_amount",
    )


def segment_summary(facts: DataFrame, *keys: str, positive_not_raised: bool = False) -> DataFrame:
    """Counts, limit sums and configured rates per segment of the valid population."""
    rows = valid_population(facts)
    if positive_not_raised:
        rows = rows.where("te_flag = 0 and cast(cash_remark1 as double) > 0")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.expr("sum(cast(jq_credit_quota as double)) as before_sum"),
        F.expr("sum(cast(cash_quota_amount_now_after as double)) as after_sum"),
        F.expr("count_if(cast(cash_remark1 as double) > 0) as positive_rate_cnt"),
        F.expr("avg(cast(cash_remark1 as double)) as avg_configured_rate"),
    )


def launch_overall(facts: DataFrame, date_col: str = "jq_date", time_col: str = "jq_time") -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("cnt"), F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time"),
        F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"),
    )


def launch_by_day(facts: DataFrame, date_col: str = "jq_date", time_col: str = "jq_time") -> DataFrame:
    return facts.groupBy(date_col).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time")
    )


def launch_by_hour(facts: DataFrame, since: str, time_col: str, *keys: str) -> DataFrame:
    return facts.where(F.col(time_col) >= F.lit(since).cast("timestamp")).groupBy(
        F.date_trunc("hour", time_col).alias("run_hour"), *keys
    ).agg(F.count(F.lit(1)).alias("cnt"))


#: Columns a settlement table may lack: days and daily fee of the loan, early default by customers and by amount.
SETTLEMENT_COLUMNS = (
    "loan_period_days", "interest_fee_daily",
    *(f"{h}_{part}_{kind}" for h in ("fpd1", "fpd7") for part in ("fz", "fm") for kind in ("dd", "bj")),
)


def daily_settlement(facts: DataFrame) -> DataFrame:
    """Eighteen figures per settlement day; figures whose source columns are absent are NULL."""
    facts = with_absent(facts, SETTLEMENT_COLUMNS)
    sums = {
        "settled_cnt": "count(1)",
        "_before": "sum(cast(jq_credit_quota as double))",
        "_after": "sum(cast(cash_quota_amount_now_after as double))",
        "_loan": "sum(cast(loan_amount as double))",
        "raised_cnt": "count_if(cast(te_flag as bigint) = 1)",
        "_r_before": "sum(if(cast(te_flag as bigint) = 1, cast(jq_credit_quota as double), 0D))",
        "_r_after": "sum(if(cast(te_flag as bigint) = 1, cast(cash_quota_amount_now_after as double), 0D))",
        "next_loan_cnt": "count_if(cast(loan_prin as double) > 0)",
        "_next": "sum(cast(loan_prin as double))",
        "avg_loan_days": "avg(cast(loan_period_days as double))",
        "avg_daily_fee": "avg(cast(interest_fee_daily as double))",
    }
    rates = {}
    for h in ("fpd1", "fpd7"):
        for kind, suffix in (("dd", "rate"), ("bj", "amount_rate")):
            sums[f"_{h}_{kind}_n"] = f"sum(cast({h}_fz_{kind} as double))"
            sums[f"_{h}_{kind}_d"] = f"sum(cast({h}_fm_{kind} as double))"
            rates[f"{h}_{suffix}"] = f"try_divide(_{h}_{kind}_n, _{h}_{kind}_d)"
        rates[f"{h}_matured_cnt"] = f"cast(_{h}_dd_d as bigint)"
    df = valid_population(facts).groupBy("jq_date").agg(*[F.expr(f"{s} as {n}") for n, s in sums.items()])
    return df.selectExpr(
        "jq_date", "settled_cnt",
        "try_divide(_before, settled_cnt) / 100 as avg_limit_before",
        "try_divide(_after, settled_cnt) / 100 as avg_limit_after",
        "try_divide(_loan, settled_cnt) / 100 as avg_loan",
        "try_divide(_loan, _before) as use_rate",
        "raised_cnt",
        "try_divide(_r_before, raised_cnt) / 100 as raised_avg_before",
        "try_divide(_r_after, raised_cnt) / 100 as raised_avg_after",
        "next_loan_cnt",
        "try_divide(_next, next_loan_cnt) as avg_next_loan",
        "avg_loan_days", "avg_daily_fee",
        *[f"{sql} as {name}" for name, sql in rates.items()],
    )


def effect_framework(facts: DataFrame) -> DataFrame:
    """Strategy x score x flag: limits, loans, use rates, next-loan rate and early default (NULL where not in the table)."""
    horizons = ("fpd1", "fpd7")
    df = valid_population(with_absent(facts, SETTLEMENT_COLUMNS)).groupBy(
        "str_type", normalized_code("jq_mix_score_bin").alias("score"), normalized_code("te_flag").alias("flag")
    ).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.expr("sum(cast(jq_credit_quota as double)) as _b"),
        F.expr("sum(cast(cash_quota_amount_now_after as double)) as _a"),
        F.expr("sum(cast(loan_amount as double)) as _l"),
        F.expr("coalesce(sum(cast(loan_prin as double)), 0D) as _n"),
        F.expr("count_if(cast(next_loan_flag as bigint) = 1) as next_cnt"),
        *[F.expr(f"sum(cast({h}_fz_dd as double)) as _{h}_n") for h in horizons],
        *[F.expr(f"sum(cast({h}_fm_dd as double)) as _{h}_d") for h in horizons],
    )
    return df.selectExpr(
        "str_type", "score", "flag", "cnt", "next_cnt",
        "_b / cnt / 100 as avg_before", "_a / cnt / 100 as avg_after", "try_divide(_a, _b) - 1 as raise_rate",
        "try_divide(_l, _b) as use_rate_before", "_l / cnt / 100 as avg_loan",
        "_n / greatest(next_cnt, 1) as avg_next_loan", "try_divide(_n, _a / 100) as use_rate_after",
        "next_cnt / cnt as next_loan_rate",
        *[f"try_divide(_{h}_n, _{h}_d) as {h}_rate" for h in horizons],
        *[f"cast(_{h}_d as bigint) as {h}_matured_cnt" for h in horizons],
    )


def effect_delta(effect: DataFrame) -> DataFrame:
    """New strategy beside the old one per score and in total.

    The net effect of a strategy is raised minus not raised; the delta is new minus old. Totals weigh the
    averages by customers that took a next loan.
    """
    sides = effect.where("str_type in ('new', 'old')").selectExpr(
        "*", "avg_next_loan * greatest(next_cnt, 1) as _next", "avg_loan * cnt as _loan"
    )
    by = sides.groupingSets([[F.col("score"), F.col("str_type")], [F.col("str_type")]], "score", "str_type").agg(
        F.grouping("score").alias("_g"),
        F.expr("sum(cnt) as all_cnt"),
        F.expr("sum(_loan) / sum(cnt) as settled_avg_loan"),
        *[F.expr(f"coalesce(sum(cnt) filter (where flag = '{f}'), 0) as {n}_cnt")
          for f, n in (("1", "raised"), ("0", "not_raised"))],
        *[F.expr(f"sum(_next) filter (where flag = '{f}')"
                 f" / greatest(sum(next_cnt) filter (where flag = '{f}'), 1) as {n}_next")
          for f, n in (("1", "raised"), ("0", "not_raised"))],
    ).withColumn("score", F.expr("if(_g = 1, 'all', score)"))
    figures = ("all_cnt", "settled_avg_loan", "raised_cnt", "not_raised_cnt", "raised_next", "not_raised_next")
    wide = by.groupBy("score").pivot("str_type", ["new", "old"]).agg(*[F.first(c).alias(c) for c in figures])
    return wide.selectExpr(
        "score", *[f"{s}_{c}" for s in ("new", "old") for c in figures],
        "try_divide(new_raised_cnt, new_all_cnt) as new_coverage",
        "try_divide(old_raised_cnt, old_all_cnt) as old_coverage",
        "new_raised_next - old_raised_next as raised_delta",
        "new_raised_next - new_not_raised_next as new_net_effect",
        "old_raised_next - old_not_raised_next as old_net_effect",
        "(new_raised_next - new_not_raised_next) - (old_raised_next - old_not_raised_next) as net_delta",
        "(new_raised_next - old_raised_next) * new_raised_cnt as scaled_total",
    )


def deployed_relation(policy: DataFrame, plan: DataFrame) -> DataFrame:
    """Deployed rates classed by which planned rate they equal."""
    same = "abs(target_rate - {0}) < 1e-9"
    rule = (
        "case when raw_cap is null and plan_a_rate is null then 'missing_from_plan' "
        f"when {same.format('raw_cap')} then 'equals_raw_cap' when {same.format('plan_b_rate')} then 'equals_plan_b' "
        f"when {same.format('plan_a_rate')} then 'equals_plan_a' else 'other' end"
    )
    joined = policy.join(plan, list(CELL), "left")
    return joined.select("*", F.expr(rule).alias("relation"),
                         F.expr("if(eligible, try_divide(target_rate, raw_cap), null) as scale_factor"))


def relation_counts(related: DataFrame) -> DataFrame:
    return related.groupBy("relation").agg(
        F.count(F.lit(1)).alias("cells"), F.expr("coalesce(count_if(eligible), 0) as eligible_cells"),
        F.min("scale_factor").alias("min_scale"), F.max("scale_factor").alias("max_scale"),
        F.avg("scale_factor").alias("avg_scale"),
    )


def mapping_search(facts: DataFrame, policy: DataFrame, book: CodeBook = CodeBook(), k: int | None = None) -> DataFrame:
    """Try every assignment of codes to labels and three shifts of the loan count; rank by matching customers.

    The facts are aggregated to their distinct code combinations first. A permuted code book only relabels key
    parts, so matches are counted per (code, label) pairing in one join with the policy on the rate, and each
    mapping sums its own pairings.
    """
    books = {"customer": book.customer, "use_rate": book.use_rate, "score": book.score}
    counts = facts.groupBy(
        normalized_code(KEYS[0]).alias("customer_code"), normalized_code(KEYS[1]).alias("use_rate_code"),
        F.col(KEYS[2]).alias("raw_count"), normalized_code(KEYS[3]).alias("score_code"),
        F.col("cash_remark1").cast("double").alias("rate"),
    ).agg(F.count(F.lit(1)).alias("n"))
    known = " and ".join(
        f"{part}_code in ({', '.join(repr(c) for c in codes)})" for part, codes in books.items()
    )
    shifts = {"same": 0, "minus1": -1, "plus1": 1}
    moved = counts.where(known).where("rate is not null and raw_count is not null").select(
        "*", F.explode(F.array(*[
            F.struct(F.lit(name).alias("count_shift"), loan_count("raw_count", s).alias("loan_cnt"))
            for name, s in shifts.items()])).alias("s")
    ).select("customer_code", "use_rate_code", "score_code", "rate", "n", "s.*")
    moved = moved.groupBy("customer_code", "use_rate_code", "score_code", "count_shift", "loan_cnt", "rate").agg(
        F.sum("n").alias("n"))
    labels = policy.select(*CELL, "target_rate")
    hit = (moved["loan_cnt"] == labels["loan_cnt"]) & (F.abs(F.col("rate") - F.col("target_rate")) < 1e-10)
    pairs = moved.join(labels, hit, "inner").groupBy(
        "count_shift", *[c for part in books for c in (f"{part}_code", part)]
    ).agg(F.sum("n").alias("matched"))

    def permutations(part: str) -> str:
        codes = list(books[part])
        rows = [
            f"named_struct('m', {i}, 'c', {quoted(code)}, 'v', {quoted(label)})"
            for i, labels_ in enumerate(itertools.permutations([books[part][c] for c in codes]))
            for code, label in zip(codes, labels_)
        ]
        return f"filter(array({', '.join(rows)}), p -> p.c = {part}_code and p.v = {part})"

    out = pairs
    for part in books:
        keep = [c for c in out.columns if c not in (part, f"{part}_code")]
        out = out.selectExpr(*keep, f"explode({permutations(part)}) as _p").withColumn(f"{part}_map", F.col("_p.m"))
        out = out.groupBy(*[c for c in out.columns if c not in ("matched", "_p")]).agg(F.sum("matched").alias("matched"))
    # Every mapping is listed, also one without any match.
    every = moved.groupBy("count_shift").agg(F.sum("n").alias("checked_cnt"))
    for part in books:
        last = math.factorial(len(books[part])) - 1
        every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias(f"{part}_map"))
    maps = [f"{part}_map" for part in books]
    ranked = every.join(out, ["count_shift", *maps], "left").selectExpr(
        *maps, "count_shift", "coalesce(matched, 0) as matched_cnt", "checked_cnt",
        "coalesce(matched, 0) / checked_cnt as match_rate",
    )
    if k is None:
        return ranked
    return ranked.orderBy(
        F.desc("matched_cnt"), "customer_map", "use_rate_map", "score_map", "count_shift"
    ).limit(k)


def plan_vs_online(plan_cells: DataFrame, joined: DataFrame) -> DataFrame:
    """Planned against executed raises per cell; cells planned but never executed stay visible."""
    online = joined.where("is_mapped").groupBy(*CELL).agg(
        F.expr("sum(if(flag = '1', cnt, 0)) as executed_cnt"),
        F.expr("sum(cnt) as online_cnt"),
        F.expr("try_divide(sum(if(flag = '1', after_sum, 0D)), sum(if(flag = '1', cnt, 0)) * 100) as executed_avg_after"),
    )
    return plan_cells.join(online, list(CELL), "left").selectExpr(
        *CELL, "planned_cnt", "coalesce(executed_cnt, 0) as executed_cnt",
        "try_divide(coalesce(executed_cnt, 0), planned_cnt) as execution_rate",
        "executed_avg_after", "coalesce(executed_cnt, 0) = 0 as is_unexecuted",
    )


# Bands of the actual raise rate and of the limit after the raise (cents).
RATE_BANDS = ((0.2, "0-20%"), (0.5, "20-50%"), (1.0, "50-100%"))
LIMIT_BANDS = ((1_000_000, "<1万"), (2_000_000, "1-2万"), (5_000_000, "2-5万"), (10_000_000, "5-10万"))


def contribution_bands(facts: DataFrame, by: str = "rate") -> DataFrame:
    """Raised customers by band of the actual raise rate, or of the limit after it."""
    rows = valid_population(facts).where("te_flag = 1").selectExpr(
        "*", "cash_quota_amount_now_after as _a", "jq_credit_quota as _b",
        "try_divide(cash_quota_amount_now_after - jq_credit_quota, jq_credit_quota) as _r",
    )
    bands, value, last = (RATE_BANDS, "_r", ">100%") if by == "rate" else (LIMIT_BANDS, "_a", ">10万")
    edge = "<=" if by == "rate" else "<"
    case = "case " + " ".join(f"when {value} {edge} {b} then '{n}'" for b, n in bands) + f" else '{last}' end"
    return rows.groupBy(F.expr(case).alias("band")).agg(
        F.count(F.lit(1)).alias("cnt"), F.expr("avg(_b) / 100 as avg_before"), F.expr("avg(_a) / 100 as avg_after"),
        F.expr("avg(loan_amount) / 100 as avg_loan"), F.expr("try_divide(sum(loan_amount), sum(_a)) as use_rate"),
        F.expr("avg(if(next_curday_flag = 1, 1D, 0D)) as t0_rate"),
    )
