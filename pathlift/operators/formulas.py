"""Limit formulas and checks of the executed limits against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathlift.operators.execution import valid_population

GRAIN = 10_000


def with_formulas(facts: DataFrame) -> DataFrame:
    """Limits as numbers with rate target, increase target and the three expected limits."""
    named = valid_population(facts, with_caps=True).selectExpr(
        "*",
        "cast(jq_credit_quota as double) as before_limit",
        "cast(cash_quota_amount_now_after as double) as after_limit",
        "cast(cash_remark1 as double) as raise_rate",
        "cast(after_adjust_credit_limit as double) as total_cap",
        "cast(credit_max_limit as double) as increase_cap",
    )
    targets = named.selectExpr(
        "*",
        f"cast(ceil(before_limit * (1 + raise_rate) / {GRAIN}) as double) * {GRAIN} as rate_target",
        "before_limit + increase_cap as increase_target",
    )
    return targets.selectExpr(
        "*",
        "least(rate_target, total_cap, increase_target) as hard_cap_expected",
        "least(rate_target, increase_target) as no_total_cap_expected",
        "if(before_limit >= total_cap, least(rate_target, increase_target),"
        " least(rate_target, total_cap, increase_target)) as grandfather_cap_expected",
    )


def counts(df: DataFrame, conditions: dict[str, str], *extra: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("eligible_cnt"),
        *[F.expr(f"count_if({cond}) as {name}") for name, cond in conditions.items()],
        *[F.expr(e) for e in extra],
    )


def variant_summary(df: DataFrame) -> DataFrame:
    """How many executed limits equal each formula variant, and how many sit at or above each bound."""
    return counts(
        df,
        {
            "hard_cap_match_cnt": "after_limit = hard_cap_expected",
            "no_total_cap_match_cnt": "after_limit = no_total_cap_expected",
            "grandfather_cap_match_cnt": "after_limit = grandfather_cap_expected",
            "pure_rate_match_cnt": "after_limit = rate_target",
            "increase_cap_match_cnt": "after_limit = increase_target",
            "total_cap_match_cnt": "after_limit = total_cap",
            "pre_at_or_above_total_cap_cnt": "before_limit >= total_cap",
            "after_above_total_cap_cnt": "after_limit > total_cap",
            "after_above_increase_cap_cnt": "after_limit > increase_target",
            "down_limit_cnt": "after_limit < before_limit",
        },
    )


# Result classes in the order they are tested.
CLASSES = (
    ("after_limit = hard_cap_expected", "A_hard_cap_exact"),
    ("after_limit = grandfather_cap_expected", "B_cap_skipped_for_grandfathered"),
    ("after_limit = rate_target", "C_pure_rate_only"),
    ("after_limit = increase_target", "D_single_increase_cap_only"),
    ("after_limit > total_cap", "E_above_total_cap"),
    ("after_limit > increase_target", "F_above_single_increase_cap"),
    ("after_limit > before_limit", "G_other_raise_mismatch"),
)
LAST_CLASS = "H_other"


def result_classes(df: DataFrame) -> DataFrame:
    case = "case " + " ".join(f"when {c} then '{n}'" for c, n in CLASSES) + f" else '{LAST_CLASS}' end"
    return df.groupBy(F.expr(case).alias("result_class")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.avg("before_limit").alias("avg_before_limit"),
        F.avg("after_limit").alias("avg_after_limit"),
        F.expr("avg(after_limit - before_limit) as avg_change"),
        F.expr("min(after_limit - hard_cap_expected) as min_gap_vs_hard_cap"),
        F.expr("max(after_limit - hard_cap_expected) as max_gap_vs_hard_cap"),
    )


def cap_crosstab(df: DataFrame) -> DataFrame:
    return df.groupBy(
        F.expr("if(before_limit >= total_cap, 'pre>=total_cap', 'pre<total_cap') as total_cap_status"),
        F.expr("if(after_limit > total_cap, 'after>total_cap', 'after<=total_cap') as after_total_status"),
        F.expr("if(after_limit > increase_target, 'after>pre+single_cap', 'after<=pre+single_cap')"
               " as increase_cap_status"),
    ).agg(F.count(F.lit(1)).alias("cnt"), F.avg("before_limit").alias("avg_before_limit"),
          F.avg("after_limit").alias("avg_after_limit"))


def match_summary(df: DataFrame) -> DataFrame:
    """Exact matches with the hard-cap formula, which bound was active, and the gaps."""
    gap = "after_limit - hard_cap_expected"
    return counts(
        df,
        {
            "exact_match_cnt": f"{gap} = 0",
            "actual_raise_cnt": "after_limit > before_limit",
            "actual_down_cnt": "after_limit < before_limit",
            "rate_bound_cnt": "rate_target <= total_cap and rate_target <= increase_target",
            "total_cap_bound_cnt": "total_cap < rate_target and total_cap <= increase_target",
            "increase_cap_bound_cnt": "increase_target < rate_target and increase_target < total_cap",
        },
        f"avg(if({gap} = 0, 1D, 0D)) as exact_match_rate",
        f"min({gap}) as min_gap", f"max({gap}) as max_gap", f"avg({gap}) as avg_gap",
    )


def match_by_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("raise_rate").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.expr("count_if(after_limit = hard_cap_expected) as exact_match_cnt"),
        F.avg("before_limit").alias("avg_before_limit"),
        F.avg("after_limit").alias("avg_after_limit"),
        F.expr("avg(after_limit - before_limit) as avg_raise_amount"),
        F.expr("avg(try_divide(after_limit - before_limit, before_limit)) as avg_actual_rate"),
        F.expr("count_if(after_limit > before_limit) as actual_raise_cnt"),
        F.expr("count_if(after_limit = total_cap) as actual_total_cap_bind_cnt"),
        F.expr("count_if(after_limit = increase_target) as actual_increase_cap_bind_cnt"),
    )


EXCEPTION_KEYS = (
    "cashloan_cid_mob_type", "defq_use_rate_level", "jq_customer_flag", "separate_installment_loan_cnt",
    "jq_mix_score_bin", "raise_rate",
)


def exception_profile(df: DataFrame, k: int = 100) -> DataFrame:
    """Largest groups of executed limits that differ from the formula."""
    gap = "after_limit - hard_cap_expected"
    return (
        df.where("after_limit <> hard_cap_expected").groupBy(*EXCEPTION_KEYS).agg(
            F.count(F.lit(1)).alias("cnt"),
            F.avg("before_limit").alias("avg_before_limit"),
            F.avg("after_limit").alias("avg_after_limit"),
            F.avg("hard_cap_expected").alias("avg_expected_limit"),
            F.expr(f"avg({gap}) as avg_gap"), F.expr(f"min({gap}) as min_gap"), F.expr(f"max({gap}) as max_gap"),
        ).orderBy(F.desc("cnt"), *[F.asc(c) for c in EXCEPTION_KEYS]).limit(k)
    )
