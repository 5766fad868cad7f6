"""Strategy execution: what the policy table says against what happened to customers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pathlift.functions.scalars import code_map, normalized_code, safe_double, with_absent
from pathlift.session import cut_lineage

KEYS = (
    "jq_customer_flag", "defq_use_rate_level", "separate_installment_loan_cnt", "jq_mix_score_bin",
    "cash_remark1", "te_flag",
)
CELL = ("customer", "use_rate", "loan_cnt", "score")
HORIZONS = ("fpd1", "fpd7", "fpd15", "fpd30")
SAME_RATE = "1e-10"
TARGET_AVERAGE = 50_000.0

# Code books of the limit-result table, and the conclusions of the execution check.
CUSTOMER_LABELS = {"HAVE_SINGLE_LOAN": "有单期借款", "HAVE_SINGLE_NOLOAN": "无单期借款", "NO_SINGLE": "无单期"}
USE_RATE_LABELS = {"1": "高额度使用率", "2": "中额度使用率", "3": "低额度使用率"}
SCORE_LABELS = {"5": "A", "4": "B", "3": "C", "2": "D", "1": "E"}
NO_SAMPLE = "本批次无样本"
EXECUTION_BROKEN = "提额/未提额执行异常"
NO_COEFFICIENT = "无法映射系数表"
COEFFICIENT_OFF = "提额执行符合；系数需核对"
ALL_GOOD = "系数与提额执行均符合"


@dataclass(frozen=True)
class CodeBook:
    """Code -> policy label, per key part. The default keeps the codes themselves."""

    customer: dict[str, str] = field(default_factory=lambda: {k: k for k in CUSTOMER_LABELS})
    use_rate: dict[str, str] = field(default_factory=lambda: {k: k for k in USE_RATE_LABELS})
    score: dict[str, str] = field(default_factory=lambda: {k: k for k in SCORE_LABELS})

    @classmethod
    def labelled(cls) -> "CodeBook":
        return cls(CUSTOMER_LABELS, USE_RATE_LABELS, SCORE_LABELS)


def loan_count(x: Column | str, shift: int = 0) -> Column:
    """Whole count clamped to 1..7, where 7 stands for 7 and above; NULL if it is not a number."""
    n = F.floor(safe_double(x)).cast("int") + F.lit(shift)
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(7)))


def with_lookup_key(df: DataFrame, book: CodeBook = CodeBook()) -> DataFrame:
    """Policy key columns; all NULL when any part cannot be decoded."""
    parts = {
        "customer": F.try_element_at(code_map(book.customer), normalized_code(KEYS[0])),
        "use_rate": F.try_element_at(code_map(book.use_rate), normalized_code(KEYS[1])),
        "loan_cnt": loan_count(KEYS[2]),
        "score": F.try_element_at(code_map(book.score), normalized_code(KEYS[3])),
    }
    df = df.withColumns({f"_k_{n}": c for n, c in parts.items()})
    whole = " and ".join(f"_k_{n} is not null" for n in CELL)
    return df.withColumns({n: F.expr(f"if({whole}, _k_{n}, null)") for n in CELL}).drop(*[f"_k_{n}" for n in CELL])


def valid_population(df: DataFrame, with_caps: bool = False) -> DataFrame:
    """Rows whose limits before and after are known and not negative (for formula checks: rate and caps too)."""
    names = ["jq_credit_quota", "cash_quota_amount_now_after"]
    if with_caps:
        names += ["cash_remark1", "after_adjust_credit_limit", "credit_max_limit"]
    return df.where(" and ".join(f"cast({n} as double) >= 0" for n in names))


#: Columns of early default by horizon: customers (dd) that fell due and that defaulted.
HORIZON_COLUMNS = tuple(f"{h}_{part}_dd" for h in HORIZONS for part in ("fz", "fm"))


def strategy_cube(facts: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Six raw keys and the additive measures; the only pass over customers, combined before the shuffle.

    All four horizons are there; one whose columns the table lacks has NULL sums. The cube is written once: a lookup of
    its keys would otherwise move below the aggregate and decode the codes of every customer instead of every cell,
    and each further use would read the customers again.
    """
    before, after = "cast(jq_credit_quota as double)", "cast(cash_quota_amount_now_after as double)"
    measures = {
        "cnt": "count(1)",
        "before_sum": f"sum({before})",
        "after_sum": f"sum({after})",
        "increment_sum": f"sum({after} - {before})",
        "loan_sum": "sum(cast(loan_amount as double))",
        "next_prin_sum": "sum(cast(loan_prin as double))",
        "next_prin_cnt": "count_if(cast(loan_prin as double) > 0)",
        "actual_raise_cnt": f"count_if({after} > {before})",
        "actual_unchanged_cnt": f"count_if({after} = {before})",
        "actual_decrease_cnt": f"count_if({after} < {before})",
        "t0_cnt": "count_if(cast(next_curday_flag as bigint) = 1)",
        "next_loan_cnt": "count_if(cast(next_loan_flag as bigint) = 1)",
    }
    for h in HORIZONS:
        measures[f"{h}_num"] = f"sum(cast({h}_fz_dd as double))"
        measures[f"{h}_den"] = f"sum(cast({h}_fm_dd as double))"
    return cut_lineage(valid_population(with_absent(facts, HORIZON_COLUMNS)).groupBy(*extra_keys, *KEYS).agg(
        *[F.expr(f"{sql} as {name}") for name, sql in measures.items()]
    ))


def with_expected_rate(cube: DataFrame, policy: DataFrame, book: CodeBook = CodeBook()) -> DataFrame:
    """Left join of the policy rate to the cube; both are small, and the planner sees their sizes."""
    rates = policy.select(*CELL, F.col("target_rate").alias("expected_rate"))
    keyed = with_lookup_key(cube, book).join(rates, list(CELL), "left")
    return keyed.withColumns(
        {
            "flag": normalized_code("te_flag"),
            "actual_rate": safe_double("cash_remark1"),
            "is_mapped": F.col("expected_rate").isNotNull(),
        }
    ).withColumn(
        "rate_matches",
        F.expr(f"expected_rate is not null and actual_rate is not null and abs(actual_rate - expected_rate) < {SAME_RATE}"),
    )


def bucket_sums() -> list[Column]:
    """Additive figures of a bucket, split by raised (flag 1) and not raised (flag 0)."""
    sums: dict[str, str] = {
        "total_cnt": "sum(cnt)",
        "other_cnt": "sum(if(flag not in ('0', '1'), cnt, 0))",
        "actual_raise_cnt": "sum(actual_raise_cnt)",
        "actual_unchanged_cnt": "sum(actual_unchanged_cnt)",
        "actual_decrease_cnt": "sum(actual_decrease_cnt)",
        "match_cnt": "sum(if(flag = '1' and is_mapped and rate_matches, cnt, 0))",
        "mismatch_cnt": "sum(if(flag = '1' and is_mapped and not rate_matches, cnt, 0))",
        "raised_increment_sum": "sum(if(flag = '1', increment_sum, 0D))",
        "raised_actual_raise_cnt": "sum(if(flag = '1', actual_raise_cnt, 0))",
        "not_raised_unchanged_cnt": "sum(if(flag = '0', actual_unchanged_cnt, 0))",
        "zero_rate_raised_cnt":
            f"sum(if(flag = '1' and (actual_rate is null or abs(actual_rate) < {SAME_RATE}), actual_raise_cnt, 0))",
        "positive_rate_not_raised_cnt": "sum(if(flag = '0' and actual_rate > 0, cnt, 0))",
    }
    names = ["cnt", "before_sum", "after_sum", "loan_sum", "next_prin_sum", "next_prin_cnt", "t0_cnt", "next_loan_cnt"]
    names += [f"{h}_{part}" for h in HORIZONS for part in ("num", "den")]
    for prefix, flag in (("raised", "1"), ("not_raised", "0")):
        for n in names:
            zero = "0" if n.endswith("cnt") else "0D"
            sums[f"{prefix}_{n}"] = f"coalesce(sum(if(flag = '{flag}', {n}, {zero})), {zero})"
    return [F.expr(f"coalesce({sql}, 0) as {name}") for name, sql in sums.items()]


def buckets(joined: DataFrame) -> DataFrame:
    """Cell, mapped / unmapped and overall buckets in one aggregate (grouping sets)."""
    cell = [F.col(c) for c in CELL]
    df = joined.groupingSets(
        [[*cell, F.col("is_mapped")], [F.col("is_mapped")], []], *CELL, "is_mapped"
    ).agg(F.grouping_id().alias("_g"), *bucket_sums())
    kind = "case when _g = 0 then 'cell' when is_mapped is null then 'all' when is_mapped then 'mapped' else 'unmapped' end"
    return df.withColumn("bucket", F.expr(kind)).where("bucket <> 'cell' or is_mapped").drop("_g", "is_mapped")


def execution_figures(b: DataFrame) -> DataFrame:
    """Counts, averages, rates and the conclusion of every bucket. Amounts in cents become yuan."""
    df = b.selectExpr("*", "raised_cnt + not_raised_cnt as settled_cnt",
                      "raised_before_sum + not_raised_before_sum as before_sum",
                      "raised_after_sum + not_raised_after_sum as after_sum")
    ratios = {
        "raise_coverage": ("raised_cnt", "settled_cnt"),
        "coefficient_match_rate": ("match_cnt", "match_cnt + mismatch_cnt"),
        "raised_avg_before": ("raised_before_sum", "raised_cnt * 100"),
        "raised_avg_after": ("raised_after_sum", "raised_cnt * 100"),
        "raised_actual_rate": ("raised_increment_sum", "raised_before_sum"),
        "raised_avg_increment": ("raised_increment_sum", "raised_cnt * 100"),
        "not_raised_avg_before": ("not_raised_before_sum", "not_raised_cnt * 100"),
        "not_raised_avg_after": ("not_raised_after_sum", "not_raised_cnt * 100"),
        "settled_avg_before": ("before_sum", "settled_cnt * 100"),
        "settled_avg_after": ("after_sum", "settled_cnt * 100"),
        "settled_increase_rate": ("after_sum - before_sum", "before_sum"),
        "raised_t0_rate": ("raised_t0_cnt", "raised_cnt"),
        "not_raised_t0_rate": ("not_raised_t0_cnt", "not_raised_cnt"),
        "raised_next_loan_rate": ("raised_next_loan_cnt", "raised_cnt"),
        "not_raised_next_loan_rate": ("not_raised_next_loan_cnt", "not_raised_cnt"),
        "raised_actual_raise_rate": ("raised_actual_raise_cnt", "raised_cnt"),
        "not_raised_unchanged_rate": ("not_raised_unchanged_cnt", "not_raised_cnt"),
        "execution_rate": ("raised_actual_raise_cnt + not_raised_unchanged_cnt", "settled_cnt"),
        "raised_avg_loan": ("raised_loan_sum", "raised_cnt * 100"),
        "raised_avg_next_loan": ("raised_next_prin_sum", "raised_next_prin_cnt"),
        "raised_next_use_rate": ("raised_next_prin_sum", "raised_after_sum / 100"),
        "not_raised_avg_loan": ("not_raised_loan_sum", "not_raised_cnt * 100"),
        "not_raised_avg_next_loan": ("not_raised_next_prin_sum", "not_raised_next_prin_cnt"),
        "not_raised_next_use_rate": ("not_raised_next_prin_sum", "not_raised_after_sum / 100"),
    }
    for h in HORIZONS:
        ratios[f"raised_{h}_rate"] = (f"raised_{h}_num", f"raised_{h}_den")
        ratios[f"not_raised_{h}_rate"] = (f"not_raised_{h}_num", f"not_raised_{h}_den")
    counts = [
        "settled_cnt", "raised_cnt", "not_raised_cnt", "other_cnt", "match_cnt", "mismatch_cnt",
        "positive_rate_not_raised_cnt", "zero_rate_raised_cnt", "actual_raise_cnt", "actual_unchanged_cnt",
        "actual_decrease_cnt",
    ]
    counts += [f"{p}_{h}_den" for h in HORIZONS for p in ("raised", "not_raised")]
    keys = [c for c in (*CELL, "bucket", "expected_rate") if c in b.columns]
    out = df.selectExpr(
        *keys,
        *[f"cast({c} as bigint) as {c}" for c in counts],
        *[f"try_divide(cast({n} as double), cast({d} as double)) as {name}" for name, (n, d) in ratios.items()],
    )
    return out.withColumn("conclusion", F.expr(conclusion_sql()))


def conclusion_sql() -> str:
    return (
        f"case when settled_cnt = 0 then '{NO_SAMPLE}' when execution_rate < 1 then '{EXECUTION_BROKEN}' "
        f"when coefficient_match_rate is null then '{NO_COEFFICIENT}' "
        f"when coefficient_match_rate < 1 then '{COEFFICIENT_OFF}' else '{ALL_GOOD}' end"
    )


def cell_report(joined: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per policy cell, also for cells nobody fell into."""
    sums = joined.where("is_mapped").groupBy(*CELL).agg(*bucket_sums())
    figures = [c for c in sums.columns if c not in CELL]
    full = policy.select(*CELL, F.col("target_rate").alias("expected_rate")).join(sums, list(CELL), "left")
    filled = full.select(*CELL, "expected_rate", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in figures])
    return execution_figures(filled)


def cells_by_strategy(facts: DataFrame, policy: DataFrame, strategies: Sequence[str], strategy: str = "str_type",
                      book: CodeBook = CodeBook()) -> DataFrame:
    """Every policy cell once per strategy, also where a strategy has nobody in it."""
    rows = facts.where(F.col(strategy).isin(*strategies))
    keyed = with_lookup_key(strategy_cube(rows, (strategy,)), book).withColumn("flag", normalized_code("te_flag"))
    sums = keyed.groupBy(strategy, *CELL).agg(
        F.expr("sum(cnt) as _n"), F.expr("sum(if(flag = '1', cnt, 0)) as _r"),
        F.expr("sum(if(flag = '1', before_sum, 0D)) as _b"), F.sum("next_loan_cnt").alias("_nl"), F.sum("t0_cnt").alias("_t0"))
    cells = policy.select("*", F.explode(F.array(*[F.lit(s) for s in strategies])).alias(strategy))
    return cells.join(sums, [strategy, *CELL], "left").selectExpr(
        strategy, *CELL, "target_rate", "coalesce(_n, 0) as settled_cnt", "coalesce(_r, 0) as raised_cnt",
        "try_divide(_b, _r) / 100 as raised_avg_before", "try_divide(_nl, _n) as next_loan_rate", "try_divide(_t0, _n) as t0_rate")


def overall_report(joined: DataFrame, target: float = TARGET_AVERAGE) -> DataFrame:
    """Whole, mapped and unmapped population with the attainment of the target average."""
    b = buckets(joined).where("bucket <> 'cell'").drop(*CELL)
    df = execution_figures(b)
    t = f"{float(target)}D"
    return df.selectExpr(
        "*",
        f"{t} as target_average",
        f"coalesce(settled_avg_before, 0D) / {t} as before_attainment",
        f"coalesce(settled_avg_after, 0D) / {t} as after_attainment",
        f"{t} - coalesce(settled_avg_after, 0D) as average_gap",
        "(coalesce(settled_avg_after, 0D) - coalesce(settled_avg_before, 0D)) * settled_cnt as actual_increment_total",
        f"({t} - coalesce(settled_avg_before, 0D)) * settled_cnt as needed_increment_total",
    ).withColumn(
        "increment_attainment", F.expr("try_divide(actual_increment_total, needed_increment_total)")
    )


def rate_distribution(joined: DataFrame, raised_only: bool = True) -> DataFrame:
    """Configured rates and customer counts of every mapped cell, as a map and as ordered text."""
    rows = joined.where("is_mapped" + (" and flag = '1'" if raised_only else ""))
    two = rows.groupBy(*CELL, "actual_rate").agg(F.sum("cnt").alias("n"))
    label = "coalesce(regexp_replace(string(bround(actual_rate, 6)), '[.]0$', ''), 'null')"
    listed = two.groupBy(*CELL).agg(F.expr(
        f"array_sort(collect_list(named_struct('r', actual_rate, 'label', {label}, 'n', n))) as _d"
    ))
    return listed.selectExpr(
        *CELL,
        "map_from_entries(transform(_d, e -> struct(e.label, e.n))) as distribution",
        "array_join(transform(_d, e -> concat(e.label, ':', e.n)), '; ') as distribution_text",
    )


def coefficient_by_flag(joined: DataFrame) -> DataFrame:
    """Match / mismatch / no lookup and actual moves per flag and in total."""
    return joined.groupingSets([[F.col("flag")], []], "flag").agg(
        F.grouping("flag").alias("_g"),
        F.expr("sum(cnt) as total"),
        F.expr("sum(if(is_mapped and rate_matches, cnt, 0)) as coefficient_match"),
        F.expr("sum(if(is_mapped and not rate_matches, cnt, 0)) as coefficient_mismatch"),
        F.expr("sum(if(is_mapped, 0, cnt)) as no_lookup"),
        F.sum("actual_raise_cnt").alias("actual_raise_cnt"),
        F.sum("actual_unchanged_cnt").alias("actual_unchanged_cnt"),
        F.sum("actual_decrease_cnt").alias("actual_decrease_cnt"),
    ).withColumn("flag", F.expr("if(_g = 1, 'all', flag)")).drop("_g")


def coefficient_by_loan_count(joined: DataFrame) -> DataFrame:
    """Match and mismatch per loan count; 7 includes everything above."""
    source = normalized_code(KEYS[2])
    bucket = F.when(source.isin(*[str(i) for i in range(1, 8)]), source).otherwise(F.lit("7 (including 7+)"))
    return joined.where("is_mapped").groupBy(bucket.alias("loan_bucket")).agg(
        F.expr("sum(if(rate_matches, cnt, 0)) as coefficient_match"),
        F.expr("sum(if(rate_matches, 0, cnt)) as coefficient_mismatch"),
    )


def cell_check(joined: DataFrame, policy: DataFrame) -> DataFrame:
    """Per cell: coefficient and execution consistency; unmapped rows form one cell, unobserved cells are added."""
    agg = joined.groupBy(*[F.expr(f"if(is_mapped, {c}, null) as {c}") for c in CELL], "is_mapped").agg(
        F.max("expected_rate").alias("expected_rate"),
        F.expr("sum(cnt) as total_cnt"),
        F.expr("sum(if(is_mapped and rate_matches, cnt, 0)) as match_cnt"),
        F.expr("sum(if(is_mapped and not rate_matches, cnt, 0)) as mismatch_cnt"),
        F.expr("sum(if(flag = '0', cnt, 0)) as te_flag_0_cnt"),
        F.expr("sum(if(flag = '1', cnt, 0)) as te_flag_1_cnt"),
        F.expr("sum(if(flag in ('0', '1'), 0, cnt)) as other_te_flag_cnt"),
        F.sum("actual_raise_cnt").alias("actual_raise_cnt"),
        F.sum("actual_unchanged_cnt").alias("actual_unchanged_cnt"),
        F.sum("actual_decrease_cnt").alias("actual_decrease_cnt"),
        F.expr("sum(case flag when '1' then actual_raise_cnt when '0' then actual_unchanged_cnt else 0 end)"
               " as consistent_cnt"),
        F.expr("sum(if(flag = '0' and actual_rate > 0, cnt, 0)) as positive_config_no_raise_cnt"),
        F.expr(f"sum(if(actual_rate is null or abs(actual_rate) < {SAME_RATE}, actual_raise_cnt, 0))"
               " as zero_config_actual_raise_cnt"),
    )
    observed = agg.where("is_mapped").select(*CELL)
    unseen = policy.select(*CELL, F.col("target_rate").alias("expected_rate")).join(observed, list(CELL), "left_anti")
    zero = {c: F.lit(0).cast("bigint") for c in agg.columns if c.endswith("_cnt") and c not in CELL}
    every = agg.unionByName(unseen.withColumns({"is_mapped": F.lit(True), **zero}))
    checked = every.selectExpr(
        *CELL, "expected_rate", *zero,
        "total_cnt - consistent_cnt as inconsistent_cnt",
        "try_divide(match_cnt, total_cnt) as match_rate",
        "try_divide(consistent_cnt, total_cnt) as consistency_rate",
        "case when total_cnt = 0 then 'no_customer_in_batch' when not is_mapped then 'unmapped' else 'observed' end"
        " as observation_status",
    )
    return checked.withColumns(
        {
            "coefficient_status": F.expr(status_sql("mismatch_cnt = 0")),
            "execution_status": F.expr(
                "case observation_status when 'no_customer_in_batch' then 'no_customer'"
                " else if(inconsistent_cnt = 0, 'match', 'mismatch') end"),
            "overall_status": F.expr(status_sql("mismatch_cnt = 0 and inconsistent_cnt = 0")),
        }
    )


def status_sql(good: str) -> str:
    return (
        "case observation_status when 'no_customer_in_batch' then 'no_customer' when 'unmapped' then 'unmapped'"
        f" else if({good}, 'match', 'mismatch') end"
    )


def top_groups(joined: DataFrame, mapped: bool, k: int = 100) -> DataFrame:
    """Largest mismatching (or unmapped) raw groups; the keys make the order total."""
    cond = "is_mapped and not rate_matches" if mapped else "not is_mapped"
    return (
        joined.where(cond).select(*KEYS, "cnt", "expected_rate")
        .orderBy(F.desc("cnt"), *[F.asc(k_) for k_ in KEYS]).limit(k)
    )


def by_volume(cells: DataFrame) -> DataFrame:
    """Cell report in reading order: largest cells first, then the key."""
    return cells.orderBy(F.desc("total_cnt"), *[F.asc(c) for c in CELL])


def top_mismatch_cells(cells: DataFrame, k: int = 10) -> DataFrame:
    return cells.where("mismatch_cnt > 0").orderBy(F.desc("mismatch_cnt"), *[F.asc(c) for c in CELL]).limit(k)
