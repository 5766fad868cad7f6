"""Limit-raise plans over a segment grid: rate rules, eligibility, exact scaling to a target, scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

GRID_KEYS = ("flag_customer", "use_rate", "loan_cnt", "score_level")

# Risk tiers (upper bound of the default rate, multiplier or rate, name).
FIVE_TIERS = (
    (0.05, 2.5, "T1_超低风险(<5%)"),
    (0.10, 2.0, "T2_低风险(5-10%)"),
    (0.20, 1.5, "T3_中低风险(10-20%)"),
    (0.30, 1.2, "T4_中风险(20-30%)"),
    (None, 1.0, "T5_高风险(>=30%)"),
)
TEN_BOUNDS = (0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30, None)
TEN_NAMES = ("T1_<2%", "T2_2-4%", "T3_4-6%", "T4_6-8%", "T5_8-10%", "T6_10-15%", "T7_15-20%", "T8_20-25%",
             "T9_25-30%", "T10_>=30%")
TEN_RATES = (3.00, 2.60, 2.20, 1.80, 1.50, 1.20, 0.90, 0.60, 0.30, 0.00)
TEN_MULTIPLIERS = (5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.7, 0.5)
TEN_RISK_COEFFICIENTS = (1.00, 0.95, 0.90, 0.85, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30)
AMOUNT_CAP = 80_000.0
QUOTA_CAP = 500_000.0
RATE_CEILING = 3.0
NO_CAP = 1e12


def tier_sql(x: str, bounds: Sequence[float | None], values: Sequence[object]) -> str:
    """First tier whose upper bound lies above x; the last takes the rest."""
    lit = [f"'{v}'" if isinstance(v, str) else f"{float(v)}D" for v in values]
    steps = " ".join(f"when {x} < {b}D then {v}" for b, v in zip(bounds[:-1], lit))
    return f"case {steps} else {lit[-1]} end"


def with_five_tiers(grid: DataFrame) -> DataFrame:
    bounds = [t[0] for t in FIVE_TIERS]
    return grid.withColumns(
        {
            "tier": F.expr(tier_sql("fpd7_rate", bounds, [t[2] for t in FIVE_TIERS])),
            "tier_multiplier": F.expr(tier_sql("fpd7_rate", bounds, [t[1] for t in FIVE_TIERS])),
        }
    )


def with_ten_tiers(grid: DataFrame) -> DataFrame:
    return grid.withColumns(
        {
            "tier10": F.expr(tier_sql("fpd7_rate", TEN_BOUNDS, TEN_NAMES)),
            "tier10_rate": F.expr(tier_sql("fpd7_rate", TEN_BOUNDS, TEN_RATES)),
            "tier10_multiplier": F.expr(tier_sql("fpd7_rate", TEN_BOUNDS, TEN_MULTIPLIERS)),
            "risk_coefficient": F.expr(tier_sql("fpd7_rate", TEN_BOUNDS, TEN_RISK_COEFFICIENTS)),
        }
    )


def portfolio(grid: DataFrame, risk: str = "fpd7_rate") -> DataFrame:
    """One row: customers, amount, average limit and amount-weighted risk."""
    return grid.agg(
        F.expr("sum(settled) as customers"),
        F.expr("sum(settled * settled_avg_limit) as amount"),
        F.expr("sum(settled * settled_avg_limit) / sum(settled) as avg_limit"),
        F.expr(f"sum(settled * settled_avg_limit * coalesce({risk}, 0D)) / sum(settled * settled_avg_limit) as risk"),
    )


def with_eligibility(grid: DataFrame, levels: Sequence[str], conditional: str | None = None) -> DataFrame:
    """Score levels that may be raised; ``conditional`` is a level admitted below the portfolio's risk. A rate
    cap of 0 closes a cell."""
    listed = ", ".join(f"'{x}'" for x in levels)
    cond = f"score_level in ({listed})"
    if conditional is not None:
        grid = grid.withColumn("_risk", portfolio(grid).select("risk").scalar())
        cond = f"({cond} or (score_level = '{conditional}' and fpd7_rate < _risk))"
    return grid.withColumn("eligible", F.expr(f"coalesce({cond} and rate_cap > 0, false)")).drop("_risk")


def amount_cap_rate(avg: str) -> str:
    """Rate cap that an absolute raise cap and an absolute limit cap allow."""
    return f"greatest(least(try_divide({AMOUNT_CAP}D, {avg}), try_divide({QUOTA_CAP}D, {avg}) - 1), 0D)"


def limit_cap_rate(avg: str, cap: str) -> str:
    return f"if({avg} > 0, greatest(({cap} - {avg}) / {avg}, 0D), 0D)"


# Use-rate caps and bases by use-rate code (1 high, 2 medium, 3 low). Fixed values.
USE_RATE_CAPS = {"1": 1.00, "2": 0.80, "3": 0.30}
USE_RATE_BASES = {"1": 2.8, "2": 2.6, "3": 0.6}
TIER_RATES = (1.00, 0.80, 0.50, 0.30, 0.10)


def by_use_rate(values: dict[str, float]) -> str:
    return "case use_rate " + " ".join(f"when '{k}' then {v}D" for k, v in values.items()) + " end"


@dataclass(frozen=True)
class RateRule:
    """rate(k) = min(slope * k, ceiling): the shape of every rule. Both parts are column expressions.

    A rule without a bound has the ceiling NO_CAP; ``scaled_ceiling`` also scales the ceiling.
    """

    name: str
    slope: str
    ceiling: str = f"{NO_CAP}D"

    def rate(self, k: str = "1D") -> str:
        return f"least(({self.slope}) * {k}, {self.ceiling})"


def rule_book() -> dict[str, RateRule]:
    """The rate rules by name. They expect the tier columns and ``rate_cap`` on the grid."""
    use_cap, use_base = by_use_rate(USE_RATE_CAPS), by_use_rate(USE_RATE_BASES)
    tier_rate = tier_sql("fpd7_rate", [t[0] for t in FIVE_TIERS], TIER_RATES)
    rules = [
        RateRule("tier_with_use_cap", tier_rate, use_cap),
        RateRule("tier_use_and_table_cap", tier_rate, f"least({use_cap}, rate_cap)"),
        RateRule("tier_with_table_cap", tier_rate, "rate_cap"),
        RateRule("table_cap", "rate_cap"),
        RateRule("table_cap_by_tier", "rate_cap * tier_multiplier"),
        RateRule("ten_tier_rate", "tier10_rate"),
        RateRule("amount_cap_by_ten_tiers", f"{amount_cap_rate('settled_avg_limit')} * tier10_multiplier"),
        RateRule("use_base_by_risk", f"least({use_base} * risk_coefficient, {RATE_CEILING}D)"),
        RateRule("use_base_by_risk_capped", f"{use_base} * risk_coefficient", "rate_cap"),
    ]
    return {r.name: r for r in rules}


def increment_sql(rate: str, cap: str = "limit_cap") -> str:
    """Raised customers times what the rate adds to their limit, below the limit cap."""
    return (
        f"coalesce(raised * greatest(least(raised_avg_limit * (1 + {rate}), {cap}) - raised_avg_limit, 0D), 0D)"
    )


def apply_rule(grid: DataFrame, rule: RateRule, k: Column | float = 1.0, cap: str = "limit_cap") -> DataFrame:
    """Grid with rate, limit after the raise and increment for scale k."""
    k_col = k if isinstance(k, Column) else F.lit(float(k))
    df = grid.withColumn("k", k_col).withColumn("rate", F.expr(f"if(eligible, {rule.rate('k')}, 0D)"))
    return df.withColumns(
        {
            "new_limit": F.expr(f"least(raised_avg_limit * (1 + rate), {cap})"),
            "increment": F.expr(increment_sql("rate", cap)),
        }
    )


def needed_increment(grid: DataFrame, target: float) -> Column:
    """Increment that lifts the average limit to the target."""
    return grid.agg(F.expr(f"{float(target)}D * sum(settled) - sum(settled * settled_avg_limit)")).scalar()


def solve_scale(
    grid: DataFrame, rule: RateRule, target: float, lo: float = 0.0, hi: float = 20.0, cap: str = "limit_cap",
    by: Sequence[str] = (),
) -> DataFrame:
    """Scale k at which the total increment equals what the target needs, solved exactly.

    A cell adds base * min(slope * k, bound): linear up to its break point bound / slope, flat after it. With the
    cells sorted by break point, running sums give the total on every piece, and the piece that contains the
    need is solved by one division. The grid has one row per policy cell, which bounds the ordered window; ``by``
    solves several scenarios side by side. Out of reach: ``reached`` is false and k is the bracket end.
    """
    keys = list(by)
    room = f"least({rule.ceiling}, greatest({cap} / raised_avg_limit - 1, 0D))"
    cells = grid.where("eligible and raised > 0 and raised_avg_limit > 0").selectExpr(
        *keys, "raised * raised_avg_limit as _b", f"double({rule.slope}) as _m", f"double({room}) as _c"
    ).where("_m > 0 and _c > 0").selectExpr(*keys, "_b * _m as _w", "_b * _c as _full", "_c / _m as _brk")
    # Equal break points are one step.
    steps = cells.groupBy(*keys, "_brk").agg(F.sum("_w").alias("_w"), F.sum("_full").alias("_full"))
    up = W.partitionBy(*keys).orderBy("_brk").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy("_brk").rowsBetween(0, W.unboundedFollowing)
    pieces = steps.select(
        *keys, "_brk",
        F.coalesce(F.max("_brk").over(up), F.lit(0.0)).alias("_from"),
        F.coalesce(F.sum("_full").over(up), F.lit(0.0)).alias("_flat"),
        F.sum("_w").over(down).alias("_slope"),
    )
    if keys:
        needs = grid.groupBy(*keys).agg(
            F.expr(f"{float(target)}D * sum(settled) - sum(settled * settled_avg_limit) as need"))
        pieces = pieces.join(needs, keys)
    else:
        pieces = pieces.withColumn("need", needed_increment(grid, target))
    solved = pieces.selectExpr(
        *keys, "need", "_brk", "_flat + _slope * _brk as _at_end", "_flat + _slope * _from as _at_start",
        "(need - _flat) / _slope as _k",
    )
    inside = "need > _at_start and need <= _at_end"
    one = solved.groupBy(*keys, "need").agg(
        F.expr(f"min(_k) filter (where {inside})").alias("_k"), F.max("_at_end").alias("max_increment")
    )
    k = f"case when need <= {lo}D then {lo}D when _k is null then {hi}D else least(greatest(_k, {lo}D), {hi}D) end"
    return one.selectExpr(
        *keys, "need", "max_increment", f"{k} as k", f"need > 0 and _k is not null and _k between {lo}D and {hi}D as reached"
    )


def full_scale(grid: DataFrame, rule: RateRule, limit: float = 3.0) -> DataFrame:
    """Smallest k at which every eligible cell touches its ceiling, and how many touch it."""
    k = grid.where("eligible").agg(
        F.expr(f"least(max(try_divide({rule.ceiling}, {rule.slope})), {limit}D)").alias("k")).select("k")
    touched = grid.withColumn("_k", k.scalar()).where("eligible").agg(
        F.max("_k").alias("k_star"),
        F.expr(f"count_if(({rule.slope}) * _k >= {rule.ceiling} - 1e-9) as touched_cells"),
        F.count(F.lit(1)).alias("eligible_cells"),
    )
    return touched


def solved_plan(grid: DataFrame, rule: RateRule, target: float, lo: float = 0.0, hi: float = 20.0) -> DataFrame:
    k = solve_scale(grid, rule, target, lo, hi).select("k").scalar()
    return apply_rule(grid, rule, k)


def plan_details(plan: DataFrame, rule: RateRule) -> DataFrame:
    """Which constraint bound each cell, whether it touched a cap, and the reason as text: risk, the cap of the rate
    times multiplier times k, the raise that came out and the limit after it."""

    def pct(x: str, digits: int = 0) -> str:
        return f"coalesce(concat(string(bround({x} * 100, {digits})), '%'), 'unknown')"

    money = "coalesce(format_number({0}, 0), 'unknown')"
    return plan.withColumns(
        {
            "hit_rate_ceiling": F.expr(f"eligible and ({rule.slope}) * k >= {rule.ceiling} - 1e-9"),
            "hit_limit_cap": F.expr("eligible and raised_avg_limit * (1 + rate) > limit_cap + 1e-6"),
        }
    ).withColumns(
        {
            "bound_by": F.expr(
                "array_join(array_compact(array(if(not eligible, 'eligibility', null),"
                " if(hit_rate_ceiling, 'rate', null), if(hit_limit_cap, 'limit', null))), '+')"),
            "reason": F.expr(
                "case when not eligible then concat('score_level=', score_level, ', not eligible')"
                " when increment <= 0 then concat('score_level=', score_level, ', no room below the limit cap ', "
                f"{money.format('limit_cap')})"
                f" else concat('score_level=', score_level, ', fpd7 ', {pct('fpd7_rate', 1)}, ' (', tier, '), rate cap ', "
                f"{pct('rate_cap')}, ' x ', string(tier_multiplier), ' x ', format_string('%.2f', k), ' -> raise ', "
                f"{pct('rate')}, ', limit after ', {money.format('new_limit')}, if(hit_limit_cap, ' (limit cap)', '')) end"),
        }
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """Averages, increment, growth, risk before and after, excluded customers, median cap, bound cells."""
    return plan.agg(
        F.expr("sum(settled) as customers"),
        F.expr("sum(settled * settled_avg_limit) / sum(settled) as avg_before"),
        F.expr("(sum(settled * settled_avg_limit) + sum(increment)) / sum(settled) as avg_after"),
        F.expr("sum(increment) as increment"),
        F.expr("sum(increment) / sum(settled * settled_avg_limit) as growth"),
        F.expr("sum(settled * settled_avg_limit * coalesce(fpd7_rate, 0D)) / sum(settled * settled_avg_limit)"
               " as risk_before"),
        F.expr("sum((settled * settled_avg_limit + increment) * coalesce(fpd7_rate, 0D))"
               " / sum(settled * settled_avg_limit + increment) as risk_after"),
        F.expr("sum(if(eligible, 0, raised)) as excluded_customers"),
        F.expr("median(limit_cap) as median_limit_cap"),
        F.expr("count_if(hit_rate_ceiling) as rate_bound_cells"),
        F.expr("count_if(hit_limit_cap) as limit_bound_cells"),
    )


def waterfall(grid: DataFrame) -> DataFrame:
    """Increment as constraints are added one by one, with the loss of each step."""
    steps = [
        ("unconstrained", increment_sql("1D", f"{NO_CAP}D")),
        ("rate_cap", increment_sql("rate_cap", f"{NO_CAP}D")),
        ("eligibility", increment_sql("if(eligible, rate_cap, 0D)", f"{NO_CAP}D")),
        ("limit_cap", increment_sql("if(eligible, rate_cap, 0D)", "limit_cap")),
    ]
    sums = grid.agg(*[F.expr(f"sum({sql}) as s{i}") for i, (_, sql) in enumerate(steps)])
    rows = ", ".join(
        f"named_struct('step', {i}, 'constraint', '{name}', 'increment', s{i}, "
        f"'loss', {'cast(null as double)' if i == 0 else f's{i - 1} - s{i}'})"
        for i, (name, _) in enumerate(steps)
    )
    return sums.select(F.expr(f"inline(array({rows}))"))


def with_scenarios(grid: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Repeat every grid row per scenario. Scenarios are settings: a short literal list, no join."""
    rows = []
    for i, s in enumerate(scenarios):
        fields = ", ".join(
            f"'{n}', {v!r}" if isinstance(v, str) else f"'{n}', {float(v)}D" for n, v in s.items()
        )
        rows.append(f"named_struct('scenario', {i}, {fields})")
    return grid.select("*", F.expr(f"inline(array({', '.join(rows)}))"))


def cap_sensitivity(
    grid: DataFrame, target: float, rate_mults=(1.0, 1.25, 1.5, 2.0, 3.0), limit_mults=(1.0, 1.5, 2.0)
) -> DataFrame:
    """Reachable average and increment when the rate cap and the limit cap are relaxed."""
    cases = [{"rate_mult": r, "limit_mult": q} for r in rate_mults for q in limit_mults]
    tier_rate = tier_sql("fpd7_rate", [t[0] for t in FIVE_TIERS], TIER_RATES)
    rate = f"least({tier_rate}, {by_use_rate(USE_RATE_CAPS)}, rate_cap * rate_mult)"
    inc = increment_sql(rate, "limit_cap * limit_mult")
    return with_scenarios(grid, cases).groupBy("rate_mult", "limit_mult").agg(
        F.expr(f"sum({inc}) as increment"),
        F.expr(f"(sum(settled * settled_avg_limit) + sum({inc})) / sum(settled) as avg_after"),
    ).withColumn("reaches_target", F.col("avg_after") >= F.lit(float(target)))


def relaxation(grid: DataFrame, target: float, mults=(1.0, 1.2, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Reachable average when every eligible cell is filled to a relaxed rate cap."""
    inc = increment_sql("if(eligible, rate_cap * mult, 0D)")
    return with_scenarios(grid, [{"mult": m} for m in mults]).groupBy("mult").agg(
        F.expr(f"sum({inc}) as increment"),
        F.expr(f"(sum(settled * settled_avg_limit) + sum({inc})) / sum(settled) as avg_after"),
    ).withColumn("reaches_target", F.col("avg_after") >= F.lit(float(target)))


def smallest_relaxation(grid: DataFrame, target: float, hi: float = 3.0) -> DataFrame:
    """Smallest multiplier of the rate cap that reaches the target: the scale of the table-cap rule."""
    return solve_scale(grid, rule_book()["table_cap"], target, 1.0, hi)


def base_search(
    grid: DataFrame, target: float, highs=(2.4, 2.6, 2.8, 3.0), mediums=(2.0, 2.2, 2.4, 2.6),
    lows=(0.6, 0.7, 0.8, 0.9),
) -> DataFrame:
    """Grid of use-rate bases, each solved for its scale; scenarios that need k above 1 are dropped.

    Ranked by the low-use contribution, then the largest rate, then the medium-use contribution downwards.
    """
    cases = [{"high": h, "medium": m, "low": lo} for h in highs for m in mediums for lo in lows]
    grids = with_scenarios(grid, cases)
    slope = f"least(case use_rate when '1' then high when '2' then medium else low end * risk_coefficient, {RATE_CEILING}D)"
    rule = RateRule("scenario", slope)
    names = ["scenario", "high", "medium", "low"]
    scale = solve_scale(grids, rule, target, 0.2, 1.0, by=names).where("reached").select(*names, "k")
    solved = grids.join(F.broadcast(scale), names).withColumn("rate", F.expr(f"if(eligible, {rule.rate('k')}, 0D)"))
    inc = increment_sql("rate")
    return solved.groupBy(*names, "k").agg(
        F.expr(f"sum({inc}) as increment"), F.expr("max(rate) as largest_rate"),
        *[F.expr(f"coalesce(sum({inc}) filter (where use_rate = '{c}'), 0D) as {n}_increment")
          for n, c in (("high", "1"), ("medium", "2"), ("low", "3"))],
    )


def rank_bases(found: DataFrame, k: int = 15) -> DataFrame:
    return found.orderBy(
        F.asc("low_increment"), F.asc("largest_rate"), F.desc("medium_increment"), F.asc("scenario")
    ).limit(k)


def tier_statistics(plan: DataFrame, key: str = "tier") -> DataFrame:
    """Customers, weighted cap and rate, increment and weighted risk per tier or use rate."""
    return plan.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"),
        F.expr("sum(settled) as settled"), F.expr("sum(raised) as raised"),
        F.expr("try_divide(sum(raised * rate_cap), sum(raised)) as avg_rate_cap"),
        F.expr("try_divide(sum(raised * rate), sum(raised)) as avg_rate"),
        F.expr("sum(increment) as increment"),
        F.expr("try_divide(sum(settled * settled_avg_limit * coalesce(fpd7_rate, 0D)),"
               " sum(settled * settled_avg_limit)) as weighted_risk"),
    )


def plan_statistics(plan: DataFrame) -> DataFrame:
    """The same figures over five key sets in one pass."""
    keys = ("score_level", "use_rate", "loan_cnt", "flag_customer")
    c = {k: F.col(k) for k in keys}
    sets = [[c["score_level"]], [c["use_rate"]], [c["loan_cnt"]], [c["flag_customer"]],
            [c["score_level"], c["use_rate"]]]
    df = plan.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_g"),
        F.expr("sum(settled) as settled"), F.expr("sum(raised) as raised"),
        F.expr("sum(settled * settled_avg_limit) as _a0"), F.expr("sum(increment) as increment"),
        F.expr("sum(raised * raised_avg_limit) as _r0"),
    )
    names = {7: "score_level", 11: "use_rate", 13: "loan_cnt", 14: "flag_customer", 3: "score_level x use_rate"}
    kind = "case _g " + " ".join(f"when {g} then '{n}'" for g, n in names.items()) + " end"
    return df.selectExpr(
        f"{kind} as key_set", "concat_ws('_', score_level, use_rate, string(loan_cnt), flag_customer) as key_value",
        "settled", "raised", "raised / settled as raised_share", "_a0 / settled as avg_before",
        "(_a0 + increment) / settled as avg_after", "increment / settled as avg_gain", "increment",
        "coalesce(try_divide(increment, _r0), 0D) as weighted_rate",
    )


def rate_matrix(plan: DataFrame) -> DataFrame:
    """Weighted rate by use rate and ten risk tiers."""
    return plan.where("eligible").groupBy("use_rate").pivot("tier10", list(TEN_NAMES)).agg(
        F.expr("try_divide(sum(raised * rate), sum(raised)) * 100")
    )


def compare_samples(samples: dict[str, DataFrame]) -> DataFrame:
    """The same plan on several samples, with and without the use-rate cap."""
    union: DataFrame | None = None
    for name, grid in samples.items():
        part = grid.withColumn("sample", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    tier_rate = tier_sql("fpd7_rate", [t[0] for t in FIVE_TIERS], TIER_RATES)
    base = f"least({tier_rate}, rate_cap)"
    both = with_scenarios(union, [{"use_cap": "with"}, {"use_cap": "without"}])
    rate = f"if(use_cap = 'with', least({base}, {by_use_rate(USE_RATE_CAPS)}), {base})"
    return both.groupBy("sample", "use_cap").agg(F.expr(f"sum({increment_sql(rate)}) as increment"))


# --- plans on scored bins -------------------------------------------------------------------------------------

PENETRATIONS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
COVERS = (0.50, 0.65, 0.80)
TIER_EDGES = (0.25, 0.50)
# Raise ratios per tier of the four plans.
RATIO_PLANS = {
    "S1_温和": (0.50, 0.30, 0.15),
    "S2_进取": (0.60, 0.40, 0.20),
    "S3_积极": (0.70, 0.50, 0.25),
    "S4_优选": (0.80, 0.40, 0.15),
}


def segment_baseline(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """Rows, amount, average loan and default rate per segment."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.expr("sum(curr_loan_prin) as amount"),
        F.expr("try_divide(sum(fpd7_fz_dd), sum(fpd7_fm_dd)) as fpd7_dd"),
    ).withColumn("avg_loan", F.expr("amount / rows"))


def span_days(df: DataFrame, time_col: str, period: int = 7) -> DataFrame:
    """Days covered by the sample; the last period start reaches to the end of its period."""
    return df.agg(F.expr(f"datediff(max({time_col}), min({time_col})) + {period} as span_days"))


def penetration_sensitivity(
    suggestions: DataFrame, baseline: DataFrame, span: DataFrame, keys: Sequence[str], penetrations=(0.1, 0.3, 0.5, 1.0)
) -> DataFrame:
    """New amount, scale and mixed default rate for several take-up shares."""
    joined = suggestions.join(baseline.select(*keys, "amount"), list(keys), "left").selectExpr(
        "bin_avg_loan * bin_rows as bin_amount", "suggested_ratio", "bin_fpd7_dd", "bin_rows"
    )
    up = joined.agg(
        F.expr("sum(bin_amount * suggested_ratio) as up_amount"),
        F.expr("try_divide(sum(bin_amount * bin_fpd7_dd), sum(bin_amount)) as up_rate"),
        F.expr("sum(bin_rows) as up_rows"),
    )
    base = baseline.agg(
        F.expr("sum(amount) as amount"), F.expr("sum(amount * fpd7_dd) / sum(amount) as rate"),
    ).select(F.struct("*"))
    row = up.withColumn("_b", base.scalar()).withColumn("_days", span.scalar())
    return with_scenarios(row, [{"penetration": p} for p in penetrations]).selectExpr(
        "penetration", "up_rows", "up_amount * penetration as new_amount",
        "up_amount * penetration / _b.amount as scale_up",
        "up_amount * penetration / _days as new_per_day", "up_amount * penetration / _days * 30 as new_per_month",
        "(_b.amount * _b.rate + up_amount * penetration * up_rate) / (_b.amount + up_amount * penetration) as mixed_rate",
    )


def plan_search(
    best_bins: DataFrame, span: DataFrame, target_daily: float, max_rate: float, covers=COVERS, plans=None,
    penetrations=PENETRATIONS,
) -> DataFrame:
    """All cover x ratio plan x take-up combinations over the best model's bins, with whether they qualify."""
    plans = plans or RATIO_PLANS
    cases = [
        {"cover": c, "plan": n, "r1": r[0], "r2": r[1], "r3": r[2], "penetration": p}
        for c in covers for n, r in plans.items() for p in penetrations
    ]
    rows = best_bins.select("loan_amount", "fpd7_dd", "fpd7_dd_lift", "cnt")
    many = with_scenarios(rows, cases).where("fpd7_dd_lift < cover")
    ratio = f"case when fpd7_dd_lift < {TIER_EDGES[0]} then r1 when fpd7_dd_lift < {TIER_EDGES[1]} then r2 else r3 end"
    found = many.groupBy("scenario", "cover", "plan", "penetration").agg(
        F.expr(f"sum(loan_amount * {ratio} * penetration) as new_amount"),
        F.expr("try_divide(sum(loan_amount * fpd7_dd), sum(loan_amount)) as new_rate"),
        F.expr("sum(cnt) as customers"),
    )
    return found.withColumn("new_per_day", F.col("new_amount") / span.scalar()).withColumn(
        "qualifies", F.expr(f"new_per_day >= {float(target_daily)}D and new_rate <= {float(max_rate)}D")
    )


def best_plan(found: DataFrame) -> DataFrame:
    """Lowest new default rate, then the largest volume."""
    return found.where("qualifies").orderBy(F.asc("new_rate"), F.desc("new_per_day"), F.asc("scenario")).limit(1)


def plan_detail(best_bins: DataFrame, found: DataFrame, span: DataFrame, plans=None) -> DataFrame:
    """Bins of the winning plan with tier, ratio and daily amount."""
    plans = plans or RATIO_PLANS
    win = best_plan(found).select(F.struct("cover", "plan", "penetration")).scalar()

    def ratio(i: int) -> str:
        return "case _w.plan " + " ".join(f"when '{n}' then {r[i]}D" for n, r in plans.items()) + " end"

    tier = (
        f"case when fpd7_dd_lift < {TIER_EDGES[0]} then 'tier1' when fpd7_dd_lift < {TIER_EDGES[1]} then 'tier2'"
        " else 'tier3' end"
    )
    rows = best_bins.withColumn("_w", win).where("fpd7_dd_lift < _w.cover").withColumn("plan_tier", F.expr(tier))
    rows = rows.withColumn(
        "raise_ratio", F.expr(f"case plan_tier when 'tier1' then {ratio(0)} when 'tier2' then {ratio(1)}"
                              f" else {ratio(2)} end"))
    return rows.withColumn(
        "new_per_day", F.expr("loan_amount * raise_ratio * _w.penetration") / span.scalar()
    ).drop("_w")


def plan_tier_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("plan_tier").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("cnt").alias("customers"), F.sum("loan_amount").alias("loan_amount"),
        F.sum("new_per_day").alias("new_per_day"),
        F.expr("try_divide(sum(loan_amount * fpd7_dd), sum(loan_amount)) as rate"),
    )
