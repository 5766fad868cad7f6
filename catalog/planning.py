"""Registered queries: limit-raise plans over the segment grid and plans on scored bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import scoring as SC
from catalog.rounding import near, registry, rounded
from pathlift.operators import planning as P
from pathlift.session import cut_lineage
from pathlift.sources import tables as T
from pathlift.sources.fixtures import view, with_clause

QUERIES, ORACLE, register = registry()
_GRIDS: dict = {}
TARGET = 58_000.0
LEVELS = ("5", "4", "3")


def grid(spark, sf_dir):
    """The segment grid, stored once per session: plans read it many times, the loans behind it only once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRIDS:
        raw = cut_lineage(view(spark, sf_dir, "fx_segment_grid"))
        tiers = P.with_ten_tiers(P.with_five_tiers(raw))
        _GRIDS[key] = cut_lineage(P.with_eligibility(tiers, LEVELS))
    return _GRIDS[key]


def tier(values, bounds=P.TEN_BOUNDS, text=False) -> str:
    lit = [f"'{v}'" if text else f"CAST({v} AS DOUBLE)" for v in values]
    return "CASE " + " ".join(f"WHEN fpd7_rate < {b} THEN {v}" for b, v in zip(bounds[:-1], lit)) + f" ELSE {lit[-1]} END"


FIVE = [t[0] for t in P.FIVE_TIERS]
GRID = [
    *with_clause("fx_segment_grid"),
    f"""gr AS (SELECT *, {tier([t[2] for t in P.FIVE_TIERS], FIVE, True)} AS tier, {tier([t[1] for t in P.FIVE_TIERS], FIVE)} AS mult,
      {tier(P.TIER_RATES, FIVE)} AS trate, {tier(P.TEN_NAMES, text=True)} AS tier10, {tier(P.TEN_RATES)} AS t10r,
      {tier(P.TEN_MULTIPLIERS)} AS t10m, {tier(P.TEN_RISK_COEFFICIENTS)} AS rc,
      CASE use_rate WHEN '1' THEN 1.0 WHEN '2' THEN 0.8 ELSE 0.3 END AS ucap, CASE use_rate WHEN '1' THEN 2.8 WHEN '2' THEN 2.6 ELSE 0.6 END AS ubase,
      GREATEST(LEAST(80000 / settled_avg_limit, 500000 / settled_avg_limit - 1), 0) AS acap,
      score_level IN ('3', '4', '5') AND rate_cap > 0 AS ok FROM fx_segment_grid)""",
]


def inc(rate: str, cap: str = "limit_cap") -> str:
    return f"COALESCE(raised * GREATEST(LEAST(raised_avg_limit * (1 + {rate}), {cap}) - raised_avg_limit, 0), 0)"


def sql(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([*GRID, *extra]) + "\n" + select


@register("grid_balance", sql("""
SELECT COUNT(*) AS rows, CAST(MAX(ABS(settled - raised - not_raised)) AS DOUBLE) AS largest_gap, MAX(ABS(settled - raised - not_raised)) <= 1 AS within_tolerance FROM gr"""))
def grid_balance(spark, sf_dir):
    return T.balance_check(view(spark, sf_dir, "fx_segment_grid"), "settled", ("raised", "not_raised"), 1)


@register("grid_one_to_one", "WITH " + ", ".join(with_clause("fx_segment_grid", "fx_policy")) + """
SELECT COUNT(*) - COUNT(p.target_rate) AS rows_without_match,
  (SELECT COUNT(*) FROM (SELECT 1 FROM fx_segment_grid GROUP BY flag_customer, use_rate, loan_cnt, score_level HAVING COUNT(*) > 1)) AS repeated_left_keys,
  (SELECT COUNT(*) FROM (SELECT 1 FROM fx_policy GROUP BY customer, use_rate, loan_cnt, score HAVING COUNT(*) > 1)) AS repeated_right_keys
FROM fx_segment_grid g LEFT JOIN fx_policy p ON p.customer = g.flag_customer AND p.use_rate = g.use_rate AND p.loan_cnt = g.loan_cnt AND p.score = g.score_level""")
def grid_one_to_one(spark, sf_dir):
    policy = view(spark, sf_dir, "fx_policy").withColumnsRenamed({"customer": "flag_customer", "score": "score_level"})
    return T.one_to_one_check(view(spark, sf_dir, "fx_segment_grid"), policy, P.GRID_KEYS, "target_rate")


@register("grid_without_totals", sql("SELECT flag_customer, use_rate, CAST(SUM(settled) AS BIGINT) AS settled FROM gr GROUP BY 1, 2"))
def grid_without_totals(spark, sf_dir):
    """Sub-totals of a roll-up carry the word total, as in a spreadsheet, and are dropped again."""
    rolled = view(spark, sf_dir, "fx_segment_grid").rollup("flag_customer", "use_rate").agg(F.sum("settled").alias("settled"))
    marked = rolled.fillna("total", ["flag_customer", "use_rate"])
    return T.drop_totals(marked, ("flag_customer", "use_rate"))


@register("risk_tiers", sql("""
SELECT flag_customer, use_rate, loan_cnt, score_level, tier, mult AS tier_multiplier, tier10, t10r AS tier10_rate, t10m AS tier10_multiplier,
  rc AS risk_coefficient FROM gr"""))
def risk_tiers(spark, sf_dir):
    return grid(spark, sf_dir).select(*P.GRID_KEYS, "tier", "tier_multiplier", "tier10", "tier10_rate", "tier10_multiplier",
                                      "risk_coefficient")


@register("portfolio", sql("""
SELECT CAST(SUM(settled) AS BIGINT) AS customers, ROUND(SUM(settled * settled_avg_limit), 2) AS amount,
  ROUND(SUM(settled * settled_avg_limit) / SUM(settled), 6) AS avg_limit,
  ROUND(SUM(settled * settled_avg_limit * COALESCE(fpd7_rate, 0)) / SUM(settled * settled_avg_limit), 8) AS risk FROM gr"""))
def portfolio(spark, sf_dir):
    df = P.portfolio(grid(spark, sf_dir))
    return df.select("customers", near("amount", 2).alias("amount"), near("avg_limit", 6).alias("avg_limit"),
                     near("risk", 8).alias("risk"))


@register("eligibility", sql("""
SELECT flag_customer, use_rate, loan_cnt, score_level, (score_level IN ('3', '4', '5') OR (score_level = '2' AND fpd7_rate <
  (SELECT SUM(settled * settled_avg_limit * COALESCE(fpd7_rate, 0)) / SUM(settled * settled_avg_limit) FROM gr))) AND rate_cap > 0 AS eligible FROM gr"""))
def eligibility(spark, sf_dir):
    return P.with_eligibility(grid(spark, sf_dir), LEVELS, "2").select(*P.GRID_KEYS, "eligible")


@register("caps_as_rates", sql("""
SELECT flag_customer, use_rate, loan_cnt, score_level, ROUND(acap, 8) AS amount_cap_rate,
  ROUND(CASE WHEN raised_avg_limit > 0 THEN GREATEST((limit_cap - raised_avg_limit) / raised_avg_limit, 0) ELSE 0 END, 8) AS limit_cap_rate FROM gr"""))
def caps_as_rates(spark, sf_dir):
    return grid(spark, sf_dir).selectExpr(
        *P.GRID_KEYS, f"round({P.amount_cap_rate('settled_avg_limit')} + 1e-9, 8) as amount_cap_rate",
        f"round({P.limit_cap_rate('raised_avg_limit', 'limit_cap')} + 1e-9, 8) as limit_cap_rate")


RULES = {
    "tier_with_use_cap": "LEAST(trate, ucap)", "tier_use_and_table_cap": "LEAST(trate, ucap, rate_cap)",
    "tier_with_table_cap": "LEAST(trate, rate_cap)", "table_cap": "rate_cap", "table_cap_by_tier": "rate_cap * mult",
    "ten_tier_rate": "t10r", "amount_cap_by_ten_tiers": "acap * t10m", "use_base_by_risk": "LEAST(ubase * rc, 3.0)",
    "use_base_by_risk_capped": "LEAST(ubase * rc, rate_cap)",
}


@register("rate_rules", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, ROUND(SUM({inc(f'CASE WHEN ok THEN {r} ELSE 0 END')}), 2) AS increment, "
    f"ROUND((SUM(settled * settled_avg_limit) + SUM({inc(f'CASE WHEN ok THEN {r} ELSE 0 END')})) / SUM(settled), 6) AS avg_after FROM gr"
    for n, r in RULES.items())))
def rate_rules(spark, sf_dir):
    """Every rule at full scale."""
    g, out = grid(spark, sf_dir), None
    for name, rule in P.rule_book().items():
        part = P.apply_rule(g, rule).agg(
            F.lit(name).alias("rule"), F.expr("round(sum(increment) + 1e-9, 2)").alias("increment"),
            F.expr("round((sum(settled * settled_avg_limit) + sum(increment)) / sum(settled) + 1e-9, 6)").alias("avg_after"))
        out = part if out is None else out.unionByName(part)
    return out


@register("grid_plan", sql(f"""
SELECT flag_customer, use_rate, loan_cnt, score_level, ROUND(CASE WHEN ok THEN LEAST(ubase * rc, rate_cap) ELSE 0 END, 8) AS rate,
  ROUND(LEAST(raised_avg_limit * (1 + CASE WHEN ok THEN LEAST(ubase * rc, rate_cap) ELSE 0 END), limit_cap), 4) AS new_limit,
  ROUND({inc('CASE WHEN ok THEN LEAST(ubase * rc, rate_cap) ELSE 0 END')}, 2) AS increment FROM gr"""))
def grid_plan(spark, sf_dir):
    df = P.apply_rule(grid(spark, sf_dir), P.rule_book()["use_base_by_risk_capped"])
    return df.selectExpr(*P.GRID_KEYS, "round(rate + 1e-9, 8) as rate", "round(new_limit + 1e-9, 4) as new_limit",
                         "round(increment + 1e-9, 2) as increment")


def solver(slope: str, ceiling: str = "1e12", source: str = "gr", keys: str = "") -> list[str]:
    """Totals at every break point by direct evaluation, then interpolation in the piece that holds the need."""
    k = f"{keys}, " if keys else ""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(",") if c.strip()) or "TRUE"
    part = f"PARTITION BY {keys}" if keys else ""
    return [
        f"""cl AS (SELECT {k}raised * raised_avg_limit AS b, {slope} AS m, LEAST({ceiling}, GREATEST(limit_cap / raised_avg_limit - 1, 0)) AS c
          FROM {source} WHERE ok AND raised > 0 AND raised_avg_limit > 0)""",
        f"cl2 AS (SELECT * FROM cl WHERE m > 0 AND c > 0)",
        f"""nd AS (SELECT {k}{TARGET} * SUM(settled) - SUM(settled * settled_avg_limit) AS need FROM {source} {'GROUP BY ' + keys if keys else ''})""",
        f"""pts AS (SELECT {', '.join('a.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}a.x, SUM(b.b * LEAST(b.m * a.x, b.c)) AS t FROM
          (SELECT DISTINCT {k}c / m AS x FROM cl2) a JOIN cl2 b ON {on} GROUP BY ALL)""",
        f"pts2 AS (SELECT *, LAG(x, 1, 0.0) OVER (w) AS x0, LAG(t, 1, 0.0) OVER (w) AS t0 FROM pts WINDOW w AS ({part} ORDER BY x))",
    ]


@register("solved_scale", sql("""
SELECT ROUND(MAX(need), 2) AS need, ROUND((SELECT MAX(t) FROM pts), 2) AS max_increment, ROUND(MAX(x0 + (need - t0) / (t - t0) * (x - x0)), 8) AS k, TRUE AS reached
FROM pts2, nd WHERE need > t0 AND need <= t""", *solver("rate_cap * mult")))
def solved_scale(spark, sf_dir):
    df = P.solve_scale(grid(spark, sf_dir), P.rule_book()["table_cap_by_tier"], TARGET)
    return df.select(near("need", 2).alias("need"), near("max_increment", 2).alias("max_increment"),
                     near("k", 8).alias("k"), "reached")


SOLVED = [*solver("rate_cap * mult"),
          "sk AS (SELECT x0 + (need - t0) / (t - t0) * (x - x0) AS k FROM pts2, nd WHERE need > t0 AND need <= t)",
          f"""pl AS (SELECT gr.*, k, CASE WHEN ok THEN LEAST(rate_cap * mult * k, 1e12) ELSE 0 END AS rate FROM gr, sk)""",
          f"pp AS (SELECT *, {inc('rate')} AS increment, ok AND raised_avg_limit * (1 + rate) > limit_cap + 1e-6 AS hitcap FROM pl)"]


def solved(spark, sf_dir):
    rule = P.rule_book()["table_cap_by_tier"]
    return P.plan_details(P.solved_plan(grid(spark, sf_dir), rule, TARGET), rule)


@register("solved_plan_summary", sql("""
SELECT CAST(SUM(settled) AS BIGINT) AS customers, ROUND(SUM(settled * settled_avg_limit) / SUM(settled), 6) AS avg_before,
  ROUND((SUM(settled * settled_avg_limit) + SUM(increment)) / SUM(settled), 4) AS avg_after, ROUND(SUM(increment), 0) AS increment,
  ROUND(SUM(increment) / SUM(settled * settled_avg_limit), 8) AS growth,
  ROUND(SUM(settled * settled_avg_limit * COALESCE(fpd7_rate, 0)) / SUM(settled * settled_avg_limit), 8) AS risk_before,
  ROUND(SUM((settled * settled_avg_limit + increment) * COALESCE(fpd7_rate, 0)) / SUM(settled * settled_avg_limit + increment), 8) AS risk_after,
  CAST(SUM(CASE WHEN ok THEN 0 ELSE raised END) AS BIGINT) AS excluded_customers, MEDIAN(limit_cap) AS median_limit_cap,
  CAST(0 AS BIGINT) AS rate_bound_cells, COUNT(CASE WHEN hitcap THEN 1 END) AS limit_bound_cells FROM pp""", *SOLVED))
def solved_plan_summary(spark, sf_dir):
    df = P.plan_summary(solved(spark, sf_dir))
    return df.selectExpr(
        "customers", "round(avg_before + 1e-9, 6) as avg_before", "round(avg_after + 1e-9, 4) as avg_after",
        "round(increment + 1e-9, 0) as increment", "round(growth + 1e-9, 8) as growth", "round(risk_before + 1e-9, 8) as risk_before",
        "round(risk_after + 1e-9, 8) as risk_after", "excluded_customers", "median_limit_cap", "rate_bound_cells",
        "limit_bound_cells")


@register("plan_reasons", sql("""
SELECT flag_customer, use_rate, loan_cnt, score_level, CASE WHEN NOT ok THEN 'eligibility' WHEN hitcap THEN 'limit' ELSE '' END AS bound_by,
  CASE WHEN NOT ok THEN CONCAT('score_level=', score_level, ', not eligible')
  WHEN increment <= 0 THEN CONCAT('score_level=', score_level, ', no room below the limit cap ', FORMAT('{:,}', CAST(ROUND_EVEN(limit_cap, 0) AS BIGINT)))
  ELSE CONCAT('score_level=', score_level, ', fpd7 ', COALESCE(CAST(ROUND_EVEN(fpd7_rate * 100, 1) AS VARCHAR) || '%', 'unknown'), ' (', tier, '), rate cap ',
    CAST(ROUND_EVEN(rate_cap * 100, 0) AS VARCHAR), '% x ', CAST(mult AS VARCHAR), ' x ', PRINTF('%.2f', k), ' -> raise ', CAST(ROUND_EVEN(rate * 100, 0) AS VARCHAR),
    '%, limit after ', FORMAT('{:,}', CAST(ROUND_EVEN(LEAST(raised_avg_limit * (1 + rate), limit_cap), 0) AS BIGINT)), CASE WHEN hitcap THEN ' (limit cap)' ELSE '' END) END AS reason
FROM pp""", *SOLVED))
def plan_reasons(spark, sf_dir):
    return solved(spark, sf_dir).select(*P.GRID_KEYS, "bound_by", "reason")


@register("tier_statistics", sql("""
SELECT tier, COUNT(*) AS cells, CAST(SUM(settled) AS BIGINT) AS settled, CAST(SUM(raised) AS BIGINT) AS raised, ROUND(SUM(raised * rate_cap) / SUM(raised), 8) AS avg_rate_cap,
  ROUND(SUM(raised * rate) / SUM(raised), 8) AS avg_rate, ROUND(SUM(increment), 0) AS increment,
  ROUND(SUM(settled * settled_avg_limit * COALESCE(fpd7_rate, 0)) / SUM(settled * settled_avg_limit), 8) AS weighted_risk FROM pp GROUP BY tier""", *SOLVED))
def tier_statistics(spark, sf_dir):
    df = P.tier_statistics(solved(spark, sf_dir))
    return rounded(df, 8, ("increment",)).withColumn("increment", near("increment", 0))


@register("use_rate_statistics", sql("""
SELECT use_rate, COUNT(*) AS cells, CAST(SUM(raised) AS BIGINT) AS raised, ROUND(SUM(raised * rate) / SUM(raised), 8) AS avg_rate,
  ROUND(SUM(increment), 0) AS increment FROM pp GROUP BY use_rate""", *SOLVED))
def use_rate_statistics(spark, sf_dir):
    df = P.tier_statistics(solved(spark, sf_dir), "use_rate")
    return df.selectExpr("use_rate", "cells", "raised", "round(avg_rate + 1e-9, 8) as avg_rate", "round(increment + 1e-9, 0) as increment")


STATS = {"score_level": "score_level", "use_rate": "use_rate", "loan_cnt": "CAST(loan_cnt AS VARCHAR)",
         "flag_customer": "flag_customer", "score_level x use_rate": "CONCAT(score_level, '_', use_rate)"}


@register("plan_statistics", sql(" UNION ALL ".join(f"""
SELECT '{n}' AS key_set, {v} AS key_value, CAST(SUM(settled) AS BIGINT) AS settled, CAST(SUM(raised) AS BIGINT) AS raised, ROUND(SUM(raised) / SUM(settled), 8) AS raised_share,
  ROUND(SUM(settled * settled_avg_limit) / SUM(settled), 4) AS avg_before, ROUND((SUM(settled * settled_avg_limit) + SUM(increment)) / SUM(settled), 4) AS avg_after,
  ROUND(SUM(increment), 0) AS increment, ROUND(COALESCE(SUM(increment) / NULLIF(SUM(raised * raised_avg_limit), 0), 0), 8) AS weighted_rate FROM pp GROUP BY 2"""
    for n, v in STATS.items()), *SOLVED))
def plan_statistics(spark, sf_dir):
    df = P.plan_statistics(solved(spark, sf_dir))
    return df.selectExpr(
        "key_set", "key_value", "settled", "raised", "round(raised_share + 1e-9, 8) as raised_share", "round(avg_before + 1e-9, 4) as avg_before",
        "round(avg_after + 1e-9, 4) as avg_after", "round(increment + 1e-9, 0) as increment", "round(weighted_rate + 1e-9, 8) as weighted_rate")


@register("rate_matrix", sql("SELECT use_rate, " + ", ".join(
    f"ROUND(SUM(CASE WHEN tier10 = '{t}' THEN raised * rate END) / NULLIF(SUM(CASE WHEN tier10 = '{t}' THEN raised END), 0) * 100, 6) AS t{i}"
    for i, t in enumerate(P.TEN_NAMES)) + " FROM pp WHERE ok GROUP BY use_rate", *SOLVED))
def rate_matrix(spark, sf_dir):
    df = P.rate_matrix(solved(spark, sf_dir))
    return df.select("use_rate", *[near(f"`{t}`", 6).alias(f"t{i}") for i, t in enumerate(P.TEN_NAMES)])


@register("constraint_waterfall", sql(f"""
SELECT CAST(step AS INTEGER) AS step, name AS "constraint", ROUND(v, 2) AS increment, ROUND(LAG(v) OVER (ORDER BY step) - v, 2) AS loss FROM (
  SELECT 0 AS step, 'unconstrained' AS name, SUM({inc('1', '1e12')}) AS v FROM gr UNION ALL SELECT 1, 'rate_cap', SUM({inc('rate_cap', '1e12')}) FROM gr
  UNION ALL SELECT 2, 'eligibility', SUM({inc('CASE WHEN ok THEN rate_cap ELSE 0 END', '1e12')}) FROM gr
  UNION ALL SELECT 3, 'limit_cap', SUM({inc('CASE WHEN ok THEN rate_cap ELSE 0 END')}) FROM gr)"""))
def constraint_waterfall(spark, sf_dir):
    return rounded(P.waterfall(grid(spark, sf_dir)), 2)


@register("cap_sensitivity", sql(f"""
SELECT CAST(rm AS DOUBLE) AS rate_mult, CAST(lm AS DOUBLE) AS limit_mult, ROUND(SUM({inc('LEAST(trate, ucap, rate_cap * rm)', 'limit_cap * lm')}), 2) AS increment,
  ROUND((SUM(settled * settled_avg_limit) + SUM({inc('LEAST(trate, ucap, rate_cap * rm)', 'limit_cap * lm')})) / SUM(settled), 4) AS avg_after,
  (SUM(settled * settled_avg_limit) + SUM({inc('LEAST(trate, ucap, rate_cap * rm)', 'limit_cap * lm')})) / SUM(settled) >= {TARGET} AS reaches_target
FROM gr, (VALUES (1.0), (1.25), (1.5), (2.0), (3.0)) AS a(rm), (VALUES (1.0), (1.5), (2.0)) AS b(lm) GROUP BY rm, lm"""))
def cap_sensitivity(spark, sf_dir):
    df = P.cap_sensitivity(grid(spark, sf_dir), TARGET)
    return df.withColumns({"increment": near("increment", 2), "avg_after": near("avg_after", 4)})


@register("cap_relaxation", sql(f"""
SELECT CAST(m AS DOUBLE) AS mult, ROUND(SUM({inc('CASE WHEN ok THEN rate_cap * m ELSE 0 END')}), 2) AS increment,
  ROUND((SUM(settled * settled_avg_limit) + SUM({inc('CASE WHEN ok THEN rate_cap * m ELSE 0 END')})) / SUM(settled), 4) AS avg_after,
  (SUM(settled * settled_avg_limit) + SUM({inc('CASE WHEN ok THEN rate_cap * m ELSE 0 END')})) / SUM(settled) >= {TARGET} AS reaches_target
FROM gr, (VALUES (1.0), (1.2), (1.5), (2.0), (2.5), (3.0)) AS a(m) GROUP BY m"""))
def cap_relaxation(spark, sf_dir):
    df = P.relaxation(grid(spark, sf_dir), TARGET)
    return df.withColumns({"increment": near("increment", 2), "avg_after": near("avg_after", 4)})


@register("smallest_relaxation", sql("""
SELECT ROUND(MAX(x0 + (need - t0) / (t - t0) * (x - x0)), 8) AS k, TRUE AS reached FROM pts2, nd WHERE need > t0 AND need <= t""", *solver("rate_cap")))
def smallest_relaxation(spark, sf_dir):
    df = P.smallest_relaxation(grid(spark, sf_dir), TARGET, hi=20.0)
    return df.select(near("k", 8).alias("k"), "reached")


@register("full_scale", sql("""
SELECT ROUND(MAX(k), 8) AS k_star, COUNT(CASE WHEN ubase * rc * k >= rate_cap - 1e-9 THEN 1 END) AS touched_cells, COUNT(*) AS eligible_cells
FROM gr, (SELECT LEAST(MAX(rate_cap / (ubase * rc)), 3.0) AS k FROM gr WHERE ok) WHERE ok"""))
def full_scale(spark, sf_dir):
    df = P.full_scale(grid(spark, sf_dir), P.rule_book()["use_base_by_risk_capped"])
    return df.withColumn("k_star", near("k_star", 8))


SEARCH_CASES = ", ".join(f"({h}, {m}, {lo})" for h in (2.4, 2.6, 2.8, 3.0) for m in (2.0, 2.2, 2.4, 2.6) for lo in (0.6, 0.7, 0.8, 0.9))
SEARCH = [f"cs AS (SELECT CAST(h AS DOUBLE) AS high, CAST(m AS DOUBLE) AS medium, CAST(l AS DOUBLE) AS low FROM (VALUES {SEARCH_CASES}) AS v(h, m, l))",
          "gs AS (SELECT gr.*, cs.*, LEAST(CASE use_rate WHEN '1' THEN high WHEN '2' THEN medium ELSE low END * rc, 3.0) AS slope FROM gr, cs)",
          *solver("slope", source="gs", keys="high, medium, low"),
          """kk AS (SELECT high, medium, low, x0 + (need - t0) / (t - t0) * (x - x0) AS k FROM pts2 JOIN nd USING (high, medium, low)
            WHERE need > t0 AND need <= t)""",
          "ks AS (SELECT * FROM kk WHERE k BETWEEN 0.2 AND 1)",
          f"""fs AS (SELECT high, medium, low, k, SUM({inc('CASE WHEN ok THEN slope * k ELSE 0 END')}) AS i, MAX(CASE WHEN ok THEN slope * k ELSE 0 END) AS mx,
            SUM(CASE WHEN use_rate = '3' THEN {inc('CASE WHEN ok THEN slope * k ELSE 0 END')} ELSE 0 END) AS lowinc,
            SUM(CASE WHEN use_rate = '2' THEN {inc('CASE WHEN ok THEN slope * k ELSE 0 END')} ELSE 0 END) AS medinc
            FROM gs JOIN ks USING (high, medium, low) GROUP BY 1, 2, 3, 4)"""]


@register("base_search", sql("""
SELECT high, medium, low, ROUND(k, 8) AS k, ROUND(i, 0) AS increment, ROUND(mx, 8) AS largest_rate, ROUND(lowinc, 0) AS low_increment,
  ROUND(medinc, 0) AS medium_increment FROM fs""", *SEARCH))
def base_search(spark, sf_dir):
    df = P.base_search(grid(spark, sf_dir), TARGET)
    return df.selectExpr("high", "medium", "low", "round(k + 1e-9, 8) as k", "round(increment + 1e-9, 0) as increment",
                         "round(largest_rate + 1e-9, 8) as largest_rate", "round(low_increment + 1e-9, 0) as low_increment",
                         "round(medium_increment + 1e-9, 0) as medium_increment")


@register("compare_samples", "WITH " + ", ".join([*with_clause("fx_limit_result"), f"""gn AS (SELECT str_type, defq_use_rate_level AS use_rate, jq_customer_flag, LEAST(separate_installment_loan_cnt, 7) AS n,
  SUBSTR(jq_mix_score_bin, 1, 1) AS s, SUM(CASE WHEN te_flag = 1 THEN 1 ELSE 0 END) AS raised, AVG(CASE WHEN te_flag = 1 THEN jq_credit_quota END) / 100 AS raised_avg_limit,
  SUM(fpd7_fz_dd) / NULLIF(SUM(fpd7_fm_dd), 0) AS fpd7_rate, AVG(cash_remark1) AS rate_cap, MAX(after_adjust_credit_limit) / 100 AS limit_cap
  FROM fx_limit_result WHERE str_type IN ('new', 'old') AND defq_use_rate_level IN ('1', '2', '3') GROUP BY 1, 2, 3, 4, 5)""",
  f"gq AS (SELECT *, {tier(P.TIER_RATES, FIVE)} AS trate, CASE use_rate WHEN '1' THEN 1.0 WHEN '2' THEN 0.8 ELSE 0.3 END AS ucap FROM gn)"]) + f"""
SELECT str_type AS sample, 'with' AS use_cap, ROUND(SUM({inc('LEAST(trate, rate_cap, ucap)')}), 2) AS increment FROM gq GROUP BY 1
UNION ALL SELECT str_type, 'without', ROUND(SUM({inc('LEAST(trate, rate_cap)')}), 2) FROM gq GROUP BY 1""")
def compare_samples(spark, sf_dir):
    facts = view(spark, sf_dir, "fx_limit_result").where("defq_use_rate_level in ('1', '2', '3')")

    def sample(name):
        return facts.where(F.col("str_type") == name).groupBy(
            F.col("defq_use_rate_level").alias("use_rate"), "jq_customer_flag",
            F.expr("least(separate_installment_loan_cnt, 7) as n"), F.expr("substr(jq_mix_score_bin, 1, 1) as s"),
        ).agg(
            F.expr("count_if(te_flag = 1) as raised"),
            F.expr("avg(if(te_flag = 1, jq_credit_quota, null)) / 100 as raised_avg_limit"),
            F.expr("try_divide(sum(fpd7_fz_dd), sum(fpd7_fm_dd)) as fpd7_rate"),
            F.expr("avg(cash_remark1) as rate_cap"), F.expr("max(after_adjust_credit_limit) / 100 as limit_cap"))

    return rounded(P.compare_samples({"new": sample("new"), "old": sample("old")}), 2)


# --- plans on scored bins ---------------------------------------------------------------------------------------------

SKEYS = SC.KEYS


@register("segment_baseline", SC.sql("""
SELECT loan_ser_node, flag_customer, COUNT(*) AS rows, ROUND(SUM(curr_loan_prin), 2) AS amount, ROUND(SUM(fpd7_fz_dd) / SUM(fpd7_fm_dd), 8) AS fpd7_dd,
  ROUND(SUM(curr_loan_prin) / COUNT(*), 4) AS avg_loan FROM smp GROUP BY 1, 2"""))
def segment_baseline(spark, sf_dir):
    df = P.segment_baseline(SC.sample(spark, sf_dir), SKEYS, SC.WEEK)
    return df.selectExpr(*SKEYS, "rows", "round(amount + 1e-9, 2) as amount", "round(fpd7_dd + 1e-9, 8) as fpd7_dd",
                         "round(avg_loan + 1e-9, 4) as avg_loan")


@register("span_days", SC.sql("SELECT CAST(MAX(loan_week_begin) - MIN(loan_week_begin) + 7 AS INTEGER) AS span_days FROM smp"))
def span_days(spark, sf_dir):
    return P.span_days(SC.sample(spark, sf_dir), SC.WEEK)


@register("penetration_sensitivity", SC.sql("""
SELECT CAST(p AS DOUBLE) AS penetration, CAST(n AS BIGINT) AS up_rows, ROUND(u * p, 2) AS new_amount, ROUND(u * p / amount, 8) AS scale_up, ROUND(u * p / d, 2) AS new_per_day,
  ROUND(u * p / d * 30, 2) AS new_per_month, ROUND((amount * rate + u * p * ur) / (amount + u * p), 8) AS mixed_rate
FROM (SELECT SUM(amt * ratio) AS u, SUM(amt * dd) / SUM(amt) AS ur, SUM(bin_rows) AS n FROM sug),
  (SELECT SUM(a) AS amount, SUM(a * r) / SUM(a) AS rate FROM (SELECT SUM(curr_loan_prin) AS a, SUM(fpd7_fz_dd) / SUM(fpd7_fm_dd) AS r FROM smp GROUP BY loan_ser_node, flag_customer)),
  (SELECT MAX(loan_week_begin) - MIN(loan_week_begin) + 7 AS d FROM smp), (VALUES (0.1), (0.3), (0.5), (1.0)) AS v(p)""", *SC.SUGGEST))
def penetration_sensitivity(spark, sf_dir):
    s = SC.sample(spark, sf_dir)
    df = P.penetration_sensitivity(
        S_suggestions(spark, sf_dir), P.segment_baseline(s, SKEYS, SC.WEEK), P.span_days(s, SC.WEEK), SKEYS)
    return df.selectExpr("penetration", "up_rows", "round(new_amount + 1e-9, 2) as new_amount", "round(scale_up + 1e-9, 8) as scale_up",
                         "round(new_per_day + 1e-9, 2) as new_per_day", "round(new_per_month + 1e-9, 2) as new_per_month",
                         "round(mixed_rate + 1e-9, 8) as mixed_rate")


def S_suggestions(spark, sf_dir):
    from pathlift.operators import scoring as S

    return S.raise_suggestions(SC.binned(spark, sf_dir), SKEYS)


def best_bins(spark, sf_dir):
    def make():
        return cut_lineage(SC.binned(spark, sf_dir).where("is_best_model and slice = 'all'").select(
            *SKEYS, "model", "bin_no", "cnt", "loan_amount", "fpd7_dd", "fpd7_dd_lift"))

    key = ("bins", spark.sparkContext.applicationId, sf_dir)
    if key not in _GRIDS:
        _GRIDS[key] = make()
    return _GRIDS[key]


COVERS, PENS = (0.80, 0.95, 1.10), P.PENETRATIONS
PLAN_ROWS = ", ".join(f"('{n}', {r[0]}, {r[1]}, {r[2]})" for n, r in P.RATIO_PLANS.items())
FOUND = [*SC.SUGGEST, "span AS (SELECT MAX(loan_week_begin) - MIN(loan_week_begin) + 7 AS d FROM smp)",
         "best_bins AS (SELECT *, dd / NULLIF(rate, 0) AS lift FROM bb)",
         f"""fd AS (SELECT cover, plan, pen, SUM(amt * CASE WHEN lift < 0.25 THEN r1 WHEN lift < 0.5 THEN r2 ELSE r3 END * pen) AS new_amount,
           SUM(amt * dd) / SUM(amt) AS new_rate, SUM(cnt) AS customers FROM best_bins, (VALUES {', '.join(f'({c})' for c in COVERS)}) AS c(cover),
           (VALUES {PLAN_ROWS}) AS p(plan, r1, r2, r3), (VALUES {', '.join(f'({x})' for x in PENS)}) AS q(pen) WHERE lift < cover GROUP BY 1, 2, 3)""",
         """fq AS (SELECT fd.*, new_amount / d AS per_day FROM fd, span)""",
         """win AS (SELECT * FROM fq WHERE per_day >= 1000 AND new_rate <= 0.35 ORDER BY new_rate, per_day DESC, plan LIMIT 1)"""]


def found(spark, sf_dir):
    s = SC.sample(spark, sf_dir)
    return P.plan_search(best_bins(spark, sf_dir), P.span_days(s, SC.WEEK), 1000, 0.35, covers=COVERS)


@register("plan_search", SC.sql("""
SELECT CAST(cover AS DOUBLE) AS cover, plan, CAST(pen AS DOUBLE) AS penetration, ROUND(new_amount, 2) AS new_amount, ROUND(new_rate, 8) AS new_rate,
  CAST(customers AS BIGINT) AS customers, ROUND(per_day, 2) AS new_per_day, per_day >= 1000 AND new_rate <= 0.35 AS qualifies FROM fq""", *FOUND))
def plan_search(spark, sf_dir):
    return found(spark, sf_dir).selectExpr(
        "cover", "plan", "penetration", "round(new_amount + 1e-9, 2) as new_amount", "round(new_rate + 1e-9, 8) as new_rate", "customers",
        "round(new_per_day + 1e-9, 2) as new_per_day", "qualifies")


@register("best_plan", SC.sql("""
SELECT CAST(cover AS DOUBLE) AS cover, plan, CAST(pen AS DOUBLE) AS penetration, ROUND(new_rate, 8) AS new_rate, ROUND(per_day, 2) AS new_per_day FROM win""", *FOUND))
def best_plan(spark, sf_dir):
    return P.best_plan(found(spark, sf_dir)).selectExpr(
        "cover", "plan", "penetration", "round(new_rate + 1e-9, 8) as new_rate", "round(new_per_day + 1e-9, 2) as new_per_day")


DETAIL = [*FOUND, f"""dt AS (SELECT b.*, CASE WHEN lift < 0.25 THEN 'tier1' WHEN lift < 0.5 THEN 'tier2' ELSE 'tier3' END AS plan_tier,
  CAST(CASE WHEN lift < 0.25 THEN r1 WHEN lift < 0.5 THEN r2 ELSE r3 END AS DOUBLE) AS raise_ratio, pen, d FROM best_bins b, win, span,
  (VALUES {PLAN_ROWS}) AS p(pname, r1, r2, r3) WHERE p.pname = win.plan AND lift < win.cover)"""]


@register("plan_detail", SC.sql("""
SELECT loan_ser_node, flag_customer, bin_no, cnt, plan_tier, raise_ratio, ROUND(amt * raise_ratio * pen / d, 4) AS new_per_day FROM dt""", *DETAIL))
def plan_detail(spark, sf_dir):
    df = P.plan_detail(best_bins(spark, sf_dir), found(spark, sf_dir), P.span_days(SC.sample(spark, sf_dir), SC.WEEK))
    return df.selectExpr(*SKEYS, "bin_no", "cnt", "plan_tier", "raise_ratio", "round(new_per_day + 1e-9, 4) as new_per_day")


@register("plan_tier_summary", SC.sql("""
SELECT plan_tier, COUNT(*) AS bins, CAST(SUM(cnt) AS BIGINT) AS customers, ROUND(SUM(amt), 2) AS loan_amount,
  ROUND(SUM(amt * raise_ratio * pen / d), 4) AS new_per_day, ROUND(SUM(amt * dd) / SUM(amt), 8) AS rate FROM dt GROUP BY plan_tier""", *DETAIL))
def plan_tier_summary(spark, sf_dir):
    df = P.plan_tier_summary(P.plan_detail(
        best_bins(spark, sf_dir), found(spark, sf_dir), P.span_days(SC.sample(spark, sf_dir), SC.WEEK)))
    return df.selectExpr("plan_tier", "bins", "customers", "round(loan_amount + 1e-9, 2) as loan_amount",
                         "round(new_per_day + 1e-9, 4) as new_per_day", "round(rate + 1e-9, 8) as rate")
