"""Derived views over the shipped tables: the inputs the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlift.config import AttributionConfig, ExpertStep, SuppressionRule, Threshold, Window

TABLES = ("events", "lineitem", "orders")

FX_APP_DAILY = """
SELECT CAST(ts AS DATE) AS create_date, '20240130' AS pt,
  event_type AS traffic_channel,
  CASE WHEN user_id % 3 = 0 THEN 'android' WHEN user_id % 3 = 1 THEN 'ios' ELSE ' ' END AS systemtype,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CONCAT('b', CAST(user_id % 5 AS STRING)) END AS device_brand,
  CASE WHEN value < 15 THEN '0' WHEN value < 70 THEN '1-9' ELSE '10+' END AS reg_sx_days,
  CONCAT('k', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING)) AS register_software,
  COUNT(*) AS cnt,
  SUM(CASE WHEN value >= 30 THEN 1 ELSE 0 END) AS approval_cnt,
  SUM(CASE WHEN value >= 60 THEN 1 ELSE 0 END) AS approval_jy0_cnt,
  COUNT(DISTINCT user_id) AS cid_cnt,
  COUNT(DISTINCT CASE WHEN value >= 30 THEN user_id END) AS approval_cid_cnt
FROM events GROUP BY 1,2,3,4,5,6,7
"""

# The warehouse keeps one partition per day, each with the whole history up to that day.
FX_APP_SNAPSHOTS = """
SELECT a.create_date, p.pt, a.traffic_channel, a.systemtype, a.device_brand, a.reg_sx_days, a.register_software,
  a.cnt, a.approval_cnt, a.approval_jy0_cnt, a.cid_cnt, a.approval_cid_cnt
FROM fx_app_daily a JOIN (VALUES ('20240129', DATE '2024-01-29'), ('20240130', DATE '2024-01-30')) AS p(pt, as_of)
  ON a.create_date <= p.as_of
"""

FX_LIMIT_RESULT = """
WITH b AS (
 SELECT l_orderkey * 10 + l_linenumber AS businessid,
  CAST(DATE_TRUNC('year', l_shipdate) AS DATE) AS jq_date,
  l_shipdate AS jq_time,
  CASE WHEN l_returnflag = 'N' THEN 'new' WHEN l_returnflag = 'A' THEN 'old' ELSE 'other' END AS str_type,
  l_linestatus AS app_flow_flag,
  CASE WHEN l_suppkey % 5 = 0 THEN 2 WHEN l_suppkey % 5 <= 2 THEN 0 ELSE 1 END AS te_flag,
  o_orderpriority AS cashloan_cid_mob_type,
  CASE WHEN o_orderstatus = 'P' THEN 'HAVE_SINGLE_LOAN' WHEN o_orderstatus = 'O' THEN 'HAVE_SINGLE_NOLOAN' ELSE 'NO_SINGLE' END AS jq_customer_flag,
  CASE WHEN l_partkey % 50 = 0 THEN '4' ELSE CAST(1 + l_partkey % 3 AS STRING) END AS defq_use_rate_level,
  1 + l_orderkey % 9 AS separate_installment_loan_cnt,
  CONCAT(CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS STRING), '.0') AS jq_mix_score_bin,
  CAST(CAST(ROUND(l_discount * 100) AS BIGINT) AS DOUBLE) / 20 AS cash_remark1,
  CAST(ROUND(l_extendedprice * 100) AS DOUBLE) AS jq_credit_quota,
  CAST(2000000 + l_quantity * 200000 AS DOUBLE) AS after_adjust_credit_limit,
  CAST(1000000 + 100000 * (l_partkey % 20) AS DOUBLE) AS credit_max_limit,
  CAST(l_quantity AS BIGINT) % 5 AS score_q, l_tax, l_orderkey, l_linenumber, l_extendedprice
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT *, CAST(CEIL(jq_credit_quota * (1 + cash_remark1) / 10000) AS DOUBLE) * 10000 AS rate_target FROM b)
SELECT businessid, jq_date, jq_time, str_type, app_flow_flag, te_flag, cashloan_cid_mob_type, jq_customer_flag,
  defq_use_rate_level, separate_installment_loan_cnt,
  jq_mix_score_bin, cash_remark1, jq_credit_quota, after_adjust_credit_limit, credit_max_limit,
  CASE WHEN te_flag = 0 THEN jq_credit_quota WHEN te_flag = 2 THEN jq_credit_quota - 10000
       WHEN l_linenumber = 7 THEN rate_target
       ELSE LEAST(rate_target, after_adjust_credit_limit, jq_credit_quota + credit_max_limit) END AS cash_quota_amount_now_after,
  jq_credit_quota * 0.4 AS loan_amount,
  CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS next_loan_flag,
  CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END AS next_curday_flag,
  CASE WHEN l_tax >= 0.04 THEN l_extendedprice * 0.3 END AS loan_prin,
  CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS fpd7_fm_dd,
  CASE WHEN l_orderkey % 4 = 0 AND l_linenumber > 4 + score_q THEN 1 ELSE 0 END AS fpd7_fz_dd,
  CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice ELSE 0 END AS fpd7_fm_bj,
  CASE WHEN l_orderkey % 4 = 0 AND l_linenumber > 4 + score_q THEN l_extendedprice * 0.5 ELSE 0 END AS fpd7_fz_bj,
  CASE WHEN l_orderkey % 3 > 0 THEN 1 ELSE 0 END AS fpd1_fm_dd,
  CASE WHEN l_orderkey % 3 = 1 AND l_linenumber > 3 + score_q THEN 1 ELSE 0 END AS fpd1_fz_dd,
  CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice ELSE 0 END AS fpd1_fm_bj,
  CASE WHEN l_orderkey % 3 = 1 AND l_linenumber > 3 + score_q THEN l_extendedprice * 0.75 ELSE 0 END AS fpd1_fz_bj,
  CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS fpd15_fm_dd,
  CASE WHEN l_orderkey % 12 = 0 AND l_linenumber > 3 + score_q THEN 1 ELSE 0 END AS fpd15_fz_dd,
  CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS fpd30_fm_dd,
  CASE WHEN l_orderkey % 20 = 0 AND l_linenumber > 2 + score_q THEN 1 ELSE 0 END AS fpd30_fz_dd,
  CASE WHEN l_linenumber < 7 THEN 7 * l_linenumber END AS loan_period_days,
  CAST(l_extendedprice * l_tax / 100 AS DOUBLE) AS interest_fee_daily
FROM c
"""

FX_POLICY = """
SELECT c.v AS customer, u.v AS use_rate, n.v AS loan_cnt, s.v AS score,
  CAST((c.i + u.i + n.v + s.i) % 11 AS DOUBLE) / 20 AS target_rate
FROM (VALUES (0,'HAVE_SINGLE_LOAN'),(1,'HAVE_SINGLE_NOLOAN'),(2,'NO_SINGLE')) AS c(i,v)
CROSS JOIN (VALUES (0,'1'),(1,'2'),(2,'3')) AS u(i,v)
CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) AS n(v)
CROSS JOIN (VALUES (0,'1'),(1,'2'),(2,'3'),(3,'4'),(4,'5')) AS s(i,v)
"""

FX_SCORE_SAMPLE = """
SELECT l_orderkey * 10 + l_linenumber AS businessid,
  CAST(DATE_TRUNC('year', l_shipdate) AS DATE) AS loan_week_begin,
  l_returnflag AS loan_ser_node, o_orderpriority AS flag_customer, l_linestatus AS credit_use_type,
  CASE WHEN l_partkey % 40 = 0 THEN -1.0 ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 997 AS DOUBLE) END AS score_a,
  CAST(l_quantity AS DOUBLE) AS score_b,
  CASE WHEN l_orderkey % 4 <> 0 THEN 1 ELSE 0 END AS fpd7_fm_dd,
  CASE WHEN l_orderkey % 4 <> 0 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 7 THEN 1 ELSE 0 END AS fpd7_fz_dd,
  CAST(CASE WHEN l_orderkey % 4 <> 0 THEN l_extendedprice ELSE 0 END AS DOUBLE) AS fpd7_fm_bj,
  CAST(CASE WHEN l_orderkey % 4 <> 0 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 7 THEN l_extendedprice * 0.5 ELSE 0 END AS DOUBLE) AS fpd7_fz_bj,
  CASE WHEN l_orderkey % 4 <> 0 THEN 1 ELSE 0 END AS fpd1_fm_dd,
  CASE WHEN l_orderkey % 4 <> 0 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 6 THEN 1 ELSE 0 END AS fpd1_fz_dd,
  CAST(CASE WHEN l_orderkey % 4 <> 0 THEN l_extendedprice ELSE 0 END AS DOUBLE) AS fpd1_fm_bj,
  CAST(CASE WHEN l_orderkey % 4 <> 0 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 6 THEN l_extendedprice * 0.75 ELSE 0 END AS DOUBLE) AS fpd1_fz_bj,
  CASE WHEN l_orderkey % 8 > 3 THEN 1 ELSE 0 END AS fpd15_fm_dd,
  CASE WHEN l_orderkey % 8 > 3 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 8 THEN 1 ELSE 0 END AS fpd15_fz_dd,
  CAST(CASE WHEN l_orderkey % 8 > 3 THEN l_extendedprice ELSE 0 END AS DOUBLE) AS fpd15_fm_bj,
  CAST(CASE WHEN l_orderkey % 8 > 3 AND l_linenumber + CAST(l_quantity AS BIGINT) % 3 >= 8 THEN l_extendedprice * 0.25 ELSE 0 END AS DOUBLE) AS fpd15_fz_bj,
  l_extendedprice AS curr_loan_prin,
  CAST(l_extendedprice * 2 AS DOUBLE) AS curr_credit_quota,
  CAST(l_discount AS DOUBLE) AS curr_interest_ratio,
  CAST(l_extendedprice * l_tax AS DOUBLE) AS curr_total_fee,
  CASE WHEN l_tax >= 0.04 THEN CAST(l_extendedprice * 0.3 AS DOUBLE) ELSE 0.0 END AS next_loan_prin,
  CASE WHEN l_tax >= 0.04 THEN CAST(l_extendedprice * 2.2 AS DOUBLE) ELSE 0.0 END AS next_curr_credit_quota,
  CASE WHEN l_tax >= 0.04 THEN CAST(l_extendedprice * 0.03 AS DOUBLE) ELSE 0.0 END AS next_total_fee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

FX_SEGMENT_GRID = """
SELECT jq_customer_flag AS flag_customer, defq_use_rate_level AS use_rate,
  LEAST(separate_installment_loan_cnt, 7) AS loan_cnt, SUBSTR(jq_mix_score_bin, 1, 1) AS score_level,
  COUNT(*) AS settled, AVG(jq_credit_quota) / 100 AS settled_avg_limit,
  SUM(CASE WHEN te_flag = 1 THEN 1 ELSE 0 END) AS raised,
  AVG(CASE WHEN te_flag = 1 THEN jq_credit_quota END) / 100 AS raised_avg_limit,
  SUM(CASE WHEN te_flag <> 1 THEN 1 ELSE 0 END) AS not_raised,
  CAST(SUM(fpd7_fz_dd) AS DOUBLE) / NULLIF(SUM(fpd7_fm_dd), 0) AS fpd7_rate,
  AVG(cash_remark1) AS rate_cap, MAX(after_adjust_credit_limit) / 100 AS limit_cap
FROM fx_limit_result
WHERE defq_use_rate_level IN ('1','2','3') GROUP BY 1,2,3,4
"""

FX_STATUS_LOG = """
SELECT event_id AS id, CONCAT('traffic_channel=', event_type) AS canonical_path,
  CAST(user_id % 3 AS INT) AS status, ts AS updated_at,
  CAST(ts AS DATE) AS action_date, CONCAT('u', CAST(user_id % 7 AS STRING)) AS updated_by
FROM events WHERE event_id % 20 = 0
"""

# Alerts of earlier partitions, whose definitions change on the 12th and the 20th.
FX_RULE_ALERTS = """
SELECT CONCAT('traffic_channel=', event_type) AS canonical_path,
  CONCAT('202401', LPAD(CAST(EXTRACT(DAY FROM ts) AS STRING), 2, '0')) AS pt,
  CASE WHEN EXTRACT(DAY FROM ts) < 12 THEN 'Top-K' ELSE 'expert' END AS source,
  EXTRACT(DAY FROM ts) >= 12 AS is_expert_forced,
  CASE WHEN EXTRACT(DAY FROM ts) < 20 THEN '' ELSE 'reviewed' END AS rule_note,
  'rule' AS drilldown_rule, FALSE AS enters_next_level, CONCAT('path of ', event_type) AS path
FROM events WHERE EXTRACT(DAY FROM ts) >= 5 AND event_type <> 'click' GROUP BY 1, 2, 3, 4, 5, 8
"""

VIEWS = {
    "fx_rule_alerts": (FX_RULE_ALERTS, ()),
    "fx_app_daily": (FX_APP_DAILY, ()),
    "fx_app_snapshots": (FX_APP_SNAPSHOTS, ("fx_app_daily",)),
    "fx_limit_result": (FX_LIMIT_RESULT, ()),
    "fx_policy": (FX_POLICY, ()),
    "fx_score_sample": (FX_SCORE_SAMPLE, ()),
    "fx_segment_grid": (FX_SEGMENT_GRID, ("fx_limit_result",)),
    "fx_status_log": (FX_STATUS_LOG, ()),
}


def with_clause(*names: str) -> list[str]:
    """``name AS (sql)`` entries in dependency order, for the SQL side of a comparison."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        sql, needs = VIEWS[name]
        for other in needs:
            visit(other)
        entry = f"{name} AS ({sql})"
        if entry not in ordered:
            ordered.append(entry)

    for name in names:
        visit(name)
    return ordered


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame. Source tables are passed as query arguments, not as global views."""
    sql, _ = VIEWS[name]
    needs = with_clause(name)[:-1]
    text = (f"WITH {', '.join(needs)} " if needs and not sql.lstrip().startswith("WITH") else "") + sql.strip()
    args = {}
    for table in TABLES:
        if f" {table} " in text or f" {table}\n" in text:
            args[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for table in args:
        text = text.replace(f"FROM {table} ", f"FROM {{{table}}} ").replace(f"FROM {table}\n", f"FROM {{{table}}}\n")
        text = text.replace(f"JOIN {table} ", f"JOIN {{{table}}} ")
    return spark.sql(text, **args)


# Settings for these nearly uniform tables: production thresholds find nothing in them.
TEST_CONFIG = AttributionConfig(
    version="fixture",
    table="fx_app_daily",
    dimensions=("traffic_channel", "systemtype", "device_brand", "reg_sx_days", "register_software"),
    windows=(Window("1d", 1, "近1天"), Window("3d", 3, "近3天"), Window("7d", 7, "近7天")),
    thresholds=(
        Threshold(1, 5, 1.1, 1.1, 0.5, "Level1 黄色"),
        Threshold(2, 10, 1.2, 1.2, 1, "Level2 橙色"),
        Threshold(3, 30, 1.5, 1.5, 2, "Level3 红色"),
    ),
    suppression_rules=(SuppressionRule("reg_sx_days", "10+", "long registration gap"),),
    expert_path=(
        ExpertStep("systemtype", "ios", "forced: ios"),
        ExpertStep("reg_sx_days", "0", "forced: same day"),
        ExpertStep("register_software", "*", "forced: all software"),
    ),
    lookback_days=30,
    trend_days=30,
)
