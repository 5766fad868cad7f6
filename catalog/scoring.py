"""Registered queries: KS / AUC, bins, credit metrics, lift, suggestions, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.rounding import near, registry, rounded
from pathlift.operators import running as U, scoring as S
from pathlift.sources.fixtures import view, with_clause

QUERIES, ORACLE, register = registry()
KEYS = ("loan_ser_node", "flag_customer")
MODELS = ("score_a", "score_b")
WEEK = "loan_week_begin"


def sample(spark, sf_dir):
    return S.prepare_sample(view(spark, sf_dir, "fx_score_sample"))


BASE = [
    *with_clause("fx_score_sample"),
    """smp AS (SELECT *, CASE WHEN fpd7_fz_dd > 0 THEN 1 ELSE 0 END AS y, curr_loan_prin * curr_interest_ratio AS ci,
      next_loan_prin * curr_interest_ratio AS ni, CASE WHEN next_loan_prin > 0 THEN 1 ELSE 0 END AS hn FROM fx_score_sample)""",
    f"""lng AS (SELECT s.*, m.model, CASE m.model WHEN 'score_a' THEN score_a ELSE score_b END AS score
      FROM smp s CROSS JOIN (VALUES ('score_a'), ('score_b')) AS m(model)
      WHERE CASE m.model WHEN 'score_a' THEN score_a ELSE score_b END > 0)""",
    """sl AS (SELECT *, CAST(loan_week_begin AS VARCHAR) AS slice FROM lng WHERE fpd7_fm_dd = 1 UNION ALL
      SELECT *, 'all' FROM lng WHERE fpd7_fm_dd = 1)""",
    """cnts AS (SELECT loan_ser_node, flag_customer, slice, model, score, SUM(y) AS bad, COUNT(*) - SUM(y) AS good FROM sl GROUP BY ALL)""",
    """cum AS (SELECT *, SUM(bad) OVER w AS cb, SUM(good) OVER w AS cg,
      SUM(bad) OVER (PARTITION BY loan_ser_node, flag_customer, slice, model) AS tb,
      SUM(good) OVER (PARTITION BY loan_ser_node, flag_customer, slice, model) AS tg FROM cnts
      WINDOW w AS (PARTITION BY loan_ser_node, flag_customer, slice, model ORDER BY score))""",
    """ka AS (SELECT loan_ser_node, flag_customer, slice, model, CAST(SUM(bad + good) AS BIGINT) AS scored_rows,
      CASE WHEN SUM(bad + good) >= 50 AND MAX(tb) > 0 AND MAX(tg) > 0 AND COUNT(*) >= 2 THEN MAX(ABS(cb / tb - cg / tg)) END AS ks,
      CASE WHEN SUM(bad + good) >= 50 AND MAX(tb) > 0 AND MAX(tg) > 0 AND COUNT(*) >= 2 THEN
        SUM(bad * (cg - good + good / 2)) / (MAX(tb) * MAX(tg)) END AS a,
      (SELECT COUNT(*) FROM smp q WHERE q.fpd7_fm_dd = 1 AND q.loan_ser_node = cum.loan_ser_node AND q.flag_customer = cum.flag_customer
        AND (cum.slice = 'all' OR CAST(q.loan_week_begin AS VARCHAR) = cum.slice)) AS matured_rows
      FROM cum GROUP BY loan_ser_node, flag_customer, slice, model)""",
    """best AS (SELECT loan_ser_node, flag_customer, slice, model AS best_model, ks AS best_ks FROM (SELECT *, ROW_NUMBER() OVER
      (PARTITION BY loan_ser_node, flag_customer, slice ORDER BY COALESCE(ks, -1) DESC, model) AS rn FROM ka WHERE matured_rows >= 50) WHERE rn = 1)""",
]


def sql(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([*BASE, *extra]) + "\n" + select


@register("ks_auc", sql("""
SELECT loan_ser_node, flag_customer, model, scored_rows, ROUND(ks + 1e-9, 6) AS ks, ROUND(GREATEST(a, 1 - a) + 1e-9, 6) AS auc, matured_rows
FROM ka WHERE slice = 'all' AND matured_rows >= 50"""))
def ks_auc(spark, sf_dir):
    return rounded(S.ks_auc(sample(spark, sf_dir), KEYS, MODELS))


@register("ks_auc_by_week", sql("""
SELECT loan_ser_node, flag_customer, slice, model, scored_rows, ROUND(ks + 1e-9, 6) AS ks, ROUND(GREATEST(a, 1 - a) + 1e-9, 6) AS auc, matured_rows
FROM ka WHERE matured_rows >= 50"""))
def ks_auc_by_week(spark, sf_dir):
    return rounded(S.ks_auc(sample(spark, sf_dir), KEYS, MODELS, WEEK))


@register("best_model", sql("SELECT loan_ser_node, flag_customer, best_model, ROUND(best_ks + 1e-9, 6) AS best_ks FROM best WHERE slice = 'all'"))
def best_model(spark, sf_dir):
    return rounded(S.best_model(S.ks_auc(sample(spark, sf_dir), KEYS, MODELS), KEYS, MODELS))


METRICS = """COUNT(*) AS cnt, ROUND(AVG(curr_credit_quota) + 1e-9, 4) AS avg_limit, ROUND(SUM(curr_loan_prin) / COUNT(businessid) + 1e-9, 4) AS avg_loan,
  ROUND(SUM(ci) / SUM(curr_loan_prin) + 1e-9, 6) AS daily_interest, ROUND(SUM(curr_total_fee) / SUM(curr_loan_prin) + 1e-9, 6) AS total_fee_rate,
  ROUND(SUM(next_curr_credit_quota) / NULLIF(SUM(hn), 0) + 1e-9, 4) AS next_avg_limit,
  ROUND(SUM(next_loan_prin) / NULLIF(SUM(hn), 0) + 1e-9, 4) AS next_avg_loan,
  ROUND(SUM(ni) / NULLIF(SUM(next_loan_prin), 0) + 1e-9, 6) AS next_daily_interest,
  ROUND(SUM(next_total_fee) / NULLIF(SUM(next_loan_prin), 0) + 1e-9, 6) AS next_total_fee_rate,
  ROUND(SUM(curr_loan_prin) + 1e-9, 2) AS loan_amount, ROUND(SUM(next_total_fee) + 1e-9, 2) AS next_total_fee,
  CAST(SUM(fpd1_fm_dd) AS BIGINT) AS due1_cnt,
  """ + ", ".join(f"ROUND(SUM(fpd{h}_fz_{k}) / NULLIF(SUM(fpd{h}_fm_{k}), 0) + 1e-9, 6) AS fpd{h}_{k}" for h in (1, 7, 15) for k in ("dd", "bj"))
MONEY = ("avg_limit", "avg_loan", "next_avg_limit", "next_avg_loan")
TOTALS = ("loan_amount", "next_total_fee")


def metric_round(df):
    totals = [c for c in TOTALS if c in df.columns]
    df = df.withColumns({c: near(c, 2) for c in totals})
    money = [c for c in MONEY if c in df.columns]
    return rounded(df, 6, (*money, *totals)).withColumns({c: near(c, 4) for c in money})


@register("credit_metrics", sql(f"SELECT loan_ser_node, flag_customer, {METRICS} FROM smp GROUP BY 1, 2"))
def credit_metrics(spark, sf_dir):
    return metric_round(S.credit_metrics(sample(spark, sf_dir), KEYS))


@register("credit_metrics_by_week", sql(f"""
SELECT loan_ser_node, flag_customer, slice, {METRICS} FROM (SELECT *, CAST(loan_week_begin AS VARCHAR) AS slice FROM smp
UNION ALL SELECT *, 'all' FROM smp) GROUP BY 1, 2, 3"""))
def credit_metrics_by_week(spark, sf_dir):
    return metric_round(S.credit_metrics_sliced(sample(spark, sf_dir), KEYS, WEEK))


@register("model_effect", sql("""
SELECT m.loan_ser_node, m.flag_customer, m.slice, m.cnt, ROUND(a.ks + 1e-9, 6) AS score_a_ks, ROUND(GREATEST(a.a, 1 - a.a) + 1e-9, 6) AS score_a_auc,
  ROUND(b.ks + 1e-9, 6) AS score_b_ks, ROUND(GREATEST(b.a, 1 - b.a) + 1e-9, 6) AS score_b_auc, t.best_model
FROM (SELECT loan_ser_node, flag_customer, slice, COUNT(*) AS cnt FROM (SELECT *, CAST(loan_week_begin AS VARCHAR) AS slice FROM smp
  UNION ALL SELECT *, 'all' FROM smp) GROUP BY 1, 2, 3) m
LEFT JOIN best t USING (loan_ser_node, flag_customer, slice)
LEFT JOIN ka a ON a.model = 'score_a' AND a.matured_rows >= 50 AND a.loan_ser_node = m.loan_ser_node AND a.flag_customer = m.flag_customer AND a.slice = m.slice
LEFT JOIN ka b ON b.model = 'score_b' AND b.matured_rows >= 50 AND b.loan_ser_node = m.loan_ser_node AND b.flag_customer = m.flag_customer AND b.slice = m.slice"""))
def model_effect(spark, sf_dir):
    df = S.model_effect(sample(spark, sf_dir), KEYS, MODELS, WEEK)
    return rounded(df.select(*KEYS, "slice", "cnt", "score_a_ks", "score_a_auc", "score_b_ks", "score_b_auc", "best_model"))


QS = ", ".join(f"QUANTILE_CONT(score, {i / 5})" for i in range(1, 5))
EDGES = [f"""edges AS (SELECT loan_ser_node, flag_customer, model, MIN(score) AS lo, MAX(score) AS hi, LIST_DISTINCT([{QS}]) AS qs
  FROM lng WHERE fpd7_fm_dd = 1 GROUP BY 1, 2, 3)""",
         """eg AS (SELECT loan_ser_node, flag_customer, model, LIST_SORT(LIST_FILTER(qs, lambda x: x > lo AND x < hi)) AS e FROM edges)"""]


@register("quantile_edges", sql("""
SELECT loan_ser_node, flag_customer, model, CAST(i AS INTEGER) AS edge_no, ROUND(e[i] + 1e-9, 6) AS edge
FROM eg, (VALUES (1), (2), (3), (4)) AS n(i) WHERE i <= LEN(e)""", *EDGES))
def quantile_edges(spark, sf_dir):
    df = S.quantile_edges(sample(spark, sf_dir), KEYS, MODELS).selectExpr(*KEYS, "model", "posexplode(edges) as (p, edge)")
    return rounded(df.selectExpr(*KEYS, "model", "p + 1 as edge_no", "edge"))


BINS = [*EDGES, """bn AS (SELECT *, COALESCE(e[bin_no - 1], CAST('-infinity' AS DOUBLE)) AS lo, COALESCE(e[bin_no], CAST('infinity' AS DOUBLE)) AS hi
  FROM (SELECT l.*, e, 1 + LEN(LIST_FILTER(e, lambda x: x <= score)) AS bin_no FROM lng l JOIN eg USING (loan_ser_node, flag_customer, model)))""",
        f"""bm AS (SELECT loan_ser_node, flag_customer, model, CAST(bin_no AS INTEGER) AS bin_no, slice, SUM(curr_loan_prin) AS amt,
  MIN(lo) AS lo, MIN(hi) AS hi, AVG(curr_credit_quota) AS quota,
  SUM(fpd7_fz_dd) / NULLIF(SUM(fpd7_fm_dd), 0) AS dd, {METRICS}
  FROM (SELECT *, CAST(loan_week_begin AS VARCHAR) AS slice FROM bn UNION ALL SELECT *, 'all' FROM bn) GROUP BY 1, 2, 3, 4, 5)""",
        """sr AS (SELECT loan_ser_node, flag_customer, slice, SUM(fpd7_fz_dd) / NULLIF(SUM(fpd7_fm_dd), 0) AS rate FROM (
  SELECT *, CAST(loan_week_begin AS VARCHAR) AS slice FROM smp UNION ALL SELECT *, 'all' FROM smp) GROUP BY 1, 2, 3)"""]


@register("assigned_bins", sql("""
SELECT model, loan_ser_node, flag_customer, CAST(bin_no AS INTEGER) AS bin_no, COUNT(*) AS cnt, CAST(SUM(y) AS BIGINT) AS bad,
  MIN(score) AS smallest, MAX(score) AS largest FROM bn GROUP BY 1, 2, 3, 4""", *BINS))
def assigned_bins(spark, sf_dir):
    s = sample(spark, sf_dir)
    rows = S.assign_bins(s, S.quantile_edges(s, KEYS, MODELS), KEYS, MODELS)
    return rows.groupBy("model", *KEYS, "bin_no").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("y_bad").alias("bad"), F.min("score").alias("smallest"),
        F.max("score").alias("largest"))


@register("binned_metrics", sql("""
SELECT b.loan_ser_node, b.flag_customer, b.model, b.bin_no, b.slice, b.cnt, b.avg_limit, b.avg_loan, b.fpd7_dd, b.fpd7_bj,
  ROUND(s.rate + 1e-9, 6) AS segment_fpd7_dd, ROUND(b.dd / NULLIF(s.rate, 0) + 1e-9, 6) AS fpd7_dd_lift,
  COALESCE(t.best_model = b.model, FALSE) AS is_best_model
FROM bm b LEFT JOIN sr s USING (loan_ser_node, flag_customer, slice)
LEFT JOIN (SELECT * FROM best WHERE slice = 'all') t ON t.loan_ser_node = b.loan_ser_node AND t.flag_customer = b.flag_customer""", *BINS))
def binned_metrics(spark, sf_dir):
    df = binned(spark, sf_dir)
    return metric_round(df.select(
        *KEYS, "model", "bin_no", "slice", "cnt", "avg_limit", "avg_loan", "fpd7_dd", "fpd7_bj", "segment_fpd7_dd",
        "fpd7_dd_lift", "is_best_model"))


def binned(spark, sf_dir):
    s = sample(spark, sf_dir)
    curve = S.score_curve(s, KEYS, MODELS)
    edges = S.quantile_edges(s, KEYS, MODELS, curve=curve)
    return S.binned_metrics(s, edges, KEYS, MODELS, WEEK, curve)


@register("bin_ordinals", sql("""
SELECT DISTINCT loan_ser_node, flag_customer, model, CAST(bin_no AS INTEGER) AS bin_no, ROUND(lo, 6) AS bin_lo,
  CAST(DENSE_RANK() OVER (PARTITION BY loan_ser_node, flag_customer, model ORDER BY bin_no) AS INTEGER) AS bin_ordinal
FROM (SELECT DISTINCT loan_ser_node, flag_customer, model, bin_no, lo FROM bn)""", *BINS))
def bin_ordinals(spark, sf_dir):
    s = sample(spark, sf_dir)
    rows = S.assign_bins(s, S.quantile_edges(s, KEYS, MODELS), KEYS, MODELS)
    bins = rows.select(*KEYS, "model", "bin_no", "bin_lo").distinct()
    return rounded(S.bin_ordinal(bins, KEYS))


SUGGEST = [*BINS, """bb AS (SELECT b.*, s.rate FROM bm b JOIN sr s USING (loan_ser_node, flag_customer, slice)
  JOIN (SELECT * FROM best WHERE slice = 'all') t ON t.loan_ser_node = b.loan_ser_node AND t.flag_customer = b.flag_customer AND t.best_model = b.model
  WHERE b.slice = 'all')""",
           """sg AS (SELECT loan_ser_node, flag_customer, CAST(SUM(cnt) AS BIGINT) AS n, SUM(amt) / SUM(cnt) AS al, SUM(quota * cnt) / SUM(cnt) AS aq FROM bb GROUP BY 1, 2)""",
           """pk AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY loan_ser_node, flag_customer ORDER BY dd NULLS LAST, bin_no) AS rn
  FROM bb WHERE cnt >= 100) WHERE rn = 1)""",
           """sug AS (SELECT p.loan_ser_node, p.flag_customer, p.model AS best_model, p.bin_no, p.cnt AS bin_rows, s.n AS segment_rows, p.avg_loan AS bin_avg_loan, p.amt,
  p.lo, p.hi, p.quota, s.aq, s.al, p.dd, p.rate, CASE WHEN p.rate > 0 THEN p.dd / p.rate END AS rr,
  CAST(CASE WHEN p.dd / NULLIF(p.rate, 0) < 0.5 THEN 0.5 WHEN p.dd / NULLIF(p.rate, 0) < 0.8 THEN 0.3 WHEN p.dd / NULLIF(p.rate, 0) < 1 THEN 0.15 ELSE 0 END AS DOUBLE) AS ratio
  FROM pk p JOIN sg s USING (loan_ser_node, flag_customer))"""]


@register("raise_suggestions", sql("""
SELECT loan_ser_node, flag_customer, best_model, bin_no, bin_rows, segment_rows, bin_avg_loan, ROUND(al + 1e-9, 4) AS segment_avg_loan,
  ROUND(dd + 1e-9, 6) AS bin_fpd7_dd, ROUND(rate + 1e-9, 6) AS segment_fpd7_dd, ROUND(rr + 1e-9, 6) AS risk_ratio, ratio AS suggested_ratio,
  ROUND(lo, 6) AS bin_lo, ROUND(hi, 6) AS bin_hi, ROUND(quota, 4) AS bin_avg_limit, ROUND(aq, 4) AS segment_avg_limit FROM sug""", *SUGGEST))
def raise_suggestions(spark, sf_dir):
    df = S.raise_suggestions(binned(spark, sf_dir), KEYS)
    money = ("bin_avg_loan", "segment_avg_loan", "bin_avg_limit", "segment_avg_limit")
    return rounded(df, 6, (*money, "suggested_ratio")).withColumns(
        {c: near(c, 4) for c in money})


@register("cumulative_score_counts", sql("""
SELECT loan_ser_node, flag_customer, model, score, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good, CAST(cb - bad AS BIGINT) AS bad_before,
  CAST(cg - good AS BIGINT) AS good_before, CAST(tb AS BIGINT) AS bad_total, CAST(tg AS BIGINT) AS good_total FROM cum WHERE slice = 'all'"""))
def cumulative_score_counts(spark, sf_dir):
    counts = S.score_counts(sample(spark, sf_dir), KEYS, MODELS)
    return U.running_totals(counts, [*KEYS, "model"], "score", ("bad", "good"), ("model",))


@register("optimal_bins")
def optimal_bins(spark, sf_dir):
    """Best cuts by information value. No SQL: the choice is a small search per segment, tested by brute force."""
    df = S.optimal_edges(sample(spark, sf_dir), KEYS, MODELS)
    return df.selectExpr(*KEYS, "model", "size(edges) + 1 as bins", "round(iv + 1e-9, 9) as iv")


@register("approximate_edges")
def approximate_edges(spark, sf_dir):
    """Sketch-based edges for very large segments; approximate by design, so compared by rows only."""
    return S.approximate_edges(sample(spark, sf_dir), KEYS, MODELS)


STAB = ["""pb AS (SELECT CAST(LEAST(FLOOR(score_a / 100), 9) AS INTEGER) AS bin, loan_week_begin < DATE '1999-01-01' AS old_, y FROM smp WHERE score_a > 0)""",
        """ps AS (SELECT bin, COUNT(CASE WHEN old_ THEN 1 END) / (SELECT COUNT(*) FROM pb WHERE old_) AS b,
  COUNT(CASE WHEN NOT old_ THEN 1 END) / (SELECT COUNT(*) FROM pb WHERE NOT old_) AS c FROM pb GROUP BY bin)"""]


def stability(spark, sf_dir):
    s = sample(spark, sf_dir)
    old = S.score_bins(s.where("loan_week_begin < date '1999-01-01'"), "score_a", 100, 10)
    new = S.score_bins(s.where("loan_week_begin >= date '1999-01-01'"), "score_a", 100, 10)
    return S.psi(old, new)


@register("score_stability", sql("""
SELECT bin, ROUND(b + 1e-9, 8) AS base_share, ROUND(c + 1e-9, 8) AS current_share, ROUND((c - b) * 100 + 1e-9, 6) AS drift_points,
  ROUND(CASE WHEN b > 0 AND c > 0 THEN (c - b) * LN(c / b) ELSE 0 END + 1e-12, 8) AS psi FROM ps""", *STAB))
def score_stability(spark, sf_dir):
    return stability(spark, sf_dir).selectExpr(
        "bin", "round(base_share + 1e-9, 8) as base_share", "round(current_share + 1e-9, 8) as current_share",
        "round(drift_points + 1e-9, 6) as drift_points", "round(psi + 1e-12, 8) as psi")


@register("score_stability_total", sql("""
SELECT ROUND(SUM(CASE WHEN b > 0 AND c > 0 THEN (c - b) * LN(c / b) ELSE 0 END), 8) AS psi_total, ROUND(MAX(ABS((c - b) * 100)), 6) AS largest_drift FROM ps""", *STAB))
def score_stability_total(spark, sf_dir):
    return S.psi_total(stability(spark, sf_dir)).selectExpr(
        "round(psi_total + 1e-9, 8) as psi_total", "round(largest_drift + 1e-9, 6) as largest_drift")


@register("gain_table", sql("""
SELECT bin, cnt, ROUND(cnt / SUM(cnt) OVER () + 1e-9, 6) AS share, bad, ROUND(bad / cnt + 1e-9, 6) AS bad_rate,
  ROUND(SUM(bad) OVER (ORDER BY bin) / SUM(bad) OVER () + 1e-9, 6) AS cumulative_capture,
  ROUND((bad / cnt) / (SUM(bad) OVER () / SUM(cnt) OVER ()) + 1e-9, 6) AS lift
FROM (SELECT bin, COUNT(*) AS cnt, CAST(SUM(y) AS BIGINT) AS bad FROM pb GROUP BY bin)""", *STAB))
def gain_table(spark, sf_dir):
    return rounded(S.gain_table(S.score_bins(sample(spark, sf_dir), "score_a", 100, 10)))
