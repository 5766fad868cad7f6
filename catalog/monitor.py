"""Registered queries: monitoring tables, scalar functions over whole tables, sources and sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F, types as T

from catalog import attribution_sql as q
from catalog.attribution import raw_facts
from catalog.rounding import near, registry, rounded
from pathlift.functions import paths as H, scalars as C
from pathlift.operators import execution as X, monitor as M
from pathlift.session import shared_dir
from pathlift.sources import tables as S
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view, with_clause

QUERIES, ORACLE, register = registry()


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def scratch(spark, sf_dir, name: str) -> str:
    tag = hashlib.sha1(f"{spark.sparkContext.applicationId}{sf_dir}".encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/pathlift-reports-{tag}/{name}"


STAGES = ("view", "click", "signup", "purchase")


@register("funnel", """
SELECT stage, CAST(stage_no AS INTEGER) AS stage_no, value, ROUND(value / LAG(value) OVER (ORDER BY stage_no) + 1e-9, 6) AS conversion FROM (
  SELECT event_type AS stage, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS stage_no, COUNT(*) AS value
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2)""")
def funnel(spark, sf_dir):
    return rounded(M.funnel(events(spark, sf_dir), "event_type", STAGES))


VINTAGE = """
WITH loans AS (SELECT o_orderkey AS id, DATE_TRUNC('month', o_orderdate) AS cohort FROM orders),
bad AS (SELECT l_orderkey AS id, l_shipdate AS ev FROM lineitem WHERE l_returnflag = 'R'),
cut AS (SELECT DATE_TRUNC('month', MAX(ev)) AS m FROM bad),
j AS (SELECT cohort, DATE_DIFF('month', cohort, DATE_TRUNC('month', ev)) AS mob FROM loans
  LEFT JOIN (SELECT id, MIN(ev) AS ev FROM bad GROUP BY 1) USING (id))
SELECT CAST(cohort AS DATE) AS cohort, COUNT(*) AS loans, """ + ", ".join(
    f"ROUND(CASE WHEN DATE_DIFF('month', cohort, m) - 2 >= {i} THEN COUNT(CASE WHEN mob >= 0 AND mob <= {i} THEN 1 END)"
    f" / COUNT(*) END + 1e-9, 6) AS mob{i}" for i in range(1, 7)) + " FROM j, cut GROUP BY cohort, m"


@register("vintage", VINTAGE)
def vintage(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    loans = orders.selectExpr("o_orderkey as id", "o_orderdate as start")
    bad = lineitem(spark, sf_dir).where("l_returnflag = 'R'").selectExpr("l_orderkey as id", "l_shipdate as event")
    return rounded(M.vintage(loans, bad, 6, lag_months=2))


@register("retention", """
WITH seen AS (SELECT DISTINCT user_id, CAST(FLOOR(DATE_DIFF('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS period FROM events),
st AS (SELECT user_id, MIN(period) AS cohort FROM seen GROUP BY 1),
c AS (SELECT cohort, period - cohort AS n, COUNT(*) AS users FROM seen JOIN st USING (user_id) WHERE period - cohort <= 4 GROUP BY 1, 2)
SELECT c.cohort, CAST(c.n AS INTEGER) AS n, c.users, ROUND(c.users / z.users + 1e-9, 6) AS retention FROM c JOIN c z ON z.cohort = c.cohort AND z.n = 0""")
def retention(spark, sf_dir):
    ev = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"))
    return rounded(M.retention(ev, "user_id", "day", 4))


@register("score_migration", """
WITH a AS (SELECT l_partkey AS k, CAST(LEAST(FLOOR(AVG(l_quantity) / 10), 4) AS INTEGER) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1),
c AS (SELECT l_partkey AS k, CAST(LEAST(FLOOR(AVG(l_quantity) / 10), 4) AS INTEGER) AS b FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT a.b AS base_bin, """ + ", ".join(f"ROUND(COUNT(CASE WHEN c.b = {i} THEN 1 END) / COUNT(*) + 1e-9, 6) AS to_{i}" for i in range(5)) + """
FROM a JOIN c USING (k) GROUP BY 1""")
def score_migration(spark, sf_dir):
    def bins(cond):
        return lineitem(spark, sf_dir).where(cond).groupBy(F.col("l_partkey").alias("k")).agg(
            F.expr("int(least(floor(avg(l_quantity) / 10), 4)) as bin"))

    split = "l_shipdate {} timestamp_ntz '1999-01-01 00:00:00'"
    return rounded(M.migration(bins(split.format("<")), bins(split.format(">=")), "k", range(5)))


@register("roll_rates", """
WITH st AS (SELECT l_partkey AS k, EXTRACT(year FROM l_shipdate) AS y, CAST(FLOOR(MAX(FLOOR(l_discount * 100 + 0.5)) / 4) AS INTEGER) AS b
  FROM lineitem GROUP BY 1, 2),
mv AS (SELECT b, LEAD(b) OVER (PARTITION BY k ORDER BY y) AS nb FROM st)
SELECT b AS bucket, COUNT(*) AS moves, ROUND(AVG(CASE WHEN nb < b THEN 1.0 ELSE 0 END) + 1e-9, 6) AS cure,
  ROUND(AVG(CASE WHEN nb = b THEN 1.0 ELSE 0 END) + 1e-9, 6) AS stay, ROUND(AVG(CASE WHEN nb > b THEN 1.0 ELSE 0 END) + 1e-9, 6) AS worse
FROM mv WHERE nb IS NOT NULL GROUP BY 1""")
def roll_rates(spark, sf_dir):
    states = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y")).agg(
        F.expr("int(floor(max(floor(l_discount * 100 + 0.5)) / 4)) as b"))
    return rounded(M.roll_rates(states, "k", "y", "b"))


@register("channel_quality", """
WITH p AS (SELECT event_type AS channel, COUNT(*) AS volume, COUNT(*) / COUNT(DISTINCT CAST(ts AS DATE)) AS dv, AVG(CASE WHEN value >= 30 THEN 1.0 ELSE 0 END) AS pr,
  COUNT(CASE WHEN value >= 90 THEN 1 END) / COUNT(CASE WHEN value >= 60 THEN 1 END) AS dr FROM events GROUP BY 1)
SELECT channel, volume, ROUND(dv + 1e-9, 6) AS daily_volume, ROUND(pr + 1e-9, 6) AS pass_rate, ROUND(dr + 1e-9, 6) AS default_rate,
  ROUND((SELECT AVG(pr) FROM p) + 1e-9, 6) AS average_pass_rate, ROUND((SELECT AVG(dr) FROM p) + 1e-9, 6) AS average_default_rate FROM p""")
def channel_quality(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rounded(M.channel_quality(ev, "event_type", "value >= 30", "value >= 60", "value >= 90", "day"))


RULES = {"high_value": "value >= 90", "error_event": "event_type = 'error'", "low_user": "user_id < 10"}


@register("rule_hits", " UNION ALL ".join(
    f"""SELECT '{n}' AS rule, COUNT(*) AS hits, COUNT(CASE WHEN value >= 50 THEN 1 END) AS blocks,
  ROUND(COUNT(CASE WHEN event_type = 'error' THEN 1 END) / COUNT(*) + 1e-9, 6) AS precision FROM events WHERE {c}""" for n, c in RULES.items()))
def rule_hits(spark, sf_dir):
    return rounded(M.rule_hits(events(spark, sf_dir), RULES, "value >= 50", "event_type = 'error'"))


@register("device_clusters", """
SELECT props AS device, COUNT(DISTINCT user_id) AS users, COUNT(*) AS applications, COUNT(CASE WHEN value >= 30 THEN 1 END) AS passes
FROM events GROUP BY 1 HAVING COUNT(DISTINCT user_id) >= 60""")
def device_clusters(spark, sf_dir):
    return M.clusters(events(spark, sf_dir), "props", "user_id", "value >= 30", 60)


# --- scalar functions over whole tables ---------------------------------------------------------------------------------


@register("path_identity", "WITH " + ", ".join(with_clause("fx_app_daily")) + f"""
SELECT DISTINCT {', '.join(f"{q.norm(d)} AS {d}" for d in q.DIMS)},
  CONCAT_WS(' / ', {', '.join(f"CONCAT('{d}=', {q.norm(d)})" for d in sorted(q.DIMS))}) AS canonical_path,
  CONCAT_WS(' / ', {', '.join(f"CONCAT('{d}=', {q.norm(d)})" for d in q.DIMS)}) AS path,
  SUBSTR(SHA1(CONCAT_WS(' / ', {', '.join(f"CONCAT('{d}=', {q.norm(d)})" for d in sorted(q.DIMS))})), 1, 12) AS id FROM fx_app_daily""")
def path_identity(spark, sf_dir):
    """Canonical and display path and id of every dimension combination."""
    dims = CFG.dimensions
    rows = raw_facts(spark, sf_dir).select(*[C.normalize_value(d).alias(d) for d in dims]).distinct()
    rows = rows.withColumns({"canonical_path": H.canonical_path(dims), "path": H.display_path(dims)})
    return rows.withColumn("id", H.record_id(F.col("canonical_path")))


@register("suppressed_combinations", "WITH " + ", ".join(with_clause("fx_app_daily")) + """
SELECT CASE WHEN reg_sx_days = '10+' THEN 'long registration gap' ELSE '' END AS reasons, CAST(SUM(cnt) AS BIGINT) AS cnt FROM fx_app_daily GROUP BY 1""")
def suppressed_combinations(spark, sf_dir):
    from pathlift.operators.metrics import suppression_sql

    rows = raw_facts(spark, sf_dir)
    return rows.groupBy(F.expr(f"array_join({suppression_sql(CFG)}, '; ')").alias("reasons")).agg(F.sum("cnt").alias("cnt"))


@register("decoded_codes", "WITH " + ", ".join(with_clause("fx_limit_result")) + """
SELECT jq_mix_score_bin, REPLACE(jq_mix_score_bin, '.0', '') AS code, CAST(jq_mix_score_bin AS DOUBLE) AS number, separate_installment_loan_cnt,
  CAST(CASE WHEN defq_use_rate_level <> '4' THEN LEAST(separate_installment_loan_cnt, 7) END AS INTEGER) AS loan_cnt,
  CASE WHEN defq_use_rate_level = '4' THEN NULL ELSE CASE REPLACE(jq_mix_score_bin, '.0', '') WHEN '5' THEN 'A' WHEN '4' THEN 'B' WHEN '3' THEN 'C' WHEN '2' THEN 'D' ELSE 'E' END END AS score,
  RTRIM(RTRIM(CAST(CAST(cash_remark1 AS DECIMAL(10, 6)) AS VARCHAR), '0'), '.') AS rate_text, COUNT(*) AS cnt FROM fx_limit_result GROUP BY ALL""")
def decoded_codes(spark, sf_dir):
    keyed = X.with_lookup_key(view(spark, sf_dir, "fx_limit_result"), X.CodeBook.labelled())
    return keyed.groupBy(
        "jq_mix_score_bin", C.normalized_code("jq_mix_score_bin").alias("code"),
        C.safe_double("jq_mix_score_bin").alias("number"), "separate_installment_loan_cnt", "loan_cnt", "score",
        C.rate_label("cash_remark1").alias("rate_text"),
    ).agg(F.count(F.lit(1)).alias("cnt"))


@register("partition_id_check", """
SELECT id, ok, COUNT(*) AS cnt FROM (SELECT id, REGEXP_MATCHES(id, '^[0-9]{8}$') AND TRY_STRPTIME(id, '%Y%m%d') IS NOT NULL AS ok FROM (
  SELECT CASE user_id % 4 WHEN 0 THEN STRFTIME(ts, '%Y%m%d') WHEN 1 THEN STRFTIME(ts, '%Y-%m-%d') WHEN 2 THEN CONCAT('202413', STRFTIME(ts, '%d'))
    ELSE CONCAT(STRFTIME(ts, '%Y%m%d'), 'x') END AS id FROM events)) GROUP BY 1, 2""")
def partition_id_check(spark, sf_dir):
    text = ("case user_id % 4 when 0 then date_format(ts, 'yyyyMMdd') when 1 then date_format(ts, 'yyyy-MM-dd')"
            " when 2 then concat('202413', date_format(ts, 'dd')) else concat(date_format(ts, 'yyyyMMdd'), 'x') end")
    ids = events(spark, sf_dir).select(F.expr(text).alias("id"))
    return ids.groupBy("id", C.valid_partition_id("id").alias("ok")).agg(F.count(F.lit(1)).alias("cnt"))


@register("json_safe_numbers", """
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS cnt, COUNT(v) AS kept FROM (
  SELECT event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def json_safe_numbers(spark, sf_dir):
    """Infinite values (every seventh user) become NULL."""
    rows = events(spark, sf_dir).select("event_type", F.expr("if(user_id % 7 = 0, double('infinity'), value)").alias("v"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.count(C.json_number("v")).alias("kept"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------


@register("partition_scan", "WITH " + ", ".join(with_clause("fx_app_snapshots")) + """
SELECT create_date, CAST(SUM(cnt) AS BIGINT) AS cnt FROM fx_app_snapshots WHERE pt = '20240129' GROUP BY 1""")
def partition_scan(spark, sf_dir):
    """Facts written by partition, then one partition read back; the others' files are not opened."""
    path = scratch(spark, sf_dir, "facts")
    view(spark, sf_dir, "fx_app_snapshots").write.mode("overwrite").partitionBy("pt").parquet(path)
    rows = spark.read.schema(facts_schema(spark, path)).parquet(path).where(F.col("pt") == "20240129")
    return rows.groupBy("create_date").agg(F.sum("cnt").alias("cnt"))


def facts_schema(spark, path: str) -> T.StructType:
    """Stored schema with the partition id kept as text (it would be inferred as a number)."""
    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == "pt" else f.dataType) for f in found])


@register("csv_round_trip", """
SELECT event_type, COUNT(*) AS cnt, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1""")
def csv_round_trip(spark, sf_dir):
    """Report written as CSV, read back with a declared schema and a column subset."""
    path = scratch(spark, sf_dir, "events-csv")
    S.write_report(events(spark, sf_dir), path, ("event_id", "user_id", "event_type", "value"))
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, value double")
    rows = S.read_csv(spark, path, schema, ("event_type", "value"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"), near(F.sum("value"), 4).alias("total"))


@register("lookup_round_trip", "WITH " + ", ".join(with_clause("fx_limit_result", "fx_policy")) + """
SELECT p.customer, CAST(COUNT(*) AS BIGINT) AS cnt, ROUND(SUM(p.target_rate), 4) AS rates FROM fx_limit_result f JOIN fx_policy p
ON p.customer = f.jq_customer_flag AND p.use_rate = f.defq_use_rate_level AND p.loan_cnt = LEAST(f.separate_installment_loan_cnt, 7)
AND p.score = SUBSTR(f.jq_mix_score_bin, 1, 1) GROUP BY 1""")
def lookup_round_trip(spark, sf_dir):
    """Policy kept as a headed text file, read as a lookup and joined to every loan."""
    path = scratch(spark, sf_dir, "policy-csv")
    columns = ("customer", "use_rate", "loan_cnt", "score", "target_rate")
    S.write_report(view(spark, sf_dir, "fx_policy").coalesce(1), path, columns)
    policy = S.policy_table(S.read_lookup(spark, path))
    cube = X.strategy_cube(view(spark, sf_dir, "fx_limit_result"))
    joined = X.with_expected_rate(cube, policy).where("is_mapped")
    return joined.groupBy("customer").agg(
        F.sum("cnt").alias("cnt"), near(F.sum(F.col("expected_rate") * F.col("cnt")), 4).alias("rates"))


@register("wide_scan", """
SELECT COUNT(*) AS rows, ROUND(SUM(l_quantity), 2) AS quantity, ROUND(SUM(l_extendedprice), 2) AS price FROM lineitem""")
def wide_scan(spark, sf_dir):
    """Two-column scan probe: only the two columns are read."""
    return lineitem(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), near(F.sum("l_quantity"), 2).alias("quantity"),
        near(F.sum("l_extendedprice"), 2).alias("price"))
