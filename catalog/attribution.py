"""Registered queries: scan, windows, drilldown, expert path, merge and summary."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import attribution_sql as q
from catalog.rounding import near, registry
from pathlift.operators import daily as D, drill as R, metrics as M
from pathlift.plans import dashboard as P
from pathlift.session import cut_lineage, shared_dir
from pathlift.sources import files, tables as T
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view
from pathlift.sources.store import RunStore

QUERIES, ORACLE, register = registry()
_RUNS: dict = {}
_FACTS: dict = {}

RECORD_COLUMNS = (
    "canonical_path", "path", "level", "array_join(hit_windows, ',') as hit_windows", "hit_window_count",
    "primary_window", "anomaly_type", "observation_count", "growth_factor", "structure_lift_factor", "z_score",
    "excess_count", "relative_strength",
)


def stored_facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact view, stored once per session and data folder: a run reads its facts several times, the events behind them
    are grouped only once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FACTS:
        _FACTS[key] = cut_lineage(view(spark, sf_dir, name))
    return _FACTS[key]


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_facts(spark, sf_dir, "fx_app_daily")


def lazy_base(spark: SparkSession, sf_dir: str) -> D.Base:
    return D.Base.of(raw_facts(spark, sf_dir), CFG)


def full_run(spark: SparkSession, sf_dir: str) -> P.Dashboard:
    """The stored run of one session and data folder; several queries look at different parts of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = P.build(raw_facts(spark, sf_dir), CFG, "20240130")
    return _RUNS[key]


@register("daily_totals", q.query(q.base(), """
SELECT day, CAST(total AS DOUBLE) AS cnt, CAST(approvals AS DOUBLE) AS approval_cnt, CAST(jy0 AS DOUBLE) AS approval_jy0_cnt,
  CAST(persons AS DOUBLE) AS cid_cnt, CAST(person_approvals AS DOUBLE) AS approval_cid_cnt, n_rows AS aggregate_row_count FROM daily"""))
def daily_totals(spark, sf_dir):
    return lazy_base(spark, sf_dir).totals


@register("kept_days", q.query(q.base(), "SELECT day, CAST(total AS DOUBLE) AS cnt FROM kept"))
def kept_days(spark, sf_dir):
    return D.kept_days(lazy_base(spark, sf_dir).totals, CFG).select("day", "cnt")


@register("window_range", f"""
WITH {', '.join(q.with_clause('fx_app_daily'))}, r AS (SELECT MIN(create_date) AS lo, MAX(create_date) AS hi FROM fx_app_daily)
SELECT lo AS table_date_min, hi AS table_date_max, hi - 32 AS scan_start, hi - 32 AS trend_start, hi + 1 AS end_exclusive FROM r""")
def window_range(spark, sf_dir):
    return D.window_range(raw_facts(spark, sf_dir), CFG)


@register("window_range_offset", f"""
WITH {', '.join(q.with_clause('fx_app_daily'))}, r AS (SELECT MIN(create_date) AS lo, MAX(create_date) - 15 AS hi FROM fx_app_daily)
SELECT CAST(create_date AS DATE) AS day, CAST(SUM(cnt) AS DOUBLE) AS cnt FROM fx_app_daily, r
WHERE create_date >= hi - 32 AND create_date < hi + 1 GROUP BY 1""")
def window_range_offset(spark, sf_dir):
    facts = D.facts_in_range(raw_facts(spark, sf_dir), CFG, offset=15)
    return facts.groupBy("day").agg(F.sum("cnt").alias("cnt"))


@register("normalized_dimensions", q.query(q.base(), f"""
SELECT field, value, CAST(SUM(cnt) AS DOUBLE) AS cnt FROM (
{' UNION ALL '.join(f"SELECT '{d}' AS field, {d} AS value, cnt FROM f" for d in q.DIMS)}) GROUP BY field, value"""))
def normalized_dimensions(spark, sf_dir):
    return R.value_daily(lazy_base(spark, sf_dir)).groupBy("field", "value").agg(F.sum("cnt").alias("cnt"))


@register("dimension_by_day", q.query(q.base(), f"""
SELECT field, value, day, CAST(SUM(cnt) AS DOUBLE) AS cnt FROM (
{' UNION ALL '.join(f"SELECT '{d}' AS field, {d} AS value, day, cnt FROM f" for d in q.DIMS)}) GROUP BY 1, 2, 3"""))
def dimension_by_day(spark, sf_dir):
    return R.value_daily(lazy_base(spark, sf_dir))


@register("collapsed_facts", q.query(q.base(), f"""
SELECT day, {q.COLS}, CAST(SUM(cnt) AS DOUBLE) AS cnt, COUNT(*) AS source_rows FROM f GROUP BY day, {q.COLS}"""))
def collapsed_facts(spark, sf_dir):
    return D.collapse(lazy_base(spark, sf_dir).facts, CFG).select("day", *CFG.dimensions, "cnt", "source_rows")


@register("window_table", q.query(q.base(), """
SELECT t.w AS window_key, os AS observation_start, oe AS observation_end, bs AS baseline_start, be AS baseline_end,
  CAST(od AS INTEGER) AS observation_days, CAST(bd AS INTEGER) AS baseline_days, CAST(ot AS DOUBLE) AS observation_total,
  CAST(bt AS DOUBLE) AS baseline_total, CAST(SUM(persons) AS DOUBLE) AS cid_cnt,
  CAST(SUM(person_approvals) AS DOUBLE) AS approval_cid_cnt,
  ROUND(SUM(person_approvals) * 100.0 / SUM(persons), 6) AS cid_approval_rate_pct
FROM tot t JOIN kept k ON k.rn <= t.n GROUP BY ALL"""))
def window_table(spark, sf_dir):
    df = D.window_table(lazy_base(spark, sf_dir).totals, CFG)
    return df.drop("label", "purpose", "color", "ord").withColumn(
        "cid_approval_rate_pct", near("cid_approval_rate_pct", 6))


WINDOW_FIELDS = (
    "window_key", "baseline_start", "baseline_end", "observation_start", "observation_end", "baseline_days",
    "observation_days", "baseline_count", "observation_count", "baseline_daily", "observation_daily",
    "baseline_share", "observation_share", "growth_factor", "structure_lift_factor", "structure_change",
    "expected_count", "excess_count", "z_score", "level", "level_label", "severity",
)


@register("window_metrics", q.query([*q.base(), *q.single()], """
SELECT r.canonical_path, w AS window_key, bstart AS baseline_start, be AS baseline_end, os AS observation_start, oe AS observation_end,
  CAST(bd AS INTEGER) AS baseline_days, CAST(od AS INTEGER) AS observation_days, b AS baseline_count, o AS observation_count,
  b_daily AS baseline_daily, o_daily AS observation_daily, b_share AS baseline_share, o_share AS observation_share,
  g AS growth_factor, m.l AS structure_lift_factor, change AS structure_change, e AS expected_count, x AS excess_count,
  m.z AS z_score, CAST(m.level AS INTEGER) AS level,
  CASE m.level WHEN 0 THEN 'Level0 无预警' WHEN 1 THEN 'Level1 黄色' WHEN 2 THEN 'Level2 橙色' ELSE 'Level3 红色' END AS level_label,
  CASE m.level WHEN 0 THEN 'slate' WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' ELSE 'red' END AS severity
FROM single_w m JOIN single r ON """ + " AND ".join(f"m.{d} IS NOT DISTINCT FROM r.{d}" for d in q.DIMS)))
def window_metrics(spark, sf_dir):
    rows = R.single_records(lazy_base(spark, sf_dir)).select("canonical_path", F.explode("windows").alias("w"))
    return rows.select("canonical_path", *[f"w.{n}" for n in WINDOW_FIELDS])


@register("ranked_single_alerts", q.query([*q.base(), *q.single()], f"""
SELECT id, {q.RECORD_SELECT}, suppressed AS is_suppressed, CASE WHEN suppressed THEN 'long registration gap' ELSE '' END AS suppression_reasons,
  CAST(ROW_NUMBER() OVER (ORDER BY {q.ORDER}) AS INTEGER) - 1 AS sort_rank FROM single"""))
def ranked_single_alerts(spark, sf_dir):
    ranked = R.ranked(R.single_records(lazy_base(spark, sf_dir)), CFG.output_limit)
    return ranked.selectExpr("id", *RECORD_COLUMNS, "is_suppressed",
                             "array_join(suppression_reasons, '; ') as suppression_reasons", "sort_rank")


@register("single_seeds", q.query([*q.base(), *q.pair()], f"SELECT {q.RECORD_SELECT}, TRUE AS enters_next_level FROM seeds1"))
def single_seeds(spark, sf_dir):
    ok = R.eligible(R.single_records(lazy_base(spark, sf_dir)), CFG.level0_min_observation)
    return R.as_seeds(ok, CFG.single_limit, R.NOTE_SINGLE_SEED).selectExpr(*RECORD_COLUMNS, "enters_next_level")


@register("pair_records", q.query([*q.base(), *q.pair()], f"SELECT {q.RECORD_SELECT} FROM pair"))
def pair_records(spark, sf_dir):
    """Depth 2 as one lazy plan: seeds, broadcast match and extension without a stored step."""
    base = lazy_base(spark, sf_dir)
    ok = R.eligible(R.single_records(base), CFG.level0_min_observation)
    seeds = R.top(ok, CFG.single_limit)
    pairs = M.as_records(M.with_windows(R.extended_sums(base, seeds), base), CFG, source=M.SOURCE_TOPK)
    return pairs.selectExpr(*RECORD_COLUMNS)


@register("third_records", q.query([*q.base(), *q.third()], f"SELECT {q.RECORD_SELECT} FROM third"))
def third_records(spark, sf_dir):
    return full_run(spark, sf_dir).topk.third.selectExpr(*RECORD_COLUMNS)


@register("pair_seeds", q.query([*q.base(), *q.third()], f"SELECT {q.RECORD_SELECT} FROM seeds2"))
def pair_seeds(spark, sf_dir):
    return full_run(spark, sf_dir).topk.pair_seeds.selectExpr(*RECORD_COLUMNS)


@register("drilldown_counters", q.query([*q.base(), *q.third()], f"""
SELECT (SELECT COUNT(*) FROM single) AS single_scanned,
  (SELECT COUNT(*) FROM single WHERE NOT suppressed AND (level > 0 OR obs >= {q.FLOOR})) AS single_pool,
  (SELECT COUNT(*) FROM pair) AS pair_scanned,
  (SELECT COUNT(*) FROM pair WHERE NOT suppressed AND (level > 0 OR obs >= {q.FLOOR})) AS pair_pool,
  (SELECT COUNT(*) FROM third) AS third_scanned,
  (SELECT COUNT(*) FROM single WHERE NOT suppressed AND level > 0) AS single_alerts,
  (SELECT COUNT(*) FROM pair WHERE NOT suppressed AND level > 0) AS pair_alerts,
  (SELECT COUNT(*) FROM third WHERE NOT suppressed AND level > 0) AS third_alerts"""))
def drilldown_counters(spark, sf_dir):
    return full_run(spark, sf_dir).topk.counts


@register("topk_drilldown", q.query([*q.base(), *q.merged()], f"SELECT id, {q.RECORD_SELECT} FROM topk"))
def topk_drilldown(spark, sf_dir):
    """The whole drilldown, computed by this query: three depths over the stored day-level facts."""
    base = lazy_base(spark, sf_dir).materialised()
    return R.topk_drilldown(base).alerts.selectExpr("id", *RECORD_COLUMNS)


@register("expert_chain", q.query([*q.base(), *q.expert()], f"SELECT {q.RECORD_SELECT}, suppressed AS is_suppressed FROM expert"))
def expert_chain(spark, sf_dir):
    chain = R.expert_chain(lazy_base(spark, sf_dir), store_steps=False)
    every = chain.single.unionByName(chain.pair).unionByName(chain.third)
    return every.selectExpr(*RECORD_COLUMNS, "is_suppressed")


@register("merged_alerts", q.query([*q.base(), *q.merged()], f"""
SELECT canonical_path, level, hit_windows, obs AS observation_count, strength AS relative_strength, source,
  forced AS is_expert_forced, note AS rule_note FROM merged"""))
def merged_alerts(spark, sf_dir):
    return full_run(spark, sf_dir).merged.selectExpr(
        "canonical_path", "level", "array_join(hit_windows, ',') as hit_windows", "observation_count",
        "relative_strength", "source", "is_expert_forced", "rule_note")


@register("ranked_alert_list", q.query([*q.base(), *q.merged()], f"""
SELECT CAST(rn AS INTEGER) AS sort_rank, id, canonical_path, level FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {q.ORDER}) - 1 AS rn FROM merged) WHERE rn < {CFG.output_limit}"""))
def ranked_alert_list(spark, sf_dir):
    return full_run(spark, sf_dir).alerts.select("sort_rank", "id", "canonical_path", "level")


@register("suppressed_alerts", q.query([*q.base(), *q.merged()], "SELECT canonical_path, level, hit_windows FROM suppressed"))
def suppressed_alerts(spark, sf_dir):
    return full_run(spark, sf_dir).suppressed.selectExpr(
        "canonical_path", "level", "array_join(hit_windows, ',') as hit_windows")


@register("highlight", q.query([*q.base(), *q.merged()], "SELECT canonical_path, path, level, source FROM head"))
def highlight(spark, sf_dir):
    return full_run(spark, sf_dir).highlight.select("canonical_path", "path", "level", "source")


@register("alert_conditions", q.query([*q.base(), *q.merged()], " UNION ALL ".join(
    f"SELECT id, '{d}' AS field, {d} AS value FROM merged WHERE {d} IS NOT NULL" for d in q.DIMS)))
def alert_conditions(spark, sf_dir):
    return full_run(spark, sf_dir).merged.select("id", F.explode("conditions").alias("c")).select(
        "id", "c.field", "c.value")


@register("dashboard_summary", q.query([*q.base(), *q.merged()], """
SELECT CAST(SUM(total) AS DOUBLE) AS total_application_count,
  CAST(MAX(CASE WHEN rn = 1 THEN total END) AS DOUBLE) AS latest_application_count,
  CAST(MAX(CASE WHEN rn = 2 THEN total END) AS DOUBLE) AS previous_application_count,
  ROUND_EVEN((MAX(CASE WHEN rn = 1 THEN total END) / MAX(CASE WHEN rn = 2 THEN total END) - 1) * 100, 4) AS latest_day_change_pct,
  ROUND_EVEN(MAX(CASE WHEN rn = 1 THEN approvals / total END) * 100, 4) AS latest_approval_rate,
  ROUND_EVEN(MAX(CASE WHEN rn = 1 THEN person_approvals / persons END) * 100, 4) AS latest_cid_approval_rate_pct,
  CAST(SUM(approvals) AS DOUBLE) AS approval_count, CAST(SUM(persons) AS DOUBLE) AS cid_cnt,
  CAST(SUM(person_approvals) AS DOUBLE) AS approval_cid_cnt, CAST(SUM(jy0) AS DOUBLE) AS approval_jy0_count,
  (SELECT COUNT(*) FROM merged) AS merged_alert_count, (SELECT COUNT(*) FROM merged WHERE level = 3) AS level3_count,
  (SELECT COUNT(*) FROM merged WHERE level = 2) AS level2_count, (SELECT COUNT(*) FROM merged WHERE level = 1) AS level1_count,
  (SELECT COUNT(*) FROM xalerts) AS expert_alert_count, (SELECT COUNT(*) FROM suppressed) AS suppressed_alert_count,
  (SELECT path FROM head) AS highlight_path FROM kept"""))
def dashboard_summary(spark, sf_dir):
    return full_run(spark, sf_dir).summary()


@register("dashboard_meta", q.query(q.base(), f"""
SELECT MIN(day) AS date_start, MAX(day) AS date_end, COUNT(*) AS date_count, CAST(SUM(n_rows) AS BIGINT) AS aggregate_row_count,
  CAST({len(q.DIMS)} AS INTEGER) AS dimension_count, (SELECT MIN(create_date) FROM src) AS table_date_min,
  (SELECT MAX(create_date) FROM src) AS table_date_max FROM kept"""))
def dashboard_meta(spark, sf_dir):
    return full_run(spark, sf_dir).meta().drop("table", "partition", "version")


@register("dashboard_trend", q.query([*q.base(), *q.merged()], f"""
SELECT k.day AS date, CAST(k.total AS DOUBLE) AS application_count, CAST(k.approvals AS DOUBLE) AS approval_count,
  CAST(k.persons AS DOUBLE) AS cid_cnt, CAST(k.person_approvals AS DOUBLE) AS approval_cid_cnt,
  CAST(COALESCE((SELECT SUM(cnt) FROM f WHERE f.day = k.day AND systemtype = 'ios'), 0) AS DOUBLE) AS expert_seed_count,
  CAST(COALESCE((SELECT SUM(cnt) FROM f JOIN head h ON {' AND '.join(f'(h.{d} IS NULL OR h.{d} = f.{d})' for d in q.DIMS)}
    WHERE f.day = k.day), 0) AS DOUBLE) AS focus_path_count FROM kept k"""))
def dashboard_trend(spark, sf_dir):
    return full_run(spark, sf_dir).daily_trend()


RECORD = "struct<canonical_path:string,level:int,observation_count:double>"
DOCUMENT = (
    f"merged_alerts array<{RECORD}>, merged_alert_total bigint, suppressed_alerts array<{RECORD}>, suppressed_alert_total bigint, "
    f"highlight {RECORD}, top_k struct<single_downstream:array<{RECORD}>,pair_downstream:array<{RECORD}>,"
    f"third_alerts:array<{RECORD}>,third_alert_total:bigint,counts:struct<third_scanned:bigint>>, "
    f"expert struct<single:{RECORD},pair:{RECORD},third_alerts:array<{RECORD}>,third_calculated:array<{RECORD}>,"
    "third_calculated_total:bigint,alert_total:bigint>, "
    "daily_trend array<struct<date:string,application_count:double>>, "
    "rules struct<windows:array<struct<window_key:string,observation_days:int,observation_total:double>>,"
    "thresholds:array<struct<level:int,label:string,min_z_score:double>>,"
    "suppression_rules:array<struct<field:string,value:string>>,expert_path:array<struct<field:string,value:string>>,"
    "field_labels:map<string,string>>")


def document_sql() -> str:
    def records(part: str, source: str) -> str:
        return (f"SELECT '{part}' AS part, CAST(ROW_NUMBER() OVER (ORDER BY {q.ORDER}) - 1 AS INTEGER) AS place, "
                f"canonical_path AS item, CAST(level AS INTEGER) AS level, obs AS number FROM {source}")

    def total(part: str, source: str) -> str:
        return f"SELECT '{part}', 0, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(COUNT(*) AS DOUBLE) FROM {source}"

    def fixed(part: str, rows: list) -> str:
        listed = ", ".join(f"({i}, '{item}', {level}, {number})" for i, (item, level, number) in enumerate(rows))
        return (f"SELECT '{part}', CAST(i AS INTEGER), item, CAST(level AS INTEGER), CAST(number AS DOUBLE) "
                f"FROM (VALUES {listed}) AS v(i, item, level, number)")

    def cut(source: str) -> str:
        return f"(SELECT * FROM {source} ORDER BY {q.ORDER} LIMIT {CFG.output_limit})"

    found = "(SELECT * FROM third WHERE NOT suppressed AND level > 0)"
    deep = "(SELECT * FROM expert WHERE depth = 3 AND NOT suppressed)"
    parts = [
        records("merged_alerts", cut("merged")), total("merged_alert_total", "merged"),
        records("suppressed_alerts", cut("suppressed")), total("suppressed_alert_total", "suppressed"),
        records("highlight", "head"), records("single_downstream", "seeds1"), records("pair_downstream", "seeds2"),
        records("third_alerts", cut(found)), total("third_alert_total", found), total("third_scanned", "third"),
        records("expert_single", "(SELECT * FROM expert WHERE depth = 1)"),
        records("expert_pair", "(SELECT * FROM expert WHERE depth = 2)"),
        records("expert_third_alerts", cut("(SELECT * FROM expert WHERE depth = 3 AND NOT suppressed AND level > 0)")),
        records("expert_third_calculated", cut(deep)),
        total("expert_third_calculated_total", "(SELECT * FROM expert WHERE depth = 3)"),
        total("expert_alert_total", "(SELECT * FROM expert WHERE NOT suppressed AND level > 0)"),
        "SELECT 'daily_trend', CAST(ROW_NUMBER() OVER (ORDER BY day) - 1 AS INTEGER), CAST(day AS VARCHAR), NULL, CAST(total AS DOUBLE) FROM kept",
        "SELECT 'windows', CAST(ord AS INTEGER), w, CAST(od AS INTEGER), CAST(ot AS DOUBLE) FROM tot",
        fixed("thresholds", [(t.label, t.level, t.min_z_score) for t in CFG.thresholds]),
        fixed("suppression_rules", [(f"{r.field}={r.value}", "NULL", "NULL") for r in CFG.suppression_rules]),
        fixed("expert_path", [(f"{e.field}={e.value}", "NULL", "NULL") for e in CFG.expert_path]),
    ]
    if CFG.field_labels:
        parts.append(fixed("field_labels", [(f"{k}={v}", "NULL", "NULL") for k, v in sorted(CFG.field_labels.items())]))
    return q.query([*q.base(), *q.merged()], "\nUNION ALL ".join(f"SELECT * FROM ({p})" for p in parts))


@register("dashboard_document", document_sql())
def dashboard_document(spark, sf_dir):
    """The nested JSON document, parsed again and laid out as rows: every list by place, every total."""

    def items(part: str, rows: str, item: str, level: str = "cast(null as int)", number: str = "cast(null as double)") -> str:
        return (f"transform({rows}, (r, i) -> named_struct('part', '{part}', 'place', i, 'item', {item}, "
                f"'level', {level}, 'number', {number}))")

    def records(part: str, rows: str) -> str:
        return items(part, rows, "r.canonical_path", "r.level", "r.observation_count")

    def total(part: str, value: str) -> str:
        return items(part, f"array({value})", "cast(null as string)", number="cast(r as double)")

    pair = "concat(r.field, '=', r.value)"
    parts = [
        *[records(n, n) for n in ("merged_alerts", "suppressed_alerts")], records("highlight", "array(highlight)"),
        *[records(n, f"top_k.{n}") for n in ("single_downstream", "pair_downstream", "third_alerts")],
        records("expert_single", "array(expert.single)"), records("expert_pair", "array(expert.pair)"),
        *[records(f"expert_{n}", f"expert.{n}") for n in ("third_alerts", "third_calculated")],
        *[total(n, n) for n in ("merged_alert_total", "suppressed_alert_total")],
        total("third_alert_total", "top_k.third_alert_total"), total("third_scanned", "top_k.counts.third_scanned"),
        *[total(f"expert_{n}", f"expert.{n}") for n in ("third_calculated_total", "alert_total")],
        items("daily_trend", "daily_trend", "r.date", number="r.application_count"),
        items("windows", "rules.windows", "r.window_key", "r.observation_days", "r.observation_total"),
        items("thresholds", "rules.thresholds", "r.label", "r.level", "r.min_z_score"),
        items("suppression_rules", "rules.suppression_rules", pair), items("expert_path", "rules.expert_path", pair),
        items("field_labels", "array_sort(map_entries(rules.field_labels))", "concat(r.key, '=', r.value)"),
    ]
    parsed = full_run(spark, sf_dir).document().select(F.from_json("payload", DOCUMENT).alias("d")).select("d.*")
    return parsed.selectExpr(f"inline(concat({', '.join(parts)}))")


@register("partition_ranges", f"""
WITH {', '.join(q.with_clause('fx_app_snapshots'))}
SELECT pt, MIN(create_date) AS min_day, MAX(create_date) AS max_day FROM fx_app_snapshots GROUP BY pt""")
def partition_ranges(spark, sf_dir):
    return T.partition_ranges(view(spark, sf_dir, "fx_app_snapshots"), CFG)


def stored_snapshots(spark, sf_dir) -> str:
    """The snapshots as a table partitioned by pt, written once."""
    tag = hashlib.sha1(f"facts{spark.sparkContext.applicationId}{sf_dir}".encode()).hexdigest()[:12]
    path = f"{shared_dir(spark)}/pathlift-facts-{tag}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        view(spark, sf_dir, "fx_app_snapshots").write.partitionBy("pt").parquet(path)
    return path


@register("available_partitions", f"WITH {', '.join(q.with_clause('fx_app_snapshots'))} SELECT DISTINCT pt FROM fx_app_snapshots")
def available_partitions(spark, sf_dir):
    return T.available_partitions(spark, stored_snapshots(spark, sf_dir), CFG)


@register("newest_partition", f"WITH {', '.join(q.with_clause('fx_app_snapshots'))} SELECT MAX(pt) AS pt FROM fx_app_snapshots")
def newest_partition(spark, sf_dir):
    return T.newest_partitions(spark, stored_snapshots(spark, sf_dir), CFG, 1)


@register("observation_offsets", f"""
WITH {', '.join(q.with_clause('fx_app_snapshots'))}, r AS (SELECT pt, MAX(create_date) - MIN(create_date) AS span FROM fx_app_snapshots GROUP BY pt)
SELECT pt, CAST(o AS INTEGER) AS offset_days FROM r, (VALUES (0), (15), (30), (45)) AS v(o) WHERE o <= span""")
def observation_offsets(spark, sf_dir):
    return T.observation_offsets(T.partition_ranges(view(spark, sf_dir, "fx_app_snapshots"), CFG))


@register("upserted_ranges", f"""
WITH {', '.join(q.with_clause('fx_app_snapshots'))}
SELECT pt, CASE WHEN pt = '20240130' THEN MIN(create_date) + 1 ELSE MIN(create_date) END AS min_day, MAX(create_date) AS max_day
FROM fx_app_snapshots GROUP BY pt""")
def upserted_ranges(spark, sf_dir):
    """All ranges stored, then one key replaced: the others keep their rows and are not written again."""
    old = T.partition_ranges(view(spark, sf_dir, "fx_app_snapshots"), CFG)
    ranges = RunStore(spark, f"{shared_dir(spark)}/pathlift-ranges-{uuid.uuid4().hex[:12]}").ranges
    ranges.upsert(old)
    ranges.upsert(old.where("pt = '20240130'").withColumn("min_day", F.date_add("min_day", 1)))
    return ranges.current()


@register("fact_overview", f"""
WITH {', '.join(q.with_clause('fx_app_daily'))}
SELECT MIN(create_date) AS min_day, MAX(create_date) AS max_day, COUNT(*) AS aggregate_rows, CAST(SUM(cnt) AS BIGINT) AS cnt,
  CAST(SUM(approval_cnt) AS BIGINT) AS approval_cnt, CAST(SUM(approval_jy0_cnt) AS BIGINT) AS approval_jy0_cnt FROM fx_app_daily""")
def fact_overview(spark, sf_dir):
    return D.fact_overview(raw_facts(spark, sf_dir), CFG)


@register("fact_last_31_days", f"""
WITH {', '.join(q.with_clause('fx_app_daily'))}
SELECT create_date AS day, CAST(SUM(cnt) AS BIGINT) AS cnt FROM fx_app_daily GROUP BY 1 ORDER BY 1 DESC LIMIT 31""")
def fact_last_31_days(spark, sf_dir):
    return D.last_days(raw_facts(spark, sf_dir), CFG)
