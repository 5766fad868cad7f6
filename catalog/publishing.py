"""Registered queries: panel, trend, status, tracked rules, run store and read queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import attribution_sql as q
from catalog.attribution import full_run, raw_facts, stored_facts
from catalog.rounding import near, registry
from pathlift.functions.paths import from_canonical
from pathlift.operators import daily as D, panel as L, status as S
from pathlift.plans import publish as P, read_queries as R
from pathlift.session import cut_lineage, shared_dir
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view, with_clause
from pathlift.sources.store import RunStore

QUERIES, ORACLE, register = registry()
_CACHE: dict = {}
OLD_PT, NEW_PT = "20240129", "20240130"
TRACKED_PATH = "traffic_channel=purchase"
TRACKED_ID = hashlib.sha1(TRACKED_PATH.encode()).hexdigest()[:12]


def cached(kind: str, spark: SparkSession, sf_dir: str, make):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = full_run(spark, sf_dir)
    return run.merged.select("id", *CFG.dimensions).unionByName(run.suppressed.select("id", *CFG.dimensions)).distinct()


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        facts = D.facts_in_range(raw_facts(spark, sf_dir), CFG, NEW_PT, trend=True)
        return cut_lineage(L.path_daily(facts, all_paths(spark, sf_dir), CFG))

    return cached("panel", spark, sf_dir, make)


def tracked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_status_log")
    current = S.current_status(log)
    rules = S.active_rules(current, S.status_intervals(log))
    return rules.select("canonical_path", "status", F.col("entered_pt").alias("entered_day")).withColumns(
        from_canonical("canonical_path", CFG.dimensions))


def store(spark: SparkSession, sf_dir: str) -> RunStore:
    """Two published partitions of the snapshots table; the newer one with tracked rules."""

    def make():
        tag = hashlib.sha1(f"{spark.sparkContext.applicationId}{sf_dir}".encode()).hexdigest()[:12]
        target = RunStore(spark, f"{shared_dir(spark)}/pathlift-store-{tag}")
        facts = stored_facts(spark, sf_dir, "fx_app_snapshots")
        P.publish(facts, CFG, target, OLD_PT)
        P.publish(facts, CFG, target, NEW_PT, tracked=cut_lineage(tracked_rules(spark, sf_dir)))
        return target

    return cached("store", spark, sf_dir, make)


# --- SQL building blocks ---------------------------------------------------------------------------------------

COND = " AND ".join(f"(p.{d} IS NULL OR p.{d} = f.{d})" for d in q.DIMS)
PANEL = [
    *q.base(), *q.merged(),
    f"paths AS (SELECT id, {q.COLS} FROM merged UNION SELECT id, {q.COLS} FROM suppressed)",
    f"""psum AS (SELECT p.id, f.day, SUM(f.cnt) AS n, SUM(f.approval_cnt) AS a, SUM(f.cid_cnt) AS c,
        SUM(f.approval_cid_cnt) AS ca FROM paths p JOIN f ON {COND} GROUP BY p.id, f.day)""",
    """panel AS (SELECT p.id AS alert_id, d.day AS date, CAST(COALESCE(n, 0) AS DOUBLE) AS application_count,
        CAST(d.total AS DOUBLE) AS total_application_count, CAST(COALESCE(a, 0) AS DOUBLE) AS approval_count,
        CAST(COALESCE(c, 0) AS DOUBLE) AS cid_cnt, CAST(COALESCE(ca, 0) AS DOUBLE) AS approval_cid_cnt
        FROM paths p CROSS JOIN daily d LEFT JOIN psum s ON s.id = p.id AND s.day = d.day)""",
]

LOG = [
    *with_clause("fx_status_log"),
    """ch AS (SELECT * FROM (SELECT *, LAG(status) OVER (PARTITION BY canonical_path ORDER BY updated_at, id) AS prev
        FROM fx_status_log) WHERE prev IS NULL OR prev <> status)""",
    """ch2 AS (SELECT *, LEAD(updated_at) OVER w AS n_at, LEAD(action_date) OVER w AS n_date, LEAD(updated_by) OVER w AS n_by
        FROM ch WINDOW w AS (PARTITION BY canonical_path ORDER BY updated_at, id))""",
    """iv AS (SELECT id, canonical_path, status, updated_at AS entered_at, action_date AS entered_pt,
        updated_by AS entered_by, n_at AS exited_at, n_date AS exited_pt, n_by AS exited_by, n_at IS NULL AS is_active
        FROM ch2 WHERE status IN (1, 2))""",
    """lastlog AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY canonical_path ORDER BY updated_at DESC, id DESC) AS rn
        FROM fx_status_log) WHERE rn = 1)""",
    """opened AS (SELECT canonical_path, action_date FROM (SELECT *, ROW_NUMBER() OVER
        (PARTITION BY canonical_path ORDER BY updated_at DESC, id DESC) AS rn FROM ch) WHERE rn = 1)""",
    """cur AS (SELECT l.canonical_path, l.status, l.updated_by, l.updated_at,
        CASE WHEN l.status IN (1, 2) THEN o.action_date END AS action_date FROM lastlog l JOIN opened o USING (canonical_path))""",
    """act AS (SELECT c.*, COALESCE(i.entered_pt, c.action_date) AS entered_pt FROM cur c
        LEFT JOIN (SELECT canonical_path, entered_pt FROM iv WHERE is_active) i USING (canonical_path) WHERE c.status IN (1, 2))""",
]

TRACKED = [
    *LOG,
    f"""tp AS (SELECT canonical_path AS rule, entered_pt AS entered, {', '.join(
        f"SUBSTR(canonical_path, {len(d) + 2}) AS {d}" if d == 'traffic_channel' else f'CAST(NULL AS VARCHAR) AS {d}'
        for d in q.DIMS)} FROM act)""",
    f"""tracked_src AS (SELECT {', '.join('p.' + d for d in q.DIMS)}, k.rn, COALESCE(SUM(f.cnt), 0) AS c
        FROM tp p CROSS JOIN kept k LEFT JOIN f ON f.day = k.day AND f.day >= p.entered AND {COND}
        GROUP BY {', '.join('p.' + d for d in q.DIMS)}, k.rn)""",
    *q.records("tracked"),
]


def unique(ctes: list[str]) -> list[str]:
    seen, out = set(), []
    for c in ctes:
        name = c.split(" AS ", 1)[0]
        if name not in seen:
            seen.add(name)
            out.append(c)
    return out


def pub(pt: str) -> list[str]:
    """Alerts of a published partition."""
    head = [*q.base(pt, "fx_app_snapshots"), *q.merged()]
    cols = "canonical_path, path, id, level, hits, hit_windows, primary_window, obs, growth, lift, z, strength"
    if pt != NEW_PT:
        return [*head, f"""published AS (SELECT {cols}, FALSE AS is_tracked_only, CAST(NULL AS DATE) AS tracking_start
            , ROW_NUMBER() OVER (ORDER BY {q.ORDER}) - 1 AS sort_rank FROM merged)"""]
    return unique([
        *head, *TRACKED,
        f"""allrows AS (SELECT {cols}, FALSE AS is_tracked_only, CAST(NULL AS DATE) AS tracking_start FROM merged
            WHERE canonical_path NOT IN (SELECT canonical_path FROM tracked) UNION ALL
            SELECT {', '.join('t.' + c.strip() for c in cols.split(','))},
            t.canonical_path NOT IN (SELECT canonical_path FROM merged), p.entered
            FROM tracked t JOIN tp p ON p.rule = t.canonical_path)""",
        f"""published AS (SELECT *, ROW_NUMBER() OVER (ORDER BY is_tracked_only, {q.ORDER}) - 1 AS sort_rank FROM allrows)""",
    ])


SUMMARY = """CAST(SUM(total) AS DOUBLE) AS total_application_count,
  CAST(MAX(CASE WHEN rn = 1 THEN total END) AS DOUBLE) AS latest_application_count,
  CAST(MAX(CASE WHEN rn = 2 THEN total END) AS DOUBLE) AS previous_application_count,
  ROUND_EVEN((MAX(CASE WHEN rn = 1 THEN total END) / MAX(CASE WHEN rn = 2 THEN total END) - 1) * 100, 4) AS latest_day_change_pct,
  ROUND_EVEN(MAX(CASE WHEN rn = 1 THEN approvals / total END) * 100, 4) AS latest_approval_rate,
  ROUND_EVEN(MAX(CASE WHEN rn = 1 THEN person_approvals / persons END) * 100, 4) AS latest_cid_approval_rate_pct,
  CAST(SUM(approvals) AS DOUBLE) AS approval_count, CAST(SUM(persons) AS DOUBLE) AS cid_cnt,
  CAST(SUM(person_approvals) AS DOUBLE) AS approval_cid_cnt, CAST(SUM(jy0) AS DOUBLE) AS approval_jy0_count,
  (SELECT COUNT(*) FROM merged) AS merged_alert_count, (SELECT COUNT(*) FROM merged WHERE level = 3) AS level3_count,
  (SELECT COUNT(*) FROM merged WHERE level = 2) AS level2_count, (SELECT COUNT(*) FROM merged WHERE level = 1) AS level1_count,
  (SELECT COUNT(*) FROM xalerts) AS expert_alert_count, (SELECT COUNT(*) FROM suppressed) AS suppressed_alert_count"""
RATIOS = """SUM(person_approvals) / SUM(persons) AS person_approval_ratio, SUM(approvals) / SUM(total) AS item_approval_ratio"""
SUMMARY_FIELDS = (
    "total_application_count latest_application_count previous_application_count latest_day_change_pct "
    "latest_approval_rate latest_cid_approval_rate_pct approval_count cid_cnt approval_cid_cnt approval_jy0_count "
    "merged_alert_count level3_count level2_count level1_count expert_alert_count suppressed_alert_count "
    "tracked_rule_count person_approval_ratio item_approval_ratio").split()


def tracked_count(pt: str) -> str:
    return "(SELECT COUNT(*) FROM act WHERE status = 2)" if pt == NEW_PT else "0"


def summary_sql(pt: str) -> str:
    return q.query(pub(pt), f"SELECT {SUMMARY}, {tracked_count(pt)} AS tracked_rule_count, {RATIOS} FROM kept")


# --- panel and trend ---------------------------------------------------------------------------------------------


@register("exact_path_daily", q.query(q.base(), """
SELECT day, CAST(SUM(cnt) AS DOUBLE) AS application_count, CAST(SUM(approval_cnt) AS DOUBLE) AS approval_count,
  CAST(SUM(cid_cnt) AS DOUBLE) AS cid_cnt, CAST(SUM(approval_cid_cnt) AS DOUBLE) AS approval_cid_cnt
FROM f WHERE systemtype = 'none' AND device_brand = 'none' GROUP BY day"""))
def exact_path_daily(spark, sf_dir):
    facts = D.facts_in_range(raw_facts(spark, sf_dir), CFG, trend=True)
    return L.exact_daily(facts, {"systemtype": " ", "device_brand": "none"}, CFG)


@register("path_daily_panel", q.query(PANEL, "SELECT * FROM panel"))
def path_daily_panel(spark, sf_dir):
    return panel(spark, sf_dir)


@register("path_daily_unbounded", q.query(PANEL, "SELECT * FROM panel"))
def path_daily_unbounded(spark, sf_dir):
    """Same panel from a path list that is not stored, so that the planner does not know its size."""
    facts = D.facts_in_range(raw_facts(spark, sf_dir), CFG, NEW_PT, trend=True)
    return L.path_daily(facts, all_paths(spark, sf_dir), CFG)


WIN_ROWS = " UNION ALL ".join(
    f"SELECT r.id, m.w, m.os, m.oe, m.o, r.primary_window FROM {n}_w m JOIN {n} r ON "
    + " AND ".join(f"m.{d} IS NOT DISTINCT FROM r.{d}" for d in q.DIMS)
    for n in ("single", "pair", "third", "expert")
)


@register("window_approvals", q.query([*PANEL, f"wr AS (SELECT DISTINCT * FROM ({WIN_ROWS}))"], """
SELECT wr.id AS alert_id, wr.w AS window_key, wr.w = wr.primary_window AS is_primary, SUM(p.approval_count) AS approval_count,
  ROUND(CASE WHEN wr.o > 0 THEN SUM(p.approval_count) / wr.o * 100 END, 6) AS approval_rate_pct,
  SUM(p.cid_cnt) AS cid_cnt, SUM(p.approval_cid_cnt) AS approval_cid_cnt,
  ROUND(CASE WHEN SUM(p.cid_cnt) > 0 THEN SUM(p.approval_cid_cnt) / SUM(p.cid_cnt) * 100 END, 6) AS cid_approval_rate_pct
FROM wr JOIN merged ON merged.id = wr.id LEFT JOIN panel p ON p.alert_id = wr.id AND p.date BETWEEN wr.os AND wr.oe
GROUP BY wr.id, wr.w, wr.primary_window, wr.o"""))
def window_approvals(spark, sf_dir):
    df = L.window_approvals(full_run(spark, sf_dir).merged, panel(spark, sf_dir))
    return df.withColumns({c: near(c, 6) for c in ("approval_rate_pct", "cid_approval_rate_pct")})


@register("trend_context", q.query(q.base(), """
SELECT day AS date, CAST(total AS DOUBLE) AS application_count FROM daily ORDER BY day DESC LIMIT 15"""))
def trend_context(spark, sf_dir):
    return L.trend_context(panel(spark, sf_dir), 15)


TREND = [*PANEL, """trend AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY alert_id ORDER BY date DESC) AS rn,
    CASE WHEN total_application_count <> 0 THEN application_count / total_application_count * 100 ELSE 0 END AS share,
    CASE WHEN application_count > 0 THEN approval_count / application_count * 100 ELSE 0 END AS rate,
    CASE WHEN cid_cnt > 0 THEN approval_cid_cnt / cid_cnt * 100 ELSE 0 END AS prate FROM panel) WHERE rn <= 15)"""]


@register("path_trend_rows", q.query(TREND, """
SELECT alert_id, date, application_count, total_application_count, ROUND(share, 6) AS application_share_pct, approval_count,
  ROUND(rate, 6) AS approval_rate_pct, cid_cnt, approval_cid_cnt, ROUND(prate, 6) AS cid_approval_rate_pct FROM trend"""))
def path_trend_rows(spark, sf_dir):
    df = L.trend_rows(panel(spark, sf_dir), 15)
    return df.withColumns({c: near(c, 6) for c in
                           ("application_share_pct", "approval_rate_pct", "cid_approval_rate_pct")})


@register("path_trend_summary", q.query(TREND, """
SELECT alert_id, COUNT(*) AS period_days, SUM(application_count) AS period_application_count,
  MAX(CASE WHEN rn = 1 THEN application_count END) AS latest_application_count,
  MAX(CASE WHEN rn = 2 THEN application_count END) AS previous_application_count,
  ROUND(CASE WHEN MAX(CASE WHEN rn = 2 THEN application_count END) > 0 THEN
    (MAX(CASE WHEN rn = 1 THEN application_count END) / MAX(CASE WHEN rn = 2 THEN application_count END) - 1) * 100 ELSE 0 END, 6)
    AS latest_day_change_pct,
  MAX(application_count) AS peak_application_count,
  ARG_MAX(date, application_count * 100000 + rn) AS peak_date,
  ROUND(MAX(CASE WHEN rn = 1 THEN share END), 6) AS latest_application_share_pct,
  ROUND(MAX(CASE WHEN rn = 1 THEN rate END), 6) AS latest_approval_rate_pct,
  ROUND(MAX(CASE WHEN rn = 1 THEN prate END), 6) AS latest_cid_approval_rate_pct FROM trend GROUP BY alert_id"""))
def path_trend_summary(spark, sf_dir):
    df = L.trend_summary(L.trend_rows(panel(spark, sf_dir), 15))
    rounded = [c for c in df.columns if c.endswith("_pct")]
    return df.withColumns({c: near(c, 6) for c in rounded})


# --- status --------------------------------------------------------------------------------------------------------


@register("status_intervals", q.query(LOG, "SELECT * FROM iv"))
def status_intervals(spark, sf_dir):
    return S.status_intervals(view(spark, sf_dir, "fx_status_log"))


@register("current_status", q.query(LOG, "SELECT * FROM cur"))
def current_status(spark, sf_dir):
    return S.current_status(view(spark, sf_dir, "fx_status_log"))


@register("active_rules", q.query(LOG, "SELECT * FROM act"))
def active_rules(spark, sf_dir):
    log = view(spark, sf_dir, "fx_status_log")
    return S.active_rules(S.current_status(log), S.status_intervals(log))


@register("tagged_rules", q.query(LOG, """
SELECT canonical_path, status, 'current' AS seen_in FROM cur WHERE status IN (1, 2) UNION ALL
SELECT canonical_path, ARG_MAX(status, entered_at), 'history' FROM iv
WHERE canonical_path NOT IN (SELECT canonical_path FROM cur WHERE status IN (1, 2)) GROUP BY canonical_path"""))
def tagged_rules(spark, sf_dir):
    log = view(spark, sf_dir, "fx_status_log")
    return S.tagged_rules(S.current_status(log), S.status_intervals(log))


@register("status_overlay", q.query(unique([*q.base(), *q.merged(), *LOG]), """
SELECT m.canonical_path, m.level, COALESCE(c.status, 0) AS status, c.updated_at AS status_updated_at,
  c.updated_by AS status_updated_by, c.action_date, a.entered_pt AS tracking_start_pt
FROM merged m LEFT JOIN cur c USING (canonical_path) LEFT JOIN act a USING (canonical_path)"""))
def status_overlay(spark, sf_dir):
    log = view(spark, sf_dir, "fx_status_log")
    current = S.current_status(log)
    active = S.active_rules(current, S.status_intervals(log))
    merged = full_run(spark, sf_dir).merged.select("canonical_path", "level")
    return S.overlay_status(merged, current, active)


DEFINED = [
    *TRACKED, *with_clause("fx_rule_alerts"),
    """told AS (SELECT p.rule, a.*, a.pt <= STRFTIME(p.entered, '%Y%m%d') AS before FROM tp p JOIN fx_rule_alerts a ON a.canonical_path = p.rule)""",
    f"""defs AS (SELECT rule, {', '.join(f"COALESCE(ARG_MAX({c}, pt) FILTER (WHERE before), ARG_MIN({c}, pt)) AS {c}" for c in ('source', 'is_expert_forced', 'rule_note', 'path'))}
        FROM told GROUP BY rule)""",
]


@register("tracked_records", q.query(unique([*q.base(), *DEFINED]), """
SELECT t.canonical_path, level, hit_windows, primary_window, obs AS observation_count, growth AS growth_factor,
  lift AS structure_lift_factor, z AS z_score, p.entered AS tracking_start, COALESCE(d.source, '已跟踪规则') AS source,
  COALESCE(d.is_expert_forced, FALSE) AS is_expert_forced, COALESCE(d.rule_note, '') AS rule_note, COALESCE(d.path, t.path) AS path,
  CASE WHEN d.rule IS NULL THEN 1 ELSE 2 END AS conditions
FROM tracked t JOIN tp p ON p.rule = t.canonical_path LEFT JOIN defs d ON d.rule = t.canonical_path"""))
def tracked_records(spark, sf_dir):
    """Tagged rules with the definitions valid on their day; the fixture's definitions have one condition more."""
    base = D.Base.of(raw_facts(spark, sf_dir), CFG)
    part = F.struct(F.lit("x").alias("field"), F.lit("y").alias("value"), F.lit("z").alias("label"))
    alerts = view(spark, sf_dir, "fx_rule_alerts").withColumn("conditions", F.array(part, part))
    rules = S.with_definitions(tracked_rules(spark, sf_dir), S.definition_history(alerts))
    return S.tracked_records(base, rules).selectExpr(
        "canonical_path", "level", "array_join(hit_windows, ',') as hit_windows", "primary_window",
        "observation_count", "growth_factor", "structure_lift_factor", "z_score", "tracking_start",
        "source", "is_expert_forced", "rule_note", "path", "size(conditions) as conditions")


@register("rule_definitions", "WITH " + ", ".join(with_clause("fx_rule_alerts")) + """
SELECT canonical_path, pt AS valid_from, source, is_expert_forced, rule_note FROM (
  SELECT *, LAG(source) OVER w AS s0, LAG(rule_note) OVER w AS n0 FROM fx_rule_alerts WINDOW w AS (PARTITION BY canonical_path ORDER BY pt))
WHERE s0 IS NULL OR s0 <> source OR n0 <> rule_note""")
def rule_definitions(spark, sf_dir):
    alerts = view(spark, sf_dir, "fx_rule_alerts").withColumn("conditions", F.array(F.lit(1)))
    return S.definition_history(alerts).select("canonical_path", "valid_from", "source", "is_expert_forced", "rule_note")


# --- store and read queries -----------------------------------------------------------------------------------------


@register("published_alerts", q.query(pub(NEW_PT), """
SELECT id, canonical_path, level, hit_windows, obs AS observation_count, is_tracked_only, tracking_start,
  CAST(sort_rank AS INTEGER) AS sort_rank FROM published"""))
def published_alerts(spark, sf_dir):
    return store(spark, sf_dir).snapshot("alerts", NEW_PT).selectExpr(
        "id", "canonical_path", "level", "array_join(hit_windows, ',') as hit_windows", "observation_count",
        "is_tracked_only", "tracking_start", "sort_rank")


def stored_counts(pt: str) -> str:
    """Rows of the tables of a published partition, by stage."""
    return " UNION ALL ".join(f"SELECT '{pt}' AS pt, '{stage}' AS stage, (SELECT COUNT(*) FROM {source}) AS rows" for stage, source in (
        ("store/alerts", "published"), ("store/suppressed", "suppressed"), ("store/daily_trend", "kept"),
        ("store/summary", "(SELECT 1)"), ("panel/path_daily", "panel_rows")))


def counted(pt: str) -> list[str]:
    ids = "SELECT id FROM published UNION SELECT id FROM suppressed"
    return [*pub(pt), f"panel_rows AS (SELECT i.id, d.day FROM ({ids}) i CROSS JOIN daily d)"]


STAGE_ROWS = " UNION ALL ".join(
    f"(SELECT * FROM ({q.query(counted(pt), stored_counts(pt))}))" for pt in (OLD_PT, NEW_PT))


@register("stage_log", f"""
SELECT pt, stage, rows, CAST(NULL AS VARCHAR) AS error FROM ({STAGE_ROWS}) UNION ALL
SELECT pt, stage, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM (VALUES ('{OLD_PT}'), ('{NEW_PT}')) AS p(pt),
  (VALUES ('compute'), ('panel'), ('store'), ('publish')) AS s(stage)""")
def stage_log(spark, sf_dir):
    """Stages of the published attempts, with the rows of the tables whose size SQL can tell."""
    s = store(spark, sf_dir)
    told = ("store/alerts", "store/suppressed", "store/daily_trend", "store/summary", "panel/path_daily",
            "compute", "panel", "store", "publish")
    log = s.stages().join(s.pointers().select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
    return log.where(F.col("stage").isin(*told)).select("pt", "stage", "rows", "error")


@register("republished_tables", q.query(counted(OLD_PT), stored_counts(OLD_PT)))
def republished_tables(spark, sf_dir):
    """Rows per table that readers see after a partition was published again and a third attempt was lost midway."""

    def make():
        tag = hashlib.sha1(f"again{spark.sparkContext.applicationId}{sf_dir}".encode()).hexdigest()[:12]
        target = RunStore(spark, f"{shared_dir(spark)}/pathlift-store-{tag}")
        facts = stored_facts(spark, sf_dir, "fx_app_snapshots")
        P.publish(facts, CFG, target, OLD_PT)
        P.publish(facts, CFG, target, OLD_PT)
        lost = target.attempt(CFG.run_id(OLD_PT))
        lost.write("alerts", target.snapshot("alerts", OLD_PT).limit(1))
        return target

    seen = cached("again", spark, sf_dir, make)
    counts = [
        seen.snapshot(stage.split("/")[1], OLD_PT).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(OLD_PT).alias("pt"), F.lit(stage).alias("stage"), "rows")
        for stage in ("store/alerts", "store/suppressed", "store/daily_trend", "store/summary", "panel/path_daily")]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@register("published_index", f"""
WITH {', '.join(with_clause('fx_app_snapshots'))} SELECT DISTINCT pt, CAST(0 AS INTEGER) AS offset_days FROM fx_app_snapshots""")
def published_index(spark, sf_dir):
    return store(spark, sf_dir).published().select("pt", "offset_days")


@register("run_status", f"""
WITH {', '.join(with_clause('fx_app_snapshots'))}
SELECT pt, MIN(create_date) AS window_start, MAX(create_date) AS window_end, MIN(create_date) AS table_date_min,
  MAX(create_date) AS table_date_max, 'scheduled' AS source
FROM fx_app_snapshots GROUP BY pt""")
def run_status(spark, sf_dir):
    return store(spark, sf_dir).status(10).select(
        "pt", "window_start", "window_end", "table_date_min", "table_date_max", "source")


@register("latest_runs", f"""
WITH {', '.join(with_clause('fx_app_snapshots'))} SELECT DISTINCT pt, 'fixture' AS config_version FROM fx_app_snapshots""")
def latest_runs(spark, sf_dir):
    return store(spark, sf_dir).latest_runs().select("pt", "config_version")


@register("latest_partition", f"""
WITH {', '.join(with_clause('fx_app_snapshots'))} SELECT MAX(pt) AS latest_partition FROM fx_app_snapshots""")
def latest_partition(spark, sf_dir):
    return R.latest_partition(store(spark, sf_dir))


@register("stored_daily_trend", q.query(q.base(OLD_PT, "fx_app_snapshots"), """
SELECT day AS date, CAST(total AS DOUBLE) AS application_count, CAST(approvals AS DOUBLE) AS approval_count FROM kept"""))
def stored_daily_trend(spark, sf_dir):
    return store(spark, sf_dir).snapshot("daily_trend", OLD_PT).select("date", "application_count", "approval_count")


@register("ingested_trend", q.query(q.base(OLD_PT, "fx_app_snapshots"), f"""
SELECT '{OLD_PT}_0_elsewhere' AS run_id, day AS date, CAST(total AS DOUBLE) AS application_count, CAST(approvals AS DOUBLE) AS approval_count,
  CAST(NULL AS DOUBLE) AS focus_path_count FROM kept"""))
def ingested_trend(spark, sf_dir):
    """A trend computed elsewhere, handed over as JSON lines without one of the columns."""

    def make():
        tag = uuid.uuid4().hex[:12]
        source, target = f"{shared_dir(spark)}/pathlift-handed-{tag}", RunStore(spark, f"{shared_dir(spark)}/pathlift-store-{tag}")
        rows = store(spark, sf_dir).snapshot("daily_trend", OLD_PT).drop("run_id", "focus_path_count")
        rows.write.json(f"{source}/daily_trend")
        target.ingest(source, f"{OLD_PT}_0_elsewhere", OLD_PT, 0, ("daily_trend",))
        return target

    return cached("ingested", spark, sf_dir, make).snapshot("daily_trend", OLD_PT).select(
        "run_id", "date", "application_count", "approval_count", "focus_path_count")


@register("older_panel", q.query(PANEL, """
SELECT 'older' AS run_id, alert_id, date, application_count, CAST(NULL AS DOUBLE) AS cid_cnt, CAST(NULL AS DATE) AS tracking_start FROM panel"""))
def older_panel(spark, sf_dir):
    """A panel stored before there were attempts and the newer columns: read under the full schema."""

    def make():
        target = RunStore(spark, f"{shared_dir(spark)}/pathlift-store-{uuid.uuid4().hex[:12]}")
        rows = panel(spark, sf_dir).select("alert_id", "date", "application_count")
        rows.write.parquet(f"{target.path('path_daily')}/run_id=older")
        return target

    return cached("older", spark, sf_dir, make).read("path_daily").select(
        "run_id", "alert_id", "date", "application_count", "cid_cnt", "tracking_start")


@register("stored_alert_windows", q.query(
    [*q.base(OLD_PT, "fx_app_snapshots"), *q.merged(), f"wr AS (SELECT DISTINCT * FROM ({WIN_ROWS}))",
     "both_ AS (SELECT id FROM merged UNION SELECT id FROM suppressed)"], """
SELECT wr.id AS alert_id, wr.w AS window_key, wr.os AS observation_start, wr.oe AS observation_end, wr.o AS observation_count
FROM wr JOIN both_ ON both_.id = wr.id"""))
def stored_alert_windows(spark, sf_dir):
    return store(spark, sf_dir).snapshot("alert_windows", OLD_PT).select(
        "alert_id", "window_key", "observation_start", "observation_end", "observation_count")


@register("published_summary", q.query(
    pub(NEW_PT), f"""SELECT {SUMMARY}, {tracked_count(NEW_PT)} AS tracked_rule_count, {RATIOS}, (SELECT path FROM head) AS highlight_path,
  CONCAT_WS('; ', CASE WHEN SUM(persons) = 0 THEN 'person_approval_ratio: cid_cnt is 0' END,
    CASE WHEN SUM(total) = 0 THEN 'item_approval_ratio: total_application_count is 0' END) AS warnings FROM kept"""))
def published_summary(spark, sf_dir):
    return R.dashboard_summary(store(spark, sf_dir), NEW_PT).drop("run_id").withColumn(
        "warnings", F.array_join("warnings", "; "))


@register("find_rules", q.query(pub(NEW_PT), """
SELECT id, canonical_path, level FROM published WHERE CONTAINS(LOWER(canonical_path), 'traffic_channel=click') AND level = 2"""))
def find_rules(spark, sf_dir):
    return R.find_rules(store(spark, sf_dir), NEW_PT, "Traffic_Channel=CLICK", "level2").select(
        "id", "canonical_path", "level")


@register("find_rules_by_status", q.query(pub(NEW_PT), """
SELECT p.id, p.canonical_path, c.status FROM published p JOIN cur c USING (canonical_path) WHERE c.status = 1"""))
def find_rules_by_status(spark, sf_dir):
    statuses = S.current_status(view(spark, sf_dir, "fx_status_log"))
    return R.find_rules(store(spark, sf_dir), NEW_PT, status="已上策略", statuses=statuses).select(
        "id", "canonical_path", "status")


@register("filtered_rules", q.query(pub(OLD_PT), """
SELECT p.id, p.canonical_path FROM published p JOIN merged m USING (canonical_path)
WHERE p.level = 2 AND m.anomaly_type = '持续高位' AND m.depth = 3"""))
def filtered_rules(spark, sf_dir):
    rows = store(spark, sf_dir).snapshot("alerts", OLD_PT)
    return R.filter_rules(rows, level=2, anomaly="持续高位", layer="三级").select("id", "canonical_path")


@register("rule_detail", q.query(pub(NEW_PT), f"""
SELECT id, canonical_path, path, level, growth AS growth_factor FROM published WHERE canonical_path = '{TRACKED_PATH}'"""))
def rule_detail(spark, sf_dir):
    return R.rule_detail(store(spark, sf_dir), NEW_PT, TRACKED_PATH.upper()).select(
        "id", "canonical_path", "path", "level", "growth_factor")


@register("path_trend", q.query(pub(NEW_PT), f"""
SELECT '{TRACKED_ID}' AS alert_id, d.day AS date, CAST(COALESCE(s.n, 0) AS DOUBLE) AS application_count,
  ROUND(COALESCE(s.n, 0) / d.total * 100, 6) AS application_share_pct,
  ROUND(s.a / NULLIF(s.n, 0), 6) AS item_approval_ratio, ROUND(s.ca / NULLIF(s.c, 0), 6) AS person_approval_ratio
FROM daily d JOIN act ON act.canonical_path = '{TRACKED_PATH}' AND d.day >= act.entered_pt
LEFT JOIN (SELECT day, SUM(cnt) AS n, SUM(approval_cnt) AS a, SUM(cid_cnt) AS c, SUM(approval_cid_cnt) AS ca
  FROM f WHERE traffic_channel = 'purchase' GROUP BY day) s ON s.day = d.day ORDER BY d.day DESC LIMIT 7"""))
def path_trend(spark, sf_dir):
    df = R.path_trend(store(spark, sf_dir), NEW_PT, TRACKED_ID, 7)
    return df.select(
        "alert_id", "date", "application_count", near("application_share_pct", 6).alias("application_share_pct"),
        near("item_approval_ratio", 6).alias("item_approval_ratio"),
        near("person_approval_ratio", 6).alias("person_approval_ratio"))


@register("tracked_rule_followup", f"""
SELECT '20240128' AS pt, FALSE AS available, FALSE AS matched, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS INTEGER) AS level
UNION ALL ({q.query(pub(OLD_PT), f'''SELECT '{OLD_PT}', TRUE, (SELECT COUNT(*) > 0 FROM published WHERE canonical_path = '{TRACKED_PATH}'),
  (SELECT MAX(id) FROM published WHERE canonical_path = '{TRACKED_PATH}'), (SELECT MAX(level) FROM published WHERE canonical_path = '{TRACKED_PATH}')''')})
UNION ALL ({q.query(pub(NEW_PT), f'''SELECT '{NEW_PT}', TRUE, (SELECT COUNT(*) > 0 FROM published WHERE canonical_path = '{TRACKED_PATH}'),
  (SELECT MAX(id) FROM published WHERE canonical_path = '{TRACKED_PATH}'), (SELECT MAX(level) FROM published WHERE canonical_path = '{TRACKED_PATH}')''')})""")
def tracked_rule_followup(spark, sf_dir):
    return R.tracked_rule_followup(store(spark, sf_dir), TRACKED_PATH, "20240128", NEW_PT).select(
        "pt", "available", "matched", "id", "level")


@register("compare_partitions", f"""
WITH a AS ({summary_sql(OLD_PT)}), b AS ({summary_sql(NEW_PT)})
{' UNION ALL '.join(f"SELECT '{c}' AS field, ROUND(CAST(a.{c} AS DOUBLE), 8) AS value_a, ROUND(CAST(b.{c} AS DOUBLE), 8) AS value_b, ROUND(CAST(b.{c} AS DOUBLE) - CAST(a.{c} AS DOUBLE), 8) AS delta FROM a, b" for c in SUMMARY_FIELDS)}""")
def compare_partitions(spark, sf_dir):
    df = R.compare_partitions(store(spark, sf_dir), OLD_PT, NEW_PT)
    return df.select("field", *[near(c, 8).alias(c) for c in ("value_a", "value_b", "delta")])


@register("parity_check", f"""
WITH stored AS ({summary_sql(NEW_PT)}), fresh AS ({q.query([*q.base(), *q.merged()], f"SELECT {SUMMARY}, {RATIOS} FROM kept")})
{' UNION ALL '.join(f"SELECT '{c}' AS field, ROUND(CAST(s.{c} AS DOUBLE), 6) AS stored, ROUND(CAST(r.{c} AS DOUBLE), 6) AS recomputed FROM stored s, fresh r WHERE s.{c} IS DISTINCT FROM r.{c} AND NOT COALESCE(ABS(s.{c} - r.{c}) <= 1e-9, FALSE)" for c in SUMMARY_FIELDS[:16])}
UNION ALL SELECT 'tracked_rule_count', ROUND(CAST(tracked_rule_count AS DOUBLE), 6), NULL FROM stored""")
def parity_check(spark, sf_dir):
    """The stored summary against one computed anew from the day-level facts: only the count of tracked rules is lacking there."""
    stored = store(spark, sf_dir).snapshot("summary", NEW_PT)
    return P.parity(stored, full_run(spark, sf_dir).summary()).select(
        "field", near("stored", 6).alias("stored"), near("recomputed", 6).alias("recomputed"))


@register("freshness", f"""
WITH {', '.join(with_clause('fx_app_snapshots'))}
SELECT MAX(pt) AS newest_pt, '20240131' AS expected_pt, MAX(pt) = '20240131' AS is_fresh FROM fx_app_snapshots""")
def freshness(spark, sf_dir):
    from datetime import date

    from pathlift.sources.tables import partition_ranges

    return P.freshness(partition_ranges(view(spark, sf_dir, "fx_app_snapshots"), CFG), date(2024, 1, 31))


@register("daily_digest", q.query(pub(NEW_PT), """
SELECT (SELECT COUNT(*) FROM merged) AS merged_alert_count, (SELECT COUNT(*) FROM merged WHERE level = 1) AS level1_count,
  (SELECT COUNT(*) FROM merged WHERE level = 2) AS level2_count, (SELECT COUNT(*) FROM merged WHERE level = 3) AS level3_count,
  (SELECT COUNT(*) FROM published p JOIN cur c USING (canonical_path) WHERE c.status IN (1, 2) AND NOT is_tracked_only) AS tracked_hits,
  (SELECT COUNT(*) FROM published p JOIN cur c USING (canonical_path) WHERE c.status IN (1, 2) AND is_tracked_only) AS tracked_misses,
  (SELECT path FROM published ORDER BY level DESC, z DESC, sort_rank LIMIT 1) AS focus_path,
  (SELECT path FROM published WHERE level >= 3 ORDER BY z DESC, sort_rank LIMIT 1) AS level3_focus_path,
  (SELECT ROUND_EVEN((MAX(CASE WHEN rn = 1 THEN total END) / MAX(CASE WHEN rn = 2 THEN total END) - 1) * 100, 4) FROM kept) AS latest_day_change_pct,
  ROUND((SELECT COUNT(*) FROM merged WHERE level >= 2) * 100.0 / GREATEST((SELECT COUNT(*) FROM merged), 1), 6) AS level2_plus_share_pct"""))
def daily_digest(spark, sf_dir):
    rows = R.with_status(store(spark, sf_dir).snapshot("alerts", NEW_PT),
                         S.current_status(view(spark, sf_dir, "fx_status_log")))
    df = R.digest(rows, store(spark, sf_dir).snapshot("summary", NEW_PT))
    return df.withColumn("level2_plus_share_pct", near("level2_plus_share_pct", 6))


@register("digest_rules", q.query(pub(NEW_PT), """
SELECT CASE WHEN is_tracked_only THEN 'miss' ELSE 'hit' END AS kind,
  CAST(ROW_NUMBER() OVER (PARTITION BY is_tracked_only ORDER BY CASE WHEN is_tracked_only THEN 0 ELSE -level END, path, canonical_path) AS INTEGER) - 1 AS place,
  path, level, CASE level WHEN 0 THEN 'Level0 无预警' WHEN 1 THEN 'Level1 黄色' WHEN 2 THEN 'Level2 橙色' ELSE 'Level3 红色' END AS level_label,
  c.status, CASE c.status WHEN 1 THEN '已上策略' ELSE '持续观察' END AS status_label, tracking_start, hit_windows
FROM published p JOIN cur c USING (canonical_path) WHERE c.status IN (1, 2)"""))
def digest_rules(spark, sf_dir):
    rows = R.with_status(store(spark, sf_dir).snapshot("alerts", NEW_PT),
                         S.current_status(view(spark, sf_dir, "fx_status_log")))
    return R.digest_rules(rows).withColumn("hit_windows", F.array_join("hit_windows", ","))


@register("alerts_with_seeds", q.query(pub(OLD_PT), """
SELECT canonical_path, level FROM published UNION ALL SELECT DISTINCT canonical_path, level FROM (
  SELECT canonical_path, level FROM seeds1 UNION ALL SELECT canonical_path, level FROM seeds2) WHERE level = 0"""))
def alerts_with_seeds(spark, sf_dir):
    s = store(spark, sf_dir)
    return R.alerts_with_seeds(s.snapshot("alerts", OLD_PT), s.snapshot("seeds", OLD_PT)).select(
        "canonical_path", "level")


@register("approval_warnings", q.query(q.base(), """
SELECT day, ROUND(approvals / total, 6) AS item_approval_ratio, ROUND(person_approvals / persons, 6) AS person_approval_ratio,
  CASE WHEN persons = 0 THEN 'person_approval_ratio: cid_cnt is 0' ELSE '' END AS warnings FROM daily"""))
def approval_warnings(spark, sf_dir):
    totals = D.Base.of(raw_facts(spark, sf_dir), CFG).totals
    df = L.approval_ratios(totals, "approval_cnt", "cnt", "approval_cid_cnt", "cid_cnt")
    return df.select(
        "day", near("item_approval_ratio", 6).alias("item_approval_ratio"),
        near("person_approval_ratio", 6).alias("person_approval_ratio"),
        F.array_join("warnings", "; ").alias("warnings"))
