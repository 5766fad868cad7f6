"""Publishing: compute a partition, rebuild tracked rules, store every table of an attempt, then move the pointer."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, functions as F

from pathlift.config import AttributionConfig
from pathlift.operators.daily import partition_slice, trend_facts
from pathlift.operators.metrics import rank_order
from pathlift.operators.panel import path_daily, window_approvals
from pathlift.operators.ranking import numbered
from pathlift.operators.status import apply_tracked, definition_history, tracked_records
from pathlift.plans.dashboard import Dashboard, build
from pathlift.session import cut_lineage
from pathlift.sources.store import Attempt, RunStore
from pathlift.sources.tables import newest_partitions


#: Tables written at the same time, and those of one row.
WRITERS, ONE_FILE = 4, ("payloads", "runs", "summary")


def with_approvals(records: DataFrame, approvals: DataFrame) -> DataFrame:
    """Alert rates are those of the primary window."""
    primary = approvals.where("is_primary").select(
        F.col("alert_id").alias("id"), "approval_rate_pct", "cid_approval_rate_pct"
    )
    return records.join(primary, "id", "left")


def window_rows(records: DataFrame, approvals: DataFrame) -> DataFrame:
    flat = records.select(F.col("id").alias("alert_id"), F.explode("windows").alias("w")).select("alert_id", "w.*")
    return flat.join(approvals.drop("is_primary"), ["alert_id", "window_key"], "left")


def ranked_records(records: DataFrame, last: str = "false") -> DataFrame:
    """All records with their exact place in report order, from 0 and without gaps; rows that meet ``last`` come behind."""
    placed = numbered(records.withColumn("_last", F.expr(last)), [F.asc("_last"), *rank_order()], into="sort_rank")
    return placed.drop("_last")


def stored_definitions(store: RunStore, offset: int = 0) -> DataFrame:
    """How the rules of all published partitions were defined, and since when; see ``with_definitions``."""
    index = store.pointers().where(F.col("offset_days") == offset).select("run_id", "pt")
    return definition_history(store.snapshots("alerts", offset=offset).join(index, "run_id"))


class StageLog:
    """Rows and seconds of an attempt's stages, written to the store's log; an error is logged with its stage."""

    def __init__(self, store: RunStore, attempt: Attempt, pt: str, offset: int):
        self.store, self.attempt, self.pt, self.offset = store, attempt, pt, offset
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str, *tables: str):
        start, error = time.time(), None
        try:
            yield
        except Exception as failure:
            error = str(failure).splitlines()[0][:500]
            raise
        finally:
            self.seconds[name] = took = round(time.time() - start, 3)
            head = (self.attempt.run_id, self.attempt.name, self.pt, int(self.offset))
            if error is None and tables:
                # Row counts come from the footers of the files just written.
                rows = [(*head, f"{name}/{t}", self.attempt.read(t).count(), None, None) for t in tables]
            else:
                rows = []
            self.store.log_stages([*rows, (*head, name, None, took, error)])


def publish(
    raw: DataFrame,
    cfg: AttributionConfig,
    store: RunStore,
    pt: str,
    offset: int = 0,
    tracked: DataFrame | None = None,
    source: str = "scheduled",
) -> dict:
    """Compute and store one (pt, offset) as a new attempt, then point readers to it.

    ``tracked``: canonical_path, status, entered_day, dimension columns, and, from ``with_definitions``, what the rules
    were made from. Whatever fails on the way, readers go on
    reading the attempt published before, whole; the stage log says where it ended. Only this partition is read.
    """
    run_id = cfg.run_id(pt, offset)
    attempt = store.attempt(run_id)
    log = StageLog(store, attempt, pt, offset)
    start = time.time()
    with log.stage("compute"):
        if partition_slice(raw, cfg, pt).isEmpty():
            raise ValueError(f"partition {pt} has no rows; nothing was stored")
        dash = build(raw, cfg, pt, offset)
        merged = dash.merged.withColumns(
            {"tracking_start": F.lit(None).cast("date"), "is_tracked_only": F.lit(False)}
        )
        tracked_count = F.lit(0)
        if tracked is not None:
            merged = apply_tracked(dash.merged, tracked_records(dash.base, tracked))
            tracked_count = tracked.agg(F.count_if(F.col("status") == 2)).scalar()
        alerts = cut_lineage(ranked_records(merged, "is_tracked_only"))
        suppressed = cut_lineage(ranked_records(dash.suppressed))
    computed_ms = int((time.time() - start) * 1000)

    with log.stage("panel", "path_daily"):
        paths = cut_lineage(
            alerts.select("id", *cfg.dimensions).unionByName(suppressed.select("id", *cfg.dimensions)).distinct())
        panel = path_daily(trend_facts(raw, dash.base, pt, offset), paths, cfg)
        starts = alerts.where("tracking_start is not null").select(F.col("id").alias("alert_id"), "tracking_start")
        attempt.write("path_daily", panel.join(starts.distinct(), "alert_id", "left"),
                      expected_rows=paths.count() * (cfg.trend_days + 3))
        panel = attempt.read("path_daily")

    tables = ("alerts", "suppressed", "alert_windows", "seeds", "summary", "daily_trend", "payloads", "runs")
    with log.stage("store", *tables):
        both = alerts.unionByName(suppressed, allowMissingColumns=True)
        approvals = cut_lineage(window_approvals(both, panel))
        payload = dash.document().select(F.lit(pt).alias("pt"), F.lit(offset).alias("offset_days"), "payload")
        contents = {
            "alerts": with_approvals(alerts, approvals),
            "suppressed": with_approvals(suppressed, approvals),
            "alert_windows": window_rows(both.dropDuplicates(["id"]), approvals),
            "seeds": dash.topk.single_seeds.unionByName(dash.topk.pair_seeds),
            "summary": dash.summary().withColumn("tracked_rule_count", tracked_count),
            "daily_trend": dash.daily_trend(),
            "payloads": payload,
            "runs": run_row(dash, cfg, pt, offset, source, computed_ms),
        }
        # Independent tables in folders of their own: they are written side by side.
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda t: attempt.write(t, contents[t], one_file=t in ONE_FILE), tables))

    with log.stage("publish"):
        # The bounds of this partition are known from its own range; no other partition is read.
        store.ranges.upsert(dash.ranges.select(
            F.lit(pt).alias("pt"), F.col("table_date_min").alias("min_day"), F.col("table_date_max").alias("max_day")))
        attempt.publish(pt, offset)
    return {
        "run_id": run_id, "attempt": attempt.name, "pt": pt, "offset": offset, "source": source,
        "compute_s": round(log.seconds["compute"], 1), "panel_s": round(log.seconds["panel"], 1),
        "store_s": round(log.seconds["store"], 1),
    }


def run_row(dash: Dashboard, cfg: AttributionConfig, pt: str, offset: int, source: str, ms: int) -> DataFrame:
    return dash.meta().select(
        F.lit(pt).alias("pt"), F.lit(int(offset)).alias("offset_days"),
        F.lit(cfg.version).alias("config_version"), F.lit(cfg.fingerprint()).alias("config_hash"),
        F.col("date_start").alias("window_start"), F.col("date_end").alias("window_end"),
        "table_date_min", "table_date_max",
        F.lit(datetime.now(timezone.utc)).alias("generated_at"), F.lit(ms).alias("duration_ms"),
        F.lit(source).alias("source"),
    )


def backfill(
    raw: DataFrame, cfg: AttributionConfig, store: RunStore, pts: Iterable[str], tracked: DataFrame | None = None,
    workers: int = 1, resume: bool = False,
) -> list[dict]:
    """Publish several partitions, ``workers`` at a time; a failing one is reported and does not stop the rest.

    With ``resume`` partitions already published under this configuration are left out, so that a second call goes on
    where the first ended.
    """

    def one(pt: str) -> dict:
        if resume:
            done = store.pointer(pt)
            if done and done.run_id == cfg.run_id(pt):
                return {"pt": pt, "run_id": done.run_id, "attempt": done.attempt, "ok": True, "resumed": True}
        try:
            return {**publish(raw, cfg, store, pt, 0, tracked, "backfill"), "ok": True, "resumed": False}
        except Exception as error:  # noqa: BLE001 - reported per partition
            return {"pt": pt, "ok": False, "error": str(error)}

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return list(pool.map(one, pts))


def backfill_newest(
    path: str, cfg: AttributionConfig, store: RunStore, n: int, tracked: DataFrame | None = None, workers: int = 1,
    resume: bool = True,
) -> list[dict]:
    """Publish the ``n`` newest partitions of a stored fact table; which these are is read from its folders."""
    pts = [r.pt for r in newest_partitions(store.spark, path, cfg, n).collect()]
    raw = store.spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/{cfg.partition_field}={p}" for p in pts])
    raw = raw.withColumn(cfg.partition_field, F.col(cfg.partition_field).cast("string"))
    return backfill(raw, cfg, store, pts, tracked, workers, resume)


def freshness(ranges: DataFrame, run_date: date) -> DataFrame:
    """One row: the newest partition and whether it is the one of the run date."""
    today = run_date.strftime("%Y%m%d")
    return ranges.agg(F.max("pt").alias("newest_pt")).select(
        "newest_pt", F.lit(today).alias("expected_pt"), (F.col("newest_pt") == today).alias("is_fresh")
    )


def long_form(one_row: DataFrame, skip: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """A one-row table of figures as (field, value) rows; text columns are left out."""
    kinds = dict(one_row.dtypes)
    numeric = [c for c in one_row.columns if c not in skip and kinds[c] in ("double", "bigint", "int")]
    pairs = ", ".join(f"named_struct('field', '{c}', 'value', cast({c} as double))" for c in numeric)
    return one_row.select(F.expr(f"inline(array({pairs}))"))


def parity(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Fields whose stored and recomputed values differ or that one side lacks; no rows means agreement."""
    a = long_form(stored).withColumnRenamed("value", "stored").withColumn("_a", F.lit(1))
    b = long_form(fresh).withColumnRenamed("value", "recomputed").withColumn("_b", F.lit(1))
    gap = F.abs(F.col("stored") - F.col("recomputed"))
    differs = ~F.col("stored").eqNullSafe(F.col("recomputed")) & (gap.isNull() | (gap > tolerance))
    absent = F.col("_a").isNull() | F.col("_b").isNull()
    return a.join(b, "field", "full").where(absent | differs).drop("_a", "_b")
