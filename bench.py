"""Headline timings. Prints one JSON line; data folder and cores come from BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

from catalog import attribution as A, planning as PL, publishing as B, scoring as SC, strategy as ST
from pathlift.operators import daily as D, drill as R, execution as X, panel as L, planning as P, scoring as S, status as U
from pathlift.plans import dashboard as H
from pathlift.session import local_session
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def single_scan(spark):
    run(R.single_records(D.Base.of(A.raw_facts(spark, SF_DIR), CFG)))


def drilldown(spark):
    run(R.topk_drilldown(D.Base.of(A.raw_facts(spark, SF_DIR), CFG).materialised()).alerts)


def dashboard(spark):
    run(H.build(A.raw_facts(spark, SF_DIR), CFG, "20240130").summary())


def path_panel(spark):
    paths = A.full_run(spark, SF_DIR).alerts.select("id", *CFG.dimensions)
    run(L.path_daily(D.facts_in_range(A.raw_facts(spark, SF_DIR), CFG, trend=True), paths, CFG))


def status_intervals(spark):
    run(U.status_intervals(view(spark, SF_DIR, "fx_status_log")))


def strategy_execution(spark):
    joined = X.with_expected_rate(
        X.strategy_cube(view(spark, SF_DIR, "fx_limit_result")), view(spark, SF_DIR, "fx_policy"))
    run(X.overall_report(joined))


def ks_auc(spark):
    run(S.ks_auc(SC.sample(spark, SF_DIR), SC.KEYS, SC.MODELS, SC.WEEK))


def binned_metrics(spark):
    run(SC.binned(spark, SF_DIR))


def plan_solve(spark):
    run(P.solved_plan(PL.grid(spark, SF_DIR), P.rule_book()["table_cap_by_tier"], PL.TARGET))


def formula_check(spark):
    run(ST.Z.match_by_rate(ST.formulas(spark, SF_DIR)))


def stored_trend(spark):
    run(B.R.path_trend(B.store(spark, SF_DIR), B.NEW_PT, B.TRACKED_ID, 60))


def stored_dashboard(spark):
    run(B.store(spark, SF_DIR).snapshot("payloads", B.NEW_PT))


QUERIES = (
    single_scan, drilldown, dashboard, path_panel, status_intervals, strategy_execution, ks_auc, binned_metrics,
    plan_solve, formula_check, stored_trend, stored_dashboard,
)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for query in QUERIES:
        query(spark)  # classes loaded, shared tables stored
        start = time.perf_counter()
        query(spark)
        times[query.__name__] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
