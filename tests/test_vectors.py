"""Published figures and hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pathlift.config import AttributionConfig, ExpertStep, SuppressionRule, Threshold, Window
from pathlift.functions import paths as H, scalars as C
from pathlift.operators import daily as D, drill as R, metrics as M, panel as L, status as S
from pathlift.sources import tables as T

CFG = AttributionConfig(
    dimensions=("channel", "system"),
    windows=(Window("1d", 1), Window("3d", 3), Window("7d", 7)),
    thresholds=(
        Threshold(1, 30, 1.5, 1.5, 2, "L1"), Threshold(2, 50, 2, 2, 3, "L2"), Threshold(3, 100, 3, 3, 5, "L3"),
    ),
    suppression_rules=(SuppressionRule("system", "none", "no system"),),
    expert_path=(ExpertStep("channel", "a"), ExpertStep("system", "x"), ExpertStep("channel", "*")),
    lookback_days=60,
)
SCHEMA = ("create_date timestamp, pt string, channel string, system string, cnt double, approval_cnt double, "
          "approval_jy0_cnt double, cid_cnt double, approval_cid_cnt double")


def facts(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2026, 6, d, 13), "20260622", ch, sy, float(n), 0.0, 0.0, 0.0, 0.0) for d, ch, sy, n in rows], SCHEMA)


def test_published_window(spark):
    """713 of 43,278 on the last day against 4,207 of 418,669 on the ten days before."""
    rows = [(22, "a", "x", 713), (22, "b", "x", 43278 - 713)]
    rows += [(12 + i, "a", "x", 4207 / 10) for i in range(10)]
    rows += [(12 + i, "b", "x", (418669 - 4207) / 10) for i in range(10)]
    base = D.Base.of(facts(spark, rows), CFG, "20260622")
    raw = M.with_windows(R.single_sums(base), base).where("channel = 'a' and window_key = '1d'").first()
    assert raw.growth_factor == pytest.approx(1.6947943903018778, abs=5e-5)
    assert raw.structure_lift_factor == pytest.approx(1.6395348042730646, abs=5e-5)
    assert raw.excess_count == pytest.approx(278.12054630268784, abs=5e-5)
    assert raw.z_score == pytest.approx(13.336707582608508, abs=5e-5)
    assert raw.level == 1


def test_days_without_data_do_not_count(spark):
    rows = [(1, "a", "x", 5), (3, "a", "x", 5), (9, "a", "x", 5), (20, "a", "x", 40)]
    base = D.Base.of(facts(spark, rows), CFG, "20260622")
    windows = {r.window_key: r for r in D.window_table(base.totals, CFG).collect()}
    assert windows["3d"].observation_start == dt.date(2026, 6, 3)
    assert windows["3d"].baseline_days == 1
    assert windows["7d"].observation_days == 4 and windows["7d"].baseline_days == 0
    record = R.single_records(base).where("channel = 'a'").first()
    by_key = {w.window_key: w for w in record.windows}
    assert by_key["7d"].growth_factor == 0.0 and by_key["7d"].z_score == 0.0
    assert record.primary_window != "7d"


def test_lookback_and_offset(spark):
    rows = [(d, "a", "x", d) for d in range(1, 23)]
    cfg = CFG.with_(lookback_days=5)
    raw = facts(spark, rows)
    days = [r.day.day for r in D.kept_days(D.Base.of(raw, cfg).totals, cfg).collect()]
    assert sorted(days) == [18, 19, 20, 21, 22]
    assert sorted(r.day.day for r in D.facts_in_range(raw, cfg).collect()) == list(range(15, 23))
    assert max(r.day.day for r in D.facts_in_range(raw, cfg, offset=10).collect()) == 12


def test_unknown_partition_and_columns(spark):
    raw = facts(spark, [(1, "a", "x", 1)])
    with pytest.raises(ValueError):
        D.check_columns(raw.drop("channel"), CFG)
    with pytest.raises(ValueError):
        CFG.with_(dimensions=("bad name",))


def test_normalised_values(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t ",), (" a\n",), ("NaN",)], "v string")
    assert [r[0] for r in df.select(C.normalize_value("v")).collect()] == ["none", "none", "none", "a", "NaN"]
    floats = spark.createDataFrame([(float("nan"),), (None,), (1.5,)], "v double")
    assert [r[0] for r in floats.select(C.normalize_value("v", floating=True)).collect()] == ["none", "none", "1.5"]


def test_report_rounding(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.03125,), (1.23456,)], "v double")
    assert [r[0] for r in df.select(C.numeric("v")).collect()] == [0.0, 0.0, 999.0, -999.0, 0.0312, 1.2346]


def test_codes(spark):
    df = spark.createDataFrame([("5.0", "1.5"), (None, "x"), (" 3 ", None)], "a string, b string")
    assert [r[0] for r in df.select(C.normalized_code("a")).collect()] == ["5", "", "3"]
    assert [r[0] for r in df.select(C.safe_double("b")).collect()] == [1.5, None, None]


def test_paths(spark):
    df = spark.createDataFrame([("v", None, "w")], "b_dim string, a_dim string, c_dim string")
    row = df.select(H.canonical_path(["c_dim", "b_dim", "a_dim"]).alias("c"), H.display_path(["c_dim", "b_dim"]).alias("d")).first()
    assert row.c == "b_dim=v / c_dim=w" and row.d == "c_dim=w / b_dim=v"
    back = df.select(F.lit(row.d).alias("p")).select(*[c.alias(n) for n, c in H.from_canonical("p", ["b_dim", "c_dim", "a_dim"]).items()])
    assert tuple(back.first()) == ("v", "w", None)


def test_status_switching(spark):
    log = spark.createDataFrame(
        [(1, "p", 1, dt.datetime(2026, 8, 31), dt.date(2026, 8, 31), "u"), (2, "p", 2, dt.datetime(2026, 9, 1), dt.date(2026, 9, 1), "u"),
         (3, "p", 2, dt.datetime(2026, 9, 1, 5), dt.date(2026, 9, 1), "w"), (4, "p", 0, dt.datetime(2026, 9, 2), dt.date(2026, 9, 2), "u"),
         (5, "p", 2, dt.datetime(2026, 9, 3), dt.date(2026, 9, 3), "u")],
        "id bigint, canonical_path string, status int, updated_at timestamp, action_date date, updated_by string")
    found = S.status_intervals(log).orderBy(F.desc("entered_at")).collect()
    assert [(r.status, r.entered_pt.day, r.exited_pt.day if r.exited_pt else None) for r in found] == [
        (2, 3, None), (2, 1, 2), (1, 31, 1)]
    current = S.current_status(log).first()
    assert current.status == 2 and current.action_date == dt.date(2026, 9, 3)
    active = S.active_rules(S.current_status(log), S.status_intervals(log)).first()
    assert active.entered_pt == dt.date(2026, 9, 3)


def test_legacy_status_without_history(spark):
    current = spark.createDataFrame([("p", 1, dt.date(2026, 8, 1))], "canonical_path string, status int, action_date date")
    none = spark.createDataFrame([], "canonical_path string, entered_pt date, entered_at timestamp, id bigint, is_active boolean")
    assert S.active_rules(current, none).first().entered_pt == dt.date(2026, 8, 1)


def test_trend_cut_at_tracking_start(spark):
    panel = spark.createDataFrame(
        [("r", dt.date(2026, 8, 31), 3.0, 10.0, 1.0, 5.0, 2.0), ("r", dt.date(2026, 9, 1), 0.0, 12.0, 0.0, 0.0, 0.0),
         ("r", dt.date(2026, 9, 2), 4.0, 12.0, 2.0, 5.0, 2.0)],
        "alert_id string, date date, application_count double, total_application_count double, approval_count double, cid_cnt double, approval_cid_cnt double")
    starts = spark.createDataFrame([("r", dt.date(2026, 9, 1))], "alert_id string, tracking_start date")
    rows = L.trend_rows(panel, 60, starts).orderBy("date").collect()
    assert [r.application_count for r in rows] == [0.0, 4.0]
    assert rows[1].cid_approval_rate_pct == 40.0 and rows[0].approval_rate_pct == 0.0
    summary = L.trend_summary(L.trend_rows(panel, 60, starts)).first()
    assert summary.latest_day_change_pct == 0.0 and summary.peak_date == dt.date(2026, 9, 2)


def test_approval_ratio_contract(spark):
    df = spark.createDataFrame([(1.0, 5.0, 4.0, 8.0), (1.0, 0.0, None, 8.0)], "pc double, c double, pi double, i double")
    good, bad = L.approval_ratios(df, "pi", "i", "pc", "c").collect()
    assert (good.person_approval_ratio, good.item_approval_ratio, good.warnings) == (0.2, 0.5, [])
    assert bad.person_approval_ratio is None and bad.item_approval_ratio is None
    assert bad.warnings == ["person_approval_ratio: c is 0", "item_approval_ratio: pi missing"]


def test_lookup_headers_and_totals(spark, tmp_path):
    assert T.unique_names([" a ", "b", "a"]) == ["a", "b", "a_dup2"]
    (tmp_path / "grid.csv").write_text("customer, rate ,n,score,rate\nx,1,7.0,A,0.5\ntotal,,,,\n")
    table = T.read_lookup(spark, str(tmp_path / "grid.csv"))
    assert table.columns == ["customer", "rate", "n", "score", "rate_dup2"]
    kept = T.policy_table(T.drop_totals(table, ["customer"])).collect()
    assert [(r.loan_cnt, r.target_rate) for r in kept] == [(7, 0.5)]


def test_config_round_trip_and_fingerprint():
    raw = {
        "version": "v1", "dimensions": ["a"], "windows": [{"key": "1d", "observation_days": 1}],
        "thresholds": [{"level": 1, "min_observation_count": 1, "min_growth_factor": 1, "min_structure_lift_factor": 1, "min_z_score": 1}],
        "top_k": {"single_limit": 3, "pair_limit": 2},
    }
    cfg = AttributionConfig.from_dict(raw)
    assert (cfg.single_limit, cfg.pair_limit) == (3, 2)
    assert cfg.run_id("20260101") == AttributionConfig.from_dict(raw).run_id("20260101")
    assert cfg.fingerprint() != cfg.with_(lookback_days=7).fingerprint()


def test_ingest_and_reports(spark, tmp_path):
    from pathlift.sources.store import RunStore

    source = tmp_path / "in"
    (source / "daily_trend").mkdir(parents=True)
    (source / "daily_trend" / "part.json").write_text('{"date": "2026-08-01", "application_count": 5.0}\n')
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.read("alerts").count() == 0
    for _ in range(2):
        store.ingest(str(source), "20260801_0_x", "20260801", 0, ("daily_trend",))
    rows = store.snapshot("daily_trend", "20260801").collect()
    assert [(r.date, r.application_count, r.cid_cnt) for r in rows] == [(dt.date(2026, 8, 1), 5.0, None)]
    assert store.latest_partition().first()[0] == "20260801"
    df = spark.sql("select 'k' as k, map('0.5', 2) as m, array(1, 2) as a")
    T.write_report(df, str(tmp_path / "csv"), ("m", "k"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().m.replace("\\", "") == '{"0.5":2}'
    T.write_report(df, str(tmp_path / "json"), ("k", "a"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).first().a == [1, 2]


def test_published_index_keeps_newest_per_key(spark, tmp_path):
    from pathlift.sources.store import RunStore

    store = RunStore(spark, str(tmp_path / "s"))
    for run in ("20260801_0_a", "20260801_0_b"):
        store.attempt(run).publish("20260801")
    assert [r.run_id for r in store.published().collect()] == ["20260801_0_b"]


def test_solver_on_a_hand_made_grid(spark):
    from pathlift.operators import planning as P

    grid = spark.createDataFrame(
        [("c", "1", 1, "5", 100, 1000.0, 50, 1000.0, 0.03, 0.5, 1200.0, True),
         ("c", "2", 1, "4", 100, 1000.0, 50, 1000.0, 0.15, 0.2, 9000.0, True)],
        "flag_customer string, use_rate string, loan_cnt int, score_level string, settled bigint, settled_avg_limit double,"
        " raised bigint, raised_avg_limit double, fpd7_rate double, rate_cap double, limit_cap double, eligible boolean")
    # First cell: 25,000 k up to 10,000 at k = 0.4; second: 10,000 k. Need 200 customers x 65 = 13,000.
    found = P.solve_scale(grid, P.rule_book()["table_cap"], 1065.0).first()
    assert found.reached and found.k == pytest.approx(0.4 + (13_000 - 14_000) / 35_000)
    assert P.solve_scale(grid, P.rule_book()["table_cap"], 1075.0).first().k == pytest.approx(0.5)
