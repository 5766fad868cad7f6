"""Invariants, brute-force checks and skewed inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import attribution as A, planning as PL, publishing as B, scoring as SC
from pathlift.operators import daily as D, drill as R, planning as P, running as U, scoring as S
from pathlift.plans import publish as PUB
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view
from pathlift.sources.store import RunStore


def test_value_counts_add_up_to_the_day(spark, sf_dir):
    base = A.lazy_base(spark, sf_dir)
    per_field = R.value_daily(base).groupBy("field", "day").agg(F.sum("cnt").alias("n"))
    off = per_field.join(base.totals, "day").where("n <> cnt").count()
    assert off == 0


def test_children_never_exceed_parents(spark, sf_dir):
    run = A.full_run(spark, sf_dir)
    parents = {r.canonical_path: r.observation_count for r in run.topk.single.selectExpr(
        "canonical_path", "windows[2].observation_count as observation_count").collect()}
    for r in run.topk.pair.selectExpr("canonical_path", "windows[2].observation_count as n").collect():
        assert all(r.n <= parents[p] for p in r.canonical_path.split(" / "))


def test_records_are_unique_and_seeds_bounded(spark, sf_dir):
    run = A.full_run(spark, sf_dir)
    assert run.merged.groupBy("canonical_path").count().where("count > 1").count() == 0
    assert run.topk.single_seeds.count() <= CFG.single_limit and run.topk.pair_seeds.count() <= CFG.pair_limit
    assert run.topk.single_seeds.where("is_suppressed").count() == 0


def test_lazy_and_stored_drilldown_agree(spark, sf_dir):
    lazy = R.topk_drilldown(A.lazy_base(spark, sf_dir), store_steps=False)
    stored = A.full_run(spark, sf_dir).topk
    assert lazy.counts.first() == stored.counts.first()


def test_publishing_twice_changes_nothing(spark, sf_dir, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    facts = view(spark, sf_dir, "fx_app_snapshots")
    first = PUB.backfill(facts, CFG, store, [B.OLD_PT, "19990101", B.NEW_PT], workers=2)
    assert [r["ok"] for r in first] == [True, False, True] and "no rows" in first[1]["error"]
    tables = ("alerts", "alert_windows", "path_daily", "daily_trend", "summary")
    before = {t: sorted(map(str, store.snapshot(t, B.OLD_PT).collect())) for t in tables}
    assert all(before.values()) and store.read("runs").count() == 2
    PUB.publish(facts, CFG, store, B.OLD_PT)
    assert all(store.run(t, CFG.run_id("19990101")).count() == 0 for t in tables)
    assert before == {t: sorted(map(str, store.run(t, CFG.run_id(B.OLD_PT)).collect())) for t in tables}
    assert store.published().where(F.col("pt") == B.OLD_PT).count() == 1 and store.read("runs").count() == 2
    assert store.ranges.current().count() == 2


def test_old_tables_without_new_columns(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    old = spark.createDataFrame([("x", 1.0)], "alert_id string, application_count double").withColumn("run_id", F.lit("r"))
    old.write.partitionBy("run_id").parquet(store.path("path_daily"))
    row = store.read("path_daily").first()
    assert row.application_count == 1.0 and row.cid_cnt is None
    assert store.snapshot("path_daily", "20260101").count() == 0


def test_auc_by_brute_force(spark, sf_dir):
    rows = SC.sample(spark, sf_dir).where("fpd7_fm_dd = 1 and score_a > 0").select("loan_ser_node", "score_a", "y_bad").toPandas()
    found = {r.loan_ser_node: r for r in S.ks_auc(SC.sample(spark, sf_dir), ["loan_ser_node"], ["score_a"]).collect()}
    for seg, g in rows.groupby("loan_ser_node"):
        bad, good = g[g.y_bad == 1].score_a.to_numpy(), g[g.y_bad == 0].score_a.to_numpy()
        wins = (bad[:, None] > good[None, :]).sum() + 0.5 * (bad[:, None] == good[None, :]).sum()
        auc = wins / (len(bad) * len(good))
        cuts = np.unique(g.score_a)
        ks = max(abs((bad <= c).mean() - (good <= c).mean()) for c in cuts)
        assert found[seg].auc == pytest.approx(max(auc, 1 - auc), abs=1e-12)
        assert found[seg].ks == pytest.approx(ks, abs=1e-12)
        assert 0.5 <= found[seg].auc <= 1


def test_running_totals_do_not_depend_on_bands(spark):
    """One hot group with most of the rows and a few small ones."""
    df = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 50)) as g", "'m' as model", "double(pmod(id * 7919, 5003)) as v",
    ).groupBy("g", "model", "v").agg(F.count(F.lit(1)).alias("n"))
    one = U.running_totals(df, ["g", "model"], "v", ["n"], ["model"], bands=1)
    many = U.running_totals(df, ["g", "model"], "v", ["n"], ["model"], bands=512)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_quantiles_match_numpy(spark, sf_dir):
    s = SC.sample(spark, sf_dir)
    rows = s.where("fpd7_fm_dd = 1 and score_b > 0").select("loan_ser_node", "score_b").toPandas()
    found = {r.loan_ser_node: r.edges for r in S.quantile_edges(s, ["loan_ser_node"], ["score_b"]).collect()}
    for seg, g in rows.groupby("loan_ser_node"):
        q = np.unique(np.quantile(g.score_b, [0.2, 0.4, 0.6, 0.8]))
        q = q[(q > g.score_b.min()) & (q < g.score_b.max())]
        assert found[seg] == pytest.approx(list(q))


def brute_cuts(bad, good, max_bins, min_share):
    n, tb, tg = len(bad), bad.sum(), good.sum()
    best = 0.0
    for k in range(max_bins):
        for cut in itertools.combinations(range(1, n), k):
            edges = [0, *cut, n]
            iv = 0.0
            for i, j in zip(edges, edges[1:]):
                b, g = bad[i:j].sum(), good[i:j].sum()
                if b == 0 or g == 0 or b + g < min_share * (tb + tg):
                    break
                iv += (b / tb - g / tg) * np.log((b / tb) / (g / tg))
            else:
                best = max(best, iv)
    return best


def test_optimal_cuts_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(5):
        bad, good = rng.integers(0, 30, 12).astype(float), rng.integers(5, 80, 12).astype(float)
        cuts, iv = S.best_cuts(bad, good, np.arange(12.0), 4, 0.02, 100)
        assert iv == pytest.approx(brute_cuts(bad, good, 4, 0.02))
        assert len(cuts) <= 3 and cuts == sorted(cuts)


def test_too_few_rows_give_one_bin():
    assert S.best_cuts(np.array([1.0, 2.0]), np.array([3.0, 4.0]), np.array([0.0, 1.0]), 5, 0.01, 100) == ([], 0.0)


@pytest.mark.parametrize("name", ["table_cap_by_tier", "table_cap", "use_base_by_risk", "use_base_by_risk_capped", "ten_tier_rate"])
def test_solver_hits_the_target(spark, sf_dir, name):
    grid, rule = PL.grid(spark, sf_dir), P.rule_book()[name]
    start = P.portfolio(grid).first().avg_limit
    top = P.solve_scale(grid, rule, start * 10).first()
    assert not top.reached and top.k == 20.0
    customers = P.portfolio(grid).first().customers
    target = start + 0.6 * top.max_increment / customers
    found = P.solve_scale(grid, rule, target).first()
    if found.reached:
        total = P.apply_rule(grid, rule, found.k).agg(F.sum("increment")).first()[0]
        assert total == pytest.approx(found.need, rel=1e-9)
    below = P.solve_scale(grid, rule, start - 1).first()
    assert below.k == 0.0 and not below.reached


def test_panel_is_complete(spark, sf_dir):
    panel = B.panel(spark, sf_dir)
    days = A.lazy_base(spark, sf_dir).totals.count()
    assert panel.groupBy("alert_id").count().where(F.col("count") != days).count() == 0


def test_frame_needs_two_days(spark, sf_dir):
    base = A.lazy_base(spark, sf_dir)
    with pytest.raises(Exception, match="at least 2 days with data are needed in the range, found 1"):
        D.window_frame(base.totals.limit(1), CFG).count()


def test_a_later_attempt_leaves_no_old_rows(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "alert_id string, application_count double")
    store.attempt("r1").write("path_daily", rows)
    store.attempt("r2").write("path_daily", rows)
    store.attempt("r1").write("path_daily", rows.where("alert_id = 'x'"))
    assert [r.alert_id for r in store.run("path_daily", "r1").collect()] == ["x"]
    store.attempt("r1").write("path_daily", rows.where("false"))
    assert store.run("path_daily", "r1").count() == 0 and store.run("path_daily", "r2").count() == 2
    assert store.read("path_daily").count() == 2


def test_snapshots_beyond_the_listing_stay_readable(spark, tmp_path, monkeypatch):
    from pathlift.sources import store as module

    monkeypatch.setattr(module, "KEEP_PUBLISHED", 2)
    store = RunStore(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("x", 1.0)], "alert_id string, application_count double")
    for day in range(1, 5):
        attempt = store.attempt(f"2026010{day}_0_b")
        attempt.write("path_daily", row)
        attempt.publish(f"2026010{day}")
    assert store.published().count() == 2 and store.pointers().count() == 4
    assert store.snapshot("path_daily", "20260101").count() == 1


def test_alerts_beyond_the_output_limit_are_stored(spark, sf_dir, tmp_path):
    import dataclasses

    store = RunStore(spark, str(tmp_path / "s"))
    facts = view(spark, sf_dir, "fx_app_snapshots")
    full, short = CFG, dataclasses.replace(CFG, output_limit=3)
    PUB.publish(facts, full, store, B.NEW_PT, tracked=B.tracked_rules(spark, sf_dir))
    want = {r.id for r in store.run("alerts", full.run_id(B.NEW_PT)).collect()}
    other = RunStore(spark, str(tmp_path / "t"))
    PUB.publish(facts, short, other, B.NEW_PT, tracked=B.tracked_rules(spark, sf_dir))
    got = other.run("alerts", short.run_id(B.NEW_PT)).collect()
    assert {r.id for r in got} == want and len(got) > 3
    assert sorted(r.sort_rank for r in got) == list(range(len(got)))
    days = other.run("path_daily", short.run_id(B.NEW_PT)).select("alert_id").distinct()
    assert want <= {r.alert_id for r in days.collect()}


def test_one_outlier_does_not_fill_one_band(spark):
    from pathlift.operators.running import running_totals

    rows = spark.range(20_000).selectExpr("'m' as model", "cast(if(id = 7, 1e12, id) as double) as score", "1L as n")
    out = running_totals(rows, ["model"], "score", ["n"], ["model"]).orderBy("score").collect()
    assert [r.n_before for r in out] == list(range(20_000)) and {r.n_total for r in out} == {20_000}


def test_parity_reports_a_missing_and_a_changed_field(spark):
    a = spark.createDataFrame([("r", 1.0, 2.0)], "run_id string, x double, y double")
    b = spark.createDataFrame([("r", 1.0, 3.0, 4)], "run_id string, x double, y double, z int")
    assert {r.field for r in PUB.parity(a, b).collect()} == {"y", "z"} and PUB.parity(a, a).count() == 0


def test_shared_folder_is_required_on_a_cluster():
    from pathlift.session import shared_dir

    class Context:
        applicationId = "app"

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        sparkContext = Context

    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
