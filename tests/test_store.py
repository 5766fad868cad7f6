"""The run store: attempts, pointers, clustered look-ups, keyed upserts, listings, backfill."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalog import attribution as A, publishing as B
from pathlift.operators import panel as L
from pathlift.plans import publish as PUB, read_queries as R
from pathlift.sources import files, tables as T
from pathlift.sources.fixtures import TEST_CONFIG as CFG, view
from pathlift.sources.store import CLUSTERED, Attempt, Clustered, RunStore

TABLES = ("alerts", "suppressed", "alert_windows", "seeds", "summary", "daily_trend", "path_daily", "payloads", "runs")


def seen(store, pt):
    return {t: sorted(map(str, store.snapshot(t, pt).collect())) for t in TABLES}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_lost_attempt_leaves_the_published_one_whole(spark, sf_dir, monkeypatch):
    store = B.store(spark, sf_dir)
    facts = view(spark, sf_dir, "fx_app_snapshots")
    before, logged = seen(store, B.OLD_PT), store.stages().where("error is not null").count()
    assert all(before.values())
    write, written = Attempt.write, []

    def failing(self, table, df, *rest, **named):
        if len(written) == 2:
            raise OSError("disk full")
        written.append(table)
        write(self, table, df.limit(1), *rest, **named)

    monkeypatch.setattr(Attempt, "write", failing)
    monkeypatch.setattr(PUB, "WRITERS", 1)
    result = PUB.backfill(facts, CFG, store, [B.OLD_PT])[0]
    assert not result["ok"] and "disk full" in result["error"] and written == ["path_daily", "alerts"]
    assert seen(store, B.OLD_PT) == before
    assert store.run("alerts", CFG.run_id(B.OLD_PT)).count() == len(before["alerts"])
    errors = store.stages().where("error is not null").collect()
    assert len(errors) == logged + 1 and {(r.stage, r.error) for r in errors} == {("store", "disk full")}
    # What the lost attempt left can be cleared away; the published ones stay.
    pattern = f"{store.path('alerts')}/run_id={CFG.run_id(B.OLD_PT)}/attempt=*"
    assert len(files.matching(spark, pattern)) == 2
    assert store.remove_superseded(dt.datetime.now(dt.timezone.utc)) >= 2
    assert len(files.matching(spark, pattern)) == 1 and seen(store, B.OLD_PT) == before


def test_two_writers_do_not_mix(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))

    def rows(n):
        return spark.createDataFrame([(f"a{i}", float(n)) for i in range(n)], "alert_id string, application_count double")

    def trend(n):
        return spark.createDataFrame([(float(n),)], "application_count double")

    one, two = store.attempt("r"), store.attempt("r")
    one.write("path_daily", rows(1))
    two.write("path_daily", rows(2))
    two.write("daily_trend", trend(2))
    assert store.snapshot("path_daily", "20260101").count() == 0
    two.publish("20260101")
    one.write("daily_trend", trend(1))
    for n, attempt in ((2, None), (1, one)):
        if attempt:
            attempt.publish("20260101")
        assert store.snapshot("path_daily", "20260101").count() == n
        assert store.snapshot("daily_trend", "20260101").first().application_count == n
    with pytest.raises(Exception, match="(?i)exist"):
        one.write("daily_trend", trend(1))
    assert store.pointers().count() == 1 and store.newest_pt() == "20260101" and store.newest_pt(15) is None


def test_a_key_is_looked_up_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(CLUSTERED, "path_daily", Clustered("alert_id", ("alert_id", "date"), 20_000, 64 << 10))
    store = RunStore(spark, str(tmp_path / "s"))
    rows = spark.range(60_000).selectExpr(
        "lpad(hex(id div 60), 12, '0') as alert_id", "date_add(date'2026-01-01', cast(id % 60 as int)) as date",
        "cast(id as double) as application_count", "if(id div 60 = 7, date'2026-02-01', null) as tracking_start")
    attempt = store.attempt("r")
    attempt.write("path_daily", rows.repartition(5), expected_rows=60_000)
    attempt.publish("20260301")
    stored = glob.glob(str(tmp_path / "s/path_daily/run_id=r/attempt=*/shards=3/shard=*/*.parquet"))
    assert len(stored) == 3
    for file in stored:
        meta = pq.ParquetFile(file).metadata
        bounds = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        assert meta.row_group(0).column(0).path_in_schema == "alert_id"
        assert all(a.max <= b.min for a, b in zip(bounds, bounds[1:]))
    key = "000000000007"
    found = store.lookup("path_daily", key, "20260301")
    assert len(found.inputFiles()) == 1 and f"EqualTo(alert_id,{key})" in plan(found)
    assert found.count() == 60 and store.lookup("path_daily", "f" * 12, "20260301").count() == 0
    assert store.snapshot("path_daily", "20260301").count() == 60_000
    trend = R.path_trend(store, None, key, 15)
    assert "Window" not in plan(trend)
    days = [r.date for r in trend.orderBy("date").collect()]
    assert len(days) == 15 and days[0] == dt.date(2026, 2, 15) and days[-1] == dt.date(2026, 3, 1)
    assert R.path_trend(store, "20260301", key, 60).count() == 29
    assert R.path_trend(store, None, "00000000000A".lower(), 60).count() == 0


@pytest.mark.parametrize("record", ["", "xyz", "0" * 11, "0" * 13, "ABCDEFABCDEF"])
def test_record_ids_are_checked(spark, tmp_path, record):
    with pytest.raises(ValueError, match="twelve"):
        R.path_trend(RunStore(spark, str(tmp_path / "s")), "20260101", record)


def test_reads_default_to_the_newest_partition(spark, sf_dir):
    store = B.store(spark, sf_dir)
    assert R.dashboard_summary(store).collect() == R.dashboard_summary(store, B.NEW_PT).collect()
    assert R.find_rules(store).count() == R.find_rules(store, B.NEW_PT).count() > 0
    assert R.path_trend(store, None, B.TRACKED_ID).count() == R.path_trend(store, B.NEW_PT, B.TRACKED_ID).count() > 0
    days = R.tracked_rule_followup(store, B.TRACKED_PATH, B.OLD_PT)
    assert [r.pt for r in days.select("pt").distinct().orderBy("pt").collect()] == [B.OLD_PT, B.NEW_PT]


def test_nothing_published_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing was published"):
        R.dashboard_summary(RunStore(spark, str(tmp_path / "s")))


def test_an_upsert_replaces_whole_keys_only(spark, tmp_path):
    ranges = RunStore(spark, str(tmp_path / "s")).ranges
    assert ranges.current().count() == 0
    schema = "pt string, min_day date, max_day date"
    day = dt.date
    ranges.upsert(spark.createDataFrame([("a", day(2026, 1, 1), day(2026, 1, 5)), ("b", day(2026, 1, 1), None)], schema))
    untouched = glob.glob(str(tmp_path / "s/partition_ranges/*/pt=a/*.parquet"))
    ranges.upsert(spark.createDataFrame([("b", day(2026, 1, 2), day(2026, 1, 9)), ("c", None, None)], schema))
    assert {tuple(r) for r in ranges.current().collect()} == {
        ("a", day(2026, 1, 1), day(2026, 1, 5)), ("b", day(2026, 1, 2), day(2026, 1, 9)), ("c", None, None)}
    assert glob.glob(str(tmp_path / "s/partition_ranges/*/pt=a/*.parquet")) == untouched
    assert len(ranges.current().inputFiles()) == 3


def test_publishing_reads_no_other_partition(spark, sf_dir, tmp_path):
    """The other partition's only file is unreadable; nothing may open it."""
    facts = str(tmp_path / "facts")
    view(spark, sf_dir, "fx_app_snapshots").where(F.col("pt") == B.NEW_PT).write.partitionBy("pt").parquet(facts)
    (tmp_path / f"facts/pt={B.OLD_PT}").mkdir()
    (tmp_path / f"facts/pt={B.OLD_PT}/part-0.parquet").write_bytes(b"not parquet at all")
    (tmp_path / "facts/pt=draft").mkdir()
    assert [r.pt for r in T.available_partitions(spark, facts, CFG).collect()] == [B.NEW_PT, B.OLD_PT]
    listed = T.newest_partitions(spark, facts, CFG, 1)
    assert "Scan parquet" not in plan(listed) and [r.pt for r in listed.collect()] == [B.NEW_PT]
    store = RunStore(spark, str(tmp_path / "s"))
    done = PUB.backfill_newest(facts, CFG, store, 1)
    assert [(r["pt"], r["ok"], r["resumed"]) for r in done] == [(B.NEW_PT, True, False)]
    assert [r.pt for r in store.ranges.current().collect()] == [B.NEW_PT]


def test_a_second_backfill_goes_on_where_the_first_ended(spark, sf_dir):
    store = B.store(spark, sf_dir)
    facts = view(spark, sf_dir, "fx_app_snapshots")
    again = PUB.backfill(facts, CFG, store, [B.OLD_PT, "19990101", B.NEW_PT], workers=2, resume=True)
    assert [(r["ok"], r.get("resumed")) for r in again] == [(True, True), (False, None), (True, True)]
    assert "no rows" in again[1]["error"]
    failed = store.stages().where("pt = '19990101'").collect()
    assert {(r.stage, r.error is None) for r in failed} == {("compute", False)}
    other = CFG.with_(level0_min_observation=31)
    monkey = PUB.backfill(facts.where("false"), other, store, [B.OLD_PT], resume=True)[0]
    assert not monkey["ok"]  # another configuration is another run, so it was tried


def test_one_day_stores_no_table(spark, sf_dir, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    facts = view(spark, sf_dir, "fx_app_snapshots").where(F.col("pt") == B.OLD_PT)
    one_day = facts.where(F.col("create_date") == facts.agg(F.max("create_date")).first()[0])
    with pytest.raises(Exception, match="at least 2 days with data are needed in the range, found 1"):
        PUB.publish(one_day, CFG, store, B.OLD_PT)
    assert not any(files.exists(spark, store.path(t)) for t in (*TABLES, "published", "partition_ranges"))


def test_panel_sums_by_brute_force(spark, sf_dir):
    """Paths over every set of fields, unknown values and an empty path; no fact row is multiplied by paths."""
    facts = A.lazy_base(spark, sf_dir).facts
    rows = facts.toPandas()
    dims = list(CFG.dimensions)
    wanted = []
    for i, r in enumerate(rows.sample(40, random_state=1).itertuples()):
        wanted.append((f"p{i}", *[getattr(r, d) if (i >> k) & 1 or k == i % len(dims) else None for k, d in enumerate(dims)]))
    wanted += [("all", *[None] * len(dims)), ("none", "no such value", *[None] * (len(dims) - 1))]
    paths = spark.createDataFrame(wanted, "id string, " + ", ".join(f"{d} string" for d in dims))
    sums = L.path_sums(facts, paths, [CFG.count_field], CFG)
    assert "Generate" not in plan(sums)
    got = {(r.id, r.day): r[CFG.count_field] for r in sums.collect()}
    want = {}
    for name, *values in wanted:
        part = rows
        for d, v in zip(dims, values):
            if v is not None:
                part = part[part[d] == v]
        want |= {(name, day): n for day, n in part.groupby("day")[CFG.count_field].sum().items()}
    assert got == pytest.approx(want)
    panel = L.path_daily(facts, paths, CFG)
    assert panel.count() == len(wanted) * rows.day.nunique()
