"""Steps that must read the large tables once, whatever is looked up or asked afterwards."""

import catalog.attribution as A
import catalog.publishing as B
import catalog.strategy as ST


def reads(df, table):
    return any(f"/{table}.parquet" in file for file in df.inputFiles())


def test_lookups_read_the_stored_cube(spark, sf_dir):
    assert not reads(ST.joined(spark, sf_dir), "lineitem")


def test_runs_and_publishing_read_stored_facts(spark, sf_dir, monkeypatch):
    assert not reads(A.raw_facts(spark, sf_dir), "events")
    seen = []
    monkeypatch.setattr(B, "_CACHE", {})
    monkeypatch.setattr(B.P, "publish", lambda facts, *args, **more: seen.append(facts))
    B.store(spark, sf_dir)
    assert len(seen) == 2 and not any(reads(facts, "events") for facts in seen)
