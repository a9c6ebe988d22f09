"""Versioned tables: loads that change together, old versions, retention by folders, lookups that skip row groups."""

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import store


def logs(spark, n, first_day="2024-01-01", days=10):
    at = F.lit(f"{first_day} 06:00:00").cast("timestamp") + F.make_dt_interval(days=(F.col("id") % days).cast("int"), hours=(F.col("id") % 17).cast("int"))
    return spark.range(n).select("id", F.concat(F.lit("evt_"), F.lpad((F.col("id") * 7919 % n).cast("string"), 9, "0")).alias("event_id"),
                                 F.concat(F.lit("req-"), F.floor(F.col("id") / 3).cast("string")).alias("request_id"), at.alias("created_at"))


def customers(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("c"), "id").alias("external_id"))


def counts(tables):
    return {name: df.count() for name, df in tables.items()}


def folders(base, name):
    """Data files with the time of their last change."""
    out = {}
    for top, _, names in os.walk(f"{base}/{name}"):
        out |= {f"{top}/{n}": os.stat(f"{top}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


def test_tables_change_together(spark, tmp_path):
    base = str(tmp_path)
    assert store.manifest(spark, base).version == 0 and store.tables(spark, base) == {}
    assert store.publish(spark, {"customers": customers(spark, 5), "event_logs": logs(spark, 40)}, base) == 1
    assert store.publish(spark, {"customers": customers(spark, 9), "event_logs": logs(spark, 20, "2024-01-08")}, base, append=("event_logs",)) == 2
    assert counts(store.tables(spark, base)) == {"customers": 9, "event_logs": 60}
    assert counts(store.tables(spark, base, version=1)) == {"customers": 5, "event_logs": 40}
    days = {r[0] for r in store.tables(spark, base)["event_logs"].select(F.col("event_day").cast("string")).distinct().collect()}
    assert days == {f"2024-01-{d:02d}" for d in range(1, 18)}
    # A table that is not given stays.
    store.publish(spark, {"customers": customers(spark, 1)}, base)
    assert counts(store.tables(spark, base)) == {"customers": 1, "event_logs": 60}
    with pytest.raises(ValueError, match="unknown table"):
        store.publish(spark, {"nonsense": customers(spark, 1)}, base)
    with pytest.raises(ValueError, match="no version"):
        store.manifest(spark, base, 9)


def test_a_load_that_dies_between_two_tables_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    store.publish(spark, {"customers": customers(spark, 5), "event_logs": logs(spark, 40)}, base)
    broken = logs(spark, 40).withColumn("event_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.publish(spark, {"customers": customers(spark, 50), "event_logs": broken}, base)
    assert store.versions(spark, base) == [1]
    assert counts(store.tables(spark, base)) == {"customers": 5, "event_logs": 40}
    # The same load again, whole: nothing of the first try is seen.
    store.publish(spark, {"customers": customers(spark, 50), "event_logs": logs(spark, 7)}, base)
    assert counts(store.tables(spark, base)) == {"customers": 50, "event_logs": 7}


def test_loads_that_meet_are_told_apart(spark, tmp_path):
    base = str(tmp_path)
    store.publish(spark, {"customers": customers(spark, 5)}, base)
    before = store.manifest(spark, base)
    store.publish(spark, {"customers": customers(spark, 6)}, base)
    with pytest.raises(store.VersionConflict):
        store._publish(spark, base, before, {"customers": before.tables["customers"]})
    assert counts(store.tables(spark, base)) == {"customers": 6}


def test_empty_tables(spark, tmp_path):
    base = str(tmp_path)
    store.publish(spark, {"customers": customers(spark, 0), "event_logs": logs(spark, 0)}, base)
    back = store.tables(spark, base)
    assert counts(back) == {"customers": 0, "event_logs": 0}
    assert back["event_logs"].columns == [*logs(spark, 1).columns, "event_day"]
    assert store.prune(spark, base, "event_logs", 5, "2024-01-10 12:00:00") == 1


def test_retention_drops_folders_and_rewrites_the_border(spark, tmp_path):
    base, as_of = str(tmp_path), "2024-01-10 12:00:00"
    store.publish(spark, {"event_logs": logs(spark, 400)}, base)
    before = folders(base, "event_logs")
    assert store.prune(spark, base, "event_logs", 4, as_of) == 2
    since = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '4' DAY")
    want = {r.id for r in logs(spark, 400).where(F.col("created_at") >= since).collect()}
    kept = store.tables(spark, base)["event_logs"]
    assert {r.id for r in kept.collect()} == want and kept.count() == len(want)
    after = folders(base, "event_logs")
    # No file was changed, and the only new ones are of the border day.
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("event_day=")[1][:10] for f in set(after) - set(before)} == {"2024-01-06"}
    known = store.manifest(spark, base).tables["event_logs"]["folders"]
    assert sorted(known) == [f"2024-01-{d:02d}" for d in range(6, 11)]
    assert store.tables(spark, base, version=1)["event_logs"].count() == 400
    assert store.prune(spark, base, "event_logs", 4, as_of) == 2 and store.prune(spark, base, "event_logs", 0, as_of) == 2


def read_rows(df):
    """Rows that the scan handed on, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 8 << 10)
    monkeypatch.setattr(store, "BLOOM_IDS", 2000)
    base, n = str(tmp_path), 40_000
    store.publish(spark, {"event_logs": logs(spark, n, days=2)}, base)
    table = store.tables(spark, base)["event_logs"]
    assert read_rows(table.where("length(event_id) > 0")) == n
    for condition, rows in (("event_id = 'evt_000012345'", 1), ("request_id = 'req-77'", 3)):
        found = table.where(condition)
        assert found.count() == rows
        assert read_rows(found) <= n / 4, condition
    assert read_rows(table.where("request_id = 'req-0x'")) <= n / 10


def test_a_day_prunes_folders(spark, tmp_path):
    base = str(tmp_path)
    store.publish(spark, {"event_logs": logs(spark, 400)}, base)
    day = store.tables(spark, base)["event_logs"].where("event_day = '2024-01-03'")
    assert read_rows(day) == day.count() == logs(spark, 400).where("to_date(created_at) = '2024-01-03'").count()
