"""One key owning a third of all rows, and plans that stay distributed."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.operators import ingest as I
from pulsegrid.operators import profiles as P
from tests.helpers import plan

SF = "/root/testdata/sf0.001"


def test_hot_event_id_is_claimed_once(spark):
    n = 30000
    items = spark.range(n).select(
        F.expr("id div 100").alias("batch_id"), (F.col("id") % 100).cast("int").alias("idx"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), "id")).alias("event_id"),
        F.lit(None).cast("string").alias("reject_reason"))
    out = I.dedup_events(items, spark.createDataFrame([], "event_id string"))
    got = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert got == {"accepted": n - n // 3 + 1, "duplicate": n // 3 - 1}
    assert out.where("event_id = 'hot' AND outcome = 'accepted'").select("batch_id", "idx").first() == (0, 0)
    text = plan(out)
    assert "Window" not in text and "partial_min" in text and "SortAggregate" not in text


def test_hot_customer_costs_few_shuffled_rows(spark):
    e = spark.range(0, 40000, 1, 4).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("customer_id"),
        F.lit("email").alias("channel"), F.lit("opened").alias("type"), F.lit("processed").alias("status"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id")).alias("occurred_at"))
    df = P.build_profiles(e, "2024-01-31")
    assert df.where("customer_id = 7").first().total_events == 13334 + 53
    partial = e.groupBy(F.spark_partition_id(), "customer_id").count().count()
    assert partial <= 4 * 500


def test_skewed_join_is_split(spark):
    """A hot customer beyond the broadcast size: AQE splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60000
        items = spark.range(0, n, 1, 8).select(
            F.col("id").alias("batch_id"), F.lit(0).alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("payload"),
            F.when(F.col("id") % 3 == 0, "c7").otherwise(F.concat(F.lit("c"), F.col("id") % 900)).alias("customer_id"),
            F.lit("").alias("campaign_id"), F.lit(None).cast("string").alias("reject_reason"))
        cust = spark.range(900).select("id", F.concat(F.lit("c"), "id").alias("external_id"))
        camp = spark.range(20).select("id", F.concat(F.lit("k"), "id").alias("external_id"))
        out = I.resolve_dimensions(items, cust, camp)
        rows = out.groupBy().agg(F.count("*").alias("n"), F.count("customer_key").alias("k"))
        assert tuple(rows.collect()[0]) == (n, n)
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "p1_build_profiles", "p5_campaign_daily", "k12_campaign_analytics", "a12_recommend_audience", "a13_over_cap_customers",
    "b15_predict_channels", "b15_predict_all_customers", "i5_dedup_events", "n7_validate_analyses", "l1_lifecycle_entries",
    "c1_customer_profiles", "c2_timeline",
])
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_it_needs(spark):
    scan = [line for line in plan(entry.queries()["p1a_profile_counters"](spark, SF)).splitlines() if "FileScan" in line]
    assert len(scan) == 1 and "value" not in scan[0] and "event_type" not in scan[0]
    assert "PushedFilters: [IsNotNull(ts)" in scan[0]


def test_time_bounds_prune_day_folders(spark, tmp_path):
    """Each operator with a time bound reads the folders of its days only."""
    from pulsegrid.operators import audience as A
    from pulsegrid.operators import logs as L
    from pulsegrid.operators import predict as B
    from pulsegrid.plans.base import AS_OF, Tables
    from pulsegrid.plans.log_plans import _activity, _logs
    from pulsegrid.sources.tables import load_tables, write_tables

    t = Tables(spark, SF)
    write_tables({"events": t.events, "sends": t.sends, "event_logs": _logs(spark, SF), "activity_logs": _activity(spark, SF)},
                 str(tmp_path))
    back = load_tables(spark, str(tmp_path), ("events", "sends", "event_logs", "activity_logs"))
    windows = spark.createDataFrame([(24,), (168,)], "window_hours long")
    bounded = {
        "trend": (P.activity_trend(back["events"], AS_OF), P.activity_trend(t.events, AS_OF)),
        "sends": (A.send_counts(back["sends"], windows, AS_OF), A.send_counts(t.sends, windows, AS_OF)),
        "target": (B.target_daily(back["events"], AS_OF), B.target_daily(t.events, AS_OF)),
        "logs": (L.filter_event_logs(back["event_logs"], t.customers, t.campaigns, since="2024-01-20").select("id"), None),
        "prune": (L.prune(back["event_logs"], 14, AS_OF).select("id"), L.prune(_logs(spark, SF), 14, AS_OF).select("id")),
        "activity": (L.filter_activity(back["activity_logs"], since="2024-01-20").select("id"), None),
    }
    for name, (stored, derived) in bounded.items():
        scans = [line for line in plan(stored).splitlines() if "FileScan" in line and "event_day" in line]
        assert scans and all("event_day" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans), name
        if derived is not None:
            assert sorted(map(str, stored.collect())) == sorted(map(str, derived.collect())), name
