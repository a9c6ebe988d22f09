import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import deadletter as D
from pulsegrid.operators import health as H
from pulsegrid.operators import logs as L
from pulsegrid.plans import log_plans
from tests.helpers import events

NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def world(spark):
    e = events(spark, [(i, "email", "sent", f"2024-01-{i:02d}", i % 2 or None) for i in range(1, 13)])
    e = e.withColumns({"processed_at": F.col("received_at"),
                       "status": F.when(F.col("id") == 3, "failed").otherwise("processed")})
    fails = spark.createDataFrame([(3, f"2024-01-04 00:0{k}:00", "boom") for k in range(5)], "id long, t string, error string")
    fails = fails.withColumn("attempted_at", F.col("t").cast("timestamp")).drop("t")
    dlq = D.dead_letters(e, D.classify_failures(fails))
    lost = dlq.limit(1).withColumns({"id": F.lit(99).cast("long"), "event_id": F.lit("evt_lost")})
    dlq = dlq.unionByName(lost)
    cust = spark.range(1, 13).select("id", F.concat(F.lit("c"), "id").alias("external_id"))
    camp = spark.createDataFrame([(1, "camp_1")], "id long, external_id string")
    return e, fails, dlq, cust, camp


def all_logs(spark, world):
    e, fails, dlq, *_ = world
    _, _, log = D.replay_dlq(dlq, e, dlq.select("id"), NOW, "req-9")
    return L.lifecycle_entries(L.processed_entries(e, "w1"), L.failure_entries(e, fails), L.replay_entries(log))


def test_replay(spark, world):
    e, _, dlq, *_ = world
    letters, updated, log = D.replay_dlq(dlq, e, dlq.select("id"), NOW)
    assert letters.where(F.col("replayed_at").isNull()).count() == 0
    back = updated.where("status = 'pending'").collect()
    assert [(r.id, r.attempts) for r in back] == [(3, 0)]
    assert log.count() == 2
    assert [r.id for r in D.select_unprocessed(updated).collect()] == [3]
    assert [r.id for r in D.stuck_pending(updated, NOW).collect()] == [3]
    assert D.stuck_pending(updated, "2024-01-03 00:00:20").count() == 0
    again = D.replay_dlq(letters, updated.withColumn("status", F.lit("processed")), dlq.select("id"), NOW)[1]
    assert again.where("status = 'pending'").count() == 0


def test_modes_and_levels(spark, world):
    logs = all_logs(spark, world)
    stages = {r.stage for r in L.apply_log_mode(logs, "errors").collect()}
    assert stages == {"retry", "dead_lettered", "replayed"}
    assert L.apply_log_mode(logs, "off").count() == 0 and L.apply_log_mode(logs, "all").count() == logs.count()
    assert {r.level for r in logs.where(L.min_level("warn")).collect()} == {"warn", "error"}
    with pytest.raises(ValueError):
        L.min_level("loud")


def test_errors_mode_leaves_out_the_steps_without_errors(spark, world):
    """Ingest is the dear step: its items are not read for a log that keeps none of its rows."""
    e, _, dlq, *_ = world
    items = spark.range(3).select(
        F.col("id").alias("row_id"), F.lit("evt").alias("event_id"), F.lit(1).alias("customer_key"), F.lit(1).alias("campaign_key"),
        F.lit("r").alias("request_id"), F.when(F.col("id") < 2, "accepted").otherwise("rejected").alias("outcome"),
        F.lit("email").alias("channel"), F.lit("sent").alias("type"))
    _, _, replays = D.replay_dlq(dlq, e, dlq.select("id"), NOW, "req-9")
    logs = L.lifecycle_entries(L.ingest_entries(items, F.lit(NOW).cast("timestamp")), L.replay_entries(replays))
    kept = L.apply_log_mode(logs, "errors")
    assert logs.count() == 4 and [r.stage for r in kept.collect()] == ["replayed"] * 2
    assert "Range" in logs._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_life_of_one_event(spark, world):
    *_, cust, camp = world
    rows = L.trace_event(all_logs(spark, world), cust, camp, event_id="evt_3").collect()
    assert [r.stage for r in rows] == ["retry"] * 4 + ["dead_lettered", "replayed"]
    assert [r.attempt for r in rows] == [1, 2, 3, 4, 5, None]
    assert {r.request_id for r in rows} == {"req-1"} and rows[0].details == '{"error":"boom"}'
    assert rows[0].customer == "c3" and rows[0].campaign == "camp_1" and rows[0].worker is None


def test_query_pages(spark, world):
    *_, cust, camp = world
    logs = all_logs(spark, world)
    want = [r.id for r in logs.where("stage = 'processed'").orderBy(F.desc("created_at"), F.desc("id")).collect()]
    got, cursor = [], None
    while True:
        page = L.query_event_logs(logs, cust, camp, cursor, 4, stage="processed").orderBy("page_pos").collect()
        got += [r.id for r in page]
        if not page[-1].has_more:
            break
        cursor = (str(page[-1].created_at), page[-1].id)
    assert got == want and len(got) == 11
    assert L.query_event_logs(logs, cust, camp, campaign="camp_1").where("campaign_id <> 1").count() == 0
    assert L.query_event_logs(logs, cust, camp, customer="nobody").count() == 0
    with pytest.raises(ValueError):
        L.query_event_logs(logs, cust, camp, stage="lost")


def test_prune(spark, world):
    logs = all_logs(spark, world)
    assert L.prune(logs, 0, NOW).count() == logs.count()
    assert {r.stage for r in L.prune(logs, 1, NOW).collect()} == {"replayed"}


def access(spark, **over):
    base = dict(id=1, request_id="r", method="GET", route="/api/v1/customers/:id", path="/api/v1/customers/c1",
                query=" x=1 ", entity="c1", status=200, latency_ms=3, client_ip="", user_agent="a", summary="", error="")
    return spark.createDataFrame([{**base, **over}]).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


@pytest.mark.parametrize("over, action, error", [
    ({}, "customer.view", None), ({"route": "", "path": "/api/v1/nope", "status": 404}, "unknown", None),
    ({"method": "DELETE", "route": "/api/v1/things/:id"}, "DELETE /api/v1/things/:id", None),
    ({"status": 500}, "customer.view", "internal error"), ({"status": 500, "error": "db"}, "customer.view", "db"),
])
def test_activity(spark, over, action, error):
    r = L.activity_records(access(spark, **over)).first()
    assert (r.action, r.error, r.query, r.summary) == (action, error, "x=1", None)


@pytest.mark.parametrize("over", [{"route": "/api/v1/system/health"}, {"route": "/api/v1/logs"},
                                  {"route": "/api/v1/activity"}, {"path": "/app/index.html"}])
def test_not_recorded(spark, over):
    assert L.activity_records(access(spark, **over)).count() == 0


def test_activity_filters(spark):
    rec = L.activity_records(access(spark).unionByName(access(spark, id=2, status=404)))
    assert L.query_activity(rec, action="customer.", outcome="error").first().id == 2
    assert L.query_activity(rec, action="customer").count() == 0
    with pytest.raises(ValueError):
        L.query_activity(rec, outcome="maybe")


def test_dlq_pages(spark, world):
    dlq = world[2]
    first = L.list_dlq(dlq, limit=1).first()
    assert first.id == 3 and first.has_more
    second = L.list_dlq(dlq, after=3, limit=1).first()
    assert second.id == 99 and not second.has_more


def test_health(spark, world):
    e, _, dlq, *_ = world
    out = spark.createDataFrame([("accepted",)] * 3 + [("rejected",)], "outcome string")
    h = H.health_report(D.replay_dlq(dlq, e, dlq.select("id"), NOW)[1], dlq, out, NOW).first()
    assert (h.pending_events, h.processed_events, h.dlq_size, h.accepted_rate) == (1, 11, 2, 0.75)
    assert h.oldest_pending_seconds == 29 * 86400


def test_pages_of_the_newest_logs_derive_them_once(spark):
    out = log_plans.l3_query_newest_logs(spark, "/root/testdata/sf0.001")
    assert not any("events.parquet" in f for f in out.inputFiles())
    assert [(r.page, r.page_pos) for r in out.orderBy("page", "page_pos").collect()] == [(p, i) for p in (1, 2) for i in range(1, 51)]
