import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.operators import deadletter as D
from pulsegrid.operators import ingest as I
from pulsegrid.sources import batches as J
from pulsegrid.sources import fixture as X
from pulsegrid.sources import tables as W

NOW = "2026-01-01 00:00:00"
BASE = {"event_id": "evt_01HZTEST", "customer_id": "cust_00042", "campaign_id": "", "channel": "email",
        "type": "opened", "occurred_at": "2020-01-01T10:00:00Z"}


def batches(spark, bodies):
    return spark.createDataFrame(
        [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "batch_id long, body string")


def outcomes(spark, items, stored=()):
    df = I.parse_items(J.split_batches(batches(spark, [{"events": b} for b in items])))
    cust = spark.createDataFrame([(42, "cust_00042"), (7, "cust_00007")], "id long, external_id string")
    camp = spark.createDataFrame([(3, "camp_003")], "id long, external_id string")
    known = spark.createDataFrame([(s,) for s in stored], "event_id string")
    return I.ingest(df, cust, camp, known, NOW)


@pytest.mark.parametrize("change, reason", [
    ({"event_id": ""}, "event_id is required"),
    ({"customer_id": ""}, "customer_id is required"),
    ({"channel": ""}, "invalid channel"),
    ({"channel": "carrier-pigeon"}, "invalid channel"),
    ({"type": ""}, "invalid type"),
    ({"type": "exploded"}, "invalid type"),
    ({"occurred_at": ""}, "occurred_at is required"),
    ({"occurred_at": "yesterday"}, "occurred_at must be RFC3339"),
    ({"occurred_at": "2027-01-01T00:00:00Z"}, "occurred_at is in the future"),
    ({}, None),
])
def test_first_broken_rule(spark, change, reason):
    row = spark.createDataFrame([{**BASE, **change}])
    assert I.validate_events(row, NOW).first().reject_reason == reason


def test_all_channel_type_pairs_accepted(spark):
    rows = [{**BASE, "channel": c, "type": t} for c in V.CHANNELS for t in V.EVENT_TYPES]
    got = I.validate_events(spark.createDataFrame(rows), NOW)
    assert got.where(F.col("reject_reason").isNull()).count() == 40


@pytest.mark.parametrize("text, want", [
    ("2024-01-01", None), ("2024-01-01 10:00:00", None), ("2024-01-01T10:00", None), ("2024-02-30T10:00:00Z", None),
    ("2024-01-01T10:00:00", None), ("yesterday", None), ("2024-01-01T25:00:00Z", None),
    ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00+05:30", "2024-01-01 04:30:00"),
    ("2024-01-01T10:00:00.25-01:00", "2024-01-01 11:00:00.25"),
])
def test_rfc3339(spark, text, want):
    got = spark.range(1).select(I.parse_rfc3339(F.lit(text)).cast("string").alias("t")).first().t
    assert got == want


def test_malformed_batches(spark):
    b = batches(spark, ['{"events": []}', '{"events": null}', "{}", "{bad", "[]", "null", '{"events": 5}',
                        {"events": [BASE] * 501}, {"events": [BASE] * 500}])
    bad = {r.batch_id: r.batch_error for r in J.malformed_batches(b).collect()}
    assert bad == {i: J.MALFORMED for i in range(1, 7)}
    assert J.split_batches(b).count() == 1001


def test_strict_item_types(spark):
    items = [42, None, {**BASE, "event_id": 7}, {**BASE, "campaign_id": None}, "text", [1],
             {**BASE, "event_id": "evt_p", "payload": {"a": [1]}}]
    got = outcomes(spark, [items]).orderBy("idx").collect()
    assert [r.reject_reason for r in got] == [
        "malformed event object", "event_id is required", "malformed event object", None, "malformed event object",
        "malformed event object", None]
    assert got[3].payload == "{}" and json.loads(got[6].payload) == {"a": [1]}


def test_mixed_batch_summary(spark):
    items = [BASE, {**BASE, "event_id": "e2", "customer_id": "cust_x"}, {**BASE, "event_id": "e3", "campaign_id": "camp_x"},
             42, BASE, {**BASE, "event_id": "e4", "campaign_id": "camp_003"}, {**BASE, "event_id": "old"}]
    out = outcomes(spark, [items], stored=["old"])
    s = I.ingest_summary(out).first()
    assert (s.accepted, s.duplicates, s.rejected) == (2, 2, 3)
    assert [(r["index"], r["reason"]) for r in I.rejected_items(out).orderBy("index").collect()] == [
        (1, "unknown customer_id"), (2, "unknown campaign_id"), (3, "malformed event object")]


def test_rejected_item_claims_no_id(spark):
    out = outcomes(spark, [[{**BASE, "type": "exploded"}, BASE]]).orderBy("idx").collect()
    assert [r.outcome for r in out] == ["rejected", "accepted"]


def test_one_of_twenty_is_accepted(spark):
    out = outcomes(spark, [[BASE]] * 20)
    got = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert got == {"accepted": 1, "duplicate": 19}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 5)), min_size=1, max_size=25), st.sets(st.integers(0, 5)))
def test_dedup_against_brute_force(spark, posted, stored):
    """Same answer as a loop in input order, and nothing new on a replay."""
    rows = [(b, i, f"e{e}", None) for i, (b, e) in enumerate(posted)]
    df = spark.createDataFrame(rows, "batch_id long, idx int, event_id string, reject_reason string")
    known = spark.createDataFrame([(f"e{s}",) for s in stored], "event_id string")
    seen, want = {f"e{s}" for s in stored}, {}
    for b, i, e, _ in sorted(rows):
        want[(b, i)] = "duplicate" if e in seen else "accepted"
        seen.add(e)
    got = {(r.batch_id, r.idx): r.outcome for r in I.dedup_events(df, known).collect()}
    assert got == want
    again = I.dedup_events(df, spark.createDataFrame([(e,) for e in seen], "event_id string"))
    assert {r.outcome for r in again.collect()} == {"duplicate"}


def test_batch_of_any_size(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps({"events": [{**BASE, "event_id": f"e{i}"} for i in range(1203)]}))
    items, bad = J.read_event_batches(spark, str(tmp_path))
    assert items.count() == 1203 and bad.count() == 0


def test_one_batch_id_for_two_bodies(spark):
    """Rows are never doubled, and a body that is posted twice is accepted once."""
    rows = [(5, p, i, e, None) for p, body in ((1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "b"])) for i, e in enumerate(body)]
    df = spark.createDataFrame(rows, "batch_id long, post_id long, idx int, event_id string, reject_reason string")
    got = {(r.post_id, r.idx): r.outcome for r in I.dedup_events(df, spark.createDataFrame([], "event_id string")).collect()}
    assert got == {(1, 0): "accepted", (1, 1): "accepted", (2, 0): "duplicate", (2, 1): "accepted", (3, 0): "duplicate",
                   (3, 1): "duplicate"}
    other = I.dedup_events(df.drop("post_id").where("event_id <> 'a'"), spark.createDataFrame([], "event_id string"))
    assert other.count() == 3


def test_failures_after_a_replay(spark):
    rows = [(1, f"2024-01-01 00:{k:02d}:00", f"err {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "id long, at string, error string").withColumn("attempted_at", F.col("at").cast("timestamp"))
    rounds = D.failure_rounds(df).orderBy("round").collect()
    assert [(r.attempts, r.last_error, r.status) for r in rounds] == [(5, "err 4", "failed"), (5, "err 9", "failed")]
    events = spark.createDataFrame([(1, "evt_1", "{}")], "id long, event_id string, payload string")
    assert D.dead_letters(events, D.failure_rounds(df)).count() == 2


@pytest.mark.parametrize("failed, limit, dead", [(1, 5, False), (4, 5, False), (5, 5, True), (7, 5, False), (10, 5, True), (1, 1, True)])
def test_dead_letter_rule(spark, failed, limit, dead):
    rows = [(1, f"2024-01-01 00:0{k}:00", f"err {k}") for k in range(failed)]
    df = spark.createDataFrame(rows, "id long, at string, error string").withColumn("attempted_at", F.col("at").cast("timestamp"))
    r = D.classify_failures(df, limit).first()
    assert (r.status == "failed") == dead and r.attempts == (failed - 1) % limit + 1
    assert r.last_error == f"err {failed - 1}"


def test_tables_round_trip(spark, tmp_path):
    from tests.helpers import events

    e = events(spark, [(1, "email", "sent", "2024-01-01"), (2, "sms", "opened", "2024-01-02")])
    W.write_tables({"events": e}, str(tmp_path))
    back = W.load_tables(spark, str(tmp_path), ("events",))
    assert {r.rows for r in W.table_counts(back).collect()} == {2}
    day = back["events"].where(F.col("event_day") == "2024-01-02")
    assert "PartitionFilters: [isnotnull(event_day" in day._jdf.queryExecution().executedPlan().toString()


def test_replay_file(spark, tmp_path):
    (tmp_path / "replay.json").write_text(json.dumps({"events": [BASE, {**BASE, "event_id": "e2"}]}, indent=1))
    items = J.read_replay_file(spark, str(tmp_path / "replay.json"))
    assert [r.event_id for r in I.parse_items(items).orderBy("idx").collect()] == ["evt_01HZTEST", "e2"]


def test_keys_longer_than_their_padding_keep_external_ids_of_their_own(spark):
    keys = spark.createDataFrame([(42,), (10000,), (100000,), (100009,), (100000000,), (1000000001,)], "id long")
    for ext in (X.customer_ext, X.campaign_ext, X.event_ext):
        assert keys.select(ext(F.col("id")).alias("x")).distinct().count() == 6
    cust = keys.select("id", X.customer_ext(F.col("id")).alias("external_id"))
    items = cust.select(F.col("id").alias("batch_id"), F.lit(0).alias("idx"), F.col("external_id").alias("customer_id"),
                        F.lit("").alias("campaign_id"), F.lit("").alias("payload"), F.lit(None).cast("string").alias("reject_reason"))
    got = I.resolve_dimensions(items, cust, spark.createDataFrame([], "id long, external_id string")).collect()
    assert len(got) == 6 and all(r.customer_key == r.batch_id for r in got)
    assert "cust_00042" in {r.external_id for r in cust.collect()}


def test_a_batch_log_gives_the_items_of_its_bodies(spark, tmp_path):
    posted = batches(spark, ["{oops", {"events": [BASE, 42]}, {"items": []}, {"events": [BASE]}, {"events": []}])
    J.write_batch_log(posted.coalesce(1), str(tmp_path / "log"))
    good, bad = J.read_event_batches(spark, str(tmp_path / "log"), log=True)
    assert sorted((r.batch_id, r.idx) for r in good.collect()) == [(1, 0), (1, 1), (3, 0)]
    assert sorted(r.batch_id for r in bad.collect()) == [0, 2]
    assert len(good.inputFiles()) == 1 and J.read_replay_file(spark, str(tmp_path / "log"), log=True).count() == 3
