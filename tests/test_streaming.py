import json
import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from pulsegrid.operators import profiles as P
from pulsegrid.operators import rollups as R
from pulsegrid.plans import stream_plans
from pulsegrid.sources import batches as J
from pulsegrid.streaming import pipeline
from pulsegrid.streaming.pipeline import EngagementPipeline
from tests.helpers import plan

AS_OF = "2024-01-31 00:00:00"


def clock():
    return datetime(2024, 1, 31, tzinfo=timezone.utc)


def dims(spark):
    cust = spark.range(1, 6).select("id", F.concat(F.lit("c"), "id").alias("external_id"))
    camp = spark.range(1, 4).select("id", F.concat(F.lit("k"), "id").alias("external_id"))
    return cust, camp


def posted(n=120):
    rng = random.Random(3)
    types = ["sent", "delivered", "opened", "clicked", "converted", "bounced"]
    out = []
    for i in range(n):
        out.append({"event_id": f"e{i}", "customer_id": f"c{rng.randint(1, 5)}",
                    "campaign_id": rng.choice(["", "k1", "k2", "k3"]), "channel": rng.choice(["email", "sms"]),
                    "type": rng.choice(types),
                    "occurred_at": f"2024-01-{rng.randint(1, 30):02d}T{rng.randint(0, 23):02d}:{i % 60:02d}:{i // 60:02d}Z"})
    return out


def key(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def batch_answer(spark, items):
    df = spark.createDataFrame([(i, int(x["customer_id"][1:]), int(x["campaign_id"][1:]) if x["campaign_id"] else None,
                                 x["channel"], x["type"], x["occurred_at"]) for i, x in enumerate(items)],
                               "id long, customer_id long, campaign_id long, channel string, type string, t string")
    e = df.withColumns({"occurred_at": F.col("t").cast("timestamp"), "status": F.lit("processed")})
    return key(P.build_profiles(e, AS_OF)), key(R.campaign_daily(e).select("campaign_id", "channel", "event_type", "day", "count"))


def test_stream_equals_batch_with_shuffled_duplicated_files(spark, tmp_path):
    items, rng = posted(), random.Random(5)
    sent = items + rng.sample(items, 30)
    rng.shuffle(sent)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for f in range(0, len(sent), 25):
        (inbox / f"b{f}.json").write_text(json.dumps({"events": [*sent[f:f + 25], 42]}))
    (inbox / "bad.json").write_text("{oops")
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock)
    pipe.start(str(inbox), str(tmp_path / "cp"), files_per_trigger=3).awaitTermination()
    profiles, daily = batch_answer(spark, items)
    assert key(pipe.profiles(AS_OF)) == profiles
    order = ["campaign_id", "channel", "event_type", "day", "count"]
    assert key(pipe.daily().select(*order)) == daily
    counts = {r.outcome: r["count"] for r in pipe.table("outcomes").groupBy("outcome").count().collect()}
    assert counts == {"accepted": 120, "duplicate": 30, "rejected": 6}
    assert pipe.table("refused_batches").count() == 1
    assert pipe.table("events").select("id").distinct().count() == 120
    logs = {r.stage: r["count"] for r in pipe.table("event_logs").groupBy("stage").count().collect()}
    assert logs == {"ingested": 120, "duplicate": 30, "processed": 120}
    # Later files go on from the checkpoint; compaction does not change the answer.
    extra = [{**x, "event_id": f"x{i}"} for i, x in enumerate(posted(10))]
    (inbox / "late.json").write_text(json.dumps({"events": extra}))
    pipe.compact("profile_cells", 1, AS_OF)
    pipe.compact("campaign_daily", 1, AS_OF)
    pipe.start(str(inbox), str(tmp_path / "cp")).awaitTermination()
    profiles, daily = batch_answer(spark, items + extra)
    assert key(pipe.profiles(AS_OF)) == profiles and key(pipe.daily().select(*order)) == daily


def test_running_a_load_again_changes_nothing(spark, tmp_path):
    seen = []
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock,
                              on_events=lambda df, load: seen.append((load, df.count())))
    body = json.dumps({"events": posted(20)})
    batch = spark.createDataFrame([(1, body)], "batch_id long, body string")
    more = spark.createDataFrame([(2, json.dumps({"events": posted(25)}))], "batch_id long, body string")
    pipe.process(batch, 0)
    pipe.process(more, 1)
    once = key(pipe.profiles(AS_OF))
    pipe.process(batch, 0)
    pipe.process(more, 1)
    assert key(pipe.profiles(AS_OF)) == once
    assert seen == [(0, 20), (1, 5), (0, 20), (1, 5)]
    assert pipe.table("events").count() == 25


def test_first_loads_without_rows(spark, tmp_path):
    """Only a malformed body, only rejected items, then an ordinary load."""
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock)
    for load, body in enumerate(["{oops", json.dumps({"events": [42]}), json.dumps({"events": posted(5)})]):
        pipe.process(spark.createDataFrame([(load, body)], "batch_id long, body string"), load)
    counts = {r.outcome: r["count"] for r in pipe.table("outcomes").groupBy("outcome").count().collect()}
    assert counts == {"rejected": 1, "accepted": 5}
    assert pipe.table("refused_batches").count() == 1 and pipe.profiles(AS_OF).count() > 0


def test_a_load_without_repeats_reads_no_older_ids(spark, tmp_path, monkeypatch):
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock)
    items, read = posted(90), []
    whole = pipe.table
    monkeypatch.setattr(pipe, "table", lambda name: read.append(name) or whole(name))

    def load(number, part):
        read.clear()
        body = json.dumps({"events": part})
        pipe.process(spark.createDataFrame([(number, body)], "batch_id long, body string"), number)
        got = {r.outcome: r["count"] for r in whole("outcomes").where(F.col("load") == number).groupBy("outcome").count().collect()}
        return got, "event_ids" in read

    assert load(0, items[:30]) == ({"accepted": 30}, False)
    assert load(1, items[30:60]) == ({"accepted": 30}, False)
    assert load(2, items[60:] + items[:5]) == ({"accepted": 30, "duplicate": 5}, True)
    # Again, as after a failure; then nothing but repeats.
    assert load(2, items[60:] + items[:5]) == ({"accepted": 30, "duplicate": 5}, True)
    assert load(3, items) == ({"duplicate": 90}, True)
    assert whole("event_ids").count() == 90
    # A version holds all earlier bits, whichever load brought them.
    assert pipe._filter(2).count() <= pipe._filter(9).count()


def test_a_full_filter_keeps_dedup_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "FILTER_BITS", 4)
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock)
    items = posted(60)
    for number, part in enumerate([items[:40], items[40:], items]):
        pipe.process(spark.createDataFrame([(number, json.dumps({"events": part}))], "batch_id long, body string"), number)
    counts = {(r.load, r.outcome): r["count"] for r in pipe.table("outcomes").groupBy("load", "outcome").count().collect()}
    assert counts == {(0, "accepted"): 40, (1, "accepted"): 20, (2, "duplicate"): 60}


def test_the_stream_keeps_the_customers_recency(spark, tmp_path):
    cust, camp = dims(spark)
    cust = cust.withColumn("last_event_at", F.when(F.col("id") == 1, F.lit("2025-01-01").cast("timestamp")))
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), cust, camp, clock=clock)
    assert pipe.current_customers().where("last_event_at IS NOT NULL").count() == 1
    items = posted(40)
    for number, part in enumerate([items[20:], items[:20]]):
        pipe.process(spark.createDataFrame([(number, json.dumps({"events": part}))], "batch_id long, body string"), number)
    got = {r.id: r.at for r in pipe.current_customers().selectExpr("id", "cast(last_event_at as string) at").collect()}
    want = {int(c[1:]): max(x["occurred_at"] for x in items if x["customer_id"] == c) for c in {x["customer_id"] for x in items}}
    assert got[1].startswith("2025-01-01")
    assert {k: v for k, v in got.items() if k != 1 and v} == {k: v.replace("T", " ").rstrip("Z") for k, v in want.items() if k != 1}


def test_the_drained_bodies_share_files_and_make_two_loads(spark):
    pipe = stream_plans.run_pipeline(spark, "/root/testdata/sf0.001")
    log = J.read_batch_log(spark, pipe.base.removesuffix("tables") + "inbox")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.expr("event_id div 50").alias("b")).distinct()
    assert log.count() == events.count() + events.where("b % 10 = 0").count()
    assert len(log.inputFiles()) <= 4
    assert sorted(r.load for r in pipe.table("outcomes").select("load").distinct().collect()) == [0, 1]


def test_items_of_a_load_are_parsed_once(spark, tmp_path, monkeypatch):
    seen, parse = spark.sparkContext.accumulator(0), pipeline.I.parse_items

    @F.udf("boolean")
    def count(_):
        seen.add(1)
        return True

    monkeypatch.setattr(pipeline.I, "parse_items", lambda items: parse(items).where(count("event_id")))
    bodies = [(i, json.dumps({"events": posted()[i::4]})) for i in range(4)]
    pipe = EngagementPipeline(spark, str(tmp_path / "t"), *dims(spark), clock=clock)
    for load in range(2):
        pipe.process(spark.createDataFrame(bodies, J.BATCH_LOG), load)
    assert seen.value == 2 * 120
    counts = {(r.load, r.outcome): r["count"] for r in pipe.table("outcomes").groupBy("load", "outcome").count().collect()}
    assert counts == {(0, "accepted"): 120, (1, "duplicate"): 120}


def test_a_body_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"events":[1,2]}'), (2, '{"events":[]}'), (3, "{oops"), (4, None)], J.BATCH_LOG)
    items = J.split_batches(rows)
    assert [(r.batch_id, r.idx) for r in items.orderBy("idx").collect()] == [(1, 0), (1, 1)]
    assert plan(items).count("parseJson") == 1
