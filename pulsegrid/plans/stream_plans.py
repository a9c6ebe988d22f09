"""Queries and oracles: the streaming pipeline run over all events as posted batches."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.operators import deadletter as D
from pulsegrid.plans import ingest_plans
from pulsegrid.plans.base import AS_OF, EV, DAILY, PROFILES, Tables, flat, sql
from pulsegrid.plans.ingest_plans import bodies
from pulsegrid.session import checkpoint_dir
from pulsegrid.sources import batches as J
from pulsegrid.streaming import failures as A
from pulsegrid.streaming.live import enable_state_store
from pulsegrid.streaming.pipeline import EngagementPipeline

LOADS = 2


_DRAINED: dict[tuple[str, str], EngagementPipeline] = {}


def drained(spark, sf) -> EngagementPipeline:
    """One run per application and data folder; its tables serve all queries below."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _DRAINED:
        _DRAINED[at] = run_pipeline(spark, sf)
    return _DRAINED[at]


def run_pipeline(spark, sf) -> EngagementPipeline:
    """Posts every event in bodies of 50, some bodies twice, and drains their log."""
    t, base = Tables(spark, sf), f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    posted = bodies(spark, sf, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    # A body that is posted twice is made once.
    batch, again = F.col("batch_id"), F.col("batch_id") + 1000000000
    posted = posted.withColumn("batch_id", F.explode(F.when(batch % 10 == 0, F.array(batch, again)).otherwise(F.array(batch))))
    parts = max(LOADS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    J.write_batch_log(posted.repartition(parts, "batch_id"), f"{base}/inbox")
    pipe = EngagementPipeline(spark, f"{base}/tables", t.customers, t.campaigns,
                              clock=lambda: datetime.fromisoformat(AS_OF + "+00:00"))
    files = len(J.read_batch_log(spark, f"{base}/inbox").inputFiles())
    stream = J.stream_batch_log(spark, f"{base}/inbox", -(-files // LOADS))
    pipe.follow(stream, f"{base}/checkpoint").awaitTermination()
    return pipe


def st1_stream_profiles(spark, sf):
    return flat(drained(spark, sf).profiles(AS_OF))


def st2_stream_campaign_daily(spark, sf):
    pipe = drained(spark, sf)
    pipe.compact("campaign_daily", 0, AS_OF)
    return flat(pipe.daily())


def st3_stream_outcomes(spark, sf):
    pipe = drained(spark, sf)
    return flat(pipe.table("outcomes").groupBy("outcome").agg(F.count("*").alias("items")))


def st4_stream_dead_letters(spark, sf):
    """Failures posted in three parts by time; the stream ends after each part and goes on from its checkpoint."""
    enable_state_store(spark)
    base = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    failed = ingest_plans.failures(spark, sf)
    number = F.regexp_extract("error", r"(\d+)", 1).cast("int")
    for part in (number <= 3, number.between(4, 9), number > 9):
        failed.where(part).write.mode("append").parquet(f"{base}/failures")
        letters = A.live_dead_letters(spark.readStream.schema(failed.schema).parquet(f"{base}/failures"))
        letters.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start(f"{base}/letters").awaitTermination()
    done = A.failed_rounds(spark.read.schema(A.OUTPUT).parquet(f"{base}/letters"))
    return flat(D.dead_letters(ingest_plans.X.events(spark, sf), done), "id", "event_id", "error", "attempts", "failed_at", "payload")


def st5_stream_dedup(spark, sf):
    """Four loads: two of new ids, one of nothing but repeats, one of repeats and new ids."""
    t, base = Tables(spark, sf), f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    pipe = EngagementPipeline(spark, base, t.customers, t.campaigns, clock=lambda: datetime.fromisoformat(AS_OF + "+00:00"))
    posted = bodies(spark, sf, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").drop("part")
    part = F.col("batch_id") % 4
    for load, wanted in enumerate([part == 0, part == 1, part == 0, (part == 1) | (part == 2)]):
        pipe.process(posted.where(wanted), load)
    return flat(pipe.table("outcomes").groupBy("load", "outcome").agg(F.count("*").alias("items")))


def p4_stream_customer_last_event(spark, sf):
    """The recency markers that the stream keeps."""
    return flat(drained(spark, sf).current_customers(), "id", "last_event_at")


QUERIES = {f.__name__: f for f in (st1_stream_profiles, st2_stream_campaign_daily, st3_stream_outcomes,
                                   st4_stream_dead_letters, st5_stream_dedup,
                                   p4_stream_customer_last_event)}

# The pipeline processes what it accepts, so no event has failed.
_ALL = tuple(part.replace("SELECT * FROM ev WHERE status = 'processed'", "SELECT * FROM ev") for part in EV)

ORACLES = {
    "st1_stream_profiles": sql(
        """SELECT customer_id, total AS total_events, pos AS positive_events, neg AS negative_events,
          conv AS conversions, epoch_us(last_at) AS last_event_at, last_type AS last_event_type,
          round(raw, 6) + 0.0 AS engagement_score, epoch_us(last_at) AS score_updated_at, trend AS activity_trend,
          coalesce(preferred, '') AS preferred_channel
        FROM prof""", *_ALL, PROFILES),
    "st2_stream_campaign_daily": sql(
        "SELECT campaign_id, channel, type AS event_type, day::VARCHAR AS day, n AS count FROM daily", *_ALL, DAILY),
    "st3_stream_outcomes": sql(
        """SELECT 'accepted' AS outcome, count(*) AS items FROM ev
        UNION ALL SELECT 'duplicate', count(*) FROM ev WHERE id // 50 % 10 = 0""", *EV),
    "st4_stream_dead_letters": ingest_plans.ORACLES["p6_dead_letters"],
    "st5_stream_dedup": sql(
        """SELECT load, outcome, items FROM (
          SELECT 0 AS load, 'accepted' AS outcome, count(*) AS items FROM ev WHERE id // 50 % 4 = 0
          UNION ALL SELECT 1, 'accepted', count(*) FROM ev WHERE id // 50 % 4 = 1
          UNION ALL SELECT 2, 'duplicate', count(*) FROM ev WHERE id // 50 % 4 = 0
          UNION ALL SELECT 3, 'duplicate', count(*) FROM ev WHERE id // 50 % 4 = 1
          UNION ALL SELECT 3, 'accepted', count(*) FROM ev WHERE id // 50 % 4 = 2) WHERE items > 0""", *EV),
    "p4_stream_customer_last_event": sql(
        """SELECT id, coalesce(epoch_us(greatest(seen, last_at)), -1) AS last_event_at
        FROM cu LEFT JOIN lastev ON customer_id = id""", *_ALL, PROFILES),
}
