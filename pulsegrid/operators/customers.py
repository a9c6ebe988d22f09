"""Customer reads: live profiles and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators.paging import after_cursor, keyset_page
from pulsegrid.operators.profiles import activity_trend, channel_count_maps

TIMELINE_ORDER = [("occurred_at", "desc"), ("id", "desc")]


def customer_profiles(customers: DataFrame, profiles: DataFrame, events: DataFrame, as_of,
                      counts: DataFrame | None = None) -> DataFrame:
    """Every customer with live score and trend; no profile reads as zeros.

    Give ``counts`` (the long counters) to add the nested channel_counts map.
    """
    now = S.as_ts(as_of)
    live = profiles.select(
        F.col("customer_id").alias("id"), "total_events", "positive_events", "negative_events", "conversions",
        F.col("last_event_at").alias("profile_last_event_at"), "preferred_channel",
        S.decay_raw(F.col("engagement_score"), F.col("score_updated_at"), now).alias("raw_score"),
    )
    trend = activity_trend(events, as_of).select(F.col("customer_id").alias("id"), "activity_trend")
    out = customers.drop("last_event_at").join(live, "id", "left").join(trend, "id", "left")
    raw = F.coalesce("raw_score", F.lit(0.0))
    cols = [
        F.col("id"), F.col("external_id").alias("customer_id"), "email", "attributes", "is_active",
        S.normalize(raw).alias("score"), raw.alias("raw_score"),
        F.coalesce("activity_trend", F.lit("stable")).alias("trend"), "preferred_channel",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c)
          for c in ("total_events", "positive_events", "negative_events", "conversions")],
        F.col("profile_last_event_at").alias("last_event_at"),
    ]
    if counts is not None:
        maps = channel_count_maps(counts).withColumnRenamed("customer_id", "id")
        out = out.join(maps, "id", "left")
        empty = F.expr("CAST(map() AS map<string, map<string, bigint>>)")
        cols.append(F.coalesce("channel_counts", empty).alias("channel_counts"))
    return out.select(*cols)


def _timeline_rows(events: DataFrame, channel: str | None, event_type: str | None) -> DataFrame:
    if channel:
        events = events.where(F.col("channel") == channel)
    if event_type:
        events = events.where(F.col("type") == event_type)
    return events.select("id", "event_id", "customer_id", "campaign_id", "channel", "type", "occurred_at", "payload")


def _with_campaign(page: DataFrame, campaigns: DataFrame) -> DataFrame:
    ext = campaigns.select(F.col("id").alias("campaign_id"), F.col("external_id").alias("campaign"))
    return page.join(ext, "campaign_id", "left")


def timeline(events: DataFrame, campaigns: DataFrame, customer_id: int | None = None, channel: str | None = None,
             event_type: str | None = None, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """One page of events, newest first; the campaign join sees the page only."""
    rows = _timeline_rows(events, channel, event_type)
    if customer_id is not None:
        rows = rows.where(F.col("customer_id") == customer_id)
    return _with_campaign(keyset_page(rows, TIMELINE_ORDER, cursor, limit), campaigns)


def timelines(events: DataFrame, campaigns: DataFrame, limit: int, channel: str | None = None,
              event_type: str | None = None, cursor: tuple | None = None) -> DataFrame:
    """The newest ``limit`` events of every customer.

    Spark limits each group before the shuffle, so a busy customer sends ``limit`` rows a task.
    """
    order = Window.partitionBy("customer_id").orderBy(F.col("occurred_at").desc(), F.col("id").desc())
    rows = after_cursor(_timeline_rows(events, channel, event_type), TIMELINE_ORDER, cursor)
    top = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return _with_campaign(top, campaigns)
