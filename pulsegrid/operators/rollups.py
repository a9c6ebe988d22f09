"""Tables derived from events by projection or a single partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import as_ts

DAILY_KEYS = ["campaign_id", "channel", "event_type", "day"]


def until(events: DataFrame, as_of) -> DataFrame:
    """Events at or before ``as_of``; no bound when it is None."""
    return events if as_of is None else events.where(F.col("occurred_at") <= as_ts(as_of))


def processed(events: DataFrame) -> DataFrame:
    return events.where(F.col("status") == "processed")


def derive_sends(events: DataFrame, as_of=None) -> DataFrame:
    """One row per processed send that belongs to a campaign."""
    return (
        processed(until(events, as_of))
        .where((F.col("type") == "sent") & F.col("campaign_id").isNotNull())
        .select("customer_id", "campaign_id", "channel", F.col("occurred_at").alias("sent_at"))
    )


def campaign_daily(events: DataFrame, as_of=None) -> DataFrame:
    """Event count per campaign, channel, type and UTC day; organic events have no campaign."""
    return (
        processed(until(events, as_of))
        .where(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id", "channel", F.col("type").alias("event_type"), F.to_date("occurred_at").alias("day"))
        .agg(F.count("*").alias("count"))
    )


def merge_daily(*parts: DataFrame) -> DataFrame:
    """Counts of several loads added up; increments commute, so order does not matter."""
    out = parts[0].select(*DAILY_KEYS, "count")
    for part in parts[1:]:
        out = out.unionByName(part.select(*DAILY_KEYS, "count"))
    return out.groupBy(*DAILY_KEYS).agg(F.sum("count").alias("count"))
