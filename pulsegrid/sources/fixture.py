"""Derives the domain tables from the generic star-schema and event tables.

The rules are the same expressions the SQL oracles use, so both engines start from equal
rows. Nothing here aggregates: every domain table is a projection of one given table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid import vocab as V
from pulsegrid.functions.scalars import as_ts

AS_OF = "2024-01-31 00:00:00"
N_CAMPAIGNS = 20


def pick(values: Sequence, index: Column) -> Column:
    """values[index mod len]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def as_of() -> Column:
    return as_ts(AS_OF)


_SCHEMAS: dict[str, StructType] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _padded(id_: Column, width: int) -> Column:
    """At least ``width`` digits. ``lpad`` alone cuts a longer number, so that two keys would share an external id."""
    text = id_.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def customer_ext(id_: Column) -> Column:
    return F.concat(F.lit("cust_"), _padded(id_, 5))


def campaign_ext(id_: Column) -> Column:
    return F.concat(F.lit("camp_"), _padded(id_, 3))


def event_ext(id_: Column) -> Column:
    return F.concat(F.lit("evt_"), _padded(id_, 9))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        customer_ext(key).alias("external_id"),
        F.concat(customer_ext(key), F.lit("@example.com")).alias("email"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias(
            "attributes"
        ),
        (key % 10 != 0).alias("is_active"),
        (F.lit("2023-10-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=(key % 60).cast("int"))).alias(
            "created_at"
        ),
        # A marker older than most events for some customers, newer for a few, absent for the rest.
        F.when(key % 4 == 0, F.lit("2023-12-15 00:00:00").cast("timestamp"))
        .when(key % 7 == 0, F.lit("2024-01-25 12:00:00").cast("timestamp"))
        .alias("last_event_at"),
    )


def campaigns(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(N_CAMPAIGNS).select(
        i,
        campaign_ext(i).alias("external_id"),
        F.concat(F.lit("Campaign "), i.cast("string")).alias("name"),
        pick(V.OBJECTIVES, i).alias("objective"),
        pick(V.CHANNELS, i + F.expr("id div 5")).alias("channel"),
        pick(V.CAMPAIGN_STATUSES, i).alias("status"),
        (i % 4 + 2).cast("int").alias("frequency_cap"),
        F.lit(168).alias("frequency_window_hours"),
        (F.lit("2023-11-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=i.cast("int"))).alias("started_at"),
        (F.lit("2023-11-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=i.cast("int"))).alias("created_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.col("props").alias("payload"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    i, k = F.col("id"), F.col("k")
    campaign = F.when(
        (k < 80) & ~((k % N_CAMPAIGNS == 5) & (F.col("occurred_at") >= as_ts("2024-01-28 00:00:00"))),
        k % N_CAMPAIGNS,
    )
    e = e.withColumn("campaign_id", campaign)
    c, r = F.col("campaign_id"), i % 100
    late = F.when(i % 101 == 0, F.lit(36 * 3600)).otherwise(i % 90).cast("int")
    failed = i % 311 == 0
    return e.select(
        i,
        event_ext(i).alias("event_id"),
        "customer_id",
        "campaign_id",
        # A third of a campaign's events are on a second channel.
        F.when(c.isNull(), pick(V.CHANNELS, i)).otherwise(
            pick(V.CHANNELS, c + F.expr("campaign_id div 5") + F.when(i % 3 == 0, 1).otherwise(0))).alias("channel"),
        F.when((c == 13) & (r >= 68) & (r < 80), "delivered")
        .when(r < 35, "sent").when(r < 68, "delivered").when(r < 82, "opened").when(r < 90, "clicked")
        .when(r < 94, "converted").when(r < 96, "bounced").when(r < 99, "unsubscribed").otherwise("complained")
        .alias("type"),
        "occurred_at",
        (F.col("occurred_at") + F.make_dt_interval(secs=late.cast("decimal(18,6)"))).alias("received_at"),
        "payload",
        F.when(failed, "failed").otherwise("processed").alias("status"),
        F.when(failed, V.MAX_ATTEMPTS).otherwise(0).alias("attempts"),
        F.when(failed, "profile update timed out").alias("last_error"),
        F.concat(F.lit("req-"), F.expr("id div 50").cast("string")).alias("request_id"),
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted items as strings, with planted defects and repeats."""
    e = events(spark, sf_dir)
    i = F.col("id")
    posted = e.select(
        F.expr("id div 50").alias("batch_id"),
        (i % 50).cast("int").alias("idx"),
        i.alias("src"),
        F.when(i % 37 == 0, "").otherwise(F.col("event_id")).alias("event_id"),
        F.when(i % 43 == 0, "").when(i % 29 == 0, "cust_none").otherwise(customer_ext(F.col("customer_id"))).alias(
            "customer_id"
        ),
        F.when(F.col("campaign_id").isNull(), "").when(i % 31 == 0, "camp_none").otherwise(
            campaign_ext(F.col("campaign_id"))
        ).alias("campaign_id"),
        F.when(i % 17 == 0, "carrier-pigeon").otherwise(F.col("channel")).alias("channel"),
        F.when(i % 19 == 0, "exploded").otherwise(F.col("type")).alias("type"),
        F.when(i % 23 == 0, "yesterday").when(i % 47 == 0, "").when(i % 41 == 0, "2027-01-01T00:00:00Z").otherwise(
            F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        ).alias("occurred_at"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        "request_id",
    )
    repeats = posted.where(F.col("src") % 13 == 0).withColumns(
        {"batch_id": F.col("batch_id") + F.col("src") % 2, "idx": F.col("idx") + 50}
    )
    return posted.unionByName(repeats)


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids an earlier load has already stored."""
    e = raw(spark, sf_dir, "events")
    return e.where(F.col("event_id") % 11 == 0).select(event_ext(F.col("event_id")).alias("event_id"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id"), F.col("props"),
    )
    i = F.col("id")
    routes = [*V.ACTIONS, ("DELETE", "/api/v1/things/:id"), ("GET", "")]
    route = pick([r for _, r in routes], i)
    return e.select(
        i,
        "created_at",
        F.concat(F.lit("req-"), F.expr("id div 50").cast("string")).alias("request_id"),
        pick([m for m, _ in routes], i).alias("method"),
        route.alias("route"),
        F.when(i % 53 == 0, "/app/index.html").when(route == "", "/api/v1/nope").otherwise(
            F.replace(route, F.lit(":id"), customer_ext(F.col("user_id")))
        ).alias("path"),
        F.when(i % 9 == 0, F.concat(F.lit("  q="), F.repeat(F.lit("x"), F.lit(700)))).otherwise(
            F.concat(F.lit("k="), F.col("props"))
        ).alias("query"),
        F.when(route.contains(":id"), customer_ext(F.col("user_id"))).otherwise("").alias("entity"),
        F.when(i % 40 == 0, 500).when(i % 40 == 1, 503).when(i % 40 < 5, 404).when(i % 40 < 8, 400).otherwise(200)
        .alias("status"),
        (i % 97).cast("int").alias("latency_ms"),
        F.concat(F.lit("10.0.0."), (i % 200).cast("string")).alias("client_ip"),
        F.when(i % 14 == 0, F.repeat(F.lit("agent "), F.lit(60))).otherwise("test-agent").alias("user_agent"),
        F.when(i % 5 == 0, "ok").otherwise("").alias("summary"),
        F.when(i % 40 == 1, "unavailable: postgres").otherwise("").alias("error"),
    )


def audience_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation: all (objective, channel) pairs with varied conditions."""
    n = F.col("n_nationkey").cast("long")
    return raw(spark, sf_dir, "nation").select(
        n.alias("request_id"),
        pick(V.OBJECTIVES, n).alias("objective"),
        pick(V.CHANNELS, F.floor(n / 5)).alias("channel"),
        (n % 7 * 4 + 3).cast("int").alias("size"),
        (n % 3 * 0.05).cast("double").alias("min_score"),
        (n % 4 * 7).cast("int").alias("last_active_days"),
        F.when(n % 5 == 1, F.array(F.lit("email"), F.lit("sms"))).when(
            n % 5 == 3, F.array(F.lit("push"), F.lit("web"), F.lit("whatsapp"))
        ).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.when(n % 6 == 2, F.array(F.lit("camp_003"), F.lit("camp_013"))).otherwise(
            F.array().cast("array<string>")
        ).alias("exclude_campaign_ids"),
        F.when(n % 4 == 1, F.lit(False)).when(n % 4 == 2, F.lit(True)).alias("respect_frequency_cap"),
    )


def audience_request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order, with planted defects, for validation and cap lookup."""
    o = F.col("o_orderkey")
    return raw(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.when(o % 11 == 0, "fame").otherwise(pick(V.OBJECTIVES, o)).alias("objective"),
        F.when(o % 13 == 0, "fax").otherwise(pick(V.CHANNELS, F.floor(o / 5))).alias("channel"),
        F.when(o % 17 == 0, F.lit(0)).when(o % 19 == 0, F.lit(100001)).otherwise((o % 900 + 1).cast("int")).alias(
            "size"
        ),
        F.when(o % 23 == 0, F.lit(-0.5)).otherwise((o % 10 / 10).cast("double")).alias("min_score"),
        F.when(o % 29 == 0, F.lit(-1)).otherwise((o % 30).cast("int")).alias("last_active_days"),
        F.when(o % 31 == 0, F.array(F.lit("email"), F.lit("pager"))).when(
            o % 3 == 0, F.array(F.lit("email"))
        ).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.array().cast("array<string>").alias("exclude_campaign_ids"),
        F.when(o % 4 == 1, F.lit(False)).when(o % 4 == 2, F.lit(True)).alias("respect_frequency_cap"),
    )


def prediction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation: platform, audience and customer scopes in turn."""
    n = F.col("n_nationkey").cast("long")
    return raw(spark, sf_dir, "nation").select(
        n.alias("request_id"),
        pick(V.OBJECTIVES, n).alias("objective"),
        F.when(n % 4 == 1, F.array(F.lit("sms"), F.lit("email"), F.lit("sms"))).when(
            n % 8 == 7, F.array(F.lit("web"))
        ).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.when(n % 3 == 2, customer_ext(n % 14)).otherwise("").alias("customer_id"),
        F.when(
            n % 3 == 1,
            F.struct((n % 5 * 0.04).cast("double").alias("min_score"), (n % 2 * 14).cast("int").alias("last_active_days")),
        ).alias("audience"),
        F.when(n % 2 == 0, F.lit(0)).otherwise((n % 20 + 5).cast("int")).alias("lookback_days"),
    )


def prediction_request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction request per order, with planted defects."""
    o = F.col("o_orderkey")
    return raw(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.when(o % 11 == 0, "fame").otherwise(pick(V.OBJECTIVES, o)).alias("objective"),
        F.when(o % 13 == 0, F.array(F.lit("fax"))).when(
            o % 5 == 1, F.array(F.lit("sms"), F.lit("web"), F.lit("sms"), F.lit("email"))
        ).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.when(o % 3 == 0, customer_ext(F.col("o_custkey"))).otherwise("").alias("customer_id"),
        F.when(
            o % 7 < 2,
            F.struct(
                F.when(o % 17 == 0, F.lit(1.0)).otherwise((o % 10 / 10).cast("double")).alias("min_score"),
                F.when(o % 19 == 0, F.lit(-3)).otherwise((o % 30).cast("int")).alias("last_active_days"),
            ),
        ).alias("audience"),
        F.when(o % 2 == 0, F.lit(0)).when(o % 23 == 0, F.lit(400)).when(o % 29 == 0, F.lit(-1)).otherwise(
            (o % 365 + 1).cast("int")
        ).alias("lookback_days"),
    )
