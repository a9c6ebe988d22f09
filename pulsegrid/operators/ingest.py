"""Posted items to accepted events: parse, validate, resolve, deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S

FIELDS = ("event_id", "customer_id", "campaign_id", "channel", "type", "occurred_at")
MALFORMED_ITEM = "malformed event object"

_DATE_TIME = r"\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}"
RFC3339 = rf"^{_DATE_TIME}(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))$"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def parse_items(items: DataFrame) -> DataFrame:
    """Raw items to string columns; a wrong JSON type makes the whole item malformed.

    JSON null and an absent field both read as an empty string, so a null item goes on and
    fails for its missing event_id.
    """
    item = F.col("item")
    kind = _kind(item)
    ok = kind.startswith("OBJECT") | (kind == "VOID")
    for f in FIELDS:
        ok = ok & _kind(F.try_variant_get(item, f"$.{f}", "variant")).isin("STRING", "VOID")
    payload = F.try_variant_get(item, "$.payload", "variant")
    return items.select(
        *[c for c in items.columns if c != "item"],
        *[F.coalesce(F.when(ok, F.try_variant_get(item, f"$.{f}", "string")), F.lit("")).alias(f) for f in FIELDS],
        F.coalesce(F.to_json(payload), F.when(F.schema_of_variant(payload) == "VOID", "null"), F.lit("")).alias("payload"),
        (~ok).alias("malformed"),
    )


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, else NULL. The cast alone would take dates and words."""
    local = F.regexp_replace(F.regexp_extract(text, rf"^({_DATE_TIME})", 1), "T", " ")
    micros = F.rpad(F.substring(F.regexp_extract(text, r"[.,](\d+)", 1), 1, 6), 6, "0").cast("long")
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(text, r"[+-](\d{2}):\d{2}$", 1)
    minutes = F.regexp_extract(text, r"[+-]\d{2}:(\d{2})$", 1)
    offset = F.when(text.endswith("Z") | (hours == ""), F.lit(0).cast("long")).otherwise(
        sign * (hours.try_cast("long") * 3600 + minutes.try_cast("long") * 60)
    )
    base = F.unix_micros(F.concat(local, F.lit("Z")).try_cast("timestamp"))
    return F.when(text.rlike(RFC3339), F.timestamp_micros(base + micros - offset * 1000000))


def validate_events(items: DataFrame, as_of) -> DataFrame:
    """Adds ``occurred`` and ``reject_reason``, the first rule an item breaks."""
    now = S.as_ts(as_of)
    malformed = F.col("malformed") if "malformed" in items.columns else F.lit(False)
    return items.withColumn("occurred", parse_rfc3339(F.col("occurred_at"))).withColumn(
        "reject_reason",
        F.when(malformed, MALFORMED_ITEM)
        .when(F.col("event_id") == "", "event_id is required")
        .when(F.col("customer_id") == "", "customer_id is required")
        .when(~F.col("channel").isin(*V.CHANNELS), "invalid channel")
        .when(~F.col("type").isin(*V.EVENT_TYPES), "invalid type")
        .when(F.col("occurred_at") == "", "occurred_at is required")
        .when(F.col("occurred").isNull(), "occurred_at must be RFC3339")
        .when(F.col("occurred") > now, "occurred_at is in the future"),
    )


def resolve_dimensions(items: DataFrame, customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Adds internal ids; an unknown customer rejects first, then an unknown campaign.

    Rejected items do not take part in the joins. Both joins carry no broadcast hint: Spark
    broadcasts a small dimension by its size, and splits a hot customer's partition if not.
    """
    open_ = F.col("reject_reason").isNull()
    attributed = F.col("campaign_id") != ""
    cust = customers.select(F.col("external_id").alias("_cu"), F.col("id").alias("customer_key"))
    camp = campaigns.select(F.col("external_id").alias("_ca"), F.col("id").alias("campaign_key"))
    # Rows without a key get one of their own that matches nothing; NULLs would share a partition.
    lone = F.concat(F.lit("\u0000"), F.xxhash64("batch_id", "idx").cast("string"))
    out = items.withColumns({
        "_cu": F.when(open_, F.col("customer_id")).otherwise(lone),
        "_ca": F.when(open_ & attributed, F.col("campaign_id")).otherwise(lone),
    })
    out = out.join(cust, "_cu", "left").join(camp, "_ca", "left")
    reason = F.coalesce(
        "reject_reason",
        F.when(F.col("customer_key").isNull(), "unknown customer_id"),
        F.when(attributed & F.col("campaign_key").isNull(), "unknown campaign_id"),
    )
    return out.withColumns({
        "reject_reason": reason,
        "payload": F.when(F.col("payload") == "", "{}").otherwise(F.col("payload")),
    }).drop("_cu", "_ca")


def _position(batch: Column, idx: Column) -> Column:
    """Input order as one fixed-width number, so that its minimum needs no sort."""
    return (batch.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + idx).cast("decimal(38,0)")


def dedup_events(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``outcome``: rejected, accepted or duplicate.

    The first open occurrence in input order claims an id that is not stored yet. The claim
    is a partial minimum per id, and goes back to the rows by id and position, so an id repeated in a
    third of all rows lands on no single task and no row is doubled. A position is (batch_id, idx),
    or (post_id, idx) where items have a ``post_id``: needed where two bodies can share a batch_id.
    """
    pos = _position(F.col("post_id" if "post_id" in items.columns else "batch_id"), F.col("idx"))
    open_ = items.where(F.col("reject_reason").isNull())
    claims = (
        open_.groupBy("event_id").agg(F.min(pos).alias("_pos"))
        .join(stored.select("event_id"), "event_id", "left_anti")
        .select(F.col("event_id").alias("_id"), F.col("_pos").alias("_at"), F.lit(True).alias("_claimed"))
    )
    rows = items.withColumn("_pos", pos)
    return (
        rows.join(claims, (rows["_pos"] == claims["_at"]) & (rows["event_id"] == claims["_id"]), "left")
        .withColumn("outcome", F.when(F.col("reject_reason").isNotNull(), "rejected")
                    .when(F.col("_claimed"), "accepted").otherwise("duplicate"))
        .drop("_pos", "_at", "_id", "_claimed")
    )


def accepted_events(outcomes: DataFrame, received_at, *keep: str) -> DataFrame:
    """Accepted items as pending rows of the events table; ``keep`` names columns to carry along."""
    extra = [*keep, *[c for c in ("request_id",) if c in outcomes.columns]]
    return outcomes.where(F.col("outcome") == "accepted").select(
        "event_id", F.col("customer_key").alias("customer_id"), F.col("campaign_key").alias("campaign_id"), "channel",
        "type", F.col("occurred").alias("occurred_at"), S.as_ts(received_at).alias("received_at"), "payload",
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"), *extra,
    )


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Per batch: how many items were accepted, duplicates and rejected."""
    return outcomes.groupBy("batch_id").agg(*[
        F.count_if(F.col("outcome") == outcome).alias(name)
        for outcome, name in (("accepted", "accepted"), ("duplicate", "duplicates"), ("rejected", "rejected"))
    ])


def rejected_items(outcomes: DataFrame) -> DataFrame:
    """The rejected items of all batches, one row each: batch_id, index, reason."""
    return outcomes.where(F.col("outcome") == "rejected").select(
        "batch_id", F.col("idx").alias("index"), F.col("reject_reason").alias("reason"))


def ingest(items: DataFrame, customers: DataFrame, campaigns: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """Parsed items to outcomes."""
    return dedup_events(resolve_dimensions(validate_events(items, as_of), customers, campaigns), stored)
