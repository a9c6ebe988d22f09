"""Engagement profiles as a two-level aggregate.

Level one, a *cell*, is one row per (customer, channel, type, block of 365 days). Cells add up:
counts are sums, the newest event is a maximum, and the decayed score is a plain sum, as every
cell of a block decays to the block's end. No sum is ever grown from a time long after it, where it
would have underflowed. A full rebuild, a micro-batch partial and the merge of partials
are therefore the same two aggregates. All cell measures are fixed-width, so Spark uses its
hash aggregate with map-side partials: one customer owning a third of all events costs each
map task at most 40 rows for each year in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators.rollups import until
from pulsegrid.sources.tables import from_day

CELL_KEYS = ["customer_id", "channel", "type"]

# The newest event as one comparable number: time, then the smaller id, then the type's index.
_EPOCH_SHIFT = 62135596800000000
_ID_SPAN = "10000000000000000000"
_MAX_ID = 9223372036854775807


def _recency(ts: Column, id_: Column, event_type: Column) -> Column:
    micros = (F.unix_micros(ts) + F.lit(_EPOCH_SHIFT)).cast("decimal(18,0)")
    order = (F.lit(_MAX_ID) - id_).cast("decimal(19,0)")
    code = S.lookup(event_type, {t: i for i, t in enumerate(V.EVENT_TYPES)}, F.lit(len(V.EVENT_TYPES)))
    return ((micros * F.lit(_ID_SPAN).cast("decimal(20,0)") + order).cast("decimal(37,0)") * F.lit(10).cast(
        "decimal(2,0)"
    ) + code).cast("decimal(38,0)")


def _recency_ts(key: Column) -> Column:
    span = F.lit(_ID_SPAN + "0").cast("decimal(21,0)")
    return F.timestamp_micros(F.call_function("div", key, span) - F.lit(_EPOCH_SHIFT))


def _recency_type(key: Column) -> Column:
    code = (key % F.lit(10).cast("decimal(2,0)")).cast("int")
    return F.get(F.array(*[F.lit(t) for t in V.EVENT_TYPES]), code)


def _in_trend(as_of: Column, first_day: int, last_day: int) -> Column:
    start = as_of - F.expr(f"INTERVAL '{first_day}' DAY")
    inside = S.is_positive(F.col("type")) & (F.col("occurred_at") >= start)
    if last_day:
        inside = inside & (F.col("occurred_at") < as_of - F.expr(f"INTERVAL '{last_day}' DAY"))
    return inside


def event_cells(events: DataFrame, as_of) -> DataFrame:
    """Processed events up to ``as_of`` folded into cells, with the trend counts beside them.

    ``raw`` is the decayed sum at ``raw_at``, the end of the cell's block. The trend counts ignore the status, the
    measures do not; a cell of failed events only has ``n`` = 0.
    """
    now = S.as_ts(as_of)
    done = F.col("status") == "processed"
    age = S.seconds_between(F.col("raw_at"), F.col("occurred_at"))
    return (
        until(events, as_of)
        .withColumn("raw_at", S.block_end(F.col("occurred_at")))
        .groupBy(*CELL_KEYS, "raw_at")
        .agg(
            F.count_if(done).alias("n"),
            F.coalesce(
                F.sum(F.when(done, S.event_weight(F.col("type")) * S.decay_factor(age))), F.lit(0.0)
            ).alias("raw"),
            F.max(F.when(done, _recency(F.col("occurred_at"), F.col("id"), F.col("type")))).alias("recency"),
            F.count_if(_in_trend(now, V.TREND_DAYS, 0)).alias("trend_current"),
            F.count_if(_in_trend(now, 2 * V.TREND_DAYS, V.TREND_DAYS)).alias("trend_prior"),
        )
    )


def profile_partials(events: DataFrame, as_of) -> DataFrame:
    """Cells of one load, without the trend: a trend window moves, so it cannot be merged."""
    return event_cells(events, as_of).where(F.col("n") > 0).drop("trend_current", "trend_prior")


def merge_cells(partials: DataFrame) -> DataFrame:
    """Add up cells of any number of loads, in any order."""
    return partials.groupBy(*CELL_KEYS, "raw_at").agg(
        F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.max("recency").alias("recency"))


def activity_trend(events: DataFrame, as_of) -> DataFrame:
    """Positive events of the last 7 days against the 7 days before, whatever their status."""
    now = S.as_ts(as_of)
    events = from_day(events, now - F.expr(f"INTERVAL '{2 * V.TREND_DAYS}' DAY"))
    recent = until(events, as_of).where(_in_trend(now, 2 * V.TREND_DAYS, 0))
    return (
        recent.groupBy("customer_id")
        .agg(
            F.count_if(_in_trend(now, V.TREND_DAYS, 0)).alias("trend_current"),
            F.count_if(_in_trend(now, 2 * V.TREND_DAYS, V.TREND_DAYS)).alias("trend_prior"),
        )
        .withColumn("activity_trend", S.trend_label(F.col("trend_current"), F.col("trend_prior")))
    )


def _sum_where(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0))


def _preferred(counts: dict[str, Column]) -> Column:
    """Channel with the most positive events; the alphabet decides ties, none gives NULL."""
    best = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for channel in sorted(counts, reverse=True):
        out = F.when((best > 0) & (counts[channel] == best), channel).otherwise(out)
    return out


def profiles_from_cells(cells: DataFrame, as_of, trend: DataFrame | None = None) -> DataFrame:
    """One profile row per customer with at least one processed event."""
    typ, ch = F.col("type"), F.col("channel")
    inline = "trend_current" in cells.columns
    sums = [
        F.sum("n").alias("total_events"),
        _sum_where(S.is_positive(typ)).alias("positive_events"),
        _sum_where(S.is_negative(typ)).alias("negative_events"),
        _sum_where(typ == "converted").alias("conversions"),
        *[_sum_where(S.is_positive(typ) & (ch == c)).alias(f"_pos_{c}") for c in V.CHANNELS],
        F.sum(S.moved_raw(F.col("raw"), F.col("raw_at"), _recency_ts(F.col("_newest")))).alias("_raw"),
        F.max("recency").alias("_recency"),
    ]
    if inline:
        sums += [F.sum("trend_current").alias("_cur"), F.sum("trend_prior").alias("_prior")]
    # Every cell moves once, from its block's end to the customer's newest event.
    newest = F.max("recency").over(Window.partitionBy("customer_id"))
    agg = cells.withColumn("_newest", newest).groupBy("customer_id").agg(*sums).where(F.col("total_events") > 0)
    if inline:
        agg = agg.withColumn("activity_trend", S.trend_label(F.col("_cur"), F.col("_prior")))
    elif trend is not None:
        agg = agg.join(trend.select("customer_id", "activity_trend"), "customer_id", "left").fillna(
            {"activity_trend": "stable"}
        )
    else:
        agg = agg.withColumn("activity_trend", F.lit("stable"))
    last = _recency_ts(F.col("_recency"))
    return agg.select(
        "customer_id", "total_events", "positive_events", "negative_events", "conversions",
        last.alias("last_event_at"),
        _recency_type(F.col("_recency")).alias("last_event_type"),
        F.col("_raw").alias("engagement_score"),
        last.alias("score_updated_at"),
        "activity_trend",
        _preferred({c: F.col(f"_pos_{c}") for c in V.CHANNELS}).alias("preferred_channel"),
    )


def build_profiles(events: DataFrame, as_of) -> DataFrame:
    """Full rebuild from events: one scan, the trend counted in the same pass."""
    return profiles_from_cells(event_cells(events, as_of), as_of)


def merge_profiles(old: DataFrame, new: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Profiles from stored cells and the cells of a later load."""
    cells = merge_cells(old.unionByName(new))
    return profiles_from_cells(cells, as_of, activity_trend(events, as_of))


def profile_counters(events: DataFrame, as_of) -> DataFrame:
    typ = F.col("type")
    return (
        until(events, as_of).where(F.col("status") == "processed")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(S.is_positive(typ)).alias("positive_events"),
            F.count_if(S.is_negative(typ)).alias("negative_events"),
            F.count_if(typ == "converted").alias("conversions"),
        )
    )


def channel_counts(events: DataFrame, as_of) -> DataFrame:
    """Long form of the nested counters: one row per customer, channel and type."""
    return (
        until(events, as_of).where(F.col("status") == "processed")
        .groupBy(*CELL_KEYS).agg(F.count("*").alias("n"))
    )


def channel_count_maps(counts: DataFrame) -> DataFrame:
    """The same counters nested as channel -> type -> n; at most 5 x 8 entries a customer."""
    entry = F.struct(F.col("type"), F.col("n"))
    inner = counts.groupBy("customer_id", "channel").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return inner.groupBy("customer_id").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "m"))).alias("channel_counts")
    )


def last_event(events: DataFrame, as_of) -> DataFrame:
    """Newest processed event of each customer; the smaller id keeps a tie."""
    return (
        until(events, as_of).where(F.col("status") == "processed")
        .groupBy("customer_id")
        .agg(F.max(_recency(F.col("occurred_at"), F.col("id"), F.col("type"))).alias("_r"))
        .select(
            "customer_id",
            _recency_ts(F.col("_r")).alias("last_event_at"),
            _recency_type(F.col("_r")).alias("last_event_type"),
        )
    )


def decayed_score(events: DataFrame, as_of, anchor: str = "last") -> DataFrame:
    """Sum of weights, each halved every 14 days, at the last event or at ``as_of``.

    Summed by blocks of 365 days, each at its end, and moved once. Not clamped: clamping would depend
    on arrival order.
    """
    age = S.seconds_between(F.col("raw_at"), F.col("occurred_at"))
    blocks = (
        until(events, as_of).where(F.col("status") == "processed")
        .withColumn("raw_at", S.block_end(F.col("occurred_at"))).groupBy("customer_id", "raw_at")
        .agg(
            F.sum(S.event_weight(F.col("type")) * S.decay_factor(age)).alias("raw"),
            F.max("occurred_at").alias("last"),
        )
    )
    newest = F.max("last").over(Window.partitionBy("customer_id"))
    to = S.as_ts(as_of) if anchor == "as_of" else newest
    return blocks.withColumn("anchor", to).groupBy("customer_id").agg(
        F.sum(S.moved_raw(F.col("raw"), F.col("raw_at"), F.col("anchor"))).alias("raw"), F.max("anchor").alias("anchor"))


def preferred_channel(counts: DataFrame) -> DataFrame:
    """From the long counters: one row per customer, NULL without positive events."""
    pos = {
        c: F.sum(F.when((F.col("channel") == c) & S.is_positive(F.col("type")), F.col("n")).otherwise(0))
        for c in V.CHANNELS
    }
    agg = counts.groupBy("customer_id").agg(*[v.alias(c) for c, v in pos.items()])
    return agg.select("customer_id", _preferred({c: F.col(c) for c in V.CHANNELS}).alias("preferred_channel"))


def customer_last_event(customers: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Customers with the recency marker moved forward, never back; NULL gives way."""
    latest = (
        until(events, as_of).where(F.col("status") == "processed")
        .groupBy(F.col("customer_id").alias("id")).agg(F.max("occurred_at").alias("_new"))
    )
    return (
        customers.join(latest, "id", "left")
        .withColumn("last_event_at", F.greatest("last_event_at", "_new"))
        .drop("_new")
    )


def reanchor(profiles: DataFrame, as_of) -> DataFrame:
    """Stored scores decayed to ``as_of``; an anchor never moves back."""
    now = S.as_ts(as_of)
    return profiles.withColumns({
        "engagement_score": S.decay_raw(F.col("engagement_score"), F.col("score_updated_at"), now),
        "score_updated_at": F.greatest(F.col("score_updated_at"), now),
    })


def refresh_scores(profiles: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Stored profiles re-anchored at ``as_of`` with trend and preferred channel recomputed."""
    trend = activity_trend(events, as_of).select("customer_id", F.col("activity_trend").alias("_trend"))
    chan = preferred_channel(channel_counts(events, as_of)).select(
        "customer_id", F.col("preferred_channel").alias("_chan")
    )
    return (
        reanchor(profiles, as_of).join(trend, "customer_id", "left").join(chan, "customer_id", "left")
        .withColumns({
            "activity_trend": F.coalesce("_trend", F.lit("stable")),
            "preferred_channel": F.col("_chan"),
        })
        .drop("_trend", "_chan")
    )
