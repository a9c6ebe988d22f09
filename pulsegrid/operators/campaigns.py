"""Campaign analytics over the daily rollup; nothing here reads raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators.paging import page_limit

# Counter name of each event type.
COUNTERS = {
    "sends": "sent", "delivered": "delivered", "opens": "opened", "clicks": "clicked",
    "conversions": "converted", "bounces": "bounced", "unsubscribes": "unsubscribed",
    "complained": "complained",
}
RATES = {"open_rate": "opens", "click_rate": "clicks", "conversion_rate": "conversions"}


def _until_day(daily: DataFrame, as_of) -> DataFrame:
    return daily if as_of is None else daily.where(F.col("day") <= F.to_date(S.as_ts(as_of)))


def counter_sums() -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("count"))), F.lit(0).cast("long")).alias(name)
        for name, t in COUNTERS.items()
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({r: S.rate(F.col(n), F.col("delivered")) for r, n in RATES.items()})


def campaign_metrics(campaigns: DataFrame, daily: DataFrame) -> DataFrame:
    """Counters and rates per campaign; no events reads as zeros."""
    m = (
        daily.groupBy("campaign_id")
        .agg(*counter_sums(), F.min("day").alias("first_event_day"), F.max("day").alias("last_event_day"))
    )
    out = campaigns.select(F.col("id").alias("campaign_id")).join(m, "campaign_id", "left")
    out = out.fillna(0, list(COUNTERS))
    return _with_rates(out).drop("complained")


def campaign_channel_metrics(daily: DataFrame) -> DataFrame:
    """The same counters per campaign and channel, complaints included."""
    return _with_rates(daily.groupBy("campaign_id", "channel").agg(*counter_sums()))


def by_channel(channel_metrics: DataFrame) -> DataFrame:
    """Channel metrics nested as one map per campaign; at most five entries."""
    value = F.struct(*COUNTERS, *RATES)
    return channel_metrics.groupBy("campaign_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", value.alias("m"))))).alias("by_channel")
    )


def first_last_event(daily: DataFrame) -> DataFrame:
    return daily.groupBy("campaign_id").agg(
        F.min("day").alias("first_event_day"), F.max("day").alias("last_event_day")
    )


def platform_baseline(daily: DataFrame) -> DataFrame:
    """One row: pooled rates over everything attributed to a campaign."""
    totals = _with_rates(daily.agg(*counter_sums()))
    return totals.select(*RATES)


def list_campaigns(campaigns: DataFrame, daily: DataFrame, status: str | None = None, channel: str | None = None,
                   after: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of campaign summaries by id; all campaigns are aggregated, then paged."""
    if status and status not in V.CAMPAIGN_STATUSES:
        raise ValueError("invalid status filter")
    if channel and channel not in V.CHANNELS:
        raise ValueError("invalid channel filter")
    rows = campaigns
    if status:
        rows = rows.where(F.col("status") == status)
    if channel:
        rows = rows.where(F.col("channel") == channel)
    if after is not None:
        rows = rows.where(F.col("id") > after)
    n = page_limit(limit)
    page = rows.orderBy("id").limit(n + 1)
    whole = Window.partitionBy(F.lit(1))
    page = page.withColumns({
        "_pos": F.row_number().over(whole.orderBy("id")), "has_more": F.count("*").over(whole) > n,
    }).where(F.col("_pos") <= n)
    sums = daily.groupBy(F.col("campaign_id").alias("id")).agg(*counter_sums())
    out = _with_rates(page.join(sums, "id", "left").fillna(0, list(COUNTERS)))
    return out.select(
        "id", "external_id", "name", "objective", "channel", "status", "started_at",
        "sends", "open_rate", "conversion_rate", "has_more",
    )


def daily_conversions(daily: DataFrame) -> DataFrame:
    """Conversions per campaign and day; days without any have no row."""
    return (
        daily.where(F.col("event_type") == "converted")
        .groupBy("campaign_id", "day").agg(F.sum("count").alias("n"))
    )


def delivered_recent(campaigns: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """Deliveries since two calendar days before ``as_of``, zero when none."""
    since = F.date_sub(F.to_date(S.as_ts(as_of)), 2)
    recent = (
        daily.where((F.col("event_type") == "delivered") & (F.col("day") >= since))
        .groupBy("campaign_id").agg(F.sum("count").alias("delivered_recent"))
    )
    return (
        campaigns.select(F.col("id").alias("campaign_id")).join(recent, "campaign_id", "left")
        .fillna(0, ["delivered_recent"])
    )


def anomaly_open_rate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Campaigns opening at less than half of the platform rate; text or NULL."""
    return (
        metrics.withColumn("_base", baseline.select("open_rate").scalar())
        .select("campaign_id", _low_opens(F.col("_base")).alias("anomaly"))
    )


def _low_opens(base: Column) -> Column:
    own = F.col("open_rate")
    hit = (F.col("delivered") > 0) & (base > 0) & (own < 0.5 * base)
    text = F.concat(
        F.lit("open_rate "), S.fixed(own * 100, 0), F.lit("% vs platform avg "), S.fixed(base * 100, 0),
        F.lit("% ("), S.signed_pct0((own - base) / F.when(base > 0, base)), F.lit(")"),
    )
    return F.when(hit, text)


def anomaly_conversion_spike(conversions: DataFrame) -> DataFrame:
    """Last day against mean + 3 population deviations of the days before; needs three days."""
    days = Window.partitionBy("campaign_id")
    marked = conversions.withColumn("_last", F.max("day").over(days))
    stats = marked.groupBy("campaign_id").agg(
        F.count("*").alias("days"),
        F.max("_last").alias("last_day"),
        F.max(F.when(F.col("day") == F.col("_last"), F.col("n"))).alias("last_n"),
        *_prior_sums(F.when(F.col("day") < F.col("_last"), F.col("n"))),
    )
    return stats.select("campaign_id", _spike().alias("anomaly"))


def _prior_sums(n: Column) -> list[Column]:
    """Whole-number sums of the days before. A deviation in doubles depends on the order of its rows, and so
    would the answer for a last day exactly on the limit."""
    whole = n.cast("decimal(18,0)")
    return [F.count(n).alias("prior"), F.sum(whole).alias("total"), F.sum(whole * whole).alias("squares")]


def _spike() -> Column:
    c, total = F.col("prior").cast("decimal(10,0)"), F.col("total")
    # c times the distance from the mean, and c squared times the variance.
    above, spread = F.col("last_n").cast("decimal(18,0)") * c - total, c * F.col("squares") - total * total
    c_or_null = F.nullif(F.col("prior"), F.lit(0)).cast("double")
    mean, sd = total.cast("double") / c_or_null, F.sqrt(spread.cast("double")) / c_or_null
    text = F.concat(
        F.lit("conversions spiked: "), F.col("last_n").cast("string"), F.lit(" on "),
        F.col("last_day").cast("string"), F.lit(" vs mean "), S.fixed(mean, 1),
        F.lit("/day (σ="), S.fixed(sd, 1), F.lit(", >3σ)"),
    )
    return F.when((F.col("days") >= 3) & (above > 0) & (above * above > 9 * spread), text)


def anomaly_bounce_rate(metrics: DataFrame) -> DataFrame:
    return metrics.select("campaign_id", _high_bounces().alias("anomaly"))


def _high_bounces() -> Column:
    share = S.rate(F.col("bounces"), F.col("sends"))
    text = F.concat(
        F.lit("bounce_rate "), S.fixed(share * 100, 1), F.lit("% exceeds 5% threshold ("),
        F.col("bounces").cast("string"), F.lit(" bounces / "), F.col("sends").cast("string"), F.lit(" sends)"),
    )
    return F.when(share > 0.05, text)


def anomaly_silent_active(campaigns: DataFrame, recent: DataFrame) -> DataFrame:
    return (
        campaigns.select(F.col("id").alias("campaign_id"), "status").join(recent, "campaign_id")
        .select("campaign_id", _silent().alias("anomaly"))
    )


def _silent() -> Column:
    hit = (F.col("status") == "active") & (F.col("delivered_recent") == 0)
    return F.when(hit, "zero delivered events in last 48h on active campaign")


def _grouped(daily: DataFrame, as_of) -> DataFrame:
    """Counters per campaign, per (campaign, channel) and per (campaign, day) in one pass; ``part`` names the grouping."""
    since = F.date_sub(F.to_date(S.as_ts(as_of)), 2)
    recent = F.sum(F.when((F.col("event_type") == "delivered") & (F.col("day") >= since), F.col("count")).otherwise(0))
    converted = F.sum(F.when(F.col("event_type") == "converted", F.col("count")))
    whole, channel, day = [F.col("campaign_id")], [F.col("campaign_id"), F.col("channel")], [F.col("campaign_id"), F.col("day")]
    return daily.withColumn("_day", F.col("day")).groupingSets([whole, channel, day], *channel, F.col("day")).agg(
        *counter_sums(), F.min("_day").alias("first_event_day"), F.max("_day").alias("last_event_day"), recent.alias("delivered_recent"),
        converted.alias("n"), F.grouping_id("campaign_id", "channel", "day").alias("part"))


def campaign_analytics(campaigns: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """Metrics, channels, platform baseline and anomalies of every campaign in rule order.

    Everything but the baseline comes from one grouping pass over ``daily``; its rows, a few for each campaign, are
    put together by campaign.
    """
    daily = _until_day(daily, as_of)
    baseline = platform_baseline(daily)
    rows = _with_rates(_grouped(daily, as_of))
    # Bits of the columns that a grouping leaves out: day 1, channel 2.
    whole, channel, day = F.col("part") == 3, F.col("part") == 1, F.col("part") == 2
    totals = (*COUNTERS, "first_event_day", "last_event_day", "delivered_recent")
    converted = day & F.col("n").isNotNull()
    last = F.max(F.when(converted, F.col("day"))).over(Window.partitionBy("campaign_id"))
    prior = F.when(converted & (F.col("day") < F.col("_last")), F.col("n"))
    per = rows.withColumn("_last", last).groupBy("campaign_id").agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in totals],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(channel, F.struct("channel", F.struct(*COUNTERS, *RATES).alias("m")))))).alias("by_channel"),
        F.count(F.when(converted, 1)).alias("days"), F.max("_last").alias("last_day"),
        F.max(F.when(converted & (F.col("day") == F.col("_last")), F.col("n"))).alias("last_n"),
        *_prior_sums(prior),
    )
    out = campaigns.select(F.col("id").alias("campaign_id"), "status").join(per, "campaign_id", "left").fillna(
        0, [*COUNTERS, "delivered_recent"])
    out = _with_rates(out).withColumn("_b", baseline.select(F.struct(*RATES)).scalar())
    out = out.withColumn("anomalies", F.array_compact(F.array(
        _low_opens(F.col("_b.open_rate")), _spike(), _high_bounces(), _silent())))
    shown = ["campaign_id", *[c for c in COUNTERS if c != "complained"], "first_event_day", "last_event_day", *RATES]
    return out.select(*shown, "by_channel", *[F.col(f"_b.{r}").alias(f"platform_{r}") for r in RATES], "anomalies")
