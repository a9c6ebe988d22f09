"""Queries and oracles: campaign analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import campaigns as K
from pulsegrid.plans.base import AS_OF, EVD, Tables, flat, sql


def k1_list_campaigns(spark, sf):
    t = Tables(spark, sf)
    return flat(K.list_campaigns(t.campaigns, t.daily, status="active", after=1, limit=3))


def k1_list_campaigns_all(spark, sf):
    t = Tables(spark, sf)
    return flat(K.list_campaigns(t.campaigns, t.daily))


def k2_campaign_metrics(spark, sf):
    t = Tables(spark, sf)
    return flat(K.campaign_metrics(t.campaigns, t.daily))


def k3_campaign_channel_metrics(spark, sf):
    return flat(K.campaign_channel_metrics(Tables(spark, sf).daily))


def k4_first_last_event(spark, sf):
    return flat(K.first_last_event(Tables(spark, sf).daily))


def k5_platform_baseline(spark, sf):
    return flat(K.platform_baseline(Tables(spark, sf).daily))


def k6_daily_conversions(spark, sf):
    return flat(K.daily_conversions(Tables(spark, sf).daily))


def k7_delivered_recent(spark, sf):
    t = Tables(spark, sf)
    return flat(K.delivered_recent(t.campaigns, t.daily, AS_OF))


def k8_anomaly_open_rate(spark, sf):
    t = Tables(spark, sf)
    return flat(K.anomaly_open_rate(K.campaign_metrics(t.campaigns, t.daily), K.platform_baseline(t.daily)))


def k9_anomaly_conversion_spike(spark, sf):
    return flat(K.anomaly_conversion_spike(K.daily_conversions(Tables(spark, sf).daily)))


def k9_spike_by_customer(spark, sf):
    """The same rule with customers in the place of campaigns, so that it fires on this data."""
    e = Tables(spark, sf).events.where(F.col("type") == "delivered")
    days = e.groupBy(F.col("customer_id").alias("campaign_id"), F.to_date("occurred_at").alias("day")).agg(
        F.count("*").alias("n")
    )
    return flat(K.anomaly_conversion_spike(days))


def k10_anomaly_bounce_rate(spark, sf):
    t = Tables(spark, sf)
    return flat(K.anomaly_bounce_rate(K.campaign_metrics(t.campaigns, t.daily)))


def k11_anomaly_silent_active(spark, sf):
    t = Tables(spark, sf)
    return flat(K.anomaly_silent_active(t.campaigns, K.delivered_recent(t.campaigns, t.daily, AS_OF)))


def k12_campaign_analytics(spark, sf):
    t = Tables(spark, sf)
    out = K.campaign_analytics(t.campaigns, t.daily, AS_OF)
    channels = F.transform(
        F.array_sort(F.map_entries("by_channel")),
        lambda e: F.concat_ws(":", e["key"], e["value"]["sends"], e["value"]["delivered"], e["value"]["complained"]),
    )
    return flat(out.withColumn("by_channel", channels))


QUERIES = {
    f.__name__: f
    for f in (
        k1_list_campaigns, k1_list_campaigns_all, k2_campaign_metrics, k3_campaign_channel_metrics,
        k4_first_last_event, k5_platform_baseline, k6_daily_conversions, k7_delivered_recent, k8_anomaly_open_rate,
        k9_anomaly_conversion_spike, k9_spike_by_customer, k10_anomaly_bounce_rate, k11_anomaly_silent_active,
        k12_campaign_analytics,
    )
}


def _n(event_type: str) -> str:
    return f"coalesce(sum(n) FILTER (type = '{event_type}'), 0)::BIGINT"


def _r(event_type: str) -> str:
    return f"""round(CASE WHEN {_n('delivered')} > 0 THEN {_n(event_type)}::DOUBLE / {_n('delivered')}
      ELSE 0 END, 6) + 0.0"""


_COUNTS = f"""{_n('sent')} AS sends, {_n('delivered')} AS delivered, {_n('opened')} AS opens, {_n('clicked')} AS clicks,
  {_n('converted')} AS conversions, {_n('bounced')} AS bounces, {_n('unsubscribed')} AS unsubscribes"""
_RATES = f"""{_r('opened')} AS open_rate, {_r('clicked')} AS click_rate, {_r('converted')} AS conversion_rate"""

# Metrics with unrounded rates, for the rules.
METRICS = f"""
met AS (
  SELECT ca.id AS campaign_id, {_COUNTS}, min(day) AS first_day, max(day) AS last_day,
    CASE WHEN {_n('delivered')} > 0 THEN {_n('opened')}::DOUBLE / {_n('delivered')} ELSE 0 END AS open_rate,
    CASE WHEN {_n('delivered')} > 0 THEN {_n('clicked')}::DOUBLE / {_n('delivered')} ELSE 0 END AS click_rate,
    CASE WHEN {_n('delivered')} > 0 THEN {_n('converted')}::DOUBLE / {_n('delivered')} ELSE 0 END AS conversion_rate
  FROM ca LEFT JOIN daily ON campaign_id = ca.id GROUP BY 1),
base AS (
  SELECT sum(n) FILTER (type = 'opened')::DOUBLE / sum(n) FILTER (type = 'delivered') AS bo,
    sum(n) FILTER (type = 'clicked')::DOUBLE / sum(n) FILTER (type = 'delivered') AS bc,
    sum(n) FILTER (type = 'converted')::DOUBLE / sum(n) FILTER (type = 'delivered') AS bv
  FROM daily)"""

_OPEN_TEXT = """CASE WHEN delivered > 0 AND bo > 0 AND open_rate < 0.5 * bo THEN
  printf('open_rate %.0f%% vs platform avg %.0f%% (%+.0f%%)', open_rate * 100, bo * 100, (open_rate - bo) / bo * 100)
  END"""
_BOUNCE_TEXT = """CASE WHEN sends > 0 AND bounces::DOUBLE / sends > 0.05 THEN
  printf('bounce_rate %.1f%% exceeds 5%% threshold (%d bounces / %d sends)', bounces::DOUBLE / sends * 100, bounces,
    sends) END"""
_SILENT_TEXT = """CASE WHEN status = 'active' AND recent = 0
  THEN 'zero delivered events in last 48h on active campaign' END"""


def _spike(source: str) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY day DESC) AS back FROM {source}),
spike AS (
  SELECT campaign_id, count(*) AS days, max(n) FILTER (back = 1) AS last_n, max(day) AS last_day,
    avg(n) FILTER (back > 1) AS mean, stddev_pop(n) FILTER (back > 1) AS sd
  FROM ranked GROUP BY 1),
spiked AS (
  SELECT campaign_id, CASE WHEN days >= 3 AND last_n > mean + 3 * sd THEN
    printf('conversions spiked: %d on %s vs mean %.1f/day (σ=%.1f, >3σ)', last_n, last_day::VARCHAR, mean, sd)
    END AS text
  FROM spike)"""


_CONV = """
conv AS (SELECT campaign_id, day, sum(n)::BIGINT AS n FROM daily WHERE type = 'converted' GROUP BY ALL)"""
_RECENT = """
rec AS (
  SELECT ca.id AS campaign_id, status, coalesce(sum(n) FILTER (type = 'delivered' AND day >= DATE '2024-01-29'), 0)::BIGINT
    AS recent
  FROM ca LEFT JOIN daily ON campaign_id = ca.id GROUP BY 1, 2)"""

_LIST = f"""SELECT ca.id, ext AS external_id, name, objective, ca.channel, status, epoch_us(created_at) AS started_at,
  {_n('sent')} AS sends, {_r('opened')} AS open_rate, {_r('converted')} AS conversion_rate"""

ORACLES = {
    "k1_list_campaigns": sql(
        f"""SELECT * FROM ({_LIST}, (count(*) OVER () > 3)::BIGINT AS has_more
        FROM ca LEFT JOIN daily ON campaign_id = ca.id WHERE status = 'active' AND ca.id > 1
        GROUP BY ca.id, ext, name, objective, ca.channel, status, created_at) ORDER BY id LIMIT 3""", *EVD),
    "k1_list_campaigns_all": sql(
        f"""{_LIST}, 0::BIGINT AS has_more
        FROM ca LEFT JOIN daily ON campaign_id = ca.id
        GROUP BY ca.id, ext, name, objective, ca.channel, status, created_at""", *EVD),
    "k2_campaign_metrics": sql(
        f"""SELECT ca.id AS campaign_id, {_COUNTS}, {_RATES}, coalesce(min(day)::VARCHAR, '') AS first_event_day,
          coalesce(max(day)::VARCHAR, '') AS last_event_day
        FROM ca LEFT JOIN daily ON campaign_id = ca.id GROUP BY 1""", *EVD),
    "k3_campaign_channel_metrics": sql(
        f"""SELECT campaign_id, channel, {_COUNTS}, {_n('complained')} AS complained, {_RATES}
        FROM daily GROUP BY 1, 2""", *EVD),
    "k4_first_last_event": sql(
        """SELECT campaign_id, min(day)::VARCHAR AS first_event_day, max(day)::VARCHAR AS last_event_day
        FROM daily GROUP BY 1""", *EVD),
    "k5_platform_baseline": sql(f"SELECT {_RATES} FROM daily", *EVD),
    "k6_daily_conversions": sql("SELECT campaign_id, day::VARCHAR AS day, n FROM conv", *EVD, _CONV),
    "k7_delivered_recent": sql("SELECT campaign_id, recent AS delivered_recent FROM rec", *EVD, _RECENT),
    "k8_anomaly_open_rate": sql(
        f"SELECT campaign_id, coalesce({_OPEN_TEXT}, '') AS anomaly FROM met, base", *EVD, METRICS),
    "k9_anomaly_conversion_spike": sql(
        "SELECT campaign_id, coalesce(text, '') AS anomaly FROM spiked", *EVD, _CONV, _spike("conv")),
    "k9_spike_by_customer": sql(
        "SELECT campaign_id, coalesce(text, '') AS anomaly FROM spiked", *EVD, """
dels AS (
  SELECT customer_id AS campaign_id, occurred_at::DATE AS day, count(*) AS n FROM ev WHERE type = 'delivered' GROUP BY ALL)""",
        _spike("dels")),
    "k10_anomaly_bounce_rate": sql(
        f"SELECT campaign_id, coalesce({_BOUNCE_TEXT}, '') AS anomaly FROM met", *EVD, METRICS),
    "k11_anomaly_silent_active": sql(
        f"SELECT campaign_id, coalesce({_SILENT_TEXT}, '') AS anomaly FROM rec", *EVD, _RECENT),
    "k12_campaign_analytics": sql(
        f"""SELECT campaign_id, sends, delivered, opens, clicks, conversions, bounces, unsubscribes,
          round(open_rate, 6) + 0.0 AS open_rate, round(click_rate, 6) + 0.0 AS click_rate,
          round(conversion_rate, 6) + 0.0 AS conversion_rate, coalesce(first_day::VARCHAR, '') AS first_event_day,
          coalesce(last_day::VARCHAR, '') AS last_event_day, coalesce(chs, '') AS by_channel,
          round(bo, 6) + 0.0 AS platform_open_rate, round(bc, 6) + 0.0 AS platform_click_rate,
          round(bv, 6) + 0.0 AS platform_conversion_rate,
          concat_ws(' | ', {_OPEN_TEXT}, s.text, {_BOUNCE_TEXT}, {_SILENT_TEXT}) AS anomalies
        FROM met, base LEFT JOIN spiked s USING (campaign_id) LEFT JOIN rec USING (campaign_id)
        LEFT JOIN chan USING (campaign_id)""".replace("FROM met, base", "FROM met CROSS JOIN base"),
        *EVD, METRICS, _CONV, _spike("conv"), _RECENT, f"""
chan AS (
  SELECT campaign_id, string_agg(channel || ':' || s || ':' || d || ':' || c, ' | ' ORDER BY channel) AS chs
  FROM (SELECT campaign_id, channel, {_n('sent')} AS s, {_n('delivered')} AS d, {_n('complained')} AS c
        FROM daily GROUP BY 1, 2) GROUP BY 1)"""),
}
