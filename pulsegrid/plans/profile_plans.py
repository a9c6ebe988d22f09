"""Queries and oracles: derived tables, profiles and customer reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import customers as C
from pulsegrid.operators import profiles as P
from pulsegrid.operators import rollups as R
from pulsegrid.operators.paging import keyset_page
from pulsegrid.plans.base import AS_OF, EV, EVD, EVP, NEGATIVE, POSITIVE, WEIGHT, Tables, flat, sql
from pulsegrid.sources import fixture as X

MIDPOINT = "2024-01-16 00:00:00"


def p1_build_profiles(spark, sf):
    return flat(P.build_profiles(Tables(spark, sf).events, AS_OF))


def p1a_profile_counters(spark, sf):
    return flat(P.profile_counters(Tables(spark, sf).events, AS_OF))


def p1b_channel_counts(spark, sf):
    return flat(P.channel_counts(Tables(spark, sf).events, AS_OF))


def p1c_last_event(spark, sf):
    return flat(P.last_event(Tables(spark, sf).events, AS_OF))


def p1d_decayed_score(spark, sf):
    return flat(P.decayed_score(Tables(spark, sf).events, AS_OF))


def p1e_preferred_channel(spark, sf):
    return flat(P.preferred_channel(P.channel_counts(Tables(spark, sf).events, AS_OF)))


def p1f_activity_trend(spark, sf):
    return flat(P.activity_trend(Tables(spark, sf).events, AS_OF))


def p2_merge_profiles(spark, sf):
    """Three loads by arrival, folded apart, then merged: late events cross the load borders."""
    e = Tables(spark, sf).events
    cut = [X.as_ts(t) for t in ("2024-01-11 00:00:00", "2024-01-21 00:00:00")]
    got = F.col("received_at")
    loads = [e.where(got < cut[0]), e.where((got >= cut[0]) & (got < cut[1])), e.where(got >= cut[1])]
    a, b, c = (P.profile_partials(load, AS_OF) for load in loads)
    return flat(P.merge_profiles(P.merge_cells(a.unionByName(c)), b, e, AS_OF))


def p3_derive_sends(spark, sf):
    return flat(R.derive_sends(Tables(spark, sf).events, AS_OF))


def p4_customer_last_event(spark, sf):
    t = Tables(spark, sf)
    return flat(P.customer_last_event(t.customers, t.events, AS_OF), "id", "last_event_at")


def p5_campaign_daily(spark, sf):
    return flat(Tables(spark, sf).daily)


def p10_refresh_scores(spark, sf):
    """Profiles stored half-way through the month, refreshed at its end."""
    t = Tables(spark, sf)
    stored = P.build_profiles(t.events, MIDPOINT)
    fresh = P.refresh_scores(stored, t.events, AS_OF)
    return flat(fresh, "customer_id", "engagement_score", "score_updated_at", "activity_trend", "preferred_channel")


def c1_customer_profiles(spark, sf):
    t = Tables(spark, sf)
    out = C.customer_profiles(t.customers, t.profiles, t.events, AS_OF)
    return flat(out.drop("attributes", "email"))


def c2_timeline(spark, sf):
    """The five newest events of every customer."""
    t = Tables(spark, sf)
    return flat(C.timelines(t.events, t.campaigns, 5).drop("payload"))


def c2_timeline_page(spark, sf):
    """One page of all clicks on email, newest first."""
    t = Tables(spark, sf)
    return flat(C.timeline(t.events, t.campaigns, channel="email", event_type="clicked", limit=200).drop("payload"))


def c3_keyset_page(spark, sf):
    e = Tables(spark, sf).events.select("id", "occurred_at", "type")
    order = [("occurred_at", "desc"), ("id", "desc")]
    return flat(keyset_page(e, order, ("2024-01-20 00:00:00", 0), 120))


QUERIES = {
    f.__name__: f
    for f in (
        p1_build_profiles, p1a_profile_counters, p1b_channel_counts, p1c_last_event, p1d_decayed_score,
        p1e_preferred_channel, p1f_activity_trend, p2_merge_profiles, p3_derive_sends, p4_customer_last_event,
        p5_campaign_daily, p10_refresh_scores, c1_customer_profiles, c2_timeline, c2_timeline_page, c3_keyset_page,
    )
}

_PROFILE = """
SELECT customer_id, total AS total_events, pos AS positive_events, neg AS negative_events, conv AS conversions,
  epoch_us(last_at) AS last_event_at, last_type AS last_event_type, round(raw, 6) + 0.0 AS engagement_score,
  epoch_us(last_at) AS score_updated_at, trend AS activity_trend, coalesce(preferred, '') AS preferred_channel
FROM prof"""

ORACLES = {
    "p1_build_profiles": sql(_PROFILE, *EVP),
    "p1a_profile_counters": sql(
        f"""SELECT customer_id, count(*) AS total_events, count(*) FILTER ({POSITIVE}) AS positive_events,
          count(*) FILTER ({NEGATIVE}) AS negative_events, count(*) FILTER (type = 'converted') AS conversions
        FROM pe GROUP BY 1""", *EV),
    "p1b_channel_counts": sql("SELECT customer_id, channel, type, count(*) AS n FROM pe GROUP BY ALL", *EV),
    "p1c_last_event": sql(
        "SELECT customer_id, epoch_us(last_at) AS last_event_at, last_type AS last_event_type FROM lastev", *EVP),
    "p1d_decayed_score": sql(
        "SELECT customer_id, round(raw, 6) + 0.0 AS raw, epoch_us(last_at) AS anchor FROM prof", *EVP),
    "p1e_preferred_channel": sql(
        "SELECT customer_id, coalesce(preferred, '') AS preferred_channel FROM prof", *EVP),
    "p1f_activity_trend": sql(
        """SELECT customer_id, cur AS trend_current, prior AS trend_prior,
          CASE WHEN cur > prior THEN 'rising' WHEN cur < prior THEN 'declining' ELSE 'stable' END AS activity_trend
        FROM trend""", *EVP),
    "p2_merge_profiles": sql(_PROFILE, *EVP),
    "p3_derive_sends": sql("SELECT customer_id, campaign_id, channel, epoch_us(sent_at) AS sent_at FROM sends", *EVP),
    "p4_customer_last_event": sql(
        """SELECT id, coalesce(epoch_us(greatest(seen, last_at)), -1) AS last_event_at
        FROM cu LEFT JOIN lastev ON customer_id = id""", *EVP),
    "p5_campaign_daily": sql(
        "SELECT campaign_id, channel, type AS event_type, day::VARCHAR AS day, n AS count FROM daily", *EVD),
    "p10_refresh_scores": sql(
        """SELECT customer_id, round(s, 6) + 0.0 AS engagement_score,
          epoch_us(TIMESTAMP '2024-01-31') AS score_updated_at, trend AS activity_trend,
          coalesce(preferred, '') AS preferred_channel
        FROM half JOIN prof USING (customer_id)""", *EVP,
        f"""
half AS (
  SELECT customer_id,
    sum({WEIGHT} * pow(0.5, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(occurred_at)) / 1e6 / 1209600)) AS s
  FROM pe WHERE occurred_at <= TIMESTAMP '2024-01-16' GROUP BY 1)"""),
    "c1_customer_profiles": sql(
        """SELECT id, ext AS customer_id, is_active::BIGINT AS is_active,
          round(CASE WHEN coalesce(now_raw, 0) <= 0 THEN 0 ELSE now_raw / (now_raw + 10) END, 6) + 0.0 AS score,
          round(coalesce(now_raw, 0), 6) + 0.0 AS raw_score,
          CASE WHEN coalesce(t.cur, 0) > coalesce(t.prior, 0) THEN 'rising'
               WHEN coalesce(t.cur, 0) < coalesce(t.prior, 0) THEN 'declining' ELSE 'stable' END AS trend,
          coalesce(preferred, '') AS preferred_channel, coalesce(total, 0) AS total_events,
          coalesce(pos, 0) AS positive_events, coalesce(neg, 0) AS negative_events, coalesce(conv, 0) AS conversions,
          coalesce(epoch_us(last_at), -1) AS last_event_at
        FROM cu LEFT JOIN (
          SELECT prof.*, raw * pow(0.5, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_at)) / 1e6 / 1209600) AS now_raw
          FROM prof) p ON p.customer_id = id
        LEFT JOIN trend t ON t.customer_id = id""", *EVP),
    "c2_timeline": sql(
        """SELECT coalesce(campaign_id, -1) AS campaign_id, ev.id, event_id, customer_id, ev.channel, type,
          epoch_us(occurred_at) AS occurred_at,
          row_number() OVER (PARTITION BY customer_id ORDER BY occurred_at DESC, ev.id DESC) AS pos,
          coalesce(ca.ext, '') AS campaign
        FROM ev LEFT JOIN ca ON ca.id = campaign_id QUALIFY pos <= 5""", *EV),
    "c2_timeline_page": sql(
        """SELECT *, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS page_pos FROM (
          SELECT coalesce(campaign_id, -1) AS campaign_id, ev.id, event_id, customer_id, ev.channel, type,
            epoch_us(occurred_at) AS occurred_at, coalesce(ca.ext, '') AS campaign,
            (count(*) OVER () > 200)::BIGINT AS has_more
          FROM ev LEFT JOIN ca ON ca.id = campaign_id WHERE ev.channel = 'email' AND type = 'clicked')
        ORDER BY page_pos LIMIT 200""", *EV),
    "c3_keyset_page": sql(
        """SELECT id, epoch_us(occurred_at) AS occurred_at, type,
          row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS page_pos, (count(*) OVER () > 120)::BIGINT AS has_more
        FROM ev WHERE occurred_at < TIMESTAMP '2024-01-20' OR (occurred_at = TIMESTAMP '2024-01-20' AND id < 0)
        ORDER BY page_pos LIMIT 120""", *EV),
}
