"""Queries and oracles: audience recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import audience as A
from pulsegrid.plans.base import AS_OF, EVP, CAMPAIGNS, Tables, chooser, flat, sql
from pulsegrid.sources import fixture as X


def _requests(spark, sf):
    return X.audience_requests(spark, sf)


def _valid(spark, sf):
    return A.validate_audience_requests(_requests(spark, sf)).where(F.col("error").isNull())


def a1_validate_audience_requests(spark, sf):
    out = A.validate_audience_requests(X.audience_request_rows(spark, sf))
    return flat(out, "request_id", "error", "respect_cap")


def _prefiltered(spark, sf):
    t = Tables(spark, sf)
    return A.audience_prefilter(t.customers, t.profiles, t.sends, t.campaigns, _valid(spark, sf), AS_OF)


def a2_audience_prefilter(spark, sf):
    return flat(_prefiltered(spark, sf), "request_id", "customer_id", "raw_score", "preferred_channel")


def a3_candidate_pool(spark, sf):
    return flat(A.candidate_pool(_prefiltered(spark, sf), A.RequestShape.of(_valid(spark, sf))), "request_id", "customer_id", "considered", "truncated")


def a4_objective_score(spark, sf):
    pool = A.candidate_pool(_prefiltered(spark, sf), A.RequestShape.of(_valid(spark, sf)))
    score = A.objective_score(
        F.col("objective"), F.col("raw_score"), F.col("conversions"), F.col("positive_events"),
        F.col("last_event_at"), X.as_of())
    return flat(pool.withColumn("weighted", score), "request_id", "customer_id", "weighted")


def a5_top_k(spark, sf):
    """The thousand largest orders, ties by key."""
    o = X.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score")
    )
    return flat(A.top_k(o, 1000))


def a5_top_k_per_customer(spark, sf):
    o = X.raw(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score")
    )
    return flat(A.top_k_per(o, ["o_custkey"], 3))


def a6_dedup_candidates(spark, sf):
    """Every event as a ranked candidate of its channel: the newest event of a customer wins."""
    e = Tables(spark, sf).events.select(F.col("channel").alias("request_id"), "customer_id", (-F.col("id")).alias("rank"))
    return flat(A.dedup_candidates(e))


def a7_cap_context(spark, sf):
    rows = X.audience_request_rows(spark, sf).select("request_id", "channel", "objective")
    return flat(A.cap_context(rows, X.campaigns(spark)))


def a8_send_counts(spark, sf):
    t = Tables(spark, sf)
    windows = X.raw(spark, sf, "nation").select((F.col("n_nationkey") % 4 * 72 + 24).alias("window_hours"))
    return flat(A.send_counts(t.sends, windows, AS_OF))


def a9_apply_frequency_cap(spark, sf):
    return flat(_recommended(spark, sf)[0], "request_id", "customer_id", "rank")


def a10_audience_reasons(spark, sf):
    return flat(_recommended(spark, sf)[0], "request_id", "customer_id", "reasons")


def a11_audience_meta(spark, sf):
    return flat(_recommended(spark, sf)[1])


def _recommended(spark, sf):
    t = Tables(spark, sf)
    return A.recommend_audience(_requests(spark, sf), t.customers, t.profiles, t.sends, t.campaigns, AS_OF, exact=False)


def a12_recommend_audience(spark, sf):
    """With the bounded pool."""
    return flat(_recommended(spark, sf)[0], "request_id", "customer", "score", "rank", "reasons")


def a12_recommend_audience_exact(spark, sf):
    """The default: every match weighted, customers over their cap left out before the cut."""
    t = Tables(spark, sf)
    out = A.recommend_audience(_requests(spark, sf), t.customers, t.profiles, t.sends, t.campaigns, AS_OF)[0]
    return flat(out, "request_id", "customer", "score", "rank", "reasons", "considered")


def a12_recommend_audience_shared(spark, sf):
    """The same answers from ranked lists that all requests share."""
    t = Tables(spark, sf)
    out = A.recommend_audience(_requests(spark, sf), t.customers, t.profiles, t.sends, t.campaigns, AS_OF, shared=True)[0]
    return flat(out, "request_id", "customer", "score", "rank", "reasons", "considered")


def a13_over_cap_customers(spark, sf):
    t = Tables(spark, sf)
    return flat(A.over_cap_customers(t.customers, t.profiles, t.sends, t.campaigns, AS_OF))


QUERIES = {
    f.__name__: f
    for f in (
        a1_validate_audience_requests, a2_audience_prefilter, a3_candidate_pool, a4_objective_score, a5_top_k,
        a5_top_k_per_customer, a6_dedup_candidates, a7_cap_context, a8_send_counts, a9_apply_frequency_cap,
        a10_audience_reasons, a11_audience_meta, a12_recommend_audience, a12_recommend_audience_exact, a12_recommend_audience_shared,
        a13_over_cap_customers,
    )
}

_CH = ("email", "sms", "whatsapp", "push", "web")
_OBJ = ("conversion", "engagement", "retention", "reactivation", "awareness")

REQS = f"""
rq AS (
  SELECT n AS request_id, {chooser(_OBJ, 'n')} AS objective, {chooser(_CH, 'n // 5')} AS channel,
    (n % 7 * 4 + 3)::BIGINT AS size, n % 3 * 0.05::DOUBLE AS min_score, n % 4 * 7 AS days,
    CASE WHEN n % 5 = 1 THEN ['email', 'sms'] WHEN n % 5 = 3 THEN ['push', 'web', 'whatsapp'] END AS channels,
    CASE WHEN n % 6 = 2 THEN ['camp_003', 'camp_013'] ELSE [] END AS excluded, n % 4 <> 1 AS respect_cap
  FROM (SELECT n_nationkey::BIGINT AS n FROM nation)),
ctx AS (
  SELECT channel, objective, cap, hours FROM (
    SELECT *, row_number() OVER (PARTITION BY channel, objective
      ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, created_at DESC) AS rn FROM ca) WHERE rn = 1),
cand AS (
  SELECT rq.*, cu.id AS customer_id, cu.ext AS customer, p.raw, coalesce(p.preferred, '') AS preferred, p.conv, p.pos,
    p.total, p.last_at, p.trend
  FROM rq, cu JOIN prof p ON p.customer_id = cu.id
  WHERE cu.is_active
    AND (min_score <= 0 OR p.raw >= 10 * min_score / (1 - min_score))
    AND (days <= 0 OR p.last_at >= TIMESTAMP '2024-01-31' - to_days(days::INTEGER))
    AND (channels IS NULL OR list_contains(channels, p.preferred))
    AND NOT EXISTS (SELECT 1 FROM sends s JOIN ca x ON x.id = s.campaign_id
                    WHERE s.customer_id = cu.id AND list_contains(excluded, x.ext))),
pool AS (
  SELECT *, count(*) OVER (PARTITION BY request_id) AS considered FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY raw DESC, customer_id) AS pos0 FROM cand)
  WHERE pos0 <= least(size * 10, 200000)),
wtd AS (
  SELECT *, raw + w1 * ln(1 + conv) + w2 * ln(1 + pos)
    + w3 * ln(1 + greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_at)) / 86400e6, 0)) AS weighted
  FROM pool JOIN (VALUES ('conversion', 0.30, 0.05, 0.0), ('engagement', 0.05, 0.25, 0.0),
    ('reactivation', 0.10, 0.05, 0.30), ('retention', 0.10, 0.10, 0.0), ('awareness', 0.0, 0.0, 0.0))
    w(objective, w1, w2, w3) USING (objective)),
rnk AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY weighted DESC, customer_id) AS r0 FROM wtd),
capd AS (
  SELECT rnk.*, coalesce(c.cap, 3) AS cap,
    (SELECT count(*) FROM sends s WHERE s.customer_id = rnk.customer_id
       AND s.sent_at > TIMESTAMP '2024-01-31' - to_hours(coalesce(c.hours, 168))) AS got
  FROM rnk LEFT JOIN ctx c USING (channel, objective)
  WHERE r0 <= size * CASE WHEN respect_cap THEN 2 ELSE 1 END),
out0 AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY r0) AS rank,
    CASE WHEN weighted <= 0 THEN 0 ELSE weighted / (weighted + 1) END AS disp,
    greatest(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_at)) / 86400e6), 0)::BIGINT AS ago
  FROM capd WHERE NOT respect_cap OR got < cap),
chosen AS (
  SELECT *, list_filter([
    printf('score=%.2f', disp) || CASE WHEN considered >= 4 AND rank <= (considered + 3) // 4
      THEN ' top-quartile of ' || considered || ' considered' ELSE '' END,
    CASE WHEN preferred = channel THEN 'preferred_channel=' || preferred || ' matches' END,
    CASE WHEN objective = 'conversion' AND conv > 0 THEN 'converted ' || conv || 'x'
         WHEN objective = 'engagement' AND pos > 0 THEN pos || ' positive events'
         WHEN objective = 'reactivation' AND ago > 0 THEN 'dormant ' || ago || 'd with ' || total || ' events history'
    END,
    CASE WHEN ago = 0 THEN 'active today' ELSE 'active ' || ago || 'd ago' END,
    CASE WHEN trend = 'rising' THEN 'activity_trend=rising' END], lambda x: x IS NOT NULL) AS why
  FROM out0 WHERE rank <= size)"""

_R = (*EVP, REQS)
_EXACT = (*EVP, REQS.replace("least(size * 10, 200000)", "9223372036854775807").replace(
    "WHERE r0 <= size * CASE WHEN respect_cap THEN 2 ELSE 1 END", ""))

ORACLES = {
    "a1_validate_audience_requests": f"""
      SELECT o AS request_id, CASE
          WHEN o % 11 = 0 THEN 'objective must be one of conversion|engagement|retention|reactivation|awareness'
          WHEN o % 13 = 0 THEN 'channel must be one of email|sms|whatsapp|push|web'
          WHEN o % 17 = 0 OR o % 19 = 0 THEN 'size must be between 1 and 100000'
          WHEN o % 23 = 0 THEN 'conditions.min_score must be >= 0'
          WHEN o % 29 = 0 THEN 'conditions.last_active_days must be >= 0'
          WHEN o % 31 = 0 THEN 'conditions.channels contains invalid channel "pager"' ELSE '' END AS error,
        (o % 4 <> 1)::BIGINT AS respect_cap
      FROM (SELECT o_orderkey AS o FROM orders)""",
    "a2_audience_prefilter": sql(
        """SELECT request_id, customer_id, round(raw, 6) + 0.0 AS raw_score, preferred AS preferred_channel
        FROM cand""", *_R),
    "a3_candidate_pool": sql(
        """SELECT request_id, customer_id, considered, (considered = least(size * 10, 200000))::BIGINT AS truncated
        FROM pool""", *_R),
    "a4_objective_score": sql("SELECT request_id, customer_id, round(weighted, 6) + 0.0 AS weighted FROM wtd", *_R),
    "a5_top_k": """SELECT o_orderkey AS id, floor(o_totalprice / 1000) AS score FROM orders
      ORDER BY score DESC, id LIMIT 1000""",
    "a5_top_k_per_customer": """
      SELECT o_custkey, o_orderkey AS id, floor(o_totalprice / 1000) AS score,
        row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS rank
      FROM orders QUALIFY rank <= 3""",
    "a6_dedup_candidates": sql(
        "SELECT channel AS request_id, customer_id, -max(id) AS rank FROM ev GROUP BY 1, 2", *EVP),
    "a7_cap_context": sql(
        f"""SELECT channel, objective, request_id, coalesce(cap, 3) AS cap, coalesce(hours, 168) AS window_hours
        FROM (SELECT o_orderkey AS request_id,
            CASE WHEN o_orderkey % 11 = 0 THEN 'fame' ELSE {chooser(_OBJ, 'o_orderkey')} END AS objective,
            CASE WHEN o_orderkey % 13 = 0 THEN 'fax' ELSE {chooser(_CH, 'o_orderkey // 5')} END AS channel
          FROM orders) LEFT JOIN (
          SELECT channel, objective, cap, hours FROM ca QUALIFY row_number() OVER (PARTITION BY channel, objective
            ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, created_at DESC) = 1) USING (channel, objective)""",
        CAMPAIGNS),
    "a8_send_counts": sql(
        """SELECT customer_id, h AS window_hours, count(*) AS sends
        FROM sends, (SELECT DISTINCT (n_nationkey % 4 * 72 + 24)::BIGINT AS h FROM nation)
        WHERE sent_at > TIMESTAMP '2024-01-31' - to_hours(h) GROUP BY 1, 2""", *EVP),
    "a9_apply_frequency_cap": sql("SELECT request_id, customer_id, rank FROM chosen", *_R),
    "a10_audience_reasons": sql(
        """SELECT request_id, customer_id, array_to_string(
          (CASE WHEN len(why) < 2 THEN list_append(why, 'matches all audience filters') ELSE why END)[1:4], ' | ')
          AS reasons FROM chosen""", *_R),
    "a11_audience_meta": sql(
        """SELECT request_id, coalesce(c, 0) AS candidates_considered, coalesce(g, 0) AS returned,
          coalesce(c, 0) - coalesce(g, 0) AS filtered_out, size * 10 AS candidate_pool_size,
          (coalesce(c, 0) = size * 10)::BIGINT AS candidates_truncated,
          CASE WHEN respect_cap AND coalesce(g, 0) < size THEN 'frequency_cap_exhausted' ELSE '' END
            AS shortfall_reason
        FROM rq LEFT JOIN (SELECT request_id, count(*) AS c FROM pool GROUP BY 1) USING (request_id)
        LEFT JOIN (SELECT request_id, count(*) AS g FROM chosen GROUP BY 1) USING (request_id)""", *_R),
    "a12_recommend_audience": sql(
        """SELECT request_id, customer, round(disp, 6) + 0.0 AS score, rank, array_to_string(
          (CASE WHEN len(why) < 2 THEN list_append(why, 'matches all audience filters') ELSE why END)[1:4], ' | ')
          AS reasons FROM chosen""", *_R),
    "a12_recommend_audience_exact": sql(
        """SELECT request_id, customer, round(disp, 6) + 0.0 AS score, rank, array_to_string(
          (CASE WHEN len(why) < 2 THEN list_append(why, 'matches all audience filters') ELSE why END)[1:4], ' | ')
          AS reasons, considered FROM chosen""", *_EXACT),
    "a13_over_cap_customers": sql(
        """SELECT cu.id AS customer_id, cu.ext AS customer, ctx.channel, ctx.objective, cap, hours AS window_hours,
          count(*) AS sends, round(any_value(p.raw), 6) + 0.0 AS engagement_score
        FROM sends s JOIN cu ON cu.id = s.customer_id JOIN prof p ON p.customer_id = cu.id CROSS JOIN ctx
        WHERE cu.is_active AND s.sent_at > TIMESTAMP '2024-01-31' - to_hours(hours)
        GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= cap""", *_R),
}
ORACLES["a12_recommend_audience_shared"] = ORACLES["a12_recommend_audience_exact"]
