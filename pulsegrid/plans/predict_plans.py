"""Queries and oracles: channel prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import predict as B
from pulsegrid.plans.base import AS_OF, EVP, Tables, chooser, flat, sql
from pulsegrid.sources import fixture as X


def _asked(spark, sf):
    return B.normalize_prediction_requests(X.prediction_requests(spark, sf))


def _evidence(spark, sf):
    t = Tables(spark, sf)
    return B.channel_evidence(_asked(spark, sf), t.events, t.profiles, t.customers, t.daily, t.campaigns, AS_OF)


def b1_normalize_prediction_requests(spark, sf):
    out = B.normalize_prediction_requests(X.prediction_request_rows(spark, sf))
    return flat(out, "request_id", "channels", "lookback_days", "scope", "errors")


def b3_platform_evidence(spark, sf):
    t = Tables(spark, sf)
    return flat(B.platform_evidence(_asked(spark, sf), t.daily, t.campaigns, AS_OF))


def b4_audience_evidence(spark, sf):
    t = Tables(spark, sf)
    return flat(B.audience_evidence(
        _asked(spark, sf), B.target_daily(t.events, AS_OF), t.profiles, t.customers, AS_OF))


def b5_customer_evidence(spark, sf):
    t = Tables(spark, sf)
    return flat(B.customer_evidence(B.target_daily(t.events, AS_OF), 14))


def b7_platform_mean(spark, sf):
    return flat(B.platform_mean(_evidence(spark, sf)), "request_id", "channel", "platform_mean")


def b8_posteriors(spark, sf):
    return flat(B.posteriors(_evidence(spark, sf)), "request_id", "channel", "a", "b", "mean")


def b9_simulate(spark, sf):
    return flat(B.simulate(B.posteriors(_evidence(spark, sf))))


def b11_risk_rates(spark, sf):
    return flat(B.risk_rates(_evidence(spark, sf)), "request_id", "channel", "opt_out_rate", "bounce_rate",
                "others_opt_out", "others_bounce")


def b12_rank_channels(spark, sf):
    """Platform and audience requests repeat rates only by chance, so the second key decides where rates are cut to 2 places."""
    posts = B.posteriors(_evidence(spark, sf))
    rated = posts.join(B.simulate(posts), ["request_id", "channel"]).withColumns({
        "predicted_rate": F.floor(F.col("mean") * 100 + 0.5) / 100, "prob_best": B.S.round4(F.col("prob_best"))})
    return flat(B.rank_channels(rated), "request_id", "channel", "predicted_rate", "prob_best", "rank")


def b13_prediction_reasons(spark, sf):
    rows = B.prediction_reasons(B.risk_rates(B.clamped(_evidence(spark, sf))))
    return flat(rows, "request_id", "channel", "reasons")


def b14_prediction_advice(spark, sf):
    return flat(B.prediction_advice(B.predictions(_evidence(spark, sf)).drop("advice", "confidence")))


def b15_predict_channels(spark, sf):
    t = Tables(spark, sf)
    return flat(B.predict_channels(
        X.prediction_requests(spark, sf), t.events, t.profiles, t.customers, t.daily, t.campaigns, AS_OF))


def b15_predict_all_customers(spark, sf):
    t = Tables(spark, sf)
    return flat(B.predict_all_customers(t.customers, t.events, t.daily, t.campaigns, AS_OF))


def b15_predict_channels_fixed_part(spark, sf):
    """What does not depend on the draws: rates, evidence, risks, reasons, audience size."""
    t = Tables(spark, sf)
    out = B.predict_channels(
        X.prediction_requests(spark, sf), t.events, t.profiles, t.customers, t.daily, t.campaigns, AS_OF)
    return flat(out, "request_id", "scope", "success_event", "channel", "predicted_rate", "low_data", "opt_out_rate",
                "bounce_rate", "objective_delivered", "objective_successes", "other_delivered", "other_successes",
                "target_delivered", "target_successes", "reasons", "lookback_days", "audience_size")


def b15_predict_all_customers_rates(spark, sf):
    """Rate of the best channel of every customer and objective."""
    t = Tables(spark, sf)
    out = B.predict_all_customers(t.customers, t.events, t.daily, t.campaigns, AS_OF)
    return flat(out, "customer_id", "objective", "predicted_rate")


QUERIES = {
    f.__name__: f
    for f in (
        b1_normalize_prediction_requests, b3_platform_evidence, b4_audience_evidence, b5_customer_evidence,
        b7_platform_mean, b8_posteriors, b9_simulate, b11_risk_rates, b12_rank_channels, b13_prediction_reasons,
        b14_prediction_advice, b15_predict_channels, b15_predict_channels_fixed_part, b15_predict_all_customers,
        b15_predict_all_customers_rates,
    )
}

_CH = ("email", "sms", "whatsapp", "push", "web")
_OBJ = ("conversion", "engagement", "retention", "reactivation", "awareness")

PREQ = f"""
pr AS (
  SELECT n AS request_id, {chooser(_OBJ, 'n')} AS objective,
    CASE WHEN n % 4 = 1 THEN ['sms', 'email'] WHEN n % 8 = 7 THEN ['web']
         ELSE ['email', 'sms', 'whatsapp', 'push', 'web'] END AS channels,
    CASE WHEN n % 3 = 2 THEN 'customer' WHEN n % 3 = 1 THEN 'audience' ELSE 'platform' END AS scope,
    n % 14 AS cust, n % 5 * 0.04::DOUBLE AS min_score, n % 2 * 14 AS active_days,
    CASE WHEN n % 2 = 0 THEN 90 ELSE n % 20 + 5 END AS lookback
  FROM (SELECT n_nationkey::BIGINT AS n FROM nation)),
prs AS (
  SELECT *, CASE objective WHEN 'conversion' THEN 'converted' WHEN 'engagement' THEN 'clicked' ELSE 'opened' END
    AS success FROM pr),
prc AS (
  SELECT prs.*, channels[pos] AS channel, pos FROM prs, unnest(range(1, len(channels) + 1)) u(pos)),
dl AS (SELECT daily.*, ca.objective AS of FROM daily JOIN ca ON ca.id = campaign_id),
pev AS (
  SELECT k.objective, k.lookback, c.channel,
    coalesce(sum(n) FILTER (of = k.objective AND type = k.success), 0)::BIGINT AS os,
    coalesce(sum(n) FILTER (of = k.objective AND type = 'delivered'), 0)::BIGINT AS on_,
    coalesce(sum(n) FILTER (of <> k.objective AND type = k.success), 0)::BIGINT AS xs,
    coalesce(sum(n) FILTER (of <> k.objective AND type = 'delivered'), 0)::BIGINT AS xn,
    coalesce(sum(n) FILTER (type = 'sent'), 0)::BIGINT AS sent,
    coalesce(sum(n) FILTER (type = 'bounced'), 0)::BIGINT AS bounced,
    coalesce(sum(n) FILTER (type IN ('unsubscribed', 'complained')), 0)::BIGINT AS opt_outs,
    coalesce(sum(n) FILTER (type = 'delivered'), 0)::BIGINT AS del
  FROM (SELECT DISTINCT objective, success, lookback FROM prs) k
  CROSS JOIN (SELECT unnest(['email', 'sms', 'whatsapp', 'push', 'web']) AS channel) c
  LEFT JOIN dl ON dl.channel = c.channel AND dl.day >= DATE '2024-01-31' - k.lookback::INTEGER
  GROUP BY ALL),
aud AS (
  SELECT request_id, success, lookback, p.customer_id
  FROM prs JOIN prof p ON scope = 'audience' JOIN cu ON cu.id = p.customer_id AND cu.is_active
  WHERE (min_score <= 0 OR p.raw >= 10 * min_score / (1 - min_score))
    AND (active_days <= 0 OR last_at >= TIMESTAMP '2024-01-31' - to_days(active_days::INTEGER))),
who AS (
  SELECT * FROM aud UNION ALL
  SELECT request_id, success, lookback, cust FROM prs WHERE scope = 'customer'),
tev AS (
  SELECT who.request_id, channel, count(*) FILTER (type = success) AS ts, count(*) FILTER (type = 'delivered') AS tn
  FROM who JOIN ev USING (customer_id)
  WHERE campaign_id IS NOT NULL AND type IN (success, 'delivered')
    AND occurred_at >= TIMESTAMP '2024-01-31' - to_days(lookback::INTEGER)
  GROUP BY ALL),
evi AS (
  SELECT prc.*, greatest(os, 0) AS os, greatest(on_, os) AS on_, xs, greatest(xn, xs) AS xn, sent, bounced, opt_outs,
    del, coalesce(ts, 0) AS ts, greatest(coalesce(tn, 0), coalesce(ts, 0)) AS tn
  FROM prc JOIN pev USING (objective, lookback, channel) LEFT JOIN tev USING (request_id, channel)),
pm AS (
  SELECT request_id, CASE WHEN sum(on_ + xn) = 0
      THEN CASE any_value(success) WHEN 'converted' THEN 0.02 WHEN 'clicked' THEN 0.03 ELSE 0.2 END
      ELSE least(greatest(sum(os + xs)::DOUBLE / sum(on_ + xn), 1e-4), 1 - 1e-4) END::DOUBLE AS mg
  FROM evi GROUP BY 1),
l2 AS (
  SELECT evi.*, mg, 50 * ((xs + 100 * mg) / (xn + 100)) + os AS a2,
    50 * (1 - (xs + 100 * mg) / (xn + 100)) + on_ - os AS b2
  FROM evi JOIN pm USING (request_id)),
post AS (
  SELECT *, CASE scope WHEN 'platform' THEN a2
      ELSE least(a2 + b2, CASE scope WHEN 'customer' THEN 30 ELSE 500 END) * a2 / (a2 + b2) + ts END AS a,
    CASE scope WHEN 'platform' THEN b2
      ELSE least(a2 + b2, CASE scope WHEN 'customer' THEN 30 ELSE 500 END) * b2 / (a2 + b2) + tn - ts END AS b
  FROM l2),
risk AS (
  SELECT *, floor(CASE WHEN del > 0 THEN opt_outs::DOUBLE / del ELSE 0 END * 10000 + 0.5) / 10000 AS oo,
    floor(CASE WHEN sent > 0 THEN bounced::DOUBLE / sent ELSE 0 END * 10000 + 0.5) / 10000 AS bo,
    CASE WHEN sum(del) OVER w - del > 0 THEN (sum(opt_outs) OVER w - opt_outs)::DOUBLE / (sum(del) OVER w - del)
      ELSE 0 END AS xoo,
    CASE WHEN sum(sent) OVER w - sent > 0 THEN (sum(bounced) OVER w - bounced)::DOUBLE / (sum(sent) OVER w - sent)
      ELSE 0 END AS xbo
  FROM evi WINDOW w AS (PARTITION BY request_id))"""

_P = (*EVP, PREQ)

_REASONS = """concat_ws(' | ',
          CASE WHEN on_ > 0 THEN printf('%.1f%% %s rate over %s deliveries in %s campaigns (last %dd)',
              os::DOUBLE / on_ * 100, success, format('{:,}', on_), objective, lookback)
            WHEN xn > 0 THEN printf('no %s-campaign history; estimate borrows %.1f%% from %s deliveries on other objectives',
              objective, xs::DOUBLE / xn * 100, format('{:,}', xn))
            ELSE 'no history on this channel; estimate is the platform average' END,
          CASE WHEN scope = 'platform' THEN NULL
            WHEN tn > 0 THEN printf('%s history: %s %s over %s deliveries', scope, format('{:,}', ts), success,
              format('{:,}', tn))
            ELSE scope || ' has never been reached on this channel' END,
          CASE WHEN on_ + tn < 200 THEN 'low data: treat as a directional estimate' END,
          CASE WHEN del >= 100 AND xoo > 0 AND oo > 2 * xoo THEN
            printf('high opt-out risk: %.1f%% unsubscribes/complaints vs %.1f%% on the other channels', oo * 100, xoo * 100)
          END,
          CASE WHEN sent >= 100 AND xbo > 0 AND bo > 2 * xbo THEN
            printf('high bounce rate: %.1f%% vs %.1f%% on the other channels', bo * 100, xbo * 100) END)"""

# Every customer x objective x channel with 90 days of history, as the model states it.
EVERY = """
sx AS (SELECT * FROM (VALUES ('conversion', 'converted'), ('engagement', 'clicked'), ('retention', 'opened'),
  ('reactivation', 'opened'), ('awareness', 'opened')) t(objective, success)),
pl AS (
  SELECT sx.objective, success, c.channel,
    coalesce(sum(n) FILTER (of = sx.objective AND type = success), 0) AS os,
    coalesce(sum(n) FILTER (of = sx.objective AND type = 'delivered'), 0) AS on0,
    coalesce(sum(n) FILTER (of <> sx.objective AND type = success), 0) AS xs,
    coalesce(sum(n) FILTER (of <> sx.objective AND type = 'delivered'), 0) AS xn0
  FROM sx CROSS JOIN (SELECT unnest(['email', 'sms', 'whatsapp', 'push', 'web']) AS channel) c
  LEFT JOIN dl ON dl.channel = c.channel AND dl.day >= DATE '2024-01-31' - 90 GROUP BY ALL),
pl2 AS (
  SELECT *, greatest(on0, os) AS on_, greatest(xn0, xs) AS xn,
    sum(os + xs) OVER w / sum(greatest(on0, os) + greatest(xn0, xs)) OVER w AS mg
  FROM pl WINDOW w AS (PARTITION BY objective)),
pl3 AS (
  SELECT objective, success, channel, 50 * ((xs + 100 * mg) / (xn + 100)) + os AS a2,
    50 * (1 - (xs + 100 * mg) / (xn + 100)) + on_ - os AS b2 FROM pl2),
ct AS (
  SELECT customer_id, channel, type, count(*) AS n FROM ev WHERE campaign_id IS NOT NULL GROUP BY ALL),
allp AS (
  SELECT cu.id AS customer_id, pl3.objective, pl3.channel, least(a2 + b2, 30) * a2 / (a2 + b2) + coalesce(s.n, 0) AS a,
    least(a2 + b2, 30) * b2 / (a2 + b2) + greatest(coalesce(d.n, 0), coalesce(s.n, 0)) - coalesce(s.n, 0) AS b
  FROM cu CROSS JOIN pl3
  LEFT JOIN ct s ON s.customer_id = cu.id AND s.channel = pl3.channel AND s.type = pl3.success
  LEFT JOIN ct d ON d.customer_id = cu.id AND d.channel = pl3.channel AND d.type = 'delivered')"""

# Summary of Beta distributions over a grid of 129 points, relationally: `sets` lists (set_id, pos, a, b).
GRID = """
gr AS (
  SELECT a, b, ln(a / b) - (4.5 / sqrt(a) + 8 / a) - ln(1 + 4.5 / sqrt(b) + 8 / b) AS lo,
    (4.5 / sqrt(a) + 8 / a + ln(1 + 4.5 / sqrt(b) + 8 / b) + 4.5 / sqrt(b) + 8 / b + ln(1 + 4.5 / sqrt(a) + 8 / a)) / 128 AS step,
    a * ln(a / (a + b)) + b * ln(b / (a + b)) AS peak
  FROM (SELECT DISTINCT a, b FROM sets)),
dn AS (
  SELECT a, b, lo, step, k, lo + step * k AS y,
    exp(-a * (greatest(-(lo + step * k), 0) + ln(1 + exp(-abs(lo + step * k))))
        - b * (greatest(lo + step * k, 0) + ln(1 + exp(-abs(lo + step * k)))) - peak) AS d
  FROM gr, unnest(range(129)) u(k)),
ig AS (
  SELECT *, coalesce(sum((d + before) / 2) OVER (PARTITION BY a, b ORDER BY k), 0) AS run,
    sum((d + before) / 2) OVER (PARTITION BY a, b) AS total
  FROM (SELECT *, lag(d) OVER (PARTITION BY a, b ORDER BY k) AS before FROM dn)),
tb AS (
  SELECT a, b, lo, step, k, y, run / total AS f, lead(run) OVER (PARTITION BY a, b ORDER BY k) / total AS fnext FROM ig),
qt AS (
  SELECT a, b, 1 / (1 + exp(-(any_value(lo) + any_value(step) * max(k + (0.05 - f) / (fnext - f)) FILTER (f < 0.05)))) AS lower,
    1 / (1 + exp(-(any_value(lo) + any_value(step) * max(k + (0.95 - f) / (fnext - f)) FILTER (f < 0.95 AND fnext >= 0.95)))) AS upper
  FROM (SELECT * FROM tb WHERE f < 0.05 AND fnext >= 0.05 OR f < 0.95 AND fnext >= 0.95) GROUP BY a, b),
pt AS (
  SELECT s.set_id, t.y, row_number() OVER (PARTITION BY s.set_id ORDER BY t.y) AS m FROM sets s JOIN tb t ON t.a = s.a AND t.b = s.b),
fv AS (
  SELECT set_id, m, pos, CASE WHEN place <= 0 THEN 0 WHEN place >= 128 THEN 1 ELSE f + (place - floor(place)) * (fnext - f) END AS v
  FROM (SELECT pt.set_id, m, pos, a, b, (y - lo) / step AS place FROM pt JOIN sets USING (set_id) JOIN gr USING (a, b)) o
  LEFT JOIN tb ON tb.a = o.a AND tb.b = o.b AND tb.k = CASE WHEN place > 0 AND place < 128 THEN floor(place)::BIGINT END),
ov AS (
  SELECT x.set_id, x.m, x.pos, any_value(x.v) AS v, coalesce(product(o.v), 1) AS beaten
  FROM fv x LEFT JOIN fv o ON o.set_id = x.set_id AND o.m = x.m AND o.pos <> x.pos GROUP BY ALL),
wn AS (
  SELECT set_id, pos, sum((v - v0) * (beaten + b0)) AS raw
  FROM (SELECT *, lag(v) OVER w AS v0, lag(beaten) OVER w AS b0 FROM ov WINDOW w AS (PARTITION BY set_id, pos ORDER BY m))
  GROUP BY ALL),
sm AS (
  SELECT s.set_id, s.pos, s.a, s.b, lower, upper, raw / sum(raw) OVER (PARTITION BY s.set_id) AS prob
  FROM sets s JOIN qt USING (a, b) JOIN wn ON wn.set_id = s.set_id AND wn.pos = s.pos)"""

REQUEST_SETS = "sets AS (SELECT request_id AS set_id, pos, a, b FROM post)"

# Per request: its ranked channels with rounded figures, the best one and its challenger.
RANKED = """
rk AS (
  SELECT post.*, floor(a / (a + b) * 10000 + 0.5) / 10000 AS rate, floor(prob * 10000 + 0.5) / 10000 AS pb,
    floor(lower * 10000 + 0.5) / 10000 AS lo4, floor(upper * 10000 + 0.5) / 10000 AS up4
  FROM post JOIN (SELECT set_id AS request_id, pos, prob, lower, upper FROM sm) USING (request_id, pos)),
rn AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rate DESC, pb DESC, pos) AS rank FROM rk),
bs AS (SELECT request_id, channel AS best, pb AS p, success, scope FROM rn WHERE rank = 1),
rv AS (
  SELECT request_id, channel AS rival, pb AS q FROM rn WHERE rank > 1
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pb DESC, rank) = 1),
ad AS (
  SELECT request_id, best AS recommended_channel,
    CASE WHEN rival IS NULL OR p >= 0.9 THEN 'high' WHEN p >= 0.65 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN rival IS NULL THEN 'Only ' || best || ' was evaluated.'
      WHEN p >= 0.9 THEN printf('Send on %s: it has a %.1f%% chance of the highest %s rate.', best, p * 100, success)
      WHEN p >= 0.65 THEN printf('%s is the likely winner (%.1f%% chance best); %s is the main challenger.', best, p * 100, rival)
      WHEN scope = 'customer' THEN printf('Not enough history to separate channels for this customer; %s is the best guess '
        || '(%.1f%% chance best). Their response will sharpen the next prediction.', best, p * 100)
      ELSE printf('No clear winner between %s and %s (%.1f%% vs %.1f%% chance best). Run an A/B split on a slice of the '
        || 'audience before committing the rest.', best, rival, p * 100, q * 100) END AS advice
  FROM bs LEFT JOIN rv USING (request_id))"""

# The different posteriors of all customers, and their answers in the shape of requests.
EVERY_SETS = """
vec AS (
  SELECT customer_id, objective, list(a ORDER BY channel) AS va, list(b ORDER BY channel) AS vb FROM allp GROUP BY ALL),
one AS (SELECT objective, va, vb, row_number() OVER () AS set_id FROM (SELECT DISTINCT objective, va, vb FROM vec)),
sets AS (
  SELECT set_id, list_position(['email', 'sms', 'whatsapp', 'push', 'web'], list_sort(['email', 'sms', 'whatsapp', 'push', 'web'])[i]) AS pos,
    va[i] AS a, vb[i] AS b FROM one, unnest(range(1, 6)) u(i)),
epost AS (
  SELECT set_id AS request_id, pos, a, b, ['email', 'sms', 'whatsapp', 'push', 'web'][pos] AS channel, 'customer' AS scope, success
  FROM sets JOIN one USING (set_id) JOIN sx USING (objective))"""

ORACLES = {
    "b1_normalize_prediction_requests": """
      SELECT o AS request_id,
        CASE WHEN o % 13 = 0 THEN 'fax' WHEN o % 5 = 1 THEN 'sms | web | email'
             ELSE 'email | sms | whatsapp | push | web' END AS channels,
        CASE WHEN o % 2 = 0 THEN 90 WHEN o % 23 = 0 THEN 400 WHEN o % 29 = 0 THEN -1 ELSE o % 365 + 1 END::BIGINT
          AS lookback_days,
        CASE WHEN o % 3 = 0 THEN 'customer' WHEN o % 7 < 2 THEN 'audience' ELSE 'platform' END AS scope,
        concat_ws(' | ',
          CASE WHEN o % 7 < 2 AND o % 19 = 0 THEN 'audience.last_active_days: must be >= 0' END,
          CASE WHEN o % 7 < 2 AND o % 17 = 0 THEN 'audience.min_score: must be in [0, 1)' END,
          CASE WHEN o % 13 = 0 THEN 'channels: each channel must be one of email, sms, whatsapp, push, web' END,
          CASE WHEN o % 3 = 0 AND o % 7 < 2 THEN 'customer_id: customer_id and audience are mutually exclusive' END,
          CASE WHEN o % 2 = 1 AND (o % 23 = 0 OR o % 29 = 0) THEN 'lookback_days: must be between 1 and 365' END,
          CASE WHEN o % 11 = 0 THEN
            'objective: must be one of conversion, engagement, retention, reactivation, awareness' END) AS errors
      FROM (SELECT o_orderkey AS o FROM orders)""",
    "b3_platform_evidence": sql(
        """SELECT objective, lookback AS lookback_days, channel, os AS objective_successes, on_ AS objective_delivered,
          xs AS other_successes, xn AS other_delivered, sent, bounced, opt_outs, del AS delivered_all FROM pev""", *_P),
    "b4_audience_evidence": sql(
        """SELECT prs.request_id, c.channel, coalesce(ts, 0) AS target_successes, coalesce(tn, 0) AS target_delivered,
          (SELECT count(*) FROM aud WHERE aud.request_id = prs.request_id) AS audience_size
        FROM prs CROSS JOIN (SELECT unnest(['email', 'sms', 'whatsapp', 'push', 'web']) AS channel) c
        LEFT JOIN tev ON tev.request_id = prs.request_id AND tev.channel = c.channel
        WHERE scope = 'audience'""", *_P),
    "b5_customer_evidence": sql(
        """SELECT customer_id, channel, count(*) FILTER (type = 'delivered') AS delivered,
          count(*) FILTER (type = 'opened') AS opened, count(*) FILTER (type = 'clicked') AS clicked,
          count(*) FILTER (type = 'converted') AS converted
        FROM ev WHERE campaign_id IS NOT NULL AND type IN ('delivered', 'opened', 'clicked', 'converted')
          AND occurred_at >= TIMESTAMP '2024-01-17' GROUP BY ALL""", *EVP),
    "b7_platform_mean": sql(
        "SELECT request_id, channel, round(mg, 6) + 0.0 AS platform_mean FROM l2", *_P),
    "b8_posteriors": sql(
        """SELECT request_id, channel, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(a / (a + b), 6) + 0.0 AS mean
        FROM post""", *_P),
    "b11_risk_rates": sql(
        """SELECT request_id, channel, round(oo, 6) + 0.0 AS opt_out_rate, round(bo, 6) + 0.0 AS bounce_rate,
          round(xoo, 6) + 0.0 AS others_opt_out, round(xbo, 6) + 0.0 AS others_bounce FROM risk""", *_P),
    "b9_simulate": sql(
        """SELECT request_id, channel, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper, round(prob, 6) + 0.0 AS prob_best
        FROM sm JOIN post ON post.request_id = set_id AND post.pos = sm.pos""", *_P, REQUEST_SETS, GRID),
    "b12_rank_channels": sql(
        """SELECT request_id, channel, floor(a / (a + b) * 100 + 0.5) / 100 AS predicted_rate, pb AS prob_best,
          row_number() OVER (PARTITION BY request_id ORDER BY floor(a / (a + b) * 100 + 0.5) DESC, pb DESC, pos) AS rank
        FROM rk""", *_P, REQUEST_SETS, GRID, RANKED),
    "b14_prediction_advice": sql("SELECT * FROM ad", *_P, REQUEST_SETS, GRID, RANKED),
    "b15_predict_channels": sql(
        f"""SELECT request_id, risk.objective, risk.scope, risk.success AS success_event, recommended_channel, confidence, advice, rank,
          channel, rate AS predicted_rate, lo4 AS lower, up4 AS upper, pb AS prob_best,
          (on_ + tn < 200)::BIGINT AS low_data, round(oo, 6) + 0.0 AS opt_out_rate, round(bo, 6) + 0.0 AS bounce_rate,
          on_ AS objective_delivered, os AS objective_successes, xn AS other_delivered, xs AS other_successes,
          CASE WHEN risk.scope = 'platform' THEN -1 ELSE tn END AS target_delivered,
          CASE WHEN risk.scope = 'platform' THEN -1 ELSE ts END AS target_successes, {_REASONS} AS reasons,
          lookback AS lookback_days, CASE WHEN risk.scope = 'audience'
            THEN (SELECT count(*) FROM aud WHERE aud.request_id = risk.request_id) ELSE -1 END AS audience_size,
          'beta-binomial-hierarchical-v1' AS model, 4000 AS samples
        FROM risk JOIN (SELECT request_id, channel, rate, lo4, up4, pb, rank FROM rn) USING (request_id, channel) JOIN ad USING (request_id)""",
        *_P, REQUEST_SETS, GRID, RANKED),
    "b15_predict_all_customers": sql(
        """SELECT customer_id, ext AS customer, objective, recommended_channel, confidence, advice, rate AS predicted_rate,
          pb AS prob_best, lo4 AS lower, up4 AS upper
        FROM vec JOIN one USING (objective, va, vb) JOIN cu ON cu.id = customer_id
        JOIN ad ON ad.request_id = set_id JOIN rn ON rn.request_id = set_id AND rn.rank = 1""",
        *_P, EVERY, EVERY_SETS, GRID, RANKED.replace("post", "epost")),
    "b13_prediction_reasons": sql(
        f"""SELECT request_id, channel, {_REASONS} AS reasons
        FROM risk""", *_P),
    "b15_predict_channels_fixed_part": sql(
        f"""SELECT request_id, risk.scope, risk.success AS success_event, channel,
          floor(post.a / (post.a + post.b) * 10000 + 0.5) / 10000 AS predicted_rate,
          (on_ + tn < 200)::BIGINT AS low_data, round(oo, 6) + 0.0 AS opt_out_rate, round(bo, 6) + 0.0 AS bounce_rate,
          on_ AS objective_delivered, os AS objective_successes, xn AS other_delivered, xs AS other_successes,
          CASE WHEN risk.scope = 'platform' THEN -1 ELSE tn END AS target_delivered,
          CASE WHEN risk.scope = 'platform' THEN -1 ELSE ts END AS target_successes, {_REASONS} AS reasons,
          lookback AS lookback_days, CASE WHEN risk.scope = 'audience'
            THEN (SELECT count(*) FROM aud WHERE aud.request_id = risk.request_id) ELSE -1 END AS audience_size
        FROM risk JOIN (SELECT request_id, channel, a, b FROM post) post USING (request_id, channel)""", *_P),
    "b15_predict_all_customers_rates": sql(
        """SELECT customer_id, objective, max(floor(a / (a + b) * 10000 + 0.5) / 10000) AS predicted_rate
        FROM allp GROUP BY ALL""", *_P, EVERY),
}
