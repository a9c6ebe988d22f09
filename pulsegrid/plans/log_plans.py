"""Queries and oracles: logs, activity, dead-letter list and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import health as H
from pulsegrid.operators import logs as L
from pulsegrid.plans.base import AS_OF, EV, Tables, flat, sql
from pulsegrid.plans.ingest_plans import DLQ, FAILS, INBOUND, dlq, failures, outcomes, replayed
from pulsegrid.session import settle, shared_path
from pulsegrid.sources import fixture as X
from pulsegrid.sources import store


def _logs(spark, sf):
    """Steps of all events: ingest, processing, failures, replays."""
    e = Tables(spark, sf).events
    items = outcomes(spark, sf).withColumn("row_id", F.col("batch_id") * 1000 + F.col("idx"))
    done = e.withColumn("processed_at", F.col("received_at") + F.make_dt_interval(secs=F.lit(2).cast("decimal(18,6)")))
    return L.lifecycle_entries(
        L.ingest_entries(items, F.col("occurred")),
        L.processed_entries(done, "worker-1"),
        L.failure_entries(e, failures(spark, sf), worker="worker-2"),
        L.replay_entries(replayed(spark, sf)[2]),
    )


def l1_lifecycle_entries(spark, sf):
    return flat(_logs(spark, sf))


def l2_apply_log_mode(spark, sf):
    return flat(L.apply_log_mode(_logs(spark, sf), "errors"), "id", "stage", "level")


def l3_query_event_logs(spark, sf):
    t = Tables(spark, sf)
    page = L.query_event_logs(
        _logs(spark, sf), t.customers, t.campaigns, stage="processed", campaign="camp_013",
        since="2024-01-10 00:00:00", limit=60)
    return flat(page, "id", "created_at", "event_id", "customer", "campaign", "stage", "page_pos", "has_more")


def l3_query_newest_logs(spark, sf):
    """The newest page of all log rows, and the page behind it by its cursor."""
    t = Tables(spark, sf)
    # Written once, as three reads follow: the first page for its cursor, and both for the answer.
    logs = settle(_logs(spark, sf).select("id", "created_at", "event_id", "customer_id", "campaign_id", "stage"), "logs")
    first = L.query_event_logs(logs, t.customers, t.campaigns, limit=50)
    last = first.orderBy(F.col("page_pos").desc()).first()
    second = L.query_event_logs(logs, t.customers, t.campaigns, cursor=(last.created_at, last.id), limit=50)
    both = first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))
    return flat(both, "page", "page_pos", "id", "created_at", "stage", "event_id")


def l3_query_unknown_customer(spark, sf):
    t = Tables(spark, sf)
    return flat(L.query_event_logs(_logs(spark, sf), t.customers, t.campaigns, customer="cust_none"), "id", "stage")


def l4_min_level(spark, sf):
    return flat(_logs(spark, sf).where(L.min_level("warn")), "id", "stage", "level", "message")


def l5_prune(spark, sf):
    return flat(L.prune(_logs(spark, sf), 14, AS_OF), "id", "created_at")


def l5_prune_stored(spark, sf):
    """The same retention on stored logs: a version without the older day folders."""
    base = shared_path(spark, "logs")
    store.publish(spark, {"event_logs": _logs(spark, sf)}, base)
    store.prune(spark, base, "event_logs", 14, AS_OF)
    return flat(store.tables(spark, base)["event_logs"], "id", "created_at")


def _activity(spark, sf):
    return L.activity_records(X.access_log(spark, sf))


def l6_activity_records(spark, sf):
    return flat(_activity(spark, sf))


def l7_query_activity(spark, sf):
    page = L.query_activity(_activity(spark, sf), action="customer.", outcome="error", since="2024-01-05 00:00:00",
                            limit=40)
    return flat(page, "id", "created_at", "action", "status", "entity", "page_pos", "has_more")


def l9_list_dlq(spark, sf):
    return flat(L.list_dlq(dlq(spark, sf), after=100, limit=20), "id", "event_id", "error", "failed_at", "has_more")


def l10_health_report(spark, sf):
    letters, events, _ = replayed(spark, sf)
    return flat(H.health_report(events, letters, outcomes(spark, sf), AS_OF))


def l11_trace_event_stored(spark, sf):
    """The same lookup on stored logs, whose Bloom filters and order spare most row groups."""
    t, base = Tables(spark, sf), shared_path(spark, "logs")
    store.publish(spark, {"event_logs": _logs(spark, sf)}, base)
    logs = store.tables(spark, base)["event_logs"].drop("event_day")
    out = L.trace_event(logs, t.customers, t.campaigns, request_id="req-3")
    return flat(out, "id", "created_at", "event_id", "stage", "attempt", "customer", "campaign")


def l11_trace_event(spark, sf):
    """All log rows of the events of one request."""
    t = Tables(spark, sf)
    out = L.trace_event(_logs(spark, sf), t.customers, t.campaigns, request_id="req-3")
    return flat(out, "id", "created_at", "event_id", "stage", "attempt", "customer", "campaign")


QUERIES = {
    f.__name__: f
    for f in (
        l1_lifecycle_entries, l2_apply_log_mode, l3_query_event_logs, l3_query_newest_logs, l3_query_unknown_customer, l4_min_level, l5_prune,
        l5_prune_stored, l11_trace_event_stored,
        l6_activity_records, l7_query_activity, l9_list_dlq, l10_health_report, l11_trace_event,
    )
}

LOGS = """
lg AS (
  SELECT ((batch_id * 1000 + idx)::HUGEINT * 17179869184 + (CASE outcome WHEN 'accepted' THEN 0 ELSE 1 END)::HUGEINT * 2147483648 + 0) AS id, occurred_at AS created_at,
    event_id, cust AS customer_id, camp AS campaign_id,
    CASE outcome WHEN 'accepted' THEN 'ingested' ELSE 'duplicate' END AS stage, 'info' AS level,
    CASE outcome WHEN 'accepted' THEN 'event accepted' ELSE 'duplicate event_id ignored' END AS message, request_id,
    '' AS worker, -1 AS attempt, '{"channel":"' || channel || '","type":"' || type || '"}' AS details
  FROM oc WHERE outcome <> 'rejected'
  UNION ALL
  SELECT ((id)::HUGEINT * 17179869184 + 2::HUGEINT * 2147483648 + 1), received_at + to_seconds(2), event_id, customer_id, campaign_id, 'processed', 'info',
    'event applied to profile and campaign metrics', request_id, 'worker-1', 1,
    '{"type":"' || type || '","channel":"' || channel || '"}'
  FROM pe
  UNION ALL
  SELECT ((id)::HUGEINT * 17179869184 + (CASE WHEN k % 5 = 0 THEN 4 ELSE 3 END)::HUGEINT * 2147483648 + k), at_, event_id, customer_id, campaign_id,
    CASE WHEN k % 5 > 0 THEN 'retry' ELSE 'dead_lettered' END, CASE WHEN k % 5 > 0 THEN 'warn' ELSE 'error' END,
    CASE WHEN k % 5 > 0 THEN 'processing failed; will retry' ELSE 'retries exhausted; moved to dead-letter queue' END,
    request_id, 'worker-2', (k - 1) % 5 + 1, '{"error":"timeout ' || k || '"}'
  FROM fl JOIN ev USING (id)
  UNION ALL
  SELECT ((dq.id)::HUGEINT * 17179869184 + 5::HUGEINT * 2147483648 + 0), TIMESTAMP '2024-01-31', dq.event_id, customer_id, campaign_id, 'replayed', 'info',
    'dead-lettered event replayed by operator', coalesce(request_id, ''), '', -1,
    '{"dlq_id":' || dq.id || ',"replay_request_id":"req-ops"}'
  FROM dq LEFT JOIN ev USING (event_id) WHERE dq.id % 2 = 0)"""

ACTIVITY = """
acc AS (
  SELECT event_id AS id, ts AS created_at, 'req-' || (event_id // 50) AS request_id, event_id % 16 AS w,
    'cust_' || lpad(user_id::VARCHAR, 5, '0') AS who, event_id AS i, props
  FROM events),
rt AS (
  SELECT * FROM (VALUES (0, 'POST', '/api/v1/events', 'events.ingest'),
    (1, 'GET', '/api/v1/customers/:id', 'customer.view'),
    (2, 'GET', '/api/v1/customers/:id/timeline', 'customer.timeline'),
    (3, 'GET', '/api/v1/campaigns', 'campaign.list'),
    (4, 'GET', '/api/v1/campaigns/:id/analytics', 'campaign.analytics'),
    (5, 'POST', '/api/v1/audience/recommend', 'audience.recommend'),
    (6, 'POST', '/api/v1/campaigns/:id/analyze', 'ai.analyze'),
    (7, 'POST', '/api/v1/campaigns/:id/recommend', 'ai.recommend'),
    (8, 'POST', '/api/v1/predictions/channel', 'prediction.channel'),
    (9, 'GET', '/api/v1/system/dlq', 'dlq.list'),
    (10, 'POST', '/api/v1/system/dlq/:id/replay', 'dlq.replay'),
    (14, 'DELETE', '/api/v1/things/:id', 'DELETE /api/v1/things/:id'),
    (15, 'GET', '', 'unknown')) t(w, method, route, action)),
act AS (
  SELECT id, created_at, action, method, CASE WHEN route = '' THEN '/api/v1/nope' ELSE replace(route, ':id', who) END AS path,
    CASE WHEN i % 40 = 0 THEN 500 WHEN i % 40 = 1 THEN 503 WHEN i % 40 < 5 THEN 404 WHEN i % 40 < 8 THEN 400 ELSE 200 END
      AS status, i % 97 AS latency_ms, request_id, route,
    CASE WHEN contains(route, ':id') THEN who ELSE '' END AS entity, '10.0.0.' || (i % 200) AS client_ip,
    CASE WHEN i % 5 = 0 THEN 'ok' ELSE '' END AS summary,
    CASE WHEN i % 9 = 0 THEN 'q=' || repeat('x', 498) || '…' ELSE 'k=' || props END AS query,
    CASE WHEN i % 14 = 0 THEN left(repeat('agent ', 60), 200) || '…' ELSE 'test-agent' END AS user_agent,
    CASE WHEN i % 40 = 1 THEN 'unavailable: postgres' WHEN i % 40 = 0 THEN 'internal error' ELSE '' END AS error
  FROM acc JOIN rt USING (w) WHERE i % 53 <> 0)"""

_L = (*EV, INBOUND, FAILS, DLQ, LOGS)

ORACLES = {
    "l1_lifecycle_entries": sql(
        """SELECT id::VARCHAR AS id, epoch_us(created_at) AS created_at, event_id, coalesce(customer_id, -1) AS customer_id,
          coalesce(campaign_id, -1) AS campaign_id, stage, level, message, request_id, worker, attempt, details
        FROM lg""", *_L),
    "l2_apply_log_mode": sql(
        "SELECT id::VARCHAR AS id, stage, level FROM lg WHERE stage IN ('retry', 'dead_lettered', 'replayed')", *_L),
    "l3_query_event_logs": sql(
        """SELECT lg.id::VARCHAR AS id, epoch_us(lg.created_at) AS created_at, event_id, cu.ext AS customer, ca.ext AS campaign, stage,
          row_number() OVER (ORDER BY lg.created_at DESC, lg.id DESC) AS page_pos, (count(*) OVER () > 60)::BIGINT AS has_more
        FROM lg LEFT JOIN cu ON cu.id = customer_id LEFT JOIN ca ON ca.id = campaign_id
        WHERE stage = 'processed' AND campaign_id = 13 AND lg.created_at >= TIMESTAMP '2024-01-10'
        ORDER BY page_pos LIMIT 60""", *_L),
    "l3_query_newest_logs": sql(
        """SELECT (pos - 1) // 50 + 1 AS page, (pos - 1) % 50 + 1 AS page_pos, id::VARCHAR AS id,
          epoch_us(created_at) AS created_at, stage, event_id
        FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos FROM lg) WHERE pos <= 100""", *_L),
    "l3_query_unknown_customer": "SELECT event_id::VARCHAR AS id, props AS stage FROM events WHERE false",
    "l4_min_level": sql("SELECT id::VARCHAR AS id, stage, level, message FROM lg WHERE level IN ('warn', 'error')", *_L),
    "l5_prune": sql(
        """SELECT id::VARCHAR AS id, epoch_us(created_at) AS created_at FROM lg
        WHERE NOT created_at < TIMESTAMP '2024-01-31' - to_days(14)""", *_L),
    "l6_activity_records": sql("SELECT * REPLACE (epoch_us(created_at) AS created_at) FROM act", ACTIVITY),
    "l7_query_activity": sql(
        """SELECT id, epoch_us(created_at) AS created_at, action, status, entity,
          row_number() OVER (ORDER BY created_at DESC, id DESC) AS page_pos, (count(*) OVER () > 40)::BIGINT AS has_more
        FROM act WHERE starts_with(action, 'customer.') AND status >= 400 AND created_at >= TIMESTAMP '2024-01-05'
        ORDER BY page_pos LIMIT 40""", ACTIVITY),
    "l9_list_dlq": sql(
        """SELECT id, event_id, CASE WHEN id >= 1000000000 THEN 'bad row' ELSE 'profile update timed out' END AS error,
          epoch_us(failed_at) AS failed_at, (count(*) OVER () > 20)::BIGINT AS has_more
        FROM dq WHERE id > 100 ORDER BY id LIMIT 20""", *EV, DLQ),
    "l10_health_report": sql(
        """SELECT count(*) FILTER (back) AS pending_events, count(*) FILTER (status = 'processed') AS processed_events,
          count(*) FILTER (status = 'failed' AND NOT back) AS failed_events, 0 AS duplicate_events,
          round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(received_at) FILTER (back))) / 1e6, 6)
            AS oldest_pending_seconds,
          count(*) FILTER (back OR attempts = 0) AS attempts_0, 0 AS attempts_1, 0 AS attempts_2, 0 AS attempts_3,
          0 AS attempts_4, count(*) FILTER (attempts = 5 AND NOT back) AS attempts_5_up,
          (SELECT count(*) FROM dq) AS dlq_size, (SELECT count(*) FROM dq WHERE id % 2 = 1) AS dlq_open,
          (SELECT round(avg((outcome = 'accepted')::INT), 6) FROM oc) AS accepted_rate,
          (SELECT round(avg((outcome = 'duplicate')::INT), 6) FROM oc) AS duplicate_rate,
          (SELECT round(avg((outcome = 'rejected')::INT), 6) FROM oc) AS rejected_rate
        FROM rep""", *EV, INBOUND, DLQ),
    "l11_trace_event": sql(
        """SELECT lg.id::VARCHAR AS id, epoch_us(lg.created_at) AS created_at, event_id, stage, attempt, coalesce(cu.ext, '') AS customer,
          coalesce(ca.ext, '') AS campaign
        FROM lg LEFT JOIN cu ON cu.id = customer_id LEFT JOIN ca ON ca.id = campaign_id
        WHERE request_id = 'req-3'""", *_L),
}
ORACLES["l5_prune_stored"] = ORACLES["l5_prune"]
ORACLES["l11_trace_event_stored"] = ORACLES["l11_trace_event"]
