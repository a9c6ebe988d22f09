"""Lifecycle log of events and activity log of API calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators.deadletter import failed_attempts
from pulsegrid.operators.paging import keyset_page
from pulsegrid.sources.tables import from_day

# Level and message of each stage.
STAGE_TEXT = {
    "ingested": ("info", "event accepted"),
    "duplicate": ("info", "duplicate event_id ignored"),
    "processed": ("info", "event applied to profile and campaign metrics"),
    "retry": ("warn", "processing failed; will retry"),
    "dead_lettered": ("error", "retries exhausted; moved to dead-letter queue"),
    "replayed": ("info", "dead-lettered event replayed by operator"),
}
ENTRY = (
    "id", "created_at", "event_id", "customer_id", "campaign_id", "stage", "level", "message", "request_id", "worker",
    "attempt", "details",
)
NEWEST = [("created_at", "desc"), ("id", "desc")]


def _entries(rows: DataFrame, stage: Column) -> DataFrame:
    """Common form of one step's rows; a zero attempt and empty texts become NULL.

    The id is made of the step's own row number, stage and running number (``nth``, else the attempt):
    a decimal, as rows, loads and failures have no largest number.
    """
    attempt = S.nullif_zero(F.col("attempt").cast("long"))
    number = S.lookup(F.col("stage"), {s: i for i, s in enumerate(V.LOG_STAGES)}, F.lit(7))
    return rows.withColumn("stage", stage).select(
        _entry_id(F.col("row_id"), number, F.coalesce(F.col("nth") if "nth" in rows.columns else attempt, F.lit(0))).alias("id"),
        "created_at", S.nullif_empty(F.col("event_id")).alias("event_id"), "customer_id", "campaign_id", "stage",
        S.lookup(F.col("stage"), {s: t[0] for s, t in STAGE_TEXT.items()}, F.lit("info")).alias("level"),
        S.lookup(F.col("stage"), {s: t[1] for s, t in STAGE_TEXT.items()}, F.lit("")).alias("message"),
        S.nullif_empty(F.col("request_id")).alias("request_id"), S.nullif_empty(F.col("worker")).alias("worker"),
        attempt.alias("attempt"), F.coalesce("details", F.lit("{}")).alias("details"),
    )


def _entry_id(row: Column, stage: Column, nth: Column) -> Column:
    whole = row.cast("decimal(20,0)") * F.lit(8 * (1 << 31)).cast("decimal(12,0)")
    return (whole + (stage.cast("long") * F.lit(1 << 31).cast("long") + nth.cast("long"))).cast("decimal(38,0)")


def _bare(rows: DataFrame) -> DataFrame:
    fill = {"worker": F.lit(""), "attempt": F.lit(0)}
    return rows.withColumns({k: v for k, v in fill.items() if k not in rows.columns})


def ingest_entries(outcomes: DataFrame, created_at: Column) -> DataFrame:
    """ingested / duplicate rows; rejected items are not events and leave none."""
    kept = outcomes.where(F.col("outcome") != "rejected").select(
        "row_id", created_at.alias("created_at"), "event_id", F.col("customer_key").alias("customer_id"),
        F.col("campaign_key").alias("campaign_id"), "request_id", "outcome",
        F.to_json(F.struct("channel", "type")).alias("details"),
    )
    return _entries(_bare(kept), F.when(F.col("outcome") == "accepted", "ingested").otherwise("duplicate"))


def processed_entries(events: DataFrame, worker: str = "") -> DataFrame:
    rows = events.where(F.col("status") == "processed").select(
        F.col("id").alias("row_id"), F.col("processed_at").alias("created_at"), "event_id", "customer_id",
        "campaign_id", "request_id", F.lit(worker).alias("worker"), (F.col("attempts") + 1).alias("attempt"),
        F.to_json(F.struct("type", "channel")).alias("details"),
    )
    return _entries(rows, F.lit("processed"))


def failure_entries(events: DataFrame, failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS,
                    worker: str = "") -> DataFrame:
    """retry rows, and a dead_lettered row for the last allowed attempt of each round."""
    facts = events.select("id", "event_id", "customer_id", "campaign_id", "request_id")
    error = S.truncate_text(F.col("error"), 500)
    rows = failed_attempts(failures, max_attempts).join(facts, "id").select(
        F.col("id").alias("row_id"), F.col("attempted_at").alias("created_at"), "event_id", "customer_id",
        "campaign_id", "request_id", F.lit(worker).alias("worker"), "attempt",
        (F.col("round") * max_attempts + F.col("attempt")).alias("nth"), F.to_json(F.struct(error.alias("error"))).alias("details"),
    )
    return _entries(rows, F.when(F.col("attempt") >= max_attempts, "dead_lettered").otherwise("retry"))


def replay_entries(replayed: DataFrame) -> DataFrame:
    return _entries(_bare(replayed), F.lit("replayed"))


def lifecycle_entries(*steps: DataFrame) -> DataFrame:
    """All steps in one table."""
    return reduce(DataFrame.unionByName, steps)


def apply_log_mode(entries: DataFrame, mode: str) -> DataFrame:
    """all, errors (retry, dead_lettered, replayed) or off."""
    if mode == "all":
        return entries
    if mode == "errors":
        # Equalities, not a list: Spark evaluates them on a step's fixed stages and leaves out the steps without any.
        return entries.where(reduce(Column.__or__, [F.col("stage") == s for s in V.ERROR_MODE_STAGES]))
    return entries.where(F.lit(False))


def min_level(level: str) -> Column:
    """The level is a minimum: warn keeps warn and error."""
    if level not in V.LOG_LEVELS:
        raise ValueError("invalid level filter")
    return F.col("level").isin(*V.LOG_LEVELS[V.LOG_LEVELS.index(level):])


def filter_event_logs(logs: DataFrame, customers: DataFrame, campaigns: DataFrame, event_id: str | None = None,
                      request_id: str | None = None, stage: str | None = None, level: str | None = None,
                      since=None, customer: str | None = None, campaign: str | None = None) -> DataFrame:
    """Only the filters given. External ids become a semi-join: an unknown one gives no rows."""
    if stage and stage not in V.LOG_STAGES:
        raise ValueError("invalid stage filter")
    for name, value in (("event_id", event_id), ("request_id", request_id), ("stage", stage)):
        if value:
            logs = logs.where(F.col(name) == value)
    if level:
        logs = logs.where(min_level(level))
    if since is not None:
        logs = from_day(logs, S.as_ts(since)).where(F.col("created_at") >= S.as_ts(since))
    for dim, ext, key in ((customers, customer, "customer_id"), (campaigns, campaign, "campaign_id")):
        if ext:
            wanted = dim.where(F.col("external_id") == ext).select(F.col("id").alias(key))
            logs = logs.join(wanted, key, "left_semi")
    return logs


def _with_external_ids(page: DataFrame, customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    cu = customers.select(F.col("id").alias("customer_id"), F.col("external_id").alias("customer"))
    ca = campaigns.select(F.col("id").alias("campaign_id"), F.col("external_id").alias("campaign"))
    return page.join(cu, "customer_id", "left").join(ca, "campaign_id", "left")


def query_event_logs(logs: DataFrame, customers: DataFrame, campaigns: DataFrame, cursor: tuple | None = None,
                     limit: int | None = None, **filters) -> DataFrame:
    """A page of log rows, newest first; the cursor is (created_at, id) of the last row seen. The
    dimension joins see the page only."""
    rows = filter_event_logs(logs, customers, campaigns, **filters)
    page = keyset_page(rows, NEWEST, cursor, limit)
    return _with_external_ids(page, customers, campaigns)


def trace_event(logs: DataFrame, customers: DataFrame, campaigns: DataFrame, event_id: str | None = None,
                request_id: str | None = None) -> DataFrame:
    """Whole life of an event, or of a request's events, in order of ``created_at``, ``id``."""
    rows = filter_event_logs(logs, customers, campaigns, event_id=event_id, request_id=request_id)
    return _with_external_ids(rows, customers, campaigns).orderBy("created_at", "id")


def prune(rows: DataFrame, days: int, as_of, column: str = "created_at") -> DataFrame:
    """Rows within the retention; zero or less keeps all."""
    if days <= 0:
        return rows
    since = S.as_ts(as_of) - F.expr(f"INTERVAL '{days}' DAY")
    return from_day(rows, since).where(F.col(column) >= since)


def action_for(method: Column, route: Column) -> Column:
    """Name of an operation; an unlisted route keeps method and route, no route is unknown."""
    call = F.concat(method, F.lit(" "), route)
    known = S.lookup(call, {f"{m} {r}": a for (m, r), a in V.ACTIONS.items()}, call)
    return F.when(route == "", "unknown").otherwise(known)


def activity_records(access_log: DataFrame) -> DataFrame:
    """API calls worth recording, with bounded texts; empty texts become NULL."""
    error = F.when((F.col("error") == "") & (F.col("status") >= 500), "internal error").otherwise(F.col("error"))
    texts = ("request_id", "route", "entity", "client_ip", "summary")
    return (
        access_log.where(F.col("path").startswith("/api/"))
        .withColumn("action", action_for(F.col("method"), F.col("route")))
        .where(~F.col("action").isin(*V.UNRECORDED_ACTIONS))
        .select(
            "id", "created_at", "action", "method", "path", "status", "latency_ms",
            *[S.nullif_empty(F.col(c)).alias(c) for c in texts],
            S.nullif_empty(S.truncate_text(F.col("query"), V.MAX_QUERY_BYTES)).alias("query"),
            S.nullif_empty(S.truncate_text(F.col("user_agent"), V.MAX_AGENT_BYTES)).alias("user_agent"),
            S.nullif_empty(error).alias("error"),
        )
    )


def filter_activity(records: DataFrame, action: str | None = None, entity: str | None = None,
                    request_id: str | None = None, outcome: str | None = None, since=None) -> DataFrame:
    """Only the filters given; an action ending in a dot is a prefix."""
    if action:
        col = F.col("action")
        records = records.where(col.startswith(action) if action.endswith(".") else col == action)
    if entity:
        records = records.where(F.col("entity") == entity)
    if request_id:
        records = records.where(F.col("request_id") == request_id)
    if outcome == "ok":
        records = records.where(F.col("status") < 400)
    elif outcome == "error":
        records = records.where(F.col("status") >= 400)
    elif outcome:
        raise ValueError("outcome must be ok or error")
    if since is not None:
        records = from_day(records, S.as_ts(since)).where(F.col("created_at") >= S.as_ts(since))
    return records


def query_activity(records: DataFrame, cursor: tuple | None = None, limit: int | None = None, **filters) -> DataFrame:
    """A page of activity, newest first; the cursor is (created_at, id)."""
    return keyset_page(filter_activity(records, **filters), NEWEST, cursor, limit)


def list_dlq(dlq: DataFrame, after: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of dead letters by id."""
    return keyset_page(dlq, [("id", "asc")], None if after is None else (after,), limit)
