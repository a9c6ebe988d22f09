"""Failed processing: retries, dead letters, replay and stuck events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S

FAILURES_PER_TASK = 200_000


def select_unprocessed(events: DataFrame) -> DataFrame:
    """Events still to be applied; a terminal status is never applied again."""
    return events.where(~F.col("status").isin(*V.TERMINAL_STATUSES))


def failed_attempts(failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Failures with their ``round`` (from 0) and ``attempt`` in it (from 1).

    An event is dead-lettered by its last allowed attempt and only tried again after a replay,
    which counts from the beginning; so every ``max_attempts`` failures are one round.
    """
    order = Window.partitionBy("id").orderBy("attempted_at", "error")
    nth = F.row_number().over(order) - 1
    # Every failure is sorted: partitions by their number, so that a task's sort does not grow with the input.
    parts = failures.count() // FAILURES_PER_TASK + 1
    return failures.repartition(parts, "id").withColumn("_nth", nth).withColumns({
        "round": F.expr(f"_nth div {int(max_attempts)}"), "attempt": F.col("_nth") % max_attempts + 1}).drop("_nth")


def classify_failures(failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Per event: attempts of its last round, last error and the status it ends in."""
    return _round_ends(failures, max_attempts).where("_last").drop("round", "_last")


def failure_rounds(failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Per event and round of attempts the same; a round that ends in ``failed`` left a dead letter."""
    return _round_ends(failures, max_attempts).where(F.col("_last") | (F.col("status") == "failed")).drop("_last")


def _round_ends(failures: DataFrame, max_attempts: int) -> DataFrame:
    """Failures as ends of their rounds; ``_last`` marks an event's newest. In order, the end of a round holds all
    that is told of it, so the order of ``failed_attempts`` is the only sort and no aggregate follows it."""
    size = F.count("*").over(Window.partitionBy("id"))
    rows = failed_attempts(failures, max_attempts).withColumn("_size", size)
    return rows.select(
        "id", "round", F.col("attempt").alias("attempts"), F.col("error").alias("last_error"),
        F.col("attempted_at").alias("failed_at"), F.when(F.col("attempt") >= max_attempts, "failed").otherwise("pending").alias("status"),
        (F.col("round") * max_attempts + F.col("attempt") == F.col("_size")).alias("_last"),
    )


def dead_letters(events: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows for the dead-letter table, payload kept for a replay: one for each failed row of
    ``failure_rounds`` (or of ``classify_failures``, which knows the last round only)."""
    done = classified.where(F.col("status") == "failed").select("id", "attempts", "last_error", "failed_at")
    return events.select("id", "event_id", "payload").join(done, "id").select(
        "id", "event_id", "payload", F.col("last_error").alias("error"), "attempts", "failed_at",
        F.lit(None).cast("timestamp").alias("replayed_at"),
    )


def replay_dlq(dlq: DataFrame, events: DataFrame, ids: DataFrame, as_of,
               replay_request_id: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dead letters stamped, events put back to pending, replayed rows for the log).

    Only a failed event goes back; a dead letter without an event is stamped all the same.
    """
    now = S.as_ts(as_of)
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    stamped = (
        dlq.join(chosen, "id", "left")
        .withColumn("replayed_at", F.when(F.col("_chosen"), now).otherwise(F.col("replayed_at"))).drop("_chosen")
    )
    replayed = dlq.join(chosen, "id", "left_semi")
    targets = replayed.where(F.col("event_id").isNotNull()).select("event_id").distinct().withColumn("_hit", F.lit(True))
    back = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "failed")
    updated = (
        events.join(targets, "event_id", "left")
        .withColumns({
            "attempts": F.when(back, 0).otherwise(F.col("attempts")),
            "status": F.when(back, "pending").otherwise(F.col("status")),
        })
        .drop("_hit")
    )
    facts = events.select("event_id", "customer_id", "campaign_id", "request_id")
    log = replayed.select(F.col("id").alias("dlq_id"), "event_id").join(facts, "event_id", "left").select(
        F.col("dlq_id").alias("row_id"), now.alias("created_at"), "event_id", "customer_id", "campaign_id",
        "request_id", F.to_json(F.struct("dlq_id", F.lit(replay_request_id).alias("replay_request_id"))).alias("details"),
    )
    return stamped, updated, log


def stuck_pending(events: DataFrame, as_of, seconds: int = V.STUCK_AFTER_SECONDS,
                  limit: int | None = None) -> DataFrame:
    """Pending events received more than 30 seconds ago; with ``limit`` the oldest ones by id."""
    before = S.as_ts(as_of) - F.expr(f"INTERVAL '{seconds}' SECOND")
    waiting = events.where((F.col("status") == "pending") & (F.col("received_at") < before))
    return waiting if limit is None else waiting.orderBy("id").limit(limit)
