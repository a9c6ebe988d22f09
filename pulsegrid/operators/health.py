"""Pipeline health as one row of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S


def health_report(events: DataFrame, dlq: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Queue depth, oldest pending age, attempts, dead letters and ingest rates."""
    now = S.as_ts(as_of)
    pending = F.col("status") == "pending"
    state = events.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_events") for s in V.EVENT_STATUSES],
        S.seconds_between(now, F.min(F.when(pending, F.col("received_at")))).alias("oldest_pending_seconds"),
        *[F.count_if(F.col("attempts") == n).alias(f"attempts_{n}") for n in range(V.MAX_ATTEMPTS)],
        F.count_if(F.col("attempts") >= V.MAX_ATTEMPTS).alias(f"attempts_{V.MAX_ATTEMPTS}_up"),
    )
    dead = dlq.agg(F.struct(
        F.count("*").alias("dlq_size"), F.count_if(F.col("replayed_at").isNull()).alias("dlq_open")
    )).scalar()
    kinds = outcomes.agg(F.struct(
        F.count("*").alias("n"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "duplicate", "rejected")],
    )).scalar()
    return state.withColumns({"_d": dead, "_o": kinds}).select(
        *state.columns, "_d.*",
        *[S.rate(F.col(f"_o.{o}"), F.col("_o.n")).alias(f"{o}_rate") for o in ("accepted", "duplicate", "rejected")],
    )
