"""Domain tables as parquet folders under one base path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "customers", "campaigns", "events", "events_dlq", "profiles", "profile_cells", "sends", "campaign_daily",
    "event_logs", "activity_logs",
)
# Facts are laid out by day; ``from_day`` turns a time bound into one on the folders.
DAY_OF = {"events": "occurred_at", "sends": "sent_at", "event_logs": "created_at", "activity_logs": "created_at"}


def write_tables(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        if name in DAY_OF:
            # Rows of a day spread over several tasks, so that a busy day is no single writer.
            df = df.withColumn("event_day", F.to_date(DAY_OF[name]))
            df.repartition("event_day", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(8))).write.mode(mode).partitionBy(
                "event_day"
            ).parquet(f"{base}/{name}")
        elif name == "campaign_daily":
            df.write.mode(mode).partitionBy("day").parquet(f"{base}/{name}")
        else:
            df.write.mode(mode).parquet(f"{base}/{name}")


def from_day(rows: DataFrame, since) -> DataFrame:
    """Without the day folders that lie wholly before ``since``; a table without days is left as it is.

    The caller still filters by time; this only spares the listing and reading of older folders.
    """
    return rows.where(F.col("event_day") >= F.to_date(since)) if "event_day" in rows.columns else rows


def load_tables(spark: SparkSession, base: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
