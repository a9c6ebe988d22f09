"""Event batches as posted: JSON documents {"events": [...]}, read from files or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The reply to a request that cannot be read as a batch.
MALFORMED = "malformed request body"
# Posted bodies kept many to a file, as a topic keeps them by key and value.
BATCH_LOG = "batch_id long, body string"


def read_batch_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (batch_id, body). Files arrive in no defined order, nor do requests."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.xxhash64("_metadata.file_path").alias("batch_id"), F.col("value").alias("body"))


def stream_batch_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream. A Kafka topic gives the same columns from its key and value."""
    text = (
        spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).text(path)
    )
    return text.select(F.xxhash64("_metadata.file_path").alias("batch_id"), F.col("value").alias("body"))


def write_batch_log(batches: DataFrame, path: str) -> None:
    """Bodies (batch_id, body), many to a file: a file for each body costs more than its items do."""
    batches.select("batch_id", "body").write.parquet(path)


def read_batch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH_LOG).parquet(path)


def stream_batch_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(BATCH_LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _events(body: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$.events", "array<variant>")


def _with_error(batches: DataFrame) -> DataFrame:
    """A batch is taken or refused as a whole before its items are looked at."""
    return batches.withColumn("_events", _events(F.col("body"))).withColumn(
        "batch_error", F.when(F.col("_events").isNull(), MALFORMED))


def malformed_batches(batches: DataFrame) -> DataFrame:
    """Batches that are no JSON or have no ``events`` array; a batch may hold any number of events."""
    return _with_error(batches).where(F.col("batch_error").isNotNull()).drop("_events")


def split_batches(batches: DataFrame) -> DataFrame:
    """One row per item (batch_id, idx, item); items stay raw, so one bad item fails alone.

    Further columns are carried along. Where two bodies can share a batch_id (a Kafka key, a hash of the
    body), give each a ``post_id`` of its own, such as a hash of topic, partition and offset:
    ``dedup_events`` tells their items apart by it.
    """
    others = [c for c in batches.columns if c != "body"]
    # A refused body has no events, hence no rows. Filters on them would parse each body again.
    return batches.select(*others, F.posexplode(_events(F.col("body"))).alias("idx", "item"))


def read_event_batches(spark: SparkSession, path: str, log: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, malformed batches) of the files under ``path``: one body each, or with ``log`` a batch log."""
    batches = read_batch_log(spark, path) if log else read_batch_files(spark, path)
    return split_batches(batches), malformed_batches(batches)


def read_replay_file(spark: SparkSession, path: str, log: bool = False) -> DataFrame:
    """Items of a batch file, or with ``log`` of a batch log, that is posted again."""
    return split_batches(read_batch_log(spark, path) if log else read_batch_files(spark, path))


def batch_bodies(items: DataFrame, fields: list[str], size: int = 50) -> DataFrame:
    """Items (batch_id, idx, fields...) as JSON bodies of at most ``size`` items each."""
    if size <= 0:
        raise ValueError("a body holds at least one item")
    part = F.expr(f"idx div {size}")
    doc = F.struct(*[F.col(c) for c in fields])
    return (
        items.groupBy("batch_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", doc.alias("d")))).alias("_l"))
        .select("batch_id", "part", F.to_json(F.struct(F.col("_l.d").alias("events"))).alias("body"))
    )
