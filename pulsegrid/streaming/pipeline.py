"""Event batches from a stream into the derived tables, one micro-batch at a time.

Every micro-batch writes its own ``load`` partition of each table and replaces it when it is
run again, so the at-least-once delivery of ``foreachBatch`` changes nothing. Nothing is ever
updated in place: profiles and daily counts are sums over the loads, made on read, and
``compact`` folds old loads into a base.

Whether an id is stored is asked of a bit filter first, of bounded size and written anew by each load;
only the buckets of ids that it cannot rule out are read, so a load without repeats reads no older ids.
The answer is exact: an over-full filter only lets more buckets be read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import ingest as I
from pulsegrid.operators import logs as L
from pulsegrid.operators import profiles as P
from pulsegrid.operators.rollups import campaign_daily, derive_sends, merge_daily
from pulsegrid.sources.batches import malformed_batches, split_batches, stream_batch_files

BUCKETS = 64
# Bits of each bucket's filter, and how many of them an id sets: ample for half a million ids in all buckets.
FILTER_BITS = 1 << 18
FILTER_HASHES = 6
WRITERS = 4
_PARTITIONS = 1 << 14
_ROWS = 1 << 26


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def _row_ids(load: int) -> Column:
    """Ids growing with the load. The bounds are checked, so no two rows can share an id."""
    serial = F.monotonically_increasing_id()
    task, row = F.shiftright(serial, 33), F.expr("monotonically_increasing_id() & 8589934591")
    fits = (task < _PARTITIONS) & (row < _ROWS)
    return F.when(fits, F.lit(load).cast("long") * (_PARTITIONS * _ROWS) + task * _ROWS + row).otherwise(
        F.raise_error(F.lit("micro-batch too large for row ids")).cast("long")
    )


class EngagementPipeline:
    """Tables under ``base``, fed by ``process`` for each micro-batch of (batch_id, body)."""

    def __init__(self, spark: SparkSession, base: str, customers: DataFrame, campaigns: DataFrame,
                 clock: Callable[[], datetime] = _utc_now, log_mode: str = "all",
                 on_events: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.customers, self.campaigns = customers, campaigns
        self.clock, self.log_mode, self.on_events = clock, log_mode, on_events

    def start(self, source: str, checkpoint: str, files_per_trigger: int = 1000, **trigger):
        """Follow a folder of batch files; by default take what is there and stop."""
        return self.follow(stream_batch_files(self.spark, source, files_per_trigger), checkpoint, **trigger)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Follow any stream of (batch_id, body): batch files, a batch log, a topic."""
        return (
            stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def _write(self, df: DataFrame, table: str, load: int, *by: str) -> None:
        """Replace the load's own partition; the mode is dynamic whatever the session says.

        Rows go to their folder's writers first, several for each folder, so that neither many
        small files nor one writer of a busy day come of it.
        """
        out = df.withColumn("load", F.lit(load))
        if by:
            out = out.repartition(*by, F.pmod(F.xxhash64("event_id"), F.lit(WRITERS)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", *by).parquet(
            f"{self.base}/{table}"
        )

    def table(self, name: str) -> DataFrame | None:
        """A table, or None before its first row is written; any other failure to read is raised."""
        try:
            return self.spark.read.parquet(f"{self.base}/{name}")
        except AnalysisException as err:
            # A load without rows leaves a folder without files, hence without a schema.
            if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _written(self, name: str, load: int, as_planned: DataFrame) -> DataFrame:
        """The rows of a load, read back; an empty load has the planned columns."""
        rows = self.table(name)
        return as_planned.where(F.lit(False)) if rows is None else rows.where(F.col("load") == load).drop("load")

    def _stored_ids(self, load: int, posted: DataFrame) -> DataFrame:
        """Ids of earlier loads that this batch posts again. Only buckets with a possible repeat are read."""
        keys = posted.select("event_id").where("event_id IS NOT NULL").distinct().withColumn("bucket", self._bucket())
        none = keys.where(F.lit(False)).select("event_id")
        bits = self._filter(load)
        if bits is None:
            return none
        place = F.bitmap_bit_position("cell")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.bit_get(byte, (place % 8).cast("int")) == 1, F.lit(False))
        maybe = self._cells(keys).join(bits, ["bucket", "chunk"], "left").groupBy("bucket", "event_id").agg(
            F.bool_and(hit).alias("all_set")).where("all_set").drop("all_set").persist()
        try:
            buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]
            if not buckets:
                return none
            ids = self.table("event_ids").where((F.col("load") < load) & F.col("bucket").isin(*buckets))
            return ids.join(maybe, ["bucket", "event_id"], "left_semi").select("event_id")
        finally:
            maybe.unpersist()

    def _cells(self, ids: DataFrame) -> DataFrame:
        """The bits that an id sets in its bucket's filter: (bucket, event_id, cell, chunk)."""
        cells = F.array(*[F.xxhash64("event_id", F.lit(i)).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) + 1
                          for i in range(1, FILTER_HASHES + 1)])
        return ids.select("bucket", "event_id", F.explode(cells).alias("cell")).withColumn("chunk", F.bitmap_bucket_number("cell"))

    def _filter(self, load: int) -> DataFrame | None:
        """Bits of all ids stored before a load: (bucket, chunk, bits)."""
        versions = self.table("id_filters")
        newest = None if versions is None else versions.where(F.col("load") < load).agg(F.max("load").alias("m")).first().m
        return None if newest is None else versions.where(F.col("load") == newest).drop("load")

    def _write_filter(self, load: int, ids: DataFrame) -> None:
        """The bits of earlier loads and of this one, as this load's version."""
        bits = self._cells(ids).groupBy("bucket", "chunk").agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
        before = self._filter(load)
        if before is not None:
            bits = bits.unionByName(before).groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
        self._write(bits, "id_filters", load)

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")

    def process(self, batch: DataFrame, load: int) -> None:
        """One micro-batch. The posted files are read once for the two steps that need them."""
        batch = batch.persist()
        try:
            self._process(batch, load)
        finally:
            batch.unpersist()

    def _process(self, batch: DataFrame, load: int) -> None:
        now = F.lit(self.clock()).cast("timestamp")
        self._write(malformed_batches(batch), "refused_batches", load)
        items = I.parse_items(split_batches(batch))
        if "request_id" not in items.columns:
            items = items.withColumn("request_id", F.concat(F.lit("batch-"), F.hex("batch_id")))
        # Kept for the three reads that follow: the asked ids, the claims and the rows. Parsing costs most of a load.
        items = I.resolve_dimensions(I.validate_events(items, now), self.customers, self.campaigns).persist()
        try:
            # Written once and read back: later steps see the same ids, and a lost executor only
            # re-reads files.
            outcomes = I.dedup_events(items, self._stored_ids(load, items)).withColumn("id", _row_ids(load))
            self._write(outcomes, "outcomes", load)
        finally:
            items.unpersist()
        mine = self._written("outcomes", load, outcomes)
        events = I.accepted_events(mine, now, "id").withColumns(
            {"status": F.lit("processed"), "processed_at": now}
        )
        self._write(events.withColumn("event_day", F.to_date("occurred_at")), "events", load, "event_day")
        done = self._written("events", load, events).drop("event_day")
        self._write(P.profile_partials(done, now), "profile_cells", load)
        self._write(campaign_daily(done), "campaign_daily", load)
        self._write(derive_sends(done), "sends", load)
        entries = L.lifecycle_entries(
            L.ingest_entries(mine.withColumn("row_id", F.col("id")), now), L.processed_entries(done)
        )
        self._write(L.apply_log_mode(entries, self.log_mode), "event_logs", load)
        if self.on_events is not None:
            self.on_events(done, load)
        latest = done.groupBy("customer_id").agg(F.max("occurred_at").alias("last_event_at"))
        self._write(latest, "customer_last", load)
        # Last, so that a load counts as stored only when all of it is; the filter knows no id before its row is there.
        ids = done.select("event_id", self._bucket().alias("bucket"))
        self._write(ids, "event_ids", load, "bucket")
        self._write_filter(load, ids)

    def compact(self, table: str, upto: int, as_of) -> None:
        """Fold the loads up to ``upto`` into one base partition; a reader finds the newest."""
        merged = self._merged(table, as_of, upto)
        merged.withColumn("upto", F.lit(upto)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(f"{self.base}/{table}_base")

    def _merged(self, table: str, as_of, upto: int | None = None) -> DataFrame:
        rows, base = self.table(table), self.table(f"{table}_base")
        if upto is not None:
            rows = rows.where(F.col("load") <= upto)
            base = base if base is None else base.where(F.col("upto") <= upto)
        if base is not None:
            newest = base.agg(F.max("upto").alias("m")).first().m
            if newest is not None:
                rows = rows.where(F.col("load") > newest).drop("load").unionByName(
                    base.where(F.col("upto") == newest).drop("upto"))
        rows = rows.drop("load")
        return merge_daily(rows) if table == "campaign_daily" else P.merge_cells(rows)

    def current_customers(self) -> DataFrame:
        """Customers with their recency marker moved forward by all loads, never back."""
        rows = self.table("customer_last")
        if rows is None:
            return self.customers
        latest = rows.groupBy(F.col("customer_id").alias("id")).agg(F.max("last_event_at").alias("_new"))
        return self.customers.join(latest, "id", "left").withColumn("last_event_at", F.greatest("last_event_at", "_new")).drop("_new")

    def daily(self) -> DataFrame:
        return self._merged("campaign_daily", None)

    def profiles(self, as_of) -> DataFrame:
        """Profiles at ``as_of``, which must not lie before the last load."""
        now = S.as_ts(as_of)
        recent = self.table("events").where(F.col("event_day") >= F.date_sub(F.to_date(now), 15))
        return P.profiles_from_cells(self._merged("profile_cells", now), now, P.activity_trend(recent, now))
