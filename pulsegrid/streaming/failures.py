"""Failed attempts as a stream: attempts are counted in keyed state, dead letters leave it.

The state of an event is its open round: how many attempts failed. The last allowed failure emits the
dead letter and closes the round, so a replayed event counts from the beginning and an event that is
given up holds no state. Failures of an event come in the order of their time, as its attempts do; those of
one micro-batch are put in order here.

Events are keyed by bucket: a call of the processor for each event would cost more than its failures. A
bucket's open rounds are one value, and its failures of a micro-batch are counted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid import vocab as V

# A checkpoint belongs to its number of buckets.
BUCKETS = 1024
# Bucket of failures without an event's id.
NO_ID = -1
STATE = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("attempts", T.BinaryType())])
OUTPUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("attempts", T.LongType()), T.StructField("last_error", T.StringType()),
    T.StructField("failed_at_us", T.LongType()),
])


def bucket_rounds(open_: pd.Series, rows: pd.DataFrame, max_attempts: int) -> tuple[pd.Series, pd.DataFrame]:
    """(attempts of the rounds left open by id, the failures that end a round) of many events' next failures."""
    rows = rows.sort_values(["id", "us", "error"], na_position="first")
    number = rows.groupby("id").cumcount() + 1 + rows["id"].map(open_).fillna(0)
    left = open_.add(rows.groupby("id").size(), fill_value=0).astype("int64") % max_attempts
    return left[left > 0], rows[(number % max_attempts == 0).to_numpy()]


def rounds(open_attempts: int, rows: pd.DataFrame, max_attempts: int) -> tuple[int, pd.DataFrame]:
    """(attempts of the round left open, the failures that end a round) of an event's next failures."""
    left, last = bucket_rounds(pd.Series({0: open_attempts}), rows.assign(id=0), max_attempts)
    return int(left.get(0, 0)), last


class FailureProcessor(StatefulProcessor):
    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rounds", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, attempts = self.state.get() if self.state.exists() else (b"", b"")
        open_ = pd.Series(np.frombuffer(attempts, "<i8"), index=np.frombuffer(ids, "<i8"))
        # The rows of a bucket are held together to be ordered: its share of one micro-batch.
        open_, last = bucket_rounds(open_, pd.concat(list(rows)), self.max_attempts)
        if len(open_):
            self.state.update((open_.index.to_numpy("<i8").tobytes(), open_.to_numpy("<i8").tobytes()))
        else:
            self.state.clear()
        yield pd.DataFrame({"id": [None] * len(last) if key[0] == NO_ID else last["id"].to_numpy(),
                            "attempts": self.max_attempts, "last_error": last["error"].to_numpy(),
                            "failed_at_us": last["us"].to_numpy()}, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def live_dead_letters(failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """One row for each round of failures that is used up, from a stream of (id, attempted_at, error)."""
    bucket = F.when(F.col("id").isNull(), NO_ID).otherwise(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    rows = failures.select(bucket.alias("bucket"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), "error",
                           F.unix_micros("attempted_at").alias("us"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FailureProcessor(max_attempts), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def failed_rounds(letters: DataFrame) -> DataFrame:
    """What the stream wrote, as rows of ``failure_rounds`` that ``dead_letters`` takes."""
    return letters.select("id", "attempts", "last_error", F.timestamp_micros("failed_at_us").alias("failed_at"),
                          F.lit("failed").alias("status"))
