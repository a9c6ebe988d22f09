import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import deadletter as D
from pulsegrid.streaming import failures as A
from pulsegrid.streaming.live import enable_state_store
from tests.helpers import plan


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40), st.lists(st.integers(0, 40), max_size=4))
def test_any_split_in_time_ends_the_same_rounds(n, cuts):
    rows = pd.DataFrame({"us": range(n), "error": [f"e{i}" for i in range(n)]})
    edges, attempts, found = [0, *sorted(min(c, n) for c in cuts), n], 0, []
    for lo, hi in zip(edges, edges[1:]):
        attempts, last = A.rounds(attempts, rows.iloc[lo:hi].sample(frac=1, random_state=n), 5)
        found += list(last["error"])
    assert found == [f"e{i}" for i in range(4, n, 5)] and attempts == n % 5


def test_stream_leaves_the_dead_letters_of_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{k:02d}:00", f"e{k}" if k % 4 else None) for i in range(12) for k in range(i)]
    failed = spark.createDataFrame(rows, "id long, t string, error string").select("id", F.col("t").cast("timestamp").alias("attempted_at"), "error")
    enable_state_store(spark)

    def drain():
        stream = spark.readStream.schema(failed.schema).parquet(str(tmp_path / "in"))
        A.live_dead_letters(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((tuple(r) for r in A.failed_rounds(spark.read.schema(A.OUTPUT).parquet(str(tmp_path / "out"))).collect()), key=str)

    minute = F.minute("attempted_at")
    for part in (minute < 2, (minute >= 2) & (minute < 7), minute >= 7):
        failed.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        got = drain()
    want = D.failure_rounds(failed).where("status = 'failed'").select("id", "attempts", "last_error", "failed_at", "status")
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and len(got) == sum(i // 5 for i in range(12))
    # Started again with nothing new, it changes nothing.
    assert drain() == got


def test_events_of_a_bucket_are_counted_together():
    calls = pd.DataFrame({"id": [7, 9, 7, 7, 9], "us": [3, 1, 1, 2, 2], "error": ["c", "x", "a", "b", None]})
    left, last = A.bucket_rounds(pd.Series({9: 1, 2**60 + 1: 2}), calls, 3)
    assert left.to_dict() == {2**60 + 1: 2}
    assert [(r.id, r.us) for r in last.itertuples()] == [(7, 3), (9, 2)]


def test_ids_come_back_from_their_buckets_a_missing_one_too(spark, tmp_path):
    failed = spark.range(3000).selectExpr("if(id = 0, null, id + 1000000000000) id", "timestamp '2024-01-01' attempted_at", "'e' error")
    failed.write.parquet(str(tmp_path / "in"))
    enable_state_store(spark)
    query = A.live_dead_letters(spark.readStream.schema(failed.schema).parquet(str(tmp_path / "in")), 1).writeStream.format(
        "parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = [r.id for r in spark.read.schema(A.OUTPUT).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted((r.id for r in failed.collect()), key=str)


def test_rounds_are_told_by_one_sort_of_the_failures(spark):
    rows = [(1, k, None if k == 5 else f"e{k}") for k in range(12)] + [(2, 0, "a"), (2, None, "b"), (None, 3, "c"), (3, 1, "x"), (3, 1, "y")]
    failed = spark.createDataFrame(rows, "id long, s long, error string").select("id", F.timestamp_seconds("s").alias("attempted_at"), "error")
    got = {r.id: (r.attempts, r.last_error, r.failed_at and r.failed_at.second, r.status) for r in D.classify_failures(failed, 6).collect()}
    assert got == {1: (6, "e11", 11, "failed"), 2: (2, "a", 0, "pending"), 3: (2, "y", 1, "pending"), None: (1, "c", 3, "pending")}
    ends = D.failure_rounds(failed, 6).where("id = 1").orderBy("round").collect()
    assert [(r["round"], r.attempts, r.last_error, r.status) for r in ends] == [(0, 6, None, "failed"), (1, 6, "e11", "failed")]
    text = plan(D.classify_failures(failed))
    assert "Aggregate" not in text and text.count("Sort [") == 1


def test_partitions_grow_with_the_failures(spark, monkeypatch):
    failed = spark.range(40).select((F.col("id") % 20).alias("id"), F.timestamp_seconds("id").alias("attempted_at"), F.lit("e").alias("error"))
    monkeypatch.setattr(D, "FAILURES_PER_TASK", 4)
    got = D.failed_attempts(failed)
    assert got.rdd.getNumPartitions() == 11
    assert sorted((r.id, r["round"], r.attempt) for r in got.collect()) == [(i, 0, k) for i in range(20) for k in (1, 2)]
