import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.operators import profiles as P
from pulsegrid.streaming import live
from tests.helpers import events

AS_OF = "2024-01-31 00:00:00"
ROWS = st.lists(st.tuples(st.sampled_from(V.EVENT_TYPES), st.sampled_from(V.CHANNELS), st.integers(0, 10 ** 12)),
                min_size=1, max_size=30)


@settings(max_examples=50, deadline=None)
@given(ROWS, st.integers(1, 5), st.randoms())
def test_any_split_in_any_order_folds_to_the_same_state(rows, parts, rng):
    df = pd.DataFrame([(i, t, c, us) for i, (t, c, us) in enumerate(rows)], columns=["id", "type", "channel", "us"])
    whole = live.fold(None, df)
    shuffled = df.sample(frac=1, random_state=rng.randint(0, 99))
    state = None
    for k in range(parts):
        piece = shuffled.iloc[k::parts]
        if len(piece):
            state = live.fold(state, piece)
    assert [round(x, 6) if isinstance(x, float) else x for x in state] == [
        round(x, 6) if isinstance(x, float) else x for x in whole]


def test_state_equals_rebuild(spark, tmp_path):
    rows = [(1 + i % 3, V.CHANNELS[i % 2], V.EVENT_TYPES[i % 8], f"2024-01-{1 + (i * 7) % 28:02d}") for i in range(60)]
    e = events(spark, rows)
    slim = e.select("customer_id", "id", "channel", "type", "occurred_at")
    for k in range(3):
        slim.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.enable_state_store(spark)
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        live.live_profiles(stream).writeStream.outputMode("update").queryName("live_profiles").format("memory")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.sql("SELECT * FROM live_profiles").groupBy("customer_id").agg(
        F.max_by(F.struct("*"), "total_events").alias("p")).select("p.*")
    want = P.build_profiles(e, AS_OF).select(
        "customer_id", "total_events", "positive_events", "negative_events", "conversions",
        F.unix_micros("last_event_at"), "last_event_type", "engagement_score", "preferred_channel")

    def key(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert key(got) == key(want)
