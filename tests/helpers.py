"""Small tables for tests."""

from pyspark.sql import functions as F

EVENT = ("id long, event_id string, customer_id long, campaign_id long, channel string, type string, "
         "occurred_at timestamp, received_at timestamp, payload string, status string, attempts int, "
         "last_error string, request_id string")


def events(spark, rows, status="processed"):
    """Rows of (customer, channel, type, occurred_at[, campaign])."""
    full = []
    for i, row in enumerate(rows, 1):
        cust, channel, typ, at = row[:4]
        camp = row[4] if len(row) > 4 else None
        full.append((i, f"evt_{i}", cust, camp, channel, typ, at, at, "{}", status, 0, None, "req-1"))
    cols = EVENT.replace("timestamp", "string")
    df = spark.createDataFrame(full, cols)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("occurred_at", "received_at")})


def one(spark, **values):
    """One row of named literals."""
    return spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()])


def column(spark, values, fn, ddl="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
