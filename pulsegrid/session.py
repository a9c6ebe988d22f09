"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows can carry long texts; a batch for Python stays in memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Filters reach data sources written in Python.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Pools hold up to 200,000 rows; above this limit Spark would not cut groups before a shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "200000",
    # The JVM compiles no method beyond this size; generated code that is longer would be interpreted row by row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Static: only a session built here has them.
STATIC_SETTINGS = {
    # No stack trace per Column call; building a long plan takes half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "pulsegrid", **extra: str) -> SparkSession:
    """A session with the required settings; on a cluster leave ``master`` out."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, spread for work that is heavy per row.

    Large inputs have more splits than that and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder.

    On a cluster the setting is needed: a folder of the driver's own machine would be out of the
    executors' reach, so its absence is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="pulsegrid-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later reads survive lost executors, and the size that Spark plans joins with is that of the files.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
