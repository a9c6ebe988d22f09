"""Tables that change together: versioned folders under one base path, and one manifest that names them.

Every load writes folders of its own, which no reader lists. A manifest, written last and under a name that
exists only once, makes a new version of any number of tables visible at once; it names each table's
folders, so a load that fails between two tables leaves the old version as it was. Readers
resolve all tables through one manifest, the newest or a given one; old versions stay readable.

Facts are laid out by day. Retention is a new version without the folders of days that are too old; only the
border day is written again. Log tables are sorted by event id within each file, with Bloom filters on
the ids that are looked up, so that a lookup skips most row groups of every file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions import scalars as S
from pulsegrid.sources.tables import DAY_OF, TABLES

MANIFESTS = "_manifests"
# Columns that single rows are looked up by; the first one also sorts the files.
LOOKUPS = {"event_logs": ("event_id", "request_id"), "activity_logs": ("request_id",)}
# Distinct ids that a Bloom filter of one row group is made for.
BLOOM_IDS = 100_000
ROW_GROUP_BYTES = 8 << 20


class VersionConflict(RuntimeError):
    """Another load has published the version in the meantime."""


@dataclass(frozen=True)
class Manifest:
    """``tables``: name -> {schema, folders}; the folders of a table by day are {day: [paths]}, all paths below the base."""

    version: int
    tables: dict


def _files(spark: SparkSession, base: str):
    """The file system of ``base`` and a maker of its paths."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, base: str) -> list[int]:
    """All published versions, the oldest first."""
    files, path = _files(spark, base)
    folder = path(f"{base}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, base: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version; version 0 without tables where nothing is published."""
    known = versions(spark, base)
    if version is None:
        version = known[-1] if known else 0
    elif version not in known:
        raise ValueError(f"no version {version} under {base}")
    if not version:
        return Manifest(0, {})
    text = spark.read.text(f"{base}/{MANIFESTS}/{version:010d}.json", wholetext=True).first()[0]
    return Manifest(version, json.loads(text)["tables"])


def _publish(spark: SparkSession, base: str, before: Manifest, tables: dict) -> int:
    """Writes the next manifest beside the others and gives it its name in one step; fails if the name is taken."""
    files, path = _files(spark, base)
    version = before.version + 1
    content = json.dumps({"version": version, "tables": before.tables | tables})
    draft, final = path(f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}"), path(f"{base}/{MANIFESTS}/{version:010d}.json")
    out = files.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise VersionConflict(f"version {version} of {base} exists")
    return version


def _write(name: str, df: DataFrame, base: str) -> dict:
    """One table's rows in new folders; what a manifest says of them."""
    load, lookups = uuid.uuid4().hex, LOOKUPS.get(name, ())
    schema = df.schema.json()
    day = DAY_OF.get(name)
    if day:
        # Rows of a day spread over several tasks, so that a busy day is no single writer.
        df = df.withColumns({"event_day": F.to_date(day), "load": F.lit(load)})
        df = df.repartition("event_day", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(8)))
    writer = (df.sortWithinPartitions(*(["event_day"] if day else []), *lookups[:1]) if lookups else df).write.mode("append")
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_IDS)).option("parquet.block.size", str(ROW_GROUP_BYTES))
    if not day:
        writer.parquet(f"{base}/{name}/load={load}")
        return {"schema": schema, "folders": [f"{name}/load={load}"]}
    writer.partitionBy("event_day", "load").parquet(f"{base}/{name}")
    files, path = _files(df.sparkSession, base)
    found = files.globStatus(path(f"{base}/{name}/event_day=*/load={load}")) or []
    days = sorted(f.getPath().getParent().getName().removeprefix("event_day=") for f in found)
    return {"schema": schema, "folders": {d: [f"{name}/event_day={d}/load={load}"] for d in days}}


def publish(spark: SparkSession, tables: dict[str, DataFrame], base: str, append: tuple[str, ...] = ()) -> int:
    """Writes all ``tables`` and makes them visible together as the next version, which is returned.

    A table named in ``append`` keeps its earlier folders, any other is replaced; tables not given stay as they are.
    If a write fails nothing changes for readers. Loads that meet are told apart: the later one raises
    ``VersionConflict`` and may be published again.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown table {sorted(unknown)[0]}")
    before = manifest(spark, base)
    written = {name: _write(name, df, base) for name, df in tables.items()}
    for name in set(append) & set(before.tables):
        old, new = before.tables[name]["folders"], written[name]["folders"]
        written[name]["folders"] = {d: old.get(d, []) + new.get(d, []) for d in sorted({*old, *new})} if isinstance(old, dict) else old + new
    return _publish(spark, base, before, written)


def table(spark: SparkSession, base: str, name: str, known: Manifest) -> DataFrame:
    """A table as a manifest knows it; a table by day has ``event_day``, which prunes folders."""
    if name not in known.tables:
        raise ValueError(f"no table {name} in version {known.version}")
    entry = known.tables[name]
    schema, folders = StructType.fromJson(json.loads(entry["schema"])), entry["folders"]
    by_day = isinstance(folders, dict)
    paths = [f"{base}/{p}" for p in ([p for day in folders.values() for p in day] if by_day else folders)]
    if not paths:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("event_day", F.lit(None).cast("date")) if by_day else empty
    full = StructType(schema.fields).add("event_day", "date").add("load", "string") if by_day else schema
    reader = spark.read.schema(full)
    return (reader.option("basePath", f"{base}/{name}").parquet(*paths).drop("load") if by_day else reader.parquet(*paths))


def tables(spark: SparkSession, base: str, names: tuple[str, ...] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """Several tables of one version: what was published together is read together."""
    known = manifest(spark, base, version)
    return {n: table(spark, base, n, known) for n in (names or tuple(known.tables))}


def prune(spark: SparkSession, base: str, name: str, days: int, as_of) -> int:
    """The next version without the table's rows older than ``days`` before ``as_of``; zero or less keeps all.

    Folders of older days are left out, later days keep their files, and only the border day's rows within
    the retention are written again. Without anything to drop no version is made.
    """
    before = manifest(spark, base)
    if days <= 0:
        return before.version
    column, entry = DAY_OF[name], before.tables[name]
    since = spark.range(1).select((S.as_ts(as_of) - F.make_dt_interval(days=F.lit(days))).alias("t")).first().t
    border, folders = since.date().isoformat(), entry["folders"]
    later = {d: p for d, p in folders.items() if d > border}
    if border in folders:
        own = table(spark, base, name, Manifest(before.version, {name: entry | {"folders": {border: folders[border]}}}))
        old = own.where(F.col(column) < F.lit(since)).limit(1).count()
        if old:
            kept = _write(name, own.where(F.col(column) >= F.lit(since)).drop("event_day"), base)["folders"]
            later |= {border: kept.get(border, [])} if kept.get(border) else {}
        else:
            later[border] = folders[border]
    if later == folders:
        return before.version
    return _publish(spark, base, before, {name: entry | {"folders": dict(sorted(later.items()))}})
