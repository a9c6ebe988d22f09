"""Queries over customers whose keys are longer than the padding of their external ids equal their SQL."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check import NAMES, compare

SF = pathlib.Path("/root/testdata/sf0.001")
NAMES_HERE = (
    "i5_dedup_events",
    "i6_ingest_summary",
    "l11_trace_event",
    "l1_lifecycle_entries",
    "i8_read_replay_file",
    "l11_trace_event_stored",
    "l5_prune",
    "l5_prune_stored",
    "st2_stream_campaign_daily",
)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Customers 9990 to 10009 and 99990 to 100019; the events of request req-3 are of customer 10000, whose id SQL cuts not."""
    base = tmp_path_factory.mktemp("long-keys")
    for name in NAMES:
        if name not in ("customer", "events"):
            (base / f"{name}.parquet").symlink_to(SF / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (
      SELECT * REPLACE (CASE WHEN c_custkey < 20 THEN 9990 + c_custkey ELSE 99970 + c_custkey END AS c_custkey)
      FROM '{SF}/customer.parquet' WHERE c_custkey < 50) TO '{base}/customer.parquet'""")
    con.execute(f"""COPY (
      SELECT * REPLACE (CASE WHEN event_id // 50 = 3 THEN 10000 WHEN event_id % 2 = 0 THEN 9990 + event_id % 20
        ELSE 99990 + event_id % 30 END AS user_id) FROM '{SF}/events.parquet') TO '{base}/events.parquet'""")
    return str(base)


@pytest.mark.parametrize("name", NAMES_HERE)
def test_long_keys_equal_sql(spark, tables, name):
    assert compare(spark, tables, name, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok rows=")
