"""Runs registered queries against their SQL oracle: python -m tests.check [sf] [name-prefix ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _keyed(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((str(type(x)), str(x)) for x in r)
    )


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    df = query(spark, sf_dir)
    got_cols, got = _keyed(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(got)}"
    want_cols, want = _keyed(*oracle_rows(sf_dir, sql))
    if got_cols != want_cols:
        return f"MISMATCH columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} != {len(want)} e.g. {[r for r in got if r not in set(want)][:2]} " \
               f"vs {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"MISMATCH {len(bad)} values of {len(got)}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    types = {(c, type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50])
             for c, a, b in zip(got_cols, g, w) if type(a) is not type(b)}
    return f"ok rows={len(got)}" + (f" TYPES {types}" if types else "")


def main(argv: list[str]) -> int:
    from pulsegrid.session import build_session

    sf = argv[0] if argv else "0.001"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            result = compare(spark, f"/root/testdata/sf{sf}", name, query, oracles.get(name))
        except Exception as err:  # report and go on with the next query
            result = f"MISMATCH {type(err).__name__}: {str(err)[:1500]}"
        failed += "MISMATCH" in result
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
