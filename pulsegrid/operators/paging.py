"""Keyset pages: a filter on the last key and a bounded sort, never an offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V


def page_limit(limit: int | None) -> int:
    """The page size; one beyond the largest is an error, not cut in silence."""
    if limit is not None and limit > V.MAX_PAGE:
        raise ValueError(f"limit must not exceed {V.MAX_PAGE}")
    return V.DEFAULT_PAGE if limit is None or limit <= 0 else limit


def after_cursor(df: DataFrame, keys: list[tuple[str, str]], cursor: tuple | None) -> DataFrame:
    """Rows behind the cursor in the order of ``keys`` [(column, 'asc' | 'desc')]."""
    if cursor is None:
        return df
    steps = []
    for i, (name, direction) in enumerate(keys):
        c, v = F.col(name), F.lit(cursor[i]).cast(df.schema[name].dataType)
        step = c < v if direction == "desc" else c > v
        for j in range(i):
            step = (F.col(keys[j][0]) == F.lit(cursor[j]).cast(df.schema[keys[j][0]].dataType)) & step
        steps.append(step)
    first, v0 = F.col(keys[0][0]), F.lit(cursor[0]).cast(df.schema[keys[0][0]].dataType)
    # The bound on the leading key alone is implied, but the scan can push it down.
    bound = first <= v0 if keys[0][1] == "desc" else first >= v0
    return df.where(bound & reduce(lambda a, b: a | b, steps))


def keyset_page(df: DataFrame, keys: list[tuple[str, str]], cursor: tuple | None = None,
                limit: int | None = None) -> DataFrame:
    """One page in order, with its position and whether more rows follow.

    One row more than the page is fetched, so the windows see at most 201 rows.
    """
    n = page_limit(limit)
    order = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in keys]
    top = after_cursor(df, keys, cursor).orderBy(*order).limit(n + 1)
    whole = Window.partitionBy(F.lit(1))
    return (
        top.withColumns({
            "page_pos": F.row_number().over(whole.orderBy(*order)).cast("long"),
            "has_more": F.count("*").over(whole) > n,
        })
        .where(F.col("page_pos") <= n)
    )
