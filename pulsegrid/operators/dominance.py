"""Counts of rows that reach several thresholds at once, for any number of threshold sets in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges of scores: so many to each unit of log(1 + score); none is beyond the last one's.
SCORE_RANGES = 64
_LAST_RANGE = 1 + int(SCORE_RANGES * math.log1p(1e18))


def score_range(score: Column) -> Column:
    """Number of a score's range; it never falls as the score rises."""
    return F.when(score > 0, 1 + F.floor(SCORE_RANGES * F.log1p(F.least(score, F.lit(1e18))))).otherwise(F.lit(0)).cast("int")


def score_ranges(floors: DataFrame) -> DataFrame:
    """The distinct score floors (``floor``) as a table of ranges: (range, below, floors).

    A score's place, the number of floors it reaches, is ``below``, the floors in lower ranges, and those of its
    own range's few ``floors`` that are not above it. The ranges are bounded in number; the last one's floors
    are reached by place ``below`` + all for any score beyond it.
    """
    distinct = floors.select("floor").distinct().withColumn("range", score_range(F.col("floor")))
    held = distinct.groupBy("range").agg(F.sort_array(F.collect_list("floor")).alias("floors"))
    spine = floors.sparkSession.range(_LAST_RANGE + 1).select(F.col("id").cast("int").alias("range"))
    rows = spine.join(held, "range", "left").withColumn("floors", F.coalesce("floors", F.array().cast("array<double>")))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("below", F.coalesce(F.sum(F.size("floors")).over(lower), F.lit(0).cast("long")).cast("int"))


def placed(rows: DataFrame, ranges: DataFrame, score: str, place: str) -> DataFrame:
    """``rows`` with the number of floors that ``score`` reaches: an equi-join on the score's range."""
    own = rows.withColumn("range", score_range(F.col(score)))
    return own.join(ranges, "range").withColumn(
        place, F.col("below") + F.size(F.filter("floors", lambda f: f <= F.col(score)))).drop("range", "below", "floors")


def _nodes(value: Column, bits: int) -> Column:
    """The blocks of values that hold ``value`` and are asked for by a prefix: one a bit that is not set."""
    return F.array_compact(F.array(*[
        F.when(F.shiftright(value, b).bitwiseAND(F.lit(1)) == 0, F.struct(F.lit(b).alias("b"), F.shiftright(value, b).alias("n")))
        for b in range(bits)]))


def _prefix(limit: Column, bits: int) -> Column:
    """The disjoint blocks that make up all values up to ``limit``: one a set bit of limit + 1."""
    end = limit + 1
    return F.array_compact(F.array(*[
        F.when(F.shiftright(end, b).bitwiseAND(F.lit(1)) == 1, F.struct(F.lit(b).alias("b"), (F.shiftright(end, b) - 1).alias("n")))
        for b in range(bits)]))


def crossings(cells: DataFrame, asked: DataFrame, measures: tuple[str, ...],
              by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(sums by block, channel and place; requests by block): where cells and requests meet.

    A cell is in at most one block for each bit of its two values, a request asks for at most one for each bit of
    its limits; blocks that nobody asks for fall away at once.
    """
    tops = asked.agg(F.coalesce(F.max("j"), F.lit(0)).alias("j"), F.coalesce(F.max("w"), F.lit(0)).alias("w")).first()
    bits = {axis: (tops[axis] + 1).bit_length() for axis in ("j", "w")}
    wanted = asked.select("request_id", "i", "w", *by, F.explode(_prefix(F.col("j"), bits["j"])).alias("nj")).select(
        "request_id", "i", "nj", *by, F.explode(_prefix(F.col("w"), bits["w"])).alias("nw"))
    block = F.struct("nj", "nw", *by).alias("block")
    wanted = wanted.select("request_id", "i", block)
    inside = cells.where((F.col("j") <= tops.j) & (F.col("w") <= tops.w) & (F.col("i") > 0))
    for axis in ("j", "w"):
        inside = inside.withColumn(f"n{axis}", F.explode(_nodes(F.col(axis), bits[axis])))
    inside = inside.select("i", "channel", block, *measures).join(wanted.select("block").distinct(), "block", "left_semi")
    return inside.groupBy("block", "channel", "i").agg(*[F.sum(m).alias(m) for m in measures]), wanted


def dominance_counts(cells: DataFrame, asked: DataFrame, measures: tuple[str, ...], channels: tuple[str, ...],
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of ``measures`` over the cells with i >= asked i, j <= asked j and w <= asked w, by (request_id, channel);
    zero or null where there are none. ``by`` names columns of both in which a cell must equal the request.

    Values up to a limit are a few disjoint binary blocks, so a cell meets a request by equality of their
    blocks on two axes. Along the third a running sum over places passes cells and requests in one
    order, so a request reads its sum where it stands. The work grows with the cells and the requests
    (times the bits of a limit), not with their product, and a running sum passes at most one cell a place.
    """
    sums, wanted = crossings(cells, asked, measures, by)
    standing = wanted.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    zeros = [F.lit(0).cast("long").alias(m) for m in measures]
    order = Window.partitionBy("block", "channel").orderBy(F.col("i").desc())
    # Rows of the same place are peers: a request counts the cells of its own place.
    passed = sums.withColumn("request_id", F.lit(None).cast(asked.schema["request_id"].dataType)).unionByName(
        standing.select("block", "channel", "i", *zeros, "request_id"))
    summed = passed.withColumns({m: F.sum(m).over(order) for m in measures}).where("request_id IS NOT NULL")
    return summed.groupBy("request_id", "channel").agg(*[F.sum(m).alias(m) for m in measures])
