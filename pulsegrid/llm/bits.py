"""Hashed bitmaps built and probed with SQL functions: one-bit-per-cell Bloom filters of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the largest filter: 2^30 bits are 128 MB, the most that is ever broadcast.
MOST_BITS = 1 << 30


def size_for(rows: int, per_row: int = 32, least: int = 1 << 16, most: int = MOST_BITS) -> int:
    """A power of two with about ``per_row`` bits for each row, between ``least`` and ``most``."""
    return min(most, max(least, 1 << (rows * per_row - 1).bit_length()))


def cells(hashed: Column, size: int, count: int = 2) -> list[Column]:
    """``count`` cells in [1, size] of a 64-bit hash; ``size`` is a power of two."""
    return [
        (F.xxhash64(hashed, F.lit(i)) if i else hashed).bitwiseAND(F.lit(size - 1).cast("long")) + F.lit(1).cast("long")
        for i in range(count)
    ]


def bitmap(rows: DataFrame, cell: str) -> DataFrame:
    """The set of values of ``cell`` as (bucket, bits), 32,768 cells in each row."""
    return rows.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))


def probe(rows: DataFrame, bitmaps: DataFrame, probed: list[Column], flag: str) -> DataFrame:
    """``rows`` and a boolean column ``flag``: whether all ``probed`` cells are in the bitmap.

    The bitmap has at most ``MOST_BITS`` bits whatever the input's size, hence the broadcast.
    """
    found = []
    for i, cell in enumerate(probed):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__bucket{i}"), F.col("bits").alias(f"__bits{i}")))
        rows = rows.withColumn(f"__cell{i}", cell)
        rows = rows.join(side, F.bitmap_bucket_number(f"__cell{i}") == F.col(f"__bucket{i}"), "left")
        position = F.bitmap_bit_position(f"__cell{i}")
        byte = F.conv(F.hex(F.substring(f"__bits{i}", F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found.append(F.coalesce(F.bit_get(byte, (position % 8).cast("int")) == 1, F.lit(False)))
    hit = found[0]
    for one in found[1:]:
        hit = hit & one
    return rows.withColumn(flag, hit).drop(
        *[f"__{kind}{i}" for i in range(len(probed)) for kind in ("bucket", "bits", "cell")])
