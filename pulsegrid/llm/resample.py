"""Importance resampling towards a target distribution, ranked by a distributed LSD radix sort.

Word runs are hashed into buckets. The counts of a raw corpus and of a target give every bucket a
gain; a document's weight is the floored mean of its features' gains, read from one array. The
weight plus Gumbel noise that depends on the doc_id alone is a score, and the highest scores are a
draw without replacement.

Ranks come from a least-significant-digit radix sort of the composite key (score downwards, doc_id
upwards). Each pass is a stable counting sort by one digit: rows per (digit, part) are counted, a prefix
sum over digits and parts gives every such group its first place, and a row's destination is that place
plus its own place in the group. Parts are runs of ``CHUNK`` places, so no group is larger, whatever a
digit's share of all rows; no task sees more than one part's rows of a digit at a time. Every pass is
written to the shared folder and read back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.text import folded_words, narrow, raw_texts
from pulsegrid.session import settle

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
DIGIT_BITS = 12
LEAST_CHUNK, CHUNK = 1 << 10, 1 << 18
REMEMBERED = 400_000


# ---- weights ----

class _Values(dict):
    """feature -> value of its bucket; forgotten at a fixed size."""

    def __init__(self, values: list[int]):
        super().__init__()
        self.values_of = values

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[feature] = self.values_of[zlib.crc32(feature) % len(self.values_of)]
        return value


def features(words: list[bytes], width: int) -> list[bytes]:
    """All runs of 1 to ``width`` consecutive words, joined by one space."""
    if width == 1:
        return words
    return [b" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def bucket_counts(docs: DataFrame, width: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts: summed within each task, then over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, total = _Values(list(range(buckets))), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                found = list(map(bucket_of.__getitem__, features(folded_words(text), width)))
                total += np.bincount(found, minlength=buckets) if found else 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return narrow(docs, text=text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket, in thousandths of a nat; ``source`` and ``target`` are (bucket, n).

    One number for each bucket reaches the driver, whatever the corpus.
    """
    both = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    counts = np.zeros((2, buckets), np.float64)
    for r in both.fillna(0).collect():
        counts[:, r.bucket] = r.s, r.t
    total = counts.sum(axis=1)
    ratio = ((counts[1] + 1) * (total[0] + buckets)) / ((counts[0] + 1) * (total[1] + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weigh(docs: DataFrame, gains: list[int], width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = _Values(gains)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in raw_texts(batch.column("text")):
                words = folded_words(text)
                own = features(words, width)
                rows.append((len(words), len(own), sum(map(gain_of.__getitem__, own)) // len(own) if own else 0))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noisy_score(weight: Column, doc_id: Column, seed: str = SEED) -> Column:
    """Weight plus Gumbel noise of the id's hash, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    return weight + noise.cast("long")


# ---- radix sort ----

def _unsigned(key: str, descending: bool) -> Column:
    """A long whose unsigned order is the wanted one."""
    flipped = F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.bitwise_not(flipped) if descending else flipped


def _bits(low: int, high: int) -> int:
    """The low bits in which values between two longs can differ."""
    return ((low ^ high) & ((1 << 64) - 1)).bit_length()


def digits_of(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT_BITS) -> list[Column]:
    """Digits of the composite key, the least significant first; those that all rows share are left out."""
    ends = rows.agg(*[f(key).cast("long").alias(f"{key}_{name}") for key, _ in keys
                      for name, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for key, descending in reversed(keys):
        low, high = ends[f"{key}_low"], ends[f"{key}_high"]
        if low is not None:
            out += [F.shiftrightunsigned(_unsigned(key, descending), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
                    for shift in range(0, _bits(low, high), bits)]
    return out


def _counting_pass(rows: DataFrame, digit: Column, chunk: int) -> DataFrame:
    """Rows with their place after a stable sort by ``digit``."""
    marked = rows.withColumn("digit", digit)
    counts = marked.groupBy("digit", "part").count()
    # One row for each digit value, 4,096 at most, hence the window over all of them.
    bases = counts.groupBy("digit").agg(F.sum("count").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0).cast("long")).alias("base"))
    earlier = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0).cast("long"))).join(bases, "digit").select(
        "digit", "part", (F.col("base") + F.col("before")).alias("start"))
    own = F.row_number().over(Window.partitionBy("digit", "part").orderBy("place")) - 1
    moved = marked.withColumn("own", own).join(starts, ["digit", "part"]).withColumn("place", F.col("start") + F.col("own"))
    return moved.withColumn("part", F.floor(F.col("place") / chunk).cast("long")).drop("digit", "own", "start")


def radix_places(rows: DataFrame, keys: list[tuple[str, bool]], chunk: int | None = None, bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of ``keys``: (integral column without nulls, descending),
    the most significant first. The sort is stable: rows with equal keys keep the order in which they are read.
    A part is ``chunk`` places, by default a sixty-fourth of all, at least ``LEAST_CHUNK`` and at most ``CHUNK``.
    """
    rows = settle(rows.withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()),
                  "radix-input")
    digits = digits_of(rows, keys, bits)
    chunk = chunk or min(CHUNK, max(LEAST_CHUNK, rows.count() // 64))
    # Without any digit all keys are equal: one pass by a constant numbers the rows.
    for digit in digits or [F.lit(0)]:
        rows = settle(_counting_pass(rows, digit, chunk), "radix-pass")
    return rows.drop("part")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, width: int = 1,
             buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, 3... of the drawn rows, else null).

    Of the rows with at least ``least_words`` words, floor(percent / 100 of their number) are drawn: the highest
    scores, ties to the smaller doc_id. doc_id is an integer; a null doc_id has no score (null) and takes no
    part in the draw. Null and empty texts have no features and weight 0. Rows that repeat a doc_id are
    documents of their own and rank in the order they are read. Empty tables of either kind give gains
    from no counts; further columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, width, buckets, text_col), bucket_counts(target, width, buckets, target_text_col), buckets)
    weighed = weigh(docs, gains, width, id_col, text_col).withColumn("score", noisy_score(F.col("weight"), F.col("doc_id"), seed))
    weighed = settle(weighed.select("doc_id", "n_words", "n_features", "weight", "score"), "weighed")
    taking_part = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    placed = radix_places(weighed.where(taking_part), [("score", True), ("doc_id", False)])
    drawn = percent * placed.count() // 100
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = weighed.where(~taking_part).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
