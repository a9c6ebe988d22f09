"""Exact dedup by two passes over hashes with a Bloom filter between them (DataFrame functions only).

Pass one marks the filter cells that two or more rows hit; the marked cells are a bitmap of bounded
size. Pass two probes it: a row whose cells are not all marked has no equal and passes straight
through; only the possibly repeated rows are shuffled, on the SHA-256 of their normalised text. A
full filter lets more rows through to the shuffle and never changes the result.

Equal copies, however many, are summed before the shuffle; the rows of a hot group are only joined
to their group's one line, a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import bits
from pulsegrid.llm.text import narrow
from pulsegrid.session import settle


def normalised(text: Column) -> Column:
    """Runs of space and \\t\\n\\v\\f\\r become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _short(column: str = "sha") -> Column:
    """A 64-bit hash of the digest, for the filter."""
    return F.xxhash64(column)


def repeat_filter(hashed: DataFrame, size: int, marks: int = 2) -> DataFrame:
    """Pass one: the bitmap of cells that at least two rows hit."""
    rows = hashed.select(F.explode(F.array(*bits.cells(_short(), size, marks))).alias("cell"))
    twice = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return settle(bits.bitmap(twice, "cell"), "repeat-filter")


def _probed(hashed: DataFrame, bitmaps: DataFrame, size: int) -> DataFrame:
    return bits.probe(hashed, bitmaps, bits.cells(_short(), size), "__maybe")


def _groups(maybe: DataFrame) -> DataFrame:
    """Groups of two or more rows with equal digest: keeper and size."""
    return settle(
        maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where(
            "group_size > 1"),
        "repeat-groups")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null or empty text: the empty text, a group like any other. Among equal texts the smallest doc_id
    stays; rows that repeat it all stay, as nothing tells them apart. A null doc_id ranks last: it is
    kept only where its group has no other. An empty table gives an empty result; further columns
    are ignored.
    """
    hashed = settle(
        narrow(docs, doc_id=id_col, text=text_col).select("doc_id", digest(F.col("text")).alias("sha")), "digests")
    size = bits.size_for(hashed.count())
    rows = _probed(hashed, repeat_filter(hashed, size), size)
    groups = _groups(rows.where("__maybe"))
    alone = rows.where("NOT __maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"),
                                             F.lit(1).cast("long").alias("group_size"))
    joined = rows.where("__maybe").join(groups, "sha", "left").select(
        "doc_id", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return alone.unionByName(joined).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``verdicts`` does not keep; all columns, whole rows.

    Rows without a possible equal are read, probed and passed on where they lie; only the others,
    text included, are shuffled to meet their group.
    """
    hashed = settle(
        narrow(docs, doc_id=id_col, text=text_col).select("doc_id", digest(F.col("text")).alias("sha")), "digests")
    size = bits.size_for(hashed.count())
    bitmaps = repeat_filter(hashed, size)
    groups = _groups(_probed(hashed, bitmaps, size).where("__maybe"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       digest(F.col(f"`{text_col}`")).alias("sha"))
    rows = _probed(rows, bitmaps, size)
    maybe = rows.where("__maybe").join(groups, "sha", "left").where(
        F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.where("NOT __maybe").select("row.*").unionByName(maybe.select("row.*"))
