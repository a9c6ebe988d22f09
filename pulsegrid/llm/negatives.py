"""Hard-negative mining by a BOND vertical scan.

Vectors are quantised and stored as blocks of columns: one array a dimension, rows ordered by label and
id, with each dimension's smallest and largest value. An anchor reads a block's dimensions in
descending order of its own magnitude. What the unread dimensions can still add lies between sums of
their least and greatest contributions; a row whose score can no longer reach a wanted window, or the
window's k best known so far, leaves the candidate bitmap, which is packed when it thins out. The last
rows have their exact score.

Anchors and blocks meet by a lane: a block has one of its own, an anchor is sent to every lane, and a
task streams a lane's anchors past its block. So nothing is broadcast, a task holds one block and one
batch of anchors, and a hot label is spread over all blocks. The rows of a lane that come out are
the k best of a window; the best over all lanes are taken after the shuffle by anchor.

All scores are whole numbers: products are summed in float32 or float64 only where every partial
sum stays within their exact range, else as Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from pulsegrid.llm.text import narrow
from pulsegrid.session import settle

SCALE = 256
# Numbers in a block: 32,768 rows of 64 dimensions, 4 MB.
BLOCK_CELLS = 1 << 21
STEP = 8
SEEDS = 32
# Beyond any score.
NO_LIMIT = 1 << 1000
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
HIGH_PERCENT = 100
BLOCK = "block long, n int, dim int, ids binary, labels binary, cells binary"


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """vec_id, label, vec of the rows that take part."""
    out = narrow(rows, vec_id=id_col, vec=vector_col) if label is None else rows.select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vec"), label.cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.withColumn("vec_id", F.col("vec_id").cast("long")).where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(finite)


def quantised(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, x as double; shorter vectors end in zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    dim = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, dim - p.shape[1]))) for p in parts])


def _block(number: int, ids: list[np.ndarray], labels: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
    own, marks, values = np.concatenate(ids), np.concatenate(labels), _padded(cells)
    order = np.lexsort((own, marks))
    small = np.abs(values).max(initial=0) < 1 << 15
    columns = np.ascontiguousarray(values[order].T.astype("<i2" if small else "<f8"))
    return pa.RecordBatch.from_pydict({
        "block": pa.array([number], pa.int64()), "n": pa.array([len(own)], pa.int32()), "dim": pa.array([values.shape[1]], pa.int32()),
        "ids": pa.array([own[order].astype("<i8").tobytes()], pa.binary()),
        "labels": pa.array([marks[order].astype("<i8").tobytes()], pa.binary()), "cells": pa.array([columns.tobytes()], pa.binary())})


def column_blocks(rows: DataFrame, scale: int = SCALE, cells: int = BLOCK_CELLS) -> DataFrame:
    """The vectors as blocks of columns, each of a task's consecutive rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            values = quantised(batch.column("vec"), scale)
            for part, column in zip(waiting, (batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), values)):
                part.append(column)
            held += max(values.size, len(values))
            if held >= cells:
                yield _block(number, *waiting)
                number, held, waiting = number + 1, 0, ([], [], [])
        if held:
            yield _block(number, *waiting)

    return rows.select("vec_id", "label", "vec").mapInArrow(run, BLOCK)


class Block:
    """Columns of numbers, rows by (label, id)."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, cells: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.wide = len(cells) != 2 * n * dim
        self.columns = {np.float64: np.frombuffer(cells, "<f8" if self.wide else "<i2").reshape(dim, n).astype(np.float64)}
        exact = self.columns[np.float64]
        self.low, self.high = exact.min(axis=1), exact.max(axis=1)
        # How often an id occurs at most: so many more rows are needed to find k different ones.
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max())
        if not self.wide:
            self.columns[np.float32] = exact.astype(np.float32)

    def numbers(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, type]:
        """Columns and vector in the smallest type in which every partial sum is exact."""
        dim = min(len(vector), len(self.low))
        bound = float(np.abs(vector[:dim]) @ np.maximum(np.abs(self.low[:dim]), np.abs(self.high[:dim])))
        kind = np.float32 if bound < 1 << 24 and not self.wide else np.float64 if bound < 1 << 53 else object
        if kind not in self.columns:
            self.columns[kind] = np.array([[int(x) for x in row] for row in self.columns[np.float64]], object).reshape(len(self.low), -1)
        own = np.array([int(x) for x in vector[:dim]], object) if kind is object else vector[:dim].astype(kind)
        return self.columns[kind][:dim], own, kind

    def with_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in that order."""
    if not k or not len(scores):
        return np.empty(0, np.int64)
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, ties = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        short = k - len(above)
        ties = ties[np.argpartition(ids[ties], short - 1)[:short]] if short < len(ties) else ties
        chosen = np.concatenate([above, ties])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen].astype(np.float64)))] if scores.dtype != object else np.array(
        sorted(chosen, key=lambda i: (-scores[i], ids[i])), np.int64)


def _distinct(scores: np.ndarray, ids: np.ndarray, k: int, repeats: int) -> list[tuple[int, int]]:
    """(score, id) of the k best different ids; an id counts with its highest score."""
    out: dict[int, int] = {}
    for i in best(scores, ids, k * repeats):
        out.setdefault(int(ids[i]), int(scores[i]))
        if len(out) == k:
            break
    return [(score, own) for own, score in out.items()]


def vertical_scan(block: Block, vector: np.ndarray, alive: np.ndarray, first: int, windows: list[tuple[int, int]], k: int,
                  counted: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For every window (low, high) the k best (score, id) inside it, of the rows from ``first`` on that ``alive`` marks.

    ``counted`` collects how many rows were read in each step.
    """
    cells, own, kind = block.numbers(vector)
    dim, n = len(own), len(alive)
    order = np.argsort(-np.abs(vector[:dim]), kind="stable")
    # What the dimensions from the m-th on can add at most and at least.
    ends = vector[order] * block.high[order], vector[order] * block.low[order]
    most = np.r_[np.cumsum(np.maximum(*ends)[::-1])[::-1], 0.0]
    least = np.r_[np.cumsum(np.minimum(*ends)[::-1])[::-1], 0.0]
    # In the third type bounds are rounded: then nothing is left out early.
    prune = kind is not object
    floors, ceiling = [low for low, _ in windows], max(high for _, high in windows)
    rows, alive = np.arange(first, first + n), alive.copy()
    packed = False
    scores = np.zeros(n, kind)

    def edge(value: float) -> float:
        # Beyond any score of this block; keeps the comparison within the type's exact range.
        return float(min(max(value, -(1 << 53)), 1 << 53)) if kind is not np.float32 else float(min(max(value, -(1 << 24)), 1 << 24))

    for m in range(0, dim, STEP):
        o = order[m:m + STEP]
        part = cells[np.ix_(o, rows)] if packed else cells[o, first:first + n]
        scores += own[o] @ part
        if counted is not None:
            counted.append(len(rows))
        done = m + len(o)
        if done == dim or not prune:
            continue
        if block.repeats == 1 and done >= dim // 4 and (done - STEP < dim // 4 or done - STEP < dim // 2 <= done):
            # The most promising rows are finished early: their k-th best bounds what can still matter.
            hopeful = np.where(alive, scores, -np.inf)
            ahead = np.argpartition(hopeful, max(0, len(rows) - SEEDS))[-SEEDS:]
            ahead = ahead[alive[ahead]]
            exact = own @ cells[:, rows[ahead]]
            for i, (low, high) in enumerate(windows):
                inside = np.sort(exact[(exact >= edge(low)) & (exact <= edge(high))])
                if len(inside) >= k:
                    floors[i] = max(floors[i], int(inside[-k]))
        alive &= (scores >= edge(min(floors) - most[done])) & (scores <= edge(ceiling - least[done]))
        left = int(np.count_nonzero(alive))
        if 2 * left < len(rows):
            rows, scores, alive, packed = rows[alive], scores[alive], np.ones(left, bool), True
            if not left:
                break
    out = []
    for (low, high), floor in zip(windows, floors):
        inside = alive & (scores >= (floor if kind is object else edge(floor))) & (scores <= (high if kind is object else edge(high)))
        out.append(_distinct(scores[inside], block.ids[rows[inside]], k, block.repeats))
    return out


def _positives(block: Block, anchor: int, label: int, vector: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    same = block.with_label(label)
    if same.stop > same.start:
        (found,) = vertical_scan(block, vector, block.ids[same] != anchor, same.start, [(-NO_LIMIT, NO_LIMIT)], k)
        yield from ((0, score, other) for score, other in found)


def _negatives(block: Block, label: int, vector: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, int, int]]:
    same, alive = block.with_label(label), np.ones(len(block.ids), bool)
    alive[same] = False
    if alive.any():
        for i, found in enumerate(vertical_scan(block, vector, alive, 0, windows, k)):
            yield from ((i, score, other) for score, other in found)


FOUND = "anchor_id long, positive_score long, other_id long, score long"


def _searched(lanes: DataFrame, k: int, scale: int) -> DataFrame:
    """The k best of every anchor and window in every lane's block; anchors without windows seek their positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            kinds = batch.column("kind").to_pylist()
            vectors = batch.column("vec")
            for i, kind in enumerate(kinds):
                if kind == 0:
                    block = Block(*[batch.column(c)[i].as_py() for c in ("n", "dim", "ids", "labels", "cells")])
                    continue
                anchor, label = batch.column("vec_id")[i].as_py(), batch.column("label")[i].as_py()
                vector, wanted = quantised(vectors.slice(i, 1), scale)[0], batch.column("windows")[i].as_py()
                if wanted is None:
                    found = _positives(block, anchor, label, vector, k)
                    rows.extend((anchor, 0, other, score) for _, score, other in found)
                else:
                    windows = [(w["low"], w["high"]) for w in wanted]
                    rows.extend((anchor, wanted[j]["positive_score"], other, score)
                                for j, score, other in _negatives(block, label, vector, windows, k))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["anchor_id", "positive_score", "other_id", "score"])

    return lanes.mapInArrow(run, FOUND)


def _lanes(blocks: DataFrame, anchors: DataFrame, count: int) -> DataFrame:
    """Blocks and anchors dealt by lane; in a lane the block comes first."""
    numbers = blocks.select("block").withColumn("lane", F.row_number().over(Window.orderBy("block")) - 1)
    left = blocks.join(numbers, "block").select("lane", F.lit(0).alias("kind"), *[c for c in blocks.columns if c != "block"])
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("lane"), F.lit(1).alias("kind"), "*")
    # Twice as many partitions as lanes, so that few hold two.
    return left.unionByName(right, allowMissingColumns=True).repartition(2 * count, "lane").sortWithinPartitions("lane", "kind")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each group with their rank; an id counts once, with its highest score."""
    single = found.groupBy(*keys, "other_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, scale: int = SCALE,
                   label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   block_cells: int = BLOCK_CELLS) -> DataFrame:
    """One row per anchor, positive and mined negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition over ``vec_id``; ``label`` an expression over the table's columns, by default
    ``label_col``. An anchor's positives are its ``positives`` best other rows of the same label; a negative has
    another label and low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    Higher scores come first, ties by smaller id. Rows with a null id, label or vector, or a null or
    non-finite component, take no part. An empty vector scores 0; of vectors of unequal length the common
    components count. A vec_id that repeats counts once for an anchor, with its highest score in each
    role; of the rows that repeat an anchor's id the one with the least (label, vector) asks. An
    anchor without positives, or a positive without negatives in its window, has no rows; an empty
    table none. Scores beyond 64 bits are an error.
    """
    source = usable(rows, id_col, vector_col, F.col(f"`{label_col}`") if label is None else label)
    blocks = settle(column_blocks(source, scale, block_cells), "column-blocks")
    count = blocks.count()
    asking = source.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("a"))
    asking = settle(asking.select("vec_id", "a.label", "a.vec"), "anchors")
    if not count:
        return source.sparkSession.createDataFrame([], _RESULT)
    window = "array<struct<positive_score: bigint, low: bigint, high: bigint>>"
    near = _searched(_lanes(blocks, asking.withColumn("windows", F.lit(None).cast(window)), count), positives, scale)
    chosen = settle(_top(near, ["anchor_id"], positives).select(
        "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Decimals, as the products may exceed 64 bits.
    score = F.col("positive_score").cast("decimal(20,0)")
    bounds = F.struct("positive_score", F.ceil(low_percent * score / 100).cast("long").alias("low"),
                      F.floor(high_percent * score / 100).cast("long").alias("high"))
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set(bounds)).alias("windows"))
    windows = windows.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"])).where(F.size("windows") > 0)
    far = _searched(_lanes(blocks, asking.join(windows, "vec_id"), count), negatives, scale)
    mined = _top(far, ["anchor_id", "positive_score"], negatives)
    return chosen.join(mined, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
