"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs its own rows: full sequences are cut off long examples where cutting is allowed, the
rest waits in a pool of bounded size. A sequence takes, again and again, the pooled example whose
demands have the largest dot product with the room left (both as shares of the limits), so examples
heavy in what is still free go in first. Where cutting is allowed, the last gap is filled with the
head of another example, and what a task has left at the end is cut into sequences whose lengths are
powers of two, which need no padding. Tasks share nothing, so nothing is shuffled and a lost task is
simply repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from pulsegrid.llm.text import narrow, raw_texts
from pulsegrid.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
# Sequence ids: the task's partition in the high bits, its running number in the low ones.
TASK_BITS = 36


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048


@dataclass
class Piece:
    """A run of one example's ids, and how many of them bear loss (counted from ``mask``, if any)."""

    doc: object
    total: int
    start: int
    ids: np.ndarray
    mask: np.ndarray | None = None

    @property
    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def head(self, tokens: int, loss: int) -> int:
        """The longest head within both limits."""
        if self.mask is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(np.cumsum(self.mask), loss, side="right")))

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        parts = (slice(0, n), slice(n, None))
        return tuple(
            Piece(self.doc, self.total, self.start + (p.start or 0), self.ids[p], None if self.mask is None else self.mask[p])
            for p in parts)


@dataclass
class Packer:
    """Packs a stream of examples. ``pool`` pieces wait, and more where these are too short to fill two sequences."""

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    pool: int = 256
    waiting: list[Piece] = field(default_factory=list)
    held: int = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes one example; yields the sequences that are finished."""
        while len(piece.ids) >= self.limits.tokens or piece.loss > self.limits.loss:
            n = piece.head(self.limits.tokens, self.limits.loss)
            if n == len(piece.ids):
                yield [piece]
                return
            if not self.cut or n == 0:
                raise ValueError(f"example {piece.doc} exceeds a sequence and may not be cut")
            first, piece = piece.cut(n)
            if n == self.limits.tokens:
                yield [first]
            else:
                self._wait(first)
        self._wait(piece)
        if len(self.waiting) >= self.pool and self.held >= 2 * self.limits.tokens:
            yield from self._drain(self.pool // 2)

    def _wait(self, piece: Piece) -> None:
        self.waiting.append(piece)
        self.held += len(piece.ids)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._drain(0)

    def _drain(self, leave: int) -> Iterator[list[Piece]]:
        """Sequences until ``leave`` pieces or less than a sequence's tokens wait; at the end (0) also the unfilled ones."""
        lim = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        waiting, self.waiting = self.waiting, []
        need = np.array([[len(p.ids), 1, p.loss] for p in waiting], np.float64).reshape(-1, 3)
        while len(waiting) > leave and (not leave or need[:, 0].sum() >= self.limits.tokens):
            if not leave and self.cut and need[:, 0].sum() < self.limits.tokens and need[:, 2].sum() <= self.limits.loss:
                yield from self._tail(waiting)
                return
            room, chosen, live = lim.copy(), [], np.ones(len(waiting), bool)
            tokens, loss = need[:, 0].copy(), need[:, 2].copy()
            while room[0] > 0 and room[1] > 0:
                w = room / lim / lim
                score = np.where(live & (tokens <= room[0]) & (loss <= room[2]), tokens * w[0] + loss * w[2] + w[1], -1.0)
                best = int(score.argmax())
                if score[best] < 0:
                    break
                chosen.append(waiting[best])
                live[best] = False
                room -= need[best]
            if self.cut and room[0] > 0 and room[1] > 0 and live.any():
                # No whole piece fits: the head of the largest one fills the gap.
                large = int(np.where(live, need[:, 0], -1.0).argmax())
                n = waiting[large].head(int(room[0]), int(room[2]))
                if n:
                    head, waiting[large] = waiting[large].cut(n)
                    need[large] = len(waiting[large].ids), 1, waiting[large].loss
                    chosen.append(head)
            waiting, need = [p for p, l in zip(waiting, live) if l], need[live]
            yield chosen
        self.waiting, self.held = waiting, int(need[:, 0].sum())

    def _tail(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The last, unfilled sequence as several whose lengths are powers of two."""
        left = sum(len(p.ids) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room, chosen = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = pieces.pop()
                if len(piece.ids) > room:
                    head, rest = piece.cut(room)
                    pieces.append(rest)
                    piece = head
                chosen.append(piece)
                room -= len(piece.ids)
            for i in range(0, len(chosen), self.limits.segments):
                yield chosen[i:i + self.limits.segments]


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def _rows(sequence: list[Piece], number: int, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for p in sequence:
        ids = p.ids.astype("<u4", copy=False)
        yield (p.doc, p.start, len(ids), zlib.crc32(ids.tobytes()), p.total, p.loss, number, offset,
               ids.astype(np.int64) if keep_ids else None)
        offset += len(ids)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[i], f.type) for i, f in enumerate(schema)], schema=schema)


def _packed(source, packer: Packer, schema: pa.Schema, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the sequences that ``packer`` makes of the pieces of ``source``."""
    number = TaskContext.get().partitionId() << TASK_BITS
    rows: list[tuple] = []

    def sequences():
        for piece in source:
            yield from packer.add(piece)
        yield from packer.finish()

    for sequence in sequences():
        rows.extend(_rows(sequence, number, keep_ids))
        number += 1
        if len(rows) >= 4096:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _schema(kind: str, keep_ids: bool) -> tuple[str, pa.Schema]:
    ddl = f"doc_id {kind}, {COLUMNS}" + ", ids array<long>" * keep_ids
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def pack_documents(docs: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None, end_id: int | None = 1,
                   cut: bool = True, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset and,
    with ``keep_ids``, the ids. A document's ids are its text's ids and ``end_id``; all bear loss.

    Null text is empty: its document is ``end_id`` alone (nothing at all where that is None). Rows that
    repeat a doc_id are documents of their own; a null doc_id stays null. Without ``cut`` an example
    that exceeds a sequence is an error. Empty tables give an empty result; further columns are
    ignored. The vocabulary file must lie at the same path on every executor.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    source = narrow(docs, doc_id=id_col, text=text_col)
    ddl, schema = _schema(source.schema["doc_id"].dataType.simpleString(), keep_ids)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)

        def pieces():
            for batch in batches:
                for doc, data in zip(batch.column("doc_id").to_pylist(), known.encode(raw_texts(batch.column("text")))):
                    ids = np.concatenate([data, tail])
                    if len(ids):
                        yield Piece(doc, len(ids), 0, ids)

        yield from _packed(pieces(), Packer(limits, cut), schema, keep_ids)

    return source.mapInArrow(run, ddl)


def pack_examples(examples: DataFrame, limits: Limits, cut: bool = False, id_col: str = "example_id", ids_col: str = "ids",
                  loss_col: str = "loss", keep_ids: bool = True) -> DataFrame:
    """Packs instruction data given as arrays of ids and, of the same length, of loss flags (0 or 1).

    Rows as in ``pack_documents``. A null or empty array makes no piece; null flags bear no loss; a null
    flag array means that all ids bear loss; arrays of different length are an error. An example that
    exceeds a limit is cut where ``cut`` allows it and an error otherwise.
    """
    source = narrow(examples, doc_id=id_col, ids=ids_col, loss=loss_col)
    ddl, schema = _schema(source.schema["doc_id"].dataType.simpleString(), keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.array(row["ids"] or [], "<u4")
                    mask = None if row["loss"] is None else np.array([x or 0 for x in row["loss"]], np.int64)
                    if mask is not None and len(mask) != len(ids):
                        raise ValueError(f"example {row['doc_id']}: ids and loss flags differ in length")
                    if len(ids):
                        yield Piece(row["doc_id"], len(ids), 0, ids, mask)

        yield from _packed(pieces(), Packer(limits, cut), schema, keep_ids)

    return source.mapInArrow(run, ddl)
