"""Quality classifier: sizes of a text compressed with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled good and bad texts. A text is compressed window by
window with either; the normalised difference of the two sizes says which kind it resembles. A
logistic regression, fitted on labelled texts that trained neither dictionary, turns the difference
(and how far the text compresses at all, which gives repetition away) into a probability.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import labelled as L
from pulsegrid.llm.text import raw_texts

WINDOW = 1024
DICTIONARY_BYTES = 49_152
THRESHOLD = 0.3
# Texts that a line must be in to count as shared.
SHARED = 3


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in pieces of ``size`` bytes; an empty text is one empty window."""
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    samples = [w for t in texts for w in windows(t)]
    total = sum(map(len, samples))
    if total < 8 * size:
        size = max(1024, total // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: L.Calibration | None = None
    _books: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.good, self.bad, self.calibration

    def __setstate__(self, state):
        self.good, self.bad, self.calibration = state
        self._books = []

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        if not self._books:
            parameters = zstandard.ZstdCompressionParameters.from_level(
                1, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._books = [L.compressor(b, zstandard.DICT_TYPE_AUTO, parameters) for b in (self.good, self.bad)]
        good, bad = (sum(len(book.compress(w)) for w in windows(text)) for book in self._books)
        ratio = good / max(1, len(text))
        return (bad - good) / (bad + good), float(np.tanh((bad - good) / 40)), min(ratio, 1.5), max(0.0, 0.25 - ratio)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.calibration.score(np.array([self.features(t) for t in texts]))


def train(fit: list[L.Example], rest: list[L.Example], counts: tuple[int, int]) -> QualityModel:
    """Label 1 is good."""
    # Lines that several texts share say nothing of a kind; in a dictionary they would favour it by chance.
    seen = Counter(line for e in fit for line in set(e.text.split(b"\n")))
    own = [(e.label, b"\n".join(line for line in e.text.split(b"\n") if seen[line] < SHARED)) for e in fit]
    texts = [[text for label, text in own if label == wanted and text]
             or [e.text for e in fit if e.label == wanted] for wanted in (1, 0)]
    # As much text of either kind, so that neither dictionary is better for having seen more.
    least = min(sum(map(len, t)) for t in texts)
    model = QualityModel(*[dictionary(_up_to(t, least)) for t in texts])
    return L.calibrated(model, rest, counts)


def _up_to(texts: list[bytes], total: int) -> list[bytes]:
    out, size = [], 0
    for t in texts:
        if size >= total:
            break
        out.append(t)
        size += len(t)
    return out


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = L.SAMPLE_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of quality 1), predicted.

    The dictionaries and the calibration are learned from at most ``sample_rows`` texts of each label, none
    of them held out; every whole text is scored, and from the text alone. Null and empty texts get
    the score of a difference of zero; repeated rows get equal scores. A null doc_id is not held out. With
    fewer than eight usable labels of either kind all texts get the labels' mean (0.5 without any).
    """
    sampled = L.sample(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                       labels, "quality", sample_rows)
    return L.score_documents(docs, L.trained(sampled, train), threshold, id_col, text_col)


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score below ``threshold``; all columns, nothing is shuffled."""
    packed = pickle.dumps(L.trained(L.sample(docs, labels, "quality"), train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = L.loaded(packed)
        for batch in batches:
            scores = own.scores(raw_texts(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
