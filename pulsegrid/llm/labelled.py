"""What the two compression classifiers share: the training sample, calibration and the scoring pass."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.near import Remembered, shingle_set
from pulsegrid.llm.text import narrow, raw_texts

# Bound of the training sample: rows of each label, and the bytes of a text that is used for training.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 32_768
FOLDS = 5


@dataclass
class Sample:
    """Examples, and how many labels there are of each class outside the held-out rows."""

    examples: list["Example"]
    counts: tuple[int, int]


@dataclass(frozen=True)
class Example:
    doc_id: object
    label: int
    text: bytes


def held_out(doc_id) -> Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text is a multiple of ``FOLDS``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS) -> Sample:
    """At most ``rows`` labelled texts of each class, in an order that depends on their ids alone.

    The ids are chosen from the labels (partial top-k in each task), so the driver gets at most
    ``2 * rows`` ids and texts of at most ``SAMPLE_BYTES``; longer ones, null texts and held-out rows are
    not used. A document with both labels counts as neither.
    """
    known = narrow(labels, doc_id="doc_id", label=label_col).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    known = known.where("label = high").select("doc_id", "label", F.xxhash64("doc_id").alias("place"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    # Some ids have no usable text, so more are chosen than are needed.
    chosen = [known.where(F.col("label") == c).orderBy("place", "doc_id").limit(2 * rows) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = narrow(docs, doc_id="doc_id", text="text").where(F.octet_length("text").between(1, SAMPLE_BYTES))
    found = [texts.join(chosen, "doc_id").where(F.col("label") == c).orderBy("place", "doc_id", "text").limit(rows)
             for c in (0, 1)]
    examples = [Example(r.doc_id, r.label, r.text.encode()) for r in found[0].unionByName(found[1]).collect()]
    return Sample(examples, (counts.get(0, 0), counts.get(1, 0)))


def without_copies(examples: list[Example], width: int = 5, slots: int = 3) -> list[Example]:
    """One of each family of copies: texts are dropped that share a min-hash with an earlier one of their label."""
    seen: set[tuple] = set()
    words_of = Remembered()
    out = []
    for e in examples:
        shingles = shingle_set(e.text, words_of, width)
        if len(shingles):
            with np.errstate(over="ignore"):
                mins = {(e.label, s, int((shingles * np.uint64(2 * s + 0x9E3779B97F4A7C15)).min())) for s in range(slots)}
            if mins & seen:
                seen |= mins
                continue
            seen |= mins
        out.append(e)
    return out


def split(examples: list[Example], share: float = 0.6) -> tuple[list[Example], list[Example]]:
    """One part to train the dictionaries on, one to calibrate with; the text's hash decides."""
    part = [xxhash.xxh3_64_intdigest(e.text, seed=1) < share * 2 ** 64 for e in examples]
    return [e for e, p in zip(examples, part) if p], [e for e, p in zip(examples, part) if not p]


@dataclass
class Calibration:
    """A logistic regression over a few features of compressed sizes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> "Calibration":
        mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = np.c_[np.ones(len(features)), (features - mean) / scale]
        w, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-6] + [1.0] * features.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (labels - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def shift(self, seen: np.ndarray, counts: tuple[int, int]) -> None:
        """From the classes' shares among the labels ``seen`` to those among all labels."""
        self.weights[0] += math.log(counts[1] / counts[0]) - math.log(seen.sum() / (len(seen) - seen.sum()))

    def score(self, features: np.ndarray) -> np.ndarray:
        """One probability a row; summed feature by feature, so that a row's neighbours in the batch change nothing."""
        x = np.clip((features - self.mean) / self.scale, -10, 10)
        total = np.full(len(x), self.weights[0])
        for column, weight in zip(x.T, self.weights[1:]):
            total += column * weight
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def compressor(content: bytes, kind: int, parameters: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content, dict_type=kind)
    book.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=parameters)


def score_documents(docs: DataFrame, model, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``model`` has ``features(list of texts)`` and a calibration.

    The model is a few hundred kilobytes whatever the corpus, and travels with the tasks.
    """
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(packed)
        for batch in batches:
            scores = own.scores(raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = source.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


_loaded: dict[int, object] = {}


def loaded(packed: bytes):
    """The model of this Python worker; the next task with the same model finds it ready."""
    key = zlib.crc32(packed)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(packed)
    return _loaded[key]


def constant(labels: list[int], otherwise: float = 0.5) -> float:
    """The share of label 1 where there is nothing to compare."""
    return sum(labels) / len(labels) if labels else otherwise


@dataclass
class Constant:
    """The model of a sample without both labels."""

    value: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def calibrated(model, rest: list[Example], counts: tuple[int, int]):
    """``model`` with a calibration on ``rest``, for the labels' shares ``counts``."""
    labels = np.array([e.label for e in rest])
    model.calibration = Calibration.fit(np.array([model.features(e.text) for e in rest]), labels)
    if min(counts):
        model.calibration.shift(labels, counts)
    return model


def trained(sample: Sample, train: Callable[[list[Example], list[Example], tuple[int, int]], object]):
    """``train(texts for dictionaries, texts to calibrate with, label counts)`` on the sample without copies.

    Where either part would lack a label both are all texts; where these have fewer than eight of a label
    the model is the share of label 1.
    """
    def least(part: list[Example]) -> int:
        ones = sum(e.label for e in part)
        return min(ones, len(part) - ones)

    examples = without_copies(sample.examples)
    if least(examples) < 8:
        return Constant(constant([e.label for e in sample.examples]))
    parts = split(examples)
    fit, rest = parts if min(map(least, parts)) >= 2 else (examples, examples)
    return train(fit, rest, sample.counts)
