"""Toxicity by compression distance: windows compressed with dictionaries of toxic and of ordinary text.

Both zstandard dictionaries are put together from labelled texts, as raw content (``train_dictionary`` spends
its bytes on what all texts share): they share common words and the ordinary words most like toxic ones; the toxic one ends with the words that set toxic texts apart, the other
with ordinary words in their place. A window is one folded word between blanks, closed by a fixed tail
that both dictionaries hold (zstandard looks for no match in the last bytes of a block). A window that
is shorter with the toxic dictionary is evidence; words of ordinary texts that mislead are added to
both dictionaries. A logistic regression over the counts of windows beyond each length difference,
fitted on texts that trained no dictionary, sets the thresholds.

The dictionaries stay below ``DICTIONARY_BYTES``, as windows must reach all of a dictionary: at most
``TOXIC_BYTES`` of marked words (the strongest first) and ``MISLEADING`` misleading ones are kept. Words in
too few texts to exceed ``LEAST_Z``, and phrases of ordinary words, are not found.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import labelled as L
from pulsegrid.llm.text import folded_words

THRESHOLD = 0.5
DICTIONARY_BYTES = 6_500
COMMON_WORDS = 400
TOXIC_BYTES = 2_000
MISLEADING = 300
# Standard deviations by which a word's share of toxic texts exceeds chance.
LEAST_Z = 5.0
GRAM = 4
# Length differences that are counted.
STEPS = (2, 3, 4, 5)
TAIL = bytes(range(1, 25))
REMEMBERED = 400_000


class Lengths(dict):
    """word -> how many bytes shorter its window is with the toxic dictionary; forgotten at a fixed size."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        parameters = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=14, chain_log=14, search_log=5, min_match=6,
            target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.toxic, self.ordinary = (
            L.compressor(b, zstandard.DICT_TYPE_RAWCONTENT, parameters).compress for b in (toxic, ordinary))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        window = b" " + word + b" " + TAIL
        value = self[word] = max(0, len(self.ordinary(window)) - len(self.toxic(window)))
        return value


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    calibration: L.Calibration | None = None
    _lengths: Lengths | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.toxic, self.ordinary, self.calibration

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.calibration = state
        self._lengths = None

    def lengths(self) -> Lengths:
        if self._lengths is None:
            self._lengths = Lengths(self.toxic, self.ordinary)
        return self._lengths

    def features(self, text: bytes) -> list[float]:
        words = folded_words(text)
        counts = Counter(map(self.lengths().__getitem__, words))
        beyond = [sum(n for d, n in counts.items() if d >= step) for step in STEPS]
        size = math.log1p(len(words))
        return [*[math.log1p(n) for n in beyond], float(min(8, max(counts, default=0))),
                *[n / max(20, len(words)) for n in beyond[:2]], size]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.calibration.score(np.array([self.features(t) for t in texts]))


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i:i + GRAM] for i in range(len(word) - GRAM + 1)}


def _book(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " + TAIL


def _fill(words: list[bytes], size: int) -> list[bytes]:
    """The first words that fit into ``size`` bytes."""
    out = []
    for w in words:
        size -= len(w) + 1
        if size < 0:
            break
        out.append(w)
    return out


def train(fit: list[L.Example], rest: list[L.Example], counts: tuple[int, int]) -> ToxicityModel:
    """Label 1 is toxic."""
    return L.calibrated(books(fit), rest, counts)


def books(fit: list[L.Example]) -> ToxicityModel:
    """A model without calibration: both dictionaries."""
    toxic, ordinary, n = Counter(), Counter(), [0, 0]
    for e in fit:
        (toxic if e.label else ordinary).update(set(folded_words(e.text)))
        n[e.label] += 1
    n = [max(1, x) for x in n]

    def z(w: bytes) -> float:
        share = (toxic[w] + ordinary[w]) / sum(n)
        return (toxic[w] / n[1] - ordinary[w] / n[0]) / math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-9)

    by_z = {w: z(w) for w in toxic.keys() | ordinary.keys() if toxic[w] + ordinary[w] >= 3}
    marked = _fill(sorted((w for w in by_z if by_z[w] >= LEAST_Z), key=lambda w: (-by_z[w], w)), TOXIC_BYTES)
    plain = sorted((w for w in by_z if by_z[w] < 0.5), key=lambda w: (-ordinary[w], w))
    common = plain[:COMMON_WORDS]
    alike = _alike(marked, plain, 3)
    model = _model(marked, common, alike, plain)
    for _ in range(2):
        lengths = model.lengths()
        misled = [w for w in plain if lengths[w] >= STEPS[0] and toxic[w] * n[0] <= 1.5 * ordinary[w] * n[1]]
        alike = list(dict.fromkeys(sorted(misled, key=lambda w: (-ordinary[w] * lengths[w], w))[:MISLEADING] + alike))
        model = _model(marked, common, alike, plain)
    return model


def _alike(marked: list[bytes], plain: list[bytes], times: int) -> list[bytes]:
    """Ordinary words that hold the marked words' parts, each part up to ``times`` times."""
    parts = set().union(*map(_grams, marked)) if marked else set()
    seen: Counter = Counter()
    out = []
    for w in sorted(plain, key=lambda w: (-len(_grams(w) & parts) / len(w), w)):
        own = _grams(w) & parts
        if any(seen[p] < times for p in own):
            out.append(w)
            seen.update(own)
    return out


def _model(marked: list[bytes], common: list[bytes], alike: list[bytes], plain: list[bytes]) -> ToxicityModel:
    room = DICTIONARY_BYTES - sum(len(w) + 1 for w in marked + common)
    shared = common[::-1] + _fill([w for w in alike if w not in set(common)], room)[::-1]
    taken = set(shared)
    instead = _fill([w for w in plain[COMMON_WORDS:] if w not in taken], sum(len(w) + 1 for w in marked))
    return ToxicityModel(_book(shared + marked[::-1]), _book(shared + instead))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = L.SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of toxic 1), predicted.

    Learned from at most ``sample_rows`` texts of each label, none of them held out; every whole text is
    scored, and from the text alone. Null and empty texts have no windows and get the score of a text without
    evidence; repeated rows get equal scores. A null doc_id is not held out. With fewer than eight
    usable labels of either kind all texts get the labels' mean (0.5 without any).
    """
    sampled = L.sample(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                       labels, "toxic", sample_rows)
    return L.score_documents(docs, L.trained(sampled, train), threshold, id_col, text_col)
