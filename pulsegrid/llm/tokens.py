"""Token ids of whole texts by a public word-level BPE, with each distinct word part encoded once.

The tokenizer's pieces never span white space, nor a change between ASCII letters, digits and
punctuation (the apostrophe aside), so a text's ids are those of the parts between such places, one
after the other. A batch of texts is cut into parts and the parts are hashed with array operations;
only parts that the task has not met go to the tokenizer's model, in one call. Parts of plain Latin
text are normalised and split here by the tokenizer's own pattern; any other part, and any text with
the beginning of a special token, goes through the whole tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from tokenizers import Tokenizer, pre_tokenizers

# The pattern by which the vocabulary's pre-tokenizer takes pieces, and the end-of-word mark.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPECIAL = b"<|"
# Parts made of these characters are normalised and split here: both are plain for them.
PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įı-ɏ]*")
# Parts that are one piece as they are: ASCII letters, a digit, or ASCII marks without the apostrophe.
PURE = regex.compile(rb"[A-Za-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
# Parts that a Python worker remembers, at about 50 bytes each.
REMEMBERED = 800_000
TABLE_BITS = 21
# Bytes of text that are encoded at a time: the arrays beside them take some 40 times as much.
PORTION = 1 << 20
# Parts beyond this length are hashed one by one.
LONG = 64

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x27] = OTHER
    return kind


def _starts() -> np.ndarray:
    """start[8 * before + here]: whether a part begins between two classes of bytes."""
    start = np.zeros(64, bool)
    for before in range(5):
        for here in range(1, 5):
            plain = OTHER not in (before, here)
            start[8 * before + here] = before == SPACE or plain and (before != here or here == DIGIT)
    return start


CLASS, START = _classes(), _starts()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known:
    """An open-addressing table, as arrays, from part hashes to where the ids of each part lie."""

    def __init__(self, bits: int):
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.count = np.empty(1 << 16, np.uint32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not there."""
        slot = (keys >> self.shift).astype(np.int64)
        there = self.keys[slot]
        todo = np.flatnonzero(there != keys)
        out = slot.copy()
        while len(todo):
            out[todo[there[todo] == 0]] = -1
            todo = todo[there[todo] != 0]
            out[todo] = slot[todo] = (slot[todo] + 1) & self.last
            there[todo] = self.keys[slot[todo]]
            todo = todo[there[todo] != keys[todo]]
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        slot, todo = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.at[slot[won]], self.size[slot[won]] = at[won], sizes[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.last
        self.used += len(ids)
        self.count += len(keys)


class Encoder:
    """texts -> arrays of their ids."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        self.whole = Tokenizer.from_file(vocabulary)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.whole.get_vocab(False).items() if token.endswith(WORD_END)]] = True
        self.split, self.letters = regex.compile(PIECES), byte_letters()
        self.remembered, self.known = remembered, Known(TABLE_BITS)
        rng = np.random.default_rng(7)
        self.byte_value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte_value[CLASS == SPACE] = 0
        self.place = rng.integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts are taken in portions of bounded size."""
        portion, size = [], 0
        for text in texts:
            if portion and size + len(text) > PORTION:
                yield from self._encode(portion)
                portion, size = [], 0
            portion.append(text)
            size += len(text)
        if portion:
            yield from self._encode(portion)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        special = {i for i, t in enumerate(texts) if SPECIAL in t}
        data = b"\n".join([b"" if i in special else t for i, t in enumerate(texts)]).lower() + b"\n"
        raw = np.frombuffer(data, np.uint8)
        kind = CLASS[raw]
        begins = np.empty(len(raw), bool)
        begins[0] = kind[0] != SPACE
        begins[1:] = START[(kind[:-1] << 3) + kind[1:]]
        first = np.flatnonzero(begins)
        ends = np.cumsum([0 if i in special else len(t) for i, t in enumerate(texts)]) + np.arange(len(texts))
        words_before = np.r_[0, np.searchsorted(first, ends)]
        tokens, tokens_before = self._tokens(data, raw, first)
        bounds = tokens_before[words_before].tolist()
        out = [tokens[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in special:
            out[i] = np.array(self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, np.uint32)
        return out

    def _tokens(self, data: bytes, raw: np.ndarray, first: np.ndarray):
        """The ids of all parts in order, and how many ids come before each part and in all."""
        if not len(first):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        raw, gap = raw[first[0]:], np.diff(first, append=len(raw))
        with np.errstate(over="ignore"):
            place = np.arange(len(raw)) - np.repeat(first - first[0], gap)
            np.minimum(place, LONG - 1, out=place)
            keys = np.add.reduceat(self.byte_value[raw] * self.place[place], first - first[0])
            keys *= np.uint64(0x9E3779B97F4A7C15)
        keys |= np.uint64(1)
        for w in np.flatnonzero(gap > LONG):
            keys[w] = xxhash.xxh3_64_intdigest(data[first[w]:first[w] + gap[w]].rstrip()) | 1
        if self.known.count > self.remembered:
            self.known = Known(TABLE_BITS)
        slot = self.known.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, example = np.unique(keys[missing], return_index=True)
            begin = first[missing[example]]
            parts = [data[a:a + n].rstrip() for a, n in zip(begin.tolist(), gap[missing[example]].tolist())]
            plain = np.fromiter((p.isalpha() or PURE.fullmatch(p) is not None for p in parts), bool, len(parts))
            for group, encode in ((plain, self._encode_pieces), (~plain, self._encode_mixed)):
                if group.any():
                    ids, stops = encode(list(itertools.compress(parts, group)))
                    self.known.add(new[group], np.diff(stops, prepend=0), ids)
            slot[missing] = self.known.find(keys[missing])
        sizes = self.known.size[slot]
        before = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        flat = np.repeat(self.known.at[slot] - before[:-1], sizes) + np.arange(before[-1])
        return self.known.ids[flat], before

    def _encode_mixed(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts with apostrophes, control or non-ASCII characters, and where each part's ids end."""
        joined = b" ".join(parts).decode()
        plain = PLAIN.fullmatch(joined.replace(" ", "")) is not None
        texts = joined.split(" ")
        lowered = unicodedata.normalize("NFC", joined).lower().split(" ") if plain else texts
        pieces, counts, odd = [], [], {}
        for i, text in enumerate(lowered):
            if not plain:
                if PLAIN.fullmatch(text) is None:
                    odd[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                    counts.append(0)
                    continue
                text = unicodedata.normalize("NFC", text).lower()
            if text.isalpha():
                pieces.append(text)
                counts.append(1)
            else:
                own = self.split.findall(text)
                pieces.extend(own)
                counts.append(len(own))
        ids, stops = self._encode_pieces([p.encode() for p in pieces])
        ends = np.r_[0, stops][np.cumsum(counts)]
        if odd:
            lists = np.split(ids, ends[:-1])
            for i, own in odd.items():
                lists[i] = own
            ids, ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
        return ids, ends

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are already normalised, and where each piece's ids end."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        joined = b" ".join(pieces)
        text = joined.decode() if joined.isascii() else joined.decode("latin-1").translate(self.letters).replace(self.letters[32], " ")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("a piece did not end with an end-of-word token")
        return ids, stops


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The Python worker's encoder: the next task in the same worker finds its parts known."""
    return Encoder(vocabulary)
