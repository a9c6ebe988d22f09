"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items.

Words are lower-cased runs of digits, letters and non-ASCII characters. A window is ``width``
consecutive words of an item (all its words where it has fewer). Every window is a pattern of one
automaton that reads each folded text once; hits are mapped back to offsets of the original text.

The items travel to the tasks in blocks whose windows have at most ``block_nodes`` bytes, and an automaton
has no more nodes than its patterns have bytes (about 40 bytes of memory each); a long item is dealt
over several blocks, window by window. The driver holds one block at a time. A benchmark of more than
one block scans the rows once for each, and what a scan found is written before the next. A worker
builds a block's automaton once and keeps it for its next tasks.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.llm.text import FOLD, folded_words, narrow, raw_texts
from pulsegrid.session import settle

SPACE = 32
# Bytes of all windows of a block, so the most nodes of its automaton: about 80 MB.
BLOCK_NODES = 2 << 20
FOUND = "n_words long, hits array<struct<first:long,last:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def item_windows(text: str | None, width: int) -> Iterator[tuple[int, bytes]]:
    """(words, pattern) of the item's windows, in order."""
    words = folded_words((text or "").encode())
    for i in range(max(1, len(words) - width + 1) if words else 0):
        window = words[i:i + width]
        yield len(window), b" " + b" ".join(window) + b" "


def automaton(windows: list[tuple[str, int, bytes]]) -> ahocorasick.Automaton | None:
    """Automaton of (item id, words, pattern); the value of a window is its length and its items."""
    patterns: dict[bytes, tuple[int, set[str]]] = {}
    for item, n, key in windows:
        patterns.setdefault(key, (n, set()))[1].add(item)
    if not patterns:
        return None
    found = ahocorasick.Automaton()
    for key, (n, owners) in patterns.items():
        found.add_word(key.decode("latin-1"), (n, tuple(sorted(owners))))
    found.make_automaton()
    return found


_built: dict[int, ahocorasick.Automaton | None] = {}


def built(packed: bytes) -> ahocorasick.Automaton | None:
    """The automaton of a pickled block; a worker's next task with the same block finds it ready."""
    key = zlib.crc32(packed)
    if key not in _built:
        _built.clear()
        _built[key] = automaton(pickle.loads(packed))
    return _built[key]


def scan(words: list[bytes], found: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], list[str]]:
    """Hit word runs [first, last) without overlap, and the items whose windows occur."""
    folded = b" " + b" ".join(words) + b" "
    ends = list(found.iter(folded.decode("latin-1")))
    if not ends:
        return [], []
    spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == SPACE)
    after = np.searchsorted(spaces, np.fromiter((e for e, _ in ends), np.int64, len(ends)))
    runs = {(int(a) - n, int(a)) for a, (_, (n, _)) in zip(after, ends)}
    return _joined(list(runs)), sorted({item for _, (_, owners) in ends for item in owners})


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of word runs."""
    if not runs:
        return []
    # Word bytes are those that folding does not turn into a space.
    edge = np.diff((np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8) != SPACE).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in runs]


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, overlapping or touching ones as one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _scanner(block: bytes, schema: pa.Schema):
    """Adds the hits of one block of windows to those that earlier blocks left in the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = built(block)
        for batch in batches:
            texts, names = raw_texts(batch.column("text")), batch.schema.names
            before = batch.select(["hits", "items"]).to_pylist() if "hits" in names else [None] * len(texts)
            out: dict[str, list] = {"n_words": [], "hits": [], "items": [], "spans": []}
            for text, old in zip(texts, before):
                words = folded_words(text)
                runs, owners = scan(words, found) if found and words else ([], [])
                if old:
                    runs = _joined([(r["first"], r["last"]) for r in old["hits"]] + runs)
                    owners = sorted({*old["items"], *owners})
                out["n_words"].append(len(words))
                out["hits"].append([{"first": a, "last": b} for a, b in runs])
                out["items"].append(owners)
                out["spans"].append(_spans(text, runs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name) for f in schema], schema=schema)

    return run


def _blocks(items: DataFrame, width: int, block_nodes: int) -> Iterator[tuple[bytes, bool]]:
    """(pickled windows, whether they are the last) of each block; at least one block, one held at a time."""
    block: list[tuple[str, int, bytes]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for n, key in item_windows(row.text, width):
            if block and size + len(key) > block_nodes:
                yield pickle.dumps(block), False
                block, size = [], 0
            block.append((row.item_id or "", n, key))
            size += len(key)
    yield pickle.dumps(block), True


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids as strings), spans (character
    offsets [start, end) of the hit runs in the original text), contaminated.

    Null and empty texts have no words and are never contaminated; items without words have no
    window. Items that share a window are all reported; a repeated item counts once; a null item id
    reads as the empty string. Rows that repeat a doc_id are judged each by itself. Empty tables
    give empty or clean results; further columns are ignored.
    """
    out = narrow(docs, doc_id=id_col, text=text_col)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    for block, last in _blocks(narrow(benchmark, item_id=item_col, text=item_text_col), width, block_nodes):
        ddl = ", ".join([*[f"{c} {kinds[c]}" for c in (["doc_id"] if last else ["doc_id", "text"])], FOUND])
        out = out.mapInArrow(_scanner(block, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
        out = out if last else settle(out, "scanned")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", (F.size("hits") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id",
               text_col: str = "text", **named) -> DataFrame:
    """``docs`` without contaminated rows; all columns, whole rows.

    The scan carries each row through; nothing is shuffled where the benchmark is one block.
    """
    items = narrow(benchmark, item_id=named.get("item_col", "item_id"), text=named.get("item_text_col", "text"))
    out = docs
    for block, last in _blocks(items, width, named.get("block_nodes", BLOCK_NODES)):
        out = out.mapInArrow(_sieve(block, text_col), docs.schema)
        out = out if last else settle(out, "sieved")
    return out


def _sieve(block: bytes, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = built(block)
        for batch in batches:
            if found:
                texts = raw_texts(batch.column(batch.schema.get_field_index(text_col)))
                batch = batch.filter(pa.array([not _touched(text, found) for text in texts], pa.bool_()))
            yield batch

    return run


def _touched(text: bytes, found: ahocorasick.Automaton) -> bool:
    folded = b" " + b" ".join(folded_words(text)) + b" "
    return next(found.iter(folded.decode("latin-1")), None) is not None
