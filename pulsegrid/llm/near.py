"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document is its set of distinct word shingles. One hash of each shingle fills ``BANDS * ROWS`` bins
(a bin keeps its smallest hash); an empty bin takes the value of the first filled bin in its own
random order of all bins, the same for every document. ``ROWS`` neighbouring bins form a band, and
documents equal in a band share a bucket.

Within a bucket only star edges are made, from the member with most company in all its buckets (the
likely original of a family of copies) to the others, so their number is linear in the bucket's
size. Edges are confirmed on the full shingle sets. Members that a star leaves outside its centre's
component are compared exactly with the members of all such buckets, covered ones too: a join on rare
shingles (``_partners``) finds every pair that can be linked, bounds on the common shingles and on the
difference of the sets leave out most others, and pairs within a component are never compared. So
every two linked documents that share a bucket end in one component. Documents with the same set are
one node from the start.

Buckets, stars, partners and components are joins and pre-aggregated groupings: no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import bits
from pulsegrid.llm.components import components
from pulsegrid.llm.text import LOWER, narrow, raw_texts
from pulsegrid.session import settle

BANDS, ROWS = 48, 8
SEED = 20240131
# log2 of the cells that count shingles for their order by frequency.
CELL_BITS = 22
# Pairs that are confirmed before the components are looked at again, as a share of all, and the least number.
FIRST_SHARE, FIRST_PAIRS = 16, 100_000
# Words whose hash a task remembers.
REMEMBERED = 200_000


class Remembered(dict):
    """word -> 64-bit hash, forgotten when it has grown to a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, words_of: Remembered, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; no words, no shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        rolled = np.full(len(words) - n + 1, np.uint64(n) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for i in range(n):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashed[i:len(words) - n + 1 + i]
        return np.unique(_mixed(rolled))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bins, self.shape = bands * rows, (bands, rows)
        # rank[i, j]: how late bin i turns to bin j when it is empty.
        self.rank = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.uint16)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def bin_values(self, hashes: np.ndarray) -> np.ndarray:
        """One value for each bin; ``hashes`` are sorted, so a bin's first is its smallest."""
        owner = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        filled = owner[first].astype(np.int64)
        values = np.empty(self.bins, np.uint64)
        values[filled] = hashes[first]
        if len(filled) < self.bins:
            without = np.ones(self.bins, bool)
            without[filled] = False
            empty = np.flatnonzero(without)
            donor = filled[self.rank[np.ix_(empty, filled)].argmin(axis=1)]
            values[empty] = values[donor]
        return values

    def band_hashes(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = _mixed(self.bin_values(hashes)).reshape(self.shape)
            return _mixed((mixed * self.weights).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(r) for r in rows), np.int32, len(rows))
    offsets = np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)]
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, words_of = Signer(), Remembered()
        for batch in batches:
            sets = [shingle_set(t, words_of, width) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                _lists([signer.band_hashes(s) if len(s) else np.empty(0, np.int64) for s in sets], pa.int64()),
            ], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Remembered()
        for batch in batches:
            sets = [shingle_set(t, words_of, width).tobytes() for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar enough."""
    return (
        edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .where(F.octet_length("left") * 100 >= F.octet_length("right") * percent)
        .where(F.octet_length("right") * 100 >= F.octet_length("left") * percent)
        .select("a", "b", "left", "right").mapInArrow(_links(percent), "a long, b long"))


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, node, company) of buckets with two or more nodes; company: rows in all buckets of a node."""
    rows = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = settle(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    size = bits.size_for(shared.count(), 16)
    mark = settle(bits.bitmap(shared.select(bits.cells(F.col("bucket"), size, 1)[0].alias("cell")), "cell"), "bucket-marks")
    # A bitmap of bounded size keeps the rows of buckets with a single node out of the shuffle.
    rows = bits.probe(rows, mark, bits.cells(F.col("bucket"), size, 1), "__shared").where("__shared").drop("__shared")
    rows = settle(rows.join(shared, "bucket"), "bucket-rows")
    company = rows.groupBy("node").agg(F.sum("n").alias("company"))
    return settle(rows.join(company, "node").select("bucket", "node", "company"), "bucket-members")


def _stars(rows: DataFrame) -> DataFrame:
    """Each bucket's members beside the one with most company, the smallest id first; a partial maximum, written
    first so that the join of a large bucket can be split."""
    top = settle(rows.groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre")), "centres")
    return rows.join(top, "bucket").where("centre <> node")


def similar_components(docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reached over
    links), kept (doc_id is its component's smallest).

    Documents are linked where 100 * common shingles >= percent * shingles of either. Null and empty
    texts, and texts of white space, have no shingles and no links; fewer than ``width`` words are one
    shingle. Rows that repeat a doc_id are one document with several texts: a link of any is a link
    of the document. A null doc_id has no links, a null component and is kept. An empty table
    gives an empty result; further columns are ignored.
    """
    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settle(source.mapInArrow(
        _signatures(width), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    named = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = settle(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"),
                     "equal-sets")
    copies = settle(named.join(classes, "set_key").where("doc_id <> rep").select("doc_id", "set_key", "rep"), "set-copies")
    # Only the copied text leaves; another text of the same doc_id stays.
    nodes = named.join(copies.select("doc_id", "set_key"), ["doc_id", "set_key"], "left_anti")
    members = _bucket_rows(nodes)
    candidates = settle(members.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    sets = _candidate_sets(source, candidates, width)
    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    stars = settle(_stars(members), "stars")
    edges = stars.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = links.unionByName(settle(confirmed(edges, sets, percent), "links"))
    label = components(links)
    uncovered = settle(_uncovered(stars, label), "uncovered")
    if uncovered.isEmpty():
        return _result(signed, label)
    pairs = settle(_partners(uncovered, sets, percent), "partners")
    share = FIRST_SHARE if pairs.count() > FIRST_PAIRS else 1
    place = F.pmod(F.xxhash64("a", "b"), F.lit(share))
    # Where there are many, a part of the pairs joins most of the components and spares the rest.
    for part in [place == 0, place > 0][:min(share, 2)]:
        found = settle(confirmed(_across(pairs.where(part), label), sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            label = components(links)
    return _result(signed, label)


def _labelled(rows: DataFrame, label: DataFrame, *ends: str) -> DataFrame:
    """``rows`` with the component c<end> of each named column; a node without links is its own."""
    for end in ends:
        rows = rows.join(label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        rows = rows.withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return rows


def _across(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between different components."""
    return _labelled(edges, label, "a", "b").where("ca <> cb").select("a", "b")


def _uncovered(stars: DataFrame, label: DataFrame) -> DataFrame:
    """(node, component, apart) of the members of buckets that hold one outside the centre's component;
    apart: it is such a member of one."""
    rows = settle(_labelled(stars, label, "centre", "node"), "star-components")
    loose = settle(rows.where("ccentre <> cnode").select("bucket", "node").distinct(), "loose")
    buckets = loose.select("bucket").distinct()
    some = rows.join(buckets, "bucket", "left_semi")
    members = some.select("node", F.col("cnode").alias("component")).unionByName(
        some.select(F.col("centre").alias("node"), F.col("ccentre").alias("component"))).distinct()
    apart = loose.select("node").distinct().withColumn("apart", F.lit(True))
    return members.join(apart, "node", "left").select("node", "component", F.coalesce("apart", F.lit(False)).alias("apart"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for one in batch.column("shingles").to_pylist():
            # A set's shingles may meet in a cell; each counts.
            np.add.at(counts, _cell(np.frombuffer(one, np.uint64)), 1)
    cells = np.flatnonzero(counts)
    for at in range(0, len(cells), 65_536):
        some = cells[at:at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["cell", "n"])


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _frequency(sets: DataFrame) -> np.ndarray:
    """log2 of the shingles in each cell, 0 for one: ``2 ** CELL_BITS`` bytes whatever the corpus."""
    counted = sets.select("shingles").mapInArrow(_counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = counted.select("cell", F.floor(F.log2("n") + 1e-9).cast("byte").alias("power")).where("n > 1").toArrow()
    out = np.zeros(1 << CELL_BITS, np.uint8)
    out[table.column("cell").to_numpy()] = table.column("power").to_numpy()
    return out


def _ceil_div(a, b):
    return -(-a // b)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each hash value modulo the sketch's size, turned for each shingle in it: two sketches of one
    size differ in no more bits than their sets in shingles. Sizes are powers of two of 2-4 bits a shingle."""
    bits_ = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits_ - 1)).astype(np.int64), minlength=bits_) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The least number of shingles in which the sets of two sketches differ."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    # The halves of a sketch folded onto each other are the sketch of half the size.
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(frequency: np.ndarray, percent: int):
    """Rows (shingle, node, component, apart, n, place, short) of the shingles that a linked pair can share first.

    Shingles are ordered by frequency, then by hash. Linked sets x, y with |x| <= |y| have
    least = ceil(percent * (|x| + |y|) / (100 + percent)) common shingles, and so the smallest common one is
    among the first |x| - least + 1 of x and the first |y| - least + 1 of y. With |y| >= |x| the first of these
    is at most |x| - ceil(2 * percent * |x| / (100 + percent)) + 1 (``short`` rows), with
    |x| >= percent * |y| / 100 the other at most |y| - ceil(percent * |y| / 100) + 1. Shingles alone in
    their cell are in one set only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for i, one in enumerate(batch.column("shingles").to_pylist()):
                hashes = np.frombuffer(one, np.uint64)
                n = len(hashes)
                power = frequency[_cell(hashes)]
                order = np.argsort(power, kind="stable")[:n - _ceil_div(percent * n, 100) + 1]
                place = np.arange(1, len(order) + 1)
                shared = power[order] > 0
                order, place = order[shared], place[shared]
                parts.append([hashes[order].view(np.int64), np.full(len(order), i), np.full(len(order), n), place,
                              place <= n - _ceil_div(2 * percent * n, 100 + percent) + 1])
            if not parts:
                continue
            shingle, row, n, place, short = (np.concatenate(x) for x in zip(*parts))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle, pa.int64()), *[batch.column(c).take(row) for c in ("node", "component", "apart")],
                 pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(short)],
                names=["shingle", "node", "component", "apart", "n", "place", "short"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int32()),
                                          pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "n", "sketch"])


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "left", "right")]
            keep = [differing(x, y) <= na + nb - 2 * _ceil_div(percent * (na + nb), 100 + percent)
                    for na, nb, x, y in zip(*columns)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _partners(uncovered: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components, one of them apart: all pairs that can be linked.

    Exact: both bounds hold for every linked pair. Long lists of a shingle are split by AQE.
    """
    own = settle(sets.join(uncovered, "node").select("node", "component", "apart", "shingles"), "uncovered-sets")
    rows = settle(own.mapInArrow(
        _prefixes(_frequency(own), percent),
        "shingle long, node long, component long, apart boolean, n int, place int, short boolean"), "prefixes")
    # A list needs a member that is apart, and another component.
    lists = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.max("apart").alias("some")).where("low <> high AND some").select("shingle")
    rows = settle(rows.join(lists, "shingle", "left_semi"), "shared-prefixes")
    x = rows.where("short").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "component", "apart", "n", "place")])
    y = rows.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("node", "component", "apart", "n", "place")])
    least = F.expr(f"({percent}L * (x_n + y_n) + {99 + percent}L) DIV {100 + percent}")
    met = x.join(y, "shingle").where("x_component <> y_component AND (x_apart OR y_apart)").where(
        "x_n < y_n OR (x_n = y_n AND x_node < y_node)").where(f"x_n * 100L >= y_n * {percent}L").where(
        (F.col("x_place") <= F.col("x_n") - least + 1) & (F.col("y_place") <= F.col("y_n") - least + 1))
    pairs = settle(met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"), F.col("x_n").alias("na"),
                              F.col("y_n").alias("nb")).distinct(), "met")
    made = settle(own.mapInArrow(_sketches, "node long, n int, sketch binary"), "sketches")
    return (pairs.join(made.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("left")), ["a", "na"])
            .join(made.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("right")), ["b", "nb"])
            .select("a", "b", "na", "nb", "left", "right").mapInArrow(_close(percent), "a long, b long").distinct())


def _candidate_sets(source: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents that share a bucket; the others' texts are not shuffled."""
    size = bits.size_for(candidates.count(), 16)
    mark = settle(bits.bitmap(candidates.select(bits.cells(F.xxhash64("doc_id"), size, 1)[0].alias("cell")), "cell"),
                  "candidate-marks")
    rows = bits.probe(source.where("doc_id IS NOT NULL"), mark, bits.cells(F.xxhash64("doc_id"), size, 1), "__maybe")
    rows = rows.where("__maybe").join(candidates, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    return settle(rows.mapInArrow(_sets(width), "node long, shingles binary"), "shingle-sets")


def _result(signed: DataFrame, label: DataFrame) -> DataFrame:
    component = F.coalesce("component", "doc_id")
    named = signed.where("doc_id IS NOT NULL").join(label, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    rest = signed.where("doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(rest)


def drop_similar(docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns. Rows that are kept are not shuffled
    where the dropped ids are few enough for Spark to send them round."""
    judged = similar_components(docs, width, percent, id_col, text_col)
    gone = settle(judged.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
