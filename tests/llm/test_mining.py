"""Quality rules, hard negatives and resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import divergence as D
from pulsegrid.llm import negatives as N
from pulsegrid.llm import plans
from pulsegrid.llm import resample as R
from tests.helpers import plan
from tests.llm import brute

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, kept string, n_words string, label string"


# ---- quality rules ----

def counts(text):
    w, places = WORDS.findall(text or ""), collections.defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i:i + 5])].append(i)
    again = len({p + k for v in places.values() if len(v) > 1 for p in v for k in range(5)})
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again)


ODD = [
    (-1, None), (-2, ""), (-3, " \t\n\x0b\x0c\r "), (-4, "a b c d e " * 30000), (-5, "one\n\n \none\none \r\none"), (-6, "  é ü 😀#<>"),
    (-7, "a b c d e f a b c d e a b c d e"), (-7, "x x x x x x"), (None, "a b c d"), (-8, "\x1f\x00 a\x85b"), (-9, "q" * 200000),
    (-10, " lead and trail \n"),
]


def quality_docs(spark, odd=ODD):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "'x' kept", "'y' n_words", "'z' label")
    return docs.unionByName(spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in odd], DOC))


def test_rule_counts_match_plain_counts(spark):
    docs = quality_docs(spark)
    want = collections.Counter((r.doc_id, *counts(r.text)) for r in docs.collect())
    got = D.judge_quality(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
        assert r.n_words < D.LEAST_WORDS or r.class_distance is not None


def divergence(p, q):
    p, q = np.asarray(p, float), np.asarray(q, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [np.where(x > 0, x * np.log2(2 * x / (p + q)), 0).sum() for x in (p, q)]
    return math.sqrt(max(0, sum(sides) / 2))


def test_distances_match_plain_histograms(spark):
    docs = quality_docs(spark)
    refs = D.references(docs)
    assert len(refs.classes) >= 2 and all(abs(sum(c) - 1) < 1e-9 for c in refs.classes) and all(abs(sum(w) - 1) < 1e-9 for w in refs.words)
    vocabulary = {w for r in docs.collect() for w in WORDS.findall(r.text or "")}
    hashed = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    code = {r.w: refs.hashes.index(r.h) for r in hashed if r.h in refs.hashes[1:]}
    assert len(code) == len(refs.hashes) - 1
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in D.judge(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), refs).collect()}
    for doc_id, text in texts:
        w, r = WORDS.findall(text or ""), got[doc_id]
        if len(w) < 20 or doc_id is None or r.n_words != len(w):
            continue
        own = np.bincount([code.get(x, 0) for x in w], minlength=len(refs.hashes)) / len(w)
        assert abs(min(divergence(own, q) for q in refs.words) - r.word_distance) < 1e-6
        left, shares = text, []
        for pattern in D.CLASSES:
            rest = re.sub(pattern, "", left)
            shares.append(len(left) - len(rest))
            left = rest
        shares = np.array([*shares, len(left)]) / len(text)
        assert abs(min(divergence(shares, q) for q in refs.classes) - r.class_distance) < 1e-6


def test_rules_leave_clean_texts_and_drop_poor_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = D.judge_quality(docs).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    poor = [r for r in rows if r.quality == 0]
    assert len(clean) > 3000 and all(r.kept for r in clean)
    assert sum(not r.kept for r in poor) > 0.9 * len(poor)


def test_rules_without_references(spark):
    docs = spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in ODD] + [(1, "%%% ### " * 100 + "a b c d e f g h", None, "", "", "")], DOC)
    rows = D.judge_quality(docs).collect()
    assert len(rows) == len(ODD) + 1 and all(r.class_distance is None and r.kept == (not r.base_failed) for r in rows)
    assert D.judge_quality(spark.createDataFrame([], DOC)).count() == 0


def test_rules_stay_in_the_jvm(spark):
    text = plan(D.judge(quality_docs(spark), D.references(quality_docs(spark))))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


# ---- hard negatives ----

VEC = "vec_id long, embedding array<float>, label int, rank string, score string, lane string"


def mined(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c, *_ in rows
              if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    anchors = {}
    for i, v, c in usable:
        if is_anchor(i):
            raw = min((c2, [float(np.float32(x)) for x in v2]) for i2, v2, c2, *_ in rows if i2 == i and (i2, c2) and v2 is not None
                      and c2 is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v2))
            anchors[i] = (raw[0], [math.floor(256 * x) for x in raw[1]])
    out = set()
    for a, (label, vector) in anchors.items():
        scores = {True: {}, False: {}}
        for i, v, c in usable:
            s = sum(x * y for x, y in zip(v, vector))
            side = scores[c == label]
            side[i] = max(side.get(i, s), s)
        first = sorted(((s, i) for i, s in scores[True].items() if i != a), key=lambda x: (-x[0], x[1]))[:positives]
        for p, pos in first:
            # An id counts once, with its best score inside the window.
            inside = {}
            for i, v, c in usable:
                s = sum(x * y for x, y in zip(v, vector))
                if c != label and low * p <= 100 * s <= high * p:
                    inside[i] = max(inside.get(i, s), s)
            for k, (i, s) in enumerate(sorted(inside.items(), key=lambda x: (-x[1], x[0]))[:negatives], 1):
                out.add((a, pos, k, i, p, s))
    return out


def vectors(rng, n, dim, labels=3, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.randrange(labels), "r", "s", "l") for i in range(n)]


def run_mining(spark, rows, is_anchor, **named):
    df = spark.createDataFrame(rows, VEC).repartition(3)
    return {tuple(r) for r in N.hard_negatives(df, is_anchor, **named).collect()}


def test_negatives_match_brute_force(spark):
    rng = random.Random(5)
    rows = vectors(rng, 400, 20)
    rows += [(1000 + i, rows[7][1], i % 3, "r", "s", "l") for i in range(40)]  # ties
    rows += [(None, rows[0][1], 1, "", "", ""), (2000, None, 1, "", "", ""), (2001, rows[0][1], None, "", "", ""),
             (2010, [float("nan")] * 20, 1, "", "", ""), (2020, [1.0, None] + [0.0] * 18, 1, "", "", ""), (2030, [float("inf")] * 20, 1, "", "", "")]
    rows += [(2040, [], 1, "", "", ""), (2050, [0.5, -0.5], 2, "", "", ""), (2060, [0.3] * 25, 1, "", "", "")]
    rows += [(30, rows[31][1], 0, "", "", ""), (45, rows[45][1], rows[45][2], "", "", ""), (45, rows[60][1], rows[45][2], "", "", "")]
    want = mined(rows, lambda i: i % 10 == 0)
    for cells in (N.BLOCK_CELLS, 400):
        assert run_mining(spark, rows, F.col("vec_id") % 10 == 0, block_cells=cells) == want
    assert len(want) > 300


@pytest.mark.parametrize("spread", [1e3, 1e9])
def test_large_numbers_are_exact(spark, spread):
    rows = [(i, [float(np.float32(x)) for x in v], c, *rest) for i, v, c, *rest in vectors(random.Random(6), 60, 3, spread=spread)]
    if spread > 1e6:
        with pytest.raises(Exception):  # beyond 64 bits
            run_mining(spark, [(i, [x * 1e9 for x in v], c, *r) for i, v, c, *r in rows], F.col("vec_id") % 10 == 0)
        rows = [(i, v[:1], c, *r) for i, v, c, *r in rows if abs(v[0]) < 5e6] + [(70, [4.0e6], 0, "", "", ""), (71, [4.1e6], 0, "", "", ""),
                                                                               (72, [4.05e6], 1, "", "", "")]
        assert run_mining(spark, rows, F.col("vec_id") == 70) == mined(rows, lambda i: i == 70)
        return
    assert run_mining(spark, rows, F.col("vec_id") % 10 == 0) == mined(rows, lambda i: i % 10 == 0)


def test_other_windows_and_empty_tables(spark):
    rows = vectors(random.Random(7), 200, 8)
    named = {"positives": 3, "negatives": 2, "low_percent": 50, "high_percent": 120}
    assert run_mining(spark, rows, F.col("vec_id") % 20 == 0, **named) == mined(rows, lambda i: i % 20 == 0, 3, 2, 50, 120)
    assert run_mining(spark, [], F.col("vec_id") % 20 == 0) == set()
    assert run_mining(spark, rows, F.col("vec_id") < 0) == set()


def test_scan_shrinks_the_candidates():
    """Vectors with most of their length in a few dimensions: most rows are left unread in the others."""
    rng = np.random.default_rng(1)
    cells = np.floor(rng.normal(size=(64, 20000)) * (200 * 0.85 ** np.arange(64))[:, None]).clip(-30000, 30000)
    block = N.Block(20000, 64, np.arange(20000).astype("<i8").tobytes(), np.zeros(20000, "<i8").tobytes(), cells.astype("<i2").tobytes())
    counted = []
    vector = cells[:, 5]
    (found,) = N.vertical_scan(block, vector, np.arange(20000) != 5, 0, [(-N.NO_LIMIT, N.NO_LIMIT)], 5, counted)
    exact = vector @ cells
    want = sorted((int(i) for i in range(20000) if i != 5), key=lambda i: (-exact[i], i))[:5]
    assert [i for _, i in found] == want
    assert counted[0] == 20000 and counted[-1] < 1000


def test_hot_label_is_spread_over_blocks(spark):
    rows = [(i, v, 0 if i % 3 else c, *rest) for i, v, c, *rest in vectors(random.Random(9), 900, 4)]
    blocks = N.column_blocks(N.usable(spark.createDataFrame(rows, VEC).repartition(4), "vec_id", "embedding", F.col("label")), cells=400)
    assert max(r.n for r in blocks.collect()) <= 325 and blocks.count() >= 3


# ---- resampling ----

def drawn(docs, target, percent=10, least=20, width=1):
    def runs(text):
        w = brute.folded(text)
        return w, [" ".join(w[i:i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % R.BUCKETS

    s, t = collections.Counter(), collections.Counter()
    for counter, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counter.update(map(bucket, runs(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, own = runs(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_t * 0 + big_s + R.BUCKETS) / ((s[b] + 1) * (big_t + R.BUCKETS)))) for b in map(bucket, own)]
        weight, score = sum(gains) // len(gains) if gains else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(w)])
    order = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(order[:percent * len(order) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("width,percent", [(1, 10), (2, 60)])
def test_resample_matches_brute_force(spark, width, percent):
    docs = quality_docs(spark)
    target = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("text", "'a' AS doc_id").unionByName(
        spark.createDataFrame([(None, "x"), ("", "x")], "text string, doc_id string"))
    want = drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, width=width)
    got = R.resample(docs, target, percent=percent, width=width)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert R.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "a " * 30, None, "", "", ""), (1, "a " * 30, None, "", "", ""), (2, "a " * 30, None, "", "", "")], DOC)
    rows = R.resample(few, none, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3] and [r.n_features for r in rows] == [30] * 3


def test_radix_sort_is_stable_and_whole(spark):
    rng = random.Random(3)
    edge = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    rows = [(rng.choice(edge) if k % 9 == 0 else 7 if k % 3 == 0 else rng.randrange(-50, 50), rng.randrange(-5, 5), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b int, k int").repartition(5, "k")
    got = R.radix_places(df, [("a", True), ("b", False)], chunk=100, bits=8).collect()
    assert sorted(r.place for r in got) == list(range(3000))
    in_order = [(-r.a, r.b) for r in sorted(got, key=lambda r: r.place)]
    assert in_order == sorted(in_order)
    same = spark.createDataFrame([(5, k) for k in range(50)], "a long, k int").coalesce(1)
    assert [r.k for r in sorted(R.radix_places(same, [("a", False)]).collect(), key=lambda r: r.place)] == list(range(50))
    assert R.radix_places(df.where("k < 0"), [("a", False)]).count() == 0


def test_hot_digit_is_split_by_parts(spark):
    """Half the rows share every digit of the score: the groups that are numbered hold at most a chunk."""
    df = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id")).alias("score"), "id")
    got = R.radix_places(df, [("score", True), ("id", False)], chunk=128)
    assert got.where("score = 9").agg(F.max("place") - F.min("place") + 1).scalar() is not None
    places = sorted((r.place, -r.score, r.id) for r in got.collect())
    assert [p[1:] for p in places] == sorted(p[1:] for p in places) and len(places) == 4000


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_hard_negatives", "op13_resampling"])
def test_queries_cover_whole_tables(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    if name == "op12_hard_negatives":
        table = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in
                 spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        assert {tuple(r) for r in rows} == mined(table, lambda i: i % 100 == 0)
    else:
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
