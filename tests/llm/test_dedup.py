import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bits, exact, near
from pulsegrid.llm.components import _large_star, components
from tests.helpers import plan
from tests.llm import brute

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, source string, sha string, bucket int"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in texts], DOC)


EDGE = [(1, None), (2, ""), (3, "a  b"), (4, "a\t\nb"), (5, " a b"), (6, "ä b"), (6, "a b"), (None, "a b"), (None, "q"), (7, "z " * 90000)]


def test_exact_edges(spark):
    rows = {(r.doc_id, r.text_sha256): r for r in exact.verdicts(docs_of(spark, EDGE)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(EDGE)
    assert (rows[1, sha("")].keep_id, rows[2, sha("")].kept, rows[2, sha("")].group_size) == (1, False, 2)
    assert [rows[d, sha("a b")].keep_id for d in (3, 4, 6, None)] == [3] * 4 and rows[3, sha("a b")].group_size == 4
    assert rows[5, sha(" a b")].kept and rows[6, sha("ä b")].kept and rows[None, sha("q")].kept
    assert not rows[None, sha("a b")].kept
    assert rows[7, sha("z " * 90000)].kept


def test_exact_drops_what_verdicts_drop(spark):
    docs = docs_of(spark, EDGE)
    kept = sorted(str((r.doc_id, r.text)) for r in exact.drop_copies(docs).collect())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for d, t in EDGE:
        first[norm(t)] = min([x for x in (first.get(norm(t)), d) if x is not None], default=None)
    assert kept == sorted(str((d, t)) for d, t in EDGE if d == first[norm(t)])
    assert exact.drop_copies(docs).columns == docs.columns


def test_exact_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact.verdicts(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_full_filter_keeps_the_result(spark, monkeypatch):
    """A filter far too small only sends more rows to the shuffle."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, exact.verdicts(docs).collect()))
    monkeypatch.setattr(bits, "size_for", lambda *a, **b: 256)
    assert sorted(map(tuple, exact.verdicts(docs).collect())) == want


def test_unrepeated_rows_are_not_shuffled(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.md5(F.col("id").cast("string"))).alias("text"))
    hashed = docs.select("doc_id", exact.digest(F.col("text")).alias("sha"))
    size = bits.size_for(4000)
    marked = exact._probed(hashed, exact.repeat_filter(hashed, size), size)
    n = {r["__maybe"]: r["count"] for r in marked.groupBy("__maybe").count().collect()}
    assert n[False] > 2500 and n[True] >= 1334
    text = plan(exact.verdicts(docs))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_near_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets, want = brute.components([(r.doc_id, r.text) for r in docs.collect()])
    got = near.similar_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(sets[d]), c, c == d) for d, c in want.items()}


def test_near_family_chains_and_ties(spark):
    """A hub of many copies that do not resemble each other, and a chain of copies of copies."""
    rng = random.Random(3)
    base = words(rng, 400).split()

    def changed(source, n):
        out = list(source)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"new{rng.randrange(10 ** 6)}"
        return out

    texts = [(i + 10, " ".join(changed(base, 6))) for i in range(120)] + [(500, " ".join(base))]
    chain = words(rng, 300).split()
    for i in range(12):
        texts.append((1000 - i, " ".join(chain)))
        chain = changed(chain, 3)
    texts += [(2000 + i, words(rng, 50)) for i in range(40)] + [(3000, "one two three"), (3001, "One\ttwo THREE"), (3002, "one two")]
    texts += [(3003, None), (3004, ""), (3005, " \n"), (3006, texts[0][1]), (3006, texts[0][1])]
    sets, want = brute.components(texts)
    got = {r.doc_id: r for r in near.similar_components(docs_of(spark, texts + [(None, "x y")])).collect()}
    assert {d: got[d].component_id for d in want} == want
    assert got[3003].n_shingles == 0 and got[3003].kept and got[None].kept and got[None].component_id is None
    assert len(set(want.values()) & set(range(1000 - 11, 1001))) == 1


def test_near_common_passage(spark):
    """Hundreds of documents around one passage are not linked, real copies among them are."""
    rng = random.Random(5)
    passage = words(rng, 120)
    texts = [(i, passage + " " + words(rng, 60)) for i in range(300)]
    texts += [(1000 + i, texts[i][1] + " tail") for i in range(0, 300, 10)]
    _, want = brute.components(texts)
    got = {r.doc_id: r.component_id for r in near.similar_components(docs_of(spark, texts)).collect()}
    assert got == want and sum(c != d for d, c in want.items()) == 30


def altered(rng, source, share):
    """``source`` with words changed one by one until about ``share`` of its shingles are others."""
    out, left = list(source), set(range(len(source)))
    while len(left) > (1 - share) * len(source):
        i = rng.randrange(len(out))
        out[i] = f"new{rng.randrange(10 ** 9)}"
        left -= set(range(i - 4, i + 1))
    return out


def test_near_crowd_below_the_threshold(spark):
    """Form pages that share nine tenths are not linked; pairs just above the threshold among them all are."""
    rng = random.Random(11)
    form = words(rng, 900)
    texts = [(i, form + " " + words(rng, 95)) for i in range(400)]
    for i in range(0, 400, 4):
        page = texts[i][1].split()
        own = 900 + rng.randrange(0, 25)
        texts.append((1000 + i, " ".join(page[:own] + words(rng, 995 - own - 17).split() + page[978:])))
    for i in range(2, 400, 8):
        texts.append((2000 + i, " ".join(texts[i][1].split()[:900] + altered(rng, texts[i][1].split()[900:], rng.choice([0.7, 0.75])))))
    _, want = brute.components(texts)
    got = {r.doc_id: r.component_id for r in near.similar_components(docs_of(spark, texts)).collect()}
    assert sum(c != d for d, c in want.items()) >= 40 and got == want


def test_near_copies_of_covered_copies(spark):
    """c - m1 - m2 with c and m2 just below the threshold, and another family member beside them."""
    rng = random.Random(12)
    texts = []
    for k in range(60):
        c = words(rng, 1000).split()
        m1 = list(c)
        m1[500] = f"other{k}"
        m2 = altered(rng, m1, 0.078)
        texts += [(10 * k, " ".join(c)), (10 * k + 1, " ".join(m1)), (10 * k + 2, " ".join(m2))]
        # Company for the original.
        texts += [(10 * k + 3 + i, " ".join(altered(rng, c, 0.01))) for i in range(3)]
    _, want = brute.components(texts)
    got = {r.doc_id: r.component_id for r in near.similar_components(docs_of(spark, texts)).collect()}
    assert sum(want[10 * k + 2] == 10 * k for k in range(60)) >= 20 and got == want


def test_near_second_text_of_a_copy(spark):
    """doc_id 5 has a copy of 1's text and a text near 9's: all three are one component."""
    rng = random.Random(13)
    a, b = words(rng, 200), words(rng, 300)
    got = {r.doc_id: r.component_id for r in near.similar_components(
        docs_of(spark, [(1, a), (5, a), (5, b), (9, b + " tail"), (12, words(rng, 80))])).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 12: 12}


def test_near_bounds_hold_for_linked_sets():
    """No linked pair is lost by the prefixes or the sketches."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40, 333, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(n) > 0.12], rng.integers(0, 1 << 63, 1 + n // 20, dtype=np.uint64)])
            apart = len(np.setxor1d(a, b))
            assert near.differing(near.sketch(a), near.sketch(b)) <= apart
            assert n < 40 or near.differing(near.sketch(a), near.sketch(b)) > apart / 2


def test_near_empty_and_drop(spark):
    empty = spark.createDataFrame([], DOC)
    assert near.similar_components(empty).count() == 0
    docs = docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f")])
    kept = near.drop_similar(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]


def test_densified_bins_agree_with_similarity():
    rng = random.Random(1)
    signer, words_of = near.Signer(), near.Remembered()
    for n in (3, 30, 400):
        text = words(rng, n).encode()
        s = near.shingle_set(text, words_of, 5)
        t = near.shingle_set(text + b" more", words_of, 5)
        jaccard = len(set(s.tolist()) & set(t.tolist())) / len(set(s.tolist()) | set(t.tolist()))
        same = (signer.bin_values(s) == signer.bin_values(t)).mean()
        assert abs(same - jaccard) < 0.3
    assert len(set(signer.band_hashes(s).tolist())) == near.BANDS


@pytest.mark.parametrize("links,want", [
    ([], {}), ([(1, 1)], {}), ([(None, 2)], {}), ([(3, 2), (2, 3), (9, 3)], {2: 2, 3: 2, 9: 2}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(100, i) for i in range(50)] + [(200, 201)], {**{i: 0 for i in range(50)}, 100: 0, 200: 200, 201: 200}),
])
def test_components(spark, links, want):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_hub_joins_are_split(spark):
    """Half of all edges on one node: its rows are dealt to several tasks in the components and in the stars."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(0, 100_000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") * 31 % 9973 + 10).alias("u"), (F.col("id") + 20_000).alias("v"))
        for made in (_large_star(edges), near._stars(edges.select(F.col("u").alias("bucket"), F.col("v").alias("node"), (F.col("v") % 7).alias("company")))):
            made.collect()
            assert "skew=true" in made._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_groups_of_sf(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect())
    assert exact.drop_copies(docs).count() == len(groups)
