import hashlib
import pickle
import random
import re._parser as parser
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import decontam, licenses, packing, sharding, urls
from pulsegrid.llm.tokens import Encoder
from tests.llm import brute

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path(packing.VOCABULARY)
DOC = "doc_id long, text string, row long, hits string, items string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0, "h", None) for i, t in texts], DOC)


# ---- decontamination ----

ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "short item"), (3, None), (4, ""), (5, "!!"),
         (6, "a a a a a a a a a a a"), (2, "short item")]
TEXTS = [(1, "x the QUICK, brown fox jumps over the lazy dog near y"), (2, "a short-item, and a shorter item"), (3, None), (4, ""),
         (5, "a " * 40), (6, "über Short Item"), (6, "nothing"), (None, "short item"), (7, "w " * 60000 + "short item")]


@pytest.mark.parametrize("block", [decontam.BLOCK_NODES, 300])
def test_leaks_match_brute_force(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_leaks(docs_of(spark, TEXTS), items, block_nodes=block).collect()
    want = []
    for d, t in TEXTS:
        places, found = brute.hits(t, ITEMS)
        want.append((d, len(brute.folded(t)), len(places), found, bool(places)))
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=key) == sorted(want, key=key)
    by = {(r.doc_id, r.n_words): r for r in got}
    text = dict(TEXTS[:6])
    span = by[1, 12].spans[0]
    assert text[1][span.start:span.end] == "the QUICK, brown fox jumps over the lazy dog near"
    span = by[6, 3].spans[0]
    assert text[6][span.start:span.end] == "Short Item"
    kept = decontam.drop_leaks(docs_of(spark, TEXTS), items, block_nodes=block)
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for d, t in TEXTS if not brute.hits(t, ITEMS)[0])


def test_blocks_stay_below_the_bound_and_lose_no_window(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    items = spark.createDataFrame([("a", long), ("b", "one two"), ("c", None)], "item_id string, text string")
    blocks = [pickle.loads(b) for b, _ in decontam._blocks(items, 10, 20_000)]
    assert len(blocks) > 5
    for block in blocks:
        found = decontam.automaton(block)
        assert found.get_stats()["nodes_count"] <= 20_000 + 1
    want = {("a", n, k) for n, k in decontam.item_windows(long, 10)} | {("b", 2, b" one two ")}
    assert {w for b in blocks for w in b} == want and sum(map(len, blocks)) == len(want)


def test_a_worker_keeps_its_automaton():
    block = pickle.dumps([("a", 1, b" x ")])
    assert decontam.built(block) is decontam.built(bytes(block))
    assert decontam.built(pickle.dumps([])) is None


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs_of(spark, []), none).count() == 0
    got = decontam.find_leaks(docs_of(spark, [(1, "a b")]), none).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (2, 0, False)


def test_leaks_of_sf(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    got = {r.doc_id: r for r in decontam.find_leaks(docs, items).collect()}
    some = 0
    for r in docs.collect():
        places, found = brute.hits(r.text, rows)
        some += bool(found)
        assert (got[r.doc_id].n_hit, got[r.doc_id]["items"]) == (len(places), found)
    assert some


# ---- packing ----

def unpacked(rows):
    """Checks the sequences, and gives each document its ids back."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    out = {}
    for doc, pieces in documents.items():
        ids = []
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == len(ids) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            ids += r.ids
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        out[doc] = ids
    return out, [sum(r.length for r in p) for p in sequences.values()]


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    whole = Tokenizer.from_file(VOCABULARY)
    got, sizes = unpacked(packing.pack_documents(docs, keep_ids=True).collect())
    assert got == {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "long " * 30000), (4, "x")]
    got, _ = unpacked(packing.pack_documents(docs_of(spark, texts), keep_ids=True).collect())
    assert got[1] == got[2] == [1] and len(got[3]) == 30001
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    twice = packing.pack_documents(docs_of(spark, [(5, "a b"), (5, "a b")])).collect()
    assert sum(r.length for r in twice) == 6 and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


@pytest.mark.parametrize("tokens", [1, 3, 5, 6])
def test_short_examples_fill_their_sequences(tokens):
    """20,000 examples of equal length: every sequence is full but the last ones, whose lengths are powers of two."""
    packer, sizes = packing.Packer(), []
    for i in range(20_000):
        sizes += [sum(len(p.ids) for p in s) for s in packer.add(packing.Piece(i, tokens, 0, np.ones(tokens, np.uint32)))]
    sizes += [sum(len(p.ids) for p in s) for s in packer.finish()]
    assert sum(sizes) == 20_000 * tokens and not [n for n in sizes if n & (n - 1)]
    assert len(sizes) <= 20_000 * tokens // 2048 + 12


def test_all_limits_hold(spark):
    rng = random.Random(2)
    rows = [(i, [i] * rng.randrange(1, 60), None) for i in range(80)]
    rows = [(i, ids, [int(rng.random() < 0.5) for _ in ids] if i % 3 else None) for i, ids, _ in rows] + [(99, [], None), (98, None, None)]
    df = spark.createDataFrame(rows, "example_id long, ids array<long>, loss array<int>")
    limits = packing.Limits(tokens=100, segments=4, loss=60)
    got = packing.pack_examples(df, limits).collect()
    assert sorted(r.doc_id for r in got) == list(range(80)) and all(r.start == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        assert sum(r.length for r in pieces) <= 100 and len(pieces) <= 4 and sum(r.loss_tokens for r in pieces) <= 60
    demand = max(sum(r.length for r in got) / 100, len(got) / 4, sum(r.loss_tokens for r in got) / 60)
    assert len(by) <= 1.35 * demand + 4
    cut = packing.pack_examples(df, packing.Limits(tokens=32, segments=4, loss=16), cut=True).collect()
    by = {}
    for r in cut:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in p) <= 32 and len(p) <= 4 and sum(r.loss_tokens for r in p) <= 16 for p in by.values())
    assert sum(r.length for r in cut) == sum(r.length for r in got)
    with pytest.raises(Exception, match="may not be cut"):
        packing.pack_examples(df, packing.Limits(tokens=8)).collect()


ENCODER, WHOLE = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé'’.,! \n\t0 9ñÉİΣß中<|sxrvted\x00\x0b\x1c\u0301\u200b"), max_size=40), max_size=4))
def test_encoder_agrees_with_the_tokenizer(texts):
    for text, ids in zip(texts, ENCODER.encode([t.encode() for t in texts])):
        assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    small = Encoder(VOCABULARY, remembered=5)
    texts = ["alpha beta gamma", "delta <|endoftext|> epsilon", "x" * 300 + " y", "alpha zeta"] * 3
    for t in texts:
        assert next(small.encode([t.encode()])).tolist() == WHOLE.encode(t, add_special_tokens=False).ids


# ---- urls ----

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
         ("b.c.com/fr/", "block"), ("com/fr/x", "block"), (None, "allow"), ("org/", "allow")]
URLS = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x#y", "http://example.org", "http://myexample.org/es/", "http://x.com/fr/x1",
        "http://a.b.c.com/fr/9", "nourl", None, "://", "http://com/de/", "http://x.net/a?b/c", "http://h?q=/es/", "http://é.org/ü", "x://y.org/a\nb",
        "http://org/", "http://.org/", "http://example.org./es/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].translate(brute.LOW), rest[cut:]
    path = tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(r), v == "block", r, v) for r, v in RULES if r is not None and path.startswith("/" + r.partition("/")[2])
            and (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("block", [16 << 20, 10])
def test_urls_match_brute_force(spark, block):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = urls.judge_urls(pages, rules, block_bytes=block).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: judged(u) for i, u in enumerate(URLS + URLS[:2])}


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string")).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge_urls(one, spark.createDataFrame([], "rule string, verdict string")).first().verdict == "allow"


def test_sweep_matches_all_rules():
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    rules = sorted({urls.parse_rule(h + rng.choice(["/", "/x", "/x/y"]), rng.choice(["allow", "block"])) for h in hosts[:60]}, key=lambda r: r.key)
    paths = [rng.choice(["", "/", "/x", "/x/y/z"]) for _ in hosts]
    keys = [urls.host_key(h) for h in hosts]
    want = [max((r for r in rules if k.startswith(r.key) and p.startswith(r.path)), key=lambda r: r.rank, default=None) for k, p in zip(keys, paths)]
    assert urls.sweep(keys, paths, rules) == want


# ---- sharding ----

def test_table_is_even_and_stable():
    names = [f"n{i}" for i in range(20)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert (table != fewer)[table != 19].mean() < 0.1
    assert (sharding.lookup_table(names[::-1], 1009) == 19 - table).all()
    weighted = np.bincount(sharding.lookup_table(["a", "b"], 1009, {"a": 3}))
    assert 2.9 < weighted[0] / weighted[1] < 3.1


def test_table_claims_in_turns():
    """Against the plain rule: whole permutations, one claim a turn."""
    names, size = ["b", "a", "c"], 13
    order = {s: [(sharding._hash(s, b"start") + j * (sharding._hash(s, b"step") % (size - 1) + 1)) % size for j in range(size)] for s in names}
    want = {}
    while len(want) < size:
        for s in sorted(names):
            free = [x for x in order[s] if x not in want]
            if free:
                want[free[0]] = s
    assert [names[i] for i in sharding.lookup_table(names, size)] == [want[i] for i in range(size)]


def test_placement(spark):
    keys = [(i, "t") for i in range(300)] + [(5, "t"), (None, "t")]
    got = sharding.place(docs_of(spark, keys), ["x", "y", "z"], size=101).collect()
    table = sharding.lookup_table(["x", "y", "z"], 101)
    for r in got:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, "xyz"[table[slot]])
    assert len(got) == 302 and sharding.place(docs_of(spark, []), ["x"]).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


# ---- licenses ----

@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", ["apache"]),
    ("This program is under the GNU Lesser General Public License v2.1", ["lgpl"]),
    ("SPDX-License-Identifier: MPL-2.0", ["mpl"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("Released under the MIT License.", ["mit"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it", ["mit"]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]), ("http://www.apache.org/licenses/LICENSE-2.0", ["apache"]),
    ("https://opensource.org/licenses/MIT", ["mit"]), ("GPLv3", ["gpl"]), ("License: GPLv2+", ["gpl"]), ("under LGPL 2.1 or later", ["lgpl"]),
    ("This Source Code Form is subject to the terms of the MPL, v. 2.0.", ["mpl"]), ("The software is provided as is.", ["as-is"]),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY', ["as-is"]), ("Creative Commons Attribution-ShareAlike 4.0", ["cc-by-sa"]),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 License", ["cc-by-nc"]), ("Attribution-NonCommercial-NoDerivatives", ["cc-by-nc-nd"]),
    ("MIT OR Apache-2.0", ["apache", "mit"]), ("license = MIT or Apache-2.0", ["apache", "mit"]), ("SPDX-License-Identifier: (MIT OR GPL-2.0-only)", ["gpl", "mit"]),
    ("BSD 3-Clause", ["bsd"]), ("the new BSD license", ["bsd"]), ("released under the MIT licence", ["mit"]),
    ("neither the name may be used to endorse or promote products derived from this software", ["bsd"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    # No licence, or not the one that a part of the words names.
    ("BSD 4.3 manual", []), ("bsd sockets", []), ("sublicense: mit", []), ("mit and without", []), ("ruby and rails", []), ("an example-2 file", []),
    ("the mit-2 bus", []), ("it is provided as known", []), ("http://example.org/gpl-3.html", []), ("attribution of sales", []),
    ("a licence to kill", []), ("", []), ("this work is in the public domain", ["public-domain"]),
])
def test_detections(text, labels):
    assert sorted({d[0] for d in licenses.detections(text.encode())}) == labels


def forms(tree):
    """Texts that a parsed pattern matches: every branch, repeats the least number of times and once more."""
    out = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            own = [chr(value)]
        elif kind == "IN":
            first, what = str(value[0][0]), value[0][1]
            own = [chr(what) if first == "LITERAL" else chr(what[0]) if first == "RANGE" else "2"]
        elif kind == "SUBPATTERN":
            own = forms(value[-1])
        elif kind == "BRANCH":
            own = [f for branch in value[1] for f in forms(branch)]
        else:
            assert kind == "MAX_REPEAT", kind
            low, high, inner = value
            own = [f * n for n in {low, min(low + 1, high)} for f in forms(inner)]
        out = [a + b for a in out for b in own]
    return out


@pytest.mark.parametrize("label", licenses.FAMILIES)
def test_every_form_passes_its_gate(label):
    _, name, spdx = licenses.FAMILIES[label]
    texts = [f"license: {f}" for f in forms(parser.parse(spdx)) + forms(parser.parse(name))]
    texts += [f"released under the {f}" for f in forms(parser.parse(name))]
    texts += [f'"license": "{f}"' for f in forms(parser.parse(spdx))] + [f"SPDX-License-Identifier: {f}" for f in forms(parser.parse(spdx))]
    for text in texts:
        low = text.lower().encode()
        matched = [s for s in licenses.signatures() if s.pattern.search(low)]
        assert label in {s.label for s in matched}, text
        assert all(any(k in low for k in s.keywords) for s in matched), text
        assert licenses.detections(low), text


@pytest.mark.parametrize("text,label", [
    ("license: agpl-3.0", "agpl"), ('"license": "gpl-3.0"', "gpl"), ("license: ms-pl", "ms-pl"), ("license: psf-2.0", "python"),
    ("under the expat license", "mit"), ("the x11 license", "mit"), ("creative commons zero", "cc0"),
    ("creative commons attribution license", "cc-by"),
])
def test_names_without_the_family_keyword(text, label):
    assert label in {d[0] for d in licenses.detections(text.encode())}


def test_suppression_matches_all_pairs():
    rng = random.Random(8)
    found = list({(rng.randrange(1, 4), s := rng.randrange(60), s + rng.randrange(1, 20), rng.choice("abc"), 0.5) for _ in range(150)})

    def beaten(x):
        return any(y[1] <= x[1] and x[2] <= y[2] and (y[0] > x[0] or y[0] == x[0] and ((y[2] - y[1]) > (x[2] - x[1]) or
                   (y[1], y[2]) == (x[1], x[2]) and y[3] < x[3])) for y in found)

    assert sorted(licenses.resolved(found)) == sorted(x for x in found if not beaten(x))


def test_base_places_match_a_plain_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    hits = 0
    for row in rows:
        w = brute.folded(row.text)
        places = sorted((i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w))
                        if w[i:i + len(phrase.split())] == phrase.split())
        r = got[row.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))
        hits += bool(places)
    assert hits > 10


def test_base_places_of_a_very_long_text():
    began = time.perf_counter()
    places = licenses.base_places([b"cc", b"by"] * 800_000)
    assert len(places) == 800_000 and places[-1] == (1_599_998, "cc-by")
    assert time.perf_counter() - began < 20


def test_license_rows(spark):
    texts = [(1, "CC BY, cc-by MIT license\nthe Apache  License"), (2, None), (3, ""), (4, "cc by " * 20000), (4, "none"), (None, "GNU General Public License")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    r = got[1, 9]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 7, "apache,cc-by,mit")
    assert (got[2, 0].n_base, got[2, 0].first_word, got[2, 0].labels, got[2, 0].score) == (0, None, "", 0.0)
    assert got[4, 40000].n_base == 20000 and got[4, 40000].last_word == 39998
    assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 < r.score <= 1
    assert len(licenses.signatures()) > 300
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0
