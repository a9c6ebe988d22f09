import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import packing, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect()}
    scored = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    wants = []
    left = {d: t for d, t in left.items() if d in good}
    wants.append(set(left))
    first = {}
    for d in sorted(left):
        first.setdefault(" ".join((left[d] or "").split()), d)
    left = {d: left[d] for d in first.values()}
    wants.append(set(left))
    left = {d: left[d] for d, c in brute.components(left.items(), 80)[1].items() if c == d}
    wants.append(set(left))
    left = {d: t for d, t in left.items() if not brute.hits(t, items)[0]}
    wants.append(set(left))
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want), name
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = corpus_pipeline.run(spark, SF).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in left.items()}
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048 and not np.any([n & (n - 1) for n in sizes.values()])


def test_near_copies_from_80_percent_go(spark):
    """A pair at 0.82: its later document leaves the pipeline."""
    words = [f"w{i}" for i in range(200)]
    other = words[:181] + [f"v{i}" for i in range(19)]
    one, two = brute.shingles(" ".join(words)), brute.shingles(" ".join(other))
    assert 0.80 <= len(one & two) / len(one | two) < 0.85
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else"), (None, None), (4, "")], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def test_stages_keep_odd_rows_whole(spark):
    """Nulls, empty and repeated rows, clashing extra columns, empty tables: every stage but the last returns its input's columns."""
    ddl = "doc_id long, text string, lang string, node long, bucket string, score string, kept string"
    good = "The quick brown fox jumps over the lazy dog. " * 5
    odd = spark.createDataFrame([(1, good, "en", 7, "b", "s", "k"), (1, good, "en", 8, "b", "s", "k"), (None, None, None, None, None, None, None),
                                 (2, "", "", 0, "", "", ""), (3, good + "x " * 50000, "en", 0, "", "", "")], ddl)
    none = spark.createDataFrame([], ddl)
    before = {tuple(r) for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns, name
        assert {tuple(r) for r in kept.collect()} <= before, name
        assert stage(spark, none, SF).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, odd, SF).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None} and stage(spark, none, SF).count() == 0
