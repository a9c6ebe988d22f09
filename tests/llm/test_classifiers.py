import numpy as np
import pytest

from pulsegrid.llm import labelled as L
from pulsegrid.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
DOC = "doc_id long, text string, score string, label int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("run,name,least,right", [(quality.score_quality, "quality", 0.98, 0.97), (toxicity.score_toxicity, "toxic", 0.92, 0.95)])
def test_held_out_accuracy(spark, tables, run, name, least, right):
    docs, labels = tables
    labelled = labels.join(run(docs, labels), "doc_id").where("held_out").toPandas()
    assert len(labelled) > 500
    assert area(labelled.score.to_numpy(), labelled[name].to_numpy()) > least
    assert (labelled.predicted == labelled[name]).mean() > right
    assert labelled.score.between(0, 1).all()


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels = tables
    got = L.sample(docs, labels, "toxic", 50)
    from zlib import crc32

    assert got.examples and all(crc32(str(e.doc_id).encode()) % 5 for e in got.examples)
    assert sum(e.label for e in got.examples) <= 50 and len(got.examples) <= 100


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, tables, run):
    _, labels = tables
    train = spark.read.parquet(f"{SF}/documents.parquet").limit(600).selectExpr("doc_id", "text", "'x' AS score", "1 AS label")
    odd = spark.createDataFrame([(-1, None, "s", 0), (-2, "", "s", 0), (-3, "word " * 60000, "s", 0), (-4, "a b", "s", 0), (-4, "a b", "s", 0),
                                 (None, "a b", "s", 0)], DOC)
    rows = run(train.unionByName(odd), labels).where("doc_id < 0 OR doc_id IS NULL").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    assert by[-1][0].score == by[-2][0].score and by[-4][0].score == by[-4][1].score == by[None][0].score
    assert by[None][0].held_out is False
    assert run(spark.createDataFrame([], DOC), labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in run(odd, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)
    assert run(odd, nulls).count() == 6


def test_score_does_not_depend_on_the_batch():
    """Equal rows score equally whatever lies beside them, in batches of 1 to 1,000."""
    rng = np.random.default_rng(4)
    features = rng.normal(size=(400, 8))
    model = L.Calibration.fit(features, (features[:, 0] + rng.normal(size=400) > 0).astype(float))
    row = features[17:18]
    seen = {model.score(row)[0]}
    for n in (2, 3, 7, 8, 33, 999, 1000):
        other = rng.normal(size=(n, 8))
        for at in (0, n // 2, n - 1):
            other[at] = row[0]
            seen.add(model.score(other)[at])
        seen.update(model.score(np.repeat(row, n, axis=0)))
    assert len(seen) == 1


def test_drop_poor_drops_what_is_predicted(spark, tables):
    docs, labels = tables
    want = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    kept = quality.drop_poor(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
