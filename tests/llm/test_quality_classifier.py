import numpy as np

from quillspark.llm import quality_classifier as K
from quillspark.llm.queries import op4_quality_knn


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    pos = np.asarray(label) == 1
    return (rank[pos].mean() - rank[~pos].mean()) / len(rank) + 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op4_quality_knn(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(rows) == 10_000 and 0.25 < sum(r.held_out for r in rows.values()) / 10_000 < 0.42
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert auc([rows[r.doc_id].score for r in labels], [r.quality for r in labels]) > 0.95


def test_cases(spark):
    docs = spark.createDataFrame([(1, "Fine words here."), (2, "BAD!! BAD!!"), (3, None), (None, ""), (3, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (None, 0), (3, None), (1, 1)], "doc_id long, quality int")
    space = K.fit(docs, labels, "quality", (1, 5))
    rows = K.classify(docs, space).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: round(r.score) for r in rows if r.doc_id in (1, 2)} == {1: 1, 2: 0}
    empty = K.fit(docs, labels.limit(0), "quality", (3, 1))
    assert [r.score for r in K.classify(docs, empty).collect()] == [0.5] * 5
    assert K.classify(docs.limit(0), space).count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    rows = [(list(range(i % 7, 40, 1 + i % 5)), list(rng.random(len(range(i % 7, 40, 1 + i % 5)))), i % 2) for i in range(50)]
    space = K.Space(rows, 8, 5)
    q = space._unit(rng.normal(size=(9, 8)))
    want = []
    for v in q:
        s = space.points @ v
        top = np.argsort(-s)[:5]
        w = np.maximum(s[top], 0).astype(float) ** 4
        want.append((w * space.labels[top]).sum() / w.sum() if w.sum() > 0 else space.mean)
    assert np.allclose(space.scores(q, block=4), want, atol=1e-6)


def test_ties_are_decided_by_the_order_of_points():
    rows = [([1, 2], [1.0, 1.0], label) for label in (1, 0, 0, 1, 0)] + [([3], [1.0], 1)]
    space = K.Space(rows, 4, 3)
    assert np.allclose(space.scores(space.points[:1]), 1 / 3) and np.allclose(space.scores(space.points[:1], block=1), 1 / 3)


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "Fine words here.", 9, "s"), (1, "Fine words here.", 9, "s"), (2, "BAD!! BAD!!", 9, "s")], "doc_id long, text string, score long, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = K.classify(docs, K.fit(docs, labels, "quality", (1, 5))).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and rows[0].asDict().keys() == {"doc_id", "score"}
