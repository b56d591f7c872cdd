import numpy as np
import pytest

from quillspark.llm import toxicity as X
from quillspark.llm.queries import op1_toxicity


def slow_kernel(a, b):
    from itertools import combinations

    def f(w):
        out = {}
        s = X._SIGN[np.frombuffer(w, np.uint8)].tolist()
        for i, j, k in combinations(range(len(s)), 3):
            out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + X.DECAY ** (k - i + 1)
        return out

    x, y = f(a), f(b)
    d = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return d(x, y) / (d(x, x) * d(y, y)) ** 0.5 if x and y else 0


def test_kernel_values_against_brute_force():
    words = [b"moron", b"scum", b"chlla"]
    marks = X.Landmarks(words)
    for probe in (b"moron", b"m.o.r.o.n", b"mooron", b"morn", b"oron", b"xyz", b"banana", b"ch\xc3\xb3n", b"chllapo", b"scummy"):
        got = marks.of_length(X.signs_of(probe)[None])[0]
        want = [slow_kernel(probe, w) for w in words]
        assert got == pytest.approx([w if w >= X.FLOOR else 0 for w in want], abs=1e-4)
        assert X.kernel(probe, words[0]) == pytest.approx(want[0])


def test_spaced_and_inserted_letters():
    marks = X.Landmarks([b"moron"])
    texts = [b"you m o r o n !", b"a mo*ron", b"m0r0n", b"plain words only", b"", b"a b c", b"x" * 60 + b"moron" + b"y" * 60]
    v = X.values(marks, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))[0][:, 0] ** 0.25
    assert v[0] == pytest.approx(1) and v[1] > 0.5 and v[2] == pytest.approx(1) and v[3] == v[4] == v[5] == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op1_toxicity(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic = [rows[r.doc_id].predicted for r in labels if r.toxic]
    clean = [rows[r.doc_id].predicted for r in labels if not r.toxic]
    assert len(rows) == 10_000 and np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a moron", "moron you", "kind words", "good words", "the moron", "m o r o n", None, "", "nice words", "great words"])] + [(None, "moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (4, 1), (2, 0), (3, 0), (8, 0), (99, 1), (None, 0)], "doc_id long, toxic int")
    machine = X.fit(docs, labels, "toxic", (1, 9))
    rows = X.classify(docs, machine).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert min(by[0], by[1], by[5], by[None]) > max(by[2], by[3], by[6], by[7])
    blank = X.fit(docs, labels.limit(0), "toxic", (5, 0))
    assert max(r.score for r in X.classify(docs, blank).collect()) < 1e-9
    assert X.classify(docs.limit(0), machine).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    texts = ["a moron", "moron you", "the moron", "kind words", "good words", "nice words"]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in enumerate(texts)] + [(0, "a moron", 7, "s"), (0, "z" * 50_000 + " moron", 7, "s")], "doc_id long, text string, score long, label string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    rows = X.classify(docs, X.fit(docs, labels, "toxic", (1, 9))).collect()
    assert sorted(r.doc_id for r in rows) == [0, 0, 0, 1, 2, 3, 4, 5] and rows[0].asDict().keys() == {"doc_id", "score"}
    assert min(r.score for r in rows if r.doc_id < 3) > max(r.score for r in rows if r.doc_id > 2)
