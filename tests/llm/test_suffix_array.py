import random
from collections import Counter

import numpy as np

from quillspark.llm import suffix_array as S


def brute(docs):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[a : a + S.LENGTH] for _, b in raw for a in range(len(b) - S.LENGTH + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - S.LENGTH + 1):
            if seen[b[a : a + S.LENGTH]] > 1:
                gone[a] += 1
                gone[a + S.LENGTH] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def rows(out):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n, letters="abcdefghé ": "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n, v) for n in (150, 199, 200, 201, 230, 400, 900) for v in ("ab", "abcdefgh é")]
    docs = [(1, None), (2, ""), (3, "x" * 700), (4, "ab" * 300), (None, passages[-1]), (5, passages[-1] + "q" + passages[-1])]
    for i in range(60):
        t = text(rng.randrange(200))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randrange(30) :] + text(rng.randrange(20))
        docs.append((100 - i, t))
    docs += [(50, docs[12][1]), docs[13], (None, docs[14][1]), (None, "null ids " * 40), (None, "null ids " * 40)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lead int").repartition(5)
    assert rows(S.remove_repeats(d)) == brute(docs)
    assert S.remove_repeats(d.limit(0)).count() == 0


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(S.remove_repeats(docs)) == want and sum(r[2] for r in want) > 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (500, 4)).astype(">u8")
    order = S.multikey_quicksort(keys)
    assert [tuple(keys[i]) for i in order] == sorted(map(tuple, keys))


def test_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    docs = [(1, long), (2, "own" + long[1000:] + "cut"), (3, "ab" * 400_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(d).orderBy("doc_id").collect()]
    n = len(long)
    assert got == [(1, n, n - 1000, 1, long[:1000].encode()), (2, n - 994, n - 1000, 1, b"owncut"), (3, 800_000, 800_000, 1, b"")]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash that is the same for all strings, groups still follow bytes."""
    rng = random.Random(6)
    raw = bytes(rng.choice(b"ab") for _ in range(900))
    data = np.frombuffer(raw + raw[100:700] + bytes(rng.choice(b"ab") for _ in range(300)), np.uint8)
    anchor, size = np.array([150, 950, 1300]), len(data)
    before, after = np.array([100, 50, 100]), np.minimum(size - anchor, 400)
    owner, offset = np.repeat(np.arange(3), 40), np.tile(np.arange(40), 3)
    order = np.argsort(offset, kind="stable")
    group = S._by_bytes(data, anchor, after, before, owner[order], offset[order], offset[order].copy())
    strings = [(int(o), data[anchor[w] - o : anchor[w] - o + S.LENGTH].tobytes()) for w, o in zip(owner[order], offset[order], strict=True)]
    same = {}
    for g, s in zip(group.tolist(), strings, strict=True):
        assert same.setdefault(g, s) == s
    assert len(set(group.tolist())) == len(set(strings)) == 80
