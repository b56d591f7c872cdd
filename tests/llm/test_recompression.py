import random
import re

from quillspark.llm import recompression as Q


def brute(docs):
    first, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for a in range(len(w) - Q.WINDOW + 1):
            k = tuple(w[a : a + Q.WINDOW])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for a in range(len(w) - Q.WINDOW + 1):
            if i is not None and first[tuple(w[a : a + Q.WINDOW])] < i:
                gone.update(range(a, a + Q.WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows(out):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    passages = [make(n, v) for n in (49, 50, 51, 60, 80, 130) for v in (2, 5, 1000)]
    docs = [(1, None), (2, ""), (3, "one"), (None, " ".join(passages[-1])), (4, "ha " * 200), (5, "ha " * 120), (6, "ha ho " * 90), (7, "x ha " + "ha " * 55)]
    for i in range(60):
        w = make(rng.randrange(30), 1000)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            w += p[a:] + make(rng.randrange(6), 1000)
        docs.append((100 - i, (" " if i % 2 else "\n").join(w)))
    docs += [(50, docs[20][1]), (50, docs[21][1]), docs[22]]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, places int").repartition(5)
    assert rows(Q.remove_repeats(d)) == brute(docs)
    assert Q.remove_repeats(d.limit(0)).count() == 0


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(Q.remove_repeats(docs)) == want and sum(r[2] for r in want) > 0


def test_long_texts(spark):
    long = [f"x{i}" for i in range(250_000)]
    docs = [(1, " ".join(long)), (2, " ".join(["own", *long[:100_000], "cut", *long[100_000:]])), (3, " ".join(long[5:54])), (4, "ha " * 300_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in Q.remove_repeats(d).orderBy("doc_id").collect()]
    assert [g[1:3] for g in got] == [(250_000, 0), (250_002, 250_000), (49, 0), (300_000, 0)] and got[1][3] == "own cut"
