import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import periodic_runs as P
from quillspark.llm.queries import QUERIES
from tests.llm.test_hashes import words as thue_morse


def brute_runs(w):
    """All runs from the definition: for each period the longest stretches, of equal stretches the smallest period."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng):
    out = []
    while len(out) < rng.choice([5, 30, 80, 300]):
        part = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 40]))]
        out += (part * rng.randint(1, 12))[: rng.randint(1, 200)]
        if rng.random() < 0.3 and out:
            out[rng.randrange(len(out))] = "x"
    return out


def numbered(docs):
    known = {}
    ids = np.array([known.setdefault(x, len(known)) for d in docs for x in d], np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def split(runs, first):
    at = np.searchsorted(runs[:, 0], first)
    return [[(s - int(first[i]), e - s, p) for s, e, p in runs[at[i] : at[i + 1]].tolist()] for i in range(len(first) - 1)]


def test_runs_of_random_words():
    rng = random.Random(5)
    docs = [random_words(rng) for _ in range(400)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("abc") * 8, list("abc") * 7]
    ids, first = numbered(docs)
    want = [brute_runs(d) for d in docs]
    assert split(P.find_runs(ids, first), first) == want and sum(map(len, want)) > 300


@pytest.mark.parametrize("size", [1 << 10, 1 << 12])
def test_blocks_and_long_texts(monkeypatch, size):
    monkeypatch.setattr(P, "PAIRS", 100)
    monkeypatch.setattr(P, "WORDS", 50)
    rng = random.Random(size)
    docs = [random_words(rng) for _ in range(20)] + [list("ab") * (size // 4) + list("c") * 40]
    ids, first = numbered(docs)
    assert split(P.find_runs(ids, first), first) == [brute_runs(d) for d in docs]


def test_hashes_that_meet_are_measured_by_words(monkeypatch):
    rng = random.Random(9)
    docs = [random_words(rng) for _ in range(60)]
    ids, first = numbered(docs)
    # a hash that can't tell most stretches apart: words still decide
    monkeypatch.setattr(P.Prefix, "equal", lambda self, at, apart, length: (at * 7 + apart + length * 0) % 3 > -1)
    assert split(P.find_runs(ids, first), first) == [brute_runs(d) for d in docs]


def test_thue_morse_words():
    one, two = thue_morse(2048)
    docs = [list(one + two + one), list(one * 3), list(one[:512] * 4)]
    ids, first = numbered(docs)
    assert split(P.find_runs(ids, first), first) == [brute_runs(d) for d in docs]


def cases():
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 10, 70, 400])))) for i in range(120)]
    docs += [(500 + i, "\n".join(random_words(rng))) for i in range(60)]
    docs += [(7, "a " * 100), (7, "b " * 100), (None, "c d " * 50), (900, None), (901, ""), (902, " \x0b\n"), (-3, "ä b " * 40), (903, " ".join(f"u{i % 997}" for i in range(40_000)))]
    return docs


def test_digest_against_brute_force(spark):
    docs = cases()
    frame = spark.createDataFrame([(d, t, 1, t) for d, t in docs], "doc_id long, text string, runs int, kept string").repartition(3)
    got = sorted((tuple(r) for r in P.digest(frame, double=True).collect()), key=str)
    want = sorted((brute(d, t) for d, t in docs if d != 903), key=str)
    assert [r for r in got if r[0] != 903] == want
    last = next(r for r in got if r[0] == 903)
    plain = zlib.crc32(b"903") % 10
    assert plain and last[1:5] == (1, 0, 40_000, 997)
    assert P.digest(frame.limit(0)).count() == 0
    rows = {r.doc_id: r for r in P.runs(frame.filter("doc_id = 900 OR doc_id IS NULL")).collect()}
    assert rows[900].kept == "" and rows[900].runs == [] and rows[None].kept == "c d" and tuple(rows[None].runs[0]) == (0, 100, 2)


def test_query_reads_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, d).collect())
    assert got == sorted(brute(*r) for r in docs) and any(r[1] for r in got)
