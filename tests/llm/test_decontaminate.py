import random
import re
from collections import Counter
from math import log2

import numpy as np
import pytest

from quillspark.llm import decontaminate as D

SPACE, MARKS = r"[^\x20\x09-\x0D]+", "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def words_of(text):
    words = [w.strip(MARKS) for w in re.findall(SPACE, text or "")]
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in words if w]


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard(a, b):
    w = lambda s: log2(1 + sum(len(x.encode()) for x in s))
    low = sum(n * w(s) for s, n in (a & b).items())
    high = sum(n * w(s) for s, n in (a | b).items())
    return low / high if high else 0


def brute(docs, items, least=0.8):
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        whole = bag(words)
        for item_id, item in items:
            target = words_of(item)
            n = min(len(target), len(words))
            if len(target) < 5 or n < max(5, least * len(target)):
                continue
            own = bag(target)
            if not own.keys() & whole.keys():
                continue  # nothing in common
            best = max((jaccard(bag(words[a : a + n]), own) for a in range(len(words) - n + 1)), default=0)
            if best >= least:
                out[doc_id, item_id] = best
    return out


def test_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine an ancient map of the northern sea route and argue".split()
    items = [(1, " ".join(base)), (2, "short one"), (3, " ".join(base[::-1])), (4, "a b c d e"), (5, None), (1, " ".join(base))]
    other = [f"w{i}" for i in range(60)]
    docs = [
        (1, " ".join(other + base + other)),
        (2, " ".join(other + base[:-1] + other)),
        (3, " ".join(other + [*base[:2], "new", *base[2:]] + other)),
        (4, " ".join([*base[:10], "x", *base[11:]])),
        (5, " ".join(base[1:-1]).upper() + "!"),
        (6, " ".join(other)),
        (7, None),
        (8, ""),
        (None, " ".join(other + base[::-1])),
        (9, "A, b. C d e"),
        (1, " ".join(base)),
    ]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, leaks string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(d, b).collect()}
    want = brute([r for r in docs if r[1] is not None], [r for r in items if r[1]])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    left = D.clean(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted({r[0] for r in docs if r[0]} - {k for k, _ in want})
    blocks = {(r.doc_id, r.item_id) for r in D.scan(d, b, block_bytes=40).selectExpr("doc_id", "inline(leaks)").collect()}
    assert blocks == want.keys()
    assert D.matches(d.limit(0), b).count() == 0 and D.matches(d, b.limit(0)).count() == 0


def test_given_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want.keys() and want


def test_short_items(spark):
    items = [(1, "forty two"), (2, "Yes!"), (3, "one two three four"), (4, "--"), (5, "forty two"), (6, "a b c d e")]
    docs = [(1, "it is Forty, two; and forty two"), (2, "forty and two"), (3, "forty"), (4, "two yes"), (5, "zero one two three four five a b c d e"), (6, "one two three"), (7, None), (None, "yes")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.matches(d, b).collect()}
    assert got == {(1, 1, 2, 2, 1.0), (1, 5, 2, 2, 1.0), (4, 2, 1, 1, 1.0), (5, 3, 1, 4, 1.0), (5, 6, 6, 5, 1.0), (None, 2, 0, 1, 1.0)}
    assert sorted(r.doc_id for r in D.clean(d, b).collect()) == [2, 3, 6, 7]
    only = D.matches(d, b.filter("item_id = 2")).collect()  # no longer item
    assert {(r.doc_id, r.item_id) for r in only} == {(4, 2), (None, 2)}


def test_recall_of_the_radius():
    """Pairs just above the similarity: how many fingerprints are within the radius."""
    rng, inside, total = random.Random(1), 0, 0
    for n in (15, 30, 60, 120, 300):
        for _ in range(300):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = list(base)
            for _ in range(rng.randint(1, n // 40 + 1)):
                at = rng.randrange(n)
                copy[at : at + rng.randrange(2)] = [f"z{rng.randrange(10**6)}"]
            prints, bags, weights = [], [], {}
            for words in (base, copy[:n]):
                raw = np.frombuffer(" ".join(words).encode(), np.uint8)
                h, w, _, _ = D.weighted_shingles(raw, np.array([0, len(raw)]))
                h, w = h[: n - 4], w[: n - 4]
                prints.append(D._prints_of(h, w, np.zeros(1, np.int64), n - 4)[0])
                bags.append(Counter(h.tolist()))
                weights |= dict(zip(h.tolist(), w.tolist(), strict=True))
            if 0.8 <= D.similarity(*bags, weights) < 0.9:
                total += 1
                inside += int(np.bitwise_count(prints[0] ^ prints[1])) <= D.RADIUS
    assert total > 200 and inside >= 0.99 * total


def test_probes_and_comparisons_agree():
    rng = np.random.default_rng(2)
    values, value = np.sort(rng.integers(0, 1 << 16, 500).astype(np.uint16)), np.unique(rng.integers(0, 1 << 16, 60).astype(np.uint16))
    want = sorted(zip(*(x.tolist() for x in D.Index._met(value, values)), strict=True))
    assert want == sorted((i, j) for i, v in enumerate(value.tolist()) for j, x in enumerate(values.tolist()) if (v ^ x).bit_count() <= D.NEAR)
    many = np.sort(np.concatenate([values, rng.integers(0, 1 << 16, 3000).astype(np.uint16)]))
    by_probe = sorted(zip(*(x.tolist() for x in D.Index._met(value, many)), strict=True))
    assert by_probe == sorted((i, j) for i, v in enumerate(value.tolist()) for j, x in enumerate(many.tolist()) if (v ^ x).bit_count() <= D.NEAR)


def test_long_text_with_one_item(spark):
    item = " ".join(f"item{i}" for i in range(40))
    text = " ".join(f"w{i}" for i in range(300_000)) + " " + item + " end " * 1000
    d = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = D.matches(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in got] == [(1, 5, 300_000, 1.0)]
