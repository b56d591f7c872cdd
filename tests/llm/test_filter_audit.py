import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.llm import common as C, filter_audit as A
from quillspark.llm.oracles import OP12
from quillspark.llm.queries import QUERIES

DOCS, LABELS = "doc_id long, text string, lang string, part string, mask int", "doc_id long, quality int, toxic int, good int"


def brute(docs, labels):
    """Applies every order to the documents one by one."""
    fails = []
    for i, (doc_id, text, lang) in enumerate(docs):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None]
        bad.append(doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in docs))
        said = [x for x in labels if x[0] == doc_id and doc_id is not None]
        fails.append((lang or "", dict(zip("ABCDE", bad, strict=True)), any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                redundant = sum(f[1][letter] for f in own) - len(gone)
                left = [f for f in left if not f[1][letter]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f[1][letter] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def cases():
    rng = random.Random(2)
    docs = []
    for i in range(150):
        n, kinds = rng.choice([0, 3, 150, 199, 200, 260]), rng.choice([1, 40, 100, 400])
        t = " ".join(rng.choice(["", "", "Ä", "A", "#"]) + f"w{rng.randrange(kinds)}" for _ in range(n))
        docs.append((i, t if rng.random() < 0.6 else f"copy {i % 4}", rng.choice(["de", "en", None, ""])))
    docs += [(None, "copy 1", "en"), (None, None, None), (3, "copy 1", "fr"), (3, None, "fr"), (3, None, "fr"), (900, "", "en"), (5, "E" * 3 + "e" * 97, "en"), (6, "E" * 4 + "e" * 96, "en"), (7, "é" * 97 + "EEE", "x|y")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1)]
    return docs, labels


def rows(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in A.COUNTS) for r in frame.collect()}


@pytest.mark.parametrize("few", [C.FEW_KEYS, 0])
def test_all_orders(spark, monkeypatch, few):
    meet = C.meet
    monkeypatch.setattr(C, "meet", lambda rows, groups, key, spread: meet(rows, groups, key, spread, few, 10))
    docs, labels = cases()
    frame = spark.createDataFrame([(*d, "p", 9) for d in docs], DOCS).repartition(3)
    got = A.audit(frame, spark.createDataFrame([(*x, 7) for x in labels], LABELS))
    assert rows(got) == brute(docs, labels) and got.count() == 600 * len({x or "" for _, _, x in docs})
    assert A.audit(frame.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_sql_agrees_with_brute_force():
    docs, labels = cases()
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    db.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    got = db.sql(OP12).fetchall()
    assert {r[:3]: r[3:] for r in got} == brute(docs, labels)


def test_transform():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 50, A.MASKS)
    signed = A.HADAMARD @ want
    assert (A.cells(signed) == want).all() and (signed == [sum(n * (-1) ** bin(s & m).count("1") for m, n in enumerate(want)) for s in range(A.MASKS)]).all()
    with pytest.raises(ValueError):
        A.cells(signed + np.eye(A.MASKS, dtype=int)[3])


def test_long_text(spark):
    text = " ".join(f"w{i % 150_000}" for i in range(300_000))
    frame = spark.createDataFrame([(1, text, "en"), (2, text + " #", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r["mask"] for r in A.masks(frame).collect()} == {1: 0, 2: 0b1000}


def test_query_reads_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert rows(QUERIES["op12_filter_audit"](spark, d)) == brute(docs, labels)
