import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_templates import brute as without_lines
from tests.llm.test_ngram_join import brute as components


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = P.quality(spark, docs, d)
    assert kept.columns == columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert 0 < len(rows) < docs.count()
    lines = P.lines(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema), d)
    want = [(i, t) for i, t in without_lines(rows) if t.split() or (i, t) in rows]
    got = [(r.doc_id, r.text) for r in lines.collect()]
    assert lines.columns == columns and sorted(got) == sorted(want)
    near = P.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in got], docs.schema), d)
    want = {c for _, _, c in components(got, 5, 80)}
    rest = [(r.doc_id, r.text) for r in near.collect()]
    assert near.columns == columns and {i for i, _ in rest} == want and len(rest) == len(want) and set(rest) <= set(got)
    clean = P.decontamination(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rest], docs.schema), d)
    bad = {i for i, _ in leaks(rest, items)}
    last = sorted((r.doc_id, r.text) for r in clean.collect())
    assert clean.columns == columns and last == sorted(r for r in rest if r[0] not in bad)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, d).collect())
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for _, t in last]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert out == [(i, len(x), sha(b"".join(k.to_bytes(4, "little") for k in x)), sha(t.encode())) for (i, t), x in zip(last, ids, strict=True)]


def test_nulls_repeats_long_texts_and_other_columns(spark, tmp_path):
    """The whole pipeline on rows of every kind: ids and texts that are null or repeated, a very long text, columns with names that the operators use."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = [text(120) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(20, good[0]), (20, good[0]), (3, good[3]), (None, good[4]), (None, text(90)), (None, None), (30, None), (31, ""), (32, " \n "), (1, text(100))]
    rows += [(40 + i, f"{text(80)}\nthis line is in all of them\n{text(70)}") for i in range(6)] + [(60, text(150_000))]
    rows += [(70, f"{text(60)} {good[7]} {text(60)}")]
    schema = "doc_id long, text string, lang string, row string, key int, n_chars long"
    spark.createDataFrame([(i, t, "en", "r", 1, len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, good[7]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id for r in got), key=str)
    # 7 and 70 hold the item; 20, one row of 3 and the null copy of 4 are copies; texts without words fail the rules
    assert ids == sorted([0, 1, 1, 2, 3, 4, 5, 6, None, *range(40, 46), 60], key=str)
    lines = {r.doc_id: r for r in got}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = dict(rows)
    assert lines[60].decoded_sha256 == sha(texts[60]) and lines[40].decoded_sha256 == sha(texts[40]) and lines[41].decoded_sha256 == sha(texts[41].replace("this line is in all of them\n", ""))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
