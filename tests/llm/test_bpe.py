import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "a", " ", "  ", "\n", "Hello  world's end, they're we've I'll x'd 'tis ' 's ''s it's's", "a \n\n b\t\tc  ", "x<|endoftext|>y  <|endoftext|><|endoftext|> z", "<|endoftext|>",
    "é à ß ñ 数 学 123abc456 ½ ²   x　", "don'tt 'san 'll'll 'rex a'reb  's", "😀😀 oḱ ‍", "tab\tend \r\n\r\n", "word " * 3000, "'", "''", "s'", " '", "x''s", "\u0085a\u001cb", "<|endof", "<|endo", "ftext|>",
]


def test_same_as_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "", ""), (3, "again", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids string").repartition(3)
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.tokenize(docs, PATH, block_bytes=200).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, b"".join(x.to_bytes(4, "little") for x in ids), tokenizer.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want, key=str)


def test_whole_table(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.tokenize(docs, PATH).collect()}
    for r in docs.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (b"".join(x.to_bytes(4, "little") for x in ids), r.text)


def test_empty_table_and_decode(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.tokenize(empty, PATH).count() == 0
    ids = Tokenizer.from_file(PATH).encode("Déjà vu", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()} == {1: "Déjà vu", 2: "", 3: ""}


def test_text_longer_than_a_block(spark):
    text = " ".join(f"x{i}" for i in range(60_000)) + "\n" + "a" * 30_000
    got = bpe.tokenize(spark.createDataFrame([(1, text), (2, text), (3, "b")], "doc_id long, text string"), PATH, block_bytes=1000).collect()
    assert {r.doc_id: r.decoded for r in got} == {1: text, 2: text, 3: "b"}
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert {bytes(r.ids) for r in got if r.doc_id < 3} == {b"".join(x.to_bytes(4, "little") for x in ids)}
