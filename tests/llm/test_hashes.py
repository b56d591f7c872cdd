"""Words and lines that sums of powers modulo 2**64 can't tell apart: the two Thue-Morse words of one length."""

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from quillspark.llm import bpe, common as C, decontaminate, line_templates, ngram_join, quality_rules, recompression, suffix_array
from tests.llm import test_decontaminate, test_line_templates, test_ngram_join, test_quality_rules, test_recompression, test_suffix_array


def words(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: "b", 98: "a"})
    return s, s.translate({97: "b", 98: "a"})


@pytest.fixture(params=[1024, 4096])
def pair(request):
    return words(request.param)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(2)


def test_hashes_differ(pair):
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    n = len(pair[0])
    one, two = C.byte_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two and len({int(x) for x in C.byte_hashes(data[:9], np.zeros(9, int), np.arange(1, 10))}) == 9
    assert len(np.unique(C.run_hashes(np.array([1, 2, 2, 1] * 5, np.uint64), 4))) == 4


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(C, "byte_hashes", lambda data, start, end, seed=0: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcabdabc" + b"x" * 300 + b"x" * 299 + b"y", np.uint8)
    first, number = C.distinct_spans(data, np.array([0, 3, 6, 9, 309]), np.array([3, 6, 9, 309, 609]))
    assert number[0] == number[2] and len(set(number.tolist())) == 4 == len(first)


def test_near_duplicates(spark, pair):
    docs = [(i, f"{w} x y z") for i, w in enumerate(pair)]
    docs += [(i + 5, f"{' '.join(f'w{k}' for k in range(40))} {w}") for i, w in enumerate(pair)]
    got = sorted((tuple(r) for r in ngram_join.join(frame(spark, docs)).collect()), key=str)
    assert got == test_ngram_join.brute(docs) and got[0][2] != got[1][2]


def test_repeated_windows(spark, pair):
    rest = " ".join(f"w{k}" for k in range(49))
    docs = [(i, f"{w} {rest}") for i, w in enumerate(pair)] + [(7, f"{pair[0]} {rest}")]
    assert test_recompression.rows(recompression.remove_repeats(frame(spark, docs))) == test_recompression.brute(docs)


def test_repeated_strings(spark, pair):
    docs = [(i, w) for i, w in enumerate(pair)] + [(7, "q" * 150 + pair[0][:130]), (8, "q" * 150 + pair[1][:130])]
    assert test_suffix_array.rows(suffix_array.remove_repeats(frame(spark, docs))) == test_suffix_array.brute(docs)


def test_lines(spark, pair):
    text = f"{pair[0]}\n{pair[1]}\n{pair[0]}"
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    assert [list(r.values())[1:6] for b in quality_rules._count_batches([batch]) for r in b.to_pylist()] == [test_quality_rules.brute(text)]
    docs = [(i, f"own {'abcdefgh'[i]}\n{pair[i % 2]} and more words here") for i in range(8)]
    got = sorted((r.doc_id, r.text) for r in line_templates.drop_lines(frame(spark, docs), least_docs=3, kept_share=0.9).collect())
    assert got == sorted(test_line_templates.brute(docs, 3, 0.9))


def test_benchmark_items(spark, pair):
    rest = [f"item{k} word" for k in range(6)]
    items = [(1, f"{pair[0]} {' '.join(rest[:3])}"), (2, pair[0])]
    docs = [(i, f"before it {w} {' '.join(rest[:3])} after it") for i, w in enumerate(pair)]
    got = {tuple(r)[:2] for r in decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i for i, _ in got} == {i for i, _ in test_decontaminate.brute(docs, items)} and (1, 2) not in got and (0, 2) in got


def test_tokens(spark, pair):
    docs = frame(spark, [(i, w) for i, w in enumerate(pair)]).coalesce(1)
    assert {r.doc_id: r.decoded for r in bpe.tokenize(docs, path("byte_bpe_50k.json")).collect()} == dict(enumerate(pair))


# texts of equal hashes for a seed that is known, worked out by undoing mix()

MASK = (1 << 64) - 1


def unmix(x):
    def unshift(y, k):
        out = y
        for _ in range(64 // k + 1):
            out = y ^ (out >> k)
        return out

    x = unshift(x, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) & MASK
    x = unshift(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & MASK
    return unshift(x, 30)


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def partner(word, seed=0):
    """Another printable word of this one's length whose hash for the seed is the same: its first eight bytes are chosen, the next eight undo the difference."""
    assert mixed(unmix(12345)) == 12345 == unmix(mixed(12345)) and mixed(12345) == int(C.mix(np.array([12345], np.uint64))[0])
    step, first, second = int(C._STEP), int.from_bytes(word[:8], "little"), int.from_bytes(word[8:16], "little")
    start = mixed((len(word) + mixed(seed)) & MASK)
    after = lambda lane: mixed(((start ^ lane) + step) & MASK)
    state, k = after(first), 0
    while True:
        k += 1
        begin = f"p{k:07d}".encode()
        other = (after(int.from_bytes(begin, "little")) ^ state ^ second).to_bytes(8, "little")
        if all(33 <= b < 127 and b != 92 and not 48 <= b < 58 and not 65 <= b < 91 for b in other) and other[-1:].isalpha():
            return begin + other + word[16:]


WORDS = [b"abcdefghijklmnop", b"abcdefghijklmnopqrstuvwx", b"abcdefghijklmnopqrstuvwxyzabcdefghijklmn"]


@pytest.fixture(params=WORDS, ids=lambda w: str(len(w)))
def computed(request):
    one, two = request.param, partner(request.param)
    data = np.frombuffer(one + two, np.uint8)
    n = len(one)
    a, b = C.byte_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two and a == b
    c, d = C.byte_hashes(data, np.array([0, n]), np.array([n, 2 * n]), C.draw())
    assert c != d
    return one.decode(), two.decode()


def test_computed_pairs_in_near_duplicates(spark, computed):
    test_near_duplicates(spark, computed)
    docs = [(i, f"{w} x y z") for i, w in enumerate(computed)]
    assert sorted(r.doc_id for r in ngram_join.clean(frame(spark, docs)).collect()) == [0, 1]


def test_computed_pairs_in_windows(spark, computed):
    test_repeated_windows(spark, computed)


def test_computed_pairs_in_lines(spark, computed):
    one, two = computed
    text = f"{one} x y {two} x y\n{one}\n{two}"
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    assert [list(r.values())[1:6] for b in quality_rules._count_batches([batch]) for r in b.to_pylist()] == [test_quality_rules.brute(text)]
    assert test_quality_rules.brute(text)[4] == 0
    docs = [(i, f"own {'abcdefgh'[i]}\n{computed[i % 2]}") for i in range(6)]
    got = sorted((r.doc_id, r.text) for r in line_templates.drop_lines(frame(spark, docs)).collect())
    assert got == sorted(test_line_templates.brute(docs)) == sorted(docs)


def test_computed_pairs_in_benchmark_items(spark, computed):
    one, two = computed
    items = [(1, f"{one} x y z"), (2, f"{two} is one of the words of this item"), (3, one)]
    docs = [(1, f"before it {two} x y z after it"), (2, f"before it {one} is one of the words of this item after it"), (3, f"{one} x y z"), (4, f"{two} {one}")]
    got = {tuple(r)[:2] for r in decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(3, 1), (2, 3), (3, 3), (4, 3)} and not test_decontaminate.brute(docs, items)
