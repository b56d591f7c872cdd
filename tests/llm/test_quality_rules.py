import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


PARTS = ["a", "b", "é", "x#", " ", " ", "\n", "\t", "\r", "\x0b", "\xa0", "|", "WORD", "a b a b ", "line\nline\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=6))
def test_counts(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = [list(row.values())[1:6] for b in Q._count_batches([batch]) for row in b.to_pylist()]
    assert out == [brute(t) for t in texts]


def test_cases_and_labels(spark):
    docs = spark.createDataFrame([(1, None, 1, "q"), (None, "", 2, "q"), (2, "a b", 3, "q"), (2, "a b", 3, "q")], "doc_id long, text string, counts int, n_words string")
    rows = Q.judge(docs).collect()
    assert len(rows) == 4 and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert Q.judge(docs.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = bad = kept_good = kept_bad = 0
    for r in Q.digest(Q.judge(docs)).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if not r.base_failed and r.doc_id in labels:
            if labels[r.doc_id]:
                good, kept_good = good + 1, kept_good + r.kept
            else:
                bad, kept_bad = bad + 1, kept_bad + r.kept
    assert kept_good > 0.98 * good and kept_bad < 0.2 * bad


def test_em_finds_the_better_rule():
    patterns = [((1, 1, 1), 800), ((-1, -1, -1), 150), ((-1, 1, 1), 60), ((1, 1, -1), 5), ((1, -1, -1), 40)]
    accuracy = Q.fit(patterns)
    assert accuracy[2] > accuracy[0] and accuracy[1] > accuracy[0]


def test_long_text():
    text = "\n".join(f"line {i % 5000} of many words x{i % 7000}" for i in range(90_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "a b c a b c"])], ["text"])
    assert [list(r.values())[1:6] for b in Q._count_batches([batch]) for r in b.to_pylist()] == [brute(text), brute("a b c a b c")]
