"""Quality rules with weak supervision: rules vote or abstain, EM weighs them.

Counts of each whole text come from array code; the rules are expressions over
these counts and vote 1 (good), -1 (bad) or 0 (abstain). The number of
documents with each pattern of votes (at most 3 ** rules rows, whatever the
input) is all that reaches the driver. There expectation-maximisation over all
patterns estimates how often each rule is right; the posterior probability is then an expression over the votes.

Results by case: a null or empty text has no words and fails the base rules;
null or repeated ids are carried through, one row for each input row; the
order of rows doesn't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_shouts"]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _SHOUT = _table(SYMBOLS), _table(b"!?")
_CAPITAL = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
_CONTINUED = _table(bytes(range(0x80, 0xC0)))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = out[order[:-1][equal]] = True
    return out


def count_chunk(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    start, end, first = C.word_spans(data, bounds)
    doc = C.owners(first)
    _, words = C.distinct_spans(data, start, end)
    out = {
        "n_words": np.diff(first),
        "word_chars": _sums(~C.SPACE[data] & ~_CONTINUED[data], bounds),
        "n_symbols": _sums(_SYMBOL[data], bounds),
        "n_letters": _sums(_LETTER[data], bounds),
        "n_capitals": _sums(_CAPITAL[data], bounds),
        "n_shouts": _sums(_SHOUT[data], bounds),
    }
    # lines with a word, and those that stood before in the same text
    feeds = np.flatnonzero(data == 10)
    head = np.union1d(bounds[:-1], feeds + 1)
    head = head[head < len(data)]
    tail = np.append(head[1:], len(data))
    fed = np.zeros(len(data) + 1, bool)
    fed[feeds + 1] = True
    tail = tail - fed[tail]
    worded = np.searchsorted(start, head) < np.searchsorted(start, tail)
    head, tail = head[worded], tail[worded]
    line_doc = np.searchsorted(bounds, head, "right") - 1
    _, content = C.distinct_spans(data, head, tail)
    _, kept = np.unique(line_doc * (len(head) + 1) + content, return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=len(bounds) - 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[kept], minlength=len(bounds) - 1)
    # words in windows that occur twice or more in the same text
    covered = np.zeros(len(words), bool)
    runs = C.run_hashes(C.mix(words.astype(np.uint64)), WINDOW)
    inside = np.flatnonzero(doc[: len(runs)] == doc[len(doc) - len(runs) :])
    inside = inside[_repeated(runs[inside] ^ C.mix(doc[inside].astype(np.uint64)))]
    keys = doc[inside]
    for j in range(WINDOW):  # what hashes leave, by the words' numbers: equal keys are equal windows of one text
        keys = np.unique(keys * (len(words) + 1) + words[inside + j], return_inverse=True)[1]
    inside = inside[_repeated(keys)]
    for j in range(WINDOW):
        covered[inside + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(bounds) - 1)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in C.chunks(batches):
        counts = count_chunk(data, bounds)
        yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], [*rows.schema.names, *COUNTS])


def with_counts(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with a struct column `counts`; text is left out unless asked for. Clashing column names are safe: they stay inside `row`."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if keep_text or c != "text"]).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_count_batches, f"row {kind}, text string, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.select("row", F.struct(*COUNTS).alias("counts"))


def _c(name: str) -> Column:
    return F.col(f"counts.{name}")


def _vote(condition: Column, vote: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), vote).otherwise(0)


def votes() -> dict[str, Column]:
    """The vote of each rule over `counts`; limits are shares of words, letters or lines. All but `prose` speak for one side and abstain otherwise."""
    words, letters = F.greatest(_c("n_words"), F.lit(1)), F.greatest(_c("n_letters"), F.lit(1))
    length = _c("word_chars") / words
    symbols, shouts = _c("n_symbols") / words, _c("n_shouts") / words
    capitals, alpha = _c("n_capitals") / letters, _c("n_letters") / F.greatest(_c("word_chars"), F.lit(1))
    repeats, lines = _c("n_repeat_words") / words, _c("n_dup_lines") / F.greatest(_c("n_lines"), F.lit(1))
    return {
        "prose": F.when((alpha >= 0.88) & (capitals < 0.25) & length.between(3, 9) & (symbols < 0.05), 1).when((symbols > 0.2) | (shouts > 0.5) | (capitals > 0.5) | (length < 2.5) | (length > 12), -1).otherwise(0),
        "fresh": _vote((words >= LEAST_WORDS) & (repeats < 0.2) & (lines < 0.2), 1),
        "word_length": _vote((length < 2.5) | (length > 12), -1),
        "symbols": _vote(symbols > 0.2, -1),
        "shouting": _vote(shouts > 0.5, -1),
        "capitals": _vote(capitals > 0.5, -1),
        "letters": _vote(alpha < 0.7, -1),
        "repeats": _vote(repeats > 0.4, -1),
        "dup_lines": _vote((lines > 0.3) & (_c("n_lines") >= 3), -1),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], balance: float = 0.5, rounds: int = 50) -> list[float]:
    """Accuracy of each rule by EM from (votes, number of documents).

    A rule that votes is right with its accuracy, whichever class; abstaining
    tells nothing. balance: prior probability that a document is good; it is
    given, as rules that speak for one side only can't tell it. Accuracies stay
    in 0.6 to 0.95: a rule is never turned round, and two outvote any one.
    """
    m = len(patterns[0][0]) if patterns else len(votes())
    v = np.array([p for p, _ in patterns], float).reshape(len(patterns), m)
    n = np.array([c for _, c in patterns], float)
    accuracy = np.full(m, 0.8)
    for _ in range(rounds if len(patterns) else 0):
        logit = math.log(balance / (1 - balance)) + v @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        right = n @ np.where(v > 0, good[:, None], np.where(v < 0, 1 - good[:, None], 0))
        accuracy = np.clip((right + 8) / (n @ (v != 0) + 10), 0.6, 0.95)
    return accuracy.tolist()


def judge(docs: DataFrame, keep_text: bool = False, threshold: float = 0.5, balance: float = 0.5) -> DataFrame:
    """(row, counts, base_failed, posterior, kept) for each row of docs; row holds docs' columns, text only if asked for."""
    rules = votes()
    voted = with_counts(docs, keep_text).select("row", "counts", *[v.cast("int").alias(f"vote_{k}") for k, v in rules.items()])
    names = [f"vote_{k}" for k in rules]
    seen = with_counts(docs.select("text")).select(*[v.cast("int").alias(f"vote_{k}") for k, v in rules.items()]).groupBy(*names).count().collect()
    accuracy = fit([(tuple(r[:-1]), r[-1]) for r in sorted(seen)], balance)
    logit = reduce(lambda a, b: a + b, [F.col(c) * math.log(a / (1 - a)) for c, a in zip(names, accuracy, strict=True)], F.lit(math.log(balance / (1 - balance))))
    posterior = 1 / (1 + F.exp(-logit))
    failed = (_c("n_words") < LEAST_WORDS) | (100 * _c("n_repeat_words") > REPEAT_PERCENT * _c("n_words"))
    return voted.select("row", "counts", failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= threshold)).alias("kept"), *names)


def digest(judged: DataFrame) -> DataFrame:
    """The counts of the base rules and the verdict, by doc_id."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("row.doc_id").cast("long").alias("doc_id"), *[F.col(f"counts.{c}").alias(c) for c in base], "base_failed", "kept", "posterior")
