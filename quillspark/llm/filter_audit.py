"""Filter interaction audit by Walsh-Hadamard sums.

A document fails some of five filters: a mask of five bits. For each part and
label, 32 signed sums are gathered, one for each set of filters: a document
counts +1 if it fails an even number of the set's filters and -1 otherwise.
The transform is its own inverse up to the factor 32, so the sums give the
number of documents of each mask exactly. From these 32 cells follows what
any order of the filters does. A document that fails k filters is removed by
each of them in 120 / k of the 120 orders, which gives each filter's Shapley
value in closed form.

Counts of a text come from array code in one pass, which leaves a few bytes a
document; equal texts meet by their SHA-256, hot ones by a broadcast of bounded
size. Sums are combined before they are shuffled, and a part's orders are
evaluated in the task that has its sums.

Results by case: a null or empty text has no words and code points: it fails A,
and E if a smaller id has an empty or null text; a null id is neither
smaller than others nor has smaller ones; repeated ids are documents of their own and not smaller than each
other; a null lang is the part ''; several labels of one id count as 1 if any is; documents
without a label are neither good nor toxic; an empty table gives no rows;
further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the filters.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"

MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in COUNTS])

#: Signs of the transform: row s, column m is -1 if m has an odd number of the bits of s.
HADAMARD = np.where(np.bitwise_count(np.arange(MASKS)[:, None] & np.arange(MASKS)) % 2, -1, 1)

_CAPITAL, _SIGN, _CONTINUED = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN[list(SIGNS)] = True
_CONTINUED[0x80:0xC0] = True


def text_masks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text of a chunk fails."""
    of = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    start, end, first = C.word_spans(data, bounds)
    words = np.diff(first)
    _, number = C.distinct_spans(data, start, end)
    pairs = np.unique(C.owners(first) * (len(start) + 1) + number)
    distinct = np.bincount(pairs // (len(start) + 1), minlength=len(words))
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * of(_CAPITAL[data]) > CAPITAL_PERCENT * of(~_CONTINUED[data]), of(_SIGN[data]) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in C.chunks(batches):
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "part", "sha")], pa.array(text_masks(data, bounds), pa.int32())], ["doc_id", "part", "sha", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of docs (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    rows = C.checkpoint(rows.mapInArrow(_mask_batches, "doc_id long, part string, sha binary, mask int"))
    first = C.checkpoint(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return C.meet(rows, first, "sha", "doc_id").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def sums(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, s0, ..., s31): the signed sums of each part and label."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = masked.join(known, "doc_id", "left").select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "mask")
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    return rows.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(MASKS)])


def cells(signed: np.ndarray) -> np.ndarray:
    """The number of documents of each mask from the signed sums."""
    total = HADAMARD @ signed
    found, rest = np.divmod(total, MASKS)
    if rest.any() or (found < 0).any():
        raise ValueError("these aren't the sums of whole documents")
    return found


def evaluate(every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, list]:
    """All orders and steps from the cells of all, of good and of toxic documents."""
    mask = np.arange(MASKS)
    fails, size = (mask[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool), np.bitwise_count(mask)
    shapley = [int((every[fails[:, f]] * (len(ORDERS) // size[fails[:, f]])).sum()) for f in range(len(FILTERS))]
    out: dict[str, list] = {c: [] for c in _OUT.names if c != "part"}
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            gone, own = mask & before > 0, fails[:, f]
            before |= 1 << f
            removed = own & ~gone
            row = (order, step, every[~own & ~gone].sum(), every[removed].sum(), every[own & gone].sum(), every[1 << f], good[removed].sum(), toxic[removed].sum(), shapley[f])
            for c, x in zip(out, row, strict=True):
                out[c].append(x)
    return out


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("every", "good", "toxic")]
        for i, part in enumerate(batch.column("part").to_pylist()):
            found = evaluate(*[cells(np.array(c[i].as_py(), np.int64)) for c in columns])
            yield C.record(_OUT, {"part": [part] * len(found["step"])} | found)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    signed = sums(masks(docs), labels)
    total = lambda where: F.array(*[F.coalesce(F.sum(F.when(where, F.col(f"s{s}"))), F.lit(0)) for s in range(MASKS)])
    parts = signed.groupBy("part").agg(total(F.lit(True)).alias("every"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))
    return parts.mapInArrow(_evaluate, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
