"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text's terms are its words (folded, hashed into WORDS columns), trigrams of
byte classes (case, digits, marks, white space) and levels of its own
repetition. Latent-semantic analysis of a bounded sample of labelled rows (term
weights and a truncated singular value decomposition by power iterations over
blocks of rows) gives each text a short vector. The sample's
vectors are broadcast; for every document the cosine with all of them is
computed exactly, block by block, and the nearest vote with their similarity.
Of equally near points the one that comes first in the sample, sorted by terms,
weights and label, counts.

Results by case: extra columns are ignored, whatever their names; null and empty texts have the vector of a text without terms
and get the sample's mean label; one row for each input row, also for null and
repeated ids; labels without a text, nulls and contradictions among them are
left out; without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled
from .quality_rules import count_chunk

#: Bytes of one class share a sign; classes are numbered from 1.
CLASSES = [bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"'\"", b"()[]{}", b":;", b"-_", b"/\\", b"@", b"=+~^`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
N = len(CLASSES) + 1
LEVELS, WORDS = 11, 1 << 12
#: Share of a word's weight in the matrix beside a class trigram's.
WORD_WEIGHT = 0.25
TERMS = N**3 + 2 * LEVELS + WORDS
_CLASS = np.zeros(256, np.int64)
for _i, _group in enumerate(CLASSES):
    _CLASS[list(_group)] = _i + 1


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of a chunk, by document and term: log counts of class trigrams and words, and levels of repetition."""
    sign, doc = _CLASS[data], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = doc * TERMS
    if len(sign) > 2:
        three = (key[:-2] + (sign[:-2] * N + sign[1:-1]) * N + sign[2:])[doc[:-2] == doc[2:]]
    else:
        three = np.zeros(0, np.int64)
    found, count = np.unique(three, return_counts=True)
    weight = np.log1p(count)
    counts = count_chunk(data, bounds)
    rows = np.flatnonzero(counts["n_words"] > 0)
    for i, (part, whole) in enumerate((("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"))):
        level = counts[part][rows] * (LEVELS - 1) // np.maximum(counts[whole][rows], 1)
        found = np.concatenate([found, rows * TERMS + N**3 + i * LEVELS + level])
        weight = np.concatenate([weight, np.full(len(rows), 6.0)])
    start, end, first = C.trimmed_words(data, bounds)
    words = C.word_hashes(data, start, end, fold=True) % np.uint64(WORDS)
    used, count = np.unique(C.owners(first) * TERMS + (N**3 + 2 * LEVELS) + words.astype(np.int64), return_counts=True)
    found, weight = np.concatenate([found, used]), np.concatenate([weight, WORD_WEIGHT * np.log1p(count)])
    order = np.argsort(found, kind="stable")
    return found[order] // TERMS, found[order] % TERMS, weight[order]


class Space:
    """A latent-semantic space and the labelled vectors in it."""

    def __init__(self, rows: list[tuple[list[int], list[float], int]], rank: int, near: int):
        self.near = near
        self.labels = np.array([label for _, _, label in rows], float)
        self.mean = float(self.labels.mean()) if len(rows) else 0.5
        used = np.unique([t for ids, _, _ in rows for t in ids]).astype(np.int64)
        self.column = np.full(TERMS, -1, np.int64)
        self.column[used] = np.arange(len(used))
        columns = [self.column[np.asarray(ids, np.int64)] for ids, _, _ in rows]
        seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *columns]), minlength=len(used))
        self.idf = np.log((1 + len(rows)) / (1 + seen)) + 0.5
        entries = [np.asarray(weights) * self.idf[c] for c, (_, weights, _) in zip(columns, rows, strict=True)]
        entries = [x / max(np.linalg.norm(x), 1e-12) for x in entries]
        # the leading right singular vectors, from products with blocks of rows; the whole matrix is never held
        basis = np.random.default_rng(0).standard_normal((len(used), min(2 * rank, len(used))))
        for _ in range(8 if len(used) and rows else 0):
            basis = np.linalg.qr(sum((m.T @ (m @ basis) for m in self._blocks(columns, entries)), np.zeros_like(basis)))[0]
        values, turn = np.linalg.eigh(sum(((y := m @ basis).T @ y for m in self._blocks(columns, entries)), np.zeros((basis.shape[1],) * 2)))
        self.axes = np.ascontiguousarray((basis @ turn[:, np.argsort(-values)])[:, :rank], np.float32)
        self.points = self._unit(np.concatenate([np.zeros((0, self.axes.shape[1])), *[m @ self.axes for m in self._blocks(columns, entries)]]))

    def _blocks(self, columns: list[np.ndarray], entries: list[np.ndarray], size: int = 250) -> Iterator[np.ndarray]:
        """The rows of the term matrix, a few at a time."""
        for at in range(0, len(columns), size):
            block = np.zeros((len(columns[at : at + size]), len(self.idf)))
            for i, (c, x) in enumerate(zip(columns[at : at + size], entries[at : at + size], strict=True)):
                block[i, c] = x
            yield block

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def vectors(self, n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        column = self.column[term]
        known = column >= 0
        doc, column, weight = doc[known], column[known], weight[known]
        out = np.zeros((n, self.axes.shape[1]), np.float32)
        if len(doc):
            head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[head]] = np.add.reduceat(self.axes[column] * (weight * self.idf[column])[:, None].astype(np.float32), head)
        return self._unit(out)

    def scores(self, vectors: np.ndarray, block: int = 512) -> np.ndarray:
        """The similarity-weighted label of the nearest points; without a similar point the mean label."""
        out = np.full(len(vectors), self.mean)
        k = min(self.near, len(self.points))
        for at in range(0, len(vectors) if k and self.axes.size else 0, block):
            cosine = vectors[at : at + block] @ self.points.T
            # the order of points decides between equal similarities
            least = np.partition(cosine, -k, axis=1)[:, -k : -k + 1] if k < cosine.shape[1] else cosine.min(1, keepdims=True)
            rank = (cosine > least).astype(np.int8) + (cosine >= least)
            top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(float) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[top]).sum(1)
            out[at : at + block] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.mean)
        return np.clip(out, 0, 1)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in C.chunks(batches):
        doc, term, weight = terms(data, bounds)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind)) for x, kind in ((term, pa.int32()), (weight, pa.float64()))]
        yield pa.RecordBatch.from_arrays([rows.column("label"), *lists], ["label", "terms", "weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int = 3000, rank: int = 32, near: int = 15) -> Space:
    """most: bound of the labelled rows that are learnt from, for each label value. Only their terms reach the driver."""
    rows = labelled.sample(docs, labels, label, fold, {0: most, 1: most}).mapInArrow(_terms_of, "label int, terms array<int>, weights array<double>")
    found = sorted((r.terms, r.weights, r.label) for r in rows.collect())
    return Space(found, rank, near)


def classify(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            score = shared.value.scores(shared.value.vectors(rows.num_rows, *terms(data, bounds)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
