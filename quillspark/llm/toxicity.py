"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words compares their common subsequences of three letters;
each occurrence counts DECAY to the power of the letters it spans, so letters
inserted between or left out cost a little, not the match. It is normalised to
1 for equal words, and its fourth power is used. Landmarks (Nystrom) are words and word parts chosen from a
bounded sample of labelled training rows, one after another, each for the toxic
texts that it alone would find. A text's value at a landmark is the kernel's
largest value over its words (values under FLOOR count 0), with the log of their
squares' sum beside it; the landmarks' own kernel matrix whitens these values,
and a linear machine with squared hinge
loss is trained on them. Letters that stand apart ("i d i o t") are also read
as one word.

Results by case: a null or empty text, like any without words, has value 0 at
all landmarks and so the machine's lowest scores; one row for each input row,
also for null and repeated ids; without labelled rows of both kinds the score
is 0 for all. Words longer than 24 letters are read in overlapping parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled

DECAY, FLOOR, LONGEST, SHARPEN = 0.6, 0.25, 24, 4
SIGNS = 32
#: Toxic texts that a landmark finds beside those that others find already, at least.
SUPPORT = 3

#: Sign of each byte: 0 ends, letters 1 to 26 in either case, digits read as the letters they resemble, 27 to 31 for the rest.
_SIGN = np.full(256, 31, np.uint8)
_SIGN[65:91] = _SIGN[97:123] = np.arange(1, 27)
for _digit, _letter in zip(b"0134578@$!", b"oleastbasi", strict=True):
    _SIGN[_digit] = _letter - 96
_SIGN[0x80:0xC0] = 27 + np.arange(64) % 3
_SIGN[0xC0:] = 30

_EDGE = np.zeros(256, bool)  # marks that are cut off at a word's ends
_EDGE[list(b".,;:!?\"'()[]{}<>*_-~`|/\\+=#%&^")] = True


def triples(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length, a row each: (code, weight) of every three-letter subsequence; codes by row, weights by column."""
    n = signs.shape[1]
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    wide = signs.astype(np.int32)
    code = (wide[:, at[:, 0]] * SIGNS + wide[:, at[:, 1]]) * SIGNS + wide[:, at[:, 2]]
    return code, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def signs_of(word: bytes) -> np.ndarray:
    return _SIGN[np.frombuffer(word, np.uint8)]


def features(word: bytes) -> dict[int, float]:
    """The kernel's feature vector of one word."""
    out: dict[int, float] = {}
    if len(word) >= 3:
        code, weight = triples(signs_of(word)[None, :LONGEST])
        for c, w in zip(code[0].tolist(), weight.tolist(), strict=True):
            out[c] = out.get(c, 0.0) + w
    return out


def kernel(a: bytes, b: bytes) -> float:
    x, y = features(a), features(b)
    dot = lambda p, q: sum(w * q.get(c, 0.0) for c, w in p.items())
    return dot(x, y) / ((dot(x, x) * dot(y, y)) ** 0.5) if x and y else 0.0


class Landmarks:
    """Kernel values of many words with a few fixed words."""

    def __init__(self, words: list[bytes]):
        self.words = words
        vectors = [features(w) for w in words]
        norms = [sum(x * x for x in v.values()) ** 0.5 for v in vectors]
        codes = sorted({c for v in vectors for c in v})
        self.row = np.zeros(SIGNS**3, np.int32)
        self.row[codes] = np.arange(1, len(codes) + 1)
        self.value = np.zeros((len(codes) + 1, len(words)), np.float32)
        for j, (v, norm) in enumerate(zip(vectors, norms, strict=True)):
            for c, w in v.items():
                self.value[self.row[c], j] = w / norm

    def of_length(self, signs: np.ndarray) -> np.ndarray:
        """Values of words of one length (rows of signs) with every landmark; under FLOOR is 0."""
        out = np.zeros((len(signs), len(self.words)), np.float32)
        if signs.shape[1] < 3 or not self.words:
            return out
        step = max(1, 400_000 // len(list(combinations(range(signs.shape[1]), 3))))
        for at in range(0, len(signs), step):
            code, weight = triples(signs[at : at + step])
            known = self.row[code]
            r, p = np.nonzero(known)
            if not len(r):
                continue
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            raw = np.add.reduceat(self.value[known[r, p]] * weight[p][:, None], head)
            rows = r[head]
            # a word's own kernel is at least the square sum of its weights, which bounds its value with a landmark
            near = raw.max(1) >= FLOOR * float(np.sqrt((weight**2).sum()))
            rows, raw = rows[near], raw[near]
            if not len(rows):
                continue
            own = np.sort((code[rows].astype(np.int64) << 32) | np.arange(code.shape[1]), axis=1)
            kind, w = own >> 32, weight[own & 0xFFFFFFFF].astype(np.float64)
            new = np.concatenate([np.ones((len(rows), 1), bool), kind[:, 1:] != kind[:, :-1]], 1).ravel()
            sums = np.add.reduceat(w.ravel(), np.flatnonzero(new)) ** 2
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(rows)), code.shape[1])[new], sums, len(rows)))
            value = raw / norm[:, None].astype(np.float32)
            out[at + rows] = np.where(value >= FLOOR, value, 0)
        return out


def chunk_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, source bytes) of the words to compare: marks cut off the ends, long ones in parts, single letters joined."""
    start, end, first = C.word_spans(data, bounds)
    doc = C.owners(first)
    for _ in range(8):
        cut = (end > start) & _EDGE[data[np.minimum(start, len(data) - 1)]]
        start = start + cut
        tail = (end > start) & _EDGE[data[np.maximum(end - 1, 0)]]
        end = end - tail
        if not cut.any() and not tail.any():
            break
    # single letters in a row make one more word each
    single = (end - start == 1).astype(np.int8)
    joined: list[bytes] = []
    owner: list[int] = []
    if single.any():
        same = np.concatenate([[False], doc[1:] == doc[:-1]])
        begin = np.flatnonzero((single == 1) & ~(same & (np.concatenate([[0], single[:-1]]) == 1)))
        after = np.concatenate([same[1:] & (single[1:] == 1), [False]])
        finish = np.flatnonzero((single == 1) & ~after) + 1
        for a, b in zip(begin.tolist(), finish.tolist(), strict=True):
            if b - a >= 3:
                joined.append(data[start[a:b]].tobytes())
                owner.append(int(doc[a]))
    if joined:
        more = np.cumsum([0, *map(len, joined)])
        data, at = np.concatenate([data, np.frombuffer(b"".join(joined), np.uint8)]), len(data)
        start, end, doc = np.concatenate([start, at + more[:-1]]), np.concatenate([end, at + more[1:]]), np.concatenate([doc, np.array(owner, np.int64)])
    long = np.flatnonzero(end - start > LONGEST)
    if len(long):
        parts = (end[long] - start[long] - LONGEST + LONGEST // 2 - 1) // (LONGEST // 2) + 1
        piece = np.repeat(start[long], parts) + (LONGEST // 2) * C.ragged(np.zeros(len(long), np.int64), parts)
        stop = np.minimum(piece + LONGEST, np.repeat(end[long], parts))
        keep = np.ones(len(start), bool)
        keep[long] = False
        start, end, doc = np.concatenate([start[keep], piece]), np.concatenate([end[keep], stop]), np.concatenate([doc[keep], np.repeat(doc[long], parts)])
    use = end - start >= 3
    return doc[use], start[use], end[use], data


def values(landmarks: Landmarks, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document and landmark: the largest sharpened kernel value over its words, and log(1 + their squares' sum); each distinct word is compared once."""
    n = len(bounds) - 1
    out, total = np.zeros((2, n, len(landmarks.words)), np.float32)
    doc, start, end, data = chunk_words(data, bounds)
    if not len(doc):
        return out, total
    signs = _SIGN[data]
    hashes = C.byte_hashes(signs, start, end)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    found = np.zeros((len(at), len(landmarks.words)), np.float32)
    length = (end - start)[at]
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        found[own] = landmarks.of_length(signs[start[at[own]][:, None] + np.arange(size)])
    found **= SHARPEN
    word, mark = np.nonzero(found)
    # (document, word) pairs that matter, each distinct word of a document once
    pair = np.unique(doc * len(at) + inverse) if len(word) else np.zeros(0, np.int64)
    owner, which = pair // max(1, len(at)), pair % max(1, len(at))
    first, last = np.searchsorted(word, which), np.searchsorted(word, which, "right")
    entry = C.ragged(first, last - first)
    cell = np.repeat(owner, last - first) * len(landmarks.words) + mark[entry]
    value = found[word[entry], mark[entry]]
    np.maximum.at(out.reshape(-1), cell, value)
    total += np.bincount(cell, value.astype(float) ** 2, total.size).reshape(total.shape)
    return out, np.log1p(total)


def _stems(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bytes) of the distinct words of a text and of their beginnings of 4 to 9 letters."""
    _, start, end, data = chunk_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    if not len(start):
        return np.zeros(0, np.uint64), start, end, data
    starts, ends = [start], [end]
    for k in range(4, 10):
        long = end - start > k
        starts.append(start[long])
        ends.append(start[long] + k)
    start, end = np.concatenate(starts), np.concatenate(ends)
    hashes, at = np.unique(C.byte_hashes(C.FOLDED[data], start, end), return_index=True)
    return hashes, start[at], end[at], data


def choose(texts: list[tuple[bytes, int]], most: int, times: int = 4) -> list[bytes]:
    """Landmarks: words, and beginnings of 4 to 9 letters, each the best for toxic texts that fewer than `times` earlier ones find."""
    labels = np.array([label for _, label in texts])
    n_toxic, n_clean = max(1, int(labels.sum())), max(1, int((labels == 0).sum()))
    keys, counts = np.unique(np.concatenate([_stems(text)[0] for text, toxic in texts if toxic]), return_counts=True)
    keys, counts = keys[counts >= 2], counts[counts >= 2]
    among = np.zeros(len(keys), np.int64)
    for text, toxic in texts:
        if not toxic and len(keys):
            own = _stems(text)[0]
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            among[at[keys[at] == own]] += 1
    fit = (counts / n_toxic > 5 * (among + 0.5) / n_clean)
    keys, clean = keys[fit], dict(zip(keys[fit].tolist(), among[fit].tolist(), strict=True))
    # only the stems that qualify are spelt out
    names: dict[int, bytes] = {}
    homes: dict[bytes, list[int]] = {}
    for i, (text, toxic) in enumerate(texts):
        if toxic:
            h, start, end, data = _stems(text)
            for j in np.flatnonzero(np.isin(h, keys)).tolist():
                name = names.setdefault(int(h[j]), data[start[j] : end[j]].tobytes().lower())
                homes.setdefault(name, []).append(i)
    clean = {name: clean[h] for h, name in names.items()}
    out: list[bytes] = []
    gone: Counter[int] = Counter()
    while homes and len(out) < most:
        best = max(homes, key=lambda w: (sum(gone[i] < times for i in homes[w]) - 3 * clean[w], len(w), w))
        fresh = [i for i in homes.pop(best) if gone[i] < times]
        if len(fresh) < SUPPORT:  # what few texts have may be chance
            continue
        gone.update(fresh)
        out.append(best)
        for w in [w for w in homes if w.startswith(best) or best.startswith(w)]:
            del homes[w]  # the same stem again
    return out


class Machine:
    """Landmarks, the whitening of their values, a linear machine and a curve to probabilities."""

    def __init__(self, texts: list[tuple[bytes, int]], landmarks: int):
        labels = np.array([t for _, t in texts], float)
        self.landmarks = Landmarks(choose(texts, landmarks) if 0 < labels.sum() < len(labels) else [])
        m = len(self.landmarks.words)
        self.white = np.zeros((m, m))
        self.weights, self.curve = np.zeros(2 * m + 1), (0.0, -50.0)
        if not m:
            return
        own = np.array([[kernel(a, b) ** SHARPEN for b in self.landmarks.words] for a in self.landmarks.words])
        value, vector = np.linalg.eigh(own + 1e-3 * np.eye(m))
        self.white = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts], pa.binary())], ["text"])
        x = np.vstack([self._inputs(values(self.landmarks, data, bounds)) for _, data, bounds in C.chunks(iter([batch]), limit=1 << 19)])
        sign, share = np.where(labels > 0, 1.0, -1.0), labels.mean()
        cost = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(100):  # squared hinge loss by Newton's method on the active rows
            active = sign * (x @ self.weights) < 1
            a, c = x[active], cost[active]
            target = np.linalg.solve((a * c[:, None]).T @ a + 0.01 * len(x) / 100 * np.eye(2 * m + 1), (a * c[:, None]).T @ sign[active])
            if np.abs(target - self.weights).max() < 1e-8:
                break
            self.weights = 0.5 * self.weights + 0.5 * target
        self.curve = labelled.platt(x @ self.weights, labels)

    def _inputs(self, v: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.hstack([v[0].astype(float) @ self.white, v[1].astype(float) @ self.white, np.ones((len(v[0]), 1))])

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        margin = self._inputs(values(self.landmarks, data, bounds)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most_toxic: int = 2000, most_clean: int = 3000, landmarks: int = 48) -> Machine:
    """most_toxic and most_clean: bounds of the labelled texts that are learnt from, the only texts that reach the driver."""
    rows = labelled.sample(docs, labels, label, fold, {1: most_toxic, 0: most_clean}).select("doc_id", "text", "label").collect()
    return Machine([(r.text.encode(), r.label) for r in sorted(rows)], landmarks)


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.scores(data, bounds))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
