"""Benchmark decontamination with SimHash windows of the items' sizes.

Items and documents are words without case and outer punctuation, in shingles
of five words; a shingle weighs the logarithm of its length in bytes. For each
length that items have, windows of that many words slide over every document.
A window's SimHash is looked up in a multi-index of the items' SimHashes: 64
bits in four blocks of 16, each probed at all values within four bits, which
finds every item within 19 bits of the window. The weighted Jaccard similarity
of the two shingle multisets, compared by their words, then decides. Of pairs of a similarity from 0.8 to
0.9, 0.99 or more are within 19 bits (tests/llm/test_decontaminate.py).

A window can reach the similarity only if shingles of items make up that share
of its own weight, so fingerprints are computed for these windows alone.

Items come to the driver in blocks of bounded size and each block is broadcast
and held against all documents, one block at a time. With one block no document
moves; with more, documents meet what was found in them by their key.

Results by case: an item of fewer than five words is one shingle, its whole
sequence, and a document has it only if it holds that whole; an item without
words matches nothing, as does a null or empty text; a document a little shorter
than an item is one window; null and repeated ids are carried through; an empty
table of either kind gives no matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, BLOCKS, BITS, NEAR = 5, 4, 16, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Places of windows whose bit sums are held at once.
STRETCH = 4096
LEAKS = "array<struct<item_id:long,start_word:long,n_words:long,similarity:double>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))

#: All 16-bit masks with at most NEAR bits set.
_MASKS = np.array(sorted(sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(BITS), k)), np.int64)


class Shingles:
    """Of a chunk: the words' hashes and one shingle for each word; those that would cross a document's end have weight 0."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = C.FOLDED[data]
        self.start, self.end, self.first = C.trimmed_words(data, bounds)
        self.words = C.word_hashes(self.data, self.start, self.end)
        self.hashes, self.weights = np.zeros(len(self.words), np.uint64), np.zeros(len(self.words))
        runs = C.run_hashes(self.words, WORDS)
        if len(runs):
            size = np.concatenate([[0], np.cumsum(self.end - self.start)])
            doc = C.owners(self.first)
            inside = doc[: len(runs)] == doc[WORDS - 1 :]
            self.hashes[: len(runs)] = runs
            self.weights[: len(runs)] = np.where(inside, np.log2(1 + size[WORDS:] - size[: len(runs)]), 0)

    def texts(self, a: int, b: int) -> list[bytes]:
        """The words from a to b without case."""
        return [self.data[x:y].tobytes() for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def weighted_shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, first, words) of Shingles."""
    s = Shingles(data, bounds)
    return s.hashes, s.weights, s.first, s.words


def _bit_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the weighted signs of each of the 64 bits; row i has the first i shingles."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return np.concatenate([np.zeros((1, 64)), np.cumsum((2 * bits - 1) * weights[:, None], axis=0)])


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _prints_of(hashes: np.ndarray, weights: np.ndarray, at: np.ndarray, shingles: int) -> np.ndarray:
    """Fingerprints of windows of so many shingles from the ascending places at; sums are kept for a stretch of a few thousand shingles."""
    out = np.zeros(len(at), np.uint64)
    done = 0
    while done < len(at):
        to = int(np.searchsorted(at, at[done] + STRETCH, "right"))
        lo = int(at[done])
        sums = _bit_sums(hashes[lo : int(at[to - 1]) + shingles], weights[lo : int(at[to - 1]) + shingles])
        out[done:to] = _fingerprints(sums[at[done:to] - lo + shingles] - sums[at[done:to] - lo])
        done = to
    return out


def bag(words: list[bytes]) -> Counter:
    """The multiset of shingles, as the words themselves."""
    return Counter(zip(*[words[k:] for k in range(WORDS)], strict=False))


def bag_weights(*bags: Counter) -> dict[tuple, float]:
    return {s: math.log2(1 + sum(map(len, s))) for b in bags for s in b}


def similarity(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted Jaccard similarity of two multisets."""
    low = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
    high = sum(n * weight[s] for s, n in a.items()) + sum(n * weight[s] for s, n in b.items()) - low
    return low / high if high else 0.0


class Index:
    """A block of items: shingles, fingerprints and the multi-index, by item length."""

    def __init__(self, items: list[tuple[int | None, str]], least: float):
        self.least = least
        self.ids, self.words, lengths, prints, shingles = [], [], [], [], []
        short: dict[int, list[tuple[int, list[bytes], int | None]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            raw = np.frombuffer(text.encode(), np.uint8)
            s = Shingles(raw, np.array([0, len(raw)]))
            n = int(s.first[-1])
            if n < WORDS:
                if n:
                    short.setdefault(n, []).append((int(C.run_hashes(s.words, n)[0]), s.texts(0, n), item_id))
                continue
            hashes, weights = s.hashes[: n - WORDS + 1], s.weights[: n - WORDS + 1]
            self.ids.append(item_id)
            self.words.append(b" ".join(s.texts(0, n)))
            shingles.append(np.unique(hashes))
            lengths.append(n)
            prints.append(_fingerprints(_bit_sums(hashes, weights)[-1:])[0])
        # short items come after the others: hashes of each length, and for each hash its items
        self.short = {}
        for n, own in short.items():
            keys = np.unique(np.array([h for h, _, _ in own], np.uint64))
            items: list[list[int]] = [[] for _ in keys]
            for h, words, item_id in own:
                items[int(np.searchsorted(keys, np.uint64(h)))].append(len(self.ids))
                self.ids.append(item_id)
                self.words.append(b" ".join(words))
            self.short[n] = keys, items
        self.lengths, self.prints = np.array(lengths, np.int64), np.array(prints, np.uint64)
        self.shingles = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.tables = {}
        for n in set(lengths):
            own = np.flatnonzero(self.lengths == n)
            blocks = []
            for b in range(BLOCKS):
                value = (self.prints[own] >> np.uint64(BITS * b)).astype(np.int64) & 0xFFFF
                order = np.argsort(value, kind="stable")
                # sorted block values with their items: as large as the items of this length are many
                blocks.append((value[order].astype(np.uint16), own[order].astype(np.int32)))
            self.tables[n] = blocks

    @staticmethod
    def _met(value: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): value[i] and the sorted values[j] differ in NEAR bits at most; by probes where those are fewer than the values."""
        found = [np.zeros((2, 0), np.int64)]
        if len(values) <= len(_MASKS):
            step = max(1, (1 << 20) // max(1, len(values)))
            for at in range(0, len(value), step):
                i, j = np.nonzero(np.bitwise_count(value[at : at + step, None] ^ values) <= NEAR)
                found.append(np.stack([i + at, j]))
        else:
            for i, v in enumerate(value.tolist()):
                probe = np.sort(v ^ _MASKS).astype(np.uint16)
                low, high = np.searchsorted(values, probe), np.searchsorted(values, probe, "right")
                j = C.ragged(low, high - low)
                found.append(np.stack([np.full(len(j), i), j]))
        i, j = np.concatenate(found, 1)
        return i, j

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): all pairs within RADIUS bits, for items of this length."""
        pairs = []
        for b, (values, items) in enumerate(self.tables[length]):
            value, group = np.unique((prints >> np.uint64(BITS * b)).astype(np.uint16), return_inverse=True)
            met = self._met(value, values)
            order, first = np.argsort(group, kind="stable"), np.searchsorted(np.sort(group), np.arange(len(value) + 1))
            count = (first[1:] - first[:-1])[met[0]]
            pairs.append(np.stack([order[C.ragged(first[met[0]], count)], np.repeat(items[met[1]], count)]))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window, item = np.unique(np.concatenate(pairs, 1), axis=1)
        apart = np.bitwise_count(prints[window] ^ self.prints[item])
        return window[apart <= RADIUS], item[apart <= RADIUS]

    def _short_leaks(self, s: Shingles) -> dict[int, dict[int, tuple[float, int, int]]]:
        """Items that stand whole, the leftmost place of each: hashes find places, the words decide."""
        found: dict[int, dict[int, tuple[float, int, int]]] = {}
        doc = C.owners(s.first)
        for n, (keys, items) in self.short.items():
            runs = C.run_hashes(s.words, n)
            key = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            at = np.flatnonzero((keys[key] == runs) & (doc[: len(runs)] == doc[n - 1 :])) if len(runs) else np.zeros(0, np.int64)
            for a in at.tolist():
                own = found.setdefault(int(doc[a]), {})
                new = [item for item in items[key[a]] if item not in own]
                words = b" ".join(s.texts(a, a + n)) if new else b""
                for item in new:
                    if self.words[item] == words:
                        own[item] = (1.0, a - int(s.first[doc[a]]), n)
        return {d: own for d, own in found.items() if own}

    def leaks(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[float, int, int]]]:
        """document: item: (similarity, first word, words) of its best window, the leftmost of equals."""
        s = Shingles(data, bounds)
        hashes, weights, first = s.hashes, s.weights, s.first
        found = self._short_leaks(s)
        maybe = np.flatnonzero(self.screen[(hashes >> np.uint64(44)).astype(np.int64)] & (weights > 0))
        place = np.searchsorted(self.shingles, hashes[maybe])
        hits = maybe[self.shingles[np.minimum(place, len(self.shingles) - 1)] == hashes[maybe]] if len(self.shingles) else maybe[:0]
        if not len(hits):
            return found
        # only the neighbourhoods of hits are looked at
        longest = int(self.lengths.max())
        doc = C.owners(first)
        touched = np.unique(doc[hits])
        for d in touched.tolist():
            lo, hi = int(first[d]), int(first[d + 1])
            own = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] - lo
            h, w, words = hashes[lo:hi], weights[lo:hi], hi - lo
            hit = np.zeros(words)
            hit[own] = w[own]
            all_w, hit_w = (np.concatenate([[0], np.cumsum(x)]) for x in (w, hit))
            near = np.zeros(words + 1, np.int64)
            np.add.at(near, np.maximum(own - longest + WORDS, 0), 1)
            np.add.at(near, own + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[:words] > 0)
            for n in self.tables:
                at = starts[starts + n <= words]
                size = n
                if words < n:
                    at, size = (np.zeros(1, np.int64), words) if words >= self.least * n else (at[:0], n)
                shingles = size - WORDS + 1
                if shingles < 1 or not len(at):
                    continue
                total, shared = all_w[at + shingles] - all_w[at], hit_w[at + shingles] - hit_w[at]
                at = at[(shared >= self.least * total - 1e-9) & (shared > 0)]
                if not len(at):
                    continue
                bags: dict[int, Counter] = {}
                for window, item in zip(*(x.tolist() for x in self.near(_prints_of(h, w, at, shingles), n)), strict=True):
                    a = int(at[window])
                    if item not in bags:
                        bags[item] = bag(self.words[item].split(b" "))
                    own = bag(s.texts(lo + a, lo + a + size))
                    value = similarity(own, bags[item], bag_weights(own, bags[item]))
                    best = found.get(d, {}).get(item, (0.0, 0, 0))
                    if value >= self.least and value > best[0]:
                        found.setdefault(d, {})[item] = (value, a, size)
        return found


def scan(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_bytes: int = 32 << 20) -> DataFrame:
    """keyed() rows of docs with `leaks`: for each leaked item its id, the best window and the similarity.

    block_bytes: item text that is broadcast at once; a larger benchmark is held against the documents block by block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    rows = C.keyed(docs).withColumn("leaks", F.array().cast(LEAKS))
    kind, several = rows.schema["row"].dataType.simpleString(), []
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part], least))
        found = rows.mapInArrow(_scanner(index), f"key binary, doc_id long, text string, row {kind}, leaks {LEAKS}")
        if blocks == 1:
            return found
        # one block's index at a time is held: what it finds, a few bytes a leak, is kept before the next one is made
        several.append(C.checkpoint(found.select("key", F.explode("leaks").alias("leak")).distinct()))
        index.destroy()
    if several:
        leaks = reduce(DataFrame.unionByName, several).groupBy("key").agg(F.collect_list("leak").alias("leaks"))
        rows = rows.drop("leaks").join(leaks, "key", "left").select("key", "doc_id", "text", "row", F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))
    return rows


def _scanner(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            leaks = rows.column("leaks").to_pylist()
            for d, items in index.value.leaks(data, bounds).items():
                leaks[d] = leaks[d] + [{"item_id": index.value.ids[i], "start_word": a, "n_words": n, "similarity": s} for i, (s, a, n) in sorted(items.items())]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(leaks, _LEAKS)], rows.schema.names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each item that each document contains."""
    return scan(docs.select("doc_id", "text"), benchmark, least).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs without a leak, all columns as they were."""
    return C.unkeyed(scan(docs, benchmark, least).filter(F.size("leaks") == 0), docs)
