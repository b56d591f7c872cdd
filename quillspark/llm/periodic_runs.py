"""Periodic runs of words: a harmonic grid and prefix hashes.

A run is a stretch of words that repeats with a smallest period q, is at least
three periods and LEAST words long and can't be made longer. If the words q
apart are equal along the run, they are so for at least max(LEAST - q, 2 q)
places in a row. So a grid with half of that as its step has a point for each
period from which on a whole step's words equal those q further; over all
periods these are about n log n (period, point) pairs. All pairs of a chunk of
documents are treated together as arrays: equal first words, equal hashes of a
step, then the longest common extension to either side by binary search over
prefix hashes, for all pairs at once. What comes out is one stretch for each
period; of the same stretch with several periods the smallest is the run's.

Hashes are sums of the words' random numbers times powers modulo a prime; equal
words always have equal hashes, so an extension is never too short. It is
verified on the words; one that is too long is measured again word by word.
Words are numbered by their bytes, not by hashes.

Documents never move: each chunk's texts are worked on where they are read.

Results by case: null and empty texts have no words and no runs; a null id
leaves the words as they are; repeated ids have a row for each input row; a text
of any length is one sequence; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a run, and periods of it, at least.
LEAST, PERIODS = 24, 3

#: Pairs of period and grid point, and words of stretches, that are looked at together.
PAIRS, WORDS = 1 << 18, 1 << 21

PRIME = np.uint64((1 << 31) - 1)
_U = np.uint64


class Prefix:
    """Hashes of all stretches of a sequence of numbers below 2 ** 31, by sums of the first ones."""

    def __init__(self, values: np.ndarray, seed: int = 0x9E3779B1):
        n = len(values)
        base = C.mix(np.array([seed], _U)) % (PRIME - _U(1000)) + _U(500)
        power, step = np.ones(n + 1, _U), base
        size = 1
        while size <= n:  # powers by doubling
            to = min(size, n + 1 - size)
            power[size : size + to] = power[:to] * step % PRIME
            step, size = step * step % PRIME, 2 * size
        self.power = power
        # sums of n numbers below 2 ** 31 stay below 2 ** 64
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(C.mix(values.astype(_U) + _U(seed)) % PRIME * power[:n] % PRIME)]) % PRIME

    def equal(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of this length from at and from at + apart on seem equal."""
        one = self.sums[at + length] + PRIME - self.sums[at]
        two = self.sums[at + apart + length] + PRIME - self.sums[at + apart]
        return one % PRIME * self.power[apart] % PRIME == two % PRIME


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """By binary search the greatest length up to most for which fits(places, lengths) holds, for all places at once; it holds for 0 and for all less than a length that does."""
    out = np.zeros(len(most), np.int64)
    step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
    while step:
        now = np.flatnonzero(out + step <= most)
        if len(now):
            now = now[fits(now, out[now] + step)]
            out[now] += step
        step //= 2
    return out


def _need(period: np.ndarray) -> np.ndarray:
    """Places in a row that equal those a period further, in the shortest run."""
    return np.maximum(LEAST - period, (PERIODS - 1) * period)


def _pairs(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, grid point) of all documents and periods, in blocks."""
    n = np.diff(first)
    periods = np.where(n >= LEAST, n // PERIODS, 0)
    total = np.concatenate([[0], np.cumsum(periods)])
    done = 0
    while done < total[-1]:
        # as many (document, period) as a block of pairs holds
        flat = np.arange(done, min(done + PAIRS, total[-1]))
        doc = np.searchsorted(total, flat, "right") - 1
        period = flat - total[doc] + 1
        step = (_need(period) + 1) // 2
        points = (n[doc] - period - step) // step + 1
        points = np.maximum(points, 0)
        ends = np.cumsum(points)
        use = max(1, int(np.searchsorted(ends, PAIRS, "right")))
        doc, period, step, points = doc[:use], period[:use], step[:use], points[:use]
        k = C.ragged(np.zeros(use, np.int64), points)
        yield np.repeat(doc, points), np.repeat(period, points), np.repeat(first[doc], points) + k * np.repeat(step, points)
        done += use


def _stretches(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of all stretches that the hashes show; rows of an array, each once."""
    prefix, found = Prefix(ids), [np.zeros((0, 3), np.int64)]
    for doc, period, at in _pairs(first):
        hit = np.flatnonzero(ids[at] == ids[at + period])
        doc, period, at = doc[hit], period[hit], at[hit]
        need = _need(period)
        hit = np.flatnonzero(prefix.equal(at, period, (need + 1) // 2))
        if not len(hit):
            continue
        doc, period, at, need = doc[hit], period[hit], at[hit], need[hit]
        ahead = _longest(lambda i, x, at=at, period=period: prefix.equal(at[i], period[i], x), first[doc + 1] - period - at)
        behind = _longest(lambda i, x, at=at, period=period: prefix.equal(at[i] - x, period[i], x), at - first[doc])
        long = ahead + behind >= need
        rows = np.stack([at - behind, at + ahead + period, period], 1)[long]
        found.append(np.unique(rows, axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _true(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which stretches repeat with their period, word by word."""
    out, size = np.ones(len(rows), bool), rows[:, 1] - rows[:, 0] - rows[:, 2]
    ends, done = np.cumsum(size), 0
    while done < len(rows):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + WORDS, "right")))
        at = C.ragged(rows[done:to, 0], size[done:to])
        same = ids[at] == ids[at + np.repeat(rows[done:to, 2], size[done:to])]
        out[done:to] = np.logical_and.reduceat(same, ends[done:to] - size[done:to] - (ends[done - 1] if done else 0))
        done = to
    return out


def _measured(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches that the words have inside these ones."""
    out = []
    for start, end, period in rows.tolist():
        same = ids[start : end - period] == ids[start + period : end]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
        out += [(start + a, start + b + period, period) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= max(LEAST - period, (PERIODS - 1) * period)]
    return np.array(out, np.int64).reshape(-1, 3)


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """Of each stretch the row with its smallest period; rows in order of start, end, period."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return new


def find_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of documents whose words are ids[first[i]:first[i + 1]], by start and period; equal numbers are equal words."""
    rows = _stretches(ids, first)
    while True:
        least = _least_periods(rows)
        runs = rows[least]
        true = _true(ids, runs)
        if true.all():
            break
        # hashes of different words met: all periods of such a stretch are measured
        number = np.cumsum(least) - 1
        rows = np.unique(np.concatenate([rows[true[number]], _measured(ids, rows[~true[number]])]), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def doubled(n: int, key: int) -> np.ndarray | None:
    """The places of the words of a document of n words whose tail is made periodic, None for one that stays as it is."""
    if key % 10 or not n:
        return None
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the most repetitions; exact, the first one of equals."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("kept", pa.string())])
OUT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _documents(batches: Iterator[pa.RecordBatch], double: bool) -> Iterator[list[tuple[int | None, list[tuple[int, int, int]], bytes]]]:
    """(doc_id, runs, kept words) of each document of each chunk."""
    for rows, data, bounds in C.chunks(batches):
        start, end, first = C.word_spans(data, bounds)
        _, ids = C.distinct_spans(data, start, end)
        known = rows.column("doc_id").to_pylist()
        if double:
            for i, doc_id in enumerate(known):
                places = None if doc_id is None else doubled(int(first[i + 1] - first[i]), zlib.crc32(str(doc_id).encode()))
                if places is not None:
                    own = slice(int(first[i]), int(first[i + 1]))
                    start[own], end[own], ids[own] = (x[own][places] for x in (start, end, ids))
        runs = find_runs(ids, first)
        gone = np.zeros(len(ids) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        stays = np.cumsum(gone)[:-1] == 0
        cut, raw, out = np.searchsorted(runs[:, 0], first), data.tobytes(), []
        for i, doc_id in enumerate(known):
            a, b = int(first[i]), int(first[i + 1])
            keep = a + np.flatnonzero(stays[a:b])
            words = b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])
            out.append((doc_id, [(x - a, y - x, p) for x, y, p in runs[cut[i] : cut[i + 1]].tolist()], words))
        yield out


def _rows(double: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches, double):
            yield C.record(_OUT, {"doc_id": [d[0] for d in docs], "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in d[1]] for d in docs], "kept": [d[2].decode() for d in docs]})

    return run


def _digests(double: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches, double):
            out: dict[str, list] = {c: [] for c in _DIGEST.names}
            for doc_id, runs, words in docs:
                best = _best(runs) if runs else (None, None, None)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                row = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(words).hexdigest())
                for c, x in zip(out, row, strict=True):
                    out[c].append(x)
            yield C.record(_DIGEST, out)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def runs(docs: DataFrame, double: bool = False) -> DataFrame:
    """(doc_id, runs, kept): all runs of each text and its words without the repetitions; double: the tails of a tenth of the documents are made periodic first."""
    return _texts(docs).mapInArrow(_rows(double), OUT)


def digest(docs: DataFrame, double: bool = False) -> DataFrame:
    """The number of runs, the one with the most repetitions and hashes of all runs and of the kept words; the same work as runs(), but texts don't leave the task."""
    return _texts(docs).mapInArrow(_digests(double), DIGEST)
