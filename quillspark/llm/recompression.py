"""Substring dedup by recompression: repeats of 50 words across documents.

In each round runs of one symbol and then pairs of neighbours get a new name;
a pair is named where a hash puts its first symbol left and its second right.
A name is a hash of what it stands for, so it is the same in all documents.
A symbol spans at most a fixed number of words per round, and
whether a boundary between symbols lasts depends on few words around it. So
inside a repeat, MARGIN words from its ends, the symbols are the same wherever
it stands.

The first rounds reach symbols of four words, which say little about repeats,
and stay inside the task. From there on each round goes through Spark: its
names are posted, and documents learn which of theirs other documents have too.
Only neighbours that both survived are paired in the next round, and their
pairs are posted in turn, until names span the inner part of a repeat. The
first of these rounds names triples of symbols, and takes a quarter of them,
chosen by their hash, as the symbols of the later ones, which need no texts.

A window of 50 words can only be a repeat if all names of all rounds inside it
are shared; a window without such a name stays a candidate. Candidates are
verified. First neighbours between two chosen symbols go together, as one hash
of all their words: what a smaller doc_id has in the same way is a repeat and
is not posted again. The smallest holder of a window never finds it so. The
windows of the rest are then posted one by one, by 96-bit hashes, and those
that a smaller doc_id has are answered. So the result is that of comparing all
windows.

Results by case: null and empty texts have no words; a null doc_id is neither
smaller than others nor ever loses words; rows of equal id are not smaller than
each other; a text of any length is one sequence; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

WINDOW = 50
#: Words that a symbol spans at most after each round.
SPANS = (2, 4)
TUPLE, CHOSEN = 3, np.uint64(4)
#: Rounds that go through Spark: names of 1, 2 and 3 chosen symbols in a row, the most that fit into a window's inner part.
ROUNDS = 3
#: Symbols between which windows go together, a share of the chosen ones, and windows of such a segment at most.
CUTS, TOGETHER = np.uint64(16), 64
_U = np.uint64


def margin() -> int:
    """Words from a repeat's end within which its symbols may differ: in each round a run at the edge, and one more symbol that pairs with it."""
    return sum(2 * most - 1 for most in SPANS)


def compress(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, words) after all rounds; symbols never cross documents."""
    symbol, start, size = words.copy(), np.arange(len(words)), np.ones(len(words), np.int64)
    for k, most in enumerate(SPANS):
        n = len(symbol)
        if n < 2:
            break
        # runs of one symbol, if they span few enough words
        head = np.ones(n, bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (doc[start[1:]] != doc[start[:-1]])
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, n))
        run = (length > 1) & (length * size[at] <= most)
        if run.any():
            drop = np.zeros(n, bool)
            drop[C.ragged(at[run] + 1, length[run] - 1)] = True
            symbol[at[run]] = C.mix(C.mix(symbol[at[run]]) + length[run].astype(_U) * _U(2 * k + 3))
            size[at[run]] *= length[run]
            symbol, start, size = symbol[~drop], start[~drop], size[~drop]
        # pairs
        side = C.mix(symbol ^ _U(0xABCDEF + k)) >> _U(63) == 0
        pair = np.flatnonzero(side[:-1] & ~side[1:] & (doc[start[:-1]] == doc[start[1:]]) & (size[:-1] + size[1:] <= most))
        symbol[pair] = C.mix(symbol[pair] + C.mix(symbol[pair + 1] ^ _U(k + 17)))
        size[pair] += size[pair + 1]
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, start, size = symbol[keep], start[keep], size[keep]
    return symbol, start, size


def high_symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the chosen high-level symbols."""
    symbol, start, size = compress(words, doc)
    name = C.run_hashes(symbol, TUPLE)
    n = len(name)
    same = doc[start[:n]] == doc[start[TUPLE - 1 :]] if n else np.zeros(0, bool)
    use = np.flatnonzero(same & (name % CHOSEN == 0))
    return name[use], start[use], (start[TUPLE - 1 :][use] + size[TUPLE - 1 :][use] - start[use]) if n else start[use]


def paired(place: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, span): which names of a document pair with the next one, and the words of both and between them; no more than a window has."""
    left = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, np.int64)
    span = place[left + 1] + size[left + 1] - place[left]
    return left[span <= WINDOW], span[span <= WINDOW]


def _marks(name: np.ndarray, size: np.ndarray) -> np.ndarray:
    """25 bits of a name and the words that it spans: what the next round needs."""
    return ((name >> _U(39)).astype(np.uint32) << np.uint32(6)) | size.astype(np.uint32)


def _flat(answers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists of blobs."""
    blobs = [b"".join(x) if x else b"" for x in answers.to_pylist()]
    return np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs]), np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)


def _distinct(places: pa.Array, checks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, mark) of answers, sorted, each once."""
    (doc, place), mark = _flat(places), _flat(checks)[1].astype(np.uint32)
    order = np.lexsort((mark, place, doc))
    doc, place, mark = doc[order], place[order], mark[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (mark[1:] != mark[:-1])
    return doc[new], place[new], mark[new]


def _sums(n: int, doc: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A value for the set of (place, mark) of each of n rows."""
    out = np.zeros(n, _U)
    np.add.at(out, doc, C.mix((place.astype(_U) << _U(32)) | mark.astype(_U)))
    return out


class _Words:
    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, seeds: tuple[int, int]):
        self.data, self.seeds = data, seeds
        self.start, self.end, self.first = C.word_spans(data, bounds)
        self.doc = C.owners(self.first)
        self.hashes = C.word_hashes(data, self.start, self.end, seed=seeds[0])
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.rows = rows.column("number").to_numpy(zero_copy_only=False)
        self._windows = None

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit and 32-bit hashes, of seeds of their own, of the words of the windows from these words on."""
        if not len(at):
            return np.zeros(0, _U), np.zeros(0, np.uint32)
        if self._windows is None:
            other = C.word_hashes(self.data, self.start, self.end, seed=self.seeds[1])
            self._windows = C.run_hashes(self.hashes, WINDOW), (C.run_hashes(other, WINDOW) >> _U(32)).astype(np.uint32)
        return self._windows[0][at], self._windows[1][at]

    def segments(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of all words of as many windows, and 25 bits more with the length in the lowest 6.

        The first, the middle and the last window have every word of up to TOGETHER windows.
        """
        parts = [self.windows(at + k) for k in (0 * length, (length - 1) // 2, length - 1)]
        name, check = C.mix(length.astype(_U)), C.mix(length.astype(_U) + _U(1))
        for one, two in parts:
            name, check = C.mix(name ^ one), C.mix(check ^ two.astype(_U))
        return name, ((check >> _U(39)).astype(np.uint32) << np.uint32(6)) | (length - 1).astype(np.uint32)

    def shared(self, answers: pa.Array, at: np.ndarray) -> np.ndarray:
        """Which of the names that start at these words are among the answered places of their documents."""
        doc, place = _flat(answers)
        place = self.first[doc] + place
        found = np.zeros(len(self.hashes) + 1, bool)
        found[place[place < self.first[doc + 1]]] = True
        return found[at]

    def rounds(self, rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(name, first word, words, whether shared) of all rounds; names of the first one only."""
        name, at, size = high_symbols(self.hashes, self.doc)
        use = self.shared(rows.column("round0"), at)
        out = [(name, at, size, use)]
        # should two rows share a number, the answers aren't this text's own and only the first round counts
        doc = self.doc[at[use]] if len(at) else at
        own = _sums(rows.num_rows, *_distinct(rows.column("round0"), rows.column("marks"))) == _sums(rows.num_rows, doc, at[use] - self.first[doc], _marks(name, size)[use])
        for k in range(1, ROUNDS):
            at, size = at[use], size[use]
            at, size = (x[own[self.doc[at]]] for x in (at, size)) if len(at) else (at, size)
            left, size = paired(at, size, self.doc[at] if len(at) else at)
            at = at[left]
            use = self.shared(rows.column(f"round{k}"), at)
            out.append((name, at, size, use))
        return out


def _post_symbols(n: int, seeds: tuple[int, int]):
    """The names of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            w = _Words(rows, data, bounds, seeds)
            name, at, size = high_symbols(w.hashes, w.doc)
            long = np.diff(w.first)[w.doc[at]] >= WINDOW if len(at) else np.zeros(0, bool)
            use = np.flatnonzero(long & w.known[w.doc[at]]) if len(at) else np.zeros(0, np.int64)
            doc = w.doc[at[use]]
            yield R.post(name[use], w.ids[doc], at[use] - w.first[doc], _marks(name, size)[use], n, "documents", w.rows[doc])

    return run


def _post_pairs(n: int):
    """The names of the next round, from what the last one left shared: rows of answers, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            doc, place, mark = _distinct(batch.column("places"), batch.column("checks"))
            left, span = paired(place, (mark & np.uint32(63)).astype(np.int64), doc)
            half = mark.astype(_U)
            name = C.mix(C.mix(half[left] + ((place[left + 1] - place[left]).astype(_U) << _U(32))) ^ (half[left + 1] << _U(20)))
            yield R.post(name, ids[doc[left]], place[left], _marks(name, span), n, "documents")

    return run


def _lengths(checks: np.ndarray) -> np.ndarray:
    return (checks & np.uint32(TOGETHER - 1)).astype(np.int64) + 1


def _post_segments(n: int, edge: int, seeds: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            w = _Words(rows, data, bounds, seeds)
            levels, total = w.rounds(rows), len(w.hashes)
            symbol, at = levels[0][:2]
            # a window is out if a name inside it isn't shared
            from_, to = (np.concatenate(x) for x in zip(*[(first[~use] + size[~use] + edge - WINDOW, first[~use] - edge) for _, first, size, use in levels], strict=True))
            out = np.zeros(total + 2, np.int64)
            use = from_ <= to
            np.add.at(out, np.clip(from_[use], 0, total), 1)
            np.add.at(out, np.clip(to[use] + 1, 0, total + 1), -1)
            start = np.flatnonzero(np.cumsum(out)[:total] == 0)
            last = w.first[w.doc[start] + 1] if len(start) else start
            start = start[(start + WINDOW <= last) & w.known[w.doc[start]]] if len(start) else start
            cuts = np.append(at[symbol % CUTS == 0], total)
            after = np.minimum(cuts[np.searchsorted(cuts, start)], w.first[w.doc[start] + 1]) if len(start) else start
            head = np.ones(len(start), bool)
            head[1:] = (start[1:] != start[:-1] + 1) | (after[1:] != after[:-1]) | ((after - start)[1:] // TOGETHER != (after - start)[:-1] // TOGETHER)
            first = start[head]
            length = np.diff(np.append(np.flatnonzero(head), len(start)))
            name, check = w.segments(first, length)
            doc = w.doc[first]
            yield R.post(name, w.ids[doc], first - w.first[doc], check, n, "smaller", w.rows[doc])

    return run


def _post_windows(n: int, seeds: tuple[int, int]):
    """The windows of segments that no smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            w = _Words(rows, data, bounds, seeds)
            starts = [np.zeros(0, np.int64)]
            for i, (places, checks) in enumerate(zip(rows.column("segments").to_pylist(), rows.column("segment_checks").to_pylist(), strict=True)):
                if places and w.known[i]:
                    check = R.places_of(checks)
                    miss = check & R.MISS > 0
                    length = _lengths(check[miss])
                    start = np.unique(w.first[i] + C.ragged(R.places_of(places)[miss].astype(np.int64), length))
                    starts.append(start[start + WINDOW <= w.first[i + 1]])
            start = np.concatenate(starts)
            name, check = w.windows(start)
            doc = w.doc[start] if len(start) else start
            yield R.post(name, w.ids[doc], start - w.first[doc], check, n, "smaller", w.rows[doc])

    return run


def _cut(seeds: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            w = _Words(rows, data, bounds, seeds)
            places, checks = rows.column("places").to_pylist(), rows.column("checks").to_pylist()
            gone = np.zeros(len(w.hashes) + 1, np.int64)
            at, want = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for i, blobs in enumerate(places):
                if blobs:
                    place = w.first[i] + R.places_of(blobs).astype(np.int64)
                    fits = place + WINDOW <= w.first[i + 1]
                    at.append(place[fits])
                    want.append(R.places_of(checks[i])[fits])
            at, want = np.concatenate(at), np.concatenate(want)
            # two rows might share a number, so the checks are compared
            if len(at):
                at = at[w.windows(at)[1] == want]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
            for i, (blobs, marks) in enumerate(zip(rows.column("segments").to_pylist(), rows.column("segment_checks").to_pylist(), strict=True)):
                if blobs:
                    want = R.places_of(marks)
                    place, want = w.first[i] + R.places_of(blobs)[want < R.MISS].astype(np.int64), want[want < R.MISS]
                    length = _lengths(want)
                    fits = place + length - 1 + WINDOW <= w.first[i + 1]
                    place, length, want = place[fits], length[fits], want[fits]
                    same = w.segments(place, length)[1] == want if len(place) else fits[:0]
                    np.add.at(gone, place[same], 1)
                    np.add.at(gone, (place + length - 1 + WINDOW)[same], -1)
            gone = np.cumsum(gone)[:-1] > 0
            raw, out, removed = data.tobytes(), [], []
            for i in range(rows.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                keep = np.flatnonzero(~gone[a:b]) + a
                out.append(b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]).decode())
                removed.append(b - a - len(keep))
            rest = [rows.column(c) for c in ("key", "doc_id", "row")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["key", "doc_id", "row", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """keyed() rows of docs with n_words, n_removed and `kept`, the words that stay joined by spaces."""
    # a place takes up to 29 bytes, and there are fewer places than one for every 6 bytes of text
    rows, n, seeds = C.keyed(docs), C.buckets(docs.sparkSession, size=5 * C.text_bytes(docs)), (C.draw(), C.draw())
    # answers go to rows by number; rows of equal id and text share one
    rows = rows.withColumn("number", F.xxhash64("key"))
    texts, columns = rows.select("number", "doc_id", "text"), ["number", "key", "doc_id", "row", "text"]
    posts, found = texts.mapInArrow(_post_symbols(n, seeds), R.SCHEMA), None
    for k in range(ROUNDS):
        # small beside the texts; each round starts from the answers of the one before
        answers = C.checkpoint(R.answers(posts, "documents", n))
        part = answers.select(F.col("doc_id").alias("number"), F.col("places").alias(f"round{k}"), *([F.col("checks").alias("marks")] if k == 0 else []))
        found = part if found is None else found.join(part, "number", "left")
        posts = answers.mapInArrow(_post_pairs(n), R.SCHEMA)
    # all joins take the same columns of rows, so that one shuffle of the texts serves them
    candidates = rows.join(found, "number", "left").select(*columns, "marks", *[f"round{k}" for k in range(ROUNDS)])
    segments = R.answers(candidates.mapInArrow(_post_segments(n, margin(), seeds), R.SCHEMA), "either", n).withColumnsRenamed({"doc_id": "number", "places": "segments", "checks": "segment_checks"})
    rest = rows.join(segments, "number", "left").select(*columns, "segments", "segment_checks")
    found = R.answers(rest.mapInArrow(_post_windows(n, seeds), R.SCHEMA), "smaller", n).withColumnRenamed("doc_id", "number")
    kind = rows.schema["row"].dataType.simpleString()
    return rest.join(found, "number", "left").select(*columns, "segments", "segment_checks", "places", "checks").mapInArrow(_cut(seeds), f"key binary, doc_id long, row {kind}, n_words long, n_removed long, kept string")
