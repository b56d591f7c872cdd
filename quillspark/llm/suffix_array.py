"""Substring dedup by a range-partitioned suffix array over bytes.

Sorting every suffix of a large corpus is out of reach, so suffixes are taken
at anchors: the least hash of 24 bytes among the starts that fit in a string of
200. Equal strings have their anchor at the same place, so each repeat shows
between suffixes that start at anchors. Anchors whose 24 bytes stand nowhere
else are dropped; the others go, with the bytes around them, to ranges of their
leading bytes whose splitters are sampled. Each range sorts its suffixes by
multikey quicksort and takes the common prefixes of neighbours. A string with o
bytes before its anchor can only repeat if its suffix shares 200 - o bytes with
a neighbour; these meet by a hash of the whole string, and bytes decide: two
suffixes share the strings that their common bytes on both sides of the anchor
cover. Suffixes with the same 24 leading bytes always share a range, so no
repeat lies across a boundary between ranges.

Within a chunk of documents equal surroundings are sent once, so a passage that
a third of all documents has is one suffix for each chunk.

Results by case: null and empty texts are empty; matches never cross documents;
rows of null id are documents like others; rows of equal id are documents of
their own, and rows of equal id and text repeat each other; a text of any length
is one document; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

LENGTH, GRAM = 200, 24
#: Bytes of suffixes hashed and strings compared at once.
BLOCK, STRINGS = 1 << 20, 1 << 20
_U = np.uint64
SUFFIX = "range int, lead binary, around binary, before int, strings int, doc_id long, check int, place long, waits boolean, runs binary"
_SUFFIX = pa.schema([("range", pa.int32()), ("lead", pa.binary()), ("around", pa.binary()), ("before", pa.int32()), ("strings", pa.int32()), ("doc_id", pa.int64()), ("check", pa.int32()), ("place", pa.int64()), ("waits", pa.bool_()), ("runs", pa.binary())])
#: Repeated strings of a document as runs of starts: first places and lengths.
FOUND = "doc_id long, check int, places binary, runs binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("check", pa.int32()), ("places", pa.binary()), ("runs", pa.binary())])


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each string of so many bytes, a multiple of 8, from the eight bytes at every place."""
    if len(data) < length:
        return np.zeros(0, _U)
    part, size, out, done = C.words_of(data)[: len(data) - 7].copy(), 8, None, 0
    while True:
        if length & size:
            out, done = (part, size) if out is None else (C.both(out, part[done:]), done + size)
        if done == length:
            return out[: len(data) - length + 1]
        part, size = C.both(part, part[size:]), 2 * size


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of a chunk: byte place, hash, first string and number of strings that have it, document."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        self.checks = rows.column("check").to_numpy(zero_copy_only=False)
        name = string_hashes(data, GRAM)
        start = np.arange(len(name))
        least = sliding_least((name & ~_U((1 << 24) - 1)) | start.astype(_U) if len(data) < 1 << 24 else (name & ~_U((1 << 32) - 1)) | start.astype(_U), LENGTH - GRAM + 1)
        bits = _U((1 << 24) - 1) if len(data) < 1 << 24 else _U((1 << 32) - 1)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        string = np.arange(len(least))
        fits = doc[: len(least)] == doc[LENGTH - 1 :] if len(least) else np.zeros(0, bool)
        string = string[fits]
        place = (least[fits] & bits).astype(np.int64)
        head = np.ones(len(place), bool)
        head[1:] = (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)
        at = np.flatnonzero(head)
        self.place, self.first = place[at], string[at]
        self.strings = np.diff(np.append(at, len(place)))
        self.name, self.doc = name[self.place], doc[self.place]
        self.base = bounds[self.doc]


def _post_anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            a = Anchors(rows, data, bounds)
            yield R.post(a.name, a.ids[a.doc], a.place - a.base, np.zeros(len(a.name), np.uint32), n, "places")

    return run


def _runs(doc_id: np.ndarray, check: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Repeated strings as runs: starts from first to last, by document."""
    order = np.lexsort((first, check, doc_id))
    doc_id, check, first, size = doc_id[order], check[order], first[order].astype(np.int64), (last - first + 1)[order].astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | (check[1:] != check[:-1]), [True]])) if len(doc_id) else np.zeros(1, np.int64)
    at = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return C.record(_FOUND, {"doc_id": doc_id[cut[:-1]], "check": check[cut[:-1]], "places": [C.blob(first[a:b]) for a, b in at], "runs": [C.blob(size[a:b]) for a, b in at]})


def _suffixes(splits: list[bytes], ranges: int):
    """The surroundings of anchors that stand elsewhere too, by range; those that repeat within the chunk are marked as told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            a = Anchors(rows, data, bounds)
            use = np.zeros(len(a.place), bool)
            lo, hi = np.searchsorted(a.doc, np.arange(rows.num_rows)), np.searchsorted(a.doc, np.arange(rows.num_rows), "right")
            for i, blobs in enumerate(rows.column("places").to_pylist()):
                if blobs and hi[i] > lo[i]:
                    own = np.unique(R.places_of(blobs)).astype(np.int64) + bounds[i]
                    use[lo[i] : hi[i]] = np.isin(a.place[lo[i] : hi[i]], own)
            at = np.flatnonzero(use)
            end = a.first[at] + a.strings[at] + LENGTH - 1
            _, content = C.distinct_spans(data, a.first[at], end)
            before = (a.place - a.first)[at]
            order = np.lexsort((before, content))
            content, before, at, end = content[order], before[order], at[order], end[order]
            head = np.ones(len(at), bool)
            head[1:] = (content[1:] != content[:-1]) | (before[1:] != before[:-1])
            group = np.cumsum(head) - 1
            told = (np.bincount(group) > 1)[group] if len(at) else head
            raw = data.tobytes()
            out: dict[str, list] = {f: [] for f in _SUFFIX.names}
            for i in np.flatnonzero(head).tolist():
                k = int(at[i])
                p, s = int(a.place[k]), int(a.first[k])
                for f, x in zip(_SUFFIX.names, (bisect_right(splits, raw[p : p + GRAM]), raw[p : p + GRAM], raw[s : int(end[i])], p - s, int(a.strings[k]), int(a.ids[a.doc[k]]), int(a.checks[a.doc[k]]), s - int(a.base[k]), not told[i], b""), strict=True):
                    out[f].append(x)
            # what the chunk knows by itself, a row for each document: no lead, and the runs of strings that all repeat
            own = at[told]
            direct = _runs(a.ids[a.doc[own]], a.checks[a.doc[own]], a.first[own] - a.base[own], a.first[own] - a.base[own] + a.strings[own] - 1)
            for r in direct.to_pylist():
                for f, x in zip(_SUFFIX.names, (r["doc_id"] % ranges, b"", r["places"], 0, 0, r["doc_id"], r["check"], 0, False, r["runs"]), strict=True):
                    out[f].append(x)
            yield C.record(_SUFFIX, out)

    return run


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit signs (big-endian bytes): three-way partitions by one sign at a time."""
    order = np.arange(len(keys))
    stack = [(0, len(keys), 0)] if len(keys) else []
    width = keys.shape[1]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == width:
            continue
        part = order[lo:hi]
        if hi - lo <= 64:
            order[lo:hi] = part[np.lexsort(keys[part, depth:].T[::-1])]
            continue
        sign = keys[part, depth]
        pivot = np.partition(sign, len(sign) // 2)[len(sign) // 2]
        less, equal = sign < pivot, sign == pivot
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~less & ~equal]])
        a, b = lo + int(less.sum()), lo + int(less.sum() + equal.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _reach(data: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The longest common prefix, to 200 bytes, of each suffix with a neighbour in sorted order; bytes past the end count as 0, which can only lengthen it."""
    n = len(head)
    table = np.zeros((n, LENGTH), np.uint8)
    for at in range(0, n, 4096):
        part = slice(at, at + 4096)
        size = length[part]
        table[np.repeat(np.arange(at, at + len(size)), size), C.ragged(np.zeros(len(size), np.int64), size)] = data[C.ragged(head[part], size)]
    order = multikey_quicksort(table.view(">u8"))
    common = np.zeros(n + 1, np.int64)
    for at in range(0, n - 1, 4096):
        one, two = order[at : at + 4096], order[at + 1 : at + 4097]
        one = one[: len(two)]
        same = table[one] == table[two]
        common[at + 1 : at + 1 + len(two)] = np.where(same.all(1), LENGTH, same.argmin(1))
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(common[:-1], common[1:])
    return reach


def _common(data: np.ndarray, one: np.ndarray, two: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many bytes from one[i] and two[i] on, or before them if step is -1, are equal; most[i] at most."""
    out = np.zeros(len(one), np.int64)
    now = np.flatnonzero(most > 0)
    at = np.arange(32)
    while len(now):
        inside = at < (most[now] - out[now])[:, None]
        place = (out[now][:, None] + at) if step > 0 else -(out[now][:, None] + at) - 1
        limit = len(data) - 1
        differs = inside & (data[np.clip(one[now][:, None] + place, 0, limit)] != data[np.clip(two[now][:, None] + place, 0, limit)])
        same = np.where(differs.any(1), differs.argmax(1), inside.sum(1))
        out[now] += same
        now = now[(same == len(at)) & (out[now] < most[now])]
    return out


def _by_bytes(data: np.ndarray, anchor: np.ndarray, after: np.ndarray, before: np.ndarray, owner: np.ndarray, offset: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Groups of strings with equal hashes, split where bytes differ.

    A string has offset bytes before its owner's anchor. Its owner is compared once with the owner of the group's
    first string, however many strings they share.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    home = owner[first][group].astype(np.int64)
    pair, number = np.unique(owner.astype(np.int64) * len(anchor) + home, return_inverse=True)
    one, two = pair // len(anchor), pair % len(anchor)
    ahead = np.empty(len(pair), np.int64)
    back = np.empty(len(pair), np.int64)
    for at in range(0, len(pair), 1 << 14):
        a, b = one[at : at + (1 << 14)], two[at : at + (1 << 14)]
        ahead[at : at + (1 << 14)] = np.where(a == b, LENGTH, _common(data, anchor[a], anchor[b], np.minimum(np.minimum(after[a], after[b]), LENGTH), 1))
        back[at : at + (1 << 14)] = np.where(a == b, LENGTH, _common(data, anchor[a], anchor[b], np.minimum(before[a], before[b]), -1))
    wrong = (offset > back[number]) | (LENGTH - offset > ahead[number])
    if wrong.any():  # contents of one hash: by their bytes
        known: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(group, group[wrong])).tolist():
            start = int(anchor[owner[i]] - offset[i])
            group[i] = len(first) + known.setdefault((int(offset[i]), data[start : start + LENGTH].tobytes()), len(known))
    return group


def _repeats(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Strings that repeat among the suffixes of a range.

    Strings are equal only if as many bytes stand before their anchors, so they
    are compared for a slice of these counts at a time, and hashed for about a
    MB of suffixes at a time: a range of any size takes bounded room beside its bytes.
    """
    before, strings, doc_id, check, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("before", "strings", "doc_id", "check", "place"))
    waits = rows.column("waits").to_numpy(zero_copy_only=False)
    around = rows.column("around").cast(pa.large_binary()).combine_chunks()
    _, offsets, raw = around.buffers()
    bounds = np.frombuffer(offsets, np.int64)[around.offset : around.offset + len(around) + 1]
    data = np.frombuffer(raw, np.uint8)
    head, size, n = bounds[:-1], np.diff(bounds), len(around)
    reach = _reach(data, head + before, np.minimum(size - before, LENGTH))
    # a string with o bytes before the anchor needs 200 - o bytes in common after it
    low, high = np.maximum(before - strings + 1, LENGTH - reach), before
    total = int(np.maximum(0, high - low + 1).sum())
    step = max(1, LENGTH * STRINGS // max(total, 1))
    blocks = np.unique(np.concatenate([[0], np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], BLOCK)), [n]]))
    for least in range(0, LENGTH, step):
        name, owner, offset = [], [], []
        for at, to in zip(blocks[:-1].tolist(), blocks[1:].tolist(), strict=True):
            top = np.minimum(high[at:to], least + step - 1)
            count = np.maximum(0, top - np.maximum(low[at:to], least) + 1)
            who = np.repeat(np.arange(at, to), count)
            if not len(who):
                continue
            ahead = top[who - at] - C.ragged(np.zeros(to - at, np.int64), count)  # strings by rising start
            start = head[who] + before[who] - ahead - bounds[at]
            name.append(string_hashes(data[bounds[at] : bounds[to]], LENGTH)[start] ^ C.mix(ahead.astype(_U)))
            owner.append(who.astype(np.int32))
            offset.append(ahead.astype(np.int16))
        if not name:
            continue
        name, owner, offset = np.concatenate(name), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(name, kind="stable")
        ordered = name[order]
        group = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) - 1
        group = _by_bytes(data, head + before, size - before, before, owner[order], offset[order].astype(np.int64), group)
        # a suffix that doesn't wait stands for several places
        heavy = np.bincount(group, np.where(waits[owner[order]], 1, 2))
        hit = np.zeros(len(name), bool)
        hit[order] = heavy[group] > 1
        hit = np.flatnonzero(hit & waits[owner])
        if len(hit):
            who = owner[hit]
            begin = place[who] + before[who] - offset[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (who[1:] != who[:-1]) | (begin[1:] != begin[:-1] + 1)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(hit)) - 1
            yield _runs(doc_id[who[at]], check[who[at]], begin[at], begin[last])


def _compare(rows: pa.Table) -> pa.Table:
    """A range: what chunks knew by themselves goes through, suffixes are sorted and compared."""
    out = []
    leads = pa.compute.binary_length(rows.column("lead"))
    direct = rows.filter(pa.compute.equal(leads, 0))
    out += direct.select(["doc_id", "check", "around", "runs"]).rename_columns(_FOUND.names).to_batches()
    rows = rows.filter(pa.compute.greater(leads, 0))
    if rows.num_rows:
        out += _repeats(rows)
    C.release()
    return pa.Table.from_batches(out, _FOUND)


def splitters(texts: DataFrame, ranges: int) -> list[bytes]:
    """Bounds of the ranges: quantiles of 24 bytes from a hashed place of a hashed share of the texts, at most 128 for each range.

    They decide how even the ranges are, never what repeats.
    """
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    lead = F.substring(raw, (1 + F.pmod(F.xxhash64("doc_id"), size - GRAM)).cast("int"), F.lit(GRAM))
    step = max(1, texts.count() // (64 * ranges))
    few = texts.filter((F.pmod(F.xxhash64("doc_id", F.lit(step)), F.lit(step)) == 0) & (size >= LENGTH))
    few = few.select(lead.alias("lead"), F.xxhash64("doc_id", F.lit(1)).alias("by")).orderBy("by", "lead").limit(128 * ranges)
    leads = sorted(bytes(r["lead"]) for r in few.collect())
    return [leads[len(leads) * i // ranges] for i in range(1, ranges)] if leads else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in C.chunks(batches):
        gone = np.zeros(len(data) + 1, np.int64)
        places, runs = rows.column("places").to_pylist(), rows.column("runs").to_pylist()
        for i, blobs in enumerate(places):
            if blobs:
                first = bounds[i] + R.places_of(blobs, np.int64)
                to = np.minimum(first + R.places_of(runs[i]).astype(np.int64) - 1 + LENGTH, bounds[i + 1])
                np.add.at(gone, first, 1)
                np.add.at(gone, to, -1)
        gone = np.cumsum(gone)[:-1] > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        head[inner] = gone[inner]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        removed, kept = total(gone), data[~gone].tobytes()
        to = np.concatenate([[0], np.cumsum(np.diff(bounds) - removed)]).tolist()
        rest = [rows.column(c) for c in ("doc_id", "row")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(bounds)), pa.array(removed), pa.array(total(head)), pa.array([kept[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], pa.binary())], ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept) of each row of docs; `kept` has the remaining bytes, row the other columns."""
    spark, n = docs.sparkSession, C.buckets(docs.sparkSession)
    # rows of one id with different texts are documents of their own; 96 bits of the row's key tell them apart
    rows = C.keyed(docs).withColumnRenamed("doc_id", "own")
    rows = rows.select(F.xxhash64("key").alias("doc_id"), F.hash("key").alias("check"), "own", "text", "row")
    texts = rows.select("doc_id", "check", "text")
    # a hash of two rows here only lets more anchors pass
    shared = R.answers(texts.mapInArrow(_post_anchors(n), R.SCHEMA), "places").drop("checks")
    ranges = C.buckets(spark, each=16)
    bounds = splitters(texts, ranges)
    # both joins take the same columns of rows, so that one shuffle of the texts serves both
    rows = rows.select("doc_id", "check", "own", "row", "text")
    suffixes = rows.join(shared, "doc_id", "left").mapInArrow(_suffixes(bounds, ranges), SUFFIX)
    found = suffixes.groupBy("range").applyInArrow(_compare, FOUND)
    found = found.groupBy("doc_id", "check").agg(F.collect_list("places").alias("places"), F.collect_list("runs").alias("runs"))
    kind = rows.schema["row"].dataType.simpleString()
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("check", "places", "runs")).alias("found"))
    mine = F.filter("found", lambda x: x["check"] == F.col("check"))[0]
    joined = rows.join(found, "doc_id", "left").select(F.col("own").alias("doc_id"), "row", "text", mine["places"].alias("places"), mine["runs"].alias("runs"))
    return joined.mapInArrow(_cut, f"doc_id long, row {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
