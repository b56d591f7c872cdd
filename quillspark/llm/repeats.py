"""Posting names of text places to hash buckets and replying to the places.

A place is (doc_id, position, check); where rows of one doc_id are to be told
apart, a row's own number gets the reply instead of the doc_id. What a chunk of documents can tell by
itself never moves: a name is posted once for each chunk, with the places that
still wait for an answer; the others are answered at once. So a passage that a
third of all documents has is one post for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "bucket int, doc_id long, names binary, docs binary, places binary, checks binary, waits binary, rows binary"
#: Set in the check of a reply that tells that no smaller document has the place's text.
MISS = np.uint32(1 << 31)
ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("names", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("checks", pa.binary()), ("waits", pa.binary()), ("rows", pa.binary())])
_REPLY = pa.schema([("doc_id", pa.int64()), ("places", pa.binary()), ("checks", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: small or ascending numbers compress well so."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(blobs: list[bytes], kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _by_document(doc_id: np.ndarray, place: np.ndarray, check: np.ndarray) -> dict[str, list]:
    order = np.lexsort((place, doc_id))
    doc_id, place, check = doc_id[order], place[order], check[order]
    head = np.flatnonzero(np.concatenate([[True], doc_id[1:] != doc_id[:-1]])) if len(doc_id) else np.zeros(0, np.int64)
    ends = [*head[1:].tolist(), len(doc_id)] if len(head) else []
    at = list(zip(head.tolist(), ends, strict=True))
    return {"doc_id": doc_id[head].tolist(), "places": [C.blob(place[a:b]) for a, b in at], "checks": [C.blob(check[a:b]) for a, b in at]}


def post(name: np.ndarray, doc_id: np.ndarray, place: np.ndarray, check: np.ndarray, n: int, several: str, row: np.ndarray | None = None) -> pa.RecordBatch:
    """several: 'documents' or 'places' (a name is answered if it has two of them), or 'smaller' or 'either' (if a smaller id has it; 'either' tells of the others too)."""
    order = np.lexsort((place, doc_id, name))
    own_rows, row = row is not None, doc_id[order] if row is None else row[order]
    name, doc_id, place, check = name[order], doc_id[order], place[order].astype(np.uint32), check[order].astype(np.uint32)
    size = len(name)
    head = np.ones(size, bool)
    head[1:] = name[1:] != name[:-1]
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    if several == "places":
        told = (np.bincount(group) > 1)[group] if size else head
        send = head
    else:
        least = doc_id == doc_id[first][group] if size else head
        if several == "documents":
            told = np.bincount(group, ~least, len(first))[group] > 0 if size else head
            send = least & (~told | head)
        else:
            told, send = ~least, least
    out: dict[str, list] = {f.name: [] for f in ARROW}
    answered = _by_document(row[told], place[told], check[told])
    k = len(answered["doc_id"])
    for f, x in (answered | {"bucket": [i % n for i in answered["doc_id"]], "names": [b""] * k, "docs": [b""] * k, "waits": [b""] * k, "rows": [b""] * k}).items():
        out[f] += x
    at = np.flatnonzero(send)
    at = at[np.lexsort((place[at], doc_id[at]))]  # so that all but the names compresses
    order, cut = C.split_by(name[at], n)
    at = at[order]
    for b in range(n):
        own = at[cut[b] : cut[b + 1]]
        if len(own):
            for f, x in zip(ARROW.names, (b, None, C.blob(name[own]), C.blob(doc_id[own]), planes(place[own]), C.blob(check[own]), C.blob(~told[own]), C.blob(row[own]) if own_rows else b""), strict=True):
                out[f].append(x)
    return C.record(ARROW, out)


def _answer(several: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        direct = rows.filter(pa.compute.is_valid(rows.column("doc_id")))
        if direct.num_rows:
            for part in direct.select(_REPLY.names).to_batches():
                yield pa.RecordBatch.from_arrays(part.columns, schema=_REPLY)
        posts = rows.filter(pa.compute.is_null(rows.column("doc_id")))
        get = lambda c, kind: np.frombuffer(b"".join(posts.column(c).to_pylist()), kind)
        name, doc_id, place, check, waits = get("names", np.uint64), get("docs", np.int64), from_planes(posts.column("places").to_pylist(), np.uint32), get("checks", np.uint32), get("waits", bool)
        if not len(name):
            return
        row = get("rows", np.int64)
        row = row if len(row) else doc_id
        # equal names differ in checks only if their hashes collide; 'places' and 'documents' need no check
        order = np.lexsort((doc_id, check, name)) if several in ("smaller", "either") else np.lexsort((doc_id, name))
        name, doc_id, place, check, waits, row = name[order], doc_id[order], place[order], check[order], waits[order], row[order]
        head = np.ones(len(name), bool)
        head[1:] = name[1:] != name[:-1]
        if several in ("smaller", "either"):
            head[1:] |= check[1:] != check[:-1]
        group, first = np.cumsum(head) - 1, np.flatnonzero(head)
        if several == "places":
            # a post that doesn't wait stands for several places
            hit = np.bincount(group, np.where(waits, 1, 2))[group] > 1
        elif several == "documents":
            hit = (np.bincount(group, doc_id != doc_id[first][group], len(first)) + np.bincount(group, ~waits, len(first)) > 0)[group]
        else:
            hit = doc_id != doc_id[first][group]
        if several == "either":
            check = np.where(hit, check, check | MISS)
            hit = waits
        else:
            hit &= waits
        yield C.record(_REPLY, _by_document(row[hit], place[hit], check[hit]))
        C.release()

    return run


def answers(posts: DataFrame, several: str, n: int = 1) -> DataFrame:
    """n: buckets of the posts. (doc_id, places, checks): arrays of blobs for each document that has an answered place."""
    replies = C.grouped(posts, n).applyInArrow(_answer(several), "doc_id long, places binary, checks binary")
    return replies.groupBy("doc_id").agg(F.collect_list("places").alias("places"), F.collect_list("checks").alias("checks"))


def places_of(blobs: list[bytes] | None, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or []), kind)
