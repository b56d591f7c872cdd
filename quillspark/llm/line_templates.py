"""Line dedup by log templates: a tree of fixed depth over token counts and leading tokens.

A line's tokens that hold a digit become a wildcard. Lines with the same number
of tokens and the same DEPTH leading tokens (all of a shorter line's) share a
leaf. In leaves that lines of enough documents reach, a token stays in the
template if it stands at its position in lines of enough documents; other
positions generalise to wildcards. A template with at least half of its tokens
kept recurs if enough documents have it. A line with too few tokens without a
digit for that keeps all of its tokens, digits included, and is a leaf and a
template of its own. The lines of a recurring template are dropped from all
documents but the first (smallest id) that has them, so a passage isn't lost
from the corpus.

Each pass over the texts sends only lines that a Bloom filter of the previous
pass's result lets through; joins then decide exactly, by two hashes of tokens
that are hashed with a seed of the run. Lines are
counted within a chunk of documents before they move, so a line that a third of
all documents has is a row for each chunk.

Results by case: lines without tokens are kept; null and empty texts have no
lines; rows with equal id and text lose the same lines; a null id counts as a
document and is never the first; a line and a text of any length are taken
whole; other columns stay, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH, LEAST = 3, 1
WILD = np.uint64(0x5CA1AB1E)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """All lines of a chunk with enough tokens: document, leaf, hash of the masked line, byte span."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kept_share: float = 0.5, seed: int = 0):
        start, end, _ = C.word_spans(data, bounds)
        feeds = np.flatnonzero(data == 10)
        head = np.union1d(bounds[:-1], feeds + 1)
        head = head[head < len(data)]
        tail = np.append(head[1:], len(data))
        fed = np.zeros(len(data) + 1, bool)
        fed[feeds + 1] = True
        tail = tail - fed[tail]
        first, last = np.searchsorted(start, head), np.searchsorted(start, tail)
        use = last - first >= LEAST
        self.head, self.tail, self.first = head[use], tail[use], first[use]
        self.count = (last - first)[use]
        self.doc = np.searchsorted(bounds, self.head, "right") - 1
        tokens = C.word_hashes(data, start, end, seed=seed)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        wild = digits[end] > digits[start]
        masked = np.concatenate([[0], np.cumsum(wild)])
        alone = self.count - (masked[self.first + self.count] - masked[self.first]) < kept_share * self.count
        wild[C.ragged(self.first[alone], self.count[alone])] = False
        self.tokens = np.where(wild, WILD, tokens)
        # leaf and line are hashes of their own: together they name a line in 128 bits
        leaf = C.mix(self.count.astype(np.uint64))
        for i in range(DEPTH):
            longer = np.flatnonzero(self.count > i)
            leaf[longer] = C.mix(leaf[longer] * np.uint64(31) + self.tokens[self.first[longer] + i])
        self.line = C.byte_hashes(self.tokens.view(np.uint8), 8 * self.first, 8 * (self.first + self.count))
        self.leaf = np.where(alone, C.mix(~self.line), leaf)

    def once(self, keys: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Positions that keep each (key, document) once."""
        at = np.arange(len(keys)) if at is None else at
        _, kept = np.unique(C.mix(keys[at]) ^ self.doc[at].astype(np.uint64), return_index=True)
        return at[np.sort(kept)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count_leaves(kept_share: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in C.chunks(batches):
            lines = Lines(data, bounds, kept_share, seed)
            leaf, count = np.unique(lines.leaf[lines.once(lines.leaf)], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(leaf), pa.array(count.astype(np.int64))], ["leaf", "docs"])

    return run


def _lines_in(bloom, kept_share: float, seed: int):
    """Distinct masked lines of a chunk in leaves that pass: tokens, documents, smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            lines = Lines(data, bounds, kept_share, seed)
            at = lines.once(lines.line, np.flatnonzero(bloom.value.test(lines.leaf)))
            ids = rows.column("doc_id").cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)[lines.doc[at]]
            known = known[lines.doc[at]]
            order = np.lexsort((doc_id, ~known, lines.line[at]))
            at, doc_id, known = at[order], doc_id[order], known[order]
            line, head, count = np.unique(lines.line[at], return_index=True, return_counts=True)
            tokens = lines.tokens[C.ragged(lines.first[at[head]], lines.count[at[head]])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lines.count[at[head]])]), pa.int32()), _signed(tokens))
            yield pa.RecordBatch.from_arrays([_signed(lines.leaf[at[head]]), _signed(line), lists, pa.array(count.astype(np.int64)), pa.array(doc_id[head], mask=~known[head])], ["leaf", "line", "tokens", "docs", "first"])

    return run


def recurring_lines(docs: DataFrame, least_docs: int = 5, kept_share: float = 0.5, seed: int = 0) -> DataFrame:
    """(leaf, line, first): masked lines whose template recurs, and the smallest id of its documents. Both passes read all of docs (doc_id, text). seed: of all hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    leaves = rows.select("text").mapInArrow(_count_leaves(kept_share, seed), "leaf long, docs long").groupBy("leaf").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs).select("leaf")
    leaves = C.checkpoint(leaves)
    lines = rows.mapInArrow(_lines_in(C.filter_of(leaves, "leaf"), kept_share, seed), "leaf long, line long, tokens array<long>, docs long, first long")
    lines = lines.groupBy("leaf", "line").agg(F.any_value("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.min("first").alias("first"))
    lines = C.checkpoint(lines.join(leaves, "leaf", "left_semi"))
    places = lines.select("leaf", "line", "docs", F.posexplode("tokens").alias("pos", "token"))
    common = places.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs)
    fixed = places.filter(F.col("token") != F.lit(int(WILD))).join(common.select("leaf", "pos", "token"), ["leaf", "pos", "token"], "left_semi")
    fixed = fixed.groupBy("leaf", "line").agg(F.count("*").alias("kept"), F.bit_xor(F.xxhash64("pos", "token")).alias("template"), F.bit_xor(F.xxhash64("token", "pos")).alias("other"))
    named = lines.join(fixed, ["leaf", "line"]).filter(F.col("kept") >= kept_share * F.size("tokens")).select("leaf", "line", F.struct("template", "other").alias("template"), "docs", "first")
    templates = named.groupBy("leaf", "template").agg(F.sum("docs").alias("n"), F.min("first").alias("home")).filter(F.col("n") >= least_docs)
    return named.join(templates, ["leaf", "template"]).select("leaf", "line", F.col("home").alias("first"))


PLACES = "leaf long, line long, at array<struct<key:binary,doc_id:long,place:int>>"


def _spans_of(bloom, kept_share: float, seed: int):
    """Lines that pass, each once for the chunk: name, and its places: key of the row, id, place among the lines with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            lines = Lines(data, bounds, kept_share, seed)
            at = np.flatnonzero(bloom.value.test(lines.line))
            at = at[np.lexsort((lines.leaf[at], lines.line[at]))]
            leaf, line = lines.leaf[at], lines.line[at]
            head = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (line[1:] != line[:-1])])) if len(at) else at
            place = at - np.searchsorted(lines.doc, lines.doc[at])
            own = pa.array(lines.doc[at])
            entry = pa.StructArray.from_arrays([rows.column("key").take(own), rows.column("doc_id").take(own), pa.array(place.astype(np.int32))], ["key", "doc_id", "place"])
            yield pa.RecordBatch.from_arrays([_signed(leaf[head]), _signed(line[head]), pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), entry)], ["leaf", "line", "at"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in C.chunks(batches):
        lines, out = Lines(data, bounds), rows.column("text").to_pylist()
        gone = rows.column("places").to_pylist()
        dropped = np.zeros(rows.num_rows, np.int64)
        for i, places in enumerate(gone):
            if places:
                base, raw, keep, at = int(bounds[i]), data[bounds[i] : bounds[i + 1]].tobytes(), [], 0
                own = np.searchsorted(lines.doc, i) + np.unique(places)
                for a, b in zip((lines.head[own] - base).tolist(), (lines.tail[own] - base).tolist(), strict=True):
                    keep.append(raw[at:a])
                    at = min(b + 1, len(raw))  # with its line feed
                keep.append(raw[at:])
                out[i], dropped[i] = b"".join(keep).decode(), len(own)
        keep_columns = [c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n not in ("text", "places")]
        yield pa.RecordBatch.from_arrays([*keep_columns, pa.array(out, pa.string()), pa.array(dropped)], [n for n in rows.schema.names if n not in ("text", "places")] + ["text", "n_dropped"])


def drop_lines(docs: DataFrame, least_docs: int = 5, kept_share: float = 0.5) -> DataFrame:
    """keyed() rows of docs, text without the lines of recurring templates, and n_dropped."""
    rows, seed = C.keyed(docs), C.draw()
    lines = C.checkpoint(recurring_lines(rows, least_docs, kept_share, seed))
    # a line that very many documents have is a row for each chunk until it has met its template
    places = rows.select("key", "doc_id", "text").mapInArrow(_spans_of(C.filter_of(lines, "line"), kept_share, seed), PLACES)
    gone = places.join(lines, ["leaf", "line"]).select("first", F.explode("at").alias("at")).select("first", "at.*")
    gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("key").agg(F.collect_set("place").alias("places"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(gone, "key", "left").select("key", "doc_id", "row", "text", "places").mapInArrow(_drop, f"key binary, doc_id long, row {kind}, text string, n_dropped long")


def clean(docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """docs with these lines dropped, all columns as they were but n_chars, which is counted again; a document that loses every word is dropped."""
    rows = drop_lines(docs, least_docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = C.unkeyed(rows, docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out
