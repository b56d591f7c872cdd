"""BPE encoding and decoding through a table of distinct words.

Spark tasks split texts into the pre-tokens ("words") of a byte-level BPE
vocabulary and turn each block of documents into its distinct words and the
word number at each position. The distinct words of all blocks meet by hash
bucket, are encoded once, and their ids go back to the blocks by word number,
which joins them to their positions. A word has one row for each block at
most, so a word as common as a space is no hot key. Decoding joins each id with
the id-to-piece table: the table is as large as the vocabulary, so it is
broadcast, and the join with a block's ids is a lookup by id in its array
(decode() is the same join for a column of ids, in DataFrame functions).

Results by case: a null or empty text has no ids and decodes to ''; a null or
repeated doc_id is carried through, one result row for each input row; other
columns are ignored, whatever their names; an empty table gives no rows; a text
longer than a block is a block of its own. Words are told apart by their bytes.
The literal of a special token in a text is that token, as the library has it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from . import common as C

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
SCHEMA = "bucket int, kind int, block long, a binary, b binary, c binary"
RESULT = "doc_id long, n_tokens long, ids binary, decoded string"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ARROW_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def character_classes(tokenizer) -> np.ndarray:
    """The class of each code point as the tokenizer's own splitter sees it."""
    out = np.zeros(0x110000, np.uint8)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    points = [p for p in range(0x34000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 1 << 14):
        part = points[at : at + (1 << 14)]
        found = np.full(len(part), BLANK, np.uint8)
        for lead, kind in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
            whole = {start // 3 for _, (start, end) in split("".join(f"{lead}{chr(p)}\n" for p in part)) if end - start == 2 and start % 3 == 0}
            found[list(whole)] = kind
        out[part] = found
    return out


def word_starts(text: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Boolean array of the code points at which a pre-token starts; no pre-token crosses one of starts.

    Runs of letters, numbers or other characters are words and take one space
    before them; of a run of blanks the last one stands alone before other
    characters unless it is that space; after an apostrophe that begins a word
    s, t, m, d, re, ve and ll are cut off from the letters.
    """
    n = len(text)
    kind = classes[text]
    head = np.zeros(n + 1, bool)
    head[starts] = True
    head[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= head
    at = change[:n].copy()
    # the last blank of a run that something follows in the same text
    last = np.flatnonzero((kind == BLANK) & change[1:] & ~head[1:])
    at[last] = True
    spaces = last[text[last] == 32]
    at[spaces + 1] = False
    # contractions
    mark = np.flatnonzero(at & (text == 39) & change[1:] & ~head[1:])
    mark = mark[kind[mark + 1] == LETTER]
    ends = np.flatnonzero(change)
    run = ends[np.searchsorted(ends, mark + 1, "right")] - mark - 1 if len(mark) else mark
    one, two = text[mark + 1], text[np.minimum(mark + 2, n - 1)]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    long = (run >= 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    cut = short | long
    mark, run, size = mark[cut], run[cut], np.where(short[cut], 1, 2)
    at[mark + 1] = False
    rest = run > size
    at[(mark + 1 + size)[rest]] = True
    return at


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _squeeze_numbers(x: np.ndarray) -> bytes:
    """Little-endian bytes plane by plane: high bytes of small numbers cost next to nothing."""
    return _squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _open_numbers(x: bytes) -> np.ndarray:
    planes = np.frombuffer(_open(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x, max_output_size=1 << 31) if x else b""


class _Block:
    """The documents of one block: their words are numbered by falling count."""

    def __init__(self, classes: np.ndarray, special: list[str]):
        self.classes, self.special = classes, special
        self.number: dict[bytes, int] = {}
        self.docs: list[tuple[bytes, bytes, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, data: np.ndarray, bounds: np.ndarray) -> None:
        raw = data.tobytes()
        text = raw.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # byte offsets of documents to code points
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[bounds]
        cuts = []
        for token in self.special:
            found = text.find(token)
            while found >= 0:
                cuts += [found, found + len(token)]
                found = text.find(token, found + len(token))
        inner = np.array([x for x in cuts if x < len(points)], np.int64)
        heads = np.concatenate([at[:-1][at[:-1] < len(points)], inner])
        starts = word_starts(points, self.classes, heads) if len(points) else np.zeros(0, bool)
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            if np.searchsorted(at, a, "right") == np.searchsorted(at, b - 1, "right"):
                starts[a + 1 : b] = False
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(points))
        byte_at = np.append(np.flatnonzero(lead[1:] > lead[:-1]), len(data))
        from_, to = byte_at[start], byte_at[end]
        first, inverse = C.distinct_spans(data, from_, to)
        slot = np.array([self.number.setdefault(raw[a:b], len(self.number)) for a, b in zip(from_[first].tolist(), to[first].tolist(), strict=True)], np.int64)
        counts = np.diff(np.searchsorted(start, at))
        valid = np.array([x is not None for x in ids], np.uint8)
        head = np.array([x if x is not None else 0 for x in ids], np.int64)
        self.docs.append((C.blob(head) + C.blob(valid), C.blob(counts.astype(np.uint32)), slot[inverse].astype(np.uint32)))
        self.size += len(data)

    def rows(self, block: int, n: int) -> Iterator[pa.RecordBatch]:
        words = list(self.number)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        hashes = C.byte_hashes(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends)
        uses = np.zeros(len(words), np.int64)
        for _, _, slots in self.docs:
            uses += np.bincount(slots, minlength=len(uses))
        ranked = np.argsort(-uses, kind="stable")
        number = np.empty(len(uses), np.uint32)
        number[ranked] = np.arange(len(uses), dtype=np.uint32)
        order, bounds = C.split_by(hashes, n)
        out: dict[str, list] = {name: [] for name in _ARROW.names}
        for i, (a, b, c) in enumerate(self.docs):
            for name, x in zip(_ARROW.names, ((block + i) % n, 0, block, a, b, _squeeze_numbers(number[c])), strict=True):
                out[name].append(x)
        for bucket in range(n):
            part = order[bounds[bucket] : bounds[bucket + 1]]
            if len(part):
                part = part[np.argsort(number[part])]
                for name, x in zip(_ARROW.names, (bucket, 1, block, _squeeze_numbers(number[part]), _squeeze(C.blob(lengths[part].astype(np.uint32))), _squeeze(b"".join([words[i] for i in part.tolist()]))), strict=True):
                    out[name].append(x)
        yield C.record(_ARROW, out)


def _split(classes, special: list[str], block_bytes: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        block = _Block(classes.value, special)
        for rows, data, bounds in C.chunks(batches, limit=C.CHUNK // 2):
            if block.size and block.size + len(data) > block_bytes:
                yield from block.rows(number, n)
                number, block = number + 1, _Block(classes.value, special)
            block.add(rows.column(0).to_pylist(), data, bounds)
        if block.docs:
            yield from block.rows(number, n)

    return run


_loaded: dict[str, object] = {}


def _tokenizer(model: str):
    """The library's tokenizer, loaded once by each worker; it runs in the task's own thread."""
    if model not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[model] = Tokenizer.from_str(model)
    return _loaded[model]


def _encode(model):
    """In a bucket: each distinct word is encoded once; its ids go to the blocks that have the word."""

    def run(table: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(model.value)
        number: dict[bytes, int] = {}
        ids: list[list[int]] = []
        length, first, flat = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        held, rows = [], table.to_pylist()
        for r in rows:
            if r["kind"] == 1:
                ends = np.cumsum(np.frombuffer(_open(r["b"]), np.uint32).astype(np.int64))
                raw = _open(r["c"])
                held.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)], np.int64))
        distinct = list(number)
        for at in range(0, len(distinct), 4096):
            ids += [e.ids for e in tokenizer.encode_batch([w.decode() for w in distinct[at : at + 4096]], add_special_tokens=False)]
        if ids:
            length = np.array([len(x) for x in ids], np.int64)
            flat = np.array([x for part in ids for x in part], np.uint32)
            first = np.concatenate([[0], np.cumsum(length)])
        out: dict[str, list] = {name: [] for name in _ARROW.names}
        for r in rows:
            a, b, c = r["a"], r["b"], r["c"]
            if r["kind"] == 1:
                own = held.pop(0)
                b = _squeeze_numbers(length[own])
                c = _squeeze_numbers(flat[C.ragged(first[own], length[own])])
            for name, x in zip(_ARROW.names, (r["bucket"], r["kind"], r["block"], a, b, c), strict=True):
                out[name].append(x)
        del rows, held, number, distinct, ids
        C.release()
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _ARROW}, schema=_ARROW)

    return run


def _place(pieces):
    """In a block: ids are put in place by position, and pieces by joining the ids with the id-to-piece table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_bytes, piece_at = pieces.value
        rows = [r for b in batches for r in b.select(["kind", "a", "b", "c"]).to_pylist()]
        words = [r for r in rows if r["kind"] == 1]
        slots = [_open_numbers(r["a"]) for r in words]
        total = sum(map(len, slots))
        length, id_at = np.zeros(total, np.int64), np.zeros(total, np.int64)
        ids, to = [np.zeros(0, np.uint32)], 0
        for r, slot in zip(words, slots, strict=True):
            widths = _open_numbers(r["b"]).astype(np.int64)
            length[slot] = widths
            id_at[slot] = to + np.cumsum(widths) - widths
            ids.append(_open_numbers(r["c"]))
            to += len(ids[-1])
        flat = np.concatenate(ids)
        for r in rows:
            if r["kind"]:
                continue
            out: dict[str, list] = {name: [] for name in _ARROW_RESULT.names}
            counts = np.frombuffer(r["b"], np.uint32).astype(np.int64)
            doc = np.frombuffer(r["a"], np.int64, len(counts)).tolist()
            valid = r["a"][8 * len(counts) :]
            slot = _open_numbers(r["c"])
            token = flat[C.ragged(id_at[slot], length[slot])].astype("<u4")
            size = piece_at[token + 1] - piece_at[token]
            text = piece_bytes[C.ragged(piece_at[token], size)].tobytes()
            id_to = np.concatenate([[0], np.cumsum(length[slot])])[np.concatenate([[0], np.cumsum(counts)])]
            text_to = np.concatenate([[0], np.cumsum(size)])[id_to].tolist()
            id_to = id_to.tolist()
            for i in range(len(counts)):
                out["doc_id"].append(doc[i] if valid[i] else None)
                out["n_tokens"].append(id_to[i + 1] - id_to[i])
                out["ids"].append(token[id_to[i] : id_to[i + 1]].tobytes())
                out["decoded"].append(text[text_to[i] : text_to[i + 1]].decode("utf-8", "replace"))
            yield C.record(_ARROW_RESULT, out)
        C.release()

    return run


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(model: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of all pieces of a byte-level vocabulary file: as many rows as it has ids."""
    spec, of = json.loads(model), byte_of_character()
    pieces = {i: bytes(of[ch] for ch in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return sorted(pieces.items())


def tokenize(docs: DataFrame, vocabulary: str, block_bytes: int = 32 << 20) -> DataFrame:
    """Ids (little-endian unsigned 32-bit, as bytes) and the text decoded from them, for each row of docs (doc_id, text).

    vocabulary: path of a byte-level BPE file of the tokenizers library, read on the driver.
    block_bytes: text of one block, whose words and ids one task holds.
    """
    from tokenizers import Tokenizer

    spark, model = docs.sparkSession, open(vocabulary, encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    table = piece_table(model)
    size = table[-1][0] + 1
    lengths = np.zeros(size, np.int64)
    for i, piece in table:
        lengths[i] = len(piece)
    joined = np.frombuffer(b"".join(piece for _, piece in table), np.uint8)
    # both are as large as the vocabulary, whatever the input
    pieces = spark.sparkContext.broadcast((joined, np.concatenate([[0], np.cumsum(lengths)])))
    classes = spark.sparkContext.broadcast(character_classes(tokenizer))
    shared = spark.sparkContext.broadcast(tokenizer.to_str())
    special = [x["content"] for x in json.loads(model)["added_tokens"]]
    total = C.text_bytes(docs)
    n = C.buckets(spark, size=total)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_split(classes, special, block_bytes, n), SCHEMA)
    encoded = C.grouped(split, n).applyInArrow(_encode(shared), SCHEMA)
    return C.grouped(encoded, total // block_bytes, "block").applyInArrow(_place(pieces), RESULT)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` to rows of (doc_id, array of ids) by an id-to-piece join; the piece table is as large as the vocabulary.

    Ids unknown to the vocabulary add nothing. A null or empty array decodes to ''.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("piece", T.BinaryType())])
    pieces = F.broadcast(spark.createDataFrame([(i, bytearray(p)) for i, p in piece_table(open(vocabulary, encoding="utf-8").read())], schema))
    base = rows.withColumn("_row", F.monotonically_increasing_id())
    exploded = base.select("_row", F.posexplode(ids).alias("_pos", "id")).join(pieces, "id")
    joined = exploded.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", F.hex("piece").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8")
    return base.join(joined.select("_row", text.alias("decoded")), "_row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("_row")
