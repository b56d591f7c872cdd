"""Shared pieces of the text operators: checkpoints, Arrow chunks, words and hashes.

Words are maximal runs of bytes that are not ASCII white space (x20, x09-x0D);
UTF-8 keeps those bytes out of longer characters, so byte work is exact.
All array code handles a chunk of whole documents at once, a few MB each, so a
Python worker's memory doesn't depend on the size of Spark's batches.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that array code takes at once; one longer document is taken alone.
CHUNK = (2 << 20) - 4096

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_WORD = _U(0xA0761D6478BD642F)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names in spark.checkpoint.dir; only a session of one process (tests) may do without and gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets batches for Python of fewer rows than Spark's default, which for long texts would be tens of MB each.

    The registered queries and the pipeline call it for their session, operators don't. Any other value than the default stands.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives freed memory back: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do without
        pass


def buckets(spark: SparkSession, *, size: float = 0, each: int = 4) -> int:
    """Hash buckets of a blob shuffle of so many bytes: a multiple of the partitions that the session is set to, more if a bucket would pass 32 MB."""
    return max(each * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) >> 25)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def grouped(rows: DataFrame, n: int, column: str = "bucket", each: int = 4):
    """rows grouped by one of n buckets; if they are more than `each` for each partition that the session is set to, the tasks are more too."""
    tasks = -(-n // each)
    return (rows.repartition(tasks, column) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows).groupBy(column)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Bytes with A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32

#: Spans of more bytes are hashed one by one.
LANES = 16


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes behind the end count as 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return lanes[at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * np.maximum(8 - left, 0).astype(_U)))


def draw() -> int:
    """A seed that the driver draws for one run of an operator and its tasks carry: nobody can work out beforehand which texts will have equal hashes."""
    return secrets.randbits(64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), eight bytes at a time through mix().

    mix() can be undone, so for a seed that is known texts of equal hashes can be computed. Where that would change a
    result, the seed is one of draw(), or the bytes are compared.
    """
    size = end - start
    out = mix(size.astype(_U) + mix(np.array([seed], _U)))
    if not len(out):
        return out
    lanes = words_of(data)
    now = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(now):
            break
        left = size[now] - 8 * k
        out[now] = mix((out[now] ^ _lane(lanes, start[now] + 8 * k, left)) + _STEP)
        now = now[left > 8]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same_spans(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes from one[i] and two[i] on have the same bytes."""
    out, lanes = np.ones(len(size), bool), words_of(data)
    now = np.flatnonzero((size > 0) & (size <= 8 * LANES) & (one != two))
    for k in range(LANES):
        if not len(now):
            break
        left = size[now] - 8 * k
        out[now] = _lane(lanes, one[now] + 8 * k, left) == _lane(lanes, two[now] + 8 * k, left)
        now = now[out[now] & (left > 8)]
    for i in np.flatnonzero((size > 8 * LANES) & (one != two)).tolist():
        out[i] = np.array_equal(data[one[i] : one[i] + size[i]], data[two[i] : two[i] + size[i]])
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): a span for each distinct content and the number of each span's content, by its bytes."""
    hashes = byte_hashes(data, start, end)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    home = first[number]
    if ((size != size[home]) | ~same_spans(data, start, start[home], size)).any():  # two contents of one hash
        raw, known = data.tobytes(), {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        _, first = np.unique(number, return_index=True)
    return first, number


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, for each start, from hashes of halves; empty if there are fewer."""
    if len(values) < n:
        return np.zeros(0, _U)
    part, size, out, done = values, 1, None, 0
    while True:
        if n & size:
            out, done = (part, size) if out is None else (both(out, part[done:]), done + size)
        if done == n:
            return mix(out + _U(n))
        part, size = both(part, part[size:]), 2 * size


def both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    m = min(len(left), len(right))
    return mix((left[:m] * _WORD) ^ (right[:m] + _STEP))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds): document i of rows is bytes[bounds[i]:bounds[i + 1]]; a null is empty."""
    for batch in batches:
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
        if not len(text):
            continue
        _, offsets, data = text.buffers()
        bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            to = min(to, len(text))
            yield batch.slice(at, to - at), raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to
    release()


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words; document i has words first[i] to first[i + 1]."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    word = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    start = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    inner = bounds[1:][bounds[1:] > 0] - 1
    after[inner] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    return byte_hashes(FOLDED[data] if fold else data, start, end, seed)


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of each word, from word_spans' first."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each n-word shingle; a document of 1 to n - 1 words has its whole sequence as one."""
    doc = owners(first)
    runs = run_hashes(words, n)
    inside = doc[: len(runs)] == doc[n - 1 :] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    whole = np.array([run_hashes(words[first[i] : first[i + 1]], int(first[i + 1] - first[i]))[0] ^ _U(first[i + 1] - first[i]) for i in short], _U)
    return np.concatenate([runs[inside], whole]), np.concatenate([doc[: len(runs)][inside], short])


def split_by(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds) that sort 64-bit hashes into n buckets, stable within a bucket."""
    bucket = ((keys >> _U(32)) * _U(n) >> _U(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], ..., start[i] + length[i] - 1 of all i, one after another."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return shift + np.arange(total)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def crc32_text(column: str) -> "Column":
    """crc32 of an id written as decimal text, as the folds of the labelled tables use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def trimmed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans without ASCII punctuation at the words' ends; words of nothing else are left out."""
    start, end, _ = word_spans(data, bounds)
    if len(start):
        plain = np.flatnonzero(~_MARK[data])
        if not len(plain):
            start, end = start[:0], end[:0]
        else:
            start = plain[np.minimum(np.searchsorted(plain, start), len(plain) - 1)]
            end = plain[np.maximum(np.searchsorted(plain, end) - 1, 0)] + 1
            # a word of marks only finds its start behind its end
            keep = start < end
            start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, bounds)


class Bloom:
    """A Bloom filter over 64-bit hashes in slices by their highest bits; every slice has a power of two of bits."""

    def __init__(self, slices: int, rows: list):
        self.shift = _U(64 - slices.bit_length() + 1) if slices > 1 else _U(0)
        self.several = slices > 1
        size = max([len(r.bits) for r in rows], default=8)
        self.bits = np.zeros((slices, size), np.uint8)
        for r in rows:
            self.bits[r.slice] = np.frombuffer(r.bits, np.uint8)
        self.mask = _U(8 * size - 1)

    def test(self, keys: np.ndarray) -> np.ndarray:
        part = (keys >> self.shift).astype(np.int64) if self.several else np.zeros(len(keys), np.int64)
        out = np.ones(len(keys), bool)
        for place in _places(keys, self.mask):
            out &= (self.bits[part, (place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _places(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    one, two = mix(keys), mix(~keys) | _U(1)
    return [(one + _U(i) * two) & mask for i in range(3)]


#: Bits of one slice of a filter, and of a filter at most; beyond that it lets more keys pass.
SLICE_BITS, FILTER_BITS = 20, 28


def filter_of(keys: DataFrame, column: str):
    """A broadcast Bloom filter of a column of hashes (longs); what reaches the driver is as large as the filter, 32 MB at most."""
    count = keys.count()
    bits = max(13, min(FILTER_BITS, int(np.ceil(np.log2(max(1, count) * 12)))))
    spread = max(0, bits - SLICE_BITS)
    part = F.shiftrightunsigned(F.col(column), 64 - spread).cast("int") if spread else F.lit(0)
    size = 1 << min(bits, SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, bool)
        slice_ = None
        for batch in batches:
            slice_ = batch.column(0)[0].as_py()
            for place in _places(batch.column(1).to_numpy().view(_U), _U(size - 1)):
                out[place.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    rows = keys.select(part.alias("slice"), F.col(column).alias("key")).groupBy("slice").applyInArrow(run, "slice int, bits binary").collect() if count else []
    return keys.sparkSession.sparkContext.broadcast(Bloom(1 << spread, rows))


def row_key(doc_id: Column, text: Column) -> Column:
    """32 bytes that are equal for equal (doc_id, text) only."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("n")), F.coalesce(F.concat(F.lit(":"), text), F.lit("n"))), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (key, doc_id, text, row): row holds the other columns, so their names can't clash; key is row_key()."""
    rest = [docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns) if c != "text"] or [F.lit(0).alias("_none")]
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(row_key(doc_id, F.col("text")).alias("key"), doc_id.alias("doc_id"), F.col("text"), F.struct(*rest).alias("row"))


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, from rows with `row` of keyed() and `text`."""
    rest = iter(range(len(docs.columns)))
    columns = []
    for c in docs.columns:
        i = next(rest)
        columns.append(F.col("text").alias(c) if c == "text" else F.col(f"row._{i}").alias(c))
    return rows.select(*columns)


#: Keys whose groups are broadcast at most: all of them if there are so few, else the hottest.
FEW_KEYS, HOT_KEYS = 100_000, 10_000


def meet(rows: DataFrame, groups: DataFrame, key: str, spread: str, few: int = FEW_KEYS, hot: int = HOT_KEYS) -> DataFrame:
    """rows with the columns of groups, null where a row's key has no group.

    groups: key (binary), n (its number of rows) and other columns, one row for each key, kept by the caller (it is read
    more than once). So many keys at most are broadcast; of more, the ones with over
    1 / hot of all rows, which can be hot keys at most, are, and the rest is shuffled by key.
    spread: a column that differs between rows of one key.
    """
    keys, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if keys <= few:
        return rows.join(F.broadcast(groups.drop("n")), key, "left")
    names, limit = [c for c in groups.columns if c not in (key, "n")], max(1, total // hot)
    top = groups.filter(F.col("n") > limit).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in names])
    dealt = F.when(F.col("_hot"), F.concat(F.col(key), F.coalesce(F.col(spread).cast("string"), F.lit("n")).cast("binary"))).otherwise(F.col(key))
    rest = groups.filter(F.col("n") <= limit).select(F.col(key).alias("_key"), *names)
    out = rows.join(F.broadcast(top), key, "left").withColumn("_key", dealt).join(rest, "_key", "left")
    return out.select(*rows.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in names])
