"""Secret scan: Aho-Corasick keywords, anchored expressions near hits, embedded checksums.

One automaton finds keywords in the lower-cased bytes of a text; a second one
runs over the bytes with all lower-case hexadecimal digits folded to one sign
and finds where 16 of them stand in a row. Expressions are tried only at these
places, anchored, in the order that a scan from the left would meet them.

Kinds without a checksum (the base kinds): assign, access, hex. Kinds whose
spans must also carry a right checksum: github and npm tokens (base-62 CRC32 in
the last six characters) and age keys (Bech32).

Results by case: a null or empty text has no spans; one row for each input row,
also for null and repeated ids; other columns are ignored; an empty table gives
no rows. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "github", "npm", "age"]
BASE_KINDS = ("assign", "access", "hex")

#: Keyword, kind.
KEYWORDS = {
    b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign", b"apikey": "assign", b"api_key": "assign",
    b"akia": "access", b"ghp_": "github", b"gho_": "github", b"ghu_": "github", b"ghs_": "github", b"ghr_": "github", b"npm_": "npm", b"age-secret-key-1": "age",
}

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
AGE = re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Z0-9])")

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"

_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_HEX = bytes(1 if 48 <= b < 58 or 97 <= b < 103 else 0 for b in range(256))

SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def crc62(body: bytes) -> bytes:
    """CRC32 in base 62, six digits, as token issuers embed it."""
    n, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(reversed(out))


def bech32_valid(text: str) -> bool:
    """The checksum of a Bech32 string, as published for address formats."""
    prefix, _, data = text.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.find(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, poly in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= poly if top >> i & 1 else 0
    return state == 1 and -1 not in values


def _assign(m: re.Match) -> bool:
    return len(m[1]) >= 12


def _crc(m: re.Match) -> bool:
    return crc62(m[1]) == m[2]


#: Kind: expression, and what a match must satisfy besides.
RULES = {
    "assign": (ASSIGN, _assign),
    "access": (ACCESS, lambda m: len(m[0]) >= 18),
    "github": (GITHUB, _crc),
    "npm": (NPM, _crc),
    "age": (AGE, lambda m: bech32_valid(m[0].decode())),
}


def automaton(words):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word.decode("latin-1"), (value, len(word)))
    out.make_automaton()
    return out


def scan(text: bytes, keywords) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) of all spans, in bytes. keywords: the automaton over KEYWORDS."""
    out, ends = [], dict.fromkeys(RULES, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(text.translate(_LOWER).decode("latin-1")))
    for at, kind in hits:
        if at < ends[kind]:
            continue
        rule, right = RULES[kind]
        if m := rule.match(text, at):
            ends[kind] = m.end()
            if right(m):
                out.append((at, m.end(), KINDS.index(kind)))
    return out


def hex_runs(data: np.ndarray, bounds: np.ndarray, least: int = 16) -> list[tuple[int, int]]:
    """Maximal runs of hexadecimal digits of at least this length, in bytes of the chunk."""
    import ahocorasick

    signs = data.tobytes().translate(_HEX)
    seed = ahocorasick.Automaton()
    seed.add_word("\x01" * least, least)
    seed.make_automaton()
    out, last = [], 0
    for end, size in seed.iter(signs.decode("latin-1")):
        at = end + 1 - size
        if at < last:
            continue
        stop = signs.find(b"\x00", at)
        last = len(signs) if stop < 0 else stop
        edge = bounds[np.searchsorted(bounds, at, "right") :]
        start = at
        while start < last:  # a run may go on into the next document of the chunk
            to = min(last, int(edge[0]) if len(edge) else last)
            if to - start >= least:
                out.append((start, to))
            start, edge = to, edge[1:]
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .common import chunks

    keywords = automaton(KEYWORDS)
    for rows, data, bounds in chunks(batches):
        found: dict[int, list] = {}
        for start, end in hex_runs(data, bounds):
            doc = int(np.searchsorted(bounds, start, "right")) - 1
            found.setdefault(doc, []).append((start - int(bounds[doc]), end - int(bounds[doc]), 2))
        raw, edges, out = data.tobytes(), bounds.tolist(), []
        for i in range(rows.num_rows):
            text = raw[edges[i] : edges[i + 1]]
            spans = sorted(scan(text, keywords) + found.get(i, []), key=lambda x: (x[0], x[2]))
            at = points = 0
            listed = []
            for start, end, kind in spans:
                points += len(text[at:start].decode())
                at = start
                listed.append({"kind": KINDS[kind], "start": points, "end": points + len(text[start:end].decode())})
            out.append(listed)
        keep = [c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, _SPANS)], [n for n in rows.schema.names if n != "text"] + ["spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end) by start and kind, for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan_batches, f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the listing of spans as text."""
    as_text = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(as_text(BASE_KINDS), 256).alias("base_sha256"), as_text(KINDS).alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS if k not in BASE_KINDS])
