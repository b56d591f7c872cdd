import base64
import gzip
import hashlib
import io
import os
import zlib

import duckdb
import pandas as pd
import pytest

from quillspark.llm import common as C, warc as W
from quillspark.llm.oracles import OP11
from quillspark.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, record_type string, n int"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == payload and p is not None]
        top = max(same, default=None)
        first = top is None or page_id == top
        out.append((page_id, len(payload), sha1(payload), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def cases():
    pages = [(i, f"http://e.org/{i}?a=1&b=%20", f"<p>{i % 7}</p>" if i % 3 else f"own {i} ä") for i in range(60)]
    pages += [(100, None, None), (101, "http://e.org/x y\r\nWARC-Type: bad", ""), (None, "u", "<p>1</p>"), (None, "u", "alone"), (None, None, "twice"), (None, None, "twice")]
    pages += [(200, "u", "again"), (200, "v", "again"), (4, "u", "again"), (300, "u", "\r\n\r\nHTTP/1.1 200\r\n\r\n\x00 \U0001f600" + "x" * 3_000_000), (301, "ü", "WARC/1.1\r\n\r\n")]
    return pages


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", 1) for p in pages], PAGES).repartition(3)


def rows(got):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)


@pytest.mark.parametrize(("few", "roll"), [(C.FEW_KEYS, W.ROLL), (0, 2000)])
def test_round_trip(spark, tmp_path, monkeypatch, few, roll):
    meet = C.meet
    monkeypatch.setattr(C, "meet", lambda rows, groups, key, spread: meet(rows, groups, key, spread, few, 8))
    pages, folder = cases(), str(tmp_path / "w")
    assert rows(W.round_trip(frame(spark, pages), folder, roll)) == brute(pages) and not os.path.exists(folder)


def test_archives_as_a_plain_reader_sees_them(spark, tmp_path):
    pages = cases()
    files = W.write_archives(frame(spark, pages), str(tmp_path), 4000)
    names = {f for f in os.listdir(tmp_path / "archives") if f.endswith(".gz")}
    assert {os.path.basename(r.path) for r in files.collect()} == names and len(names) > 3
    assert {(r.path.split("/")[-1], r.bytes) for r in W.archives_in(spark, str(tmp_path / "archives")).collect()} == {(n, os.path.getsize(tmp_path / "archives" / n)) for n in names}
    found = W.read_archives(files, keep_payload=True)
    got = {(os.path.basename(r.path), r.offset): r for r in found.collect()}
    assert sorted((r.payload or b"" for r in got.values() if r.record_type == "response"), key=len)[-1].startswith(b"\r\n\r\nHTTP/1.1 200\r\n\r\n\x00 ")
    assert W.lost_revisits(found).count() == 0 and W.lost_revisits(found.filter("coalesce(page_id, 0) <> 200")).count() == 1
    seen = 0
    for name in names:
        raw, at = (tmp_path / "archives" / name).read_bytes(), 0
        while at < len(raw):
            d = zlib.decompressobj(31)
            record = d.decompress(raw[at:])
            head, block = record.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block, end = block[: int(fields["Content-Length"])], block[int(fields["Content-Length"]) :]
            row = got[name, at]
            assert end == b"\r\n\r\n" and d.eof and row.record_type == fields["WARC-Type"] and row.record_id == fields["WARC-Record-ID"]
            if row.record_type == "response":
                http, payload = block.split(b"\r\n\r\n", 1)
                assert payload == row.payload and fields["WARC-Payload-Digest"] == f"sha1:{sha1(payload)}" and f"Content-Length: {len(payload)}".encode() in http
            if row.record_type == "revisit":
                assert block.endswith(b"\r\n\r\n") and fields["WARC-Refers-To"] == row.refers_to and row.payload is None
            at, seen = len(raw) - len(d.unused_data), seen + 1
    assert seen == len(got) == len(pages) + len(names)


def read(raw, piece=None):
    return list(W.records_of(io.BytesIO(raw), "f", keep_payload=True))


def test_other_writers_and_small_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 3)
    body = b"WARC/1.0\r\nwarc-type: resource\r\ncontent-length:  5\r\nContent-Type: text/plain\r\n\r\nab\r\nc\r\n\r\n"
    page = W.page_record(1, "http://e.org", b"<p>" * 50, False, None, "d")
    found = read(gzip.compress(body) + page + gzip.compress(body, 1))
    assert [(r["record_type"], r["payload"], r["problem"]) for r in found] == [("resource", b"ab\r\nc", None), ("response", b"<p>" * 50, None), ("resource", b"ab\r\nc", None)]
    assert [r["offset"] for r in found] == [0, len(gzip.compress(body)), len(gzip.compress(body)) + len(page)]


def test_broken_records(spark, tmp_path):
    page = W.page_record(1, "u", b"payload", False, None, "d")
    text = gzip.decompress(page)
    bad = {
        "the file ends inside a record": page[:-30],
        "not a gzip member": b"plain" + page,
        "the payload's digest differs": gzip.compress(text.replace(b"payload\r\n", b"PAYLOAD\r\n").replace(b"WARC-Block", b"X-Block")),
        "the block's digest differs": gzip.compress(text.replace(b"200 OK", b"201 OK")),
        "the record is longer than its length": gzip.compress(text + text),
        "the record is shorter than its length": gzip.compress(text[:-8]),
        "no length": gzip.compress(text.replace(b"Content-Length: 8", b"X: 8").replace(b"\r\nContent-Length", b"\r\nX-Length", 1)),
        "no WARC version": gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"),
        "no end of the headers": gzip.compress(b"WARC/1.1\r\nA: b"),
        "a header line without a colon": gzip.compress(b"WARC/1.1\r\nAb\r\n\r\n"),
        "not a number": gzip.compress(b"WARC/1.1\r\nContent-Length: 1e3\r\n\r\n"),
    }
    for want, raw in bad.items():
        found = read(page + raw)
        assert [r["page_id"] for r in found] == [1, None] and found[1]["problem"].startswith(want), (want, found[1])
    (tmp_path / "x.warc.gz").write_bytes(page + bad["no length"])
    files = W.archives_in(spark, str(tmp_path))
    assert [r.problem for r in W.read_archives(files, strict=False).collect()] == [None, "no length"]
    with pytest.raises(Exception, match="no length"):
        W.read_archives(files).collect()


def test_a_long_record_is_read_in_pieces(tmp_path):
    payload = os.urandom(1 << 20) * 24
    at = tmp_path / "long.warc.gz"
    at.write_bytes(W.page_record(5, "u", payload, False, None, "d"))

    class Watched:
        most = 0

        def __init__(self):
            self.file = open(at, "rb")

        def read(self, n):
            self.most = max(self.most, n)
            return self.file.read(n)

    watched = Watched()
    (row,) = W.records_of(watched, "f")
    assert row["payload_bytes"] == len(payload) and row["payload_digest"] == sha1(payload) and row["payload"] is None and watched.most == W.PIECE


def test_empty_table(spark, tmp_path):
    assert rows(W.round_trip(frame(spark, []), str(tmp_path / "e"))) == []
    pages = frame(spark, [(1, None, "a")]).select("page_id", "html")
    assert rows(W.round_trip(pages, str(tmp_path / "f"))) == brute([(1, None, "a")])


def test_sql_agrees_with_brute_force():
    pages, db = cases(), duckdb.connect()
    db.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert sorted(db.sql(OP11).fetchall(), key=str) == brute(pages)


def test_query_reads_whole_table(spark):
    d = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert rows(QUERIES["op11_warc"](spark, d)) == brute(pages)
