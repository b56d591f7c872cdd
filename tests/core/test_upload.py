import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import mutations as M
from quillspark.sources import ingest
from quillspark.sources.pdf import pdf_pages
from quillspark.sources.snapshots import Conflict, Store
from tests.core.test_changes import pdf


@pytest.fixture
def found(spark, tmp_path):
    for folder in ("in/a", "in/b", "store"):
        (tmp_path / folder).mkdir(parents=True)
    for i in range(20):
        (tmp_path / "in" / "ab"[i % 2] / f"file {i // 2}.pdf").write_bytes(pdf(f"(text {i}) Tj".encode()) if i else b"broken")
    return ingest.files(spark, str(tmp_path / "in"))


def left(folder):
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


def test_files_and_rows_come_in_one_pass(ws, found, tmp_path):
    new = ingest.upload(ws, found, "Brakes", "Manual", str(tmp_path / "store"))
    rows = new.documents.filter("id > 4").orderBy("id").collect()
    paths = sorted((str(p) for p in (tmp_path / "in").rglob("*.pdf")))
    assert [r.id for r in rows] == list(range(5, 25)) and [r.original_filename for r in rows] == [p.rsplit("/", 1)[-1] for p in paths]
    for r, p in zip(rows, paths, strict=True):
        copy = tmp_path / "store" / r.stored_filename
        assert r.file_path == str(copy) and copy.read_bytes() == open(p, "rb").read()
    assert rows[0].extraction_status == "failed: Invalid PDF structure." and rows[0].page_count is None
    assert left(tmp_path / "store") == sorted(r.stored_filename for r in rows)
    assert rows == new.documents.filter("id > 4").orderBy("id").collect()


def test_a_failing_file_leaves_nothing_behind(ws, found, tmp_path):
    store = tmp_path / "store"
    (store / "other.txt").write_text("stays")

    def fails(data):
        if b"text 7" in data:
            os._exit(3)  # the worker dies in the middle
        return pdf_pages(data)

    with pytest.raises(Exception):  # noqa: B017
        ingest.upload(ws, found, "Brakes", "Manual", str(store), fails)
    assert left(store) == ["other.txt"]


def test_a_failing_move_leaves_nothing_behind(ws, found, tmp_path, monkeypatch):
    store, asked = tmp_path / "store", []
    plain = ingest._for_each

    def for_each(rows, act):
        asked.append(1)
        if len(asked) == 1:  # half of the files are moved, then it stops
            plain(rows.limit(10), act)
            raise OSError("no space")
        return plain(rows, act)

    monkeypatch.setattr(ingest, "_for_each", for_each)
    with pytest.raises(OSError, match="no space"):
        ingest.upload(ws, found, "Brakes", "Manual", str(store))
    assert left(store) == [] and len(asked) == 2


def test_upload_into_a_store(ws, found, tmp_path):
    store, uploads = Store(ws.spark, str(tmp_path / "versions")), str(tmp_path / "store")
    store.save(ws)
    assert ingest.upload_into(store, 1, found, "Brakes", "Manual", uploads) == 2
    assert store.load().documents.count() == 24 and store.load(1).documents.count() == 4 and len(left(uploads)) == 20
    with pytest.raises(Conflict):  # version 2 is there: neither rows nor files stay
        ingest.upload_into(store, 1, found, "Brakes", "Manual", uploads)
    assert store.load().documents.count() == 24 and len(left(uploads)) == 20
    one = store.load().documents.filter("id = 9").first()
    after, report = ingest.delete_document(store.load(), 9, uploads)
    assert report.first().file_removed and not os.path.exists(one.file_path) and after.documents.filter("id = 9").count() == 0 and len(left(uploads)) == 19
    assert ingest.delete_document(store.load(), 9, uploads)[0].documents.count() == 23  # a file that isn't there any more is no failure
    with pytest.raises(M.Missing):
        ingest.delete_document(ws, 99, uploads)
    assert tuple(ingest.delete_document(ws, 2, uploads)[1].select("symptom_links_removed", "file_removed").first()) == (2, False)


def test_no_bytes_at_the_driver(ws, found, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    collected, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(self.columns) or plain(self))
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    ingest.upload(ws, found, "Brakes", "Manual", str(tmp_path / "store"))
    assert not any({"content", "path", "stored_filename"} & set(c) for c in collected)
    assert ws.documents.select(F.max("id")).first()[0] == 4
