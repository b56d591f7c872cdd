import os
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import mutations as M
from quillspark.sources.snapshots import Conflict, Snapshot, Store, new_rows, rows_of
from quillspark.sources.workspace import TABLES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(a, b, but=()):
    return all(rows(getattr(a, t).drop(*but)) == rows(getattr(b, t).drop(*but)) for t in TABLES)


def spread(ws, files=6):
    """The workspace with many symptoms in several files, ordered by id."""
    many = ws.spark.range(10, 110).select("id", F.lit(1).cast("long").alias("vehicle_id"), F.concat(F.lit("s"), "id").alias("title"), F.lit("open").alias("status"))
    symptoms = ws.symptoms.unionByName(many, allowMissingColumns=True).repartitionByRange(files, "id")
    return ws.with_tables(symptoms=symptoms)


@pytest.fixture
def store(ws, tmp_path):
    store = Store(ws.spark, str(tmp_path / "store"))
    assert store.save(spread(ws)) == 1
    return store


def data_files(store, name):
    return {f for folder, _, names in os.walk(f"{store.path}/tables/{name}") for f in names if f.endswith(".parquet")}


def test_reload_equals_the_tables(ws, store):
    assert same(store.load(), spread(ws)) and store.versions() == [1]
    changed = M.delete_symptom(store.load(), 1)
    assert store.save(changed, 1) == 2
    assert same(store.load(), M.delete_symptom(spread(ws), 1)) and same(store.load(1), spread(ws))
    with pytest.raises(LookupError):
        store.load(7)
    with pytest.raises(LookupError):
        Store(ws.spark, f"{store.path}-none").load()


def test_second_writer_gets_an_error(ws, store):
    first, second = M.delete_symptom(store.load(1), 1), M.delete_symptom(store.load(1), 2)
    store.save(first, 1)
    before = {t: data_files(store, t) for t in TABLES}
    with pytest.raises(Conflict):
        store.save(second, 1)
    assert {t: data_files(store, t) for t in TABLES} == before and same(store.load(), first)
    assert not [f for f in os.listdir(f"{store.path}/versions") if f.startswith("_")]


def test_many_writers_at_once(store):
    """Of all that write the same version, one is first."""
    base, won, lost = store.snapshot(1), [], []

    def write(i):
        try:
            store._put(Snapshot(2, base.folders, {"notes": [str(i)]}))
            won.append(i)
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and store.snapshot().dropped["notes"] == [str(won[0])]


def test_a_reader_sees_one_version(store):
    """What was loaded stays as it was while later versions come and go."""
    old = store.load()
    seen = rows(old.symptoms)
    for version in (1, 2, 3):
        store.rewrite(version, lambda ws: M.update_symptom(ws, 50, {"title": f"v{version}"}), rows_of("symptom", 50))  # noqa: B023
        assert rows(old.symptoms) == seen
        assert store.load().symptoms.filter("id = 50").first().title == f"v{version}"


def test_one_row_rewrites_one_file(store):
    before = data_files(store, "symptoms")
    assert len(before) == 6
    assert store.rewrite(1, lambda ws: M.update_symptom(ws, 55, {"title": "changed", "status": "resolved"}), rows_of("symptom", 55)) == 2
    two = store.snapshot()
    new = data_files(store, "symptoms") - before
    assert len(new) == 1 and len(two.dropped["symptoms"]) == 1 and set(two.dropped["symptoms"]) < before and two.folders["notes"] == store.snapshot(1).folders["notes"]
    want = M.update_symptom(store.load(1), 55, {"title": "changed", "status": "resolved"})
    assert rows(store.load().symptoms.drop("updated_at")) == rows(want.symptoms.drop("updated_at"))
    # files that don't count any more aren't opened
    scan = store.table(two, "symptoms")
    scan.collect()
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().get("numFiles").get().value() == 6 and scan.select("_metadata.file_name").distinct().count() == 6


def test_every_change_by_file(ws, store):
    version = 1
    steps = [
        ("symptom", 1, lambda w: M.update_symptom(w, 1, {"linked_document_ids": [1, 3]})),
        ("symptom", 60, lambda w: M.delete_symptom(w, 60)),
        ("procedure", 1, lambda w: M.update_procedure(w, 1, {"steps": "new"})),
        ("procedure", 2, lambda w: M.delete_procedure(w, 2)),
        ("note", 5, lambda w: M.update_note(w, 5, {"related_entity_type": "symptom", "related_entity_id": 1})),
        ("note", 6, lambda w: M.delete_note(w, 6)),
        ("document", 2, lambda w: M.update_document(w, 2, {"title": "T", "system": "S", "document_type": "D"})),
        ("document", 2, lambda w: M.delete_document(w, 2)[0]),
    ]
    for kind, id_, change in steps:
        want = change(store.load(version))
        version = store.rewrite(version, change, rows_of(kind, id_))
        assert same(store.load(version), want, ("updated_at",)), (kind, id_)
    with pytest.raises(M.Missing):
        store.rewrite(version, lambda w: M.delete_note(w, 99), rows_of("note", 99))
    with pytest.raises(ValueError, match="no rows of it are named"):
        store.rewrite(version, lambda w: M.delete_symptom(w, 3), {"symptoms": F.col("id") == 3})
    assert store.versions()[-1] == version


def test_new_records_are_files_of_their_own(store):
    before = data_files(store, "symptoms")
    changed, id_ = M.create_symptom(store.load(), {"title": "new one", "linked_document_ids": [2]})
    assert store.append(1, changed, new_rows("symptom", id_)) == 2 and id_ == 110
    assert before < data_files(store, "symptoms") and rows(store.load().symptoms.select("id", "title").filter("id = 110")) == [(110, "new one")]
    assert (110, 2) in rows(store.load().symptom_documents) and store.load().symptoms.count() == store.load(1).symptoms.count() + 1


def test_compaction_and_expiry(store):
    for version in (1, 2):
        store.rewrite(version, lambda w: M.delete_symptom(w, 20 + version), rows_of("symptom", 20 + version))  # noqa: B023
    want = rows(store.load().symptoms)
    assert store.compact(3, "symptoms") == 4
    assert rows(store.load().symptoms) == want and store.snapshot().dropped["symptoms"] == [] and len(store.snapshot().folders["symptoms"]) == 1
    assert store.expire(1) > 0 and store.versions() == [4] and rows(store.load().symptoms) == want and len(data_files(store, "notes")) > 0
    left = {f for fs in store.snapshot().folders.values() for f in fs}
    assert {f"tables/{t}/{d}" for t in os.listdir(f"{store.path}/tables") for d in os.listdir(f"{store.path}/tables/{t}")} == left
