import json

import pytest

from quillspark.sources.snapshots import Store
from quillspark.streaming import changes as S


def change(change_id, hour, id_, title, gone=False):
    return {"change_id": change_id, "at": f"2026-02-01T{hour:02}:00:00Z", "gone": gone, "id": id_, "vehicle_id": 1, "title": title}


@pytest.fixture
def stream(ws, tmp_path):
    store = Store(ws.spark, str(tmp_path / "store"))
    store.save(ws)
    (tmp_path / "in").mkdir()

    def send(name, *rows):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        source = ws.spark.readStream.schema(S.change_schema("notes")).json(str(tmp_path / "in"))
        S.follow(source, store, "notes", "s", str(tmp_path / "state"), "2 hours").awaitTermination()
        return {r.id: r.title for r in store.load().notes.collect()}

    return store, send


def test_changes_become_versions(ws, stream):
    store, send = stream
    before = {r.id: r.title for r in ws.notes.collect()}
    got = send("1", change("a", 9, 1, "first"), change("b", 10, 1, "second"), change("c", 10, 2, "x", gone=True), change("d", 10, 70, "new"))
    assert got == {**{k: v for k, v in before.items() if k != 2}, 1: "second", 70: "new"}
    # a repeated change and one that is too late do nothing, the others come in
    assert send("2", change("b", 10, 1, "again"), change("e", 3, 3, "too late"), change("f", 11, 4, "in time")) == {**got, 4: "in time"}
    assert store.snapshot().seen["s"] >= 1 and store.load(1).notes.count() == ws.notes.count()


def test_a_batch_that_runs_again_changes_nothing(ws, stream):
    store, _ = stream
    batch = ws.spark.createDataFrame([("z", None, False, 5, 1, "once")], "change_id string, at timestamp, gone boolean, id long, vehicle_id long, title string")
    batch = batch.select("*", *[__import__("pyspark").sql.functions.lit(None).cast(f.dataType).alias(f.name) for f in S.schema("notes") if f.name not in batch.columns])
    run = S.apply(store, "notes", "other")
    run(batch, 4)
    version = store.versions()[-1]
    run(batch, 4)
    run(batch, 3)
    assert store.versions()[-1] == version and store.snapshot().seen == {"other": 4}
    assert store.load().notes.filter("id = 5").first().title == "once"


def test_another_writer_in_between(ws, stream, monkeypatch):
    store, _ = stream
    plain, asked = store.snapshot, []

    def late(version=None):
        asked.append(version)
        found = plain(version)
        if len(asked) == 1:  # someone else writes after the version was read
            store.save(ws.with_tables(notes=ws.notes.filter("id <> 6")), found.version)
        return found

    monkeypatch.setattr(store, "snapshot", late)
    batch = ws.notes.filter("id = 5").selectExpr("'q' change_id", "timestamp'2026-02-01' at", "false gone", "* except (title)", "'mine' title")
    S.apply(store, "notes", "s")(batch, 0)
    got = {r.id: r.title for r in store.load().notes.collect()}
    assert got[5] == "mine" and 6 not in got and store.versions() == [1, 2, 3]
