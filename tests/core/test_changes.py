import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import browse, dashboard, links, mutations as M, search
from quillspark.sources import config, ingest
from quillspark.sources import workspace as W


def by_id(df, id_):
    return df.filter(F.col("id") == id_).first()


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_dashboard(ws):
    assert tuple(dashboard.counts(ws).first()) == (3, 1, 3, 2, 2, 6)
    assert [r.id for r in dashboard.recent_documents(ws).collect()] == [2, 3, 1]
    assert [r.id for r in dashboard.favorites(ws).collect()] == [1]
    assert [r.id for r in dashboard.recent_symptoms(ws, active=True).collect()] == [1, 2]
    assert dashboard.recent_notes(ws).filter("id = 3").first().title == "Untitled note"
    assert [r.key for r in dashboard.recent_activity(ws, 4).collect()] == ["document-2", "symptom-1", "symptom-3", "note-6"]
    assert dashboard.dashboard(ws)["vehicle"].first().make == "Volvo"
    assert dashboard.vehicle_profile(ws).first().label == "2009 Volvo V70 LE 1.8L"


def test_second_layer(ws):
    assert tuple(browse.status_histogram(links.symptoms(ws)).first()) == (3, 2, 1, 0)
    assert browse.visible_counts(links.symptoms(ws), browse.status_filter("active"), "symptom").first().sentence == "Showing 2 of 3 symptoms"
    assert {r.id for r in ws.documents.filter(browse.extraction_filter("failed")).collect()} == {2}
    assert {r.id for r in ws.documents.filter(browse.favorite_filter("not_favorites")).collect()} == {2, 3}
    assert ws.documents.filter(browse.favorite_filter("else")).count() == 4
    symptoms = links.symptoms(ws)
    assert [r.id for r in browse.ordered(symptoms, "oldest").collect()] == [2, 3, 1]
    assert [r.id for r in browse.ordered(symptoms, "title").collect()] == [1, 2, 3]
    assert browse.keyword(symptoms, "PLATE", browse.SYMPTOM_FIELDS).count() == 1
    assert browse.keyword(links.procedures(ws), "fumes", browse.PROCEDURE_FIELDS).count() == 0
    pick = lambda *a: browse.selection(symptoms, *a).first().id
    assert (pick(3, 2), pick(50, 2), pick(None, None)) == (3, 2, 1)
    assert browse.selection(symptoms.limit(0), 1, 1).first() is None


def test_symptom_changes(ws):
    new, id_ = M.create_symptom(ws, {"title": " Noise ", "confidence": " LOW", "linked_document_ids": ["1", 1, 4, 77, "x"]})
    row = by_id(new.symptoms, id_)
    assert (id_, row.title, row.confidence, row.status, row.vehicle_id) == (5, "Noise", "low", "open", 1)
    assert [p for p in pairs(new.symptom_documents) if p[0] == 5] == [(5, 1)]  # 4 belongs to another vehicle
    same = M.update_symptom(ws, 1, {"status": "resolved"})
    assert by_id(same.symptoms, 1).status == "resolved" and by_id(same.symptoms, 1).title == "Idle surge after warm start"
    assert pairs(same.symptom_documents) == pairs(ws.symptom_documents)
    once = M.update_symptom(ws, 1, {"linked_document_ids": [1, 3]})
    assert pairs(once.symptom_documents) == [(1, 1), (1, 3)] == pairs(M.update_symptom(once, 1, {"linked_document_ids": [1, 3]}).symptom_documents)
    gone = M.delete_symptom(ws, 1)
    assert gone.symptoms.count() == 3 and gone.symptom_documents.count() == 0
    for bad in ({"title": " "}, {"title": "x", "status": "odd"}, {}):
        with pytest.raises(M.Invalid):
            M.create_symptom(ws, bad)
    with pytest.raises(M.Missing):
        M.update_symptom(ws, 4, {"title": "other vehicle"})


def test_procedure_changes(ws):
    new, id_ = M.create_procedure(ws, {"title": "Bleed", "difficulty": "Advanced"})
    assert by_id(new.procedures, id_).difficulty == "advanced" and by_id(M.update_procedure(new, id_, {"steps": " a "}).procedures, id_).steps == "a"
    assert M.delete_procedure(ws, 1).procedure_documents.count() == 0


def test_notes_move_their_link(ws):
    new, id_ = M.create_note(ws, {"title": "n", "content": "c", "related_entity_type": "document", "related_entity_id": "2"})
    assert by_id(new.notes, id_).document_id == 2 and by_id(new.notes, id_).body == "c"
    for kind, target in (("symptom", 1), ("procedure", 1)):
        new = M.update_note(new, id_, {"related_entity_type": kind, "related_entity_id": target})
        row = by_id(links.notes(new), id_)
        assert [row[f"linked_{k}"] is not None for k in links.LINK_TYPES] == [k == kind for k in links.LINK_TYPES]
    assert by_id(M.update_note(ws, 3, {"title": "t"}).notes, 3).related_entity_id == 1  # the old link is stored
    assert by_id(M.update_note(ws, 1, {"related_entity_type": "none"}).notes, 1).related_entity_id is None
    assert M.delete_note(ws, 1).notes.count() == 5
    for bad in ({"related_entity_type": "symptom"}, {"related_entity_type": "symptom", "related_entity_id": 99}, {"note_type": "poem"}, {"related_entity_type": "document", "related_entity_id": -1}):
        with pytest.raises(M.Invalid):
            M.create_note(ws, {"title": "x"} | bad)


def test_documents(ws):
    row = by_id(M.update_document(ws, 1, {"notes": " n ", "is_favorite": "yes"}).documents, 1)
    assert (row.notes, row.is_favorite, row.subsystem) == ("n", True, "")
    with pytest.raises(M.Invalid):
        M.update_document(ws, 1, {"system": ""})
    with pytest.raises(M.Invalid):
        M.update_document(ws, 3, {"title": ""})
    new, report = M.delete_document(ws, 2)
    assert report.first().asDict() == {"symptom_links_removed": 2, "procedure_links_removed": 0, "note_links_cleared": 1, "file_removed": False}
    note = by_id(new.notes, 2)
    assert (note.related_entity_type, note.related_entity_id, note.document_id) == ("none", None, None)
    assert by_id(new.notes, 6).document_id is None and new.documents.count() == 3 and pairs(new.symptom_documents) == [(1, 3), (1, 50)]
    assert links.dangling(new).filter("related_entity_type = 'document' AND related_entity_id = 2").count() == 0


def test_settings(ws):
    first = M.document_defaults(ws, ["a"], ["b"]).first()
    assert (first.systems, first.types) == (["Engine", "Cooling"], ["b"])
    new = M.update_document_defaults(ws, ["Engine", "engine", " Body "], ["Manual"])
    assert tuple(M.document_defaults(new, [], []).first()) == (["Engine", "Body"], ["Manual"])
    with pytest.raises(M.Invalid):
        M.update_document_defaults(ws, [], ["x"])
    new = M.update_vehicle(ws, "2010", "Volvo", " V90 ", "S")
    assert (by_id(new.vehicles, 1).model, by_id(new.vehicles, 2).model) == ("V90", "Focus")
    for year in (1899, 2101, "x", 2000.5):
        with pytest.raises(M.Invalid):
            M.update_vehicle(ws, year, "a", "b")


def test_settings_as_a_whole(ws):
    runtime = config.runtime_settings(ws.spark, config.Config("/w", "/u", 7))
    row = M.settings(ws, runtime, ["a"], ["b"]).first()
    assert (row.vehicle.id, row.vehicle.make, row.runtime.uploads, row.runtime.max_upload_mb, row.document_defaults.systems, row.document_defaults.types, row.backup.supported) == (1, "Volvo", "/u", 7, ["Engine", "Cooling"], ["b"], True)
    none = M.settings(ws.with_tables(app_settings=ws.app_settings.limit(0)), runtime, ["a"], ["b"]).first()
    assert tuple(none.document_defaults) == (["a"], ["b"])


def test_backfills(ws):
    new = {r.id: r for r in M.backfill_notes(ws.notes).collect()}
    assert new[2].content == "from body" and (new[3].related_entity_type, new[3].related_entity_id) == ("document", 1) and new[6].related_entity_type == "none"
    spaces = ws.notes.filter("id = 1").withColumns({"content": F.lit("  "), "body": F.lit("b"), "note_type": F.lit(" ")})
    assert tuple(M.backfill_notes(spaces).select("content", "note_type").first()) == ("  ", "general")
    filled = by_id(M.backfill_document(ws.documents, "other.pdf", "application/pdf", "s", "seed"), 4)
    assert (filled.file_type, filled.page_count, filled.extraction_status) == ("application/pdf", 1, "completed")


def test_constraints(ws):
    assert {tuple(r) for r in M.violations(ws).collect()} == {("document", "symptom_documents", 50), ("unique", "symptom_documents", 1)}


def test_round_trip_and_new_columns(ws, tmp_path):
    W.save(ws, str(tmp_path / "w"))
    again = W.load(ws.spark, str(tmp_path / "w"))
    assert again.documents.schema == ws.documents.schema and pairs(again.symptom_documents) == pairs(ws.symptom_documents)
    old = W.conform(ws.notes.drop("note_type", "related_entity_type"), "notes").first()
    assert (old.note_type, old.related_entity_type) == ("general", "none")
    seeds = W.insert_missing(ws.vehicles.select("id", "make"), ws.spark.createDataFrame([(1, "x"), (9, "y")], "id long, make string"), ["id"])
    assert pairs(seeds) == [(1, "Volvo"), (2, "Ford"), (9, "y")]


def pdf(*pages, flate=False):
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n"
    for i, content in enumerate(pages):
        body = zlib.compress(content) if flate else content
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj << /Length %d %s>>\nstream\n%s\nendstream endobj\n" % (11 + 2 * i, len(body), b"/Filter /FlateDecode " if flate else b"", body)
    return out


def test_ingest(ws, tmp_path):
    spark = ws.spark
    files = {"front_brake.pdf": pdf(b"BT (Hello \\(big\\)) Tj ET", b"BT [(wor) -20 (ld)] TJ <4142> Tj ET"), "empty.PDF": pdf(b"", flate=True), "zip.pdf": pdf(b"(deflated) Tj", flate=True), "bad.pdf": b"not a pdf", "note.txt": b"x", "large.pdf": b"%PDF-" + b"x" * 3000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = ingest.files(spark, str(tmp_path), 2000)
    rows = {r.path.rsplit("/", 1)[-1]: (r.extracted_text, r.extraction_status, r.page_count) for r in ingest.extracted(found).collect()}
    assert rows == {
        "front_brake.pdf": ("Hello (big)\n\nworld AB", "completed", 2),
        "empty.PDF": ("", "no_text_found", 1),
        "zip.pdf": ("deflated", "completed", 1),
        "bad.pdf": ("", "failed: Invalid PDF structure.", None),
    }
    assert {r.path.rsplit("/", 1)[-1] for r in ingest.rejected(spark, str(tmp_path), 2000).collect()} == {"note.txt", "large.pdf"}
    archive = ingest.backup(ws, str(tmp_path / "backup"))
    assert archive.endswith("Z.tar.gz")


def test_upload(ws, tmp_path):
    spark = ws.spark
    for folder in ("a", "b", "store"):
        (tmp_path / folder).mkdir()
    for name, text in (("a/my file.pdf", b"(one) Tj"), ("b/my file.pdf", b"(two) Tj"), ("a/Other.PDF", b"(three) Tj")):
        (tmp_path / name).write_bytes(pdf(text))
    found, store = ingest.files(spark, str(tmp_path)), str(tmp_path / "store")
    new = ingest.upload(ws, found, " Brakes ", "Manual", store, notes=" n ")
    rows = new.documents.filter("id > 4").orderBy("id").collect()
    assert rows == new.documents.filter("id > 4").orderBy("id").collect()  # the same whenever it is computed
    assert [(r.id, r.title, r.original_filename, r.system, r.notes, r.extracted_text, r.vehicle_id) for r in rows] == [
        (5, "Other", "Other.PDF", "Brakes", "n", "three", 1), (6, "my file", "my file.pdf", "Brakes", "n", "one", 1), (7, "my file", "my file.pdf", "Brakes", "n", "two", 1)]
    assert len({r.stored_filename for r in rows}) == 3 and all(r.file_path == f"{store}/{r.stored_filename}" and (tmp_path / "store" / r.stored_filename).exists() for r in rows)
    assert rows[1].stored_filename.startswith("my-file-") and ingest.total_after(ws, found).first().total == 7
    (tmp_path / "store" / f".{rows[1].stored_filename}.crc").unlink(missing_ok=True)  # a checksum of the copy
    (tmp_path / "store" / rows[1].stored_filename).write_bytes(pdf(b"(new) Tj"))
    again = ingest.extract_again(new, 6, ingest.files(spark, store))
    assert [r.extracted_text for r in again.documents.filter("id > 4").orderBy("id").collect()] == ["three", "new", "two"]
    with pytest.raises(M.Missing):
        ingest.extract_again(ws, 1, found)
    for system, kind in (("", "Manual"), ("Brakes", " "), (None, "Manual")):
        with pytest.raises(M.Invalid):
            ingest.upload(ws, found, system, kind, store)


def test_ids_that_are_no_numbers(ws):
    for bad in (float("inf"), float("-inf"), float("nan"), "Infinity", "NaN", "x", 1.5, -1, 10**400):
        with pytest.raises(M.Invalid):
            M.identifier(bad)
    for bad in ("1_0", "3d", " ", "abc", "0x", "-1"):
        with pytest.raises(M.Invalid):
            M.identifier(bad)
    assert M.identifier("0x10") == 16 and M.identifier(1e300) == int(1e300)
    assert M.identifiers([1, "Infinity", float("nan"), "2", 2, None, [3]]) == [1, 2]
    assert M.identifiers([1e300, "1_0", "0x10", "3d", 2**63, " ", "abc", 2**63 - 1025, "3"]) == [16, 2**63 - 1024, 3]
    changed = M.update_symptom(ws, 1, {"linked_document_ids": [1e300, 2**63, "0x2", "abc"]})
    assert [tuple(r) for r in changed.symptom_documents.collect()] == [(1, 2)]
    for id_ in (1e300, 2**63, 99):
        with pytest.raises(M.Missing):
            M.delete_symptom(ws, id_)
    with pytest.raises(M.Invalid, match="does not exist"):
        M.create_note(ws, {"title": "t", "content": "", "related_entity_type": "symptom", "related_entity_id": "1e300"})
    assert [M.payload("note", {"related_entity_id": v})["related_entity_id"] for v in ("abc", "", None, "7", " 8 ", "0x10", "Infinity", 5, float("nan"))] == [None, None, None, 7, 8, 16, None, 5, None]
    assert M.identifier(" 7 ") == 7 and M.identifier("") is None


def test_whole_answers(ws):
    answer = search.respond(ws, "symptoms", query="throttle", system="Engine")
    assert (answer.total.first().total, [r.id for r in answer.results.collect()]) == (1, [1])
    assert {tuple(r) for r in answer.filters.collect()} == {("systems", "Engine"), ("systems", "Brakes"), ("statuses", "monitoring"), ("statuses", "open"), ("statuses", "odd")}
    assert {tuple(r) for r in links.picker(ws.with_tables(procedures=ws.procedures.limit(0))).filter("kind = 'procedure'").select("id", "empty").collect()} == {(None, links.EMPTY["procedure"])}
    assert M.payload("note", {"title": "t", "related_entity_id": "", "x": 1}) == {"title": "t", "content": None, "note_type": None, "related_entity_type": None, "related_entity_id": None}
