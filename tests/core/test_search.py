import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import facets, links, search
from quillspark.plans import specs


def found(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def docs(ws, **request):
    return search.search_documents(links.documents(ws), **request)


def test_documents_by_relevance(ws):
    rows = docs(ws, query="  THERMOSTAT ", system="Cooling").collect()
    assert [(r.id, r.relevance_score, r.snippet_field, r.snippet) for r in rows] == [(1, 1000, "Title", "Thermostat replacement bulletin")]
    assert docs(ws, query="idle airflow DIAGRAM").first().relevance_score == 900
    assert docs(ws, query="idle.pdf").first().relevance_score == 700


def test_wildcards_are_the_users(ws):
    assert found(docs(ws, query="th%tat re"), "id", "snippet", "snippet_field") == [(1, "", "")]
    assert found(docs(ws, query="a_b\\c"), "id") == [(3,)]
    assert found(search.search(links.symptoms(ws), specs.SYMPTOMS, "%"), "id") == []


def test_only_ascii_letters_fold_in_documents(ws):
    assert found(docs(ws, query="À propos"), "id") == []
    assert found(docs(ws, query="propos"), "id", "snippet_field") == [(4, "Title")]


def test_document_orders_and_filters(ws):
    assert [r[0] for r in found(docs(ws), "id")] == [4, 3, 2, 1]
    assert [r[0] for r in found(docs(ws, sort="title"), "id")] == [2, 1, 3, 4]
    assert [r[0] for r in found(docs(ws, sort="nonsense", query="e"), "id")] == [4, 3, 2, 1]
    assert {r[0] for r in found(docs(ws, favorite="true"), "id")} == {1, 4}
    assert len(found(docs(ws, favorite="1"), "id")) == 4 and len(found(docs(ws, query=["a", "b"], system=["x"]), "id")) == 4
    assert found(docs(ws).filter("id = 1"), "relevance_score", "snippet", "snippet_field") == [(0, "Check the thermostat first.", "Notes")]
    assert found(docs(ws).filter("id IN (1, 4)").orderBy("id"), "vehicle_label") == [("2009 Volvo V70 LE",), ("2012 Ford Focus null",)]


def test_symptoms(ws):
    out = search.search(links.symptoms(ws), specs.SYMPTOMS, "throttle", system="Engine", status="monitoring").collect()
    assert [(r.id, r.snippet_field, r.relevance_score, r.linked_document_count) for r in out] == [(1, "Suspected causes", 360, 2)]
    assert [(d.id, d.title) for d in out[0].linked_documents] == [(2, "Idle airflow diagram"), (3, "throttle cleaning checklist")]
    assert found(search.search(links.symptoms(ws), specs.SYMPTOMS), "id") == [(1,), (3,), (2,)]
    assert found(search.search(links.symptoms(ws), specs.SYMPTOMS, sort="title"), "id") == [(1,), (2,), (3,)]
    assert found(links.symptoms(ws).filter("id = 2"), "confidence", "linked_document_ids") == [("medium", [])]


def test_procedures(ws):
    out = search.search(links.procedures(ws), specs.PROCEDURES, "cleaner", system="Engine", difficulty="beginner").collect()
    assert [(r.id, r.snippet_field, r.relevance_score, r.linked_document_count) for r in out] == [(1, "Parts needed", 460, 1)]


def test_notes(ws):
    out = search.search(links.notes(ws), specs.NOTES, "torque", note_type="reminder", related_entity_type="procedure").collect()
    assert [(r.id, r.linked_title, r.snippet_field, r.relevance_score) for r in out] == [(1, "Clean the throttle body", "Content", 660)]


def test_note_links(ws):
    rows = {r.id: r for r in links.notes(ws).collect()}
    kinds = {i: (r.related_entity_type, r.related_entity_id, r.linked_title) for i, r in rows.items()}
    assert kinds[2] == ("document", 2, "Idle airflow diagram") and rows[2].content == "from body"
    assert kinds[3] == ("document", 1, "Thermostat replacement bulletin")  # an old link
    assert kinds[4] == ("document", 1, "")  # stored in another case: named, not linked
    assert kinds[5] == ("symptom", 99, "") and kinds[6] == ("none", None, "")
    assert sum(rows[1][f"linked_{k}"] is not None for k in links.LINK_TYPES) == 1
    shown = {r.id: (r.t, r.m) for r in links.notes(ws).select("id", links.link_title().alias("t"), links.link_meta().alias("m")).collect()}
    assert shown[1] == ("Clean the throttle body", "Engine - Beginner") and shown[4] == ("Document #1", "")
    assert shown[5] == ("Symptom #99", "") and shown[6] == ("No link", "") and shown[2][1] == "Engine - Diagram"
    assert {r.id for r in links.dangling(ws).collect()} == {4, 5}


def test_option_lists(ws):
    assert [r.value for r in facets.stored_options(ws.documents, "document_type").collect()] == ["Bulletin", "Diagram"]
    assert [r.value for r in facets.options(ws.documents, "system").collect()] == ["Brakes", "Cooling", "Engine"]
    out = facets.suggestions(["Engine", " Body", "body"], ws.documents, "system").collect()
    assert [r.value for r in out] == ["Engine", "Body", "Brakes", "Cooling"]
    spark = ws.spark
    mixed = spark.createDataFrame([("b",), ("A",), ("é",), ("f",), ("",), (None,), (" e",)], "v string")
    assert [r.value for r in facets.options(mixed, "v").collect()] == ["A", "b", "e", "é", "f"]
    assert [r.value for r in facets.client_options(mixed, "v").collect()][-3:] == ["b", "é", "f"]


def plain_snippet(text, query):
    clean = " ".join(text.split())
    at = clean.lower().find(query.lower()) if query else -1
    if at < 0:
        return clean[:177] + "..." if len(clean) > 180 else clean
    a, b = max(0, at - 80), min(len(clean), at + len(query) + 80)
    return ("..." if a else "") + clean[a:b].strip() + ("..." if b < len(clean) else "")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t", max_size=400), min_size=20, max_size=40), st.sampled_from(["", "a", "ab b", "aaa"]))
def test_snippets_and_scores(spark, texts, query):
    df = spark.createDataFrame([(t,) for t in texts], "title string").repartition(2)
    out = df.select("title", T.snippet(F.col("title"), query).alias("s"), search.relevance(specs.NOTES.fields[:1], query).alias("r")).collect()
    for r in out:
        assert r.s == plain_snippet(r.title, query)
        assert not query or (r.r > 0) == (query in r.title.strip())
        assert len(r.s) <= max(180, len(query) + 166)


@pytest.mark.parametrize("size, want", [(180, 180), (181, 180)])
def test_preview_bounds(spark, size, want):
    assert len(spark.range(1).select(T.snippet(F.lit("x" * size), "")).first()[0]) == want
