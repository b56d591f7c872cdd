"""What a task holds follows from how rows are dealt: no key, kind or file takes them all."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from quillspark.operators import links, mutations, trigrams
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    """Plans as they are for tables too large to broadcast, without later changes."""
    values = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"} | values
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def most(df):
    """Rows of the largest partition, and of all."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes)


@pytest.mark.parametrize("kind", ["none", "symptom"])
def test_notes_without_a_record_are_spread(spark, ws, kind):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("vehicle_id"), F.lit(kind).alias("related_entity_type"), F.when(F.lit(kind == "symptom"), F.col("id") + 1).alias("related_entity_id"), "id")
    notes = ws.notes.limit(0).unionByName(rows, allowMissingColumns=True)
    with settings(spark):
        largest, n = most(links.notes(ws.with_tables(notes=notes)))
        assert n == 1000 and largest < 500


def test_choices_of_a_link_stay_where_they_are_read(spark, ws):
    symptoms = ws.symptoms.limit(0).unionByName(spark.range(1000).select("id", F.lit(1).cast("long").alias("vehicle_id"), F.lit("t").alias("title")), allowMissingColumns=True)
    with settings(spark):
        largest, n = most(links.picker(ws.with_tables(symptoms=symptoms, procedures=ws.procedures.limit(0))))
        assert n == 1000 + ws.documents.count() + 1 and largest < 500


@pytest.mark.parametrize("name, rows", [("extract_pdfs", 200), ("extract_structured_pdfs", 200), ("positive_ids", 1500), ("json_list", 1000)])
def test_rows_with_costly_work_are_dealt_over_tasks(spark, name, rows):
    """The table is one row group, so one task reads it."""
    largest, n = most(registry.QUERIES[name](spark, SF))
    assert n == rows and largest < rows / 2


def test_letters_are_worked_out_once_and_stay(spark, ws, tmp_path, monkeypatch):
    """No sample of the letters is taken and no letters are moved; characters of two UTF-16 units are one."""
    calls = []
    monkeypatch.setattr(type(ws.documents), "repartitionByRange", lambda *a, **k: calls.append(a))
    documents = links.documents(ws).withColumn("extracted_text", F.lit("A\U0001f600b\nc"))
    index = trigrams.write_index(documents, str(tmp_path / "i"))
    assert not calls
    assert {r.gram for r in index.collect()} >= {"a\U0001f600b", "\U0001f600b\n", "b\nc"}


@pytest.mark.parametrize("n_ids", [0, 20, 3000])
def test_broken_rules_are_looked_for_by_shares(spark, ws, monkeypatch, n_ids):
    """A task gets about ROWS of the pairs, whatever their bytes; rows without an id and repeated ids are told as before."""
    monkeypatch.setattr(mutations, "ROWS", 500, raising=False)
    ids = ws.documents.limit(0).unionByName(spark.range(n_ids).select("id", F.lit(1).cast("long").alias("vehicle_id")), allowMissingColumns=True)
    pairs = spark.range(8000).select((F.col("id") % 4000).alias("symptom_id"), F.when(F.col("id") % 4000 > 0, F.col("id") % 4000).alias("document_id"))
    found = mutations.violations(ws.with_tables(documents=ids.unionByName(ids.filter("id = 1")), symptom_documents=pairs, notes=ws.notes.limit(0), procedure_documents=ws.procedure_documents.limit(0)))
    largest, _ = most(found.filter("rule = 'unique' AND table = 'symptom_documents'"))
    assert largest < 500
    got = {(r["rule"], r["table"]): r["n"] for r in found.groupBy("rule", "table").agg(F.count("*").alias("n")).collect()}
    told = {("unique", "symptom_documents"): 4000, ("document", "symptom_documents"): 8000 - 2 * max(n_ids - 1, 0), ("symptom", "symptom_documents"): 8000 - 2 * 4}
    assert got == told | ({("unique", "documents"): 1} if n_ids else {})
