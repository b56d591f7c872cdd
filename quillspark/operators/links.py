"""Entities with what they link to: bridges as ordered arrays, notes with their one polymorphic link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.workspace import Workspace

#: The kinds that a note can link to.
LINK_TYPES = ["document", "symptom", "procedure"]

#: The texts about a link.
NO_TYPE, NO_SYSTEM, LINKED, PLEASE, CHOOSE = "No type", "No system", "Linked ", "Please choose a linked ", "Choose a "

#: What is shown where a kind has nothing to link to.
EMPTY = {
    "document": "No documents available yet. Upload a PDF in Documents first.",
    "symptom": "No symptoms available yet. Add a symptom first.",
    "procedure": "No procedures available yet. Add a procedure first.",
}


def documents(ws: Workspace) -> DataFrame:
    """Documents of all vehicles with the vehicle's label; a null trim reads 'null'."""
    vehicles = ws.vehicles.select(F.col("id").alias("vehicle_id"), "year", "make", "model", "trim")
    label = F.concat(F.col("year").cast("string"), F.lit(" "), "make", F.lit(" "), "model", F.lit(" "), F.coalesce("trim", F.lit("null")))
    blank = {c: T.blank_to(F.col(c), "") for c in ("subsystem", "source", "notes", "extracted_text")}
    return ws.documents.join(vehicles, "vehicle_id").withColumn("vehicle_label", label).drop("year", "make", "model", "trim").withColumns(blank)


def list_documents(ws: Workspace) -> DataFrame:
    return documents(ws).orderBy(F.desc("created_at"), F.desc("id"))


def linked_documents(bridge: DataFrame, key: str, documents_: DataFrame) -> DataFrame:
    """(key, linked): documents of each parent as an array of structs, by title without case, then id.

    Pairs are made distinct first; the array of a parent is as long as its links.
    """
    pairs = bridge.select(key, "document_id").distinct()
    docs = documents_.select(F.col("id").alias("document_id"), "title", "system", "document_type")
    entry = F.struct(T.ascii_lower(F.col("title")).alias("by"), F.col("document_id").alias("id"), "title", "system", "document_type")
    found = pairs.join(docs, "document_id").groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("linked"))
    return found.withColumn("linked", F.transform("linked", lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), T.blank_to(e["system"], "").alias("system"), T.blank_to(e["document_type"], "").alias("document_type"))))


def with_links(rows: DataFrame, bridge: DataFrame, key: str, documents_: DataFrame, few: bool = False) -> DataFrame:
    """rows with linked_documents, linked_document_ids and linked_document_count; empty arrays without links.

    few: rows are a part of their table that is small beside the bridge, which is reduced to their links first.
    """
    bridge = bridge.join(rows.select(F.col("id").alias(key)), key, "left_semi") if few else bridge
    links = linked_documents(bridge, key, documents_).withColumnRenamed(key, "id")
    none = F.array().cast(links.schema["linked"].dataType)
    out = rows.join(links, "id", "left").withColumn("linked_documents", F.coalesce("linked", none)).drop("linked")
    return out.withColumn("linked_document_ids", F.transform("linked_documents", lambda e: e["id"])).withColumn("linked_document_count", F.size("linked_documents").cast("long"))


def symptom_rows(rows: DataFrame) -> DataFrame:
    blank = {c: T.blank_to(F.col(c), "") for c in ("description", "system", "suspected_causes", "notes")}
    return rows.withColumns(blank | {"confidence": T.blank_to(F.col("confidence"), "medium"), "status": T.blank_to(F.col("status"), "open")})


def procedure_rows(rows: DataFrame) -> DataFrame:
    blank = {c: T.blank_to(F.col(c), "") for c in ("system", "tools_needed", "parts_needed", "safety_notes", "steps", "notes")}
    return rows.withColumns(blank | {"difficulty": T.blank_to(F.col("difficulty"), "intermediate"), "confidence": T.blank_to(F.col("confidence"), "medium")})


def symptoms(ws: Workspace) -> DataFrame:
    return with_links(symptom_rows(ws.scoped("symptoms")), ws.symptom_documents, "symptom_id", ws.documents)


def procedures(ws: Workspace) -> DataFrame:
    return with_links(procedure_rows(ws.scoped("procedures")), ws.procedure_documents, "procedure_id", ws.documents)


def notes(ws: Workspace) -> DataFrame:
    """Notes with at most one of linked_document, linked_symptom and linked_procedure, and its title.

    The link compares the stored type as it is; where the type is blank, the
    old document_id links. Each note thus has one (kind, id), so the records of all
    kinds are joined at once on equal keys. Notes without a link have their own id
    as key under no kind, so they don't come together in one task. The shown type is
    trimmed and lower-cased.
    """
    rows = ws.scoped("notes")
    raw, blank = F.col("related_entity_type"), F.coalesce(F.trim("related_entity_type"), F.lit("")) == ""
    legacy = F.when(F.col("document_id") > 0, F.col("document_id"))
    kind = T.blank_to(T.search_form(raw), F.when(legacy.isNotNull(), "document").otherwise("none"))
    own = F.when(F.col("related_entity_id") > 0, F.col("related_entity_id"))
    to = F.when(raw.isin(LINK_TYPES), F.col("related_entity_id")).when(blank, F.col("document_id"))
    rows = rows.select(
        "*",
        F.when(to.isNull(), "").when(blank, "document").otherwise(raw).alias("_kind"),
        F.coalesce(to, F.col("id")).alias("_key"),
        kind.alias("_type"),
        F.when(kind == "document", F.coalesce(own, legacy)).otherwise(own).alias("_id"),
    )
    details = {
        "document": [T.blank_to(F.col("system"), "").alias("system"), T.blank_to(F.col("document_type"), "").alias("document_type")],
        "symptom": [T.blank_to(F.col("system"), "").alias("system"), T.blank_to(F.col("status"), "open").alias("status")],
        "procedure": [T.blank_to(F.col("system"), "").alias("system"), T.blank_to(F.col("difficulty"), "intermediate").alias("difficulty")],
    }
    targets = [getattr(ws, f"{k}s").select("vehicle_id", F.lit(k).alias("_kind"), F.col("id").alias("_key"), F.struct("id", "title", *details[k]).alias(f"linked_{k}")) for k in LINK_TYPES]
    rows = rows.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), targets), ["vehicle_id", "_kind", "_key"], "left")
    titles = [F.nullif(F.col(f"linked_{k}.title"), F.lit("")) for k in LINK_TYPES]
    return rows.select(
        "id",
        "vehicle_id",
        T.blank_to(F.col("title"), "").alias("title"),
        T.blank_to(F.col("content"), T.blank_to(F.col("body"), "")).alias("content"),
        T.blank_to(F.col("note_type"), "general").alias("note_type"),
        F.col("_type").alias("related_entity_type"),
        F.col("_id").alias("related_entity_id"),
        *[f"linked_{k}" for k in LINK_TYPES],
        F.coalesce(*titles, F.lit("")).alias("linked_title"),
        "created_at",
        "updated_at",
    )


def listed(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), F.desc("id"))


def _own(fields: dict[str, str]):
    """The field of the linked record that the type names; null without a record."""
    return T.first_of([(F.col("related_entity_type") == k, F.col(f"linked_{k}.{f}")) for k, f in fields.items()], F.lit(None))


def link_title():
    kind, own = F.col("related_entity_type"), _own(dict.fromkeys(LINK_TYPES, "title"))
    numbered = F.concat(T.labelize(kind), F.lit(" #"), F.col("related_entity_id").cast("string"))
    return F.when(kind == "none", "No link").otherwise(F.coalesce(F.nullif(own, F.lit("")), numbered, F.concat(T.labelize(kind), F.lit(" link"))))


def link_meta():
    parts = []
    for k, field, default in (("document", "document_type", NO_TYPE), ("symptom", "status", None), ("procedure", "difficulty", None)):
        detail = F.col(f"linked_{k}.{field}")
        shown = T.blank_to(detail, default) if default else T.labelize(detail)
        here = (F.col("related_entity_type") == k) & F.col(f"linked_{k}").isNotNull()
        parts.append((here, F.concat(T.blank_to(F.col(f"linked_{k}.system"), NO_SYSTEM), F.lit(" - "), shown)))
    return T.first_of(parts, F.lit(""))


def type_label(kind, none: str = ""):
    return F.when(kind == "none", none).otherwise(T.labelize(kind))


def open_label(kind):
    return F.when(kind.isin(LINK_TYPES), kind).otherwise("item")


def heading(kind):
    return F.concat(F.lit(LINKED), open_label(kind))


def missing_link_message(kind):
    return F.when(kind.isin(LINK_TYPES), F.concat(F.lit(PLEASE), kind, F.lit("."))).otherwise("")


def picker(ws: Workspace) -> DataFrame:
    """(kind, label, placeholder, empty, id, title): what each kind of link offers to choose from; one row without an id where there is nothing.

    A document of any vehicle can be chosen, symptoms and procedures of the anchor's. Rows stay where they are read;
    only whether a kind has any is looked up.
    """
    rows = {"document": ws.documents, "symptom": ws.scoped("symptoms"), "procedure": ws.scoped("procedures")}
    kinds = ws.spark.createDataFrame([(k,) for k in LINK_TYPES], "kind string")
    entities = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "id", "title") for k, df in rows.items()])
    there = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind")).limit(1) for k, df in rows.items()])
    none = kinds.join(F.broadcast(there), "kind", "left_anti").select("kind", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("title"))
    empty = T.first_of([(F.col("kind") == k, F.lit(text)) for k, text in EMPTY.items()], F.lit(None))
    return entities.unionByName(none).select("kind", heading(F.col("kind")).alias("label"), F.concat(F.lit(CHOOSE), "kind").alias("placeholder"), F.when(F.col("id").isNull(), empty).alias("empty"), "id", "title")


def existing(ids: DataFrame, table: DataFrame, column: str = "id") -> DataFrame:
    """Of the asked ids those that the table has, each once."""
    return ids.select(column).distinct().join(table.select(F.col("id").alias(column)), column, "left_semi")


def dangling(ws: Workspace) -> DataFrame:
    """(id, related_entity_type, related_entity_id) of notes whose linked record doesn't exist."""
    gone = F.col("related_entity_type").isin(LINK_TYPES) & _own(dict.fromkeys(LINK_TYPES, "id")).isNull()
    return notes(ws).filter(gone).select("id", "related_entity_type", "related_entity_id")
