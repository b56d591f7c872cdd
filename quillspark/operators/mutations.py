"""Changes as pure functions from workspace to workspace, to be saved as a new copy.

Requests are small Python values and are checked at once: Invalid or Missing
is raised before any table is touched. Tables are rewritten by projections and
anti joins; only single rows are read to check a request.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.workspace import Workspace, conform, insert_missing, point_lookup
from .dashboard import vehicle
from .links import LINK_TYPES

#: What the coded columns may hold.
CONFIDENCE = ["low", "medium", "high"]
STATUS = ["open", "monitoring", "resolved"]
DIFFICULTY = ["beginner", "intermediate", "advanced"]
NOTE_TYPES = ["general", "observation", "repair_log", "reminder"]

CODES: dict[str, dict[str, tuple[list[str], str]]] = {
    "symptoms": {"confidence": (CONFIDENCE, "medium"), "status": (STATUS, "open")},
    "procedures": {"difficulty": (DIFFICULTY, "intermediate"), "confidence": (CONFIDENCE, "medium")},
    "notes": {"note_type": (NOTE_TYPES, "general")},
    "documents": {},
}
TEXTS = {
    "symptoms": ["title", "description", "system", "suspected_causes", "notes"],
    "procedures": ["title", "system", "tools_needed", "parts_needed", "safety_notes", "steps", "notes"],
    "documents": ["title", "system", "subsystem", "document_type", "source", "notes"],
}
REQUIRED = {"symptoms": ["title"], "procedures": ["title"], "documents": ["title", "system", "document_type"]}


class Invalid(ValueError):
    """A request that breaks a rule."""


class Missing(LookupError):
    """A request about a row that isn't there."""


def now() -> Column:
    """This second in UTC, without zone."""
    return F.date_trunc("second", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())).cast("timestamp_ntz")


def code(value: object, allowed: list[str], default: str, name: str) -> str:
    found = T.query_text(value).lower() or default
    if found not in allowed:
        raise Invalid(f"{name} must be one of {', '.join(allowed)}.")
    return found


def identifier(value: object) -> int | None:
    """A positive whole number; None for a blank."""
    if value is None or value == "":
        return None
    number = T.number(value)
    # infinities and NaN are no whole numbers
    if not number.is_integer() or number <= 0:
        raise Invalid("An id must be a positive number.")
    return int(number)


def identifiers(values: object) -> list[int]:
    """Distinct positive whole numbers in their order; whatever else is dropped, as is what is too large for an id."""
    found: dict[int, None] = {}
    for value in values if isinstance(values, (list, tuple)) else []:
        try:
            number = identifier(value)
        except Invalid:
            continue
        if number is not None and number <= T.LARGEST:
            found[number] = None
    return list(found)


#: The fields that a form of each kind sends.
FORMS = {
    "note": ["title", "content", "note_type", "related_entity_type", "related_entity_id"],
    "symptom": ["title", "description", "system", "suspected_causes", "confidence", "status", "notes", "linked_document_ids"],
    "procedure": ["title", "system", "difficulty", "tools_needed", "parts_needed", "safety_notes", "steps", "notes", "confidence", "linked_document_ids"],
}


def payload(kind: str, form: Mapping[str, Any]) -> dict[str, Any]:
    """A form as a request: its own fields only; the id of a note's link is a number, or null where the form has '' or no number."""
    out = {c: form.get(c) for c in FORMS[kind]}
    if kind == "note":
        chosen = T.number(out["related_entity_id"]) if out["related_entity_id"] else math.nan
        out["related_entity_id"] = chosen if math.isfinite(chosen) else None
    return out


def _values(table: str, request: Mapping[str, Any]) -> dict[str, Any]:
    """The table's columns that the request names, normalised."""
    out: dict[str, Any] = {c: T.query_text(request[c]) for c in TEXTS.get(table, []) if c in request}
    out |= {c: code(request[c], allowed, default, c) for c, (allowed, default) in CODES[table].items() if c in request}
    for c in REQUIRED.get(table, []):
        if c in out and not out[c]:
            raise Invalid(f"{c} is required.")
    return out


def insert(df: DataFrame, table: str, values: Mapping[str, Any], scope: DataFrame | None = None) -> DataFrame:
    """df with one more row: id is the largest one plus 1, times are now. Two one-row sides are joined to make it."""
    row = df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = row.crossJoin(scope) if scope is not None else row
    row = row.withColumns({c: F.lit(v) for c, v in values.items()} | {c: now() for c in ("created_at", "updated_at") if c in df.columns})
    return df.unionByName(conform(row, table))


def patch(df: DataFrame, at: Column, values: Mapping[str, Any]) -> DataFrame:
    """df with new values in the rows where `at` holds; values are literals or columns of the row."""
    types = {f.name: f.dataType for f in df.schema}
    new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(types[c]) for c, v in values.items()}
    return df.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in new.items()})


def _row(df: DataFrame, id_: int, name: str):
    found = point_lookup(df, identifier(id_) or 0).first()
    if found is None:
        raise Missing(f"{name} not found.")
    return found


def replace_links(bridge: DataFrame, key: str, id_: int, documents: DataFrame, ids: Iterable[int]) -> DataFrame:
    """bridge in which the parent links to those of ids that documents has; unknown ids drop out silently."""
    new = documents.filter(F.col("id").isin(list(ids))).select(F.lit(id_).cast("long").alias(key), F.col("id").alias("document_id"))
    return bridge.filter(F.col(key) != id_).unionByName(new.distinct())


def _linked(ws: Workspace, kind: str, id_: int, ids: object) -> Workspace:
    bridge = f"{kind}_documents"
    return ws.with_tables(**{bridge: replace_links(getattr(ws, bridge), f"{kind}_id", id_, ws.scoped("documents"), identifiers(ids))})


def _create(ws: Workspace, kind: str, request: Mapping[str, Any]) -> tuple[Workspace, int]:
    table = f"{kind}s"
    values = _values(table, {c: "" for c in [*TEXTS[table], *CODES[table]]} | dict(request))
    new = insert(getattr(ws, table), table, values, ws.anchor)
    id_ = new.agg(F.max("id")).first()[0]
    return _linked(ws.with_tables(**{table: new}), kind, id_, request.get("linked_document_ids")), id_


def _update(ws: Workspace, kind: str, id_: int, request: Mapping[str, Any]) -> Workspace:
    table = f"{kind}s"
    _row(ws.scoped(table), id_, kind)
    values = _values(table, request) | {"updated_at": now()}
    ws = ws.with_tables(**{table: patch(getattr(ws, table), F.col("id") == id_, values)})
    return _linked(ws, kind, id_, request["linked_document_ids"]) if "linked_document_ids" in request else ws


def _delete(ws: Workspace, kind: str, id_: int) -> Workspace:
    """The row and its links go; notes that link to it stay as they are."""
    _row(ws.scoped(f"{kind}s"), id_, kind)
    bridge = f"{kind}_documents"
    return ws.with_tables(**{f"{kind}s": getattr(ws, f"{kind}s").filter(F.col("id") != id_), bridge: getattr(ws, bridge).filter(F.col(f"{kind}_id") != id_)})


def create_symptom(ws: Workspace, request: Mapping[str, Any]) -> tuple[Workspace, int]:
    return _create(ws, "symptom", request)


def update_symptom(ws: Workspace, id_: int, request: Mapping[str, Any]) -> Workspace:
    """Fields that the request doesn't name stay; links change only if it names linked_document_ids."""
    return _update(ws, "symptom", id_, request)


def delete_symptom(ws: Workspace, id_: int) -> Workspace:
    return _delete(ws, "symptom", id_)


def create_procedure(ws: Workspace, request: Mapping[str, Any]) -> tuple[Workspace, int]:
    return _create(ws, "procedure", request)


def update_procedure(ws: Workspace, id_: int, request: Mapping[str, Any]) -> Workspace:
    return _update(ws, "procedure", id_, request)


def delete_procedure(ws: Workspace, id_: int) -> Workspace:
    return _delete(ws, "procedure", id_)


def _note_link(ws: Workspace, kind: object, id_: object) -> dict[str, Any]:
    kind = code(kind, [*LINK_TYPES, "none"], "none", "related_entity_type")
    id_ = identifier(id_)
    if kind == "none":
        id_ = None
    elif id_ is None:
        raise Invalid("An id is required for a linked record.")
    elif point_lookup(ws.scoped(f"{kind}s"), id_).isEmpty():
        raise Invalid(f"Linked {kind} does not exist.")
    return {"related_entity_type": kind, "related_entity_id": id_, "document_id": id_ if kind == "document" else None}


def create_note(ws: Workspace, request: Mapping[str, Any]) -> tuple[Workspace, int]:
    title, content = T.query_text(request.get("title")), T.query_text(request.get("content"))
    if not title:
        raise Invalid("title is required.")
    values = {"title": title, "content": content, "body": content} | _values("notes", {"note_type": request.get("note_type")})
    values |= _note_link(ws, request.get("related_entity_type"), request.get("related_entity_id"))
    new = insert(ws.notes, "notes", values, ws.anchor)
    return ws.with_tables(notes=new), new.agg(F.max("id")).first()[0]


def update_note(ws: Workspace, id_: int, request: Mapping[str, Any]) -> Workspace:
    """Where the request doesn't name the link, the one in effect is checked and stored, an old document_id included."""
    old = _row(ws.scoped("notes"), id_, "note")
    legacy = old.document_id if (old.document_id or 0) > 0 else None
    kind = T.query_text(old.related_entity_type).lower() or ("document" if legacy else "none")
    link = old.related_entity_id if (old.related_entity_id or 0) > 0 else legacy
    title = T.query_text(request["title"]) if "title" in request else old.title or ""
    content = T.query_text(request["content"]) if "content" in request else old.content or old.body or ""
    if not title:
        raise Invalid("title is required.")
    values = {"title": title, "content": content, "body": content} | _values("notes", {"note_type": request.get("note_type", old.note_type)})
    values |= _note_link(ws, request.get("related_entity_type", kind), request.get("related_entity_id", link))
    return ws.with_tables(notes=patch(ws.notes, F.col("id") == id_, values | {"updated_at": now()}))


def delete_note(ws: Workspace, id_: int) -> Workspace:
    _row(ws.scoped("notes"), id_, "note")
    return ws.with_tables(notes=ws.notes.filter(F.col("id") != id_))


def update_document(ws: Workspace, id_: int, request: Mapping[str, Any]) -> Workspace:
    old = _row(ws.documents, id_, "document")
    values = {c: getattr(old, c) or "" for c in TEXTS["documents"]} | _values("documents", request)
    for c in REQUIRED["documents"]:
        if not values[c]:
            raise Invalid(f"{c} is required.")
    if isinstance(request.get("is_favorite"), bool):
        values["is_favorite"] = request["is_favorite"]
    return ws.with_tables(documents=patch(ws.documents, F.col("id") == id_, values | {"updated_at": now()}))


def delete_report(ws: Workspace, id_: int) -> DataFrame:
    """One row: what a deletion of the document removes or clears. file_removed only tells that a file name is known."""
    ours = F.col("document_id") == id_
    note = (F.col("related_entity_type") == "document") & (F.col("related_entity_id") == id_)
    named = (T.blank_to(F.col("stored_filename"), T.base_name(F.coalesce("file_path", F.lit("")))) != "") & (F.col("id") == id_)
    parts = [
        ws.symptom_documents.agg(F.count_if(ours).alias("symptom_links_removed")),
        ws.procedure_documents.agg(F.count_if(ours).alias("procedure_links_removed")),
        ws.notes.agg(F.count_if(note).alias("note_links_cleared")),
        ws.documents.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("file_removed")),
    ]
    return reduce(DataFrame.crossJoin, parts)


def clear_note_links(notes: DataFrame, id_: int, at: Column) -> DataFrame:
    """Notes that link to the document link to nothing; any other mention of it as document_id becomes null."""
    linked = (F.col("related_entity_type") == "document") & (F.col("related_entity_id") == id_)
    notes = patch(notes, F.coalesce(linked, F.lit(False)), {"related_entity_type": "none", "related_entity_id": None, "document_id": None, "updated_at": at})
    return patch(notes, F.coalesce(F.col("document_id") == id_, F.lit(False)), {"document_id": None})


def delete_document(ws: Workspace, id_: int) -> tuple[Workspace, DataFrame]:
    """The workspace without the document, and the report about it. ingest.delete_document() removes the file too."""
    _row(ws.documents, id_, "document")
    report = delete_report(ws, id_)
    keep = F.col("document_id") != id_
    return (
        ws.with_tables(
            notes=clear_note_links(ws.notes, id_, now()),
            documents=ws.documents.filter(F.col("id") != id_),
            symptom_documents=ws.symptom_documents.filter(keep),
            procedure_documents=ws.procedure_documents.filter(keep),
        ),
        report,
    )


def update_vehicle(ws: Workspace, year: object, make: object, model: object, trim: object = "", engine: object = "") -> Workspace:
    """The anchor's profile; the year is a whole number from 1900 to 2100."""
    number = identifier(year)
    if number is None or not 1900 <= number <= 2100:
        raise Invalid("year must be from 1900 to 2100.")
    texts = {c: T.query_text(v) for c, v in {"make": make, "model": model, "trim": trim, "engine": engine}.items()}
    if not texts["make"] or not texts["model"]:
        raise Invalid("make and model are required.")
    first = ws.anchor.first()[0]
    return ws.with_tables(vehicles=patch(ws.vehicles, F.col("id") == first, {"year": number} | texts))


def document_defaults(ws: Workspace, systems: list[str], types: list[str]) -> DataFrame:
    """The stored lists, or the given ones where none is stored."""
    return ws.app_settings.filter("id = 1").select(T.parse_list(F.col("document_system_defaults"), systems).alias("systems"), T.parse_list(F.col("document_type_defaults"), types).alias("types"))


def settings(ws: Workspace, runtime: DataFrame, systems: list[str], types: list[str]) -> DataFrame:
    """The settings as a whole, one row of structs: vehicle, runtime (config.runtime_settings()), document_defaults and backup. The given lists stand in where none is stored."""
    stored = document_defaults(ws, systems, types).select(F.struct("*").alias("stored"))
    given = F.struct(F.array(*map(F.lit, systems)).alias("systems"), F.array(*map(F.lit, types)).alias("types"))
    rows = ws.spark.range(1).join(F.broadcast(stored), F.lit(True), "left").select(F.coalesce("stored", given).alias("document_defaults"))
    backup = F.struct(F.col("backup_supported").alias("supported")).alias("backup")
    parts = vehicle(ws).select(F.struct("*").alias("vehicle")), runtime.select(F.struct(*[c for c in runtime.columns if c != "backup_supported"]).alias("runtime"), backup)
    return reduce(DataFrame.crossJoin, parts, rows).select("vehicle", "runtime", "document_defaults", "backup")  # a row each


def update_document_defaults(ws: Workspace, systems: object, types: object) -> Workspace:
    lists = []
    for values, name in ((systems, "systems"), (types, "types")):
        found: dict[str, str] = {}
        for value in values if isinstance(values, (list, tuple)) else []:
            if T.query_text(value):
                found.setdefault(T.query_text(value).lower(), T.query_text(value))
        if not found:
            raise Invalid(f"{name} must hold a value.")
        lists.append(T.format_list(F.array(*map(F.lit, found.values()))))
    values = {"document_system_defaults": lists[0], "document_type_defaults": lists[1], "updated_at": now()}
    row = ws.spark.range(1).select(F.lit(1).alias("id"))
    table = insert_missing(ws.app_settings, conform(row, "app_settings"), ["id"])
    return ws.with_tables(app_settings=patch(table, F.col("id") == 1, values))


def backfill_document(documents: DataFrame, original_filename: str, file_type: str, subsystem: str, source: str) -> DataFrame:
    """Fills what a document loaded under this name lacks; its update time changes in any case."""
    fill = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in {"file_type": file_type, "subsystem": subsystem, "source": source, "page_count": 1}.items()}
    fill |= {"extraction_status": T.blank_to(F.col("extraction_status"), "completed"), "updated_at": now()}
    return patch(documents, F.coalesce(F.col("original_filename") == original_filename, F.lit(False)), fill)


def backfill_notes(notes: DataFrame) -> DataFrame:
    """Three steps in order. Content of spaces alone is looked at but stays, as only '' counts as none there."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    notes = patch(notes, blank("content"), {"content": F.coalesce(F.nullif("content", F.lit("")), "body", F.lit(""))})
    old = blank("related_entity_type") & F.col("document_id").isNotNull() & (F.col("related_entity_id").isNull() | (F.col("related_entity_id") <= 0))
    notes = patch(notes, old, {"related_entity_type": "document", "related_entity_id": F.col("document_id")})
    return patch(notes, blank("note_type"), {"note_type": "general"})


#: So many rows, about, come to a task that looks for broken rules. Tasks cut by bytes would get the more ids, the better those are packed.
ROWS = 1 << 19


def violations(ws: Workspace) -> DataFrame:
    """(rule, table, id) of rows that break a reference, a key or the rule that settings have one row.

    The tables are counted in one job at once, and tasks are as many as that asks for. A task
    holds the keys of its share of rows, or the ids of its share of a table, which go to all tasks if they are
    no more than one share. Rows that refer to ids pass by: an id that very many refer to needs no memory.
    """
    parts = []
    tables = ("documents", "symptoms", "procedures", "notes", "symptom_documents", "procedure_documents")
    counts = [getattr(ws, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in tables]
    n_rows = {r["table"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}

    def tasks(*names: str) -> int:
        return max(ws.spark.sparkContext.defaultParallelism, -(-max(n_rows[t] for t in names) // ROWS))

    def report(rows: DataFrame, rule: str, table: str, id_: str) -> None:
        parts.append(rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.col(id_).cast("long").alias("id")))

    def repeated(table: str, *key: str) -> None:
        rows = getattr(ws, table).select(*key).repartition(tasks(table), *key)
        report(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "unique", table, key[0])

    def missing(rows: DataFrame, kind: str, table: str, id_: str) -> None:
        key, there = f"{kind}_id", f"{kind}s"
        ids = getattr(ws, there).select(F.col("id").alias(key))
        ids = F.broadcast(ids) if n_rows[there] <= ROWS else ids.repartition(tasks(there, table), key).hint("shuffle_hash")
        report(rows.join(ids, key, "left_anti"), kind, table, id_)

    vehicles = ws.vehicles.select(F.col("id").alias("vehicle_id"))
    for table in ("documents", "symptoms", "procedures", "notes"):
        report(getattr(ws, table).join(vehicles, "vehicle_id", "left_anti"), "vehicle", table, "id")
        repeated(table, "id")
    for kind in ("symptom", "procedure"):
        table = f"{kind}_documents"
        missing(getattr(ws, table), "document", table, "document_id")
        missing(getattr(ws, table), kind, table, f"{kind}_id")
        repeated(table, f"{kind}_id", "document_id")
    missing(ws.notes.filter("document_id IS NOT NULL"), "document", "notes", "id")
    report(ws.app_settings.filter("id <> 1"), "single", "app_settings", "id")
    return reduce(DataFrame.unionByName, parts)
