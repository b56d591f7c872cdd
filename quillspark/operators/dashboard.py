"""Counts, top sections and the activity feed of a workspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.workspace import Workspace

SECTION, FEED = 5, 8
ACTIVE = ["open", "monitoring"]


def note_title(c: str = "title") -> Column:
    """Only spaces count as blank here."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Untitled note"))


def counts(ws: Workspace) -> DataFrame:
    """Six counts in one row: one pass over each table, and joins of one-row results."""
    documents = ws.scoped("documents").agg(F.count("*").alias("documents"), F.count_if("is_favorite").alias("favorites"))
    symptoms = ws.scoped("symptoms").agg(F.count("*").alias("symptoms"), F.count_if(F.col("status").isin(ACTIVE)).alias("active_symptoms"))
    procedures = ws.scoped("procedures").agg(F.count("*").alias("procedures"))
    notes = ws.scoped("notes").agg(F.count("*").alias("notes"))
    return reduce(DataFrame.crossJoin, [documents, symptoms, procedures, notes])


def top(df: DataFrame, n: int = SECTION) -> DataFrame:
    """The n rows updated last: each task keeps n, so nothing is sorted as a whole."""
    return df.orderBy(F.col("updated_at").desc_nulls_last(), F.desc("id")).limit(n)


def _documents(ws: Workspace) -> DataFrame:
    return ws.scoped("documents").select("id", "title", "system", "document_type", "is_favorite", "created_at", "updated_at")


def favorites(ws: Workspace, n: int = SECTION) -> DataFrame:
    return top(_documents(ws).filter("is_favorite"), n)


def recent_documents(ws: Workspace, n: int = SECTION) -> DataFrame:
    return top(_documents(ws), n)


def recent_symptoms(ws: Workspace, n: int = SECTION, active: bool = False) -> DataFrame:
    rows = ws.scoped("symptoms").select("id", "title", "system", "confidence", "status", "created_at", "updated_at")
    return top(rows.filter(F.col("status").isin(ACTIVE)) if active else rows, n)


def recent_procedures(ws: Workspace, n: int = SECTION) -> DataFrame:
    return top(ws.scoped("procedures").select("id", "title", "system", "difficulty", "confidence", "created_at", "updated_at"), n)


def recent_notes(ws: Workspace, n: int = SECTION) -> DataFrame:
    return top(ws.scoped("notes").select("id", note_title().alias("title"), "note_type", "related_entity_type", "created_at", "updated_at"), n)


def recent_activity(ws: Workspace, n: int = FEED) -> DataFrame:
    """The last n of all four tables. Each table gives at most its own last n to the union."""
    parts = []
    for kind in ("document", "symptom", "procedure", "note"):
        title = note_title() if kind == "note" else F.col("title")
        rows = ws.scoped(f"{kind}s").select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), title.alias("title"), F.coalesce("updated_at", "created_at").alias("updated_at"))
        parts.append(rows.orderBy(F.col("updated_at").desc_nulls_last(), F.desc("entity_id")).limit(n))
    feed = reduce(DataFrame.unionByName, parts).orderBy(F.col("updated_at").desc_nulls_last(), F.desc("entity_id"), "entity_type").limit(n)
    return feed.select(F.concat("entity_type", F.lit("-"), F.col("entity_id").cast("string")).alias("key"), "entity_type", "entity_id", F.initcap("entity_type").alias("type_label"), "title", "updated_at")


def vehicle(ws: Workspace) -> DataFrame:
    """The anchor's row; what it lacks is ''."""
    return ws.vehicles.orderBy("id").limit(1).select("id", "year", *[T.blank_to(F.col(c), "").alias(c) for c in ("make", "model", "trim", "engine")])


def dashboard(ws: Workspace) -> dict[str, DataFrame]:
    """Every section by name; each is planned on its own and runs when it is asked for."""
    return {
        "vehicle": vehicle(ws),
        "summary": counts(ws),
        "favorite_documents": favorites(ws),
        "recent_documents": recent_documents(ws),
        "recent_symptoms": recent_symptoms(ws),
        "active_symptoms": recent_symptoms(ws, active=True),
        "recent_procedures": recent_procedures(ws),
        "recent_notes": recent_notes(ws),
        "recent_activity": recent_activity(ws),
    }


def vehicle_profile(ws: Workspace) -> DataFrame:
    """The anchor's non-blank parts joined by spaces."""
    return ws.vehicles.orderBy("id").limit(1).select("id", T.join_parts(*[F.col(c) for c in ("year", "make", "model", "trim", "engine")]).alias("label"))
