"""Keyword search: filters, matching, additive relevance by field, snippets and order.

Document search folds ASCII letters only, matches untrimmed values and reads %
and _ of the query as wildcards. The other searches fold all letters, match
trimmed values and take the query literally.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.specs import DOCUMENTS, NOTES, PROCEDURES, SYMPTOMS, Field, Search
from ..sources.workspace import Workspace
from . import facets, links


def equals(df: DataFrame, **filters: object) -> DataFrame:
    """Rows with these values; a filter of '' or None doesn't apply, nor does a value that isn't a string."""
    for column, value in filters.items():
        if isinstance(value, str) and value:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def newest(date: str = "updated_at") -> list[Column]:
    return [F.col(date).desc_nulls_last(), F.col("id").desc()]


def _like(f: Field, q: str) -> Column:
    return F.coalesce(F.col(f.column), F.lit("")).rlike(T.wildcard_pattern(q))


def _contains(f: Field, q: str) -> Column:
    return F.contains(T.search_form(F.col(f.column)), F.lit(q))


def relevance(fields: tuple[Field, ...], q: str) -> Column:
    """Sum over fields of the exact weight where the value is the query, else of the weight where it holds it."""
    if not q:
        return F.lit(0)
    return reduce(add, [F.when(T.search_form(F.col(f.column)) == q, f.exact_weight).when(_contains(f, q), f.weight).otherwise(0) for f in fields])


def document_relevance(q: str) -> Column:
    if not q:
        return F.lit(0)
    parts = []
    for f in DOCUMENTS.fields:
        exact = F.when(T.ascii_lower(F.col(f.column)) == q, f.exact_weight) if f.exact else None
        partial = (F.when if exact is None else exact.when)(_like(f, q), f.weight)
        parts.append(partial.otherwise(0))
    return reduce(add, parts)


def _found(df: DataFrame, score: Column, fields: list[Field], hit, query: str) -> DataFrame:
    """df with relevance_score, snippet and snippet_field of the first field that hits, '' without one.

    Steps build on each other, so that each row is looked through once for its field and one text is cleaned and cut.
    """
    nothing, columns = F.lit(""), df.columns
    by = lambda values: T.first_of([(F.col("_field") == i, v) for i, v in enumerate(values)], nothing)
    first = df.select("*", score.alias("relevance_score"), T.first_of([(hit(f), F.lit(i)) for i, f in enumerate(fields)], F.lit(-1)).alias("_field"))
    clean = first.select("*", T.collapse(by([F.coalesce(F.col(f.column), nothing) for f in fields])).alias("_clean"), by([F.lit(f.label) for f in fields]).alias("snippet_field"))
    return clean.select(*columns, "relevance_score", T.cut(F.col("_clean"), query).alias("snippet"), "snippet_field")


def search(rows: DataFrame, spec: Search, query: object = "", sort: str = "relevance", attach: Callable[[DataFrame], DataFrame] | None = None, **filters: object) -> DataFrame:
    """Rows that match, with relevance_score, snippet and snippet_field, in order.

    attach: adds columns to the rows that are found, before they are put in order.
    sort: 'title' without case and accents, 'newest', or else by relevance; without a query by newest.
    """
    q = T.query_text(query)
    lowered = q.lower()
    rows = equals(rows, **filters)
    if q:
        rows = rows.filter(reduce(or_, [_contains(f, lowered) for f in spec.fields]))
        shown = spec.ordered(spec.snippets), lambda f: _contains(f, lowered)
    else:
        shown = spec.ordered(spec.previews), lambda f: T.normalize(F.col(f.column)) != ""
    out = _found(rows, relevance(spec.fields, lowered), *shown, q)
    out = attach(out) if attach else out
    if sort == "title":
        return out.orderBy(F.collate(F.coalesce("title", F.lit("")), "UNICODE_CI_AI"), *newest())
    if sort == "newest" or not q:
        return out.orderBy(*newest())
    return out.orderBy(F.desc("relevance_score"), *newest())


def search_documents(documents: DataFrame, query: object = "", system: object = "", document_type: object = "", favorite: object = "", sort: str = "relevance") -> DataFrame:
    """favorite: only 'true' filters. Order is by creation, not by update."""
    q = T.query_text(query)
    lowered = q.lower()
    rows = equals(documents, system=system, document_type=document_type)
    if favorite == "true":
        rows = rows.filter("is_favorite")
    if q:
        rows = rows.filter(reduce(or_, [_like(f, lowered) for f in DOCUMENTS.fields]))
        shown = list(DOCUMENTS.fields), lambda f: F.contains(F.lower(F.coalesce(F.col(f.column), F.lit(""))), F.lit(lowered))
    else:
        shown = DOCUMENTS.ordered(DOCUMENTS.previews), lambda f: T.normalize(F.col(f.column)) != ""
    out = _found(rows, document_relevance(lowered), *shown, q)
    if sort == "title":
        return out.orderBy(T.ascii_lower(F.col("title")).asc_nulls_first(), *newest("created_at"))
    if sort == "relevance" and q:
        return out.orderBy(F.desc("relevance_score"), *newest("created_at"))
    return out.orderBy(*newest("created_at"))


def search_linked(ws: Workspace, kind: str, **request: object) -> DataFrame:
    """search() of symptoms or procedures: what they link to is looked up for the rows that are found."""
    rows, spec, bridge = {"symptom": (links.symptom_rows, SYMPTOMS, ws.symptom_documents), "procedure": (links.procedure_rows, PROCEDURES, ws.procedure_documents)}[kind]
    few = any(T.query_text(v) for k, v in request.items() if k != "sort")
    return search(rows(ws.scoped(f"{kind}s")), spec, attach=lambda found: links.with_links(found, bridge, f"{kind}_id", ws.documents, few), **request)


@dataclass(frozen=True)
class Response:
    """What a search answers: rows in order, their number (one row), and the options of its filters over all rows of the kind."""

    results: DataFrame
    total: DataFrame
    filters: DataFrame


#: Filters of each kind of search, with the name of their option list.
FILTERS = {
    "documents": {"system": "systems", "document_type": "document_types"},
    "symptoms": {"system": "systems", "status": "statuses"},
    "procedures": {"system": "systems", "difficulty": "difficulties"},
    "notes": {"note_type": "note_types", "related_entity_type": "related_entity_types"},
}


def respond(ws: Workspace, kind: str, **request: object) -> Response:
    """Any of the four searches as a whole. Filters come from rows that no filter has touched, so they can be widened again."""
    options = {name: column for column, name in FILTERS[kind].items()}
    if kind == "documents":
        # T.query_text is applied inside: only strings count
        results = search_documents(links.documents(ws), **request)
        return Response(results, results.agg(F.count("*").alias("total")), facets.several(ws.documents, options, "stored"))
    plain = {"symptoms": links.symptom_rows, "procedures": links.procedure_rows}
    results = search_linked(ws, kind.removesuffix("s"), **request) if kind in plain else search(links.notes(ws), NOTES, **request)
    return Response(results, results.agg(F.count("*").alias("total")), facets.several(plain[kind](ws.scoped(kind)) if kind in plain else links.notes(ws), options))
