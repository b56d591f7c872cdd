"""The registered queries over the given tables and, for each, the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, dashboard, facets, history, links, mutations, search, trigrams
from ..sources import checkpoints, config, ingest, snapshots
from ..sources.workspace import Workspace, conform, dealt, insert_missing, point_lookup
from . import specs
from .bindings import WS, ascii_lower, collapse, normalize, preview, read, snippet, sql, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None, build: Callable[[Workspace], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
    if oracle:
        ORACLE_SQL[name] = sql(oracle)


def on_table(name: str, oracle: str | None, table: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(read(spark, sf_dir, table))
    if oracle:
        ORACLE_SQL[name] = oracle


def ranked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", *columns, "relevance_score", "snippet", "snippet_field")


# --- searches ---------------------------------------------------------------------------------


def _document_search(q: str, where: str = "true") -> str:
    """All four fields; notes are null in these tables."""
    p = q.lower()
    fields = {"title": ("Title", 900, 400), "original_filename": ("Filename", 700, 300), "extracted_text": ("Extracted text", None, 100)}
    hit = {c: f"{ascii_lower(c)} LIKE '%{p}%'" for c in fields}
    score = " + ".join(f"CASE {f'''WHEN {ascii_lower(c)} = '{p}' THEN {e}''' if e else ''} WHEN {hit[c]} THEN {w} ELSE 0 END" for c, (_, e, w) in fields.items())
    literal = {c: f"contains(lower({c}), '{p}')" for c in fields}
    chosen = "CASE " + " ".join(f"WHEN {literal[c]} THEN {c}" for c in fields) + " ELSE '' END"
    label = "CASE " + " ".join(f"WHEN {literal[c]} THEN '{fields[c][0]}'" for c in fields) + " ELSE '' END"
    return f""", hits AS (SELECT *, {score} relevance_score, {label} snippet_field, {collapse(chosen)} clean FROM ws_documents WHERE ({" OR ".join(hit.values())}) AND {where})
    SELECT id, title, "system", document_type, is_favorite, relevance_score, {snippet("clean", q)} snippet, snippet_field FROM hits"""


def _documents(ws: Workspace, **request: str) -> DataFrame:
    return ranked(search.search_documents(links.documents(ws), **request), "title", "system", "document_type", "is_favorite")


_NO_QUERY = f""", rows AS (SELECT *, {collapse("extracted_text")} clean, {normalize("extracted_text")} <> '' full_text FROM ws_documents)
    SELECT id, title, "system", document_type, is_favorite, 0 relevance_score, {preview("CASE WHEN full_text THEN clean ELSE original_filename END")} snippet,
    CASE WHEN full_text THEN 'Extracted text' ELSE 'Filename' END snippet_field FROM rows"""

query("search_documents_relevance", _document_search("the"), lambda ws: _documents(ws, query="the"))
query("search_documents_newest", _NO_QUERY, lambda ws: _documents(ws, sort="newest"))
query("search_documents_title", _document_search("src1 document"), lambda ws: _documents(ws, query=" SRC1 document ", sort="title"))
query("search_documents_filtered", _document_search("de", "\"system\" = 'en' AND document_type = 'src3'"), lambda ws: _documents(ws, query="de", system="en", document_type="src3"))
query("search_documents_favorite", _document_search("a", "is_favorite"), lambda ws: _documents(ws, query="a", favorite="true"))
query("search_documents_wildcard", _document_search("t_e %e"), lambda ws: _documents(ws, query="t_e %e"))
query("search_documents_wildcards", _document_search("%t_e%%a _%s%"), lambda ws: _documents(ws, query="%t_e%%a _%s%"))
query("search_documents_all", _document_search("%_%"), lambda ws: _documents(ws, query="%_%"))
query("search_documents_accents", _document_search("é"), lambda ws: _documents(ws, query="É"))


def _literal_search(table: str, fields: dict[str, tuple[str, int, int]], order: list[str], q: str, columns: str, where: str = "true") -> str:
    """fields: column -> (label, exact, weight)."""
    p = q.lower()
    norm = {c: f"lower({normalize(c)})" for c in fields}
    hit = {c: f"contains({norm[c]}, '{p}')" for c in fields}
    score = " + ".join(f"CASE WHEN {norm[c]} = '{p}' THEN {e} WHEN {hit[c]} THEN {w} ELSE 0 END" for c, (_, e, w) in fields.items())
    chosen = "CASE " + " ".join(f"WHEN {hit[c]} THEN {c}" for c in order) + " ELSE '' END"
    label = "CASE " + " ".join(f"WHEN {hit[c]} THEN '{fields[c][0]}'" for c in order) + " ELSE '' END"
    return f""", hits AS (SELECT *, {score} relevance_score, {label} snippet_field, {collapse(chosen)} clean FROM {table} WHERE ({" OR ".join(hit.values())}) AND {where})
    SELECT id, {columns}, relevance_score, {snippet("clean", q)} snippet, snippet_field FROM hits"""


_P = {"title": ("Title", 900, 400), '"system"': ("System", 120, 120), "steps": ("Steps", 240, 240)}
_N = {"title": ("Title", 900, 400), "content": ("Content", 260, 260), "note_type": ("Note type", 100, 100), "linked_title": ("Linked item", 160, 160)}
_S = {"title": ("Title", 900, 400), '"system"': ("System", 120, 120), "suspected_causes": ("Suspected causes", 220, 220)}


def _procedures(ws: Workspace, **request: str) -> DataFrame:
    return ranked(search.search(links.procedures(ws), specs.PROCEDURES, **request), "title", "system", "difficulty")


_P_ALL = 'SELECT id, title, "system", difficulty, 0 relevance_score, title snippet, \'Title\' snippet_field FROM ws_procedures'
query("search_procedures_relevance", _literal_search("ws_procedures", _P, list(_P), "al", 'title, "system", difficulty'), lambda ws: _procedures(ws, query="AL"))
query(
    "search_procedures_title",
    _literal_search("ws_procedures", _P, list(_P), "1", 'title, "system", difficulty', "difficulty = 'beginner'"),
    lambda ws: _procedures(ws, query="1", difficulty="beginner", sort="title"),
)
query("search_procedures_no_query", _P_ALL, lambda ws: _procedures(ws, query="  "))
query("search_procedures_oldest_alias", _literal_search("ws_procedures", _P, list(_P), "brand#1", 'title, "system", difficulty'), lambda ws: _procedures(ws, query="brand#1", sort="oldest"))

_SYMPTOM_LINKS = f"""found AS (SELECT symptom_id id, count(*) n, string_agg(document_id, ',' ORDER BY {ascii_lower("title")}, document_id) ids
    FROM ws_symptom_documents JOIN ws_documents d ON d.id = document_id GROUP BY symptom_id)"""


def _joined_ids() -> F.Column:
    return F.array_join(F.transform("linked_document_ids", lambda i: i.cast("string")), ",").alias("linked_ids")


query(
    "search_symptoms_linked",
    f", {_SYMPTOM_LINKS}, searched AS (SELECT * FROM ({_literal_search('ws_symptoms', _S, list(_S), '12', 'title, status', chr(34) + 'system' + chr(34) + chr(32) + '= ' + chr(39) + '1-URGENT' + chr(39))[2:].replace('hits AS', 'WITH hits AS', 1)}))"
    " SELECT s.*, coalesce(n, 0) linked_document_count, coalesce(ids, '') linked_ids FROM searched s LEFT JOIN found USING (id)",
    lambda ws: search.search_linked(ws, "symptom", query="12", system="1-URGENT").select("id", "title", "status", "relevance_score", "snippet", "snippet_field", "linked_document_count", _joined_ids()),
)
query(
    "search_notes_polymorphic",
    _literal_search("ws_notes", _N, ["content", "title", "linked_title", "note_type"], "7", "title, note_type, related_entity_type, related_entity_id, linked_title", "related_entity_type = 'procedure'"),
    lambda ws: ranked(search.search(links.notes(ws), specs.NOTES, "7", related_entity_type="procedure"), "title", "note_type", "related_entity_type", "related_entity_id", "linked_title"),
)

# --- option lists --------------------------------------------------------------------------------


def _facets(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT '{f}' facet, {c} \"value\" FROM {table} WHERE trim({c}) <> ''" for f, c in columns.items())


query(
    "facets_documents",
    _facets("ws_documents", {"systems": '"system"', "document_types": "document_type"}),
    lambda ws: facets.several(ws.documents, {"systems": "system", "document_types": "document_type"}, "stored"),
)
query("facets_procedures", _facets("ws_procedures", {"systems": '"system"', "difficulties": "difficulty"}), lambda ws: facets.several(links.procedure_rows(ws.scoped("procedures")), {"systems": "system", "difficulties": "difficulty"}))
query("facets_symptoms", _facets("ws_symptoms", {"systems": '"system"', "statuses": "status"}), lambda ws: facets.several(links.symptom_rows(ws.scoped("symptoms")), {"systems": "system", "statuses": "status"}))
query("facets_notes", _facets("ws_notes", {"note_types": "note_type", "related_entity_types": "related_entity_type"}), lambda ws: facets.several(links.notes(ws), {"note_types": "note_type", "related_entity_types": "related_entity_type"}))
query("facet_counts", " UNION ALL ".join(f"SELECT '{f}' facet, {c} \"value\", count(*) n FROM ws_documents WHERE trim({c}) <> '' GROUP BY ALL" for f, c in {"systems": '"system"', "document_types": "document_type", "statuses": "extraction_status"}.items()),
      lambda ws: facets.counts(ws.documents, {"systems": "system", "document_types": "document_type", "statuses": "extraction_status"}, "stored"))
query("facet_counts_notes", " UNION ALL ".join(f"SELECT '{f}' facet, {c} \"value\", count(*) n FROM ws_notes WHERE {c} <> '' GROUP BY ALL" for f, c in {"note_types": "note_type", "related_entity_types": "related_entity_type"}.items()),
      lambda ws: facets.counts(links.notes(ws), {"note_types": "note_type", "related_entity_types": "related_entity_type"}))
query("client_options", 'SELECT DISTINCT "system" "value" FROM ws_procedures', lambda ws: facets.client_options(ws.procedures, "system"))
query(
    "suggestions_merge",
    """SELECT arg_min(v, (r, i, v)) "value", min((r, i))[1] "rank", min((r, i))[2] "at" FROM (
      SELECT v, 0 r, CAST(i AS BIGINT) i FROM (VALUES ('EN', 0), ('Klingon', 1), ('fr', 2), ('FR', 3)) t(v, i) UNION ALL SELECT DISTINCT "system", 1, 0 FROM ws_documents) GROUP BY lower(v)""",
    lambda ws: facets.suggestions(["EN", " Klingon", "fr", "FR", ""], ws.documents, "system"),
)

# --- dashboard -------------------------------------------------------------------------------------

query(
    "dashboard_counts",
    """SELECT (SELECT count(*) FROM ws_documents) documents, (SELECT count(*) FROM ws_documents WHERE is_favorite) favorites, (SELECT count(*) FROM ws_symptoms) symptoms,
    (SELECT count(*) FROM ws_symptoms WHERE status IN ('open', 'monitoring')) active_symptoms, (SELECT count(*) FROM ws_procedures) procedures, (SELECT count(*) FROM ws_notes) notes""",
    dashboard.counts,
)


def _top(table: str, columns: str, where: str = "true") -> str:
    return f"SELECT id, {columns}, updated_at FROM {table} WHERE {where} ORDER BY updated_at DESC, id DESC LIMIT 5"


_D = 'title, "system", document_type'
_NOTE_TITLE = "coalesce(nullif(trim(title), ''), 'Untitled note')"
query("dashboard_favorites", _top("ws_documents", _D, "is_favorite"), lambda ws: dashboard.favorites(ws).drop("is_favorite", "created_at"))
query("dashboard_recent_documents", _top("ws_documents", _D), lambda ws: dashboard.recent_documents(ws).drop("is_favorite", "created_at"))
query("dashboard_recent_symptoms", _top("ws_symptoms", 'title, "system", confidence, status'), lambda ws: dashboard.recent_symptoms(ws).drop("created_at"))
query("dashboard_active_symptoms", _top("ws_symptoms", 'title, "system", confidence, status', "status IN ('open', 'monitoring')"), lambda ws: dashboard.recent_symptoms(ws, active=True).drop("created_at"))
query("dashboard_recent_procedures", _top("ws_procedures", 'title, "system", difficulty, confidence'), lambda ws: dashboard.recent_procedures(ws).drop("created_at"))
query("dashboard_recent_notes", _top("ws_notes", f"{_NOTE_TITLE} title, note_type, related_entity_type"), lambda ws: dashboard.recent_notes(ws).drop("created_at"))
query(
    "recent_activity",
    f"""SELECT entity_type || '-' || entity_id "key", entity_type, entity_id, upper(entity_type[1]) || entity_type[2:] type_label, title, updated_at FROM (
      SELECT 'document' entity_type, id entity_id, title, updated_at FROM ws_documents UNION ALL SELECT 'symptom', id, title, updated_at FROM ws_symptoms
      UNION ALL SELECT 'procedure', id, title, updated_at FROM ws_procedures UNION ALL SELECT 'note', id, {_NOTE_TITLE}, updated_at FROM ws_notes)
    ORDER BY updated_at DESC, entity_id DESC, entity_type LIMIT 8""",
    dashboard.recent_activity,
)
query("profile_label", 'SELECT id, array_to_string(list_filter(["year"::VARCHAR, make, model, "trim"], lambda x: x <> \'\'), \' \') "label" FROM ws_vehicles ORDER BY id LIMIT 1', dashboard.vehicle_profile)

# --- lists -----------------------------------------------------------------------------------------

query(
    "list_documents",
    "SELECT d.id, title, original_filename, d.\"system\", document_type, extraction_status, page_count, is_favorite, \"year\" || ' ' || make || ' ' || model || ' ' || coalesce(\"trim\", 'null') vehicle_label FROM ws_documents d JOIN ws_vehicles v ON v.id = vehicle_id",
    lambda ws: links.list_documents(ws).select("id", "title", "original_filename", "system", "document_type", "extraction_status", "page_count", "is_favorite", "vehicle_label"),
)
query(
    "list_symptoms",
    f', {_SYMPTOM_LINKS} SELECT s.id, title, "system", confidence, status, coalesce(n, 0) linked_document_count, coalesce(ids, \'\') linked_ids FROM ws_symptoms s LEFT JOIN found USING (id)',
    lambda ws: links.listed(links.symptoms(ws)).select("id", "title", "system", "confidence", "status", "linked_document_count", _joined_ids()),
)
query(
    "list_procedures",
    f""", found AS (SELECT procedure_id id, count(*) n, string_agg(document_id, ',' ORDER BY {ascii_lower("title")}, document_id) ids FROM ws_procedure_documents JOIN ws_documents d ON d.id = document_id GROUP BY procedure_id)
    SELECT p.id, title, "system", difficulty, confidence, coalesce(n, 0) linked_document_count, coalesce(ids, '') linked_ids FROM ws_procedures p LEFT JOIN found USING (id)""",
    lambda ws: links.listed(links.procedures(ws)).select("id", "title", "system", "difficulty", "confidence", "linked_document_count", _joined_ids()),
)
_N_COLUMNS = ["id", "title", "content", "note_type", "related_entity_type", "related_entity_id", "linked_title"]
query("list_notes", f"SELECT {', '.join(_N_COLUMNS)} FROM ws_notes", lambda ws: links.listed(links.notes(ws)).select(*_N_COLUMNS))
query("linked_counts", ", counted AS (SELECT symptom_id id, count(*) n FROM ws_symptom_documents GROUP BY symptom_id) SELECT s.id, coalesce(n, 0) linked_count FROM ws_symptoms s LEFT JOIN counted USING (id)",
      lambda ws: ws.symptoms.select("id").join(ws.symptom_documents.distinct().groupBy(F.col("symptom_id").alias("id")).agg(F.count("document_id").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("linked_count")))

# --- second layer ----------------------------------------------------------------------------------

query("browse_symptoms_active", "SELECT id, title, status FROM ws_symptoms WHERE status IN ('open', 'monitoring') AND (contains(lower(title), '9') OR contains(lower(\"system\"), '9') OR contains(lower(suspected_causes), '9'))",
      lambda ws: browse.ordered(browse.keyword(ws.symptoms.filter(browse.status_filter("active")), "9", browse.SYMPTOM_FIELDS), dates=("updated_at",)).select("id", "title", "status"))
query("browse_documents_extraction", "SELECT id, title, extraction_status FROM ws_documents WHERE extraction_status LIKE 'failed%' AND NOT is_favorite",
      lambda ws: browse.ordered(ws.documents.filter(browse.extraction_filter("failed") & browse.favorite_filter("not_favorites")), "title", accents=False).select("id", "title", "extraction_status"))
query("browse_notes_by_link", "SELECT id, title, note_type FROM ws_notes WHERE related_entity_type = 'none' AND note_type = 'click'",
      lambda ws: browse.ordered(browse.choose(links.notes(ws), related_entity_type="none", note_type="click", title="all"), "oldest").select("id", "title", "note_type"))
query("browse_procedures_search", "SELECT id, title, difficulty FROM ws_procedures WHERE difficulty = 'advanced' AND (contains(lower(title), 'a') OR contains(lower(\"system\"), 'a') OR contains(lower(steps), 'a'))",
      lambda ws: browse.ordered(browse.keyword(browse.choose(ws.procedures, difficulty="advanced", confidence="all"), "A", browse.PROCEDURE_FIELDS), "title").select("id", "title", "difficulty"))
query("status_histogram", "SELECT count(*) total, count(*) FILTER (status NOT IN ('monitoring', 'resolved')) \"open\", count(*) FILTER (status = 'monitoring') monitoring, count(*) FILTER (status = 'resolved') resolved FROM ws_symptoms",
      lambda ws: browse.status_histogram(ws.symptoms))
query("visible_counts", "SELECT count(*) FILTER (status = 'open') visible, count(*) total, 'Showing ' || count(*) FILTER (status = 'open') || ' of ' || count(*) || ' symptoms' sentence FROM ws_symptoms",
      lambda ws: browse.visible_counts(ws.symptoms, browse.status_filter("open"), "symptom"))
query("default_selection", "SELECT id, title FROM ws_procedures ORDER BY CASE id WHEN 999999999 THEN 0 WHEN 77 THEN 1 ELSE 2 END, updated_at DESC, id DESC LIMIT 1",
      lambda ws: browse.selection(ws.procedures, 999999999, 77).select("id", "title"))
query("anchor_lookup", "SELECT min(id) vehicle_id FROM ws_vehicles", lambda ws: ws.anchor)
query("point_lookup", "SELECT id, title, status FROM ws_symptoms WHERE id = 7", lambda ws: point_lookup(ws.symptoms, 7).select("id", "title", "status"))

# --- scalar functions ------------------------------------------------------------------------------

query("labelize", "SELECT id, upper(note_type[1]) || note_type[2:] \"label\", CASE WHEN related_entity_type = 'none' THEN 'No link' ELSE upper(related_entity_type[1]) || related_entity_type[2:] END type_label FROM ws_notes",
      lambda ws: ws.notes.select("id", T.labelize(F.col("note_type")).alias("label"), links.type_label(F.col("related_entity_type"), "No link").alias("type_label")))
query("link_titles", "SELECT id, CASE WHEN related_entity_type = 'none' THEN 'No link' WHEN linked_title <> '' THEN linked_title ELSE upper(related_entity_type[1]) || related_entity_type[2:] || ' #' || related_entity_id END link_title FROM ws_notes",
      lambda ws: links.notes(ws).select("id", links.link_title().alias("link_title")))
query("notes_old_links", "SELECT id, CASE WHEN related_entity_type = 'document' AND related_entity_id IS NULL THEN 'none' ELSE related_entity_type END related_entity_type, related_entity_id, linked_title FROM ws_notes",
      lambda ws: links.notes(ws.with_tables(notes=ws.notes.withColumns({"document_id": F.when(F.col("related_entity_type") == "document", F.col("related_entity_id")), "related_entity_id": F.when(F.col("related_entity_type") != "document", F.col("related_entity_id")), "related_entity_type": F.when(F.col("related_entity_type") == "document", "  ").otherwise(F.col("related_entity_type"))}))).select("id", "related_entity_type", "related_entity_id", "linked_title"))
query("notes_old_bodies", "SELECT id, content FROM ws_links", lambda ws: links.notes(ws.with_tables(notes=ws.notes.withColumns({"body": F.col("content"), "content": F.when(F.col("id") % 2 == 0, "").otherwise(F.col("content"))}))).select("id", "content"))
query("search_symptoms_description", f", described AS (SELECT *, 'seen ' || id % 13 description, 'note ' || id % 7 notes FROM ws_symptoms) SELECT * FROM ({_literal_search('described', _S | {'description': ('Description', 250, 250), 'notes': ('Notes', 140, 140)}, ['title', 'description', chr(34) + 'system' + chr(34), 'suspected_causes', 'notes'], 'e 6', 'title')[2:].replace('hits AS', 'WITH hits AS', 1)})",
      lambda ws: ranked(search.search(ws.symptoms.withColumns({"description": F.concat(F.lit("seen "), (F.col("id") % 13).cast("string")), "notes": F.concat(F.lit("note "), (F.col("id") % 7).cast("string"))}), specs.SYMPTOMS, "E 6"), "title"))
query("link_meta", "SELECT id, link_meta FROM ws_notes", lambda ws: links.notes(ws).select("id", links.link_meta().alias("link_meta")))
query("deep_links", "SELECT id, CASE WHEN related_entity_type = 'none' OR related_entity_id = 0 THEN '/dashboard' ELSE '/' || related_entity_type || 's?' || related_entity_type || 'Id=' || related_entity_id || '#' || related_entity_type || '-library' END url FROM ws_links",
      lambda ws: ws.notes.select("id", T.entity_link(F.col("related_entity_type"), F.col("related_entity_id")).alias("url")))
query("display_times", "SELECT id, strftime(updated_at, '%b %-d, %Y, %-I:%M %p') shown FROM ws_symptoms", lambda ws: ws.symptoms.select("id", T.display_time(F.col("updated_at")).alias("shown")))
query("extraction_classes", "SELECT id, CASE WHEN starts_with(extraction_status, 'failed') THEN 'failed' ELSE extraction_status END class FROM ws_documents", lambda ws: ws.documents.select("id", T.extraction_class(F.col("extraction_status")).alias("class")))

_EXT = r"regexp_extract(url, '(?s)[^.].*?(\.[^.]*)\z', 1)"
_BASENAME = r"regexp_extract(url, '([^/]*)/*\z', 1)"
_EXT = _EXT.replace("url", _BASENAME)
_STEM = f"substr({_BASENAME}, 1, length({_BASENAME}) - length({_EXT}))"
on_table("filename_titles", f"SELECT page_id, {_BASENAME} \"name\", {_EXT} \"extension\", coalesce(nullif({collapse(f'''regexp_replace({_STEM}, '[_-]+', ' ', 'g')''')}, ''), 'Untitled Document') title, CASE WHEN lower({_EXT}) = '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END mime FROM pages",
         "pages", lambda p: p.select("page_id", T.base_name(F.col("url")).alias("name"), T.extension(F.col("url")).alias("extension"), T.title_from_filename(F.col("url")).alias("title"), T.mime_type(F.col("url")).alias("mime")))
_CUT = f"CASE WHEN {_EXT} = lower({_EXT}) THEN {_STEM} ELSE {_BASENAME} END"
_SAFE = _CUT
for _pattern, _value in ((r'[<>:"/\\|?*\x00-\x1f]', "-"), (f"{WS}+", "-"), ("-+", "-"), (r"[. ]+\z", ""), ("^[-. ]+", "")):
    _SAFE = f"regexp_replace({_SAFE}, '{_pattern}', '{_value}', 'g')"
on_table("safe_filenames", f"SELECT page_id, coalesce(nullif({_SAFE}, ''), 'document') || lower({_EXT}) safe FROM pages", "pages", lambda p: p.select("page_id", T.safe_filename(F.col("url")).alias("safe")))
on_table("json_list", "SELECT event_id, '[\"' || event_type || '\",\"' || user_id || '\"]' \"list\", 2 size FROM events", "events",
         lambda e: dealt(e.select("event_id", "event_type", "user_id"), "event_id").select("event_id", T.format_list(T.parse_list(F.to_json(F.array("event_type", F.col("user_id").cast("string"), F.concat(F.lit(" "), F.upper("event_type")))), ["none"])).alias("list"), F.size(T.parse_list(F.concat(F.lit('["a", 1, "b"]'), F.lit("")), ["none"])).alias("size")))
on_table("line_list", f"""SELECT doc_id, coalesce(string_agg(v, chr(10) ORDER BY i), '') "lines", count(v) n FROM (
      SELECT doc_id, arg_min(v, i) v, min(i) i FROM (SELECT doc_id, {normalize('unnest(p)')} v, unnest(range(len(p))) i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') p FROM documents)) WHERE v <> '' GROUP BY doc_id, lower(v)
      UNION ALL SELECT doc_id, NULL, 0 FROM documents) GROUP BY doc_id""", "documents",
         lambda d: d.select("doc_id", T.parse_lines(F.coalesce("text", F.lit(""))).alias("l")).select("doc_id", T.format_lines(F.col("l")).alias("lines"), F.size("l").cast("long").alias("n")))

# --- changes, as what they make of the tables ----------------------------------------------------

query("update_patch", "SELECT id, title, CASE WHEN id = 3 THEN 'resolved' ELSE status END status, CASE WHEN id = 3 THEN 'high' ELSE confidence END confidence FROM ws_symptoms",
      lambda ws: mutations.update_symptom(ws, 3, {"status": " Resolved", "confidence": "HIGH"}).symptoms.select("id", "title", "status", "confidence"))
query("insert_validated", "SELECT id, title, note_type, related_entity_type, related_entity_id FROM ws_links UNION ALL SELECT (SELECT max(id) FROM ws_links) + 1, 'New', 'reminder', 'procedure', 5",
      lambda ws: mutations.create_note(ws, {"title": " New ", "note_type": "reminder", "related_entity_type": "procedure", "related_entity_id": "5"})[0].notes.select("id", "title", "note_type", "related_entity_type", "related_entity_id"))
query("delete_cascade", "SELECT l_orderkey symptom_id, l_partkey document_id FROM lineitem WHERE l_orderkey <> 7", lambda ws: mutations.delete_symptom(ws, 7).symptom_documents)
query("delete_document_report", "SELECT (SELECT count(*) FROM lineitem WHERE l_partkey = 9) symptom_links_removed, (SELECT count(*) FROM lineitem WHERE l_suppkey = 9) procedure_links_removed, (SELECT count(*) FROM ws_links WHERE related_entity_type = 'document' AND related_entity_id = 9) note_links_cleared, false file_removed",
      lambda ws: mutations.delete_document(ws, 9)[1])
query("delete_document_notes", "SELECT id, CASE WHEN related_entity_type = 'document' AND related_entity_id = 9 THEN 'none' ELSE related_entity_type END related_entity_type, CASE WHEN NOT (related_entity_type = 'document' AND related_entity_id = 9) THEN related_entity_id END related_entity_id FROM ws_links",
      lambda ws: mutations.delete_document(ws, 9)[0].notes.select("id", "related_entity_type", "related_entity_id"))
query("replace_links", "SELECT l_orderkey symptom_id, l_partkey document_id FROM lineitem WHERE l_orderkey <> 7 UNION ALL SELECT 7, id FROM ws_documents WHERE id IN (1, 2, 3)",
      lambda ws: mutations.update_symptom(ws, 7, {"linked_document_ids": [1, "2", 2, 3, -4, "x", 10**12]}).symptom_documents)
query("backfill_notes", "SELECT id, content, CASE WHEN related_entity_type IS NULL AND doc IS NOT NULL THEN 'document' ELSE related_entity_type END related_entity_type, CASE WHEN related_entity_type IS NULL AND doc IS NOT NULL THEN doc ELSE related_entity_id END related_entity_id, coalesce(note_type, 'general') note_type FROM (SELECT id, content, nullif(related_entity_type, 'none') related_entity_type, related_entity_id, CASE WHEN id % 2 = 0 THEN id END doc, nullif(note_type, 'click') note_type FROM ws_links)",
      lambda ws: mutations.backfill_notes(ws.notes.withColumns({"body": F.col("content"), "content": F.lit(""), "related_entity_type": F.nullif("related_entity_type", F.lit("none")), "document_id": F.when(F.col("id") % 2 == 0, F.col("id")), "note_type": F.nullif("note_type", F.lit("click"))})).select("id", "content", "related_entity_type", "related_entity_id", "note_type"))
query("seed_insert", "SELECT id, make FROM ws_vehicles UNION ALL SELECT 1000, 'NEW'", lambda ws: insert_missing(ws.vehicles.select("id", "make"), ws.spark.createDataFrame([(1000, "NEW"), (1, "other")], "id long, make string"), ["id"]))
query("semi_existing_ids", "SELECT DISTINCT l_partkey id FROM lineitem SEMI JOIN ws_documents d ON d.id = l_partkey", lambda ws: links.existing(ws.symptom_documents.select(F.col("document_id").alias("id")), ws.documents))
query("dangling_links", "SELECT id, related_entity_type, related_entity_id FROM ws_notes WHERE related_entity_type <> 'none' AND (linked_id IS NULL OR (related_entity_type = 'document' AND linked_id % 5 = 0))",
      lambda ws: links.dangling(ws.with_tables(documents=ws.documents.filter("id % 5 <> 0"))))
query("constraint_report", """SELECT "rule", "table", CAST(count(*) AS BIGINT) n FROM (
      SELECT 'document' "rule", 'symptom_documents' "table", l_partkey FROM lineitem ANTI JOIN ws_documents d ON d.id = l_partkey
      UNION ALL SELECT 'document', 'procedure_documents', l_suppkey FROM lineitem ANTI JOIN ws_documents d ON d.id = l_suppkey
      UNION ALL SELECT 'unique', 'symptom_documents', l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
      UNION ALL SELECT 'unique', 'procedure_documents', l_partkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
      UNION ALL SELECT 'symptom', 'symptom_documents', l_orderkey FROM lineitem ANTI JOIN ws_symptoms s ON s.id = l_orderkey
      UNION ALL SELECT 'procedure', 'procedure_documents', l_partkey FROM lineitem ANTI JOIN ws_procedures s ON s.id = l_partkey) GROUP BY ALL""",
      lambda ws: mutations.violations(ws).groupBy("rule", "table").agg(F.count("*").alias("n")))

# --- PDF files, made from the given tables --------------------------------------------------------


def _pdf(*pages: F.Column) -> F.Column:
    """A PDF with these ASCII texts as its pages."""
    parts = [F.lit("%PDF-1.4\n")]
    for i, text in enumerate(pages):
        shown = F.regexp_replace(text, r"([\\()])", r"\\$1")
        parts += [F.lit(f"{10 + 2 * i} 0 obj << /Type /Page /Contents {11 + 2 * i} 0 R >> endobj\n{11 + 2 * i} 0 obj << >>\nstream\n("), shown, F.lit(") Tj\nendstream endobj\n")]
    return F.encode(F.concat(*parts), "UTF-8")



def _part_files(p: DataFrame) -> DataFrame:
    """Two pages each; small parts have files that aren't PDF, middle ones empty pages."""
    p = dealt(p, "p_partkey")
    content = F.when(F.col("p_size") < 5, F.encode(F.lit("not a pdf"), "UTF-8")).when(F.col("p_size") < 9, _pdf(F.lit(" "))).otherwise(_pdf(F.concat(F.lit("  "), F.col("p_name"), F.lit("  (new)")), F.col("p_type")))
    return p.select(F.concat(F.lit("/in/part "), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"))


_PART_TEXT = "CASE WHEN p_size < 9 THEN '' ELSE trim(regexp_replace(p_name, ' +', ' ', 'g')) || ' (new)' || chr(10) || chr(10) || p_type END extracted_text, CASE WHEN p_size < 5 THEN 'failed: Invalid PDF structure.' WHEN p_size < 9 THEN 'no_text_found' ELSE 'completed' END extraction_status, CASE WHEN p_size >= 9 THEN 2 WHEN p_size >= 5 THEN 1 END page_count"
on_table("extract_pdfs", f"SELECT '/in/part ' || p_partkey || '.pdf' path, {_PART_TEXT} FROM part", "part", lambda p: ingest.extracted(_part_files(p)))


def _structured_files(p: DataFrame) -> DataFrame:
    """Objects in an object stream, pages against the order of their numbers, nested parentheses and hex strings with a digit too few."""
    p = dealt(p.select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    heads = [(1, F.lit("<< /Type /Catalog /Pages 2 0 R >>")), (2, F.lit("<< /Type /Pages /Count 2 /Kids [12 0 R 10 0 R] >>")), (10, F.lit("<< /Type /Page /Contents 11 0 R >>")), (12, F.lit("<< /Type /Page /Contents [13 0 R 14 0 R] >>"))]
    inner, places, at = F.concat(*[c for _, c in heads]), [], F.lit(0)
    for number, c in heads:
        places += [F.lit(str(number)), at.cast("string")]
        at = at + F.length(c)
    index = F.concat_ws(" ", *places, F.lit(""))
    stream = lambda n, head, body: F.concat(F.lit(f"{n} 0 obj << "), F.lit(head), F.lit(" /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream endobj\n"))
    packed = F.concat(F.lit("20 0 obj << /Type /ObjStm /N 4 /First "), F.length(index).cast("string"), F.lit(" /Length "), F.length(F.concat(index, inner)).cast("string"), F.lit(" >>\nstream\n"), index, inner, F.lit("\nendstream endobj\n"))
    shown = [stream(11, "", F.concat(F.lit("("), "p_name", F.lit(" (nested ("), "p_brand", F.lit("))) Tj"))), stream(13, "", F.concat(F.lit("<"), F.hex(F.encode("p_type", "UTF-8")), F.lit("4> Tj"))), stream(14, "", F.concat(F.lit("[(a) -20 (b)] TJ % ("), "p_name", F.lit(")")))]
    content = F.encode(F.concat(F.lit("%PDF-1.5\n"), *shown, packed, F.lit("trailer << /Root 1 0 R >>")), "UTF-8")
    return p.select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"))


on_table("extract_structured_pdfs", "SELECT '/in/' || p_partkey || '.pdf' path, p_type || '@ ab' || chr(10) || chr(10) || trim(regexp_replace(p_name, ' +', ' ', 'g')) || ' (nested (' || p_brand || '))' extracted_text, 'completed' extraction_status, 2 page_count FROM part", "part", lambda p: ingest.extracted(_structured_files(p)))
_STAMP = "1700000000000-abc"


def _uploaded(ws: Workspace) -> DataFrame:
    files = _part_files(ws.procedures.select(F.col("id").alias("p_partkey"), F.length("title").alias("p_size"), F.col("title").alias("p_name"), F.col("steps").alias("p_type")))
    names = ingest.numbered(files, "/store/", _STAMP)
    return ingest.document_rows(ws, files, names, {"system": "Engine", "document_type": "Manual"}, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))


query("upload_rows", f""", files AS (SELECT id, row_number() OVER (ORDER BY 'part ' || id || '.pdf') - 1 k, length(title) p_size, title p_name, steps p_type FROM ws_procedures)
    SELECT (SELECT max(id) FROM ws_documents) + 1 + k id, 0 vehicle_id, 'part ' || id title, 'part ' || id || '.pdf' original_filename, 'part-' || id || '-{_STAMP}' || k || '.pdf' stored_filename, '/store/part-' || id || '-{_STAMP}' || k || '.pdf' file_path, 'application/pdf' file_type,
      'Engine' "system", 'Manual' document_type, {_PART_TEXT}, false is_favorite FROM files""",
      lambda ws: _uploaded(ws).drop("subsystem", "source", "notes", "created_at", "updated_at"))
query("upload_total", "SELECT (SELECT count(*) FROM ws_documents) + (SELECT count(*) FROM ws_procedures) total", lambda ws: ingest.total_after(ws, ws.procedures))
query("extract_again", "SELECT id, CASE WHEN id = 5 THEN 'procedure again' ELSE extracted_text END extracted_text, CASE WHEN id = 5 THEN 'completed' ELSE extraction_status END extraction_status, CASE WHEN id = 5 THEN 1 ELSE page_count END page_count FROM ws_documents",
      lambda ws: ingest.extract_again(ws.with_tables(documents=ws.documents.withColumn("file_path", F.concat(F.lit("/store/"), F.col("id").cast("string"), F.lit(".pdf")))), 5, ws.procedures.select(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"), _pdf(F.lit("procedure again")).alias("content"))).documents.select("id", "extracted_text", "extraction_status", "page_count"))

# --- orders, as the place of the first rows --------------------------------------------------------


def _placed(columns: str, table: str, order: str, where: str = "true") -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) place FROM {table} WHERE {where} QUALIFY place <= 100"


_NEW = "updated_at DESC NULLS LAST, id DESC"
_MADE = "created_at DESC NULLS LAST, id DESC"
query("order_documents_list", _placed("id", "ws_documents", _MADE), lambda ws: browse.page(links.list_documents(ws)).select("id", "place"))
query("order_documents_relevance", f", found AS ({_document_search('the').replace(', hits AS', 'WITH hits AS', 1)}) " + _placed("id, relevance_score", "found JOIN (SELECT id, created_at FROM ws_documents) USING (id)", f"relevance_score DESC, {_MADE}"), lambda ws: browse.page(_documents(ws, query="the")).select("id", "relevance_score", "place"))
query("order_documents_title", _placed("id", "ws_documents", f"{ascii_lower('title')}, {_MADE}"), lambda ws: browse.page(_documents(ws, sort="title")).select("id", "place"))
query("order_symptoms_list", _placed("id", "ws_symptoms", _NEW), lambda ws: browse.page(links.listed(links.symptoms(ws))).select("id", "place"))
query("order_procedures_title", _placed("id", "ws_procedures", f"lower(title), {_NEW}"), lambda ws: browse.page(_procedures(ws, sort="title")).select("id", "place"))
query("order_procedures_relevance", f", found AS ({_literal_search('ws_procedures', _P, list(_P), 'al', 'updated_at').replace(', hits AS', 'WITH hits AS', 1)}) " + _placed("id", "found", f"relevance_score DESC, {_NEW}"), lambda ws: browse.page(search.search(links.procedures(ws), specs.PROCEDURES, query="al")).select("id", "place"))
query("order_options", f"SELECT \"value\", row_number() OVER (ORDER BY {ascii_lower(chr(34) + 'value' + chr(34))}, \"value\") place FROM (SELECT DISTINCT document_type \"value\" FROM ws_documents)", lambda ws: browse.page(facets.stored_options(ws.documents, "document_type")))
query("order_browse_oldest", _placed("id", "ws_symptoms", "updated_at, id DESC"), lambda ws: browse.page(browse.ordered(ws.symptoms, "oldest", dates=("updated_at",))).select("id", "place"))
query("order_browse_title", _placed("id", "ws_symptoms", f"title, {_NEW}"), lambda ws: browse.page(browse.ordered(ws.symptoms, "title")).select("id", "place"))

# --- whole answers, requests and forms -------------------------------------------------------------


def _answer(ws: Workspace, kind: str, **request: object) -> DataFrame:
    """Total and option lists of a search side by side."""
    answer = search.respond(ws, kind, **request)
    return answer.filters.withColumn("total", F.lit(None).cast("long")).unionByName(answer.total.select(F.lit("total").alias("facet"), F.lit("").alias("value"), "total"))


def _answered(facet_sql: str, total_sql: str) -> str:
    return f"SELECT facet, \"value\", CAST(NULL AS BIGINT) total FROM ({facet_sql}) UNION ALL SELECT 'total', '', ({total_sql})"


query("respond_documents", _answered(_facets("ws_documents", {"systems": '"system"', "document_types": "document_type"}), "SELECT count(*) FROM ws_documents WHERE \"system\" = 'en'"), lambda ws: _answer(ws, "documents", system="en"))
query("respond_symptoms", _answered(_facets("ws_symptoms", {"systems": '"system"', "statuses": "status"}), "SELECT count(*) FROM ws_symptoms WHERE status = 'open' AND (contains(title, '7') OR contains(suspected_causes, '7'))"), lambda ws: _answer(ws, "symptoms", query=" 7", status="open"))
query("respond_procedures", _answered(_facets("ws_procedures", {"systems": '"system"', "difficulties": "difficulty"}), "SELECT count(*) FROM ws_procedures"), lambda ws: _answer(ws, "procedures"))
query("respond_notes", _answered(_facets("ws_notes", {"note_types": "note_type", "related_entity_types": "related_entity_type"}), "SELECT count(*) FROM ws_notes WHERE note_type = 'click'"), lambda ws: _answer(ws, "notes", note_type="click"))
query("request_of_form", _placed("id, title", "ws_procedures", _NEW, "difficulty = 'beginner'"), lambda ws: browse.page(_procedures(ws, **T.request({"query": "  ", "difficulty": " beginner ", "sort": " newest", "system": ""}))).select("id", "title", "place"))
query("request_not_text", _placed("id", "ws_documents", _MADE), lambda ws: browse.page(_documents(ws, query=["the"], system=7, favorite=True)).select("id", "place"))
query("link_picker", "".join(f"{' UNION ALL ' if i else ''}SELECT '{k}' kind, 'Linked {k}' \"label\", 'Choose a {k}' placeholder, CAST(NULL AS VARCHAR) \"empty\", id, title FROM ws_{k}s" for i, k in enumerate(links.LINK_TYPES)), links.picker)
query("link_picker_empty", f"SELECT 'symptom' kind, '{links.EMPTY['symptom']}' \"empty\" UNION ALL SELECT 'procedure', NULL FROM ws_procedures UNION ALL SELECT 'document', NULL FROM ws_documents", lambda ws: links.picker(ws.with_tables(symptoms=ws.symptoms.filter("id < 0"))).select("kind", "empty"))
query("link_messages", "SELECT id, CASE related_entity_type WHEN 'none' THEN '' ELSE 'Please choose a linked ' || related_entity_type || '.' END message, 'Linked ' || CASE related_entity_type WHEN 'none' THEN 'item' ELSE related_entity_type END heading FROM ws_links",
      lambda ws: ws.notes.select("id", links.missing_link_message(F.col("related_entity_type")).alias("message"), links.heading(F.col("related_entity_type")).alias("heading")))
query("form_payload", "SELECT id, title, note_type, related_entity_type, related_entity_id FROM ws_links UNION ALL SELECT (SELECT max(id) FROM ws_links) + 1, 'From a form', 'general', 'document', 6",
      lambda ws: mutations.create_note(ws, mutations.payload("note", {"title": "From a form", "related_entity_type": "document", "related_entity_id": "6", "other": 1}))[0].notes.select("id", "title", "note_type", "related_entity_type", "related_entity_id"))
query("badges", "SELECT id, CASE status WHEN 'resolved' THEN 'bg-emerald-100 text-emerald-800' WHEN 'monitoring' THEN 'bg-amber-100 text-amber-800' ELSE 'bg-slate-100 text-slate-700' END badge FROM ws_symptoms", lambda ws: ws.symptoms.select("id", T.badge("status", F.col("status")).alias("badge")))
query("health", "SELECT 'ok' status, 'quillspark' \"name\", '0.2.0' \"version\"", lambda ws: config.health(ws.spark))
query("runtime_settings", "SELECT '/w' \"tables\", '/u' uploads, 20 max_upload_mb, false paths_editable, true backup_supported", lambda ws: config.runtime_settings(ws.spark, config.Config("/w", "/u")))
query("anchor_profile", 'SELECT id, "year", make, model, coalesce("trim", \'\') "trim", \'\' engine FROM ws_vehicles ORDER BY id LIMIT 1', lambda ws: dashboard.dashboard(ws)["vehicle"])

# --- two vehicles: only the first one's rows count ---------------------------------------------------


def _two(ws: Workspace) -> Workspace:
    odd = {t: getattr(ws, t).withColumn("vehicle_id", F.col("id") % 2) for t in ("documents", "symptoms", "procedures", "notes")}
    return ws.with_tables(**odd)


query("scoped_counts", """SELECT (SELECT count(*) FROM ws_documents WHERE id % 2 = 0) documents, (SELECT count(*) FROM ws_documents WHERE is_favorite AND id % 2 = 0) favorites, (SELECT count(*) FROM ws_symptoms WHERE id % 2 = 0) symptoms,
    (SELECT count(*) FROM ws_symptoms WHERE status IN ('open', 'monitoring') AND id % 2 = 0) active_symptoms, (SELECT count(*) FROM ws_procedures WHERE id % 2 = 0) procedures, (SELECT count(*) FROM ws_links WHERE id % 2 = 0) notes""", lambda ws: dashboard.counts(_two(ws)))
query("scoped_symptoms", "SELECT id, title FROM ws_symptoms WHERE id % 2 = 0 AND contains(lower(title), '5')", lambda ws: search.search(links.symptoms(_two(ws)), specs.SYMPTOMS.only("title"), "5").select("id", "title"))
query("scoped_notes", "SELECT id, CASE WHEN linked_id % 2 = 0 THEN linked_title ELSE '' END linked_title FROM ws_notes WHERE id % 2 = 0", lambda ws: links.notes(_two(ws)).select("id", "linked_title"))

# --- further changes ---------------------------------------------------------------------------------

query("insert_symptom", "SELECT id, title, \"system\", confidence, status FROM ws_symptoms UNION ALL SELECT (SELECT max(id) FROM ws_symptoms) + 1, 'Noise', '', 'low', 'open'",
      lambda ws: mutations.create_symptom(ws, {"title": " Noise ", "confidence": "LOW"})[0].symptoms.select("id", "title", "system", "confidence", "status"))
query("insert_symptom_links", "SELECT l_orderkey symptom_id, l_partkey document_id FROM lineitem UNION ALL SELECT (SELECT max(id) FROM ws_symptoms) + 1, id FROM ws_documents WHERE id IN (2, 3)",
      lambda ws: mutations.create_symptom(ws, {"title": "x", "linked_document_ids": [3, "2", 3, 0, float("inf"), "NaN", 1.5, None]})[0].symptom_documents)
query("insert_procedure", "SELECT id, title, \"system\", difficulty, confidence, steps FROM ws_procedures UNION ALL SELECT (SELECT max(id) FROM ws_procedures) + 1, 'Bleed', 'Brakes', 'advanced', 'medium', 'one'",
      lambda ws: mutations.create_procedure(ws, {"title": "Bleed", "system": "Brakes", "difficulty": "Advanced", "steps": " one "})[0].procedures.select("id", "title", "system", "difficulty", "confidence", "steps"))
query("update_procedure", "SELECT id, title, CASE WHEN id = 4 THEN 'beginner' ELSE difficulty END difficulty, CASE WHEN id = 4 THEN 'new steps' ELSE steps END steps FROM ws_procedures",
      lambda ws: mutations.update_procedure(ws, 4, {"difficulty": "beginner", "steps": "new steps "}).procedures.select("id", "title", "difficulty", "steps"))
query("delete_procedure", "SELECT id FROM ws_procedures WHERE id <> 5", lambda ws: mutations.delete_procedure(ws, 5).procedures.select("id"))
query("delete_procedure_links", "SELECT l_partkey procedure_id, l_suppkey document_id FROM lineitem WHERE l_partkey <> 5", lambda ws: mutations.delete_procedure(ws, 5).procedure_documents)
query("update_note", "SELECT id, CASE WHEN id = 2 THEN 'Moved' ELSE title END title, CASE WHEN id = 2 THEN 'symptom' ELSE related_entity_type END related_entity_type, CASE WHEN id = 2 THEN 1 ELSE related_entity_id END related_entity_id FROM ws_links",
      lambda ws: mutations.update_note(ws, 2, {"title": "Moved", "note_type": "general", "related_entity_type": "symptom", "related_entity_id": 1}).notes.select("id", "title", "related_entity_type", "related_entity_id"))
query("delete_note", "SELECT id FROM ws_links WHERE id <> 3", lambda ws: mutations.delete_note(ws, 3).notes.select("id"))
query("update_document", "SELECT id, CASE WHEN id = 6 THEN 'Renamed' ELSE title END title, \"system\", is_favorite OR id = 6 is_favorite FROM ws_documents",
      lambda ws: mutations.update_document(ws, 6, {"title": "Renamed", "is_favorite": True}).documents.select("id", "title", "system", "is_favorite"))
query("update_vehicle", 'SELECT id, CASE WHEN id = 0 THEN 2010 ELSE "year" END "year", CASE WHEN id = 0 THEN \'Volvo\' ELSE make END make, CASE WHEN id = 0 THEN \'V90\' ELSE model END model FROM ws_vehicles',
      lambda ws: mutations.update_vehicle(ws, "2010", "Volvo", " V90 ").vehicles.select("id", "year", "make", "model"))
query("update_defaults", "SELECT 1 id, '[\"Engine\",\"Body\"]' systems, '[\"Manual\"]' types", lambda ws: mutations.update_document_defaults(ws, ["Engine", " engine", "Body"], ["Manual"]).app_settings.select("id", F.col("document_system_defaults").alias("systems"), F.col("document_type_defaults").alias("types")))
query("read_defaults", "SELECT 'Engine|Body' systems, 'a|b' types", lambda ws: mutations.document_defaults(mutations.update_document_defaults(ws, ["Engine", "Body"], ["x"]).with_tables(app_settings=mutations.update_document_defaults(ws, ["Engine", "Body"], ["x"]).app_settings.withColumn("document_type_defaults", F.lit("{broken"))), [], ["a", "b"]).select(F.array_join("systems", "|").alias("systems"), F.array_join("types", "|").alias("types")))
query("backfill_document", "SELECT id, CASE WHEN original_filename = 'src1-1.pdf' THEN 'application/pdf' END file_type, page_count, CASE WHEN original_filename = 'src1-1.pdf' THEN 'seed' END source FROM ws_documents",
      lambda ws: mutations.backfill_document(ws.documents, "src1-1.pdf", "application/pdf", "s", "seed").select("id", "file_type", "page_count", "source"))
query("schema_evolution", "SELECT id, 'general' note_type, 'none' related_entity_type, '' body FROM ws_links", lambda ws: conform(ws.notes.drop("note_type", "related_entity_type", "body"), "notes").select("id", "note_type", "related_entity_type", "body"))
query("links_of_deleted", "SELECT id, related_entity_type, related_entity_id FROM ws_notes WHERE related_entity_type <> 'none' AND (linked_id IS NULL OR (related_entity_type = 'procedure' AND linked_id % 3 = 0))",
      lambda ws: links.dangling(ws.with_tables(procedures=ws.procedures.filter("id % 3 <> 0"))))
query("linked_exists", "SELECT id, linked_id IS NOT NULL AND related_entity_type <> 'none' linked FROM ws_notes", lambda ws: links.notes(ws).select("id", F.coalesce(*[F.col(f"linked_{k}.id") for k in links.LINK_TYPES]).isNotNull().alias("linked")))
on_table("toggle_list", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN '1,2,3,0' WHEN 1 THEN '2,3' WHEN 2 THEN '1,3' ELSE '1,2' END toggled FROM events", "events", lambda e: e.select("event_id", F.array_join(T.toggle(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>"), F.col("user_id") % 4), ",").alias("toggled")))
on_table("backup_names", "SELECT event_id, 'backup-' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H-%M-%S-%gZ') || '.tar.gz' archive FROM events", "events", lambda e: e.select("event_id", ingest.backup_name(F.col("ts")).alias("archive")))
on_table("stored_names", f"SELECT page_id, coalesce(nullif({_SAFE}, ''), 'document') || '-{_STAMP}' || lower({_EXT}) stored FROM pages", "pages", lambda p: p.select("page_id", T.stored_filename(F.col("url"), F.lit(f"-{_STAMP}")).alias("stored")))
on_table("positive_ids", "SELECT o_orderkey, CASE WHEN o_orderkey = 16 THEN '16,3,5,7' WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN o_orderkey || ',3,16,5,7' ELSE '3,16,5,7' END ids FROM orders", "orders",
         lambda o: dealt(o.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.array_join(T.positive_ids(F.array(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("-1"), *map(F.lit, ["3", "Infinity", "NaN", "1.5", "x", "3.0", "1e300", "1_0", "0x10", "3d", "9223372036854775808", " ", "", "abc", " 0b101 ", "+7.0", "0x", "1e-1"]))), ",").alias("ids")))
query("first_content", "SELECT id, CASE WHEN \"trim\" <> '' THEN \"trim\" ELSE model END shown FROM ws_vehicles", lambda ws: ws.vehicles.select("id", T.blank_to(F.col("engine"), T.blank_to(F.col("trim"), F.col("model"))).alias("shown")))


# --- whole orders, groups, times, an index, versions -----------------------------------------------

on_table("order_all_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) place FROM orders", "orders",
         lambda o: browse.places(o.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "place"))
query("newest_notes", "SELECT id, related_entity_type, related_entity_id, row_number() OVER (PARTITION BY related_entity_type, related_entity_id ORDER BY updated_at DESC NULLS LAST, id DESC) place FROM ws_links WHERE related_entity_id > 0 QUALIFY place <= 3",
      lambda ws: history.newest_notes(ws.notes).select("id", "related_entity_type", "related_entity_id", "place"))
query("open_over_time", """, days AS (SELECT CAST(updated_at AS DATE) "day", CAST(count(*) FILTER (status = 'open') AS BIGINT) n FROM ws_symptoms GROUP BY 1)
    SELECT "day", n, CAST(sum(n) OVER (ORDER BY "day") AS BIGINT) total, CAST(sum(n) OVER (ORDER BY "day" RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) recent FROM days""",
      lambda ws: history.open_over_time(ws.symptoms))


def _versions(lines: DataFrame) -> DataFrame:
    """Each day on which a supplier ships gives its record a new title: the last line of that day."""
    title = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return lines.groupBy("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("since")).agg(F.max(title).alias("title"))


on_table("title_at_receipt", """WITH versions AS (SELECT l_suppkey, CAST(l_shipdate AS TIMESTAMP) since, max(lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || l_linenumber) title FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l.l_suppkey, title FROM (SELECT *, CAST(l_shipdate AS TIMESTAMP) - INTERVAL 100 DAYS seen FROM lineitem) l ASOF LEFT JOIN versions v ON v.l_suppkey = l.l_suppkey AND l.seen >= v.since""", "lineitem",
         lambda li: history.as_of(li.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_shipdate").cast("timestamp") - F.expr("INTERVAL 100 DAYS")).alias("at")), _versions(li), ["l_suppkey"], "at", "since", ["title"]).select("l_orderkey", "l_linenumber", "l_suppkey", "title"))
on_table("title_validity", """WITH versions AS (SELECT l_suppkey, CAST(l_shipdate AS TIMESTAMP) since, max(lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || l_linenumber) title FROM lineitem GROUP BY ALL)
    SELECT *, lead(since) OVER (PARTITION BY l_suppkey ORDER BY since) valid_to FROM versions""", "lineitem",
         lambda li: history.validity(_versions(li), ["l_suppkey"], "since"))


def _kept(ws: Workspace) -> str:
    """A new folder among the session's kept rows."""
    return f"{checkpoints.folder(ws.spark)}/{ws.spark._jvm.java.util.UUID.randomUUID()}"


def _indexed(ws: Workspace, **request: str) -> DataFrame:
    rows = links.documents(ws)
    return ranked(trigrams.search_documents(rows, trigrams.write_index(rows, _kept(ws)), **request), "title", "system", "document_type", "is_favorite")


query("search_documents_index", _document_search("the%ation"), lambda ws: _indexed(ws, query="the%ation"))
query("search_documents_index_accents", _document_search("dré"), lambda ws: _indexed(ws, query=" Dré"))


def _versioned(ws: Workspace) -> DataFrame:
    """Symptoms after an update, a deletion and a new record, each a version of a store, as the store has them."""
    store = snapshots.Store(ws.spark, _kept(ws))
    small = ws.with_tables(documents=ws.documents.drop("extracted_text").withColumn("extracted_text", F.lit("")))
    store.save(small.with_tables(symptoms=small.symptoms.repartitionByRange(8, "id")))
    two = store.rewrite(1, lambda w: mutations.update_symptom(w, 3, {"title": "changed", "linked_document_ids": [1, 2, -1]}), snapshots.rows_of("symptom", 3))
    three = store.rewrite(two, lambda w: mutations.delete_symptom(w, 5), snapshots.rows_of("symptom", 5))
    changed, id_ = mutations.create_symptom(store.load(three), {"title": "new", "linked_document_ids": [4]})
    now = store.load(store.append(three, changed, snapshots.new_rows("symptom", id_)))
    counts = now.symptom_documents.distinct().groupBy(F.col("symptom_id").alias("id")).agg(F.count("*").alias("links"))
    return now.symptoms.join(counts, "id", "left").select("id", "title", "status", F.coalesce("links", F.lit(0)).alias("links"))


query("versioned_changes", """, counts AS (SELECT symptom_id id, count(*) links FROM ws_symptom_documents GROUP BY 1)
    SELECT id, CASE WHEN id = 3 THEN 'changed' ELSE title END title, status, CASE WHEN id = 3 THEN (SELECT count(*) FROM ws_documents d WHERE d.id IN (1, 2)) ELSE coalesce(links, 0) END links FROM ws_symptoms LEFT JOIN counts USING (id) WHERE id <> 5
    UNION ALL SELECT (SELECT max(id) FROM ws_symptoms) + 1, 'new', 'open', (SELECT count(*) FROM ws_documents d WHERE d.id = 4)""", _versioned)


def _settings(ws: Workspace) -> DataFrame:
    """The settings as a whole; the stored lists are what the documents use."""
    lists = ws.documents.agg(*[F.to_json(F.array_sort(F.collect_set(c))).alias(f"document_{name}_defaults") for c, name in (("system", "system"), ("document_type", "type"))])
    stored = ws.with_tables(app_settings=conform(lists.withColumn("id", F.lit(1)), "app_settings"))
    out = mutations.settings(stored, config.runtime_settings(ws.spark, config.Config("/w", "/u")), ["x"], ["y"])
    text = lambda c: F.array_join(f"document_defaults.{c}", "|").alias(c)
    return out.select("vehicle.id", "vehicle.make", "vehicle.trim", "runtime.uploads", text("systems"), text("types"), F.col("backup.supported").alias("backup"))


query("settings_answer", """ SELECT v.id, make, coalesce("trim", '') "trim", '/u' uploads, (SELECT string_agg(DISTINCT "system", '|' ORDER BY "system") FROM ws_documents) systems, (SELECT string_agg(DISTINCT document_type, '|' ORDER BY document_type) FROM ws_documents) "types", true backup FROM ws_vehicles v ORDER BY v.id LIMIT 1""", _settings)
