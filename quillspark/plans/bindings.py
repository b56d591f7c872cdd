"""The given star-schema tables in the roles of a workspace, as DataFrames and as SQL.

BASE is the same binding for DuckDB: a WITH list that the oracle queries start with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import Workspace, of_tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _seconds(id_: str):
    return F.expr(f"TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, {id_})")


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    t = lambda name: read(spark, sf_dir, name)
    none, anchor = F.lit(None).cast("string"), F.lit(0).cast("long").alias("vehicle_id")
    vehicles = t("nation").select(
        F.col("n_nationkey").alias("id"),
        (F.col("n_nationkey") + 1990).alias("year"),
        F.col("n_name").alias("make"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("model"),
        F.when(F.col("n_regionkey") != 0, F.lower("n_name")).alias("trim"),
    )
    documents = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    documents = documents.select(
        F.col("doc_id").alias("id"),
        anchor,
        F.concat("source", F.lit(" document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("original_filename"),
        F.col("lang").alias("system"),
        F.col("source").alias("document_type"),
        F.col("text").alias("extracted_text"),
        F.when(F.col("n_chars") < 500, "no_text_found").when(F.col("n_chars") < 1500, "failed: too short").otherwise("completed").alias("extraction_status"),
        F.col("n_chars").alias("page_count"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_favorite"),
        _seconds("doc_id").alias("created_at"),
        _seconds("doc_id").alias("updated_at"),
    )
    symptoms = t("orders").select(
        F.col("o_orderkey").alias("id"),
        anchor,
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("suspected_causes"),
        F.col("o_orderpriority").alias("system"),
        F.when(F.col("o_orderstatus") == "P", "monitoring").when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )
    procedures = t("part").select(
        F.col("p_partkey").alias("id"),
        anchor,
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("system"),
        F.when(F.col("p_size") <= 15, "beginner").when(F.col("p_size") <= 35, "intermediate").otherwise("advanced").alias("difficulty"),
        F.col("p_type").alias("steps"),
        _seconds("p_partkey").alias("created_at"),
        _seconds("p_partkey").alias("updated_at"),
    )
    kind = F.col("event_type")
    link = F.when(kind == "view", "procedure").when(kind == "purchase", "symptom").when(kind == "signup", "document").otherwise("none")
    notes = t("events").select(
        F.col("event_id").alias("id"),
        anchor,
        F.when(kind != "error", F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"))).otherwise("  ").alias("title"),
        F.col("props").alias("content"),
        kind.alias("note_type"),
        link.alias("related_entity_type"),
        F.when(link != "none", F.col("user_id")).alias("related_entity_id"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    lineitem = t("lineitem")
    return of_tables(
        spark,
        vehicles=vehicles,
        documents=documents,
        symptoms=symptoms,
        procedures=procedures,
        notes=notes,
        symptom_documents=lineitem.select(F.col("l_orderkey").alias("symptom_id"), F.col("l_partkey").alias("document_id")),
        procedure_documents=lineitem.select(F.col("l_partkey").alias("procedure_id"), F.col("l_suppkey").alias("document_id")),
    )


#: DuckDB: ASCII folding of a column, white space, the same as functions.text has.
def ascii_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def normalize(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^{WS}+|{WS}+\\z', '', 'g'), '')"


def collapse(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), '')"


def preview(c: str) -> str:
    return f"CASE WHEN length({c}) > 180 THEN substr({c}, 1, 177) || '...' ELSE {c} END"


def snippet(clean: str, query: str) -> str:
    """clean: a column whose white space is collapsed already."""
    if not query:
        return preview(clean)
    at = f"(strpos(lower({clean}), '{query.lower()}') - 1)"
    end = f"least(length({clean}), {at} + {len(query) + 80})"
    start = f"greatest(0, {at} - 80)"
    cut = f"CASE WHEN {start} > 0 THEN '...' ELSE '' END || trim(substr({clean}, {start} + 1, {end} - {start})) || CASE WHEN {end} < length({clean}) THEN '...' ELSE '' END"
    return f"CASE WHEN {at} < 0 THEN {preview(clean)} ELSE {cut} END"


BASE = """
ws_vehicles AS (
  SELECT CAST(n_nationkey AS BIGINT) id, n_nationkey + 1990 "year", n_name make, 'R' || n_regionkey model, CASE WHEN n_regionkey <> 0 THEN lower(n_name) END "trim" FROM nation),
ws_documents AS (
  SELECT d.doc_id id, 0 vehicle_id, source || ' document ' || d.doc_id title, source || '-' || d.doc_id || '.pdf' original_filename, lang "system", source document_type, text extracted_text,
    CASE WHEN n_chars < 500 THEN 'no_text_found' WHEN n_chars < 1500 THEN 'failed: too short' ELSE 'completed' END extraction_status, CAST(n_chars AS INTEGER) page_count,
    coalesce(quality = 1, false) is_favorite, TIMESTAMP '2020-01-01' + to_seconds(d.doc_id) created_at, TIMESTAMP '2020-01-01' + to_seconds(d.doc_id) updated_at
  FROM documents d LEFT JOIN labels USING (doc_id)),
ws_symptoms AS (
  SELECT o_orderkey id, 'Order ' || o_orderkey title, 'customer ' || o_custkey suspected_causes, o_orderpriority "system", 'medium' confidence,
    CASE o_orderstatus WHEN 'P' THEN 'monitoring' WHEN 'O' THEN 'open' ELSE 'resolved' END status, CAST(o_orderdate AS TIMESTAMP) updated_at FROM orders),
ws_procedures AS (
  SELECT p_partkey id, p_name title, p_brand "system", CASE WHEN p_size <= 15 THEN 'beginner' WHEN p_size <= 35 THEN 'intermediate' ELSE 'advanced' END difficulty, 'medium' confidence,
    p_type steps, TIMESTAMP '2020-01-01' + to_seconds(p_partkey) updated_at FROM part),
ws_links AS (
  SELECT event_id id, CASE WHEN event_type <> 'error' THEN event_type || ' by user ' || user_id ELSE '  ' END title, props content, event_type note_type,
    CASE event_type WHEN 'view' THEN 'procedure' WHEN 'purchase' THEN 'symptom' WHEN 'signup' THEN 'document' ELSE 'none' END related_entity_type,
    CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN user_id END related_entity_id, CAST(ts AS TIMESTAMP) updated_at FROM events),
ws_notes AS (
  SELECT n.* REPLACE (nullif(related_entity_id, 0) AS related_entity_id), coalesce(d.title, s.title, p.title, '') linked_title, coalesce(d.id, s.id, p.id) linked_id,
    CASE WHEN d.id IS NOT NULL THEN d."system" || ' - ' || d.document_type
         WHEN s.id IS NOT NULL THEN s."system" || ' - ' || upper(s.status[1]) || s.status[2:]
         WHEN p.id IS NOT NULL THEN p."system" || ' - ' || upper(p.difficulty[1]) || p.difficulty[2:] ELSE '' END link_meta
  FROM ws_links n
  LEFT JOIN ws_documents d ON related_entity_type = 'document' AND n.related_entity_id = d.id
  LEFT JOIN ws_symptoms s ON related_entity_type = 'symptom' AND n.related_entity_id = s.id
  LEFT JOIN ws_procedures p ON related_entity_type = 'procedure' AND n.related_entity_id = p.id),
ws_symptom_documents AS (SELECT DISTINCT l_orderkey symptom_id, l_partkey document_id FROM lineitem),
ws_procedure_documents AS (SELECT DISTINCT l_partkey procedure_id, l_suppkey document_id FROM lineitem)
"""


def sql(body: str) -> str:
    return f"WITH {BASE} {body}"
