"""The tables of a workspace: schemas, defaults, loading and saving as Parquet."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each table with what a missing or new one holds (SQL), None for null.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "vehicles": ("id long, year int, make string, model string, trim string, engine string, created_at timestamp_ntz", {}),
    "app_settings": ("id int, document_system_defaults string, document_type_defaults string, updated_at timestamp_ntz", {"document_system_defaults": "'[]'", "document_type_defaults": "'[]'"}),
    "documents": (
        "id long, vehicle_id long, title string, original_filename string, stored_filename string, file_path string, file_type string, system string, subsystem string,"
        " document_type string, source string, notes string, extracted_text string, extraction_status string, page_count int, is_favorite boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
        {"extraction_status": "'not_attempted'", "is_favorite": "false"},
    ),
    "symptoms": (
        "id long, vehicle_id long, title string, description string, system string, suspected_causes string, confidence string, severity string, status string, notes string,"
        " first_observed_at string, created_at timestamp_ntz, updated_at timestamp_ntz",
        {"confidence": "'medium'", "status": "'open'"},
    ),
    "symptom_documents": ("symptom_id long, document_id long", {}),
    "procedures": (
        "id long, vehicle_id long, title string, system string, difficulty string, tools_needed string, parts_needed string, safety_notes string, steps string, confidence string,"
        " status string, notes string, created_at timestamp_ntz, updated_at timestamp_ntz",
        {"difficulty": "'intermediate'", "confidence": "'medium'", "status": "'draft'"},
    ),
    "procedure_documents": ("procedure_id long, document_id long", {}),
    "notes": (
        "id long, vehicle_id long, document_id long, title string, body string, content string, note_type string, related_entity_type string, related_entity_id long,"
        " created_at timestamp_ntz, updated_at timestamp_ntz",
        {"body": "''", "content": "''", "note_type": "'general'", "related_entity_type": "'none'"},
    ),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types, in order; columns that it lacks get their default. Further columns go."""
    defaults = TABLES[table][1]
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.expr(defaults.get(f.name, "null"))).cast(f.dataType).alias(f.name)
            for f in schema(table)
        ]
    )


@dataclass(frozen=True)
class Workspace:
    vehicles: DataFrame
    app_settings: DataFrame
    documents: DataFrame
    symptoms: DataFrame
    symptom_documents: DataFrame
    procedures: DataFrame
    procedure_documents: DataFrame
    notes: DataFrame

    def with_tables(self, **tables: DataFrame) -> Workspace:
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @property
    def anchor(self) -> DataFrame:
        """One row, the lowest vehicle id: a scalar that joins broadcast."""
        return self.vehicles.agg(F.min("id").alias("vehicle_id"))

    def scoped(self, table: str) -> DataFrame:
        """Rows of the anchor vehicle. The other side has one row, so this never shuffles the table."""
        return getattr(self, table).join(F.broadcast(self.anchor), "vehicle_id", "left_semi")


def of_tables(spark: SparkSession, **tables: DataFrame) -> Workspace:
    """A workspace of the given tables; those left out are empty."""
    given = {n: conform(tables[n], n) if n in tables else spark.createDataFrame([], schema(n)) for n in TABLES}
    return Workspace(**given)


def load(spark: SparkSession, path: str) -> Workspace:
    """Tables from Parquet folders under path. Columns added since they were written get their defaults."""
    return Workspace(**{n: conform(spark.read.parquet(f"{path}/{n}"), n) for n in TABLES})


def save(ws: Workspace, path: str) -> None:
    for f in fields(ws):
        getattr(ws, f.name).write.mode("errorifexists").parquet(f"{path}/{f.name}")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt anew by unique keys, for work on each row that costs much more than moving it: a file of few row groups is read by as few tasks, however many there could be."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def point_lookup(df: DataFrame, id_: int) -> DataFrame:
    """The row of an id, if any: the filter reaches the scan. What is no long is nobody's id."""
    return df.filter(F.col("id") == F.lit(id_ if -(1 << 63) <= id_ < 1 << 63 else None)).limit(1)


def insert_missing(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """table with those of rows whose key it doesn't hold yet."""
    return table.unionByName(rows.join(table.select(*on), on, "left_anti"))
