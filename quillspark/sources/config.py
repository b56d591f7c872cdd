"""Settings of a running workspace and the rows that tell about it."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"


@dataclass(frozen=True)
class Config:
    """Where tables and uploads live and how large an upload may be; from the environment where it says so."""

    tables: str
    uploads: str
    max_upload_mb: int = 20

    @staticmethod
    def of_environment(root: str = ".") -> Config:
        get = os.environ.get
        return Config(get("QUILLSPARK_TABLES") or f"{root}/workspace", get("QUILLSPARK_UPLOADS") or f"{root}/uploads", int(get("MAX_UPLOAD_SIZE_MB") or 20))


def runtime_settings(spark: SparkSession, config: Config) -> DataFrame:
    """One row; paths can't be edited while a workspace is open."""
    values = {"tables": config.tables, "uploads": config.uploads, "max_upload_mb": config.max_upload_mb, "paths_editable": False, "backup_supported": True}
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in values.items()])


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit("quillspark").alias("name"), F.lit(VERSION).alias("version"))
