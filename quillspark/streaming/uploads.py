"""An extension: PDF files as a stream. New files of a folder become rows of text, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.ingest import MAX_BYTES, extracted, pdf_pages

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, extract: Callable[[bytes], list[str]] = pdf_pages, max_bytes: int = MAX_BYTES, trigger: dict | None = None) -> StreamingQuery:
    """Appends (path, extracted_text, extraction_status, page_count) to Parquet at `out`.

    The checkpoint remembers which files were read, and the file sink commits a
    batch as a whole, so a restart neither loses nor repeats a file.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)
    files = files.filter((F.col("length") <= max_bytes) & (F.lower(T.extension(F.col("path"))) == ".pdf"))
    writer = extracted(files, extract).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)
