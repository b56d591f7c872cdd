"""PDF files: a gate on name and size, text by page, and what a document row takes from it.

The only Python on this path reads the bytes of a file; Arrow carries them.
`extract` may be any function from bytes to page texts; sources/pdf.py has the usual one.
"""

from __future__ import annotations

import secrets
import tarfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mutations
from ..operators.browse import places
from ..operators.mutations import Invalid, Missing, now, patch
from . import files as files_
from .checkpoints import delete
from .pdf import pdf_pages
from .snapshots import Store
from .workspace import Workspace, conform, point_lookup, save

MAX_BYTES = 20 << 20

#: What a rejected file is told.
TOO_LARGE, NO_PDF = "PDF is too large. The limit is {} MB.", "Only PDF files are allowed."


def _reader(extract: Callable[[bytes], list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, errors = [], []
            for content in batch["content"]:
                try:
                    pages.append(list(extract(bytes(content))))
                    errors.append(None)
                except Exception as error:  # a broken file is a result, not a failure of the job
                    pages.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"path": batch["path"], "pages": pages, "error": errors})

    return run


def page_text(pages: Column) -> Column:
    """Pages with content, white space collapsed, a blank line between them."""
    return F.array_join(F.filter(F.transform(pages, T.collapse), lambda p: p != ""), "\n\n")


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, extracted_text, extraction_status, page_count) of files (path, content)."""
    rows = files.select("path", "content").mapInPandas(_reader(extract), "path string, pages array<string>, error string")
    return rows.select("path", *_results())


def _results() -> list[Column]:
    """Text, status and number of pages from `pages` and `error`."""
    text = F.coalesce(page_text(F.col("pages")), F.lit(""))
    status = F.when(F.col("pages").isNull(), F.concat(F.lit("failed: "), F.coalesce("error", F.lit("")))).when(text == "", "no_text_found").otherwise("completed")
    return [text.alias("extracted_text"), status.alias("extraction_status"), F.when(F.col("pages").isNotNull(), F.size("pages")).alias("page_count")]


def files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """PDF files of a folder up to a size: larger ones aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.filter((F.col("length") <= max_bytes) & (F.lower(T.extension(F.col("path"))) == ".pdf"))


def rejected(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, reason) of the files that don't come in."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    large = F.when(F.col("length") > max_bytes, TOO_LARGE.format(max_bytes >> 20))
    reason = F.when(F.lower(T.extension(F.col("path"))) != ".pdf", NO_PDF).otherwise(large)
    return found.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def numbered(found: DataFrame, uploads: str, unique: str) -> DataFrame:
    """(path, number, stored_filename, file_path) of files: numbers follow the order of paths, names are their own, so both are the same whenever they are computed again."""
    rows = places(found.select("path"), F.col("path")).select("path", (F.col("place") - 1).alias("number"))
    stored = T.stored_filename(T.base_name(F.col("path")), F.concat(F.lit(f"-{unique}"), F.col("number").cast("string")))
    return rows.select("path", "number", stored.alias("stored_filename"), F.concat(F.lit(uploads.rstrip("/") + "/"), stored).alias("file_path"))


def document_rows(ws: Workspace, found: DataFrame, names: DataFrame, values: dict[str, str], at: Column, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """A document for each file (path, content) with its name from numbered(); ids follow the largest one."""
    return _documents(ws, extracted(found, extract).join(names, "path"), values, at)


def _documents(ws: Workspace, taken: DataFrame, values: dict[str, str], at: Column) -> DataFrame:
    """A document for each row with path, number, stored name and text."""
    name = T.base_name(F.col("path"))
    base = ws.documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base")).crossJoin(ws.anchor)
    new = taken.crossJoin(F.broadcast(base)).select(
        (F.col("_base") + 1 + F.col("number")).alias("id"),
        "vehicle_id",
        (F.lit(values["title"]) if values.get("title") else T.title_from_filename(name)).alias("title"),
        name.alias("original_filename"),
        "stored_filename",
        "file_path",
        T.mime_type(name).alias("file_type"),
        *[F.lit(values.get(c, "")).alias(c) for c in ("system", "document_type", "subsystem", "source", "notes")],
        "extracted_text",
        "extraction_status",
        "page_count",
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return conform(new, "documents")


def total_after(ws: Workspace, found: DataFrame) -> DataFrame:
    """One row: how many documents there are when the files are in."""
    return ws.documents.agg(F.count("*").alias("before")).crossJoin(found.agg(F.count("*").alias("files"))).select((F.col("before") + F.col("files")).alias("total"))


def _taken(extract: Callable[[bytes], list[str]], folder: str):
    """Copies each file to the folder under its stored name and reads its text: the bytes stay in the task."""
    pages_of = _reader(extract)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["stored_filename"], batch["content"], strict=True):
                files_.put(folder, name, bytes(content))
            for read in pages_of(iter([batch])):
                yield read.assign(stored_filename=batch["stored_filename"].to_numpy())

    return run


def _each(act: Callable[[str], object]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["stored_filename"]:
                act(name)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def _for_each(rows: DataFrame, act: Callable[[str], object]) -> int:
    """Runs act in tasks for each stored name; how many there were."""
    return rows.select("stored_filename").mapInPandas(_each(act), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def take_files(found: DataFrame, uploads: str, unique: str, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, stored_filename, file_path, extracted_text, extraction_status, page_count, number) of files (path, content), copied to uploads.

    One pass over the bytes copies and reads them, in tasks, under names that follow from a file's path, so
    a task that runs again writes the same files. They come into a folder of their own first and are moved when all
    are there. If anything fails, no file of them stays. number: the place in the order of paths, from 0.
    """
    spark, base, staged = found.sparkSession, uploads.rstrip("/"), f"{uploads.rstrip('/')}/_staged-{unique}"
    name = T.stored_filename(T.base_name(F.col("path")), F.concat(F.lit(f"-{unique}-"), F.substring(F.sha2(F.col("path"), 256), 1, 16)))
    try:
        named = found.select("path", "content", name.alias("stored_filename"))
        named.mapInPandas(_taken(extract, f"{staged}/files"), "path string, pages array<string>, error string, stored_filename string").write.parquet(f"{staged}/rows")
        rows = spark.read.parquet(f"{staged}/rows")
        texts = rows.select("path", "stored_filename", F.concat(F.lit(f"{base}/"), "stored_filename").alias("file_path"), *_results())
        out = places(texts, F.col("path")).withColumn("number", F.col("place") - 1).drop("place")
        try:
            _for_each(rows, lambda n: files_.move(f"{staged}/files", base, n))
        except BaseException:
            _for_each(rows, lambda n: files_.remove(base, n))
            raise
    finally:
        delete(spark, staged)
    return out


def upload(ws: Workspace, found: DataFrame, system: object, document_type: object, uploads: str, extract: Callable[[bytes], list[str]] = pdf_pages, **texts: object) -> Workspace:
    """The workspace with a document for each file. System and type are required; each file is copied to the uploads folder under a name of its own, which file_path tells."""
    values = {c: T.query_text(v) for c, v in {"system": system, "document_type": document_type, **texts}.items()}
    if not values["system"] or not values["document_type"]:
        raise Invalid("System and document type are required.")
    taken = take_files(found, uploads, f"{time.time_ns() // 10**6}-{secrets.token_hex(3)}", extract)
    at = F.to_timestamp_ntz(F.lit(time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())))
    return ws.with_tables(documents=ws.documents.unionByName(_documents(ws, taken, values, at)))


def upload_into(store: Store, base: int, found: DataFrame, system: object, document_type: object, uploads: str, extract: Callable[[bytes], list[str]] = pdf_pages, **texts: object) -> int:
    """upload() as the version after base: files and rows come together or, if someone else was first, not at all."""
    ws = store.load(base)
    last = ws.documents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    after = upload(ws, found, system, document_type, uploads, extract, **texts)
    new = F.col("id") > last
    try:
        return store.append(base, after, {"documents": new})
    except BaseException:
        _for_each(after.documents.filter(new), lambda n: files_.remove(uploads.rstrip("/"), n))
        raise


def delete_document(ws: Workspace, id_: int, uploads: str) -> tuple[Workspace, DataFrame]:
    """mutations.delete_document(), and the stored file of that name is removed from uploads, if it is there."""
    after, report = mutations.delete_document(ws, id_)
    row = point_lookup(ws.documents, id_).select("stored_filename", "file_path").first()
    name = (row.stored_filename or row.file_path or "").rsplit("/", 1)[-1]
    if name:
        files_.remove(uploads.rstrip("/"), name)
    return after, report


def stored_file(found: DataFrame, filename: str) -> DataFrame:
    """The file of this base name."""
    return found.filter(T.base_name(F.col("path")) == filename.rsplit("/", 1)[-1]).limit(1)


def extract_again(ws: Workspace, id_: int, found: DataFrame, extract: Callable[[bytes], list[str]] = pdf_pages) -> Workspace:
    """The document's text, status and page count from its stored file as it is now."""
    row = ws.documents.filter(F.col("id") == id_).select("stored_filename", "file_path").first()
    if row is None:
        raise Missing("Document not found.")
    name = (row.file_path or row.stored_filename or "").rsplit("/", 1)[-1]
    result = extracted(stored_file(found, name), extract).first() if name else None
    if result is None:
        raise Missing("The document's file was not found.")
    values = {"extracted_text": result.extracted_text, "extraction_status": result.extraction_status, "page_count": result.page_count, "updated_at": now()}
    return ws.with_tables(documents=patch(ws.documents, F.col("id") == id_, values))


def backup_name(at: Column) -> Column:
    """The archive's name from a time in UTC: its ISO form without colons and dots."""
    return F.concat(F.lit("backup-"), F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-"), F.lit(".tar.gz"))


def backup(ws: Workspace, folder: str, uploads: str | None = None) -> str:
    """Saves all tables to folder/workspace and packs them, with the uploads, as one archive on the driver's disk."""
    save(ws, f"{folder}/workspace")
    archive = f"{folder}/{ws.spark.range(1).select(backup_name(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))).first()[0]}"
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(f"{folder}/workspace", "workspace")
        if uploads and Path(uploads).exists():
            tar.add(uploads, "uploads")
    return archive
