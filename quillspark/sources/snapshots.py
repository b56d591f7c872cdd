"""Versions of a workspace under one path: immutable folders of files and a list of what a version has.

`path/versions/<n>.json` names, for each table, its folders and the files in
them that later changes replaced. A change writes new files, then its list
under the next number, which must not exist yet: whoever comes second gets a
Conflict and has changed nothing. Readers take the highest number; nothing that
it names is ever written again, so they see one version as a whole.

A change of few rows finds the files that hold them, by the statistics in
their footers and one column, writes these files' rows anew and keeps the others.

The list is put in place by a hard link on local file systems and by a rename
that doesn't overwrite elsewhere, as HDFS has it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import delete
from .workspace import TABLES, Workspace, conform, schema


class Conflict(RuntimeError):
    """Someone else wrote the next version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version: for each table its folders, and files in them that don't count any more; for each stream the last batch that it has."""

    version: int
    folders: Mapping[str, list[str]]
    dropped: Mapping[str, list[str]]
    seen: Mapping[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()

    # -- versions

    def _at(self, name: str):
        at = self._hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        at, system = self._at("versions")
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest one if none is named."""
        known = self.versions()
        if not known or version not in (None, *known):
            raise LookupError(f"no version {version if version is not None else ''} at {self.path}")
        at, system = self._at(f"versions/{known[-1] if version is None else version}.json")
        stream = system.open(at)
        try:
            body = bytes(self._hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()
        found = json.loads(body)
        return Snapshot(**found)

    def _put(self, snapshot: Snapshot) -> None:
        """Puts the list of a version in place, if its number is free."""
        temp, system = self._at(f"versions/_{uuid.uuid4().hex}")
        out = system.create(temp, False)
        out.write(json.dumps(asdict(snapshot)).encode())
        out.close()
        to, _ = self._at(f"versions/{snapshot.version}.json")
        try:
            if system.getUri().getScheme() == "file":
                os.link(temp.toUri().getPath(), to.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
                self._hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(temp, to, none)
        except Exception as error:
            if isinstance(error, FileExistsError) or "already exists" in str(error):
                raise Conflict(f"version {snapshot.version} was written by someone else") from None
            raise
        finally:
            system.delete(temp, False)

    # -- reading

    def table(self, snapshot: Snapshot, name: str) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in snapshot.folders.get(name, [])]
        if not folders:
            return self.spark.createDataFrame([], schema(name))
        rows = self.spark.read.parquet(*folders)
        gone = snapshot.dropped.get(name, [])
        # a condition on names of files alone is checked while files are listed: these aren't opened
        return rows.filter(~F.col("_metadata.file_name").isin(gone)) if gone else rows

    def load(self, version: int | None = None) -> Workspace:
        snapshot = self.snapshot(version)
        return Workspace(**{n: conform(self.table(snapshot, n), n) for n in TABLES})

    # -- writing

    def _written(self, name: str, rows: DataFrame) -> str:
        folder = f"tables/{name}/{uuid.uuid4().hex}"
        conform(rows, name).write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, base: int, rows: Mapping[str, DataFrame], dropped: Mapping[str, Iterable[str]] | None = None, whole: bool = False, seen: Mapping[str, int] | None = None) -> int:
        """The version after base: its tables with these rows more and without these files. whole: the rows are all that these tables have; seen: batches of streams.

        If the number is taken, what was written is deleted and Conflict raised.
        """
        before = self.snapshot(base) if base else Snapshot(0, {}, {})
        new: dict[str, str] = {}
        try:
            for name, part in rows.items():
                new[name] = self._written(name, part)
            folders = {n: [f for f in before.folders.get(n, []) if not (whole and n in new)] + ([new[n]] if n in new else []) for n in TABLES}
            gone = {n: [] if whole and n in new else sorted({*before.dropped.get(n, []), *(dropped or {}).get(n, [])}) for n in TABLES}
            at, system = self._at("versions")
            system.mkdirs(at)
            self._put(Snapshot(base + 1, folders, gone, {**before.seen, **(seen or {})}))
        except BaseException:
            for folder in new.values():
                delete(self.spark, f"{self.path}/{folder}")
            raise
        return base + 1

    def save(self, ws: Workspace, base: int = 0) -> int:
        """All tables of ws as the version after base (0: the first one)."""
        return self.commit(base, {n: getattr(ws, n) for n in TABLES}, whole=True)

    def files_with(self, snapshot: Snapshot, name: str, at: Column) -> list[str]:
        """Names of the table's files that hold a row where `at` holds: as many as are to be written anew."""
        rows = self.table(snapshot, name)
        return sorted(r[0] for r in rows.filter(at).select("_metadata.file_name").distinct().collect())

    def rewrite(self, base: int, change: Callable[[Workspace], Workspace], touched: Mapping[str, Column]) -> int:
        """The version after base with a change of rows that are there.

        touched: for each table that changes, a condition that holds for the rows that do. `change` gets
        a workspace in which these tables have the rows of the files in question only, and the other tables are whole.
        """
        snapshot = self.snapshot(base)
        full = self.load(base)
        gone = {n: self.files_with(snapshot, n, at) for n, at in touched.items()}
        part = {n: conform(self.table(snapshot, n).filter(F.col("_metadata.file_name").isin(f) if f else F.lit(False)), n) for n, f in gone.items()}
        given = full.with_tables(**part)
        after = change(given)
        for name in TABLES:
            if name not in touched and getattr(after, name) is not getattr(given, name):
                raise ValueError(f"{name} changes, but no rows of it are named")
        changed = {n: getattr(after, n) for n in touched if getattr(after, n) is not part[n]}
        return self.commit(base, changed, {n: gone[n] for n in changed})

    def append(self, base: int, ws: Workspace, new: Mapping[str, Column]) -> int:
        """The version after base with the rows of ws where the condition of their table holds; the rest of ws is taken to be there already."""
        return self.commit(base, {n: getattr(ws, n).filter(at) for n, at in new.items()})

    def upsert(self, base: int, name: str, rows: DataFrame, gone: DataFrame, seen: Mapping[str, int] | None = None) -> int:
        """The version after base in which these rows (one for each id) replace those of their ids, and the ids in `gone` have none; other files stay as they are."""
        table, ids = self.table(self.snapshot(base), name), rows.select("id").unionByName(gone.select("id"))
        files = sorted(r[0] for r in table.select("id", F.col("_metadata.file_name").alias("_file")).join(ids, "id", "left_semi").select("_file").distinct().collect())
        kept = conform(table.filter(F.col("_metadata.file_name").isin(files) if files else F.lit(False)), name).join(ids, "id", "left_anti")
        return self.commit(base, {name: kept.unionByName(conform(rows, name))}, {name: files}, seen=seen)

    def compact(self, base: int, name: str) -> int:
        """The version after base with one folder for the table and no dropped files."""
        return self.commit(base, {name: self.table(self.snapshot(base), name)}, whole=True)

    def expire(self, keep: int = 1) -> int:
        """Deletes all versions but the last ones, and folders that only they had; how many folders."""
        known = self.versions()
        old, new = known[:-keep] if keep else [], known[-keep:]
        used = {f for v in new for fs in self.snapshot(v).folders.values() for f in fs}
        gone = {f for v in old for fs in self.snapshot(v).folders.values() for f in fs} - used
        for version in old:
            delete(self.spark, f"{self.path}/versions/{version}.json")
        for folder in gone:
            delete(self.spark, f"{self.path}/{folder}")
        return len(gone)


def rows_of(kind: str, id_: int) -> dict[str, Column]:
    """What an update or a deletion of this record touches, for Store.rewrite()."""
    own = {f"{kind}s": F.col("id") == id_}
    if kind in ("symptom", "procedure"):
        return own | {f"{kind}_documents": F.col(f"{kind}_id") == id_}
    if kind == "document":
        linked = (F.col("related_entity_type") == "document") & (F.col("related_entity_id") == id_)
        return own | {b: F.col("document_id") == id_ for b in ("symptom_documents", "procedure_documents")} | {"notes": F.coalesce(linked, F.lit(False)) | F.coalesce(F.col("document_id") == id_, F.lit(False))}
    return own


def new_rows(kind: str, id_: int) -> dict[str, Column]:
    """The rows of a record that was just created, for Store.append()."""
    return {t: at for t, at in rows_of(kind, id_).items() if t == f"{kind}s" or kind in ("symptom", "procedure")}
