"""An extension: a stream of changed rows into a versioned workspace.

A change has an id of its own (change_id), a time (at), whether its record is
gone (gone), and the record's columns. Changes that come again within the delay are
taken once; those that are older than the delay behind the newest one seen are
dropped. Of a batch the last change of each record counts. Each batch is one version
of the store and leaves its number there, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Conflict, Store
from ..sources.workspace import TABLES, schema

#: Columns of a change besides the record's own.
CHANGE = "change_id string, at timestamp, gone boolean"


def change_schema(table: str) -> str:
    return f"{CHANGE}, {TABLES[table][0]}"


def last_changes(batch: DataFrame, table: str) -> DataFrame:
    """One row for each record: its last change; of changes at one time the one with the greatest change_id."""
    columns = ["gone", *[f.name for f in schema(table)]]
    last = batch.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("at", "change_id")).alias("last"))
    return last.select("last.*")


def apply(store: Store, table: str, stream: str, retries: int = 5) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: each batch as one version. Another writer's version in between is taken as the new base."""

    def run(batch: DataFrame, number: int) -> None:
        changes = last_changes(batch, table).persist()  # used for the ids and for the rows
        try:
            for attempt in range(retries + 1):
                snapshot = store.snapshot()
                if snapshot.seen.get(stream, -1) >= number:
                    return
                gone = F.coalesce("gone", F.lit(False))
                try:
                    store.upsert(snapshot.version, table, changes.filter(~gone), changes.filter(gone), {stream: number})
                    return
                except Conflict:
                    if attempt == retries:
                        raise
        finally:
            changes.unpersist()

    return run


def follow(changes: DataFrame, store: Store, table: str, stream: str, checkpoint: str, delay: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Brings a stream of changes (change_schema()) into the store. stream: its name among the streams of this store."""
    once = changes.withWatermark("at", delay).dropDuplicatesWithinWatermark(["change_id"])
    writer = once.writeStream.foreachBatch(apply(store, table, stream)).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
