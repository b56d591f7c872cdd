"""An extension: top rows of each group, running figures, and the state that a record had at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], *order: Column, size: int = 3) -> DataFrame:
    """The first rows of each group with their `place`; the order has to be one without ties.

    Each task keeps that many rows of a group before anything is shuffled, so a group of any size is no load.
    """
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("place") <= size)


def newest_notes(notes: DataFrame, size: int = 3) -> DataFrame:
    """The newest notes of each record that notes link to."""
    linked = notes.filter(F.col("related_entity_type").isin("document", "symptom", "procedure") & (F.col("related_entity_id") > 0))
    return top_rows(linked, ["related_entity_type", "related_entity_id"], F.col("updated_at").desc_nulls_last(), F.desc("id"), size=size)


def running(df: DataFrame, day: Column, counted: Column, span: int = 7) -> DataFrame:
    """(day, n, total, recent): rows that count on each day, up to it, and in the last `span` days.

    Days are counted first, so the windows go over as many rows as there are days; rows without a day are left out.
    """
    days = df.select(day.cast("date").alias("day"), counted.alias("counted")).filter("day IS NOT NULL").groupBy("day").agg(F.count_if("counted").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    recent = Window.orderBy(number).rangeBetween(1 - span, 0)
    return days.select("day", "n", F.sum("n").over(so_far).alias("total"), F.sum("n").over(recent).alias("recent"))


def open_over_time(symptoms: DataFrame, span: int = 7) -> DataFrame:
    """Symptoms that are open, by the day they were created."""
    return running(symptoms, F.col("created_at"), F.coalesce(F.col("status") == "open", F.lit(False)), span)


def validity(versions: DataFrame, keys: list[str], time: str) -> DataFrame:
    """versions with `valid_to`, the time of the record's next version; null for the last one."""
    return versions.withColumn("valid_to", F.lead(time).over(Window.partitionBy(*keys).orderBy(time)))


def as_of(events: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, values: list[str], bucket: int = 30 * 86400) -> DataFrame:
    """events with the values that the newest version of their record has at or before their time; null before the first one.

    keys name the record in both tables and aren't null; a record has one version for each time at most. Time is cut into buckets of
    so many seconds. In a bucket of a record, events and versions are put in order; what was valid when the
    bucket began is carried over from a row for each bucket. So a record with very many
    events is spread over its buckets, and nothing is paired.
    """
    which = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket)
    none = F.lit(None).cast(versions.select(F.struct(*values)).schema[0].dataType)
    row = events.select(F.struct("*")).schema[0].dataType
    v = versions.select(*keys, which(since).alias("_bucket"), F.col(since).cast("timestamp").alias("_time"), F.lit(0).alias("_kind"), F.struct(*values).alias("_value"), F.lit(None).cast(row).alias("_row"))
    e = events.select(*keys, which(at).alias("_bucket"), F.col(at).cast("timestamp").alias("_time"), F.lit(1).alias("_kind"), none.alias("_value"), F.struct(*events.columns).alias("_row"))
    both = v.unionByName(e)
    before = Window.partitionBy(*keys, "_bucket").orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_now", F.last("_value", ignorenulls=True).over(before)).filter("_kind = 1")
    last = both.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.col("_time"))).alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_bucket", F.last("_value", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried IS NOT NULL")
    found = inside.join(carried, [*keys, "_bucket"], "left").select("_row", F.coalesce("_now", "_carried").alias("_found"))
    return found.select("_row.*", *[F.col("_found")[c].alias(c) for c in values])
