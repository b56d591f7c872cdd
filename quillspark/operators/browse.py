"""The second query layer, over rows that are listed already: filters with an 'all' choice, plain keyword search, date and title orders, counts and selection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.checkpoints import checkpoint
from .dashboard import ACTIVE

#: Columns of the plain search; descriptions and safety notes don't take part.
SYMPTOM_FIELDS = ["title", "system", "suspected_causes", "notes"]
PROCEDURE_FIELDS = ["title", "system", "tools_needed", "parts_needed", "notes", "steps"]


def choose(df: DataFrame, **filters: str) -> DataFrame:
    for column, value in filters.items():
        if value and value != "all":
            df = df.filter(F.col(column) == value)
    return df


def status_filter(status: str) -> Column:
    if status == "all":
        return F.lit(True)
    return F.col("status").isin(ACTIVE) if status == "active" else F.col("status") == status


def favorite_filter(choice: str) -> Column:
    return {"favorites_only": F.col("is_favorite"), "not_favorites": ~F.col("is_favorite")}.get(choice, F.lit(True))


def extraction_filter(choice: str) -> Column:
    return F.lit(True) if choice == "all" else T.extraction_class(F.col("extraction_status")) == choice


def keyword(df: DataFrame, query: object, columns: list[str]) -> DataFrame:
    """Rows with the query in one of the columns, whose values aren't trimmed."""
    q = T.query_text(query).lower()
    return df.filter(reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q)) for c in columns])) if q else df


def date_of(*columns: str) -> Column:
    """The first column with content as a time; what can't be read is 1970."""
    text = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(F.lit(0)))


def ordered(df: DataFrame, sort: str = "newest", dates: tuple[str, ...] = ("updated_at", "created_at"), accents: bool = True, incoming: tuple[Column, ...] = ()) -> DataFrame:
    """sort: 'title' ('accents' and case matter or not), 'oldest', else newest. Ties keep the incoming order, by default newest first, then id."""
    ties = incoming or (F.col("updated_at").desc_nulls_last(), F.desc("id"))
    if sort == "title":
        return df.orderBy(F.collate(F.coalesce("title", F.lit("")), "UNICODE" if accents else "UNICODE_CI_AI"), *ties)
    return df.orderBy(date_of(*dates).asc() if sort == "oldest" else date_of(*dates).desc(), *ties)


def status_histogram(symptoms: DataFrame) -> DataFrame:
    """Total, monitoring, resolved; any other status counts as open."""
    monitoring, resolved = F.count_if(F.col("status") == "monitoring"), F.count_if(F.col("status") == "resolved")
    return symptoms.agg(F.count("*").alias("total"), (F.count("*") - monitoring - resolved).alias("open"), monitoring.alias("monitoring"), resolved.alias("resolved"))


def visible_counts(df: DataFrame, visible: Column, noun: str) -> DataFrame:
    """visible, total and the sentence about them, in one pass."""
    counted = df.agg(F.count_if(visible).alias("visible"), F.count("*").alias("total"))
    return counted.withColumn("sentence", T.count_sentence(F.col("visible"), F.col("total"), noun))


def selection(df: DataFrame, requested: int | None, current: int | None, *order: Column) -> DataFrame:
    """The row to show: the requested one, else the current one, else the first; no row of an empty table."""
    rank = F.when(F.col("id") == F.lit(requested), 0).when(F.col("id") == F.lit(current), 1).otherwise(2)
    return df.orderBy(rank, *(order or (F.col("updated_at").desc_nulls_last(), F.desc("id")))).limit(1)


def places(df: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """df with `place`, the number of each row in the order, from 1; the order has to be one without ties.

    Rows are dealt by ranges of the order and sorted within them. That is kept, as the ranges are sampled anew in
    each run; then a row's place is its place in its range and the sizes of the ranges before it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_within": within}))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range, n at most
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_within") + 1).drop("_range", "_within", "_before")


def page(ordered_rows: DataFrame, size: int = 100) -> DataFrame:
    """The first rows of an order with their place in it, from 1. Each task keeps `size` rows, so nothing is sorted as a whole."""
    return ordered_rows.limit(size).withColumn("place", F.monotonically_increasing_id() + 1)
