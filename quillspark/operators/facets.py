"""Option lists for filters and suggestions. Each is an aggregate with a map-side part: what is shuffled are distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def stored_options(df: DataFrame, column: str) -> DataFrame:
    """(value): distinct values as stored that aren't blank, without case for ASCII letters."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    return values.orderBy(T.ascii_lower(F.col("value")), "value")


def options(df: DataFrame, column: str) -> DataFrame:
    """(value): distinct trimmed values that aren't empty, in the order of a dictionary without case and accents."""
    values = df.select(T.normalize(F.col(column)).alias("value")).filter("value <> ''").distinct()
    return values.orderBy(F.collate("value", "UNICODE_CI_AI"), "value")


def client_options(df: DataFrame, column: str) -> DataFrame:
    """(value): distinct non-empty values, untrimmed, in the order of a dictionary."""
    values = df.select(F.col(column).alias("value")).filter("value <> ''").distinct()
    return values.orderBy(F.collate("value", "UNICODE"), "value")


#: How an option list takes a value, which values it leaves out, and its order.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]] = {
    "stored": (lambda c: c, lambda v: F.trim(v) != "", lambda v: T.ascii_lower(v)),
    "plain": (T.normalize, lambda v: v != "", lambda v: F.collate(v, "UNICODE_CI_AI")),
}


def counts(df: DataFrame, columns: dict[str, str], kind: str = "plain") -> DataFrame:
    """(facet, value, n): the values of several option lists (facet name -> column) with the number of their rows, from one scan.

    A row gives one (facet, value) for each list; they are counted before they are shuffled.
    """
    value, keep, _ = KINDS[kind]
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value(F.col(c)).alias("value")) for name, c in columns.items()])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").filter(keep(F.col("value")))
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def several(df: DataFrame, columns: dict[str, str], kind: str = "plain") -> DataFrame:
    """(facet, value) for several option lists in the order of columns, each in its own order."""
    _, _, order = KINDS[kind]
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("facet"))
    return counts(df, columns, kind).orderBy(place, order(F.col("value")), "value").select("facet", "value")


def suggestions(saved: list[str], df: DataFrame, column: str) -> DataFrame:
    """(value, place): saved values, then those in use; of values equal without case the first spelling stands."""
    spark = df.sparkSession
    first = spark.createDataFrame([(v, i) for i, v in enumerate(saved)], "value string, at long").select(F.lit(0).alias("rank"), "at", "value")
    used = df.select(T.normalize(F.col(column)).alias("value")).distinct().select(F.lit(1).alias("rank"), F.lit(0).cast("long").alias("at"), "value")
    both = first.unionByName(used).withColumn("value", T.normalize(F.col("value"))).filter("value <> ''")
    key = F.struct("rank", "at", F.lower("value").alias("l"), "value")
    found = both.groupBy(F.lower("value").alias("key")).agg(F.min(key).alias("first"))
    return found.select("first.*").select("value", "rank", "at").orderBy("rank", "at", F.collate("value", "UNICODE"), "value")
