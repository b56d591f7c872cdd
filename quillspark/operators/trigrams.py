"""An extension: an index of three letters for searches in documents.

The index has a row for each three letters in a row that a document has in one
of the searched fields, without case of ASCII letters, each file in order of the letters, so that a query reads few
pages. Documents that have all of a query's letters are candidates; the
search itself decides, on their texts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.specs import DOCUMENTS
from ..sources.workspace import dealt
from . import search

SIZE = 3
#: Candidates whose ids go into the scan's filter; more are joined.
FEW = 2000


def _grams(c: Column) -> Column:
    """Distinct runs of three characters, found by one pattern that goes on by a character."""
    return F.array_distinct(F.regexp_extract_all(T.ascii_lower(F.coalesce(c, F.lit(""))), F.lit(f"(?s)(?=(.{{{SIZE}}}))."), 1))


def postings(documents: DataFrame) -> DataFrame:
    """(gram, id), each once."""
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(f.column)) for f in DOCUMENTS.fields])))
    return documents.select(F.explode(grams).alias("gram"), "id")


def write_index(documents: DataFrame, path: str) -> DataFrame:
    """Writes the index and reads it back. Each file has some documents, in order of letters, then ids, so their
    letters are worked out once and never moved."""
    postings(dealt(documents, "id")).sortWithinPartitions("gram", "id").write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def grams_of(query: object) -> list[str]:
    """The letters that every hit of the query has; [] if it is too short to tell."""
    lowered = "".join(c.lower() if c.isascii() else c for c in T.query_text(query))
    found: dict[str, None] = {}
    for part in lowered.replace("_", "%").split("%"):
        found |= dict.fromkeys(part[i : i + SIZE] for i in range(len(part) - SIZE + 1))
    return list(found)


def candidates(index: DataFrame, query: object) -> DataFrame | None:
    """(id) of the documents that have all of the query's letters; None if any document may."""
    grams = grams_of(query)
    if not grams:
        return None
    lists = index.filter(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n"))
    return lists.filter(F.col("n") == len(grams)).select("id")


def search_documents(documents: DataFrame, index: DataFrame, query: object = "", **request: object) -> DataFrame:
    """search.search_documents() with the index of these documents: the same rows."""
    found = candidates(index, query)
    if found is not None:
        some = found.limit(FEW + 1).collect()
        few = len(some) <= FEW
        documents = documents.filter(F.col("id").isin([r.id for r in some])) if few else documents.join(found, "id", "left_semi").select(*documents.columns)
    return search.search_documents(documents, query, **request)
