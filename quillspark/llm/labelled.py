"""Bounded samples of labelled rows for fitting classifiers, and small helpers of theirs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text


def held_out(fold: tuple[int, int], column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo fold[0], is fold[1]; a null id is held out, so nothing is learnt from it."""
    return F.coalesce(crc32_text(column) % fold[0] == fold[1], F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most most[v] labelled rows for each label value v, by a hash of the id; held-out rows never.

    The choice is made on ids and labels alone; their number is bounded, so
    broadcasting them to the texts is too. Of several texts of one id the least stands.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(~held_out(fold) & F.col("label").isin(*most)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.filter("label = other").select("doc_id", "label")  # rows that contradict each other teach nothing
    chosen = [r for value, n in most.items() for r in known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def platt(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a x + b))) fitted to 0/1 labels by Newton's method with a small ridge."""
    x = np.stack([values, np.ones_like(values)], 1)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    y = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
