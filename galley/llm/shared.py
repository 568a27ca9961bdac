"""Helpers of the training-data operators: tables, pinned results, holdouts, words of a batch."""

from __future__ import annotations

import math
import os
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TEXTS_PER_BATCH = 1000


def prepared(spark: SparkSession) -> None:
    """Sets a session up for these operators.

    Texts are long: batches of ``TEXTS_PER_BATCH`` rows keep Python workers small. And workers
    must be able to import the package that the driver has imported: their search path is the one
    the session was started with, so the place of the package is added to it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def pinned(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Cuts the lineage in a way that outlives executors, and makes later readers see one and the
    same set of rows in the same files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


def labelled(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """Rows ``(doc_id, y)`` to learn from: at most about ``bound`` of them, chosen by key hash.

    A document with several label rows takes the largest label; null ids and labels are left
    out. While there are no more than ``bound`` rows, all are used. The bound is what allows
    the result to be broadcast.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = rows.count()
    if n <= bound:
        return rows
    share = math.floor(bound / n * 2**31)
    return rows.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(2**31)) < share)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the labelled documents with their label; ``labels`` comes from ``labelled``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(labels), "doc_id")


class Vocabulary:
    """Numbers the distinct byte words of a batch of texts."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def words(self) -> list[bytes]:
        return list(self.ids)


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def slices(batches: Iterable, size: int = TEXTS_PER_BATCH) -> Iterable:
    """Frames of at most ``size`` rows, so a worker's memory does not follow the batch setting."""
    for batch in batches:
        for start in range(0, len(batch), size):
            yield batch.iloc[start : start + size]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last one: intercept) of a ridge logistic regression, by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        w = np.zeros((x.shape[1] if x.ndim == 2 else 0) + 1)
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
