"""Toxicity: class-conditional Kneser-Ney models of the characters of words.

Two models are counted by Spark, one over the toxic and one over the ordinary texts of a part of
the labelled rows; orders up to two share the counts of both classes, so an expression that is rare
in a class falls back on common ground. Each word of a text has a log-likelihood in either model.
What is compared is normalised by length: the difference per symbol over the whole text, and the
largest difference per symbol of any one word, since a long text with one insult is toxic too. A
logistic of these, fitted on the other part of the labelled rows, gives the score.

Defined results: a null text counts as empty; an empty text has no differences and gets the score
of a text without evidence; whole texts are read, however long; repeated rows get equal scores;
an empty table gives an empty result; without labelled texts of both classes every score is the
share of toxic rows among those labelled (0 without any). Other columns are neither read nor
disturbed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm import kneser_ney
from galley.llm.shared import (
    Vocabulary,
    byte_words,
    fit_logistic,
    labelled,
    learning_rows,
    pinned,
    remainder,
)

MAX_LABELLED = 1_000_000
MAX_CALIBRATION = 30_000
TOXIC, ORDINARY = 1, 0


def evidence(texts: pd.Series, sent: kneser_ney.Sent) -> np.ndarray:
    """Per text: largest difference of a word per symbol, largest of a word, and mean per symbol."""
    vocabulary = Vocabulary()
    ids = [vocabulary.number(byte_words(t)) for t in texts]
    scores = sent.word_scores(vocabulary.words())
    difference, symbols = scores[:, 0] - scores[:, 1], scores[:, 2]
    rate = difference / np.maximum(symbols, 1)
    out = np.zeros((len(ids), 3))
    for k, own in enumerate(ids):
        if len(own):
            out[k] = rate[own].max(), difference[own].max() / 10, difference[own].sum() / symbols[own].sum()
    return np.clip(out, -5, 8)


def evidenced(rows: DataFrame, model: kneser_ney.Model) -> DataFrame:
    """``rows`` with their evidence ``x``, an array of three numbers."""
    text = F.col("text").cast("string")
    shares = model.shares(kneser_ney.counts(rows), [TOXIC, ORDINARY])
    arrays = shares.sent()
    if arrays is None:
        difference = F.col("p0") - F.col("p1")
        limited = lambda x: F.least(F.greatest(x, F.lit(-5.0)), F.lit(8.0))
        keyed = rows.withColumn("key", F.concat_ws(" ", F.xxhash64(text), F.xxhash64(text, F.lit(1))))  # of equal texts
        own = shares.joined(keyed.select("key", text.alias("text"))).groupBy("key").agg(
            F.array(
                limited(F.max(difference / F.col("symbols"))),
                limited(F.max(difference) / 10),
                limited(F.sum(difference * F.col("n")) / F.sum(F.col("symbols") * F.col("n"))),
            ).alias("x")
        )
        none = F.array(*[F.lit(0.0)] * 3)
        return keyed.join(own, "key", "left").withColumn("x", F.coalesce("x", none)).drop("key")
    sent = rows.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("array<double>")
    def seen(text: pd.Series) -> pd.Series:
        parts = [evidence(text.iloc[k : k + 1000], sent.value) for k in range(0, len(text), 1000)]
        return pd.Series([list(map(float, x)) for part in parts for x in part], dtype=object)

    return rows.withColumn("x", seen(text))


class Scorer:
    """The model and the logistic on its evidence, or a constant score."""

    def __init__(self, model: kneser_ney.Model | None, weights: np.ndarray, constant: float | None = None) -> None:
        self.model, self.weights, self.constant = model, weights, constant

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their score."""
        if self.constant is not None:
            return rows.withColumn("score", F.lit(float(self.constant)))
        *slopes, intercept = map(float, self.weights)
        z = sum((F.col("x")[k] * w for k, w in enumerate(slopes)), F.lit(intercept))
        z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
        return evidenced(rows, self.model).withColumn("score", 1 / (1 + F.exp(-z))).drop("x")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    first: Column,
    second: Column,
    max_labelled: int = MAX_LABELLED,
    max_calibration: int = MAX_CALIBRATION,
) -> Scorer:
    """Learns from the labelled rows where ``first`` or ``second`` holds.

    The logistic is fitted on evidence that models of the first part alone give for rows of the
    second; the models used for scoring count both parts.
    """
    part = F.when(first, 0).otherwise(2)
    rows = learning_rows(docs, labelled(labels, "toxic", first | second, max_labelled))
    counted = pinned(kneser_ney.counts(rows, (F.col("y") > 0).cast("int") + part), "classes")
    both = counted.groupBy((F.col("y") % 2).alias("y"), "code", "rest").agg(F.sum("n").alias("n"))
    of_first, of_both = kneser_ney.fits([counted.where("y < 2"), both], shared=True)
    known = learning_rows(docs, labelled(labels, "toxic", second, max_calibration))
    if set(of_first.classes) != {TOXIC, ORDINARY}:
        share = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
        return Scorer(None, None, share or 0.0)
    got = evidenced(known, of_first).select("x", "y").toPandas()  # at most about max_calibration rows
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, 3)
    weights = fit_logistic(x, (got["y"].to_numpy() > 0).astype(np.float64), ridge=1e-4)
    return Scorer(of_both, weights)


def learn_rows(key: str) -> Column:
    return remainder(key, 3) != 1


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    part = remainder("doc_id", 3)
    scorer = fit(docs, labels, part == 0, part == 2)
    rows = scorer.scored(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.coalesce(~learn_rows("doc_id"), F.lit(False)).alias("held_out"),
        "score",
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
