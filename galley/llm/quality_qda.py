"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed counts. Spark sums, per class, the vectors and
their outer products; the driver turns these few sums into class means and shrunken covariances
and keeps their Cholesky factors. A document's score is the logistic of the difference of the two
Gaussian log-densities, each a Mahalanobis distance through the cached factor.

Defined results: a null text counts as empty, an empty text has the vector of an empty text and is
scored like any other; whole texts are read, however long; repeated rows each get their own
(equal) score; an empty table gives an empty result; without labels of both classes every score
is 0.5. Other columns of the input are neither read nor disturbed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.shared import fit_logistic, labelled, learning_rows, pinned, remainder, sigmoid

MAX_LABELLED = 1_000_000
FEATURES = (
    "log_words", "log_word_length", "symbols", "upper", "exclaims", "distinct", "echoed",
    "same_lines", "common_share", "digits", "bare_words", "stops", "adjoined",
)
DIM = len(FEATURES)


_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CAPITALS = _LETTERS[26:]
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>~^_=+@\\{}[]"
_STOPS = b".,;:?"
_HIGH = bytes(range(128, 256))
_PUNCTUATION = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())


def _count(held: bytes, of: bytes) -> int:
    return len(held) - len(held.translate(None, of))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; capitals are those of ASCII."""
    held = (text or "").encode("utf-8", "replace")
    words = held.split()
    n = len(words)
    if n == 0:
        return [0.0] * DIM
    counts = Counter(words)
    chars = len(text)
    inside = chars - len(held) + sum(map(len, words))
    ascii_only = held.translate(None, _HIGH)
    letters = _count(ascii_only, _LETTERS) + chars - len(ascii_only)
    lines = [x for x in held.split(b"\n") if x and not x.isspace()]
    bare = adjoined = 0
    for w, c in counts.items():
        stem = w.rstrip(_PUNCTUATION)
        if not stem:
            bare += c
        elif len(w) - len(stem) > 1:
            adjoined += c
    return [
        math.log1p(n),
        math.log(inside / n),
        math.sqrt(_count(held, _SYMBOLS) / inside),
        math.sqrt(_count(held, _CAPITALS) / max(1, letters)),
        math.sqrt(held.count(b"!") / inside),
        math.log(n / len(counts)) / math.log(n + 1),
        math.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n),
        math.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        math.sqrt(max(counts.values()) / n),
        math.sqrt(_count(held, _DIGITS) / chars),
        math.sqrt(bare / n),
        math.sqrt(_count(held, _STOPS) / n),
        math.sqrt(adjoined / n),
    ]


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, DIM)


def _stacked(xs: pd.Series) -> np.ndarray:
    return np.array(xs.tolist(), dtype=np.float64).reshape(-1, DIM)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes."""

    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    half_logdets: list[float] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        whitened = (x - self.means[k]) @ self.factors[k].T
        return -0.5 * np.einsum("ij,ij->i", whitened, whitened) - self.half_logdets[k]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference per dimension, squashed so far outliers stay comparable."""
        if len(self.means) < 2:
            return np.zeros(len(x))
        return np.arcsinh((self.log_density(x, 1) - self.log_density(x, 0)) / DIM)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), 0.5)
        return sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def vectors(rows: DataFrame) -> DataFrame:
    """``(y, x)`` of labelled texts: label 0 or 1 and the statistics."""

    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in text])

    return rows.select((F.col("y") > 0).cast("int").alias("y"), of("text").alias("x"))


def class_sums(rows: DataFrame) -> DataFrame:
    """``(y, i, j, total)``: per class the count (-1, -1), sums (i, -1) and product sums (i, j)."""

    def partial(batches):
        sums = {}
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), _stacked(batch["x"])])
            y = batch["y"].to_numpy()
            for k in (0, 1):
                part = x[y == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        for k, s in sums.items():
            i, j = np.nonzero(np.tri(DIM + 1, dtype=bool))
            yield pd.DataFrame({"y": k, "i": i - 1, "j": j - 1, "total": s[i, j]})

    parts = rows.mapInPandas(partial, "y int, i int, j int, total double")
    return parts.groupBy("y", "i", "j").agg(F.sum("total").alias("total"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Callable[[str], Column],
    shrink: float = 0.25,
    max_labelled: int = MAX_LABELLED,
) -> Discriminant:
    """Learns from labelled rows for which ``learn("doc_id")`` holds.

    A class covariance is ``(1 - shrink)`` of its own and ``shrink`` of the pooled one, on
    features scaled by the pooled deviation, plus a small ridge.
    """
    known = labelled(labels, "quality", learn("doc_id"), max_labelled)
    rows = pinned(vectors(learning_rows(docs, known)), "quality")
    total = np.zeros((2, DIM + 1, DIM + 1))
    for r in class_sums(rows).collect():  # two classes, a fixed number of sums
        total[r.y, r.i + 1, r.j + 1] = total[r.y, r.j + 1, r.i + 1] = r.total
    n = total[:, 0, 0]
    if n.min() < 2:
        return Discriminant()
    means = [total[k, 0, 1:] / n[k] for k in (0, 1)]
    own = [total[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    model = Discriminant()
    for k in (0, 1):
        weight = max(shrink, DIM / n[k]) if DIM < n[k] else 1.0
        mixed = ((1 - weight) * own[k] + weight * pooled) / np.outer(spread, spread)
        lower = np.linalg.cholesky(mixed + 0.02 * np.eye(DIM))
        model.means.append(means[k])
        model.factors.append(np.linalg.inv(lower) / spread)
        model.half_logdets.append(float(np.log(np.diag(lower)).sum()))
    model.scale = _scaled(model, rows)
    return model


def _scaled(model: Discriminant, rows: DataFrame, bins: int = 64) -> tuple[float, float]:
    """Slope and intercept that make the margin a probability, from its histogram by class."""

    @F.pandas_udf("double")
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(model.margin(_stacked(x)))

    counts = rows.groupBy(F.round(margin("x") * bins / 8).cast("int").alias("bin"), "y").count().collect()
    x = np.array([r.bin * 8 / bins for r in counts])
    y = np.array([float(r.y) for r in counts])
    c = np.array([float(r["count"]) for r in counts])
    repeats = np.maximum(1, np.round(c * min(1, 20000 / c.sum()))).astype(int)
    w = fit_logistic(np.repeat(x, repeats)[:, None], np.repeat(y, repeats), ridge=1e-4)
    return float(w[0]), float(w[1])


def _column(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(of(matrix(text)))

    return run


def score(model: Discriminant) -> Callable[[Column], Column]:
    """A function of a text column: the probability that the document is of quality."""
    return _column(lambda x: model.score(x))


def learn_rows(key: str) -> Column:
    return remainder(key, 5) != 0


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels, learn_rows)
    return docs.select(
        "doc_id",
        F.coalesce(~learn_rows("doc_id"), F.lit(False)).alias("held_out"),
        score(model)(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels, learn_rows)
    return docs.where(score(model)(F.col("text")) >= threshold)
