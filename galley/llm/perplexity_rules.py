"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity by language.

The base rules reject texts with fewer than 20 words and texts in which windows of eight words
that occur twice or more cover over 30 % of the words. Of the rest, a modified Kneser-Ney model,
counted by Spark, gives the perplexity per symbol; n-grams run over the edges of words, with the space
as a symbol, so the order of words counts. No document is scored by a model that has counted it: texts
fall into two halves by hash, and either half is scored by the model of the other. A document is
rejected if it lies outside the band of its language. A band reaches from the lower quartile of
log-perplexity less ``spread`` quartile distances to the perplexity that ``JUNK_SHARE`` of planted junk
exceeds: documents of the language, chosen by hash, with their words shuffled. Of each language
``PLANTED_SHARE`` are taken, and ``PLANTED_LEAST`` documents where that is more. The upper end stays
between ``NEAR`` and ``spread`` quartile distances above the upper quartile; so the share is reached
where shuffling shows, and no language loses its clean texts where it does not.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and
has no perplexity; whole texts are read, however long; repeated rows get equal results; a null
language is a language of its own; languages with fewer than ``MIN_DOCUMENTS`` documents share the
band of all documents; an empty table gives an empty result. Other columns are neither read nor
disturbed. Languages and bands are small written tables, joined without a hint: Spark sends them to
all tasks while they are small, however many languages there are.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm import kneser_ney
from galley.llm.shared import Vocabulary, byte_words, pinned, slices

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
SPREAD = 4.0
NEAR = 1.5
JUNK_SHARE = 0.95
PLANTED_SHARE = 1 / 16
PLANTED_LEAST = 1000
MIN_DOCUMENTS = 50
_SYMBOLS = "#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; ``ids`` are equal for equal words only."""
    if len(ids) < window + 1:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x) - window + 1, dtype=np.uint64)
    for k in range(window):
        h = (h ^ x[k : k + len(h)]) * _BASE
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(x) + 1, dtype=np.int64)
    (at,) = np.nonzero(again)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def same_lines(held: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in held.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def shuffled(text: str) -> str:
    """The words of a text in an order that follows from the text."""
    words = text.split()
    random.Random(text).shuffle(words)
    return " ".join(words)


def with_planted(docs: DataFrame, share: float = PLANTED_SHARE, least: int = PLANTED_LEAST) -> DataFrame:
    """``doc_id, lang, text, half, planted``: the documents, and shuffled copies of some of each language."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"),
        F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), F.lit(False).alias("planted"),
    )

    @F.pandas_udf("string")
    def junk(texts: pd.Series) -> pd.Series:
        return pd.Series([shuffled(t) for t in texts], dtype=object)

    languages = pinned(rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")), "languages")
    wanted = F.greatest(F.lit(share), F.lit(least) / F.col("n"))
    chosen = F.pmod(F.xxhash64(F.lit("planted"), "doc_id", "text"), F.lit(2**31)) < wanted * 2**31
    taken = rows.where("text IS NOT NULL").join(languages, F.col("lang").eqNullSafe(F.col("of"))).where(chosen).drop("of", "n")
    return rows.unionByName(taken.withColumn("text", junk("text")).withColumn("planted", F.lit(True)))


def measured(docs: DataFrame, model: kneser_ney.Model, counted: DataFrame) -> DataFrame:
    """``doc_id, lang, planted``, the counts, and the log-perplexity per symbol (null without words)."""
    shares = model.shares(counted, [0, 1])
    arrays = shares.sent()
    sent = None if arrays is None else docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"]]
            vocabulary = Vocabulary()
            ids = [vocabulary.number(byte_words(t)) for t in texts]
            scores = sent.value.word_scores([w for t in texts for w in kneser_ney.whole(t)]) if sent else None
            at = 0
            rows = []
            for text, own, half in zip(texts, ids, batch["half"], strict=True):
                held = text.encode("utf-8", "replace")
                spaces = len(held) - len(held.translate(None, _SPACES))
                value = None
                if sent and len(own):
                    value = -scores[at, 1 - half] / scores[at, 2]
                    at += 1
                rows.append(
                    (
                        len(own), len(text) - spaces, sum(map(text.count, _SYMBOLS)), same_lines(held),
                        repeated_words(own), value,
                    )
                )
            out = pd.DataFrame(
                rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]
            )
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "lang", batch["lang"].to_numpy())
            out["planted"] = batch["planted"].to_numpy()
            out["key"] = batch["key"].to_numpy()
            out["log_perplexity"] = out["log_perplexity"].astype(float)
            yield out

    # equal for equal texts that are scored by the same half
    key = F.concat_ws(" ", F.xxhash64("text"), F.xxhash64("text", F.lit(1)), "half")
    rows = docs.withColumn("key", key)
    out = rows.mapInPandas(
        run,
        "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, log_perplexity double, planted boolean, key string",
    )
    if sent:
        return out.drop("key")
    # equal texts add to numerator and denominator alike
    own = shares.joined_across(rows).withColumn("other", F.when(F.col("key").endswith(" 0"), F.col("p1")).otherwise(F.col("p0")))
    own = own.select(F.col("key"), (-F.col("other") / F.col("symbols")).alias("joined"))
    return out.join(own, "key", "left").withColumn("log_perplexity", F.col("joined")).drop("key", "joined")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def bands(rows: DataFrame, spread: float = SPREAD) -> tuple[DataFrame, tuple[float, float]]:
    """``(lang, low, high)`` of the languages with a band of their own, and the band of all rows."""
    good = rows.where(~_failed())
    clean, planted = F.when(~F.col("planted"), F.col("log_perplexity")), F.when(F.col("planted"), F.col("log_perplexity"))
    quartiles = F.percentile_approx(clean, [0.25, 0.75], 10000)
    junk = F.percentile_approx(planted, 1 - JUNK_SHARE, 10000)
    distance = F.col("q")[1] - F.col("q")[0]
    low = F.col("q")[0] - spread * distance
    most = F.col("q")[1] + spread * distance
    high = F.least(most, F.greatest(F.col("q")[1] + min(NEAR, spread) * distance, F.coalesce("junk", most)))
    every = good.agg(quartiles.alias("q"), junk.alias("junk")).select(low.alias("low"), high.alias("high")).first()
    own = (
        good.groupBy("lang")
        .agg(quartiles.alias("q"), junk.alias("junk"), F.count(clean).alias("n"))
        .where(F.col("n") >= MIN_DOCUMENTS)
        .select(F.col("lang").alias("band_lang"), low.alias("low"), high.alias("high"))
    )
    return pinned(own, "bands"), (every.low, every.high)


def judged(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Counts, perplexity, band and verdict of every document."""
    rows = with_planted(docs)
    counted = pinned(kneser_ney.counts(rows, F.col("planted").cast("int") * 2 + F.col("half"), across=True), "counted")
    model = kneser_ney.fit(counted.where("y < 2"))
    both = pinned(measured(rows, model, counted), "measured")
    own, (low, high) = bands(both, spread)
    rows = both.where("not planted")
    joined = rows.join(own, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    lowest, highest = F.coalesce("low", F.lit(low)), F.coalesce("high", F.lit(high))
    outside = (F.col("log_perplexity") < lowest) | (F.col("log_perplexity") > highest)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _failed().alias("base_failed"),
        (~_failed() & ~F.coalesce(outside, F.lit(False))).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"), F.exp(lowest).alias("least"), F.exp(highest).alias("most"),
    )
