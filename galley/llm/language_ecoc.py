"""Language identification by error-correcting output codes.

Every language has a codeword of bits. Each bit is predicted by a binary classifier over hashed
character n-grams (1 and 3 characters of a lower-cased word with its edges): the log-ratio of how
often an n-gram occurs in the languages whose bit is one and in those whose bit is zero. A text's
bits are decoded to the language whose codeword has the least weighted loss; the weights say how
reliable a bit is for a language on the learning rows. Texts whose best two codewords lie close
together are flagged as ambiguous.

Spark counts the n-grams over all learning rows; the table has a fixed number of slots per
language. Defined results: null texts and texts without a letter are ``und`` with score 0; very
long texts are read whole; repeated rows get equal results; ties go to the first language by name;
an empty table gives an empty result; without learning rows every text is ``und``. Other columns
are neither read nor disturbed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.shared import Vocabulary, remainder, sigmoid, slices

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
ORDERS = (1, 3)
UNKNOWN = "und"
MAX_WEIGHING = 20_000
_EDGE = 32
_NOISE = bytes(range(0x21, 0x41)) + b"[\\]^_`{|}~"
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_PLAIN = _LOWER.translate(bytes.maketrans(_NOISE, b" " * len(_NOISE)))


def letters_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters; ASCII digits and punctuation part words."""
    if not text:
        return []
    if not text.isascii():
        text = text.lower()
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def word_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, slot)`` of every n-gram of every word; words without a letter have none."""
    texts = [w.decode("utf-8", "replace") for w in words]
    texts = [t if any(map(str.isalpha, t)) else "" for t in texts]
    stream = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owners, slots = [], []
    code = stream.astype(np.uint64)
    for n in ORDERS:
        if len(stream) < n:
            break
        h = np.zeros(len(stream) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = (h ^ code[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        first, last = owner[: len(h)], owner[n - 1 :]
        ok = first == last
        if n == 1:
            ok &= stream != _EDGE
        else:  # an edge alone, or an edge on both sides of nothing, says nothing
            ok &= np.array(lengths, dtype=np.int64)[first] > 2
        owners.append(first[ok])
        slots.append((h[ok] >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(slots)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Bits, 0 or 1, of shape ``(languages, bits)``.

    Up to seven languages take every split of the languages in two; more take random splits, the
    set with the widest least distance out of a number of tries.
    """
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 7:
        splits = range(1, 2 ** (languages - 1))
        return np.array([[s >> k & 1 for s in splits] for k in range(languages)], dtype=np.int8)
    rng = np.random.default_rng(seed)
    bits = math.ceil(15 * math.log2(languages))
    best, widest = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (languages, bits), dtype=np.int8)
        signs = 2 * code.astype(int) - 1
        near = (bits - (signs @ signs.T - 2 * bits * np.eye(languages, dtype=int)).max()) // 2
        mixed = (code.min(0) != code.max(0)).all()
        if mixed and near > widest:
            best, widest = code, near
    return best


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # bits x slots
    trust: np.ndarray  # languages x bits
    gain: float = 4.0

    def margins(self, texts: pd.Series) -> np.ndarray:
        """Mean log-ratio of the n-grams of each text, per bit; nan for a text without letters."""
        vocabulary = Vocabulary()
        ids = [vocabulary.number(letters_words(t)) for t in texts]
        words = vocabulary.words()
        bits = self.code.shape[1]
        sums, sizes = np.zeros((len(words) + 1, bits)), np.zeros(len(words) + 1)
        if words:
            owner, slot = word_slots(words)
            sizes[: len(words)] = np.bincount(owner, minlength=len(words))
            for b in range(bits):
                sums[: len(words), b] = np.bincount(owner, self.weights[b][slot], minlength=len(words))
        out = np.full((len(texts), bits), np.nan)
        for k, held in enumerate(ids):
            total = sizes[held].sum()
            if total:
                out[k] = sums[held].sum(0) / total
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of each codeword, texts x languages."""
        bits = 2 * sigmoid(self.gain * margins) - 1
        loss = np.exp(-self.code[None] * bits[:, None, :])
        return (loss * self.trust[None]).sum(2)

    def decode(self, texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": 0.0, "ambiguous": True})
        margins = self.margins(texts)
        known = ~np.isnan(margins).any(1)
        loss = self.losses(np.nan_to_num(margins))
        share = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(share, axis=1)
        gap = ranked[:, -1] - (ranked[:, -2] if len(self.languages) > 1 else 0)
        names = np.array(self.languages, dtype=object)
        return pd.DataFrame(
            {
                "lang_pred": np.where(known, names[best], UNKNOWN),
                "score": np.where(known, ranked[:, -1], 0.0),
                "ambiguous": ~known | (gap < 0.1),
            }
        )


def counts(rows: DataFrame) -> DataFrame:
    """``(lang, slot, n)`` over all texts of ``rows(text, lang)``; slots are summed per task first."""

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, group in batch.groupby("lang"):
                vocabulary = Vocabulary()
                uses = [vocabulary.number(letters_words(t)) for t in group["text"]]
                words = vocabulary.words()
                if not words:
                    continue
                times = np.bincount(np.concatenate(uses), minlength=len(words))
                owner, slot = word_slots(words)
                part = np.bincount(slot, times[owner], minlength=SLOTS)
                total[lang] = total.get(lang, 0) + part
        for lang, part in total.items():
            (slot,) = np.nonzero(part)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": part[slot].astype(np.int64)})

    return (
        rows.select("text", "lang")
        .mapInPandas(partial, "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame, learn: Callable[[str], Column], max_weighing: int = MAX_WEIGHING) -> Codebook:
    """Learns from rows with a language for which ``learn("doc_id")`` holds.

    Counts cover all of them. The trust in each bit is measured on about ``max_weighing`` rows,
    chosen by key hash.
    """
    rows = docs.where(learn("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = counts(rows).toPandas()  # languages x slots at most
    languages = sorted(got["lang"].unique())
    bits = codewords(len(languages))
    if not languages:
        return Codebook([], bits, np.zeros((1, SLOTS)), bits)
    table = np.zeros((len(languages), SLOTS))
    place = {x: k for k, x in enumerate(languages)}
    table[got["lang"].map(place).to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    shares = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * SLOTS)
    weights = np.zeros((bits.shape[1], SLOTS))
    for b in range(bits.shape[1]):
        one, zero = shares[bits[:, b] == 1], shares[bits[:, b] == 0]
        if len(one) and len(zero):
            weights[b] = np.log(one.mean(0)) - np.log(zero.mean(0))
    signs = (2 * bits - 1).astype(float)
    book = Codebook(languages, signs, weights, np.ones_like(signs) / signs.shape[1])
    book.trust = _trust(book, rows, max_weighing)
    return book


def _trust(book: Codebook, rows: DataFrame, most: int) -> np.ndarray:
    """Share of right bits per language and bit, as weights that sum to one per language."""
    n = rows.count()
    part = rows.where(
        F.pmod(F.xxhash64(F.lit("trust"), "doc_id"), F.lit(2**31)) < math.ceil(min(1, most / max(1, n)) * 2**31)
    )
    place = {x: k for k, x in enumerate(book.languages)}

    def partial(batches):
        right = np.zeros_like(book.code)
        seen = np.zeros(len(place))
        for batch in slices(batches):
            batch = batch[batch["lang"].isin(list(place))]  # a language may have no letters to learn from
            margins = np.nan_to_num(book.margins(batch["text"]))
            k = batch["lang"].map(place).to_numpy(dtype=np.int64)
            np.add.at(right, k, (margins * book.code[k] > 0).astype(float))
            np.add.at(seen, k, 1)
        i, j = np.indices(right.shape).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "good": right[i, j], "n": seen[i]})

    sums = part.select("text", "lang").mapInPandas(partial, "i int, j int, good double, n double")
    trust = np.full_like(book.code, 0.5)
    for r in sums.groupBy("i", "j").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        trust[r.i, r.j] = (r.good + 1) / (r.n + 2)
    return trust / trust.sum(1, keepdims=True)


def decoded(book: Codebook) -> Callable[[Column], Column]:
    """A function of a text column: a struct of ``lang_pred``, ``score`` and ``ambiguous``."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        parts = [book.decode(text.iloc[k : k + 1000]) for k in range(0, len(text), 1000)]
        return pd.concat(parts, ignore_index=True) if parts else book.decode(text)

    return run


def learn_rows(key: str) -> Column:
    return remainder(key, 4) != 2


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document."""
    book = fit(docs, learn_rows)
    rows = docs.select(
        "doc_id",
        F.coalesce(~learn_rows("doc_id"), F.lit(False)).alias("held_out"),
        decoded(book)(F.col("text")).alias("found"),
    )
    return rows.select("doc_id", "held_out", "found.*")


def kept(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is known beyond doubt.

    Rejected are texts without a letter and texts whose best two codewords are about equal.
    """
    book = fit(docs, learn_rows)
    return docs.where(~decoded(book)(F.col("text")).getField("ambiguous"))
