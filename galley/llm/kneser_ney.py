"""Modified Kneser-Ney models over the characters of words, counted and kept by Spark.

A word is the sequence of its characters and an end mark, each predicted from the four symbols
before it (start marks first). An n-gram of up to five symbols is two integers: ``code`` has 12 bits
a symbol, the low 11 bits of its code point and a bit for those from U+0800 up, ``rest`` has 10 bits
a symbol, the upper bits of the code point. Together they are the whole n-gram, so counts,
continuation counts, discounts and back-off weights are plain aggregations of integers.

Counts cover every word of every text given; they are summed by word, batch and task before they
are shuffled. A model keeps every n-gram and every context, as a written table; no part of it passes
the driver. Probabilities are found by joins for the distinct n-grams of the texts that are to be
scored: what the model has of all their orders at once, then each order with the one below. Spark's
driver takes memory for every job and exchange, whatever the rows, so several models are fitted in
the same jobs and orders are written one by one. ``Shares`` holds the probabilities: up to ``MAX_SENT`` of them are sent to the tasks, more
are joined to the words. Both ways give the same scores.

With classes, the orders above ``SHARED`` are counted by class and the lower ones over all classes
together, so expressions that are rare in a class fall back on shared counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.shared import Vocabulary, byte_words, pinned, slices

ORDER = 5
SYMBOL_BITS = 12
REST_BITS = 10
SHARED = 2
MAX_SENT = 4_000_000  # n-grams sent to every task; more are joined
_PAD, _END = 1, 2
_MASKS = [np.int64((1 << (SYMBOL_BITS * k)) - 1) for k in range(ORDER + 1)]
_RESTS = [np.int64((1 << (REST_BITS * k)) - 1) for k in range(ORDER + 1)]
_FLUSH = 4_000_000
_GRAM = ["code", "rest"]


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, code, rest)`` of every symbol of every word: five symbols in two integers."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = "\x02" + "\x01" * (ORDER - 1)
    marks = bytes([0, 1, 2]), bytes([3, 3, 3])
    text = "\x01" * (ORDER - 1)
    text += gap.join(w.translate(bytes.maketrans(*marks)).decode("utf-8", "replace") for w in words) + "\x02"
    stream = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    symbol = (stream & 2047) | ((stream > 2047) << 11)
    code = np.zeros(len(symbol) - ORDER + 1, dtype=np.int64)
    rest = np.zeros_like(code)
    for k in range(ORDER):
        code = (code << SYMBOL_BITS) | symbol[k : k + len(code)]
    upper = stream >> 11
    if upper.any():
        for k in range(ORDER):
            rest = (rest << REST_BITS) | upper[k : k + len(code)]
    last = symbol[ORDER - 1 :]
    owner = np.cumsum(last == _END) - (last == _END)
    ok = last != _PAD
    return owner[ok], code[ok], rest[ok]


def distinct(code: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams, and for each given one its place among them."""
    if not rest.any():
        code, at = np.unique(code, return_inverse=True)
        return code, np.zeros_like(code), at
    order = np.lexsort((code, rest))
    code, rest = code[order], rest[order]
    new = np.concatenate([[True], (np.diff(code) != 0) | (np.diff(rest) != 0)])
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return code[new], rest[new], at


def whole(text: str | None) -> list[bytes]:
    """The words of a text as one, with single spaces between, so that n-grams run over their edges."""
    words = byte_words(text)
    return [b" ".join(words)] if words else []


def chunks(words: list[bytes], size: int = 2_000_000) -> Iterable[tuple[int, list[bytes]]]:
    """Parts of about ``size`` bytes with the place of their first word."""
    start = held = 0
    for k, word in enumerate(words):
        if held and held + len(word) > size:
            yield start, words[start:k]
            start, held = k, 0
        held += len(word)
    if start < len(words):
        yield start, words[start:]


def counts(rows: DataFrame, group: Column | None = None, across: bool = False) -> DataFrame:
    """``(y, code, rest, n)`` of all words of ``rows.text``, ``y`` the group (0 without one).

    With ``across``, n-grams run over the edges of words.
    """
    units = whole if across else byte_words

    def partial(batches):
        held: dict[int, list] = {}
        size = 0

        def merged():
            for y, parts in held.items():
                code, rest, at = distinct(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
                n = np.bincount(at, np.concatenate([p[2] for p in parts]))
                yield y, code, rest, n

        for batch in slices(batches):
            for y, part in batch.groupby("y"):
                vocabulary = Vocabulary()
                uses = [vocabulary.number(units(t)) for t in part["text"]]
                words = vocabulary.words()
                if not words:
                    continue
                times = np.bincount(np.concatenate(uses), minlength=len(words))
                for start, some in chunks(words):
                    owner, code, rest = word_codes(some)
                    code, rest, at = distinct(code, rest)
                    held.setdefault(int(y), []).append((code, rest, np.bincount(at, times[start + owner])))
                    size += len(code)
            if size > _FLUSH:
                held = {y: [tuple(parts)] for y, *parts in merged()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > _FLUSH // 2:
                    for y, ((code, rest, n),) in held.items():
                        yield pd.DataFrame({"y": y, "code": code, "rest": rest, "n": n.astype(np.int64)})
                    held, size = {}, 0
        for y, code, rest, n in merged():
            yield pd.DataFrame({"y": y, "code": code, "rest": rest, "n": n.astype(np.int64)})

    group = F.lit(0) if group is None else group
    parts = rows.select(F.col("text").cast("string").alias("text"), group.cast("int").alias("y"))
    return (
        parts.where("y is not null")
        .mapInPandas(partial, "y int, code long, rest long, n long")
        .groupBy("y", *_GRAM)
        .agg(F.sum("n").alias("n"))
    )


@dataclass
class Sent:
    """Sorted n-grams with their logarithms of probability, one column a class."""

    codes: np.ndarray
    rests: np.ndarray
    logs: np.ndarray
    plain: int  # the first n-grams, whose rest is zero

    def get(self, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The rows of n-grams, every one of which is held."""
        at = np.searchsorted(self.codes[: self.plain], code)
        (odd,) = np.nonzero(rest)
        if len(odd):
            codes, rests, held, by = self._odd
            wanted = np.searchsorted(codes, code[odd]) * len(rests) + np.searchsorted(rests, rest[odd])
            at[odd] = self.plain + by[np.searchsorted(held, wanted)]
        return self.logs[at]

    @cached_property
    def _odd(self) -> tuple[np.ndarray, ...]:
        """The other n-grams as one sorted number each, made of the places of both integers."""
        codes, own = np.unique(self.codes[self.plain :], return_inverse=True)
        rests, upper = np.unique(self.rests[self.plain :], return_inverse=True)
        held = own * len(rests) + upper
        by = np.argsort(held)
        return codes, rests, held[by], by

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each class, words x classes; last column: symbols."""
        classes = self.logs.shape[1]
        out = np.zeros((len(words), classes + 1))
        for start, some in chunks(words):
            owner, code, rest = word_codes(some)
            code, rest, at = distinct(code, rest)
            logs, part = self.get(code, rest), slice(start, start + len(some))
            for c in range(classes):
                out[part, c] = np.bincount(owner, logs[at, c], minlength=len(some))
            out[part, -1] = np.bincount(owner, minlength=len(some))
        return out


@dataclass
class Shares:
    """``table``: ``code, rest, p0, p1, ...``, the log-probability of every n-gram in each class; ``n`` rows."""

    table: DataFrame
    n: int
    classes: int

    def sent(self) -> Sent | None:
        """All of it as arrays, where it is small enough to go to every task."""
        if self.n > MAX_SENT:
            return None
        logs = [F.col(f"p{c}").cast("float") for c in range(self.classes)]
        got = self.table.select(*_GRAM, *logs).toArrow()
        code, rest, *logs = (got.column(i).to_numpy() for i in range(2 + self.classes))
        by = np.lexsort((code, rest))
        rest = rest[by]
        plain = int(np.searchsorted(rest, 1))
        return Sent(code[by], rest, np.column_stack([x[by] for x in logs]), plain)

    def joined(self, texts: DataFrame) -> DataFrame:
        """``key, n, symbols, p0, p1, ...`` of each distinct word of ``texts(key, text)``, ``n`` times in the text.

        Words are scored once each; texts do not move, but their distinct words do.
        """

        def words_of(batches):
            for batch in slices(batches):
                rows = [
                    (key, word, n)
                    for key, text in zip(batch["key"], batch["text"], strict=True)
                    for word, n in Counter(byte_words(text)).items()
                ]
                yield pd.DataFrame(rows, columns=["key", "word", "n"], dtype=object)

        def codes_of(batches):
            for batch in slices(batches):
                words = list(batch["word"])
                owner, code, rest = word_codes(words)
                at = pd.Series(words, dtype=object).iloc[owner].reset_index(drop=True)
                yield pd.DataFrame({"word": at, "code": code, "rest": rest})

        key = texts.schema["key"].dataType.simpleString()
        held = pinned(texts.select("key", "text").mapInPandas(words_of, f"key {key}, word binary, n long"), "words")
        codes = held.select("word").distinct().mapInPandas(codes_of, "word binary, code long, rest long")
        columns = [f"p{c}" for c in range(self.classes)]
        scores = (
            codes.join(self.table, _GRAM)
            .groupBy("word")
            .agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("symbols"))
        )
        return held.join(scores, "word").select("key", "n", "symbols", *columns)

    def joined_across(self, texts: DataFrame) -> DataFrame:
        """``key, symbols, p0, p1, ...`` of ``texts(key, text)``, with n-grams over the edges of words.

        The distinct n-grams of each text move. A key that repeats adds up.
        """

        def codes_of(batches):
            for batch in slices(batches, 100):
                for key, text in zip(batch["key"], batch["text"], strict=True):
                    code, rest, at = distinct(*word_codes(whole(text))[1:])
                    frame = pd.DataFrame({"code": code, "rest": rest, "n": np.bincount(at, minlength=len(code))})
                    frame.insert(0, "key", pd.Series([key] * len(frame), dtype=object))
                    yield frame

        key = texts.schema["key"].dataType.simpleString()
        codes = texts.select("key", "text").mapInPandas(codes_of, f"key {key}, code long, rest long, n long")
        columns = [f"p{c}" for c in range(self.classes)]
        return (
            codes.join(self.table, _GRAM)
            .groupBy("key")
            .agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in columns], F.sum("n").alias("symbols"))
        )


@dataclass
class Model:
    """``table``: ``k, y, kind, code, rest, value``. Kind 0: discounted share of an n-gram of order k;
    kind 1: back-off weight of its context."""

    table: DataFrame
    symbols: int
    classes: list[int]
    shared: bool

    def shares(self, grams: DataFrame, ys: list[int]) -> Shares:
        """Natural logarithm of the probability of the last symbol of each of ``grams(code, rest)``."""
        orders = [F.struct(F.lit(k).alias("k"), *(c.alias(n) for c, n in zip(_suffix(k), _GRAM, strict=True))) for k in range(1, ORDER + 1)]
        asked = grams.select(F.explode(F.array(*orders)).alias("gram")).select("gram.*").distinct()
        back = self._values(1, "b", ys).withColumnsRenamed({"code": "context", "rest": "upper"})
        shift = F.shiftright("code", SYMBOL_BITS).alias("context"), F.shiftright("rest", REST_BITS).alias("upper")
        asked = asked.join(self._values(0, "v", ys), ["k", *_GRAM], "left").select("*", *shift)
        asked = pinned(asked.join(back, ["k", "context", "upper"], "left").drop("context", "upper"), "asked")
        below: DataFrame | None = None
        for k in range(1, ORDER + 1):
            now = asked.where(F.col("k") == k)
            if below is None:  # one context, the empty one
                now = now.select("*", *[F.lit(1 / max(1, self.symbols)).alias(f"l{c}") for c in range(len(ys))])
            else:
                below = below.withColumnsRenamed({"code": "lower", "rest": "under"} | {f"p{c}": f"l{c}" for c in range(len(ys))})
                shorter = [c.alias(n) for c, n in zip(_suffix(k - 1), ("lower", "under"), strict=True)]
                now = now.select("*", *shorter).join(below, ["lower", "under"])
            p = [F.coalesce(f"v{c}", F.lit(0.0)) + F.coalesce(f"b{c}", F.lit(1.0)) * F.col(f"l{c}") for c in range(len(ys))]
            below = now.select(*_GRAM, *[x.alias(f"p{c}") for c, x in enumerate(p)])
        logs = [F.log(F.greatest(f"p{c}", F.lit(1e-300))).alias(f"p{c}") for c in range(len(ys))]
        table = pinned(below.select(*_GRAM, *logs), "shares")
        return Shares(table, table.count(), len(ys))

    def _values(self, kind: int, name: str, ys: list[int]) -> DataFrame:
        """``k, code, rest`` and the values of a kind, one column ``name`` and number a class."""
        of = [F.when(F.col("k") <= SHARED, -1).otherwise(y) if self.shared else F.lit(y) for y in ys]
        rows = self.table.where((F.col("kind") == kind) & F.col("y").isin(*ys, *[-1] * self.shared))
        values = [F.max(F.when(F.col("y") == y, F.col("value"))).alias(f"{name}{c}") for c, y in enumerate(of)]
        return rows.groupBy("k", *_GRAM).agg(*values)

    def log_share(self, code: np.ndarray, y: int, rest: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the probabilities of a few n-grams given here."""
        code, rest, at = distinct(code, np.zeros_like(code) if rest is None else rest)
        frame = pd.DataFrame({"code": code, "rest": rest})
        return self.shares(self.table.sparkSession.createDataFrame(frame), [y]).sent().get(code, rest)[at, 0]

    def word_scores(self, words: list[bytes], ys: list[int]) -> np.ndarray:
        """The scores of a few words given here."""
        _, code, rest = word_codes(words)
        frame = pd.DataFrame({"code": code, "rest": rest})
        return self.shares(self.table.sparkSession.createDataFrame(frame), ys).sent().word_scores(words)


def _suffix(k: int) -> tuple[Column, Column]:
    """The last ``k`` symbols of an n-gram."""
    return F.col("code").bitwiseAND(F.lit(int(_MASKS[k]))), F.col("rest").bitwiseAND(F.lit(int(_RESTS[k])))


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(0, n.get(k, 0)) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def fit(counted: DataFrame, shared: bool = False) -> Model:
    """A model of ``counts``; with ``shared``, low orders are those of all classes together (-1)."""
    return fits([counted], shared)[0]


def fits(counted: list[DataFrame], shared: bool = False) -> list[Model]:
    """A model ``m`` of each of several ``counts``, made in the same jobs."""
    sets = [one.select(F.lit(m).alias("m"), "y", *_GRAM, "n") for m, one in enumerate(counted)]
    current = pinned(reduce(DataFrame.unionByName, sets), "ngrams")
    levels: list[DataFrame] = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            left = current
            if shared and k == SHARED:  # left neighbours are told apart over all classes
                left = current.select("m", F.lit(-1).alias("y"), *_GRAM).distinct()
            code, rest = _suffix(k)
            current = left.groupBy("m", "y", code.alias("code"), rest.alias("rest")).agg(F.count(F.lit(1)).alias("n"))
            current = pinned(current, f"order{k}")  # each order is counted once
        levels.append(current.select(F.lit(k).alias("k"), "m", "y", *_GRAM, "n"))
    grams = reduce(DataFrame.unionByName, levels)
    few = [F.count(F.when(F.col("n") == n, 1)).alias(f"n{n}") for n in range(1, 5)]
    facts = grams.groupBy("m", "k", "y").agg(F.count(F.lit(1)).alias("grams"), *few).collect()

    discount = F.lit(0.0)
    for r in facts:
        d = _discounts({n: r[f"n{n}"] for n in range(1, 5)})
        step = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = (F.col("m") == r.m) & (F.col("k") == r.k) & (F.col("y") == r.y)
        discount = F.when(own, step).otherwise(discount)
    of = ["m", "k", "y"]
    taken = grams.select(
        *of, *_GRAM, "n", discount.alias("d"),
        F.shiftright("code", SYMBOL_BITS).alias("context"), F.shiftright("rest", REST_BITS).alias("upper"),
    )
    contexts = taken.groupBy(*of, "context", "upper").agg(F.sum("n").alias("total"), F.sum("d").alias("back"))
    values = taken.join(contexts, [*of, "context", "upper"]).select(
        *of, F.lit(0).alias("kind"), *_GRAM, ((F.col("n") - F.col("d")) / F.col("total")).alias("value")
    )
    backs = contexts.select(
        *of, F.lit(1).alias("kind"), F.col("context").alias("code"), F.col("upper").alias("rest"),
        (F.col("back") / F.col("total")).alias("value"),
    )
    table = pinned(values.unionByName(backs), "model")
    models = []
    for m in range(len(counted)):
        symbols = [r.grams for r in facts if (r.m, r.k) == (m, 1)]
        if len(symbols) > 1:  # classes may have the same ones
            symbols = [current.where(F.col("m") == m).select(*_GRAM).distinct().count()]
        classes = sorted(r.y for r in facts if (r.m, r.k) == (m, ORDER))
        models.append(Model(table.where(F.col("m") == m).drop("m"), sum(symbols), classes, shared))
    return models
