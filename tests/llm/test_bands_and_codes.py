"""Bands of many and of rare languages; language codes against plain Python."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from galley.llm import language_ecoc, perplexity_rules


def test_every_language_has_its_band(spark):
    """As many languages as there are, also rare ones; those too small share the band of all."""
    n = 1500
    rows = spark.range(n * 80).select(
        F.concat(F.lit("l"), F.col("id") % n).alias("lang"), F.lit(100).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_repeat_words"),
        ((F.col("id") % n) + F.floor(F.col("id") / n) / 100).alias("log_perplexity"), (F.floor(F.col("id") / n) % 8 == 0).alias("planted"),
    )
    small = rows.limit(10).withColumn("lang", F.lit("small"))
    own, _ = perplexity_rules.bands(rows.unionByName(small))
    got = {r.band_lang: (r.low, r.high) for r in own.collect()}
    assert len(got) == n and "small" not in got
    assert all(low < int(lang[1:]) + 0.4 < high for lang, (low, high) in got.items())


def test_rare_languages_are_planted_whole_and_common_ones_by_share(spark):
    rows = spark.range(40_000).select(
        "id", F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 0, F.lit("rare")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("common")).alias("lang"),
        F.concat(F.lit("some words of text "), "id").alias("text"),
    )
    made = perplexity_rules.with_planted(rows).where("planted").groupBy("lang").count().collect()
    planted = {r.lang: r["count"] for r in made}
    assert planted["rare"] == 200
    common = rows.where("lang = 'common'").count()
    assert abs(planted["common"] - common / 16) < 5 * math.sqrt(common / 16)
    assert 900 < planted[None] < 1100


def test_language_codes_equal_plain_python(spark):
    """Counts, weights, trust, margins, losses and the nearest codeword, worked out one by one."""
    vocabulary = {"aa": "the of and with house", "bb": "der die und mit haus", "cc": "le la et avec maison", "dd": "το και με σπίτι ένα"}
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(words.split(), 12)), lang) for k, (lang, words) in enumerate(list(vocabulary.items()) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    book = language_ecoc.fit(docs, lambda key: F.col(key) % 3 > 0)
    learned = [r for r in rows if r[0] % 3 > 0]

    def slots(text):
        """Slots of single letters and of three characters with the edges of words."""
        found = []
        for word in language_ecoc.letters_words(text):
            found += language_ecoc.word_slots([word])[1].tolist()
        return found

    languages = sorted(vocabulary)
    counts = {lang: Counter(s for _, t, x in learned if x == lang for s in slots(t)) for lang in languages}
    totals = {lang: sum(c.values()) + 0.5 * language_ecoc.SLOTS for lang, c in counts.items()}
    bits = language_ecoc.codewords(len(languages))
    assert book.languages == languages and (book.code == 2 * bits - 1).all()

    def weight(bit, slot):
        share = {lang: (counts[lang][slot] + 0.5) / totals[lang] for lang in languages}
        sides = [[share[x] for x, code in zip(languages, bits, strict=True) if code[bit] == side] for side in (1, 0)]
        return math.log(sum(sides[0]) / len(sides[0])) - math.log(sum(sides[1]) / len(sides[1]))

    def margins(text):
        held = slots(text)
        return [sum(weight(b, s) for s in held) / len(held) for b in range(bits.shape[1])]

    right = np.zeros(book.code.shape)
    for _, text, lang in learned:
        k = languages.index(lang)
        right[k] += np.array(margins(text)) * book.code[k] > 0
    seen = Counter(x for _, _, x in learned)
    trust = (right + 1) / (np.array([seen[x] for x in languages])[:, None] + 2)
    trust /= trust.sum(1, keepdims=True)
    assert np.allclose(book.trust, trust)

    asked = [r[1] for r in rows[:16]] + ["das house la", "1234 ---", "", None]
    got = book.decode(pd.Series(asked, dtype=object))
    for text, told in zip(asked, got.itertuples(), strict=True):
        if not text or not slots(text):
            assert (told.lang_pred, told.score, told.ambiguous) == ("und", 0.0, True)
            continue
        outputs = [2 / (1 + math.exp(-book.gain * m)) - 1 for m in margins(text)]
        losses = [sum(t * math.exp(-c * o) for t, c, o in zip(tr, code, outputs, strict=True)) for tr, code in zip(trust, book.code, strict=True)]
        shares = [math.exp(-8 * (x - min(losses))) for x in losses]
        shares = [x / sum(shares) for x in shares]
        best = int(np.argmin(losses))
        assert told.lang_pred == languages[best] and math.isclose(told.score, shares[best], rel_tol=1e-9)
        second = sorted(shares)[-2]
        assert told.ambiguous == (shares[best] - second < 0.1)
