"""Models with classes against plain Python, and the number of jobs that the toxicity query takes."""

import math
import uuid
from collections import Counter

from pyspark.sql import functions as F

from galley.llm import kneser_ney, toxicity

MOST_JOBS = 80  # 63 here; 119 while both models were fitted apart and each order was joined by itself

TEXTS = {
    0: ["banana bandana", "ananas and band", "a plain band"],
    1: ["bad banana", "aé bad aé", "a bad bad and"],
}


def grams_of(texts):
    grams = Counter()
    for w in " ".join(texts).split():
        s = [1] * 4 + [ord(c) for c in w] + [2]
        grams.update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    return grams


def brute_force(texts):
    """``share(gram, y)`` of two classes that have orders one and two in common."""
    held = {}
    for y, own in texts.items():
        held[y, 5] = grams_of(own)
        for k in (4, 3):
            held[y, k] = Counter(g[1:] for g in held[y, k + 1])
    two = Counter(g[1:] for g in set(held[0, 3]) | set(held[1, 3]))
    one = Counter(g[1:] for g in two)
    for y in texts:
        held[y, 2], held[y, 1] = two, one

    def share(g, y):
        if not g:
            return 1 / len(one)
        table = held[y, len(g)]
        d = kneser_ney._discounts(Counter(table.values()))
        same = {x: n for x, n in table.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return share(g[1:], y)
        cut = lambda n: d[min(n, 3) - 1]
        own = (table[g] - cut(table[g])) / total if table[g] else 0
        return own + sum(map(cut, same.values())) / total * share(g[1:], y)

    return share


def test_models_made_together_equal_brute_force(spark):
    sets = [TEXTS, {0: TEXTS[1] + ["zebra 日本"], 1: TEXTS[0][:2]}]
    counted = [
        kneser_ney.counts(spark.createDataFrame([(t, y) for y in own for t in own[y]], "text string, y int"), F.col("y"))
        for own in sets
    ]
    models = kneser_ney.fits(counted, shared=True)
    for own, model in zip(sets, models, strict=True):
        share = brute_force(own)
        assert model.classes == [0, 1] and model.symbols == len({c for t in own.values() for c in "".join(t) if c != " "}) + 1
        words = ["banana", "bad", "nab", "zebra", "日本", "é"]
        got = model.word_scores([w.encode() for w in words], [1, 0])
        for w, row in zip(words, got, strict=True):
            s = [1] * 4 + [ord(c) for c in w] + [2]
            for y, value in ((1, row[0]), (0, row[1])):
                expected = sum(math.log(share(tuple(s[i - 4 : i + 1]), y)) for i in range(4, len(s)))
                assert abs(value - expected) < 1e-4 and row[2] == len(w) + 1


def test_models_without_a_class_or_any_text(spark):
    frame = lambda rows: kneser_ney.counts(spark.createDataFrame(rows, "text string, y int"), F.col("y"))
    none, one = kneser_ney.fits([frame([]), frame([("a band", 1)])], shared=True)
    assert (none.classes, none.symbols) == ([], 0) and (one.classes, one.symbols) == ([1], 5)
    assert none.table.count() == 0 and one.word_scores([b"band"], [1])[0, 0] < 0


def test_toxicity_takes_few_jobs(spark):
    """The driver's memory follows the jobs and exchanges of the query, not the rows."""
    said = ["a fine day", "you vile wretch", "the old house", "vile day"]
    docs = spark.createDataFrame([(k, f"{said[k % 4]} {k}") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "toxicity")
    try:
        rows = toxicity.scored(docs, labels).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert len(rows) == 200 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in rows)
    assert 0 < jobs <= MOST_JOBS, jobs
