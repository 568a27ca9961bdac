"""Every operator and stage on odd, empty and clashing input: one defined row per row, no crash."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from galley.llm import (
    html_extract,
    jaccard_join,
    language_ecoc,
    license_rules,
    nn_descent,
    packing,
    perplexity_rules,
    quality_qda,
    sentencepiece_dropout,
    toxicity,
)

PER_ROW = {
    "quality": lambda d, l: quality_qda.classified(d, l),
    "toxicity": lambda d, l: toxicity.scored(d, l),
    "language": lambda d, l: language_ecoc.identified(d),
    "perplexity": lambda d, l: perplexity_rules.judged(d),
    "license": lambda d, l: license_rules.scanned(d),
    "sentencepiece": lambda d, l: sentencepiece_dropout.digests(d),
    "jaccard": lambda d, l: jaccard_join.joined(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, odd_docs, no_docs, labels, no_labels):
    rows = PER_ROW[name](odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    same = [r for r in rows if r.doc_id == 1]
    assert len(set(same)) <= 2  # the repeated row has the result of its twin
    if "score" in rows[0]:
        assert all(0 <= r.score <= 1 for r in rows)
    assert PER_ROW[name](no_docs, no_labels).count() == 0


def test_packing_keeps_every_token(odd_docs, no_docs):
    rows = packing.digests(odd_docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    ids = {r.doc_id: r for r in rows if r.doc_id in (2, 3)}
    assert ids[2].ids_crc32 == ids[3].ids_crc32
    assert packing.digests(no_docs).count() == 0


def test_stages_keep_the_columns(spark, odd_docs, no_docs, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_pages(spark):
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>Some text, here.</p>", 1), (3, None, "<p>Some text, here.</p>", 1),
            (4, "u", "<nav>menu</nav>", 1), (None, "u", "<script>never closed", 1), (5, "u", "<p>" + "long, text. " * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extracted(pages).collect()}
    assert got[1] == got[2] == got[4] == got[None] == ("", 0)
    assert got[3] == ("Some text, here.", 16)
    assert got[5][1] == 12 * 50_000 - 1
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [
        (0, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x"),
        (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [1.0, None], "x"), (6, [float("nan"), 1.0], "x"),
        (7, [float("inf"), 1.0], "x"), (8, [1.0, 2.0, 3.0], "x"), (40, [-3.0, 1.0], "x"), (None, [1.0, 1.0], "x"),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asks = F.col("vec_id") % 20 == 0
    got = sorted(tuple(r) for r in nn_descent.nearest(vectors, asks).collect())
    by = {q: [(v, s) for a, _, v, s in got if a == q] for q in (0, 20, 40)}
    assert by[0] == [(1, 1.0), (20, 1.0), (2, 0.5), (40, -3.0)]
    assert by[20] == [(0, 1.0), (1, 1.0), (2, 0.5), (40, -3.0)]
    assert by[40] == [(2, -1.0), (0, -3.0), (1, -3.0), (20, -3.0)]
    assert [r for _, r, _, _ in got] == [1, 2, 3, 4] * 3
    assert nn_descent.nearest(vectors.limit(0), asks).count() == 0
