"""The pipeline's decisions, stage by stage, and what comes out of it."""

import os

import corpus_pipeline
import pytest

from galley.llm import language_ecoc, quality_qda
from galley.llm.shared import table
from tests.llm.test_operators import _brute

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "packing"]

    good = stages["quality"](spark, docs, FOLDER)
    verdicts = quality_qda.classified(docs, labels).where("predicted = 1").collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in verdicts} and 0 < good.count() < docs.count()

    told = stages["language"](spark, good, FOLDER)
    known = language_ecoc.identified(good).where("not ambiguous").collect()
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in known}

    single = stages["near_duplicates"](spark, told, FOLDER)
    classes = _brute({r.doc_id: r.text for r in told.collect()}, 0.8)
    assert {r.doc_id for r in single.collect()} == {c for c, _ in classes.values()}

    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in single.collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_clean_labelled_documents_stay(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    kept = corpus_pipeline.language(spark, corpus_pipeline.quality(spark, docs, folder), folder)
    ids = {r.doc_id for r in kept.collect()}
    assert len(clean & ids) >= 0.99 * len(clean) and len(junk & ids) <= 0.05 * len(junk)
