"""One named query per operator, ``(spark, folder) -> DataFrame``, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import (
    exact_topk,
    html_extract,
    jaccard_join,
    language_ecoc,
    license_rules,
    nn_descent,
    packing,
    perplexity_rules,
    prefix_trie,
    quality_qda,
    sentencepiece_dropout,
    token_alignment,
    toxicity,
)
from galley.llm.shared import prepared, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepared(spark)
            return build(spark, folder)

        QUERIES[name] = run
        return build

    return register


@query("op9_quality_qda")
def op9(spark, folder):
    return quality_qda.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_language_ecoc")
def op10(spark, folder):
    return language_ecoc.identified(table(spark, folder, "documents"))


@query("op3_ngram_jaccard_join")
def op3(spark, folder):
    return jaccard_join.joined(table(spark, folder, "documents"))


@query("op5_best_fit_packing")
def op5(spark, folder):
    return packing.digests(table(spark, folder, "documents"))


@query("op4_ngram_perplexity")
def op4(spark, folder):
    return perplexity_rules.judged(table(spark, folder, "documents"))


@query("op2_toxicity_kneser_ney")
def op2(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_tag_path_ratios")
def op8(spark, folder):
    return html_extract.extracted(table(spark, folder, "pages"))


@query("op7_license_rules")
def op7(spark, folder):
    return license_rules.scanned(table(spark, folder, "documents"))


@query("op1_sentencepiece_dropout")
def op1(spark, folder):
    return sentencepiece_dropout.digests(table(spark, folder, "documents"))


@query("op6_nn_descent")
def op6(spark, folder):
    return nn_descent.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_prefix_trie")
def op11(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op12_norm_buckets")
def op12(spark, folder):
    return exact_topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_pair_bitmaps")
def op13(spark, folder):
    return token_alignment.aligned(table(spark, folder, "documents"))
