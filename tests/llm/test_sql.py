"""Queries against their SQL in DuckDB, on the smallest tables and on odd and random texts."""

import os
import random

import duckdb
import pandas as pd
import pytest

from galley.llm import license_rules
from galley.llm.oracle import ORACLE
from galley.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORDS = (
    "mit license licence licensed under the apache general public gnu lesser version 2 0 2.1 v3 or any later bsd clause "
    "SPDX-License-Identifier: GPL-2.0 MIT. cc by nc sa 4 creative commons attribution share alike released mozilla terms "
    "of is proprietary public domain xyz été"
).split()


def _same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    def plain(frame):
        rows = frame[ours.columns].itertuples(index=False, name=None)
        return sorted(repr([None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r]) for r in rows)

    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    _same(QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE[name]).df())


def test_license_scan_of_random_words_equals_sql(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choice(WORDS) for _ in range(random.randint(0, 60)))) for i in range(600)]
    rows += [(9001, None), (9002, ""), (9003, "a license"), (9003, "a license")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    _same(license_rules.scanned(frame).toPandas(), con.execute(ORACLE["op7_license_rules"]).df())


def test_license_scan_of_wrapped_references_equals_sql(spark):
    rows = [
        (k, f"Released{gap}under the{gap}Mozilla Public terms. DISTRIBUTED{gap}Under the GPL.")
        for k, gap in enumerate([" ", "\n", "\t", "  ", ", ", "\r\n * ", " -- "])
    ]
    got = license_rules.scanned(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    _same(got, con.execute(ORACLE["op7_license_rules"]).df())
    assert set(got["labels"]) == {"gpl,mpl"}
