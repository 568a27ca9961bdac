"""Dirty CSV files: every line is accepted or rejected with its problem."""

import pytest
from pyspark.sql import types as T

from galley.session import scratch_path
from galley.sources import catalog, files

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType()),
     T.StructField("day", T.DateType())]
)
GOOD = [
    ("1,plain,1.5,2026-01-31", (1, "plain", 1.5, "2026-01-31")),
    ('2,"a, b",2,2026-01-31', (2, "a, b", 2.0, "2026-01-31")),
    ('3,"say ""no""",3,2026-01-31', (3, 'say "no"', 3.0, "2026-01-31")),
    ("4,,,", (4, None, None, None)),
    ("5,ünï,-1e3,2026-02-28", (5, "ünï", -1000.0, "2026-02-28")),
]
BAD = [
    ("x1,n,1,2026-01-31", "id is no bigint"),
    ("6,n,cheap,2026-01-31", "price is no double"),
    ("7,n,1,2026-02-31", "day is no date"),
    ("8,n,1", "too few fields"),
    ("9,n,1,2026-01-31,more", "too many fields"),
    (",n,1,2026-01-31", "id is missing"),
    ("10,n,cheap,never", "price is no double"),
    ("99999999999999999999,n,1,2026-01-31", "id is no bigint"),
]


def written(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("\n".join(["id,name,price,day", *lines]),)], "value string").coalesce(1).write.text(path)
    return path


def test_lines_are_accepted_or_rejected_with_their_problem(spark):
    lines = files.read_csv_checked(spark, written(spark, [x for x, _ in GOOD + BAD]), SCHEMA)
    rows = lines.collect()
    assert len(rows) == len(GOOD) + len(BAD)
    accepted = [(r.id, r["name"], r.price, None if r.day is None else str(r.day)) for r in rows if r.problem is None]
    assert accepted == [want for _, want in GOOD]
    assert [r.problem for r in rows if r.problem] == [want for _, want in BAD]
    assert [r.record for r in rows if r.problem and "missing" not in r.problem] == [x for x, p in BAD if "missing" not in p]
    # what could be read of a rejected line is kept
    assert [(r.id, r["name"]) for r in rows if r.problem == "price is no double"] == [(6, "n"), (10, "n")]


def test_rejected_lines_have_a_table_and_a_check(spark):
    name = scratch_path(spark, "layer").rsplit("/", 1)[-1].replace("-", "_")
    catalog.ensure_layer(spark, name, scratch_path(spark, "layer"))
    path = written(spark, [x for x, _ in GOOD + BAD])
    check = files.load_csv(spark, path, SCHEMA, name, "prices").first()
    assert (check.check, check.target, check.violations, check.passed) == ("readable", "prices", len(BAD), False)
    assert spark.table(f"{name}.prices").count() + spark.table(f"{name}.prices_rejected").count() == len(GOOD + BAD)
    assert spark.table(f"{name}.prices").columns == SCHEMA.names
    clean = files.load_csv(spark, written(spark, [x for x, _ in GOOD]), SCHEMA, name, "clean").first()
    assert clean.passed and spark.table(f"{name}.clean_rejected").count() == 0


@pytest.mark.parametrize("text", ["two\nlines", 'quoted "\n" break', "comma, and \\ slash", "tail\n", '"', "\\\""])
def test_quotes_and_line_breaks_come_back(spark, text):
    path = scratch_path(spark, "breaks")
    rows = spark.createDataFrame([(1, text, 1.0, None), (2, "next", 2.0, None)], T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMA.fields]))
    files.write_csv(rows, path)
    got = files.read_csv_checked(spark, path, SCHEMA, line_breaks=True).orderBy("id").collect()
    assert [(r.id, r["name"], r.problem) for r in got] == [(1, text, None), (2, "next", None)]
