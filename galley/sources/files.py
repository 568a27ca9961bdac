"""CSV and Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.operators.quality import CHECK_SCHEMA
from galley.sources.catalog import read_table, write_table

RECORD, PROBLEM = "record", "problem"
_RAW = "__record"


def write_csv(df: DataFrame, path: str) -> None:
    """Header line, ISO dates. Timestamps keep their microseconds and texts their outer spaces, so a
    read restores them."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema is required: inferring it would scan the data twice and guess."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False, header: bool = True
) -> DataFrame:
    """The columns of ``schema``, and for lines that do not fit it their ``record`` and ``problem``.

    A line has a problem if it has too few or too many fields, a field that is not of its type, or
    nothing in a column that may not be null. Nothing is dropped: lines with a problem keep the
    fields that could be read. Quotes inside fields are doubled. Line breaks inside fields need
    ``line_breaks``; files are then not split, so there should be many of them.
    """
    wanted = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(_RAW, T.StringType())])
    read = (
        spark.read.schema(wanted)
        .option("header", header)
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )
    broken = F.when(F.col(_RAW).isNotNull(), _problem(schema))
    missing = F.coalesce(*[F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is missing")) for f in schema.fields if not f.nullable], F.lit(None))
    return read.select(*schema.names, F.col(_RAW).alias(RECORD), F.coalesce(broken, missing).alias(PROBLEM))


def _problem(schema: T.StructType) -> Column:
    """What is wrong with a line that could not be read, from its fields as text."""
    n = len(schema.fields)
    # one field more than the schema has, so that a longer line shows
    as_text = ", ".join(f"f{i} STRING" for i in range(n + 1))
    fields = F.from_csv(F.col(_RAW), as_text, {"escape": '"', "mode": "PERMISSIVE"})
    too_many = F.when(fields[f"f{n}"].isNotNull(), F.lit("too many fields"))
    # a value that the reader gave up although there is text for it
    wrong = [
        F.when(fields[f"f{i}"].isNotNull() & F.col(f.name).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
        for i, f in enumerate(schema.fields)
    ]
    return F.coalesce(too_many, *wrong, F.lit("too few fields"))


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    layer: str,
    name: str,
    line_breaks: bool = False,
    header: bool = True,
) -> DataFrame:
    """Loads accepted lines into a table and the others, with their problem, into ``<name>_rejected``.

    Returns the check row that counts the rejected ones.
    """
    lines = read_csv_checked(spark, path, schema, line_breaks, header)
    write_table(lines.where(F.col(PROBLEM).isNull()).select(*schema.names), layer, name)
    write_table(lines.where(F.col(PROBLEM).isNotNull()), layer, rejected_table(name))
    n = read_table(spark, layer, rejected_table(name)).count()
    return spark.createDataFrame([("readable", name, n, n == 0)], CHECK_SCHEMA)


def rejected_table(name: str) -> str:
    return f"{name}_rejected"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
