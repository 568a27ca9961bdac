import pytest

from galley.llm.shared import prepared


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepared(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, label int"

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "One plain text, with a few words in it. And one more line.", "en", "s", 1, 0.5, "x", 1),
        (1, "One plain text, with a few words in it. And one more line.", "en", "s", 1, 0.5, "x", 1),
        (1, "Another text under an id that was there before.", "en", "s", 1, None, None, None),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, 0.5, "x", 1),
        (4, " \n\t ", "de", "s", 3, 0.5, "x", 1),
        (5, LONG, "en", "s", len(LONG), 0.5, "x", 1),
        (6, "12345 --- 67890", "fr", "s", 1, 0.5, "x", 1),
        (7, "日本語のテキスト 😀 ▁ <|endoftext|>", None, "s", 1, 0.5, "x", 1),
        (None, "A text without an id.", "en", "s", 1, 0.5, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 0), (1, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
