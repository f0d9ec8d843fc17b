import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and clashing extra columns."""
    rows = [
        (1, None, None, None, None, "x", 0, 0.5),
        (2, "", "en", "a", 0, "x", 0, 0.5),
        (None, "A text without a number, and some more words in it", "en", "a", 50, "x", 0, 0.5),
        (3, "the same words over and over again, said twice", "en", None, 46, None, None, None),
        (3, "the same words over and over again, said twice", "en", None, 46, None, None, None),
        (4, "the same words over and over again, said twice", "fr", "b", 46, "y", 1, 0.1),
        (5, "word " * 60_000, "en", "b", 300_000, "y", 1, 0.1),
        (6, "x" * 70_000, None, "b", 70_000, "y", 1, 0.1),
        (7, " \t\n ", "de", "c", 4, "z", 1, 0.1),
        (8, "1234 !!! ...", "de", "c", 12, "z", 1, 0.1),
        (9, "Größe ▁ 日本 \U0001f600 naïve \x00 end", "de", "c", 30, "z", 1, 0.1),
    ]
    return spark.createDataFrame(rows, DOCS + ", bits string, level int, root double")
