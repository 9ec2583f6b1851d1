import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, row int, key int, word string, n_words string"


@pytest.fixture
def documents(spark):
    """Texts with nulls in any column, empty and long ones, repeated rows, and extra columns whose names clash."""

    def make(texts):
        rows = [(i, t, None if i % 5 == 1 else "en", None if i % 7 == 2 else f"s{i % 3}", None, "s", "k", 1, 2, "w", "n") for i, t in enumerate(texts)]
        return spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, None, None, None, None, None, None), (None, "the null id", "en", "s", 3, None, None, None, None, None, None)], SCHEMA)

    return make
