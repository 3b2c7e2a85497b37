import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, removed string, score string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long_text = "It was long ago. " * 3000 + "\n" + "word " * 20000
    rows = [
        (1, "The same line here.\nAnd a second line follows it. A third one is here too.\n", "en", "a", 5),
        (2, "The same line here.\nAnd a second line follows it. A third one is here too.\n", "en", "a", 5),
        (2, "The same line here.\nAnd a second line follows it. A third one is here too.\n", "en", "a", 5),
        (3, None, None, None, None),
        (4, "", "fr", "b", 0),
        (5, " \n\t ", None, "b", 4),
        (6, long_text, "en", "a", len(long_text)),
        (7, "DE!! UNE!! \x0b été 12 <|endoftext|>  x", "fr", None, 9),
        (8, "two words", "de", "c", 9),
        (None, "a row without an id, licensed under CC BY-NC 4.0.", "en", "c", 1),
        (9, "12 34 !!", "en", "c", 8),
    ]
    return spark.createDataFrame([(*r, "clash", None, "x", "k") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
