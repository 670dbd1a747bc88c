import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, score double, key int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, one id with two texts, odd characters."""
    long = " ".join(f"word{i % 977} goes" for i in range(6000))
    rows = [
        (1, "A plain text, with a few words. And more!", "en", "a", 41, "x", 0.5, 1),
        (1, "A plain text, with a few words. And more!", "en", "a", 41, "x", 0.5, 1),
        (2, None, "en", None, None, None, None, None),
        (3, "", None, "b", 0, "", None, 2),
        (4, long, "en", "b", len(long), "y", 1.0, 3),
        (5, "Zwei Wörter; straße ÄÖÜ ﬁx Σίσυφος ΟΔΟΣ", "de", "b", 10, "z", 0.1, 4),
        (5, "the same id, another text", "en", "b", 10, "z", 0.1, 4),
        (None, "no id at all", "en", "b", 10, "z", 0.1, 4),
        (6, "it's <|endoftext|> and <|startoftext|>don't  we'll\n\n\tx y z \x1c q.. a.,b ,, c_. 12½", "en", "c", 3, "q", 0.2, 5),
        (7, "emoji 👩‍👩‍👧 é İstanbul ｆｕｌｌ 123 $%&#", "en", "c", 3, "q", 0.2, 5),
        (8, "   \n\t ", "fr", "c", 6, "q", 0.2, 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
