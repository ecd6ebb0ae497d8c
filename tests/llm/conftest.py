import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 2000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and columns named like results."""
    rows = [
        (1, "The same words stand here and the same words stand here again, for the reader.", "en", 1),
        (1, "The same words stand here and the same words stand here again, for the reader.", "en", 1),
        (2, None, None, 2),
        (3, "", "en", 3),
        (4, " \n\t\n ", "fr", 4),
        (None, "A document without an id holds these words of its own, one by one.", "en", None),
        (None, None, None, None),
        (5, "Wörter é ß 漢字 🙂 e\u0301 1234567890 !!! ###", "de", 5),
        (6, LONG, "en", 6),
        (6, "another text with the same id as the long one", "en", 6),
        (7, "x", None, 7),
        (8, "1234 !!", "en", 8),
        (9, "\x00\x01\u2028\u00a0tab\tend", "es", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    return df.selectExpr("*", "'src' as source", "length(text) as n_chars", "1 as kept", "2 as th", "'z' as node", "3 as ids", "4 as size", "5 as shard", "6 as pos", "'q' as line")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
