import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, range int, size string, before int, id string, fp string, rules string"

#: Null and empty texts, odd white space, repeated rows, a null id, texts of one long word, clashing extra columns.
TEXTS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n\x0b\x0c\r ", None),
    (4, "one", "b"),
    (5, "one two", "b"),
    (6, "Ünï cödé   nbsp em \U0001f600 TOKEN: abcdef", "a"),
    (7, "the same words again " * 40, "a"),
    (7, "the same words again " * 40, "a"),
    (8, "the same words again " * 40, "é"),
    (None, "no id here but words enough", "a"),
    (9, "x" * 300_000, "b"),
    (10, " ".join(f"w{k}" for k in range(30_000)), "b"),
    (11, "line one\nline one\n\nline two\nline one", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", s, len(t or ""), "k", 1, "s", 2, "i", "f", "r") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
