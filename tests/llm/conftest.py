import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, keep string, epoch int, position double, n_pii string, size int, `a.b` int, a int, mean int, budget int, before int, w0 int, s int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, columns with names in use."""
    long = ("Some words, again and again. " * 9000) + "x" * 50_000
    rows = [
        (1, "one two three four five six seven", "en", "s0", 33, "a", "b", 7, 0.5, "c", 1, 1),
        (1, "one two three four five six seven", "en", "s0", 33, "a", "b", 7, 0.5, "c", 1, 1),
        (2, "one two three four five six seven", "en", "s0", 33, "a", "b", 7, 0.5, "c", 1, 1),
        (3, "", "en", "s0", 0, None, None, None, None, None, None, None),
        (4, None, "en", "s1", None, None, None, None, None, None, None, None),
        (None, "a text without an id.", None, None, None, None, None, None, None, None, None, None),
        (5, long, None, "s1", len(long), "a", None, 1, None, "x", 2, 3),
        (6, " \n\t  ", "fr", None, 5, None, None, None, None, None, None, None),
        (7, "mail a.b@example.com or +1 (415) 555-0132\nReleased under the MIT License.", "en", "s1", 80, None, None, 0, 0.1, "", 0, 0),
        (8, "漢字 and 🎉 émigré\x00  end", "xx", "s2", 22, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, 1, None, 2, 3, None, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nameless(spark):
    """Every value null."""
    return spark.createDataFrame([(None,) * 18] * 3, SCHEMA)
