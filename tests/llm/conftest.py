import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, start long, words array<string>"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} of the tale" for i in range(6000))
    clean = "The quick brown fox jumps over the lazy dog and then it sleeps until the morning comes again. " * 3
    rows = [
        (1, clean, "en", "a", 1, "x", 1, ["q"]),
        (2, clean, "en", "a", 1, None, 1, None),  # a copy
        (2, clean, "en", "a", 1, None, 1, None),  # the same row again
        (3, None, "en", None, None, None, None, None),
        (4, "", None, "b", 0, None, None, None),
        (5, " \n\t\x0b ", "de", "b", 5, None, None, None),
        (None, "kein Name hier, doch ein Satz auf Deutsch.", "de", "b", 9, None, None, None),
        (6, long, "en", "c", 9, None, None, None),
        (7, "Ünïcode – ▁mark 日本語   　x 🙂🙂 é ﬁ \x00 end", "xx", "c", 9, None, None, None),
        (8, "1234 5678 !!! ???", "en", "c", 9, None, None, None),
        (9, "x", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
