import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from rows (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for r in rows:
            i, text, lang, source = (*r, *[None] * (4 - len(r)))
            full.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """NULLs in every column, empty and very long texts, ties, repeated rows."""
    long = "lorem ipsum dolor " * 60_000
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (None, "x"), (5, long), (6, long), (7, "123 456 !!", "en", None)]
    return documents([*rows, (8, "das ist ein Text und nicht mehr", "de", "b"), (8, "another text under the same id", "en", "a")])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(documents):
    """Columns that carry names which operators use inside."""
    from pyspark.sql import functions as F

    names = "h fp key row size n a b mask part words hs lang_pred score spans digest line record archive __text __row_hash component_id".split()
    base = documents([(i, f"some words number {i} for the table", "en", "s") for i in range(6)])
    return base.select("*", *[F.lit(1).alias(c) for c in names])
