import pytest

# Rows every operator on documents has to take: nulls in each column, empty and
# long texts, repeated rows, and columns whose names operators use themselves.
DDL = ("doc_id long, text string, lang string, source string, n_chars long, id long, h int, "
       "row long, cls long, spans string, doc string, score double, kept string, _text string, "
       "component long, size int")


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 1, 2, 3, 4, "x", "y", 0.5, "z", "t", 5, 6)


LONG = " ".join(f"word{i % 977} über{i}" for i in range(60_000))
EDGE = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, "a"), row(None, "one two three"),
        row(None, None, None), row(5, "same text here"), row(5, "same text here"),
        row(6, "same text here", None), row(7, LONG), row(8, LONG), row(9, "12 34 ... !!"),
        (None,) * 16]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DDL)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DDL)
