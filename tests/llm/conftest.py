import pytest

#: Documents with nulls, ties, repeated rows, a long text, and columns whose names clash with ours.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, digest string, words string, _rank long"


@pytest.fixture(scope="session")
def docs(spark):
    rng = __import__("random").Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "one", "two", "3", "x-y", "漢字"]
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "same  text\there"), (5, "same text here"), (5, "same text here"), (6, "same text here "), (None, "same text here"), (None, "no id"), (7, "word"), (8, "two words"),
        (9, " ".join(rng.choice(words) for _ in range(30_000))), (10, "naïve\xa0café  — ok\r\n"), (11, "a" * 50_000), (12, "a  b   c \n\n d"), (13, "\x00\x1c odd \x85 separators"),
    ] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))) for k in range(60)]
    return spark.createDataFrame([(i, t, "en", None, 0, -1, "d", "w", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
