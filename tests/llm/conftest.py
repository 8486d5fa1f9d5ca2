import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en"), (2, None, None), (3, " \t\n", "en"), (4, "one", "en"), (5, "one two", None), (6, "Straße İstanbul naïve 日本語 \U0001f600 x", "de"),
    (7, "The cat sat on the mat and the dog sat on the log. " * 400, "en"), (8, "same text here again", "en"), (9, "same text here again", "en"),
    (10, "same text here again", "en"), (10, "same text here again", "en"), (None, "no id here at all", "fr"), (11, "12345 !!! ### $$$", "en"),
    (12, "a　b\x1cc\x85d\xa0e <|endoftext|> <s> </s> ▁x ́e", "es"), (13, "le chat est sur la table et le chien dort " * 6, "fr"),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, g, None, None, "x", 1, "y") for i, t, g in ODD]
    return spark.createDataFrame(rows, f"{DOCS}, m string, score int, r string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
