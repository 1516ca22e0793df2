import pytest

#: Texts with all kinds of edges; ids repeat and are missing, columns have names that operators use themselves.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.\nSecond line here.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nSecond line here.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nSecond line here.", "en", "a"),
    (3, "the  quick BROWN fox jumps over the lazy dog near the old river bank today.\nsecond line here!", None, None),
    (4, None, None, None), (5, "", "de", "b"), (6, "   \n\t ", "de", "b"), (7, "one", "fr", "b"), (8, "one two", "fr", "é"),
    (None, "no id but some words of text in here", "en", "c"), (None, "no id but some words of text in here", "en", "c"), (None, None, None, None),
    (9, "12345 67890 !!! ### 3.14", None, "c"), (10, "Über straße naïve café " * 40, "de", None),
    (11, "word " * 30000 + "end", "en", "a"), (12, "日本語 テスト 文章。", "ja", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n long, score double, row string"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame([(*r, 7, 0.5, "x") for r in ROWS], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
