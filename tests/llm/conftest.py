import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tagloom.llm.common import ship

    ship(spark)


#: Ids, texts and columns that operators must cope with: nulls, empty and long texts, ties, repeated rows, clashing names.
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "src0", "en"),
    (1, "The quick brown fox jumps over the lazy dog.", "src0", "en"),
    (2, None, None, None),
    (3, "", "src0", None),
    (None, "a text without an id", None, "en"),
    (None, None, None, None),
    (4, LONG, "src1", "en"),
    (5, "Ünïcödé 漢字 🙂 <|im_end|> \\ \t\n", "src1", "de"),
]
#: Names that operators use inside.
CLASHES = ("kept", "in0", "c0", "c1", "host", "path", "n", "matches", "secrets", "ids", "redacted", "logit", "component", "node", "gone", "k",
           "decoded", "media", "note", "width", "height", "payload", "thumb_hash", "n_words", "score", "evidence", "site_rate", "rate", "host_rate", "site_n", "site_s")


@pytest.fixture
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(7) for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture
def none(odd):
    return odd.where("false")
