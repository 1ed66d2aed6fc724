import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 997} and{i % 31}" for i in range(12_000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "  \t\n ", "en", "s"), (4, "one", "en", None), (5, "Alpha beta gamma delta epsilon", "en", "s"), (5, "Alpha beta gamma delta epsilon", "en", "s"),
            (6, "alpha BETA gamma delta epsilon", "de", "s"), (7, long, "en", "s"), (8, long + " tail", "en", "s"), (9, "naïve ﬁ ① 日本語 🙂 \x00 <|endoftext|> x", "de", "s"), (None, "no id here", "en", "s")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for c in ("score", "n_tokens", "lang_pred", "key", "size", "part", "h", "k"):
        df = df.withColumn(c, df["doc_id"])
    return df


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
