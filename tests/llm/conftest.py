import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the test tables are not here")
    return SMALL


#: Nulls in every column, empty and very long texts, repeated rows and ids, names that operators use inside.
def rows():
    long_text = " ".join(f"word{n % 977} and{n % 13}" for n in range(30_000))
    passage = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank tonight"
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "x", 7),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", None, None),
        (3, None, "en", "x", 1),
        (4, "", None, None, 1),
        (5, "   \n\t ", "de", "x", 1),
        (6, long_text, "en", "x", 1),
        (7, long_text + " tail", "en", "x", 1),
        (8, f"{passage}\n{passage} once more", None, "x", 1),
        (9, f"something else\n{passage}", "fr", "x", 1),
        (9, f"something else\n{passage}", "fr", "x", 1),
        (None, f"no id here\n{passage}", "en", "x", 1),
        (None, None, None, None, None),
        (10, "12345 !!! ???", "en", "x", 1),
        (11, "Größe naïve İstanbul Ωmega 日本語 \u0000 \u001c x²", "de", "x", 1),
        (12, "a", "en", "x", 1),
    ]


CLASHING = ["id", "row", "kept", "part", "run", "text_sha256", "n", "a", "b", "token", "group", "rep", "lang_pred", "score", "chunk", "length", "piece", "items", "n_words", "odd name-1"]


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(messy):
    return messy.where("false")
