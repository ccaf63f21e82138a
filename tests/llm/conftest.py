import pytest

#: Columns with the names that operators use inside, to clash with them.
CLASHING = ("key", "rep", "label", "score", "flag", "model", "chunk", "n_tokens", "digest", "shard", "n", "words", "keys", "kept")


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table of (doc_id, text) rows, with lang, source and further columns of clashing names."""

    def make(rows, lang="en"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        df = df.withColumns({"lang": F.lit(lang), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        return df.withColumns({c: F.lit("clash") for c in CLASHING})

    return make
