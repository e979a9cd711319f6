import pytest


@pytest.fixture()
def docs(spark):
    """Make a documents table from (doc_id, text) rows, with clashing extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("row", "_row", "_id", "body", "fp", "label", "_tokens", "_keys", "_lines", "key", "k", "start", "base", "tokens"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
