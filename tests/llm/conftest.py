import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, lang) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing():
    """A table with extra columns under names that the operators use themselves."""

    def add(df):
        for name in ("row", "n", "cls", "sig", "key", "gram", "copy", "at", "pos", "part", "turn", "same", "w", "x", "block", "shard"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return add
