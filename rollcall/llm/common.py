"""What the operators on training text share: words, let-bindings, stored tables, size checks."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.session import durable_dir

# Everything in ASCII that is not a letter or a digit parts words; all else is in them.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; none for null and empty texts."""
    return F.array_remove(F.split(lower_ascii(text), WORD_BREAK), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it.

    A plain column would be copied into every place by Catalyst's project merging, and into
    lambdas, where it would be worked out again for every element.
    """
    return F.transform(F.array(value), body)[0]


def places(n: Column) -> Column:
    """1..n; empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session without one, as in tests, gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="training-text-"))
    return durable_dir(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: later jobs read files that outlive any executor, and see the same
    rows however often they are retried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile hands Python so many rows at a time at most; Spark's own number of rows is meant for narrow ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written, once nothing reads them any more."""
    for table in tables:
        spark, path = table.sparkSession, table._stored_at
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_below(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint for a table of a counted number of rows, up to a bound; else Spark's own choice of join."""
    return F.broadcast(df) if rows <= most else df


def hex_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
