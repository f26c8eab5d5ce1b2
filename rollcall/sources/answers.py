"""Answer caches: JSON lines in which the last answer of an id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.ranking import last_write


def read_labels_jsonl(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """run, id and label: the last line of each id per file; blank lines are skipped.

    Lines are ordered by the offset of their split and their place in it, which is the
    order in the file however the file was split.
    """
    lines = (
        spark.read.schema("id string, label string")
        .json(path)
        .select(
            F.regexp_extract("_metadata.file_path", run_pattern, 1).alias("run"),
            "id", "label",
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_line"),
        )
        .filter(F.col("id").isNotNull())
    )
    answer = F.struct("run", "id").alias("key")
    last = last_write(lines.withColumn("key", answer), "key", [F.col("_split"), F.col("_line")], ["label"])
    return last.select("key.run", "key.id", "label")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Answers written by :func:`rollcall.sources.sinks.append_jsonl`: a folder of part files.

    Each append stamps its lines, so the latest append of an id counts.
    """
    lines = spark.read.schema("id string, label string, written_at timestamp").json(path)
    return last_write(lines.filter(F.col("id").isNotNull()), "id", [F.col("written_at"), F.col("label")], ["label"])
