"""Profiles of tables: shapes of a text column, and an inventory of what a folder holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.text import shape

from .aggregates import value_counts
from .ranking import top_k


def shape_profile(df: DataFrame, col: str, k: int = 12, name: str = "votes") -> DataFrame:
    """The most frequent layouts of a text column."""
    shapes = df.select(shape(col).alias("pattern"))
    counts = value_counts(shapes, "pattern", name=name)
    return top_k(counts, [F.desc(name), F.asc_nulls_last("pattern")], k)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy("table_name")


def stored_size(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """One row: megabytes that the data files below a path take. Only file listings are read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.agg(F.round(F.sum("length") / 1e6, 1).alias("parquet_mb"))
