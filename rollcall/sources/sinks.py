"""Where tables go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.checks import audit_rows
from rollcall.operators.profile import stored_size
from rollcall.session import shuffles_dropped


def write_curated(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), passes: int = 1, dealt_by: Sequence[str] = ()
) -> DataFrame:
    """Replace a Parquet table and return it as read back.

    A partitioned table is rebalanced on its partition columns first. Without that every
    task writes a file into every partition, and a table read from many small files
    stays in many small files; rebalancing also splits a partition that is too large.

    In several ``passes``, rows are dealt to them by a hash of ``dealt_by``, and what a pass shuffles goes before the next:
    for tables whose shuffles would not fit the disk at once. Dealt by the key of its joins, a row meets the same rows.
    """
    for k in range(passes):
        rows = df if passes == 1 else df.filter(F.pmod(F.xxhash64(*dealt_by), F.lit(passes)) == k)
        rows = rows.hint("rebalance", *partition_by) if partition_by else rows
        with shuffles_dropped(df.sparkSession):
            rows.write.mode("append" if k else "overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of files that nothing reads any more, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Replace a Parquet table; returns it as read back, and the rows that went in.

    The rows are counted while they are written, so the table is computed once.
    """
    sent = Observation()
    back = write_curated(df.observe(sent, F.count(F.lit(1)).alias("n")), path)
    return back, sent.get["n"]


def audit_written(back: DataFrame, sent: int, name: str, stamp: Column) -> DataFrame:
    """One audit row: the rows that were sent against the rows that can be read back."""
    counts = back.agg(F.count(F.lit(1)).alias("cloud_rows")).withColumn("local_rows", F.lit(sent).cast("long"))
    return audit_rows(counts, name, stamp)


def export_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append answers to a cache."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def materialise(df: DataFrame, name: str, kind: str, store: str | None = None,
                partition_by: Sequence[str] = (), passes: int = 1, dealt_by: Sequence[str] = ()) -> DataFrame:
    """A staging model becomes a temporary view, a mart a Parquet table under ``store``."""
    if kind == "table" and store:
        df = write_curated(df, f"{store}/{name}", partition_by, passes, dealt_by)
    if kind == "view":
        df.createOrReplaceTempView(name)
    return df


def publish(
    tables: Mapping[str, DataFrame], target: str, stamp: Column, dry_run: bool = False
) -> DataFrame:
    """Replace every table at the target, then append one audit row per table.

    The audit compares the rows of the source with the rows that can be read back. A dry
    run writes nothing and reports the rows that would be sent.
    """
    out = None
    for name, df in tables.items():
        if dry_run:
            sent = df.agg(F.count(F.lit(1)).alias("local_rows")).select(F.lit(name).alias("table_name"), "local_rows")
        else:
            path = f"{target}/{name}"
            back, rows = write_counted(df, path)
            size = stored_size(df.sparkSession, path).scalar()
            sent = audit_written(back, rows, name, stamp).withColumn("cloud_mb", size)
        out = sent if out is None else out.unionByName(sent)
    if not dry_run:
        out.write.mode("append").parquet(f"{target}/load_audit")
        out = out.sparkSession.read.parquet(f"{target}/load_audit")
    return out
