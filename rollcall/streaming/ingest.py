"""Incremental ingest of vote files.

A Structured Streaming file source remembers which files it has handed out; the
checkpoint makes each run pick up only new ones. Every batch is written to its own
folder by overwriting, so a batch that is repeated after a failure replaces itself.
Beside the votes lies a manifest, one row per loaded accession: it answers which files are done and
how many rows there are, so no run reads the votes of earlier ones. If the checkpoint is lost,
files whose accession is in the manifest are skipped.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.operators.joins import todo
from rollcall.sources.sinks import audit_written, write_counted
from rollcall.sources.text_tables import read_text_csv, text_schema

BATCH = "ingest_batch"
_FILE = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "_manifest"  # Spark takes no folder of such a name for data of the one above
_LOADED = "accession string, batch_rows long, ingest_batch string"


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """Everything ingested so far, without the bookkeeping column."""
    return spark.read.schema(_target_schema()).parquet(target).drop(BATCH)


def _target_schema():
    return text_schema([*V.VOTE_COLUMNS, BATCH])


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """The manifest: accession, batch and rows of the batch, for every accession with votes."""
    path = f"{target}/{MANIFEST}"
    if not _has_data(spark, path):
        return spark.createDataFrame([], _LOADED)
    return spark.read.schema(_LOADED).parquet(path)


def skip_done(batch: DataFrame, done: DataFrame, key: str = "accession") -> DataFrame:
    """Rows of a batch whose key no earlier batch has loaded."""
    return todo(batch, done.select(key).distinct(), key)


def ingest_available(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    glob: str = "*.csv.gz",
    accession_pattern: str = r"([^/]+)\.csv(?:\.gz)?$",
    audit: str | None = None,
    files_per_batch: int = 10_000,
) -> dict[str, int]:
    """Append the vote files that have arrived since the last run; returns file and row counts.

    ``files_per_batch`` bounds the list of paths that a batch hands to the driver; a run goes on until all files are in.
    """
    counts = {"new_vote_files": 0, "new_votes": 0}

    def write(files: DataFrame, batch_id: int) -> None:
        session = files.sparkSession
        # The query id lives in the checkpoint, so folders of two checkpoints never collide.
        own = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        offered = files.select("path", F.regexp_extract("path", accession_pattern, 1).alias("accession"))
        offered = skip_done(offered, loaded(session, target).filter(F.col(BATCH) != own))
        paths = [row["path"] for row in offered.select("path").collect()]
        if not paths:
            return
        rows = read_text_csv(session, paths, V.VOTE_COLUMNS)
        place = f"{target}/{BATCH}={own}"
        written, sent = write_counted(rows, place)
        # What is listed is fully written; a batch that fails before this comes again under its own name.
        listed = written.select("accession").distinct().withColumn("batch_rows", F.lit(sent).cast("long"))
        listed.write.mode("overwrite").parquet(f"{target}/{MANIFEST}/{BATCH}={own}")
        if audit:
            audit_written(written, sent, own, F.current_timestamp()).write.mode("append").parquet(audit)
        counts["new_vote_files"] += len(paths)
        counts["new_votes"] += sent

    # Only the listing is streamed; the contents are read per batch, with their header layouts.
    listing = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )
    query = (
        listing.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    total = loaded(spark, target).groupBy(BATCH).agg(F.max("batch_rows").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {**counts, "total_votes": total}


def _has_data(spark: SparkSession, path: str) -> bool:
    """True once a path exists in the file system it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


RUN_SCHEMA = (
    "run_at timestamp, new_filings long, new_vote_files long, new_votes long, total_votes long, status string"
)


def refresh(
    spark: SparkSession, folder: str, target: str, checkpoint: str, log: str, new_filings: int = 0, then=None
) -> dict:
    """One refresh: ingest, then whatever ``then`` rebuilds; one log row is written even on failure."""
    record = {
        "run_at": datetime.now(timezone.utc).replace(tzinfo=None),
        "new_filings": new_filings, "new_vote_files": 0, "new_votes": 0, "total_votes": 0, "status": "failed",
    }
    try:
        record.update(ingest_available(spark, folder, target, checkpoint))
        if then is not None:
            then(read_ingested(spark, target))
        record["status"] = "ok"
    finally:
        spark.createDataFrame([record], RUN_SCHEMA).write.mode("append").json(log)
    return record
