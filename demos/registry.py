"""Queries over the given tables, each with the SQL that an independent engine should agree with."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.session import TABLE_SETTINGS, apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_store(spark: SparkSession) -> SparkSession:
    """Give a local session that names no shared folder one of its own; clusters have to name theirs."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rollcall-"))
    return spark


class Tables:
    """The tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = with_store(apply_settings(spark, TABLE_SETTINGS))
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        # Looked up once per query; later uses of the table are plain attributes.
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register
