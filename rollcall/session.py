"""Session helpers: settings the plans rely on, and where durable cuts of lineage live."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

# Let Spark choose and revise join strategies from measured sizes: a join side is
# broadcast only below autoBroadcastJoinThreshold, and a skewed shuffle partition
# is split even where that costs one more exchange.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For the votes and what is made of them.
TABLE_SETTINGS = ADAPTIVE_SETTINGS | {
    # The Java engine leaves methods above this size uncompiled. Cleaning a vote takes more, as one generated
    # method for a whole stage; smaller ones, for one operator each, are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A join whose smaller side has been measured to have no larger part than this needs no sort of the two sides.
    # Spark heeds this only if parts are no larger when they are put together.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
}


def apply_settings(spark: SparkSession, settings: dict[str, str] = ADAPTIVE_SETTINGS) -> SparkSession:
    """Set runtime settings, one of the sets above, on a session somebody else built."""
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``, or whoever built the session has
    set a checkpoint folder. The library never picks one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = Lock(), Counter(), {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written meanwhile go with the write; else they stay until the driver collects its garbage.

    Tables may be written side by side. Nothing but writes belongs in here: a result that is read again would be made again.
    """
    key = id(spark)
    with _lock:
        if not _writing[key]:
            _before[key] = spark.conf.get(_SHUFFLES_GO)
            spark.conf.set(_SHUFFLES_GO, "true")
        _writing[key] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(_SHUFFLES_GO, _before.pop(key))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so iterative jobs neither replay nor diverge after a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(durable_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same for tables as large as the input: written once as compressed Parquet, of which later steps read the columns they need."""
    path = f"{durable_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
