"""Joins.

No join of data with data carries a broadcast hint: a side is broadcast only when
Spark has measured it below the session's threshold. Otherwise it is shuffled, and a hot
key is split, either by adaptive skew handling or by the explicit salt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.numbers import as_column


def salted_join(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] = (),
    salts: int = 16,
) -> DataFrame:
    """Equi join in which each key's rows are spread over ``salts`` tasks.

    ``dim`` is repeated once per salt. ``salt_by`` must vary within a hot key (a row
    id, say); the salt is a hash of it, so a recomputed task repeats its choice.
    """
    fact = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return fact.join(copies, [*on, "_salt"], how).drop("_salt")


def with_parent(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Inner join to the parent row; children without a parent vanish."""
    return df.join(parent, key)


def lookup(
    df: DataFrame, dim: DataFrame, key: str | Sequence[str], defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Left join to a dimension, with a default where nothing matches."""
    out = df.join(dim, [key] if isinstance(key, str) else list(key), "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def null_safe_lookup(
    df: DataFrame,
    dim: DataFrame,
    null_safe: Mapping[str, object],
    equal: Mapping[str, object],
) -> DataFrame:
    """Left join on mixed keys; maps give {dimension column: column or expression of ``df``}.

    Both kinds of key stay hash-join keys. Dimension key columns are dropped.
    """
    right = dim.select(*[F.col(c).alias(f"_r_{c}") if c in {**null_safe, **equal} else F.col(c) for c in dim.columns])
    condition = reduce(
        lambda a, b: a & b,
        [as_column(v).eqNullSafe(F.col(f"_r_{k}")) for k, v in null_safe.items()]
        + [as_column(v) == F.col(f"_r_{k}") for k, v in equal.items()],
    )
    return df.join(right, condition, "left").drop(*[f"_r_{c}" for c in {**null_safe, **equal}])


def latest_id(df: DataFrame, group: Sequence[str], id_col: str, order: str) -> DataFrame:
    """The id with the highest ``order`` in each group; ties go to the highest id, NULL orders never win."""
    from .aggregates import latest_by

    return df.groupBy(*group).agg(latest_by(id_col, order, id_col).alias(id_col))


def keep_latest(df: DataFrame, group: Sequence[str], id_col: str, order: str) -> DataFrame:
    """Only the rows of each group's latest id.

    An aggregate and a join rather than a window: the aggregate combines before the
    shuffle, so a group that holds a third of all rows never meets in one task.
    """
    winners = latest_id(df, group, id_col, order)
    return df.join(winners, [*group, id_col])


def match_coverage(df: DataFrame, dim: DataFrame, keys: Sequence[str], filled: Column) -> DataFrame:
    """One row: all rows, rows whose key is filled, rows whose key exists in the dimension."""
    known = dim.select(*keys).distinct().withColumn("_known", F.lit(True))
    return df.join(known, list(keys), "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(filled).alias("with_key"),
        F.count("_known").alias("with_match"),
    )


def attach(dim: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join several aggregates of the same key onto a dimension."""
    return reduce(lambda out, part: out.join(part, key, "left"), parts, dim)


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates side by side, as scalar subqueries."""
    spark = aggregates[0].sparkSession
    columns = [a.select(c).scalar().alias(c) for a in aggregates for c in a.columns]
    return spark.range(1).select(*columns)


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(keys.select(key), key, "left_semi")


def todo(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been done yet."""
    return df.join(done.select(key), key, "left_anti")


def covers(gold: DataFrame, runs: DataFrame, run: str, key: str) -> DataFrame:
    """Per run, how many of the wanted ids it answered and whether that is all of them."""
    wanted = gold.select(key).distinct()
    total = wanted.select(F.count(F.lit(1)).alias("n")).scalar()
    answered = runs.select(run, key).distinct().join(wanted, key).groupBy(run).agg(F.count(F.lit(1)).alias("answered"))
    return answered.withColumn("complete", F.col("answered") == total)
