"""Order-based operators that hold up when one group, or the whole table, is too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import cut_lineage

_SLOT_BITS = 33


def with_position(
    df: DataFrame, order: Sequence[Column], name: str = "position", within: Sequence[str] = ()
) -> DataFrame:
    """Number the rows 1, 2, 3, ... in a total order, over the whole table or within groups.

    The rows are range-partitioned and sorted on (group, order), so neither the table
    nor a hot group is gathered in one task. The sorted rows are checkpointed, since a
    second evaluation might draw other partition bounds. What one task then adds up is
    one row per partition, and that is also all that is joined back.
    """
    slots = cut_lineage(
        df.orderBy(*[F.col(c) for c in within], *order).withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _SLOT_BITS)
    placed = slots.withColumn("_part", part).withColumn(
        "_at", F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: a size fixed by the shuffle, whatever the data.
    out = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1)
    out = out.drop("_slot", "_part", "_at", "_start")
    if not within:
        return out
    firsts = out.groupBy(*[F.col(c).alias(f"_g_{c}") for c in within]).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within]
    return (
        out.join(firsts, same)
        .withColumn(name, F.col(name) - F.col("_first") + 1)
        .drop("_first", *[f"_g_{c}" for c in within])
    )


def every_nth(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Every n-th row of the ordered table, starting with the first."""
    return with_position(df, order, "_position").filter((F.col("_position") - 1) % n == 0).drop("_position")


def trial_sample(df: DataFrame, order: Sequence[Column], target: int = 250) -> DataFrame:
    """An even spread of about ``target`` rows over the ordered table."""
    return every_nth(df, order, max(1, df.count() // target))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order; each task keeps only its own ``k``."""
    return df.orderBy(*order).limit(k)


def top_k_then(df: DataFrame, order: Sequence[Column], k: int, name: str, derived: Column) -> DataFrame:
    """The top rows by one order, shown in the order of a derived column."""
    return top_k(df, order, k).withColumn(name, derived).orderBy(F.asc_nulls_last(name))


def distinct_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """The first ``k`` distinct values."""
    return df.select(col).distinct().orderBy(F.asc_nulls_last(col)).limit(k)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows: those whose keys (all columns, if none are named) hash lowest together with the seed.

    A rerun, on whatever partitions, shows the same rows.
    """
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns]))
    return df.orderBy(drawn).limit(n)


def latest_batch(df: DataFrame, stamp: str) -> DataFrame:
    """Rows of the latest batch; the newest stamp is a scalar subquery, not a global window."""
    newest = df.agg(F.max(stamp).alias("newest")).scalar()
    return df.filter(F.col(stamp) == newest)


def last_write(df: DataFrame, key: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The last write of each key, by aggregate, so that a key rewritten without end is no hot spot."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    last = df.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in cols])


def search(df: DataFrame, cols: Sequence[str], text: str, order: Sequence[Column]) -> DataFrame:
    """Rows whose joined columns contain the text, ignoring case; a blank text keeps every row."""
    wanted = text.strip().lower()
    if wanted:
        joined = F.concat_ws(" ", *[F.col(c) for c in cols])
        df = df.filter(F.lower(joined).contains(wanted))
    return df.orderBy(*order)


def to_batches(df: DataFrame, order: Sequence[Column], n: int, cols: Sequence[str], key: str) -> DataFrame:
    """Ordered rows in batches of ``n``, each with its rows as one JSON array and its size."""
    placed = with_position(df, order, "_position")
    batch = F.floor((F.col("_position") - 1) / n).cast("long")
    items = F.sort_array(F.collect_list(F.struct("_position", F.struct(*cols).alias("item"))))
    return (
        placed.withColumn("batch", batch)
        .groupBy("batch")
        .agg(F.count(key).alias("asked"), F.to_json(F.transform(items, lambda s: s["item"])).alias("payload"))
    )
