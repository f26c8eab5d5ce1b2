"""Aggregations. Everything combines before the shuffle; nothing collects an unbounded group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions.numbers import as_column, percent, round_half_even, round_half_up


def count_all() -> Column:
    return F.count(F.lit(1))


def latest_by(value, order, *ties) -> Column:
    """Aggregate: the value at the highest order.

    Rows where the value or the order is NULL do not take part; ``ties`` decide among equal orders.
    """
    value, order = as_column(value), as_column(order)
    rank = F.struct(order, *[as_column(t) for t in ties])
    return F.max_by(value, F.when(value.isNotNull() & order.isNotNull(), rank))


def any_answer(col) -> Column:
    """Aggregate: one non-NULL value of the group, always the same one."""
    return F.min(as_column(col))


def fold(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)``, for aggregates that hold texts.

    Spark sorts rows for those. A hash in front of the keys settles most comparisons by a number, where
    ids that begin alike have to be compared to their end.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(*aggregates).drop("_hash")


def value_counts(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Counts of each combination, most frequent first."""
    return df.groupBy(*cols).agg(count_all().alias(name)).orderBy(F.desc(name), *[F.asc_nulls_last(c) for c in cols])


def labelled_counts(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table or set: its label and its number of rows."""
    out = None
    for label, df in parts.items():
        row = df.agg(count_all().alias("n")).select(F.lit(label).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def two_level_rate(df: DataFrame, group: Sequence[str], entity: str, flag: str) -> DataFrame:
    """Per group: entities, votes, percent over all votes, and percent of the average entity."""
    per_entity = df.groupBy(*group, entity).agg(
        count_all().alias("votes"),
        F.count_if(F.col(flag)).alias("_for"),
        F.avg(F.col(flag).cast("int")).alias("_rate"),
    )
    return per_entity.groupBy(*group).agg(
        count_all().alias("funds"),
        F.sum("votes").alias("votes"),
        percent(F.sum("_for"), F.sum("votes"), 2).alias("pct_for_all_votes"),
        round_half_up(100 * F.avg("_rate"), 2).alias("pct_for_average_fund"),
    )


def one_answer(
    df: DataFrame,
    keys: Sequence[str],
    answer: str,
    weight: str,
    any_of: Sequence[str] = (),
    any_true: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the answer that carries the most weight (ties: last in the alphabet)."""
    weighted = F.coalesce(F.col(weight), F.lit(0.0))
    return df.groupBy(*keys).agg(
        *[any_answer(c).alias(c) for c in any_of],
        *[F.bool_or(c).alias(c) for c in any_true],
        latest_by(answer, weighted, answer).alias(answer),
    )


def having(df: DataFrame, min_n: int, n: str = "votes") -> DataFrame:
    """Groups with enough rows."""
    return df.filter(F.col(n) >= min_n)


def blank_rates(df: DataFrame, blanks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Percent of blank rows in each column, in one pass; each column has its own blank marks."""
    n = count_all()
    return df.agg(
        *[
            percent(F.count_if(F.coalesce(F.col(c), F.lit("")).isin(list(marks))), n, 2).alias(c)
            for c, marks in blanks.items()
        ]
    )


def cells(col: str, values: Sequence, other: str | None = None) -> list[Column]:
    """Aggregates: how often each listed value occurs, under its own name, and how often any other does.

    Without a name for the others, the query fails where there are any: no row is left out unseen.
    Rows whose value is NULL are in no cell.
    """
    named = [F.count_if(F.col(col) == v).alias(str(v)) for v in values]
    rest = F.count_if(~F.col(col).isin(list(values)))
    if other is not None:
        return [*named, rest.alias(other)]
    complaint = F.raise_error(F.concat(F.lit(f"unlisted values of {col}: "), rest.cast("string")))
    return [F.when(rest > 0, complaint.cast("bigint")).otherwise(F.count_if(F.col(col) == values[0])).alias(str(values[0])), *named[1:]]


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, other: str | None = None) -> DataFrame:
    """Counts of row values against the listed column values; rows without a row value are a row of their own."""
    return df.groupBy(row).agg(*cells(col, values, other))


def crosstab_margins(
    df: DataFrame, row: str, col: str, values: Sequence, total: str = "All", other: str | None = None
) -> DataFrame:
    """Crosstab with row, column and grand totals, over the rows that have both values."""
    both = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    rolled = both.rollup(row).agg(
        F.grouping(row).alias("_all"), *cells(col, values, other), count_all().alias(total)
    )
    named = rolled.withColumn(row, F.when(F.col("_all") == 1, total).otherwise(F.col(row)))
    # The grand total of no rows is no row.
    return named.filter(F.col(total) > 0).drop("_all")


def share_of_total(df: DataFrame, measure: str, name: str, digits: int = 1) -> DataFrame:
    """Each row's percent of the grand total; the total is a one-row scalar, not a global window."""
    total = df.agg(F.sum(measure).alias("total")).scalar()
    return df.withColumn(name, percent(F.col(measure), total, digits))


def share_by(df: DataFrame, group: Sequence[str], measure: str, size_name: str = "proposals") -> DataFrame:
    """Size, sum and percent of the grand total per group (percent rounded half to even)."""
    sums = df.groupBy(*group).agg(count_all().alias(size_name), F.sum(measure).alias(measure))
    total = df.agg(F.sum(measure).alias("total")).scalar()
    share = round_half_even(F.try_divide(F.lit(100.0) * F.col(measure), total), 1)
    return sums.withColumn("share_of_votes", share)


def top_row(df: DataFrame, group: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """All listed attributes from the one row of each group that has the highest order."""
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("_best")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"_best.{c}").alias(c) for c in cols])


def top_texts(
    df: DataFrame,
    group: Sequence[str],
    text: str,
    order: Sequence[Column],
    k: int = V.WORDINGS_KEPT,
    sep: str = " || ",
    name: str = "all_wordings",
) -> DataFrame:
    """The first ``k`` distinct texts of each group, joined in order.

    Copies of a text collapse before the shuffle, and the rank filter keeps ``k`` texts
    per task before it, so no more than ``k`` texts of a group are ever held together.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    texts = df.groupBy(*group, text).agg(F.min(rank).alias("_rank"))
    by_rank = Window.partitionBy(*group).orderBy("_rank", text)
    kept = texts.withColumn("_pos", F.row_number().over(by_rank)).filter(F.col("_pos") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_pos", text))), lambda s: s[text])
    return kept.groupBy(*group).agg(F.array_join(listed, sep).alias(name))


def agreement(df: DataFrame, a: str, b: str, unclear: str, clear: Sequence[str]) -> DataFrame:
    """One row: how many rows carry both signals, and how often they agree."""
    both = df.filter(F.col(b).isin(list(clear)) & (F.col(a) != unclear))
    return both.agg(
        count_all().alias("both"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agree")
    )
