"""Data-quality checks. Each returns the rows that break the rule; none means the check passes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.dates import age_days

from .joins import one_row


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def unique(df: DataFrame, col: str) -> DataFrame:
    return unique_combination(df.filter(F.col(col).isNotNull()), [col])


def unique_combination(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    copies = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    return copies.filter(F.col("copies") > 1)


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their counts; NULL passes."""
    return df.filter(~F.col(col).isin(list(values))).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def relationships(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(parent_col).alias(col))
    return df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti")


def between(df: DataFrame, col: str, low, high) -> DataFrame:
    """Rows outside the closed range; NULL passes."""
    return df.filter((F.col(col) < low) | (F.col(col) > high))


def metric_at_most(df: DataFrame, col: str, limit) -> DataFrame:
    return df.select(col).filter(F.col(col) > limit)


def audit_rows(counts: DataFrame, name: str, stamp: Column) -> DataFrame:
    """Audit columns for a table of local_rows and cloud_rows."""
    return counts.select(
        stamp.alias("published_at"),
        F.lit(name).alias("table_name"),
        "local_rows",
        "cloud_rows",
        F.when(F.col("local_rows") == F.col("cloud_rows"), "ok").otherwise("MISMATCH").alias("status"),
    )


def row_count_audit(source: DataFrame, target: DataFrame, name: str, stamp: Column) -> DataFrame:
    """One row: rows at both ends and whether they agree."""
    n = F.count(F.lit(1))
    counts = one_row(source.agg(n.alias("local_rows")), target.agg(n.alias("cloud_rows")))
    return audit_rows(counts, name, stamp)


def fresh(df: DataFrame, stamp: str, max_days: int, now: Column) -> DataFrame:
    """The last stamp, if it is more than ``max_days`` whole days old."""
    last = df.agg(F.max(stamp).alias("last_publish"))
    return last.filter(age_days("last_publish", now) > max_days)


def reconcile(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row of totals if any pair of one-row, one-column aggregates differs; NULL counts as 0."""
    ends = []
    for name, (left, right) in pairs.items():
        ends += [left.toDF(f"{name}_report"), right.toDF(f"{name}_source")]
    differs = F.lit(False)
    for name in pairs:
        differs = differs | (
            F.coalesce(F.col(f"{name}_report"), F.lit(0)) != F.coalesce(F.col(f"{name}_source"), F.lit(0))
        )
    return one_row(*ends).filter(differs)


def run(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check with its number of violations, from a single job."""
    out = None
    for name, violations in checks.items():
        row = violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


# Many rules at once ------------------------------------------------------------


class Rule(NamedTuple):
    """A declared rule on named tables: the rows that break it, and the marks by which it is counted with others.

    A mark belongs to a table and makes, from the rule's name, a struct or NULL for each of its rows.
    """

    violations: Callable[[Mapping[str, DataFrame]], DataFrame]
    marks: tuple[tuple[str, Callable[[str], Column]], ...]


def _mark(
    name: str, kind: str, when: Callable[[], Column] | None = None, key: Sequence[str] = (), part: str = "", left=0, right=0, parent: bool = False
) -> Column:
    amounts = [F.coalesce(F.col(x), F.lit(0)) if isinstance(x, str) else F.lit(x) for x in (left, right)]
    told = F.struct(
        F.lit(name).alias("check"), F.lit(kind).alias("kind"), F.lit(part).alias("part"),
        F.array(*[F.col(c).cast("string") for c in key]).cast("array<string>").alias("key"),
        amounts[0].cast("long").alias("left"), amounts[1].cast("long").alias("right"), F.lit(parent).alias("parent"),
    )
    return told if when is None else F.when(when(), told)


def _marked(table: str, kind: str, **how) -> tuple[str, Callable[[str], Column]]:
    return table, partial(_mark, kind=kind, **how)


def rule_not_null(table: str, col: str) -> Rule:
    return Rule(lambda t: not_null(t[table], col), (_marked(table, "rows", when=lambda: F.col(col).isNull(), left=1),))


def rule_between(table: str, col: str, low, high) -> Rule:
    outside = lambda: (F.col(col) < low) | (F.col(col) > high)
    return Rule(lambda t: between(t[table], col, low, high), (_marked(table, "rows", when=outside, left=1),))


def rule_at_most(table: str, col: str, limit) -> Rule:
    return Rule(lambda t: metric_at_most(t[table], col, limit), (_marked(table, "rows", when=lambda: F.col(col) > limit, left=1),))


def rule_accepted(table: str, col: str, values: Sequence) -> Rule:
    odd = lambda: ~F.col(col).isin(list(values))
    return Rule(lambda t: accepted_values(t[table], col, values), (_marked(table, "values", when=odd, key=[col]),))


def rule_unique(table: str, col: str) -> Rule:
    return Rule(lambda t: unique(t[table], col), (_marked(table, "grain", when=lambda: F.col(col).isNotNull(), key=[col], left=1),))


def rule_grain(table: str, cols: Sequence[str]) -> Rule:
    return Rule(lambda t: unique_combination(t[table], cols), (_marked(table, "grain", key=cols, left=1),))


def rule_relationship(table: str, col: str, parent: str, parent_col: str) -> Rule:
    return Rule(
        lambda t: relationships(t[table], col, t[parent], parent_col),
        (
            _marked(table, "orphans", when=lambda: F.col(col).isNotNull(), key=[col], left=1),
            _marked(parent, "orphans", when=lambda: F.col(parent_col).isNotNull(), key=[parent_col], parent=True),
        ),
    )


def rule_balance(violations: Callable[[Mapping[str, DataFrame]], DataFrame], *sides: tuple[str, Mapping]) -> Rule:
    """A reconciliation: in every ``part``, ``left`` and ``right`` amounts sum to the same; right ones count under keys with a ``parent``."""
    return Rule(violations, tuple(_marked(table, "balance", **how) for table, how in sides))


def run_rules(tables: Mapping[str, DataFrame], rules: Mapping[str, Rule]) -> DataFrame:
    """One row per rule with its number of violations, as :func:`run` counts them, from one scan of each table.

    Each row of a table gives its marks for all rules: none where rules on single rows and values hold, and one key for
    each rule on keys. Marks are summed by key before the shuffle, so a hot key is one row of each task.
    """
    by_table: dict[str, list[Column]] = defaultdict(list)
    for name, rule in rules.items():
        for table, mark in rule.marks:
            by_table[table].append(mark(name))
    marks = reduce(
        DataFrame.unionByName,
        [tables[t].select(F.explode(F.filter(F.array(*m), lambda x: x.isNotNull())).alias("m")).select("m.*") for t, m in by_table.items()],
    )
    by_key = marks.groupBy("check", "kind", "part", "key").agg(
        F.sum("left").alias("left"), F.sum("right").alias("right"), F.bool_or("parent").alias("parent")
    )
    broken = (
        F.when(F.col("kind") == "rows", F.col("left"))
        .when(F.col("kind") == "values", 1)
        .when(F.col("kind") == "grain", (F.col("left") > 1).cast("long"))
        .when((F.col("kind") == "orphans") & ~F.col("parent"), F.col("left"))
        .otherwise(0)
    )
    right = F.sum(F.when(F.col("parent"), F.col("right")).otherwise(0))
    parts = by_key.groupBy("check", "kind", "part").agg(F.sum(broken).alias("n"), (F.sum("left") != right).alias("differs"))
    differs = F.bool_or((F.col("kind") == "balance") & F.col("differs")).cast("long")
    counted = parts.groupBy("check").agg((F.sum("n") + differs).alias("violations"))
    names = marks.sparkSession.createDataFrame([(name,) for name in rules], "check string")
    return names.join(counted, "check", "left").select("check", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
