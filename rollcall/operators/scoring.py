"""Scoring of labelling systems against known labels, one row per system and item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import values as V

from .aggregates import cells


def binary_metrics(
    answers: DataFrame,
    by: Sequence[str],
    truth: str,
    said: str,
    labels: Sequence[str] = V.SCORED_LABELS,
) -> DataFrame:
    """Accuracy, precision and recall per label, and the share of answers outside the labels.

    Every figure comes from one conditional pass. A precision or recall with an empty
    denominator is NULL.
    """
    t, s = F.col(truth), F.col(said)
    n = F.count(F.lit(1))
    hit = s.eqNullSafe(t)
    columns = [n.alias("proposals"), F.try_divide(F.count_if(hit), n).alias("accuracy")]
    for label in labels:
        both = F.count_if((s == label) & (t == label))
        columns += [
            F.try_divide(both, F.count_if(s == label)).alias(f"{label}_precision"),
            F.try_divide(both, F.count_if(t == label)).alias(f"{label}_recall"),
        ]
    clear = F.coalesce(s.isin(list(labels)), F.lit(False))
    columns.append(F.try_divide(F.count_if(~clear), n).alias("no_clear_answer"))
    return answers.groupBy(*by).agg(*columns)


def confusion(
    answers: DataFrame, by: Sequence[str], truth: str, said: str, values: Sequence[str], other: str | None = None
) -> DataFrame:
    """Truth against what was said, per system; answers outside the list are counted under ``other``, or fail the query."""
    return answers.groupBy(*by, truth).agg(*cells(said, values, other))
