"""The whole build as one acyclic plan: raw tables to marts, labels and reports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from rollcall import values as V
from rollcall.session import cut_lineage, stored
from rollcall.sources.sinks import materialise

from . import labelling, marts, reports, staging


def build(
    raw: dict[str, DataFrame],
    store: str | None = None,
    labels: DataFrame | None = None,
    window: tuple[str, str] = V.MEETING_WINDOW,
    threshold: float = V.MATCH_THRESHOLD,
    votes_by: Sequence[str] = ("report_year",),
    passes: int = 1,
) -> dict[str, DataFrame]:
    """Every table of the build.

    With a ``store``, marts are written there as Parquet and read back, so the vote table
    is cleaned once and later marts read columns from disk. Without one the plan stays
    lazy, but for what labelling has to materialise. Stored votes are partitioned by the columns ``votes_by``, for which
    they are shuffled once more. They are written in so many ``passes``, each over the votes of some filings; with more
    than one, nothing else is written beside them. Given ``labels`` replace the
    labelling step.
    """
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, kind: str = "table", partition_by: Sequence[str] = (), passes: int = 1) -> DataFrame:
        # The session is not the build's own, so its views carry a prefix that no user's view has.
        out[name] = materialise(df, f"rollcall_{name}" if kind == "view" else name, kind, store, partition_by, passes, ["filing_id"])
        return out[name]

    def keep_together(*tables: tuple) -> list[DataFrame]:
        """Tables that do not need each other are written at the same time, to fill the cluster."""
        with ThreadPoolExecutor(len(tables)) as pool:
            return list(pool.map(lambda table: keep(*table), tables))

    filings = keep("filings", staging.filings(raw["filings"]), "view")
    series = keep("series", staging.series(raw["series"]), "view")
    clean = keep("clean_votes", staging.clean_votes(raw["votes"], window), "view")
    first = [("votes", marts.votes(clean, filings), "table", votes_by, passes), ("funds", marts.funds(series, filings))]
    votes, funds = keep_together(*first) if passes == 1 else [keep(*table) for table in first]

    # Stored votes are read back; otherwise the clean ones spare a second join to the filings.
    answers = marts.fund_answers(votes if store else clean, filings, funds, stored if store else cut_lineage)
    # Labelling reads the answers and so does the labelled fact: settle them once.
    answers = keep("fund_answers", answers if store else cut_lineage(answers))
    if labels is None:
        wordings = keep("wordings", labelling.wordings(answers))
        matched = cut_lineage(labelling.match_proposals(wordings, threshold))
        groups = keep("proposal_groups", labelling.proposal_groups(matched))
        labels = labelling.proposal_labels(matched, groups)
    labels = keep("proposal_labels", labels)
    fact = keep("fund_es_votes", marts.fund_es_votes(answers, labels))

    _, topics, *_ = keep_together(
        ("quality_summary", marts.quality_summary(votes)),
        ("fund_year_topic", marts.fund_year_topic(votes)),
        ("sibling_comparison", marts.sibling_comparison(fact)),
        ("support_by_direction", marts.support_by_direction(fact)),
        ("house_gap", reports.house_gap(fact)),
    )
    keep_together(
        ("topic_trends", reports.topic_trends(topics)),
        ("fund_scorecard", reports.fund_scorecard(funds, topics, fact)),
    )
    return out
