"""Facts, dimensions and comparisons built from the staged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import decide, numbers, text
from rollcall.operators import aggregates as A
from rollcall.operators import joins as J
from rollcall.session import cut_lineage


def votes(clean: DataFrame, filings: DataFrame) -> DataFrame:
    """Cleaned votes with their filing; a vote without a filing vanishes."""
    parent = filings.select("filing_id", "filer_kind", "filer_name", "report_year", "is_amendment")
    return J.with_parent(clean, parent, "filing_id")


def quality_summary(votes: DataFrame) -> DataFrame:
    """Headline quality figures, one row, one pass."""
    n = A.count_all()
    comparable = F.count_if(F.col("voted_with_management").isNotNull())
    return votes.agg(
        n.alias("votes"),
        F.count_distinct("filing_id").alias("filings_with_votes"),
        F.count_if(F.col("filer_kind") == "fund").alias("fund_votes"),
        F.count_if(F.col("filer_kind") == "manager").alias("manager_votes"),
        numbers.percent(F.count_if(F.col("meeting_date").isNull()), n, 3).alias("pct_no_usable_date"),
        numbers.percent(F.count_if(F.col("cusip").isNull()), n, 2).alias("pct_no_cusip"),
        numbers.percent(F.count_if(F.col("vote") == "OTHER"), n, 3).alias("pct_vote_unrecognised"),
        numbers.percent(F.count_if(F.col("vote") == "UNKNOWN"), n, 2).alias("pct_vote_blank"),
        numbers.percent(F.count_if(F.col("vote") == "NOT VOTED"), n, 2).alias("pct_not_voted"),
        numbers.percent(comparable, n, 2).alias("pct_comparable_to_management"),
        numbers.percent(F.count_if("voted_with_management"), comparable, 2).alias("pct_with_management"),
        F.count_if("is_environment").alias("environment_votes"),
        F.count_if("is_social").alias("social_votes"),
        F.count_if(F.col("proposed_by") == "shareholder").alias("shareholder_proposal_votes"),
    )


def funds(series: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per fund: latest attributes, years seen, and whether its name carries a theme word."""
    parent = filings.select("filing_id", "filer_cik", "filer_name", "report_year", "filed_date")
    # One aggregate by fund: each task folds its rows into the funds it meets before the shuffle, however many
    # filers and filings a fund has.
    ties = ["filer_cik", "fund_name", "filer_name"]
    latest = A.fold(
        J.with_parent(series, parent, "filing_id"),
        ["fund_id"],
        *[A.latest_by(c, "filed_date", *ties).alias(c) for c in ["fund_name", "filer_name", "filer_cik"]],
        F.count_distinct("fund_name").alias("names_used"),
        F.min("report_year").alias("first_report_year"),
        F.max("report_year").alias("last_report_year"),
    )
    return latest.withColumn("is_esg_named", text.matches_word("fund_name", V.THEME_WORDS))


def qualifying_votes(votes: DataFrame, filings: DataFrame) -> DataFrame:
    """Fund votes with a clear answer on environmental or social shareholder proposals."""
    parent = filings.filter((F.col("filer_kind") == "fund") & F.col("report_year").isNotNull()).select(
        "filing_id", "filer_cik", "filer_name", "report_year", "filed_date"
    )
    wanted = votes.filter(
        F.col("fund_id").isNotNull()
        & (F.col("proposed_by") == "shareholder")
        & (F.col("is_environment") | F.col("is_social"))
        & F.col("vote").isin(V.DECIDED_ANSWERS)
    ).select(
        "filing_id", "fund_id", "issuer_name", "cusip", "meeting_date", "proposal_text",
        "is_environment", "is_social", "vote", "voted_with_management", "shares_voted",
    )
    # The key is made behind the join, for the votes of such filings alone, and takes no room in its shuffle.
    key = text.proposal_key("cusip", "issuer_name", "meeting_date", "proposal_text")
    return J.with_parent(wanted, parent, "filing_id").withColumn("proposal_key", key)


def fund_answers(
    votes: DataFrame, filings: DataFrame, funds: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """One row per fund and proposal, not yet labelled.

    Split answers are settled first, which shrinks the votes to one row per proposal;
    superseded filings are dropped from that smaller table. Both steps read the same
    qualifying votes, so a corrected filing without such votes displaces nothing. Votes need
    not have met their filing yet: they meet it here. ``cut`` materialises the settled answers.
    """
    answers = A.one_answer(
        qualifying_votes(votes, filings),
        # The filer's attributes follow from the filing: as keys they need no aggregate.
        keys=["filing_id", "fund_id", "proposal_key", "filer_cik", "filer_name", "report_year", "filed_date"],
        answer="vote",
        weight="shares_voted",
        any_of=["issuer_name", "cusip", "meeting_date", "proposal_text"],
        any_true=["is_environment", "is_social", "voted_with_management"],
    )
    # The latest filing is sought among these rows and then joined back to them. Both sides
    # read the settled rows, a small part of the votes, instead of cleaning the votes twice.
    answers = cut(answers)
    current = J.keep_latest(answers, ["filer_cik", "report_year", "fund_id"], "filing_id", "filed_date").select(
        "filing_id", "fund_id", "proposal_key", "filer_cik", "filer_name", "report_year", "issuer_name", "cusip",
        "meeting_date", "proposal_text", "is_environment", "is_social", "vote", "voted_with_management",
        (F.col("vote") == "FOR").alias("supported"),
    )
    named = J.lookup(
        current, funds.select("fund_id", "is_esg_named", "fund_name"), "fund_id", {"is_esg_named": False}
    )
    return named.withColumn("is_reference_house", text.matches_any_of("fund_name", "filer_name", V.REFERENCE_HOUSES))


def fund_es_votes(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled fact: each answer with the proposal it matches and the way that proposal points."""
    found = labels.select(
        "cusip", "meeting_date", "report_year", "wording_key",
        F.col("proposal_id").alias("matched_proposal_id"), "direction", F.col("basis").alias("direction_basis"),
    )
    joined = J.null_safe_lookup(
        answers,
        found,
        null_safe={"cusip": "cusip", "meeting_date": "meeting_date"},
        equal={"report_year": "report_year", "wording_key": text.wording_key("proposal_text")},
    )
    return joined.withColumn("direction", F.coalesce("direction", F.lit(V.UNCLEAR))).withColumn(
        "direction_basis", F.coalesce("direction_basis", F.lit(V.NOT_LABELLED))
    )


def sibling_comparison(fact: DataFrame) -> DataFrame:
    """Themed funds against the other funds of the same filing on the same proposal."""
    themed = F.col("is_esg_named")
    return (
        fact.filter(~F.col("is_reference_house"))
        .groupBy("filing_id", "proposal_key")
        .agg(
            *[A.any_answer(c).alias(c) for c in ["filer_name", "report_year", "direction", "direction_basis"]],
            F.count_if(themed).alias("esg_funds"),
            F.count_if(~themed).alias("other_funds"),
            numbers.rate("supported", themed).alias("esg_support"),
            numbers.rate("supported", ~themed).alias("other_support"),
        )
        .filter((F.col("esg_funds") > 0) & (F.col("other_funds") > 0))
        .withColumn("support_gap", F.col("esg_support") - F.col("other_support"))
        .withColumn("outcome", decide.outcome("esg_support", "other_support"))
    )


def support_by_direction(fact: DataFrame) -> DataFrame:
    """The headline: support per fund group, split by the way proposals point."""
    group = ["report_year", "direction", "direction_basis", "fund_group"]
    grouped = fact.withColumn("fund_group", decide.fund_group("is_reference_house", "is_esg_named"))
    return A.two_level_rate(grouped, group, "fund_id", "supported").orderBy(
        *[F.asc_nulls_last(c) for c in ["direction_basis", "direction", "report_year", "fund_group"]]
    )


def fund_year_topic(votes: DataFrame) -> DataFrame:
    """Answers per fund, year, topic and proposer: the whole vote table in one small summary."""
    wanted = votes.filter(
        (F.col("filer_kind") == "fund") & F.col("fund_id").isNotNull() & F.col("report_year").isNotNull()
    )
    topic = decide.first_true(V.TOPIC_PRECEDENCE, "Other").alias("topic")
    return wanted.groupBy("fund_id", "report_year", topic, "proposed_by").agg(
        A.count_all().alias("votes"),
        F.count_if(F.col("vote") == "FOR").alias("votes_for"),
        F.count_if(F.col("vote") == "AGAINST").alias("votes_against"),
        F.count_if(F.col("vote") == "ABSTAIN").alias("votes_abstain"),
        F.count_if(F.col("versus_management") == "WITH").alias("with_management"),
        F.count_if(F.col("versus_management") == "AGAINST").alias("against_management"),
        F.sum("shares_voted").alias("shares_voted"),
    )
