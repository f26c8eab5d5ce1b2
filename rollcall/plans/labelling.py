"""Which way a proposal points: wordings, matching, and two independent signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import decide, numbers, text
from rollcall.operators import aggregates as A
from rollcall.operators.matching import leader_cluster

WORDING_KEYS = ["cusip", "meeting_date", "report_year", "wording_key"]


def wordings(answers: DataFrame) -> DataFrame:
    """One row per company, meeting, year and wording, with how funds voted on it."""
    themed, reference, supported = F.col("is_esg_named"), F.col("is_reference_house"), F.col("supported")
    return answers.groupBy(
        "cusip", "meeting_date", "report_year", text.wording_key("proposal_text").alias("wording_key")
    ).agg(
        A.any_answer("issuer_name").alias("company"),
        A.any_answer("proposal_text").alias("proposal_text"),
        F.bool_or("is_environment").alias("is_environment"),
        F.bool_or("is_social").alias("is_social"),
        A.count_all().alias("fund_votes"),
        F.count_if(supported).alias("fund_votes_for"),
        F.count_distinct("filer_cik").alias("filers"),
        F.count_if("voted_with_management").alias("votes_with_management"),
        F.count_if(themed).alias("esg_votes"),
        F.count_if(themed & supported).alias("esg_votes_for"),
        F.count_if(reference).alias("reference_votes"),
        F.count_if(reference & supported).alias("reference_votes_for"),
    )


def match_proposals(wordings: DataFrame, threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """Wordings of one company meeting that mean the same proposal get one proposal_id."""
    meeting = F.concat(
        F.coalesce(text.company_key("company"), F.lit("")),
        F.lit("|"),
        F.coalesce(F.col("meeting_date").cast("string"), F.lit("")),
    )
    titled = wordings.withColumn("_meeting", meeting).withColumn(
        "_words", text.word_set(text.normalise_title(F.coalesce("proposal_text", F.lit(""))))
    )
    # Most voted first; the wording and the remaining keys make the order total.
    order = [-F.col("fund_votes"), F.col("wording_key"), F.col("cusip"), F.col("report_year")]
    return leader_cluster(titled, "_meeting", "_words", order, threshold).drop("_meeting", "_words")


def proposal_groups(matched: DataFrame) -> DataFrame:
    """One row per matched proposal: its most voted wording, its votes, and both signals."""
    # One shuffle for sums and title alike: the title columns come from the top-ranked row.
    top = F.max_by(
        F.struct("company", "meeting_date", "report_year", F.col("proposal_text").alias("title")),
        F.struct("fund_votes", "wording_key", "cusip", "report_year"),
    )
    sums = (
        matched.groupBy("proposal_id")
        .agg(
            top.alias("_top"),
            A.count_all().alias("wordings"),
            *[
                F.sum(c).alias(c)
                for c in ["fund_votes", "fund_votes_for", "esg_votes", "esg_votes_for",
                          "reference_votes", "reference_votes_for"]
            ],
            F.bool_or("is_environment").alias("is_environment"),
            F.bool_or("is_social").alias("is_social"),
        )
        .select("_top.*", "*")
        .drop("_top")
    )
    texts = A.top_texts(
        matched, ["proposal_id"], "proposal_text", [-F.col("fund_votes"), F.col("wording_key")], V.WORDINGS_KEPT
    )
    groups = sums.join(texts, "proposal_id", "left")
    share = F.try_divide(F.lit(100.0) * F.col("fund_votes_for"), F.col("fund_votes"))
    reference = F.try_divide(F.lit(100.0) * F.col("reference_votes_for"), F.col("reference_votes"))
    decided = (
        groups.withColumn("pct_for", numbers.round_half_even(share, 1))
        .withColumn("reference_pct_for", numbers.round_half_even(reference, 1))
        .withColumn("by_wording", text.rule_label(F.coalesce("all_wordings", F.lit(""))))
        .withColumn("by_reference_votes", decide.threshold_label(reference, "reference_votes"))
        .withColumn("_final", decide.resolve("by_reference_votes", "by_wording"))
    )
    return decided.select("*", "_final.direction", "_final.basis").drop("_final")


def proposal_labels(matched: DataFrame, groups: DataFrame) -> DataFrame:
    """The group's direction on every wording. An empty wording stays NULL, so that it joins nothing."""
    return matched.join(groups.select("proposal_id", "direction", "basis"), "proposal_id").select(
        "cusip", "meeting_date", "report_year",
        F.nullif("wording_key", F.lit("")).alias("wording_key"),
        "proposal_id", "direction", "basis",
    )


def signal_agreement(groups: DataFrame) -> DataFrame:
    """Where both signals answer: how many proposals, and how often they agree."""
    return A.agreement(groups, "by_wording", "by_reference_votes", V.UNCLEAR, [V.SUPPORTS, V.OPPOSES])


def signal_crosstab(groups: DataFrame) -> DataFrame:
    """Both signals against each other, with totals."""
    columns = [V.TOO_FEW_VOTES, V.OPPOSES, V.SUPPORTS, V.UNCLEAR]
    return A.crosstab_margins(groups, "by_wording", "by_reference_votes", columns)


def label_shares(groups: DataFrame) -> DataFrame:
    """Proposals and votes by basis and direction."""
    return A.share_by(groups, ["basis", "direction"], "fund_votes")
