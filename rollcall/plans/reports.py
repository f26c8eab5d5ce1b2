"""Reports: trends, scorecards, exports and profiles. Each function returns one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import numbers
from rollcall.operators import aggregates as A
from rollcall.operators import checks as K
from rollcall.operators import joins as J
from rollcall.operators import profile as P
from rollcall.operators import ranking as R

from .marts import quality_summary


def _last(*cols: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in cols]


def _mean_pct(col: str, digits: int) -> Column:
    return numbers.round_half_up(100 * F.avg(col), digits)


def _backed(fact: DataFrame) -> DataFrame:
    """Rows on proposals that the reference votes back."""
    return fact.filter((F.col("direction") == V.SUPPORTS) & (F.col("direction_basis") == V.BY_REFERENCE))


# Reporting models --------------------------------------------------------------


def topic_trends(fund_year_topic: DataFrame) -> DataFrame:
    """Votes, support and agreement with management by year, topic and proposer."""
    return fund_year_topic.groupBy("report_year", "topic", "proposed_by").agg(
        F.count_distinct("fund_id").alias("funds"),
        F.sum("votes").alias("votes"),
        numbers.percent(F.sum("votes_for"), F.sum("votes"), 2).alias("pct_for"),
        _with_management(),
    )


def _with_management() -> Column:
    agreed, opposed = F.sum("with_management"), F.sum("against_management")
    return numbers.percent(agreed, agreed + opposed, 2).alias("pct_with_management")


def fund_scorecard(funds: DataFrame, fund_year_topic: DataFrame, fact: DataFrame) -> DataFrame:
    """One row per fund: agreement with management, and support for backed proposals where it voted often enough."""
    overall = fund_year_topic.groupBy("fund_id").agg(F.sum("votes").alias("votes"), _with_management())
    backed = (
        _backed(fact)
        .filter(~F.col("is_reference_house"))
        .groupBy("fund_id")
        .agg(
            A.count_all().alias("es_votes_on_pro_esg"),
            numbers.percent(F.count_if("supported"), A.count_all(), 2).alias("_pct"),
        )
    )
    card = funds.select("fund_id", "fund_name", F.col("filer_name").alias("fund_house"), "is_esg_named")
    enough = numbers.suppress("_pct", "es_votes_on_pro_esg", V.MIN_SCORECARD_VOTES)
    return J.attach(card, [overall, backed], "fund_id").withColumn("pct_backing_pro_esg", enough).drop("_pct")


def house_gap(fact: DataFrame, min_votes: int = V.MIN_SCORECARD_VOTES) -> DataFrame:
    """Per house and year: themed funds against the rest, where both sides voted often enough."""
    themed, supported = F.col("is_esg_named"), F.col("supported")
    sides = (
        _backed(fact)
        .filter(~F.col("is_reference_house"))
        .groupBy(F.col("filer_name").alias("fund_house"), "report_year")
        .agg(
            F.count_if(themed).alias("esg_named_votes"),
            F.count_if(~themed).alias("other_votes"),
            numbers.percent(F.count_if(themed & supported), F.count_if(themed), 2).alias("pct_esg_named_for"),
            numbers.percent(F.count_if(~themed & supported), F.count_if(~themed), 2).alias("pct_other_for"),
        )
    )
    enough = sides.filter((F.col("esg_named_votes") >= min_votes) & (F.col("other_votes") >= min_votes))
    return enough.withColumn(
        "gap_points", numbers.round_half_up(F.col("pct_esg_named_for") - F.col("pct_other_for"), 2)
    )


def publish_status(audit: DataFrame) -> DataFrame:
    """The latest publish, one row per table."""
    return R.latest_batch(audit, "published_at")


# Result tables -----------------------------------------------------------------


def label_coverage(fact: DataFrame) -> DataFrame:
    """Fund votes and proposals by direction and basis."""
    return (
        fact.groupBy("direction", "direction_basis")
        .agg(A.count_all().alias("fund_votes"), F.count_distinct("matched_proposal_id").alias("proposals"))
        .orderBy(F.desc("fund_votes"), "direction", "direction_basis")
    )


def _sibling_columns(digits: int, outcomes) -> list[Column]:
    names = dict(zip(V.SIBLING_OUTCOMES, ["pct_same", "pct_esg_more", "pct_esg_less"]))
    return [
        A.count_all().alias("proposals_compared"),
        _mean_pct("esg_support", digits).alias("esg_pct_for"),
        _mean_pct("other_support", digits).alias("siblings_pct_for"),
        *[
            numbers.percent(F.count_if(F.col("outcome") == o), A.count_all(), digits).alias(names[o])
            for o in outcomes
        ],
    ]


def sibling_by_year(siblings: DataFrame, keys=("direction", "direction_basis", "report_year")) -> DataFrame:
    """How themed funds and their siblings compare, per direction and year."""
    return siblings.groupBy(*keys).agg(*_sibling_columns(2, V.SIBLING_OUTCOMES)).orderBy(*_last(*keys))


def sibling_by_house(siblings: DataFrame, min_n: int = 30) -> DataFrame:
    """The same per house, on backed proposals."""
    houses = _backed(siblings).groupBy("filer_name").agg(*_sibling_columns(1, V.SIBLING_OUTCOMES[:1]))
    return A.having(houses, min_n, "proposals_compared").orderBy(F.desc("proposals_compared"), "filer_name")


def themed_fund_support(fact: DataFrame, min_n: int, with_id: bool = True) -> DataFrame:
    """Support of each themed fund outside the reference houses on backed proposals; unordered."""
    keys = [*(["fund_id"] if with_id else []), "fund_name", "filer_name"]
    rates = (
        _backed(fact)
        .filter(F.col("is_esg_named") & ~F.col("is_reference_house"))
        .groupBy(*keys)
        .agg(
            A.count_all().alias("votes"),
            numbers.percent(F.count_if("supported"), A.count_all(), 1).alias("pct_for"),
        )
    )
    return A.having(rates, min_n)


def extreme_support(by_fund: DataFrame, lowest: bool, k: int = 25) -> DataFrame:
    """The funds with the lowest or highest support, those with more votes first."""
    by = F.asc_nulls_last("pct_for") if lowest else F.desc("pct_for")
    return R.top_k(by_fund, [by, F.desc("votes"), *_last("fund_name", "filer_name")], k)


def support_bands(fact: DataFrame, min_n: int = 20) -> DataFrame:
    """How many themed funds fall into each band of support."""
    per_fund = (
        _backed(fact)
        .filter(F.col("is_esg_named") & ~F.col("is_reference_house"))
        .groupBy("fund_id")
        .agg(A.count_all().alias("votes"), numbers.rate("supported").alias("s"))
    )
    bands = numbers.band("s", V.SUPPORT_BANDS).alias("support_band")
    return A.having(per_fund, min_n).groupBy(bands).agg(A.count_all().alias("funds")).orderBy("support_band")


def votes_by_year_and_kind(votes: DataFrame) -> DataFrame:
    return (
        votes.groupBy("report_year", "filer_kind")
        .agg(A.count_all().alias("votes"))
        .orderBy(*_last("report_year", "filer_kind"))
    )


def results(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The eight result tables that are exported."""
    fact, siblings = tables["fund_es_votes"], tables["sibling_comparison"]
    return {
        "data_quality_summary": tables["quality_summary"],
        "votes_by_year_and_filer_kind": votes_by_year_and_kind(tables["votes"]),
        "vote_values": A.value_counts(tables["votes"], "vote", name="votes"),
        "label_coverage": label_coverage(fact),
        "support_by_direction": tables["support_by_direction"],
        "sibling_comparison_by_year": sibling_by_year(siblings),
        "sibling_comparison_by_house": sibling_by_house(siblings),
        "esg_named_fund_support": themed_fund_support(fact, 20).orderBy(
            F.asc_nulls_last("pct_for"), F.desc("votes"), "fund_id"
        ),
    }


def esg_report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The eight sections of the report on themed funds."""
    fact, siblings, support = (
        tables["fund_es_votes"], tables["sibling_comparison"], tables["support_by_direction"],
    )
    by_fund = themed_fund_support(fact, 40, with_id=False)
    headline = ["report_year", "direction", "fund_group", "funds", "votes", "pct_for_all_votes"]
    headline_order = _last("direction", "report_year", "fund_group")
    labelled = A.share_of_total(label_coverage(fact), "fund_votes", "pct_of_votes")
    return {
        "labelled_votes": labelled.orderBy(F.desc("fund_votes")),
        "headline": support.filter(F.col("direction_basis") == V.BY_REFERENCE)
        .select(*headline, "pct_for_average_fund").orderBy(*headline_order),
        "headline_by_wording": support.filter(F.col("direction_basis") == V.BY_WORDING)
        .select(*headline).orderBy(*headline_order),
        "siblings_by_direction": sibling_by_year(
            siblings.filter(F.col("direction_basis") == V.BY_REFERENCE), ("direction", "report_year")
        ),
        "siblings_by_house": sibling_by_house(siblings).limit(40),
        "lowest_support": extreme_support(by_fund, lowest=True),
        "highest_support": extreme_support(by_fund, lowest=False),
        "support_bands": support_bands(fact),
    }


def quality_report(votes: DataFrame) -> dict[str, DataFrame]:
    """Headline row, answers, the most frequent unrecognised texts, and votes by year and kind."""
    unknown = votes.filter(F.col("vote") == V.ANSWER_OTHER)
    return {
        "headline": quality_summary(votes),
        "vote_values": A.value_counts(votes, "vote", name="votes"),
        "unrecognised": A.value_counts(unknown, "vote_as_filed", name="votes").limit(25),
        "by_year_and_kind": votes_by_year_and_kind(votes),
    }


# Chart data --------------------------------------------------------------------


def house_gap_chart(by_house: DataFrame, k: int = 20) -> DataFrame:
    """The houses with most comparisons, in the order of their gap."""
    gap = F.col("esg_pct_for") - F.col("siblings_pct_for")
    return R.top_k_then(by_house, [F.desc("proposals_compared"), F.col("filer_name")], k, "gap", gap)


def house_gap_page(by_house: DataFrame, min_n: int = 50) -> DataFrame:
    """Every house with enough comparisons, largest gap first."""
    gap = F.col("esg_pct_for") - F.col("siblings_pct_for")
    return A.having(by_house, min_n, "proposals_compared").withColumn("gap", gap).orderBy(F.desc("gap"), "filer_name")


def headline_chart(support: DataFrame) -> DataFrame:
    """Support per fund group and year on backed proposals."""
    return _backed(support).select("fund_group", "report_year", "pct_for_all_votes").orderBy("fund_group", "report_year")


def histogram(rates: DataFrame, pct: str = "pct_for", bins: int = 20) -> DataFrame:
    """How many rows fall into each equal bin of a percent."""
    return rates.groupBy(numbers.equal_bins(pct, bins).alias("bin")).agg(A.count_all().alias("n")).orderBy("bin")


# Raw profile -------------------------------------------------------------------

BLANK_MARKS_BY_COLUMN = {
    "issuer_name": [""], "cusip": V.BLANK_MARKS, "isin": V.BLANK_MARKS, "meeting_date": [""],
    "vote_description": [""], "categories": [""], "how_voted": [""],
    "management_recommendation": [""], "series_id": [""],
}
BLANK_REPORT_NAMES = {"vote_description": "description", "management_recommendation": "mgmt_rec"}


def _top(df: DataFrame, *cols: str, name: str = "votes", k: int | None = None) -> DataFrame:
    counts = A.value_counts(df, *cols, name=name)
    return counts if k is None else counts.limit(k)


def raw_profile(
    filings: DataFrame, series: DataFrame, votes: DataFrame, seed: int = 42, key: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """The seventeen sections of the profile of the raw tables.

    ``key`` names columns of the votes that tell rows apart: they draw the random rows, and are shown with them.
    """
    parents = filings.select("accession", "registrant_type", "company", "report_year")
    # Counts per filing first: the vote table meets its filings as one row per filing.
    per_filing = votes.groupBy("accession").agg(A.count_all().alias("votes")).join(parents, "accession", "left")
    themed = F.lower("series_name").rlike(V.THEME_WORDS_LOOSE)
    fund_votes = votes.join(filings.filter(F.col("registrant_type") == "RMIC").select("accession"), "accession")
    coverage = J.match_coverage(
        fund_votes, series, ["accession", "series_id"], F.coalesce("series_id", F.lit("")) != ""
    ).toDF("fund_votes", "with_series_id", "with_matching_name")
    topical = votes.filter(F.col("categories").ilike("%ENVIRONMENT%") | F.col("categories").ilike("%SOCIAL%"))
    blanks = A.blank_rates(votes, BLANK_MARKS_BY_COLUMN).withColumnsRenamed(BLANK_REPORT_NAMES)
    return {
        "row_counts": A.labelled_counts(
            {
                "filings": filings, "fund names": series, "votes": votes,
                "filings that have votes": votes.filter(F.col("accession").isNotNull()).select("accession").distinct(),
            }
        ),
        "filings_by_form": _top(filings, "form_type", "registrant_type", "report_type", name="filings"),
        "filings_by_status": _top(filings, "status", name="filings"),
        "filings_by_year": _top(filings, "report_year", name="filings", k=12),
        "votes_by_filer_type": per_filing.groupBy("registrant_type")
        .agg(F.sum("votes").alias("votes"), F.count("accession").alias("filings"))
        .orderBy(F.desc("votes"), F.asc_nulls_last("registrant_type")),
        "votes_by_category": _top(votes, "categories", k=40),
        "answer_spellings": _top(votes, "how_voted", k=40),
        "recommendation_spellings": _top(votes, "management_recommendation", k=30),
        "proposers": _top(votes, "vote_source", k=10),
        "blank_rates": blanks,
        "date_shapes": P.shape_profile(votes, "meeting_date", 12),
        "largest_filings": per_filing.groupBy("company", "registrant_type", "report_year")
        .agg(F.sum("votes").alias("votes"))
        .orderBy(F.desc("votes"), *_last("company", "report_year", "registrant_type"))
        .limit(25),
        "themed_names": series.agg(
            A.count_all().alias("fund_rows"),
            F.count_distinct("series_id").alias("distinct_funds"),
            numbers.count_distinct_where("series_id", themed).alias("esg_named_funds"),
        ),
        "themed_examples": R.distinct_top(series.filter(themed), "series_name", 40),
        "series_coverage": coverage,
        "topical_sample": R.sample_rows(
            topical.select(
                "issuer_name", "vote_source", "how_voted", "management_recommendation",
                F.left("vote_description", F.lit(150)).alias("description"), *key,
            ),
            15, seed, key,
        ),
        "random_rows": R.sample_rows(
            votes.select(
                "issuer_name", "cusip", "meeting_date", F.left("vote_description", F.lit(90)).alias("description"),
                "categories", "how_voted", "management_recommendation", "series_id", *key,
            ),
            12, seed, key,
        ),
    }


# Checks ------------------------------------------------------------------------


def declared_rules() -> dict[str, K.Rule]:
    """Every declared rule on the built tables."""
    return {
        "filings.filing_id unique": K.rule_unique("filings", "filing_id"),
        "filings.filing_id not null": K.rule_not_null("filings", "filing_id"),
        "filings.filer_kind accepted": K.rule_accepted("filings", "filer_kind", ["fund", "manager", "unknown"]),
        "filings.report_kind accepted": K.rule_accepted("filings", "report_kind", ["voting", "notice", "combination", "unknown"]),
        "series.filing_id not null": K.rule_not_null("series", "filing_id"),
        "series.filing_id has filing": K.rule_relationship("series", "filing_id", "filings", "filing_id"),
        "series.fund_id not null": K.rule_not_null("series", "fund_id"),
        "votes.filing_id not null": K.rule_not_null("votes", "filing_id"),
        "votes.vote accepted": K.rule_accepted("votes", "vote", V.STANDARD_ANSWERS),
        "votes.versus_management accepted": K.rule_accepted("votes", "versus_management", ["WITH", "AGAINST", "NONE"]),
        "votes.proposed_by accepted": K.rule_accepted("votes", "proposed_by", ["company", "shareholder", "unknown"]),
        "quality.unrecognised at most 1%": K.rule_at_most("quality_summary", "pct_vote_unrecognised", V.MAX_UNRECOGNISED_PCT),
        "funds.fund_id unique": K.rule_unique("funds", "fund_id"),
        "funds.fund_id not null": K.rule_not_null("funds", "fund_id"),
        "funds.is_esg_named not null": K.rule_not_null("funds", "is_esg_named"),
        "fact.grain": K.rule_grain("fund_es_votes", ["filing_id", "fund_id", "proposal_key"]),
        "fact.vote accepted": K.rule_accepted("fund_es_votes", "vote", V.DECIDED_ANSWERS),
        "siblings.outcome accepted": K.rule_accepted("sibling_comparison", "outcome", V.SIBLING_OUTCOMES),
        "labels.proposal_id not null": K.rule_not_null("proposal_labels", "proposal_id"),
        "labels.direction accepted": K.rule_accepted("proposal_labels", "direction", [V.SUPPORTS, V.OPPOSES, V.SPLIT, V.UNCLEAR]),
        "labels.basis accepted": K.rule_accepted("proposal_labels", "basis", [V.BY_REFERENCE, V.BY_WORDING]),
        "trends.grain": K.rule_grain("topic_trends", ["report_year", "topic", "proposed_by"]),
        "trends.pct_for in range": K.rule_between("topic_trends", "pct_for", 0, 100),
        "trends.pct_with_management in range": K.rule_between("topic_trends", "pct_with_management", 0, 100),
        "scorecard.fund_id unique": K.rule_unique("fund_scorecard", "fund_id"),
        "scorecard.fund_id not null": K.rule_not_null("fund_scorecard", "fund_id"),
        "scorecard.pct_backing_pro_esg in range": K.rule_between("fund_scorecard", "pct_backing_pro_esg", 0, 100),
        "gap.grain": K.rule_grain("house_gap", ["fund_house", "report_year"]),
        "gap.gap_points in range": K.rule_between("house_gap", "gap_points", -100, 100),
        "scorecard matches its sources": K.rule_balance(
            lambda t: scorecard_matches(t["fund_scorecard"], t["funds"], t["fund_year_topic"]),
            ("fund_scorecard", {"part": "funds", "left": 1}),
            ("funds", {"part": "funds", "right": 1, "parent": True}),
            ("fund_scorecard", {"part": "votes", "left": "votes"}),
            ("fund_year_topic", {"part": "votes", "key": ["fund_id"], "right": "votes"}),
            ("funds", {"part": "votes", "key": ["fund_id"], "parent": True, "when": lambda: F.col("fund_id").isNotNull()}),
        ),
    }


def declared_checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that break each declared rule. :func:`checks.run_rules` counts them all in one scan of each table."""
    return {name: rule.violations(t) for name, rule in declared_rules().items()}


def publish_checks(audit: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Rules on the publish audit: the latest publish is complete and recent enough."""
    return {
        "publish.status accepted": K.accepted_values(publish_status(audit), "status", ["ok"]),
        "publish is fresh": K.fresh(audit, "published_at", V.MAX_PUBLISH_AGE_DAYS, now),
    }


def scorecard_matches(scorecard: DataFrame, funds: DataFrame, fund_year_topic: DataFrame) -> DataFrame:
    """The scorecard must carry every fund, and every vote of those funds."""
    known = J.semi(fund_year_topic, funds, "fund_id")
    return K.reconcile(
        {
            "funds": (scorecard.agg(A.count_all()), funds.agg(A.count_all())),
            "votes": (scorecard.agg(F.sum("votes")), known.agg(F.sum("votes"))),
        }
    )
