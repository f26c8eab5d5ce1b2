"""Raw text tables to typed, cleaned ones. Lazy: nothing is read until a mart asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import dates, decide, numbers, text


def filings(raw: DataFrame) -> DataFrame:
    """One row per filing."""
    return raw.select(
        F.col("accession").alias("filing_id"),
        "form_type",
        (F.col("form_type") == V.AMENDMENT_FORM).alias("is_amendment"),
        F.col("cik").alias("filer_cik"),
        text.trim("company").alias("filer_name"),
        dates.safe_date("date_filed").alias("filed_date"),
        decide.decode("registrant_type", V.FILER_KINDS, "unknown").alias("filer_kind"),
        decide.first_match("report_type", V.REPORT_KINDS, "unknown").alias("report_kind"),
        numbers.safe_int("report_year").alias("report_year"),
        dates.parse_date("period_of_report", V.PERIOD_FORMAT).alias("period_end_date"),
        numbers.safe_int("series_count").alias("series_count"),
        F.col("status").alias("download_status"),
    )


def series(raw: DataFrame) -> DataFrame:
    """One row per fund named on a filing."""
    fund_id = text.trim("series_id")
    return raw.filter(F.coalesce(fund_id, F.lit("")) != "").select(
        F.col("accession").alias("filing_id"),
        F.upper(fund_id).alias("fund_id"),
        text.trim(text.squeeze("series_name")).alias("fund_name"),
    )


def drop_headings(df: DataFrame, headings=None) -> DataFrame:
    """Rows that repeat the column headings inside the data go; matching is exact but for case."""
    for column, known in (headings or V.HEADINGS).items():
        df = df.filter(~F.upper(F.coalesce(F.col(column), F.lit(""))).isin(list(known)))
    return df


def clean_votes(raw: DataFrame, window: tuple[str, str] = V.MEETING_WINDOW) -> DataFrame:
    """One row per vote record, with standard answers, dates, identifiers and topics."""
    # Three steps, so that what later expressions use several times is computed once.
    trimmed = drop_headings(raw).select(
        F.col("accession").alias("filing_id"),
        F.upper(text.trim("series_id")).alias("fund_id"),
        text.trim("issuer_name").alias("issuer_name"),
        text.trim("cusip").alias("cusip"),
        text.trim("isin").alias("isin"),
        text.trim("meeting_date").alias("meeting_date"),
        text.trim("vote_description").alias("proposal_text"),
        F.upper(F.coalesce("categories", F.lit(""))).alias("categories"),
        F.upper(text.trim(F.coalesce("vote_source", F.lit("")))).alias("_source"),
        text.upper_key("how_voted").alias("vote_as_filed"),
        text.upper_key("management_recommendation").alias("_rec"),
        "shares_voted",
        "shares_on_loan",
    )
    parsed = trimmed.select(
        "*",
        dates.parse_date_any("meeting_date").alias("_day"),
        decide.standardise("_rec", V.VERSUS_MANAGEMENT, other="NONE").alias("versus_management"),
    )
    return parsed.select(
        "filing_id",
        F.when(F.col("fund_id") != "", F.col("fund_id")).alias("fund_id"),
        "issuer_name",
        text.sized_code("cusip", 9).alias("cusip"),
        text.sized_code("isin", 12).alias("isin"),
        dates.clamp_date("_day", *window).alias("meeting_date"),
        "proposal_text",
        "categories",
        *[text.has_any("categories", words).alias(flag) for flag, words in V.TOPIC_FLAGS.items()],
        decide.standardise("_source", V.PROPOSERS, other="unknown").alias("proposed_by"),
        decide.standardise("vote_as_filed", V.ANSWERS, V.ANSWER_OTHER, V.ANSWER_BLANK).alias("vote"),
        "versus_management",
        decide.word_to_bool("versus_management", "WITH", "AGAINST").alias("voted_with_management"),
        numbers.safe_double("shares_voted").alias("shares_voted"),
        numbers.safe_double("shares_on_loan").alias("shares_on_loan"),
        "vote_as_filed",
    )
