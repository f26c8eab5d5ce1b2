"""What the settling of answers makes Spark do."""

from demos.registry import Tables
from rollcall.plans import marts

VOTES = (
    "filing_id string, fund_id string, issuer_name string, cusip string, meeting_date date, proposal_text string, proposed_by string,"
    " is_environment boolean, is_social boolean, vote string, voted_with_management boolean, shares_voted double"
)
FILINGS = "filing_id string, filer_kind string, filer_cik string, filer_name string, report_year int, filed_date date"


def _qualifying(spark):
    votes = spark.createDataFrame(
        [("F1", "S1", "Acme", None, None, "Report", "shareholder", True, False, "FOR", True, 1.0),
         ("F2", "S1", "Acme", None, None, "Report", "shareholder", True, False, "FOR", True, 1.0)], VOTES)
    filings = spark.createDataFrame([("F1", "fund", "1", "House", 2024, None), ("F2", "manager", "1", "House", 2024, None)], FILINGS)
    return marts.qualifying_votes(votes, filings)


def test_keys_are_made_for_joined_votes_alone(spark):
    found = _qualifying(spark)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("Join")
    assert [(r.filing_id, r.proposal_key.split("|")[0]) for r in found.collect()] == [("F1", "ACME")]


def test_wide_stages_are_compiled_by_operator(spark):
    Tables(spark, "nowhere")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
