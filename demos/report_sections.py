"""The remaining sections of the raw profile, the report on themed funds, and the chart data."""

from __future__ import annotations

from rollcall.plans import reports

from . import builds
from .builds import RAW_YEAR, SUPPORT_SQL, _profile
from .filings_analogue import expected, half_up, pct
from .registry import query

RAW_LINES = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"


def top(value: str, name: str, k: int) -> str:
    """SQL for the most frequent raw values of the vote table."""
    return f"SELECT {value} AS {name}, count(*) AS votes {RAW_LINES} GROUP BY 1 ORDER BY votes DESC, {name} NULLS LAST LIMIT {k}"


@query("SELECT 'ok' AS status, count(*) AS filings FROM orders")
def filings_by_status(t):
    return _profile(t, "filings_by_status")


@query(expected(f"SELECT {RAW_YEAR} AS report_year, count(*) AS filings FROM filings GROUP BY 1 ORDER BY filings DESC, report_year LIMIT 12"))
def filings_by_year(t):
    return _profile(t, "filings_by_year")


@query(top("""CASE p_type WHEN 'ECONOMY' THEN 'ENVIRONMENT OR CLIMATE|SECTION 14A SAY-ON-PAY VOTES'
  WHEN 'MEDIUM' THEN 'HUMAN RIGHTS|DIRECTOR ELECTIONS' WHEN 'LARGE' THEN 'Corporate Governance'
  WHEN 'SMALL' THEN 'Environment or Climate' WHEN 'PROMO' THEN 'OTHER SOCIAL ISSUES' ELSE 'ENVIRONMENT OR CLIMATE' END""", "categories", 40))
def votes_by_category(t):
    return _profile(t, "votes_by_category")


@query(top("""CASE l_returnflag WHEN 'N' THEN ['For', ' f ', 'YES'][(l_linenumber % 3 + 1)::integer]
  WHEN 'A' THEN ['Against', 'a', 'No'][(l_linenumber % 3 + 1)::integer]
  ELSE ['withheld', 'With-hold', '1-Year', '', 'TNA', 'For  All', 'Abstain'][l_linenumber] END""", "how_voted", 40))
def answer_spellings(t):
    return _profile(t, "answer_spellings")


@query(top("['For', 'against', 'None', ' FOR '][((l_partkey + l_linenumber) % 4 + 1)::integer]", "management_recommendation", 30))
def recommendation_spellings(t):
    return _profile(t, "recommendation_spellings")


@query(top("""CASE WHEN l_orderkey % 211 = 0 THEN 'Vote Source' WHEN l_linestatus = 'O' THEN 'SECURITY HOLDER'
  WHEN l_linenumber % 3 = 0 THEN ' Issuer ' WHEN l_linenumber % 3 = 1 THEN 'mgmt' ELSE 'Security Holder' END""", "vote_source", 10))
def proposers(t):
    return _profile(t, "proposers")


HEADLINE = "report_year, direction, fund_group, funds, votes, pct_for_all_votes"


@query(f"SELECT {HEADLINE}, pct_for_average_fund FROM ({SUPPORT_SQL}) WHERE direction_basis = 'reference votes'")
def headline(t):
    return reports.esg_report(builds.built(t))["headline"]


@query(f"SELECT {HEADLINE} FROM ({SUPPORT_SQL}) WHERE direction_basis = 'wording only'")
def headline_by_wording(t):
    return reports.esg_report(builds.built(t))["headline_by_wording"]


@query(expected(f"""
SELECT direction, report_year, count(*) AS proposals_compared,
  {half_up("100 * avg(esg_support)", 2)} AS esg_pct_for, {half_up("100 * avg(other_support)", 2)} AS siblings_pct_for,
  {pct("count(*) FILTER (WHERE outcome = 'same as siblings')", "count(*)", 2)} AS pct_same,
  {pct("count(*) FILTER (WHERE outcome = 'ESG fund more supportive')", "count(*)", 2)} AS pct_esg_more,
  {pct("count(*) FILTER (WHERE outcome = 'ESG fund less supportive')", "count(*)", 2)} AS pct_esg_less
FROM compared WHERE direction_basis = 'reference votes' GROUP BY 1, 2"""))
def siblings_by_direction(t):
    return reports.esg_report(builds.built(t))["siblings_by_direction"]


@query(f"""
SELECT fund_group, report_year, pct_for_all_votes FROM ({SUPPORT_SQL})
WHERE direction = 'supports ESG' AND direction_basis = 'reference votes'""")
def headline_chart(t):
    return reports.headline_chart(builds.built(t)["support_by_direction"])


# With a minimum of one comparison, so that more houses qualify than the chart shows.
HOUSES = f"""
SELECT filer_name, count(*) AS proposals_compared, {half_up("100 * avg(esg_support)", 1)} AS esg_pct_for,
  {half_up("100 * avg(other_support)", 1)} AS siblings_pct_for,
  {pct("count(*) FILTER (WHERE outcome = 'same as siblings')", "count(*)", 1)} AS pct_same
FROM compared WHERE direction = 'supports ESG' AND direction_basis = 'reference votes' GROUP BY filer_name"""


@query(expected(f"SELECT *, esg_pct_for - siblings_pct_for AS gap FROM ({HOUSES})"))
def house_gap_page(t):
    return reports.house_gap_page(reports.sibling_by_house(builds.built(t)["sibling_comparison"], 1), 1)


@query(expected(f"SELECT *, esg_pct_for - siblings_pct_for AS gap FROM ({HOUSES} ORDER BY proposals_compared DESC, filer_name LIMIT 5)"))
def house_gap_top5(t):
    return reports.house_gap_chart(reports.sibling_by_house(builds.built(t)["sibling_comparison"], 1), 5)
