"""Raw filing tables derived from the given tables, and what they should turn into.

Orders stand for filings, suppliers for funds, line items for votes and parts for
proposals. The raw tables are written as untidily as filers write: many spellings,
date layouts and code styles. EXPECTED states the clean values straight from the
given columns, without cleaning any text, so a build that agrees with it has
recovered them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from rollcall.plans.build import build
from rollcall.session import durable_dir, stored

from .registry import Tables

# Orders date from 1995 to 2001; both ends of the window cut some of them off.
WINDOW = ("1995-07-01", "2001-03-31")


def _accession(key: str) -> str:
    return f"concat('A', lpad(cast({key} AS string), 10, '0')) AS accession"


ACCESSION = _accession("o_orderkey")


def _series_id(key: str) -> str:
    return f"concat(if({key} % 2 = 1, ' s', 'S'), lpad(cast({key} AS string), 9, '0')) AS series_id"


def _filings(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, t.orders["o_custkey"] == t.customer["c_custkey"], "left")


def raw_filings(t: Tables) -> DataFrame:
    return _filings(t).selectExpr(
        ACCESSION,
        "if(o_orderkey % 9 = 0, 'N-PX/A', 'N-PX') AS form_type",
        "lpad(cast(o_custkey AS string), 10, '0') AS cik",
        "concat(if(c_nationkey % 8 = 0, ' Domini House ', ' House '), c_nationkey, ' Trust ') AS company",
        "if(o_orderkey % 101 <> 0, date_format(o_orderdate, 'yyyy-MM-dd'), NULL) AS date_filed",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'XX' WHEN o_orderstatus = 'P' THEN 'IM' ELSE 'RMIC' END AS registrant_type",
        "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'FUND NOTICE REPORT' WHEN '2-HIGH' THEN 'Combination Voting Report'"
        " WHEN '5-LOW' THEN NULL ELSE 'Fund Voting Report' END AS report_type",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS period_of_report",
        "CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN concat(year(o_orderdate), '.0')"
        " ELSE cast(year(o_orderdate) AS string) END AS report_year",
        "cast(o_orderkey % 4 AS string) AS series_count",
        "'ok' AS status",
    )


def raw_series(t: Tables) -> DataFrame:
    # Lines are dealt by accession before they are made distinct, so that this, the join to the orders and the
    # build's join to the filings share one shuffle. Whole keys are compared beside it, as for the votes.
    lines = t.lineitem.selectExpr(_accession("l_orderkey"), "l_orderkey", "l_suppkey").repartition("accession").distinct()
    filed = t.orders.selectExpr(ACCESSION, "o_orderkey", "if(year(o_orderdate) < 1998, ' Old', '') AS ending")
    # What a name takes from its supplier is made once a supplier.
    named = t.supplier.selectExpr(
        "s_suppkey",
        _series_id("s_suppkey"),
        "concat(CASE s_suppkey % 6 WHEN 0 THEN 'Green   Growth ' WHEN 1 THEN ' Sustainable Income '"
        " WHEN 2 THEN 'Greenway Equity ' ELSE 'Equity ' END, s_name) AS name",
    )
    joined = lines.join(filed, "accession").filter("l_orderkey BETWEEN o_orderkey AND o_orderkey").join(
        named, lines["l_suppkey"] == named["s_suppkey"]
    )
    return joined.selectExpr("accession", "series_id", "concat(name, ending) AS series_name")


TITLE = """CASE p_type WHEN 'ECONOMY' THEN 'Report on climate transition plan'
  WHEN 'MEDIUM' THEN 'Human rights due diligence' WHEN 'LARGE' THEN 'Report on lobbying expenditure'
  WHEN 'SMALL' THEN 'Revisit plastics packaging goals' WHEN 'PROMO' THEN 'Independent chair policy'
  ELSE 'Report on risks of esg goals' END AS title"""
CATEGORIES = """CASE p_type WHEN 'ECONOMY' THEN 'ENVIRONMENT OR CLIMATE|SECTION 14A SAY-ON-PAY VOTES'
  WHEN 'MEDIUM' THEN 'HUMAN RIGHTS|DIRECTOR ELECTIONS' WHEN 'LARGE' THEN 'Corporate Governance'
  WHEN 'SMALL' THEN 'Environment or Climate' WHEN 'PROMO' THEN 'OTHER SOCIAL ISSUES'
  ELSE 'ENVIRONMENT OR CLIMATE' END AS categories"""


def _written(fmt: str) -> str:
    return f"date_format(trunc(o_orderdate, 'quarter'), '{fmt}')"


def raw_votes(t: Tables, keep: Sequence[str] = ()) -> DataFrame:
    """Line items as raw votes; ``keep`` names columns of theirs that stay beside."""
    # Titles and categories are spelled out behind the joins, as they would be most of what the joins shuffle.
    proposals = t.part.selectExpr("p_partkey", "p_type", "substring_index(p_name, ' ', 1) AS colour")
    filed = _filings(t).selectExpr(
        ACCESSION, "o_orderkey", "c_mktsegment", "substr(c_mktsegment, 1, 4) AS code",
        f"CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN {_written('M/d/yyyy')}"
        f" WHEN o_orderkey % 6 = 1 THEN {_written('MM/dd/yy')} WHEN o_orderkey % 6 = 2 THEN {_written('d-MMM-yyyy')}"
        f" WHEN o_orderkey % 6 = 3 THEN {_written('dd-MMM-yy')} WHEN o_orderkey % 6 = 4 THEN {_written('yyyyMMdd')}"
        f" ELSE {_written('MM/dd/yyyy')} END AS meeting_date",
    )
    # Parts first, while lines are narrow and those that a filter drops need not meet their orders.
    lines = t.lineitem.join(proposals, t.lineitem["l_partkey"] == proposals["p_partkey"]).selectExpr("*", _accession("l_orderkey"))
    # They meet on the accession, the key that the build joins votes to filings by, so that one shuffle serves both
    # joins. It holds ten digits, so whole keys are compared beside it: as a range, which adds no key to shuffle by.
    joined = lines.join(filed, "accession").filter("l_orderkey BETWEEN o_orderkey AND o_orderkey")
    return joined.selectExpr("*", TITLE, CATEGORIES).selectExpr(
        "accession",
        "concat(c_mktsegment, if(o_orderkey % 2 = 0, ' Holdings, Inc.', ' Inc')) AS issuer_name",
        "if(o_orderkey % 13 = 0, 'N/A', concat(' 00000', lower(code))) AS cusip",
        "concat('US000000', code) AS isin",
        "meeting_date",
        "CASE o_orderkey % 4 WHEN 1 THEN concat('Shareholder Proposal Regarding ', title)"
        " WHEN 2 THEN concat(title, ' (', l_linenumber, ')') WHEN 3 THEN concat(title, ' ', colour)"
        " ELSE title END AS vote_description",
        "categories",
        "CASE WHEN l_orderkey % 211 = 0 THEN 'Vote Source' WHEN l_linestatus = 'O' THEN 'SECURITY HOLDER'"
        " WHEN l_linenumber % 3 = 0 THEN ' Issuer ' WHEN l_linenumber % 3 = 1 THEN 'mgmt'"
        " ELSE 'Security Holder' END AS vote_source",
        "cast(cast(l_quantity AS long) AS string) AS shares_voted_total",
        "'0' AS shares_on_loan",
        "CASE l_returnflag WHEN 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN 'For' WHEN 1 THEN ' f ' ELSE 'YES' END"
        " WHEN 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'Against' WHEN 1 THEN 'a' ELSE 'No' END"
        " ELSE CASE l_linenumber WHEN 1 THEN 'withheld' WHEN 2 THEN 'With-hold' WHEN 3 THEN '1-Year' WHEN 4 THEN ''"
        " WHEN 5 THEN 'TNA' WHEN 6 THEN 'For  All' ELSE 'Abstain' END END AS how_voted",
        "CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN '1,000'"
        " WHEN l_linenumber = 6 THEN concat(cast(l_quantity AS long), '.0')"
        " ELSE cast(cast(l_quantity AS long) AS string) END AS shares_voted",
        "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'For' WHEN 1 THEN 'against' WHEN 2 THEN 'None'"
        " ELSE ' FOR ' END AS management_recommendation",
        _series_id("l_suppkey"),
        "'' AS other_info",
        *keep,
    )


def raw(t: Tables) -> dict[str, DataFrame]:
    return {"filings": raw_filings(t), "series": raw_series(t), "votes": raw_votes(t)}


def built(t: Tables) -> dict[str, DataFrame]:
    return build(raw(t), window=WINDOW)


# Line items whose votes are joined and written at a time.
LINES_A_PASS = 20_000_000


def built_in_store(t: Tables) -> dict[str, DataFrame]:
    """The same, for queries that read most of its tables: each is made and written once, and what was shuffled for it goes with the write."""
    landed = {"filings": stored(raw_filings(t)), "series": stored(raw_series(t)), "votes": raw_votes(t)}
    passes = max(1, -(-t.lineitem.count() // LINES_A_PASS))
    return build(landed, f"{durable_dir(t.spark)}/store-{uuid.uuid4().hex}", window=WINDOW, votes_by=(), passes=passes)


# The clean values ---------------------------------------------------------------

EXPECTED = f"""
WITH filings AS (
  SELECT o_orderkey AS k, 'A' || lpad(o_orderkey::varchar, 10, '0') AS filing_id,
    lpad(o_custkey::varchar, 10, '0') AS filer_cik, c_nationkey % 8 = 0 AS yardstick, c_mktsegment AS segment,
    (CASE WHEN c_nationkey % 8 = 0 THEN 'Domini House ' ELSE 'House ' END) || c_nationkey || ' Trust' AS filer_name,
    CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate::date END AS filed_date,
    CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' WHEN o_orderstatus = 'P' THEN 'manager' ELSE 'fund' END AS filer_kind,
    CASE o_orderpriority WHEN '3-MEDIUM' THEN 'notice' WHEN '2-HIGH' THEN 'combination' WHEN '5-LOW' THEN 'unknown'
      ELSE 'voting' END AS report_kind,
    CASE WHEN o_orderkey % 53 <> 0 THEN year(o_orderdate)::integer END AS report_year,
    o_orderdate::date AS period_end_date, year(o_orderdate) AS y,
    CASE WHEN o_orderkey % 41 <> 0 AND date_trunc('quarter', o_orderdate) BETWEEN date '{WINDOW[0]}' AND date '{WINDOW[1]}'
      THEN date_trunc('quarter', o_orderdate)::date END AS meeting_date
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), titles(p_type, title, core, points) AS (
  VALUES ('ECONOMY', 'Report on climate transition plan', 'E', 'supports ESG'),
    ('MEDIUM', 'Human rights due diligence', 'M', 'supports ESG'),
    ('LARGE', 'Report on lobbying expenditure', 'L', 'supports ESG'),
    ('SMALL', 'Revisit plastics packaging goals', 'S', 'opposes ESG'),
    ('PROMO', 'Independent chair policy', 'P', 'unclear'),
    ('STANDARD', 'Report on risks of esg goals', 'R', 'opposes ESG')
), votes AS MATERIALIZED (
  SELECT f.*, 'S' || lpad(l_suppkey::varchar, 9, '0') AS fund_id, l_suppkey, core, points,
    segment || (CASE WHEN k % 2 = 0 THEN ' Holdings, Inc.' ELSE ' Inc' END) AS issuer_name,
    CASE WHEN k % 13 <> 0 THEN '00000' || substr(segment, 1, 4) END AS cusip,
    CASE k % 4 WHEN 0 THEN title WHEN 1 THEN 'Shareholder Proposal Regarding ' || title
      WHEN 2 THEN title || ' (' || l_linenumber || ')' ELSE title || ' ' || split_part(p_name, ' ', 1) END AS proposal_text,
    core IN ('E', 'S', 'R') AS is_environment, core IN ('M', 'P') AS is_social,
    core = 'M' AS is_director_election, core = 'E' AS is_say_on_pay, core = 'L' AS is_governance,
    CASE WHEN l_linestatus = 'O' OR l_linenumber % 3 = 2 THEN 'shareholder' ELSE 'company' END AS proposed_by,
    CASE WHEN l_returnflag = 'N' THEN 'FOR' WHEN l_returnflag = 'A' THEN 'AGAINST'
      ELSE ['WITHHOLD', 'OTHER', '1 YEAR', 'UNKNOWN', 'NOT VOTED', 'FOR', 'ABSTAIN'][l_linenumber] END AS vote,
    ['WITH', 'AGAINST', 'NONE', 'WITH'][((l_partkey + l_linenumber) % 4 + 1)::integer] AS versus_management,
    CASE WHEN NOT (l_linenumber = 7 AND l_quantity > 40) THEN l_quantity END AS shares_voted
  FROM lineitem JOIN filings f ON f.k = l_orderkey JOIN part ON p_partkey = l_partkey JOIN titles USING (p_type)
  WHERE l_orderkey % 211 <> 0
), named AS (
  SELECT DISTINCT fund, f.*, 'S' || lpad(fund::varchar, 9, '0') AS fund_id,
    ['Green Growth', 'Sustainable Income', 'Greenway Equity', 'Equity', 'Equity', 'Equity'][(fund % 6 + 1)::integer]
      || ' ' || s_name || (CASE WHEN y < 1998 THEN ' Old' ELSE '' END) AS fund_name
  FROM (SELECT DISTINCT l_orderkey, l_suppkey AS fund FROM lineitem) JOIN filings f ON f.k = l_orderkey
    JOIN supplier ON s_suppkey = fund
), funds AS MATERIALIZED (
  SELECT fund_id, max(fund_name) FILTER (WHERE latest = 1 AND filed_date IS NOT NULL) AS fund_name,
    max(filer_name) FILTER (WHERE latest = 1 AND filed_date IS NOT NULL) AS filer_name,
    max(filer_cik) FILTER (WHERE latest = 1 AND filed_date IS NOT NULL) AS filer_cik,
    count(DISTINCT fund_name) AS names_used, min(report_year) AS first_report_year, max(report_year) AS last_report_year,
    CASE WHEN bool_or(latest = 1 AND filed_date IS NOT NULL) THEN any_value(fund) % 6 < 2 END AS is_esg_named
  FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY filed_date DESC NULLS LAST, filer_cik DESC,
      fund_name DESC, filer_name DESC) AS latest FROM named) GROUP BY fund_id
), wanted AS (
  SELECT *, coalesce(cusip, upper(issuer_name)) || '|' || coalesce(meeting_date::varchar, '') || '|'
      || md5(regexp_replace(lower(proposal_text), '[^a-z0-9]', '', 'g')) AS proposal_key,
    regexp_replace(lower(proposal_text), '[^a-z0-9 ]', '', 'g') AS wording_key,
    dense_rank() OVER (PARTITION BY filer_cik, report_year, fund_id ORDER BY filed_date DESC, filing_id DESC) AS age
  FROM votes WHERE filer_kind = 'fund' AND report_year IS NOT NULL AND proposed_by = 'shareholder'
    AND (is_environment OR is_social) AND vote IN ('FOR', 'AGAINST', 'ABSTAIN', 'WITHHOLD') AND filed_date IS NOT NULL
), settled AS (
  SELECT *, row_number() OVER (PARTITION BY filing_id, fund_id, proposal_key
      ORDER BY coalesce(shares_voted, 0) DESC, vote DESC) AS place,
    min(proposal_text) OVER (PARTITION BY filing_id, fund_id, proposal_key) AS text_shown,
    bool_or(CASE versus_management WHEN 'WITH' THEN true WHEN 'AGAINST' THEN false END)
      OVER (PARTITION BY filing_id, fund_id, proposal_key) AS with_management
  FROM wanted WHERE age = 1
), answers AS MATERIALIZED (
  SELECT s.* REPLACE (text_shown AS proposal_text), s.vote = 'FOR' AS supported, d.fund_name,
    coalesce(d.is_esg_named, false) AS is_esg_named
  FROM settled s LEFT JOIN funds d USING (fund_id) WHERE place = 1
), wordings AS MATERIALIZED (
  SELECT cusip, meeting_date, report_year, wording_key, min(issuer_name) AS company, min(proposal_text) AS proposal_text,
    any_value(core) AS core, any_value(points) AS points,
    bool_or(is_environment) AS is_environment, bool_or(is_social) AS is_social,
    count(*) AS fund_votes, sum(supported::integer)::bigint AS fund_votes_for, count(DISTINCT filer_cik) AS filers,
    sum(coalesce(with_management, false)::integer)::bigint AS votes_with_management,
    sum(is_esg_named::integer)::bigint AS esg_votes, sum((is_esg_named AND supported)::integer)::bigint AS esg_votes_for,
    sum(yardstick::integer)::bigint AS reference_votes, sum((yardstick AND supported)::integer)::bigint AS reference_votes_for
  FROM answers GROUP BY ALL
), ranked AS (
  SELECT *, lower(split_part(company, ' ', 1)) || '|' || coalesce(meeting_date::varchar, '') AS meeting,
    row_number() OVER (PARTITION BY lower(split_part(company, ' ', 1)), meeting_date
      ORDER BY fund_votes DESC, wording_key, cusip NULLS FIRST, report_year) AS place
  FROM wordings
), leaders AS (
  SELECT meeting, core, row_number() OVER (PARTITION BY meeting ORDER BY min(place)) AS n
  FROM ranked GROUP BY meeting, core
), matched AS MATERIALIZED (
  SELECT r.*, meeting || '|' || n AS proposal_id FROM ranked r JOIN leaders USING (meeting, core)
), sums AS (
  SELECT proposal_id, any_value(points) AS by_wording, count(*) AS wordings, sum(fund_votes)::bigint AS fund_votes,
    sum(fund_votes_for)::bigint AS fund_votes_for, sum(reference_votes)::bigint AS reference_votes,
    sum(reference_votes_for)::bigint AS reference_votes_for,
    round_even(100.0::double * sum(fund_votes_for) / sum(fund_votes) * 10, 0) / 10 AS pct_for,
    round_even(100.0::double * sum(reference_votes_for) / nullif(sum(reference_votes), 0) * 10, 0) / 10 AS reference_pct_for
  FROM matched GROUP BY proposal_id
), groups AS MATERIALIZED (
  SELECT *, CASE WHEN reference_votes < 3 THEN 'not enough votes' WHEN reference_pct_for >= 60 THEN 'supports ESG'
      WHEN reference_pct_for <= 15 THEN 'opposes ESG' ELSE 'unclear' END AS by_reference_votes,
    CASE WHEN reference_votes < 3 THEN by_wording WHEN reference_pct_for >= 60 THEN 'supports ESG'
      WHEN reference_pct_for <= 15 THEN 'opposes ESG' ELSE 'split' END AS direction,
    CASE WHEN reference_votes < 3 THEN 'wording only' ELSE 'reference votes' END AS basis
  FROM sums
), fact AS MATERIALIZED (
  SELECT a.*, g.proposal_id AS matched_proposal_id, g.direction, g.basis AS direction_basis
  FROM answers a JOIN matched m ON m.cusip IS NOT DISTINCT FROM a.cusip
    AND m.meeting_date IS NOT DISTINCT FROM a.meeting_date AND m.report_year = a.report_year
    AND m.wording_key = regexp_replace(lower(a.proposal_text), '[^a-z0-9 ]', '', 'g') JOIN groups g USING (proposal_id)
), siblings AS MATERIALIZED (
  SELECT filing_id, proposal_key, min(filer_name) AS filer_name, min(report_year) AS report_year,
    min(direction) AS direction, min(direction_basis) AS direction_basis,
    sum(is_esg_named::integer)::bigint AS esg_funds, sum((NOT is_esg_named)::integer)::bigint AS other_funds,
    avg(CASE WHEN is_esg_named THEN supported::integer END) AS esg_support,
    avg(CASE WHEN NOT is_esg_named THEN supported::integer END) AS other_support
  FROM fact WHERE NOT yardstick GROUP BY filing_id, proposal_key
  HAVING bool_or(is_esg_named) AND bool_or(NOT is_esg_named)
), compared AS (
  SELECT *, esg_support - other_support AS support_gap,
    CASE WHEN (esg_support >= 0.5) = (other_support >= 0.5) THEN 'same as siblings'
      WHEN esg_support > other_support THEN 'ESG fund more supportive' ELSE 'ESG fund less supportive' END AS outcome
  FROM siblings
), topics AS MATERIALIZED (
  SELECT fund_id, report_year, CASE core WHEN 'M' THEN 'Social' WHEN 'P' THEN 'Social' WHEN 'L' THEN 'Governance'
      ELSE 'Environment' END AS topic, proposed_by, count(*) AS votes,
    count(*) FILTER (WHERE vote = 'FOR') AS votes_for, count(*) FILTER (WHERE vote = 'AGAINST') AS votes_against,
    count(*) FILTER (WHERE vote = 'ABSTAIN') AS votes_abstain,
    count(*) FILTER (WHERE versus_management = 'WITH') AS with_management,
    count(*) FILTER (WHERE versus_management = 'AGAINST') AS against_management, sum(shares_voted) AS shares_voted
  FROM votes WHERE filer_kind = 'fund' AND report_year IS NOT NULL GROUP BY ALL
)
"""


def expected(select: str) -> str:
    """SQL for a selection from the expected tables."""
    return EXPECTED + select.strip()


def half_up(value: str, digits: int) -> str:
    """SQL that rounds a non-negative double the way the library does."""
    scale = 10**digits
    return f"floor(({value}) * {scale} + 0.5) / {scale}"


def pct(part: str, whole: str, digits: int) -> str:
    """SQL for a rounded percent, NULL for an empty whole."""
    return half_up(f"100.0::double * ({part}) / nullif({whole}, 0)", digits)
