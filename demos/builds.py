"""The build and its reports, on raw tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.operators import aggregates as A
from rollcall.operators import checks as K
from rollcall.operators import profile as P
from rollcall.operators import ranking as R
from rollcall.plans import labelling, marts, reports, staging

from .filings_analogue import WINDOW, built, built_in_store, expected, half_up, pct, raw, raw_filings, raw_series, raw_votes
from .registry import ORACLES, Tables, query


def staged(t: Tables) -> dict[str, DataFrame]:
    """Staging and the marts that need no labels."""
    filings = staging.filings(raw_filings(t))
    votes = marts.votes(staging.clean_votes(raw_votes(t), WINDOW), filings)
    return {"filings": filings, "votes": votes, "funds": marts.funds(staging.series(raw_series(t)), filings)}


def answers(t: Tables) -> DataFrame:
    filings = staging.filings(raw_filings(t))
    clean = staging.clean_votes(raw_votes(t), WINDOW)
    return marts.fund_answers(clean, filings, marts.funds(staging.series(raw_series(t)), filings))


# Staging -------------------------------------------------------------------------


@query(expected("""
SELECT filing_id, k % 9 = 0 AS is_amendment, filer_cik, filer_name, filed_date, filer_kind, report_kind, report_year,
  period_end_date, (k % 4)::integer AS series_count FROM filings"""))
def staged_filings(t):
    return staging.filings(raw_filings(t)).drop("form_type", "download_status")


@query(expected("SELECT filing_id, fund_id, fund_name FROM named"))
def staged_series(t):
    return staging.series(raw_series(t))


@query(expected("""
SELECT filing_id, fund_id, issuer_name, cusip, meeting_date, proposal_text, is_environment, is_social,
  is_director_election, is_say_on_pay, is_governance, proposed_by, vote, versus_management,
  CASE versus_management WHEN 'WITH' THEN true WHEN 'AGAINST' THEN false END AS voted_with_management,
  shares_voted FROM votes"""))
def staged_votes(t):
    clean = staging.clean_votes(raw_votes(t), WINDOW)
    return clean.drop("isin", "categories", "shares_on_loan", "vote_as_filed")


@query(expected("""
SELECT filing_id, fund_id, vote, filer_kind, filer_name, report_year, k % 9 = 0 AS is_amendment FROM votes"""))
def votes_with_filing(t):
    return staged(t)["votes"].select(
        "filing_id", "fund_id", "vote", "filer_kind", "filer_name", "report_year", "is_amendment"
    )


# Marts ---------------------------------------------------------------------------


@query(expected(f"""
SELECT count(*) AS votes, count(DISTINCT filing_id) AS filings_with_votes,
  count(*) FILTER (WHERE filer_kind = 'fund') AS fund_votes, count(*) FILTER (WHERE filer_kind = 'manager') AS manager_votes,
  {pct("count(*) FILTER (WHERE meeting_date IS NULL)", "count(*)", 3)} AS pct_no_usable_date,
  {pct("count(*) FILTER (WHERE cusip IS NULL)", "count(*)", 2)} AS pct_no_cusip,
  {pct("count(*) FILTER (WHERE vote = 'OTHER')", "count(*)", 3)} AS pct_vote_unrecognised,
  {pct("count(*) FILTER (WHERE vote = 'UNKNOWN')", "count(*)", 2)} AS pct_vote_blank,
  {pct("count(*) FILTER (WHERE vote = 'NOT VOTED')", "count(*)", 2)} AS pct_not_voted,
  {pct("count(*) FILTER (WHERE versus_management <> 'NONE')", "count(*)", 2)} AS pct_comparable_to_management,
  {pct("count(*) FILTER (WHERE versus_management = 'WITH')", "count(*) FILTER (WHERE versus_management <> 'NONE')", 2)}
    AS pct_with_management,
  count(*) FILTER (WHERE is_environment) AS environment_votes, count(*) FILTER (WHERE is_social) AS social_votes,
  count(*) FILTER (WHERE proposed_by = 'shareholder') AS shareholder_proposal_votes FROM votes"""))
def quality_summary(t):
    return marts.quality_summary(staged(t)["votes"])


@query(expected("SELECT * FROM funds"))
def latest_attrs(t):
    return staged(t)["funds"]


@query(expected("""
SELECT filing_id, fund_id, proposal_key, filer_cik, filer_name, report_year, cusip, meeting_date, proposal_text,
  is_environment, is_social, vote, with_management AS voted_with_management, supported, is_esg_named, fund_name,
  yardstick AS is_reference_house FROM answers"""))
def one_answer(t):
    return answers(t).drop("issuer_name")


@query(expected("""
SELECT filing_id, fund_id, proposal_key, vote, matched_proposal_id, direction, direction_basis FROM fact"""))
def labelled_votes(t):
    return built(t)["fund_es_votes"].select(
        "filing_id", "fund_id", "proposal_key", "vote", "matched_proposal_id", "direction", "direction_basis"
    )


@query(expected("""
SELECT filing_id, proposal_key, filer_name, report_year, direction, direction_basis, esg_funds, other_funds, esg_support,
  other_support, support_gap, outcome FROM compared"""))
def sibling_comparison(t):
    return built(t)["sibling_comparison"]


SUPPORT_SQL = expected(f"""
SELECT report_year, direction, direction_basis, fund_group, count(*) AS funds, sum(n)::bigint AS votes,
  {pct("sum(n_for)", "sum(n)", 2)} AS pct_for_all_votes, {half_up("100 * avg(n_for / n::double)", 2)} AS pct_for_average_fund
FROM (SELECT report_year, direction, direction_basis, fund_id, count(*) AS n, sum(supported::integer) AS n_for,
    CASE WHEN yardstick THEN '1 Specialist ESG houses' WHEN is_esg_named THEN '2 ESG-named funds elsewhere'
      ELSE '3 Other funds' END AS fund_group FROM fact GROUP BY ALL)
GROUP BY ALL""")


@query(SUPPORT_SQL)
def support_by_group(t):
    return built(t)["support_by_direction"]


@query(expected("SELECT * FROM topics"))
def year_topic_summary(t):
    return marts.fund_year_topic(staged(t)["votes"])


# Reports -------------------------------------------------------------------------


@query(expected(f"""
SELECT report_year, topic, proposed_by, count(DISTINCT fund_id) AS funds, sum(votes)::bigint AS votes,
  {pct("sum(votes_for)", "sum(votes)", 2)} AS pct_for,
  {pct("sum(with_management)", "sum(with_management) + sum(against_management)", 2)} AS pct_with_management
FROM topics GROUP BY ALL"""))
def topic_trends(t):
    return reports.topic_trends(marts.fund_year_topic(staged(t)["votes"]))


@query(expected(f"""
SELECT d.fund_id, d.fund_name, d.filer_name AS fund_house, d.is_esg_named, o.votes, o.pct_with_management,
  e.es_votes_on_pro_esg, CASE WHEN e.es_votes_on_pro_esg >= 20 THEN e.p END AS pct_backing_pro_esg
FROM funds d LEFT JOIN (SELECT fund_id, sum(votes)::bigint AS votes,
    {pct("sum(with_management)", "sum(with_management) + sum(against_management)", 2)} AS pct_with_management
    FROM topics GROUP BY 1) o USING (fund_id)
  LEFT JOIN (SELECT fund_id, count(*) AS es_votes_on_pro_esg, {pct("sum(supported::integer)", "count(*)", 2)} AS p
    FROM fact WHERE direction = 'supports ESG' AND direction_basis = 'reference votes' AND NOT yardstick GROUP BY 1) e
  USING (fund_id)"""))
def fund_scorecard(t):
    return built(t)["fund_scorecard"]


GAP_SQL = f"""
SELECT *, sign(pct_esg_named_for - pct_other_for) * floor(abs(pct_esg_named_for - pct_other_for) * 100 + 0.5) / 100 AS gap_points
FROM (SELECT filer_name AS fund_house, report_year, sum(is_esg_named::integer)::bigint AS esg_named_votes,
    sum((NOT is_esg_named)::integer)::bigint AS other_votes,
    {pct("sum((is_esg_named AND supported)::integer)", "sum(is_esg_named::integer)", 2)} AS pct_esg_named_for,
    {pct("sum((NOT is_esg_named AND supported)::integer)", "sum((NOT is_esg_named)::integer)", 2)} AS pct_other_for
  FROM fact WHERE direction = 'supports ESG' AND direction_basis = 'reference votes' AND NOT yardstick GROUP BY ALL)
WHERE esg_named_votes >= 5 AND other_votes >= 5"""


@query(expected(GAP_SQL))
def house_gap(t):
    return reports.house_gap(built(t)["fund_es_votes"], min_votes=5)


BY_HOUSE = f"""
SELECT filer_name, count(*) AS proposals_compared, {half_up("100 * avg(esg_support)", 1)} AS esg_pct_for,
  {half_up("100 * avg(other_support)", 1)} AS siblings_pct_for,
  {pct("count(*) FILTER (WHERE outcome = 'same as siblings')", "count(*)", 1)} AS pct_same
FROM compared WHERE direction = 'supports ESG' AND direction_basis = 'reference votes'
GROUP BY filer_name HAVING count(*) >= 10"""


def _by_house(t) -> DataFrame:
    return reports.sibling_by_house(built(t)["sibling_comparison"], 10)


@query(expected(BY_HOUSE))
def sibling_by_house(t):
    return _by_house(t)


@query(expected(f"""
SELECT *, esg_pct_for - siblings_pct_for AS gap
FROM ({BY_HOUSE} ORDER BY proposals_compared DESC, filer_name LIMIT 20)"""))
def house_gap_top20(t):
    return reports.house_gap_chart(_by_house(t))


@query(expected(f"""
SELECT direction, direction_basis, report_year, count(*) AS proposals_compared,
  {half_up("100 * avg(esg_support)", 2)} AS esg_pct_for, {half_up("100 * avg(other_support)", 2)} AS siblings_pct_for,
  {pct("count(*) FILTER (WHERE outcome = 'same as siblings')", "count(*)", 2)} AS pct_same,
  {pct("count(*) FILTER (WHERE outcome = 'ESG fund more supportive')", "count(*)", 2)} AS pct_esg_more,
  {pct("count(*) FILTER (WHERE outcome = 'ESG fund less supportive')", "count(*)", 2)} AS pct_esg_less
FROM compared GROUP BY 1, 2, 3"""))
def sibling_by_year(t):
    return reports.sibling_by_year(built(t)["sibling_comparison"])


@query(expected("""
SELECT direction, direction_basis, count(*) AS fund_votes, count(DISTINCT matched_proposal_id) AS proposals,
  floor(100.0::double * count(*) / (SELECT count(*) FROM fact) * 10 + 0.5) / 10 AS pct_of_votes
FROM fact GROUP BY 1, 2"""))
def label_coverage(t):
    return A.share_of_total(reports.label_coverage(built(t)["fund_es_votes"]), "fund_votes", "pct_of_votes")


BACKED = "direction = 'supports ESG' AND direction_basis = 'reference votes' AND is_esg_named AND NOT yardstick"
THEMED = f"""
SELECT fund_id, fund_name, filer_name, count(*) AS votes, {pct("sum(supported::integer)", "count(*)", 1)} AS pct_for
FROM fact WHERE {BACKED} GROUP BY ALL HAVING count(*) >= 3"""


@query(expected(THEMED))
def entity_support_min_n(t):
    return reports.themed_fund_support(built(t)["fund_es_votes"], 3)


@query(expected(f"""
SELECT CASE WHEN s < 0.1 THEN 'a) under 10%' WHEN s < 0.25 THEN 'b) 10 to 25%' WHEN s < 0.5 THEN 'c) 25 to 50%'
  WHEN s < 0.75 THEN 'd) 50 to 75%' ELSE 'e) 75% and over' END AS support_band, count(*) AS funds
FROM (SELECT fund_id, avg(supported::integer) AS s FROM fact WHERE {BACKED} GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1"""))
def support_bands(t):
    return reports.support_bands(built(t)["fund_es_votes"])


@query(expected(f"""
SELECT least(19, floor(pct_for / 5))::integer AS bin, count(*) AS n FROM ({THEMED}) GROUP BY 1"""))
def histogram_bins(t):
    return reports.histogram(reports.themed_fund_support(built(t)["fund_es_votes"], 3))


# Labelling -----------------------------------------------------------------------


@query(expected("SELECT * EXCLUDE (core, points) FROM wordings"))
def wording_aggregate(t):
    return labelling.wordings(answers(t))


@query(expected("""
SELECT cusip, meeting_date, report_year, wording_key, proposal_id, direction, basis
FROM matched JOIN groups USING (proposal_id)"""))
def group_attrs_back(t):
    return built(t)["proposal_labels"]


@query(expected("""
SELECT proposal_id, wordings, fund_votes, fund_votes_for, reference_votes, reference_votes_for, pct_for, reference_pct_for,
  by_wording, by_reference_votes, direction, basis FROM groups"""))
def threshold_label(t):
    return built(t)["proposal_groups"].select(
        "proposal_id", "wordings", "fund_votes", "fund_votes_for", "reference_votes", "reference_votes_for", "pct_for",
        "reference_pct_for", "by_wording", "by_reference_votes", "direction", "basis",
    )


@query(expected("""
SELECT proposal_id, company, meeting_date, report_year, proposal_text AS title, all_wordings FROM (
  SELECT proposal_id, company, meeting_date, report_year, proposal_text,
    row_number() OVER (PARTITION BY proposal_id ORDER BY fund_votes DESC, wording_key DESC, cusip DESC NULLS LAST,
      report_year DESC) AS r FROM matched) JOIN (
  SELECT proposal_id, string_agg(proposal_text, ' || ' ORDER BY place) AS all_wordings FROM (
    SELECT proposal_id, proposal_text, row_number() OVER (PARTITION BY proposal_id
      ORDER BY min(-fund_votes * 1000 + 0), min(first_key), proposal_text) AS place
    FROM (SELECT *, first_value(wording_key) OVER (PARTITION BY proposal_id, proposal_text
        ORDER BY fund_votes DESC, wording_key) AS first_key FROM matched) GROUP BY 1, 2) WHERE place <= 12 GROUP BY 1)
USING (proposal_id) WHERE r = 1"""))
def top_texts_concat(t):
    return built(t)["proposal_groups"].select(
        "proposal_id", "company", "meeting_date", "report_year", "title", "all_wordings"
    )


@query(expected("""
SELECT count(*) AS "both", avg((by_wording = by_reference_votes)::integer) AS agree FROM groups
WHERE by_wording <> 'unclear' AND by_reference_votes IN ('supports ESG', 'opposes ESG')"""))
def signal_agreement(t):
    return labelling.signal_agreement(built(t)["proposal_groups"])


@query(expected("""
SELECT coalesce(by_wording, 'All') AS by_wording,
  count(*) FILTER (WHERE by_reference_votes = 'not enough votes') AS "not enough votes",
  count(*) FILTER (WHERE by_reference_votes = 'opposes ESG') AS "opposes ESG",
  count(*) FILTER (WHERE by_reference_votes = 'supports ESG') AS "supports ESG",
  count(*) FILTER (WHERE by_reference_votes = 'unclear') AS "unclear", count(*) AS "All"
FROM groups GROUP BY ROLLUP (by_wording)"""))
def crosstab_margins(t):
    return labelling.signal_crosstab(built(t)["proposal_groups"])


@query(expected("""
SELECT basis, direction, count(*) AS proposals, sum(fund_votes)::bigint AS fund_votes,
  round_even(100.0::double * sum(fund_votes) / (SELECT sum(fund_votes) FROM groups) * 10, 0) / 10 AS share_of_votes
FROM groups GROUP BY 1, 2"""))
def label_shares(t):
    return labelling.label_shares(built(t)["proposal_groups"])


# Quality report, profile and checks --------------------------------------------------


@query(expected("SELECT vote, count(*) AS votes FROM votes GROUP BY 1"))
def vote_values(t):
    return reports.quality_report(staged(t)["votes"])["vote_values"]


@query(expected("SELECT report_year, filer_kind, count(*) AS votes FROM votes GROUP BY 1, 2"))
def votes_by_year_and_kind(t):
    return reports.votes_by_year_and_kind(staged(t)["votes"])


def _profile(t, section: str) -> DataFrame:
    tables = raw(t)
    return reports.raw_profile(tables["filings"], tables["series"], tables["votes"])[section]


RAW_YEAR = "CASE WHEN k % 53 = 0 THEN 'n/a' WHEN k % 5 = 0 THEN y || '.0' ELSE y::varchar END"
RAW_KIND = "CASE filer_kind WHEN 'fund' THEN 'RMIC' WHEN 'manager' THEN 'IM' ELSE 'XX' END"


@query(expected("""
SELECT count(*) AS fund_votes, count(*) AS with_series_id, count(*) AS with_matching_name
FROM lineitem JOIN filings ON k = l_orderkey WHERE filer_kind = 'fund'"""))
def series_coverage(t):
    return _profile(t, "series_coverage")


@query(expected(f"""
SELECT {RAW_KIND} AS registrant_type, count(*) AS votes, count(DISTINCT l_orderkey) AS filings
FROM lineitem JOIN filings ON k = l_orderkey GROUP BY 1"""))
def votes_by_filer_type(t):
    return _profile(t, "votes_by_filer_type")


@query(expected(f"""
SELECT ' ' || filer_name || ' ' AS company, {RAW_KIND} AS registrant_type, {RAW_YEAR} AS report_year, count(*) AS votes
FROM lineitem JOIN filings ON k = l_orderkey GROUP BY 1, 2, 3 ORDER BY votes DESC, company, report_year, registrant_type LIMIT 25"""))
def largest_filings(t):
    return _profile(t, "largest_filings")


@query(expected(f"""
SELECT CASE WHEN k % 9 = 0 THEN 'N-PX/A' ELSE 'N-PX' END AS form_type, {RAW_KIND} AS registrant_type,
  CASE report_kind WHEN 'notice' THEN 'FUND NOTICE REPORT' WHEN 'combination' THEN 'Combination Voting Report'
    WHEN 'voting' THEN 'Fund Voting Report' END AS report_type, count(*) AS filings FROM filings GROUP BY 1, 2, 3"""))
def filings_by_form(t):
    return _profile(t, "filings_by_form")


@query(expected("""
SELECT 'filings' AS item, count(*) AS n FROM orders UNION ALL SELECT 'votes', count(*) FROM lineitem JOIN filings ON k = l_orderkey
UNION ALL SELECT 'fund names', count(*) FROM named
UNION ALL SELECT 'filings that have votes', count(DISTINCT l_orderkey) FROM lineitem JOIN filings ON k = l_orderkey"""))
def raw_row_counts(t):
    return _profile(t, "row_counts")


@query(expected("""
SELECT count(*) AS fund_rows, count(DISTINCT fund) AS distinct_funds,
  count(DISTINCT CASE WHEN fund % 6 < 3 THEN fund END) AS esg_named_funds FROM named"""))
def themed_names(t):
    return _profile(t, "themed_names")


@query(expected("""
SELECT DISTINCT CASE fund % 6 WHEN 0 THEN replace(fund_name, 'Green Growth', 'Green   Growth')
  WHEN 1 THEN ' ' || fund_name ELSE fund_name END AS series_name
FROM named WHERE fund % 6 < 3 ORDER BY series_name LIMIT 40"""))
def themed_examples(t):
    return _profile(t, "themed_examples")


@query(expected("SELECT 'WITH HOLD' AS vote_as_filed, count(*) AS votes FROM votes WHERE vote = 'OTHER' HAVING count(*) > 0"))
def unrecognised_answers(t):
    return reports.quality_report(staged(t)["votes"])["unrecognised"]


BY_NAME = f"""
SELECT fund_name, filer_name, count(*) AS votes, {pct("sum(supported::integer)", "count(*)", 1)} AS pct_for
FROM fact WHERE {BACKED} GROUP BY ALL HAVING count(*) >= 2"""


@query(expected(f"{BY_NAME} ORDER BY pct_for, votes DESC, fund_name, filer_name LIMIT 25"))
def lowest_support(t):
    rates = reports.themed_fund_support(built(t)["fund_es_votes"], 2, with_id=False)
    return reports.extreme_support(rates, lowest=True)


@query(expected(f"{BY_NAME} ORDER BY pct_for DESC, votes DESC, fund_name, filer_name LIMIT 25"))
def highest_support(t):
    rates = reports.themed_fund_support(built(t)["fund_es_votes"], 2, with_id=False)
    return reports.extreme_support(rates, lowest=False)


@query("""
SELECT 0.0::double AS issuer_name, floor(1e4 * count(*) FILTER (WHERE l_orderkey % 13 = 0) / count(*) + 0.5) / 100 AS cusip,
  0.0::double AS isin, floor(1e4 * count(*) FILTER (WHERE l_orderkey % 41 = 0) / count(*) + 0.5) / 100 AS meeting_date,
  0.0::double AS description, 0.0::double AS categories,
  floor(1e4 * count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 4) / count(*) + 0.5) / 100 AS how_voted,
  0.0::double AS mgmt_rec, 0.0::double AS series_id FROM lineitem""")
def blank_rates(t):
    rates = A.blank_rates(raw_votes(t), reports.BLANK_MARKS_BY_COLUMN)
    return rates.withColumnsRenamed(reports.BLANK_REPORT_NAMES)


@query(expected("""
SELECT CASE WHEN k % 41 = 0 THEN NULL ELSE CASE k % 6 WHEN 0 THEN regexp_replace(strftime(d, '%-m/%-d/%Y'), '[0-9]', '9', 'g')
    WHEN 1 THEN '99/99/99' WHEN 2 THEN '9-aaa-9999' WHEN 3 THEN '99-aaa-99' WHEN 4 THEN '99999999' ELSE '99/99/9999' END
  END AS pattern, count(*) AS votes
FROM lineitem JOIN (SELECT o_orderkey AS k, date_trunc('quarter', o_orderdate) AS d FROM orders) ON k = l_orderkey
GROUP BY 1"""))
def shape_profile(t):
    return P.shape_profile(raw_votes(t), "meeting_date")


def broken(t: Tables) -> dict[str, DataFrame]:
    """Tables that break every declared rule, in places that the given columns tell."""
    ok, odd = lambda col, good, when, key: f"if({when}, concat('odd', {key} % 3), '{good}') AS {col}", "o_orderkey % 41 = 0"
    line = "l_orderkey % 43 = 0"
    fund = "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'twice' ELSE concat('S', s_suppkey) END AS fund_id"
    return {
        "filings": t.orders.selectExpr(
            "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'twice' ELSE concat('A', o_orderkey) END AS filing_id",
            ok("filer_kind", "fund", odd, "o_orderkey"), ok("report_kind", "voting", odd, "o_custkey"),
        ),
        "series": t.orders.selectExpr(
            "if(o_orderkey % 29 = 0, NULL, concat('A', o_orderkey)) AS filing_id", "if(o_orderkey % 23 = 0, NULL, 'S') AS fund_id"
        ),
        "votes": t.lineitem.selectExpr(
            "if(l_orderkey % 19 = 0, NULL, concat('A', l_orderkey)) AS filing_id", ok("vote", "FOR", line, "l_partkey"),
            ok("versus_management", "WITH", line, "l_suppkey"), ok("proposed_by", "company", line, "l_linenumber"),
        ),
        "quality_summary": t.lineitem.selectExpr("100.0D * count_if(l_linenumber = 4) / count(*) AS pct_vote_unrecognised"),
        "funds": t.supplier.selectExpr(fund, "if(s_suppkey % 3 = 0, NULL, true) AS is_esg_named"),
        "fund_es_votes": t.lineitem.selectExpr(
            "l_orderkey AS filing_id", "l_suppkey % 2 AS fund_id", "l_linenumber % 2 AS proposal_key", ok("vote", "FOR", line, "l_partkey")
        ),
        "sibling_comparison": t.orders.selectExpr(ok("outcome", V.SIBLING_OUTCOMES[0], odd, "o_orderkey")),
        "proposal_labels": t.orders.selectExpr(
            "if(o_orderkey % 17 = 0, NULL, o_orderkey) AS proposal_id", ok("direction", V.SUPPORTS, odd, "o_orderkey"),
            ok("basis", V.BY_REFERENCE, odd, "o_custkey"),
        ),
        "topic_trends": t.customer.selectExpr(
            "c_nationkey AS report_year", "c_mktsegment AS topic", "c_custkey % 2 AS proposed_by",
            "c_custkey % 103 AS pct_for", "c_custkey % 107 - 3 AS pct_with_management",
        ),
        "fund_scorecard": t.supplier.selectExpr(fund, "2L AS votes", "if(s_suppkey % 4 = 0, 101, 50) AS pct_backing_pro_esg"),
        "fund_year_topic": t.supplier.selectExpr("concat('S', s_suppkey) AS fund_id", "2L AS votes"),
        "house_gap": t.customer.selectExpr("c_nationkey % 5 AS fund_house", "c_custkey % 20 AS report_year", "c_custkey % 111 - 5 AS gap_points"),
    }


def _counts(**rules: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql})::bigint AS violations" for name, sql in rules.items())


def _rows(table: str, when: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {when}"


def _odd(table: str, when: str, key: str) -> str:
    return f"SELECT count(DISTINCT {key} % 3) FROM {table} WHERE {when}"


def _copies(table: str, keys: str, when: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {table} WHERE {when} GROUP BY {keys} HAVING count(*) > 1)"


_O, _L = ("orders", "o_orderkey % 41 = 0"), ("lineitem", "l_orderkey % 43 = 0")


@query(_counts(**{
    "filings.filing_id unique": _copies("orders", "o_orderkey % 37 = 0", "o_orderkey % 31 <> 0 AND o_orderkey % 37 = 0"),
    "filings.filing_id not null": _rows("orders", "o_orderkey % 31 = 0"),
    "filings.filer_kind accepted": _odd(*_O, "o_orderkey"),
    "filings.report_kind accepted": _odd(*_O, "o_custkey"),
    "series.filing_id not null": _rows("orders", "o_orderkey % 29 = 0"),
    "series.filing_id has filing": _rows("orders", "o_orderkey % 29 <> 0 AND (o_orderkey % 31 = 0 OR o_orderkey % 37 = 0)"),
    "series.fund_id not null": _rows("orders", "o_orderkey % 23 = 0"),
    "votes.filing_id not null": _rows("lineitem", "l_orderkey % 19 = 0"),
    "votes.vote accepted": _odd(*_L, "l_partkey"),
    "votes.versus_management accepted": _odd(*_L, "l_suppkey"),
    "votes.proposed_by accepted": _odd(*_L, "l_linenumber"),
    "quality.unrecognised at most 1%": "SELECT (100.0 * count(*) FILTER (WHERE l_linenumber = 4) / count(*) > 1)::integer FROM lineitem",
    "funds.fund_id unique": _copies("supplier", "s_suppkey % 5", "s_suppkey % 5 = 1"),
    "funds.fund_id not null": _rows("supplier", "s_suppkey % 5 = 0"),
    "funds.is_esg_named not null": _rows("supplier", "s_suppkey % 3 = 0"),
    "fact.grain": _copies("lineitem", "l_orderkey, l_suppkey % 2, l_linenumber % 2"),
    "fact.vote accepted": _odd(*_L, "l_partkey"),
    "siblings.outcome accepted": _odd(*_O, "o_orderkey"),
    "labels.proposal_id not null": _rows("orders", "o_orderkey % 17 = 0"),
    "labels.direction accepted": _odd(*_O, "o_orderkey"),
    "labels.basis accepted": _odd(*_O, "o_custkey"),
    "trends.grain": _copies("customer", "c_nationkey, c_mktsegment, c_custkey % 2"),
    "trends.pct_for in range": _rows("customer", "c_custkey % 103 > 100"),
    "trends.pct_with_management in range": _rows("customer", "c_custkey % 107 NOT BETWEEN 3 AND 103"),
    "scorecard.fund_id unique": _copies("supplier", "s_suppkey % 5", "s_suppkey % 5 = 1"),
    "scorecard.fund_id not null": _rows("supplier", "s_suppkey % 5 = 0"),
    "scorecard.pct_backing_pro_esg in range": _rows("supplier", "s_suppkey % 4 = 0"),
    "gap.grain": _copies("customer", "c_nationkey % 5, c_custkey % 20"),
    "gap.gap_points in range": _rows("customer", "c_custkey % 111 > 105"),
    "scorecard matches its sources": "SELECT (count(*) <> count(*) FILTER (WHERE s_suppkey % 5 > 1))::integer FROM supplier",
}))
def every_declared_check(t):
    return K.run_rules(broken(t), reports.declared_rules())


def _outside(table: str, col: str, values) -> str:
    said = "', '".join(values)
    return f"SELECT count(DISTINCT {col}) FROM {table} WHERE {col} NOT IN ('{said}')"


def _report(name: str) -> str:
    return f"({ORACLES[name]})"


@query(expected(_counts(**{
    "filings.filing_id unique": _copies("filings", "filing_id", "filing_id IS NOT NULL"),
    "filings.filing_id not null": _rows("filings", "filing_id IS NULL"),
    "filings.filer_kind accepted": _outside("filings", "filer_kind", ["fund", "manager", "unknown"]),
    "filings.report_kind accepted": _outside("filings", "report_kind", ["voting", "notice", "combination", "unknown"]),
    "series.filing_id not null": _rows("named", "filing_id IS NULL"),
    "series.filing_id has filing": _rows("named", "filing_id NOT IN (SELECT filing_id FROM filings)"),
    "series.fund_id not null": _rows("named", "fund_id IS NULL"),
    "votes.filing_id not null": _rows("votes", "filing_id IS NULL"),
    "votes.vote accepted": _outside("votes", "vote", V.STANDARD_ANSWERS),
    "votes.versus_management accepted": _outside("votes", "versus_management", ["WITH", "AGAINST", "NONE"]),
    "votes.proposed_by accepted": _outside("votes", "proposed_by", ["company", "shareholder", "unknown"]),
    "quality.unrecognised at most 1%": f"SELECT ({pct("count(*) FILTER (WHERE vote = 'OTHER')", 'count(*)', 3)} > 1)::integer FROM votes",
    "funds.fund_id unique": _copies("funds", "fund_id"),
    "funds.fund_id not null": _rows("funds", "fund_id IS NULL"),
    "funds.is_esg_named not null": _rows("funds", "is_esg_named IS NULL"),
    "fact.grain": _copies("fact", "filing_id, fund_id, proposal_key"),
    "fact.vote accepted": _outside("fact", "vote", V.DECIDED_ANSWERS),
    "siblings.outcome accepted": _outside("compared", "outcome", V.SIBLING_OUTCOMES),
    "labels.proposal_id not null": _rows("matched", "proposal_id IS NULL"),
    "labels.direction accepted": _outside("groups", "direction", [V.SUPPORTS, V.OPPOSES, V.SPLIT, V.UNCLEAR]),
    "labels.basis accepted": _outside("groups", "basis", [V.BY_REFERENCE, V.BY_WORDING]),
    "trends.grain": _copies(_report("topic_trends"), "report_year, topic, proposed_by"),
    "trends.pct_for in range": _rows(_report("topic_trends"), "pct_for NOT BETWEEN 0 AND 100"),
    "trends.pct_with_management in range": _rows(_report("topic_trends"), "pct_with_management NOT BETWEEN 0 AND 100"),
    "scorecard.fund_id unique": _copies(_report("fund_scorecard"), "fund_id"),
    "scorecard.fund_id not null": _rows(_report("fund_scorecard"), "fund_id IS NULL"),
    "scorecard.pct_backing_pro_esg in range": _rows(_report("fund_scorecard"), "pct_backing_pro_esg NOT BETWEEN 0 AND 100"),
    "gap.grain": _copies(_report("house_gap"), "fund_house, report_year"),
    "gap.gap_points in range": _rows(_report("house_gap"), "gap_points NOT BETWEEN -100 AND 100"),
    "scorecard matches its sources": f"SELECT ((SELECT coalesce(sum(votes), 0) FROM {_report('fund_scorecard')}) <> (SELECT coalesce(sum(votes), 0)"
    f" FROM topics WHERE fund_id IN (SELECT fund_id FROM funds)) OR (SELECT count(*) FROM {_report('fund_scorecard')}) <> (SELECT count(*) FROM funds))::integer",
})))
def declared_checks(t):
    """All thirty rules on the build."""
    return K.run_rules(built_in_store(t), reports.declared_rules())


@query(expected("""
SELECT (SELECT count(*) FROM funds) + 1 AS funds_report, (SELECT count(*) FROM funds) AS funds_source,
  (SELECT sum(votes)::bigint FROM topics) AS votes_report, (SELECT sum(votes)::bigint FROM topics) AS votes_source"""))
def reconcile_totals(t):
    s = staged(t)
    topics = marts.fund_year_topic(s["votes"])
    return K.reconcile({
        # One fund too many on purpose: a reconciliation that holds returns nothing.
        "funds": (s["funds"].agg(A.count_all() + 1), s["funds"].agg(A.count_all())),
        "votes": (topics.agg(F.sum("votes")), topics.join(s["funds"].select("fund_id"), "fund_id", "left_semi").agg(F.sum("votes"))),
    })


# What a random row shows is told from the raw columns; the draw itself is keyed, so SQL can repeat it.
DRAWN = """(SELECT md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|' || l_partkey) AS drawn, l.*,
  c_mktsegment || (CASE WHEN k % 2 = 0 THEN ' Holdings, Inc.' ELSE ' Inc' END) AS company,
  CASE WHEN k % 13 = 0 THEN 'N/A' ELSE ' 00000' || lower(substr(c_mktsegment, 1, 4)) END AS code
  FROM lineitem l JOIN (SELECT o_orderkey AS k, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey) ON k = l_orderkey)"""


def _drawn(t) -> DataFrame:
    """Raw votes beside the keys of their line items."""
    return raw_votes(t, keep=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])


DRAW_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]


@query(f"""
SELECT company AS issuer_name, code AS cusip, l_orderkey, l_linenumber FROM {DRAWN} ORDER BY drawn LIMIT 12""")
def random_rows(t):
    """Twelve random votes, the same in every run."""
    return reports.raw_profile(raw_filings(t), raw_series(t), _drawn(t), key=DRAW_KEYS)["random_rows"].select(
        "issuer_name", "cusip", "l_orderkey", "l_linenumber"
    )


@query(f"""
SELECT company AS issuer_name, l_orderkey, l_linenumber, length(title) AS chars FROM (
  SELECT *, CASE l_orderkey % 4 WHEN 1 THEN 'Shareholder Proposal Regarding ' || t WHEN 2 THEN t || ' (' || l_linenumber || ')'
    WHEN 3 THEN t || ' ' || split_part(p_name, ' ', 1) ELSE t END AS title
  FROM {DRAWN} JOIN part ON p_partkey = l_partkey JOIN (VALUES ('ECONOMY', 'Report on climate transition plan'),
    ('MEDIUM', 'Human rights due diligence'), ('LARGE', 'Report on lobbying expenditure'), ('SMALL', 'Revisit plastics packaging goals'),
    ('PROMO', 'Independent chair policy'), ('STANDARD', 'Report on risks of esg goals')) AS x(p_type, t) USING (p_type)
  WHERE p_type NOT IN ('LARGE', 'MEDIUM')) ORDER BY drawn LIMIT 15""")
def topical_sample(t):
    """Fifteen random votes on environmental and social proposals, the same in every run."""
    return reports.raw_profile(raw_filings(t), raw_series(t), _drawn(t), key=DRAW_KEYS)["topical_sample"].select(
        "issuer_name", "l_orderkey", "l_linenumber", F.length("description").cast("long").alias("chars")
    )
