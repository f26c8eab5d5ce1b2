"""The whole build on hand-made filings, and scoring, checks and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.operators import aggregates as A
from rollcall.operators import checks as K
from rollcall.operators import joins as J
from rollcall.operators import ranking as R
from rollcall.plans import evaluation, labelling, marts, reports, staging
from rollcall.plans.build import build
from rollcall.sources.text_tables import text_schema

FILING = dict(form_type="N-PX", cik="77", company=" Wide House ", date_filed="2025-08-01", registrant_type="RMIC",
              report_type="FUND VOTING REPORT", period_of_report="06/30/2025", report_year="2025",
              series_count="2", status="ok")
VOTE = dict(issuer_name="Acme Inc", cusip="000123456", isin="US0001234567", meeting_date="07/06/2024",
            vote_description="Report on climate plans", categories="ENVIRONMENT OR CLIMATE", vote_source="SECURITY HOLDER",
            shares_voted_total="100", shares_on_loan="0", how_voted="FOR", shares_voted="100",
            management_recommendation="AGAINST", series_id="S1", other_info="")


def table(spark, columns, rows, defaults):
    return spark.createDataFrame([tuple({**defaults, **r}.get(c) for c in columns) for r in rows], text_schema(columns))


def raw_tables(spark, filings, series, votes):
    return {
        "filings": table(spark, V.FILING_COLUMNS, filings, FILING),
        "series": table(spark, V.SERIES_COLUMNS, series, {}),
        "votes": table(spark, V.VOTE_COLUMNS, votes, VOTE),
    }


def staged(spark, **kw):
    raw = raw_tables(spark, kw.get("filings", [{"accession": "A1"}]), kw.get("series", []), kw["votes"])
    filings = staging.filings(raw["filings"])
    votes = marts.votes(staging.clean_votes(raw["votes"]), filings)
    funds = marts.funds(staging.series(raw["series"]), filings)
    return filings, votes, funds


def test_filings(spark):
    rows = staging.filings(table(spark, V.FILING_COLUMNS, [
        {"accession": "1"},
        {"accession": "2", "form_type": "N-PX/A", "registrant_type": "IM", "report_type": "Notice (voting)",
         "report_year": "2025.0", "date_filed": "x"},
        {"accession": "3", "registrant_type": "ZZ", "report_type": "COMBINATION voting", "report_year": "x",
         "period_of_report": "13/01/2025"},
        {"accession": "4", "report_type": None},
    ], FILING)).orderBy("filing_id").collect()
    assert [r["filer_kind"] for r in rows] == ["fund", "manager", "unknown", "fund"]
    assert [r["report_kind"] for r in rows] == ["voting", "notice", "combination", "unknown"]
    assert [r["report_year"] for r in rows] == [2025, 2025, None, 2025]
    assert rows[0]["filer_name"] == "Wide House" and rows[0]["filed_date"] == dt.date(2025, 8, 1)
    assert rows[1]["is_amendment"] and rows[1]["filed_date"] is None
    assert rows[2]["period_end_date"] is None and rows[0]["period_end_date"] == dt.date(2025, 6, 30)


def test_votes_are_cleaned(spark):
    raw = table(spark, V.VOTE_COLUMNS, [
        {"accession": "1", "categories": "Environment or climate|Director elections", "series_id": " s1 "},
        {"accession": "2", "vote_source": "Vote Source"},
        {"accession": "3", "management_recommendation": "None", "how_voted": "With-hold", "meeting_date": "01/01/2019",
         "cusip": "123", "vote_source": "mgmt", "shares_voted": "12d", "series_id": " "},
        {"accession": "4", "management_recommendation": "No", "categories": None, "vote_source": None},
    ], VOTE)
    rows = {r["filing_id"]: r for r in staging.clean_votes(raw).collect()}
    assert set(rows) == {"1", "3", "4"}
    assert rows["1"]["is_environment"] and rows["1"]["is_director_election"] and not rows["1"]["is_social"]
    assert rows["1"]["fund_id"] == "S1" and rows["1"]["cusip"] == "000123456"
    odd = rows["3"]
    assert (odd["versus_management"], odd["voted_with_management"], odd["vote"], odd["vote_as_filed"]) == (
        "NONE", None, "OTHER", "WITH HOLD")
    assert odd["meeting_date"] is None and odd["cusip"] is None and odd["shares_voted"] is None and odd["fund_id"] is None
    assert odd["proposed_by"] == "company" and rows["4"]["proposed_by"] == "unknown"
    assert rows["4"]["voted_with_management"] is False and rows["4"]["categories"] == ""


def test_fund_dimension(spark):
    filings = [
        {"accession": "A1", "date_filed": "2024-08-01", "report_year": "2024"},
        {"accession": "A2", "date_filed": "2025-08-01", "company": "New House"},
        {"accession": "A3", "date_filed": None, "report_year": "2023"},
    ]
    series = [
        {"accession": "A1", "series_id": "s1", "series_name": "Old  Name"},
        {"accession": "A2", "series_id": " S1", "series_name": "Green Bond"},
        {"accession": "A3", "series_id": "S1", "series_name": "Old Name"},
        {"accession": "A1", "series_id": " ", "series_name": "no id"},
        {"accession": "A3", "series_id": "S2", "series_name": "Dateless"},
        {"accession": "A9", "series_id": "S3", "series_name": "No filing"},
    ]
    _, _, funds = staged(spark, filings=filings, series=series, votes=[{"accession": "A1"}])
    rows = {r["fund_id"]: r for r in funds.collect()}
    assert set(rows) == {"S1", "S2"}
    one = rows["S1"]
    assert (one["fund_name"], one["filer_name"], one["names_used"], one["first_report_year"], one["last_report_year"],
            one["is_esg_named"]) == ("Green Bond", "New House", 2, 2023, 2025, True)
    # Without any filing date no name is the latest one.
    assert rows["S2"]["fund_name"] is None and rows["S2"]["is_esg_named"] is None


def answers_of(spark, **kw):
    filings, votes, funds = staged(spark, **kw)
    return marts.fund_answers(votes, filings, funds)


def test_latest_filing_counts_among_qualifying_votes(spark):
    filings = [
        {"accession": "A1", "date_filed": "2025-08-01"}, {"accession": "A2", "date_filed": "2025-09-01"},
        {"accession": "B1", "cik": "88", "date_filed": "2025-08-01"}, {"accession": "B2", "cik": "88", "date_filed": "2025-09-01"},
        {"accession": "C1", "registrant_type": "IM"}, {"accession": "D1", "date_filed": None},
    ]
    votes = [
        {"accession": "A1"}, {"accession": "A2", "how_voted": "AGAINST"},
        {"accession": "B1"}, {"accession": "B2", "categories": "DIRECTOR ELECTIONS"},
        {"accession": "C1"}, {"accession": "D1", "series_id": "S9"},
        {"accession": "A2", "vote_source": "ISSUER", "vote_description": "other"},
        {"accession": "A2", "how_voted": "TNA", "vote_description": "another"},
        {"accession": "A2", "series_id": None, "vote_description": "third"},
    ]
    rows = answers_of(spark, filings=filings, votes=votes).collect()
    assert {(r["filing_id"], r["vote"]) for r in rows} == {("A2", "AGAINST"), ("B1", "FOR")}


def test_split_answers_and_labels(spark):
    votes = [
        {"accession": "A1", "how_voted": "FOR", "shares_voted": "60"},
        {"accession": "A1", "how_voted": "AGAINST", "shares_voted": "40", "management_recommendation": "FOR"},
        {"accession": "A1", "series_id": "S2", "how_voted": "FOR", "shares_voted": "5"},
        {"accession": "A1", "series_id": "S2", "how_voted": "AGAINST", "shares_voted": "5"},
        {"accession": "A1", "cusip": None, "meeting_date": None, "vote_description": "No date!"},
        {"accession": "A1", "vote_description": "***"},
    ]
    series = [{"accession": "A1", "series_id": "S2", "series_name": "Impact Fund"}]
    answers = answers_of(spark, votes=votes, series=series)
    rows = {(r["fund_id"], r["proposal_text"]): r for r in answers.collect()}
    split = rows["S1", "Report on climate plans"]
    assert split["vote"] == "FOR" and split["supported"] and split["voted_with_management"] is True
    assert rows["S2", "Report on climate plans"]["vote"] == "FOR"          # equal shares: last in the alphabet
    assert rows["S1", "No date!"]["proposal_key"].startswith("ACME INC||")
    assert rows["S2", "Report on climate plans"]["is_esg_named"] is True and split["is_esg_named"] is False

    labels = spark.createDataFrame(
        [(None, None, 2025, "no date", "p|1", V.SUPPORTS, V.BY_WORDING), (None, None, 2025, None, "p|2", V.SPLIT, V.BY_WORDING)],
        "cusip string, meeting_date date, report_year int, wording_key string, proposal_id string, direction string, basis string")
    fact = {r["proposal_text"]: r for r in marts.fund_es_votes(answers, labels).filter(F.col("fund_id") == "S1").collect()}
    assert (fact["No date!"]["matched_proposal_id"], fact["No date!"]["direction"]) == ("p|1", V.SUPPORTS)
    assert (fact["***"]["direction"], fact["***"]["direction_basis"]) == (V.UNCLEAR, V.NOT_LABELLED)


def fact_rows(spark, rows):
    schema = ("filing_id string, proposal_key string, fund_id string, fund_name string, filer_name string, report_year int,"
              " direction string, direction_basis string, is_esg_named boolean, is_reference_house boolean,"
              " supported boolean, matched_proposal_id string")
    base = ("F", "P", "S", "n", "House", 2025, V.SUPPORTS, V.BY_REFERENCE, False, False, False, "m")
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple({**dict(zip(names, base)), **r}[n] for n in names) for r in rows], schema)


def test_siblings(spark):
    def votes(proposal, themed, others, **kw):
        return [dict(proposal_key=proposal, is_esg_named=True, supported=s, **kw) for s in themed] + [
            dict(proposal_key=proposal, is_esg_named=False, supported=s, **kw) for s in others]

    fact = fact_rows(spark, [
        *votes("both", [True], [True]), *votes("half", [True, False], [True]), *votes("more", [True], [False]),
        *votes("less", [False], [True, True, True, False]), *votes("one side", [True], []),
        *votes("yardstick", [True], [False], is_reference_house=True),
        *votes("unknown house", [True], [False], is_reference_house=None),
    ])
    rows = {r["proposal_key"]: r for r in marts.sibling_comparison(fact).collect()}
    same, more, less = V.SIBLING_OUTCOMES
    assert {k: r["outcome"] for k, r in rows.items()} == {"both": same, "half": same, "more": more, "less": less}
    assert rows["half"]["support_gap"] == -0.5
    year = reports.sibling_by_year(marts.sibling_comparison(fact)).first()
    assert year["pct_same"] + year["pct_esg_more"] + year["pct_esg_less"] == pytest.approx(100, abs=0.02)
    # A house that cannot be told to be a yardstick still counts in a fund group.
    groups = {r["fund_group"]: r["votes"] for r in marts.support_by_direction(fact).collect()}
    assert groups == {V.FUND_GROUPS[0]: 2, V.FUND_GROUPS[1]: 7, V.FUND_GROUPS[2]: 8}


def wording(company, text, n=1, n_for=0, reference=0, reference_for=0, cusip="000123456", day="2024-07-06"):
    return (cusip, dt.date.fromisoformat(day) if day else None, 2025, "".join(c for c in text.lower() if c.isalnum() or c == " "),
            company, text, True, False, n, n_for, 1, 0, 0, 0, reference, reference_for)


WORDING = ("cusip string, meeting_date date, report_year int, wording_key string, company string, proposal_text string,"
           " is_environment boolean, is_social boolean, fund_votes long, fund_votes_for long, filers long,"
           " votes_with_management long, esg_votes long, esg_votes_for long, reference_votes long, reference_votes_for long")


def test_proposals_are_matched_and_labelled(spark):
    rows = [
        wording("Example Holdings, Inc.", "3. Stockholder Proposal Regarding Report on Water Use", 10, 5, 4, 4),
        wording("EXAMPLE HOLDING INC", "Report on water use (4)", 4, 1, 1, 0),
        wording("Example", "Independent chair policy", 9),
        wording("Example", "Report on water use", 3, day=None),
    ]
    matched = labelling.match_proposals(spark.createDataFrame(rows, WORDING)).cache()
    ids = {r["proposal_text"]: r["proposal_id"] for r in matched.collect()}
    assert ids[rows[0][5]] == ids[rows[1][5]] == "example|2024-07-06|1"
    assert ids["Independent chair policy"] == "example|2024-07-06|2" and ids["Report on water use"] == "example||1"
    groups = labelling.proposal_groups(matched).cache()
    water = groups.filter(F.col("wordings") == 2).first()
    assert water["title"] == rows[0][5] and water["fund_votes"] == 14 and water["pct_for"] == 42.9
    assert water["reference_pct_for"] == 80.0 and (water["direction"], water["basis"]) == (V.SUPPORTS, V.BY_REFERENCE)
    assert water["all_wordings"] == f"{rows[0][5]} || {rows[1][5]}"
    labels = {r["wording_key"]: r for r in labelling.proposal_labels(matched, groups).collect()}
    assert len(labels) == 4 and labels["independent chair policy"]["direction"] == V.UNCLEAR
    assert labelling.signal_agreement(groups).first()["both"] == 1
    cross = {r["by_wording"]: r for r in labelling.signal_crosstab(groups).collect()}
    assert cross["All"]["All"] == 3 and cross[V.SUPPORTS][V.SUPPORTS] == 1
    shares = labelling.label_shares(groups).collect()
    assert sum(r["fund_votes"] for r in shares) == 26


def test_only_the_first_twelve_wordings_are_read(spark):
    df = spark.createDataFrame([("g", f"title {i}" if i < 13 else "censor", 100 - i) for i in range(1, 14)] * 3,
                               "g string, t string, n int")
    text = A.top_texts(df, ["g"], "t", [-F.col("n")]).first()["all_wordings"]
    assert text.split(" || ") == [f"title {i}" for i in range(1, 13)]


def test_whole_build(spark, tmp_path):
    filings = [{"accession": "A1"}, {"accession": "A2", "cik": "99", "company": "Domini Trust"}]
    series = [{"accession": "A1", "series_id": "S1", "series_name": "Plain"},
              {"accession": "A1", "series_id": "S2", "series_name": "Green Growth"},
              *[{"accession": "A2", "series_id": f"R{i}", "series_name": f"R {i}"} for i in range(4)]]
    votes = [{"accession": "A1", "how_voted": "AGAINST"}, {"accession": "A1", "series_id": "S2"},
             *[{"accession": "A2", "series_id": f"R{i}", "vote_description": "Report on climate plans (2)"} for i in range(4)],
             {"accession": "A1", "categories": "DIRECTOR ELECTIONS", "vote_source": "ISSUER"}, {"accession": "ZZ"}]
    lazy = build(raw_tables(spark, filings, series, votes))
    stored = build(raw_tables(spark, filings, series, votes), store=str(tmp_path))
    for tables in (lazy, stored):
        assert tables["votes"].count() == 7
        fact = {r["fund_id"]: r for r in tables["fund_es_votes"].collect()}
        assert len(fact) == 6 and {r["direction"] for r in fact.values()} == {V.SUPPORTS}
        assert len({r["matched_proposal_id"] for r in fact.values()}) == 1
        assert fact["R0"]["is_reference_house"] and not fact["S1"]["is_reference_house"]
        sibling = tables["sibling_comparison"].collect()
        assert len(sibling) == 1 and sibling[0]["support_gap"] == 1.0
    broken = {r["check"]: r["violations"] for r in K.run(reports.declared_checks(stored)).collect()}
    assert len(broken) == 30 and set(broken.values()) == {0}
    assert {r["check"]: r["violations"] for r in K.run_rules(stored, reports.declared_rules()).collect()} == broken
    assert sum(r["votes"] for r in reports.votes_by_year_and_kind(stored["votes"]).collect()) == 7
    for name, df in {**reports.results(stored), **reports.esg_report(stored), **reports.quality_report(stored["votes"])}.items():
        assert df.columns and df.collect() is not None, name
    raw = raw_tables(spark, filings, series, votes)
    profile = reports.raw_profile(raw["filings"], raw["series"], raw["votes"])
    assert len(profile) == 17
    counts = {r["item"]: r["n"] for r in profile["row_counts"].collect()}
    assert counts == {"filings": 2, "fund names": 6, "votes": 8, "filings that have votes": 3}
    assert tuple(profile["series_coverage"].first()) == (7, 7, 7)
    for name, df in profile.items():
        df.collect()
    chart = reports.house_gap_chart(reports.sibling_by_house(stored["sibling_comparison"], 1)).collect()
    assert chart[0]["gap"] == 100.0
    assert reports.house_gap_page(reports.sibling_by_house(stored["sibling_comparison"], 1), 1).count() == 1
    assert reports.headline_chart(stored["support_by_direction"]).count() == 3
    assert reports.histogram(reports.themed_fund_support(stored["fund_es_votes"], 1)).first()["bin"] == 19


def test_scoring(spark):
    gold = spark.createDataFrame(
        [("1", "c", "t", "supports", "supports", "dev"), ("2", "c", "t", "opposes", "unclear", "dev"),
         ("3", "c", "t", "supports", "unclear", "dev"), ("4", "c", "t", "supports", "supports", "test")],
        "id string, company string, title string, label string, rule_label string, split string")
    runs = spark.createDataFrame(
        [("m__v1", "1", "supports"), ("m__v1", "2", "supports"), ("m__v1", "3", "no answer"), ("m__v2", "1", "supports")],
        "run string, id string, label string")
    out = evaluation.evaluate(gold, runs, "dev")
    scores = {r["system"]: r for r in out["scores"].collect()}
    assert set(scores) == {"Keyword rules", "m / v1", "Rules, then v1 where rules are unclear"}
    model = scores["m / v1"]
    assert (model["proposals"], model["accuracy"], model["supports_precision"], model["supports_recall"]) == (3, 33.3, 50.0, 50.0)
    assert model["opposes_precision"] is None and model["opposes_recall"] == 0.0 and model["no_clear_answer"] == 33.3
    assert scores["Keyword rules"]["no_clear_answer"] == 66.7
    assert {r["id"] for r in out["errors"].collect()} == {"2", "3"}
    said = {(r["system"], r["truth"]): r for r in out["confusion"].collect()}
    assert said["m / v1", "supports"]["no answer"] == 1

    done = runs.filter(F.col("run") == "m__v2")
    todo = evaluation.pending(gold, done, "dev")
    assert {r["id"] for r in todo.collect()} == {"2", "3"}
    assert evaluation.request_batches(todo, 1).count() == 2
    recorded = {r["id"]: r["label"] for r in evaluation.record_answers(todo, done).collect()}
    assert recorded == {"2": "no answer", "3": "no answer"}
    assert {r["label"] for r in evaluation.mock_answers(todo).collect()} == {"unclear"}


def test_each_check_passes_and_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "n int, t string")
    twice = df.union(df)
    stamp = F.lit("2026-03-01 00:00:00").cast("timestamp")
    audit = spark.createDataFrame([(dt.datetime(2026, 1, 15), "ok")], "published_at timestamp, status string")
    total = df.agg(F.sum("n"))
    cases = {
        "not_null": (K.not_null(df.filter("n > 0"), "n"), K.not_null(df, "n")),
        "unique": (K.unique(df.union(df.filter("n is null")), "n"), K.unique(twice, "n")),
        "accepted": (K.accepted_values(df, "t", ["a", "b"]), K.accepted_values(df, "t", ["a"])),
        "relationships": (K.relationships(df, "n", df, "n"), K.relationships(df, "n", df.filter("n = 1"), "n")),
        "combination": (K.unique_combination(df, ["n", "t"]), K.unique_combination(twice, ["n", "t"])),
        "between": (K.between(df, "n", 1, 2), K.between(df, "n", 0, 1)),
        "metric": (K.metric_at_most(df.agg(F.max("n").alias("m")), "m", 2), K.metric_at_most(df.agg(F.max("n").alias("m")), "m", 1)),
        # 45 days are still fresh, 46 are not.
        "fresh": (K.fresh(audit, "published_at", 45, stamp), K.fresh(audit, "published_at", 45, stamp + F.expr("interval 1 day"))),
        "reconcile": (K.reconcile({"n": (total, total)}), K.reconcile({"n": (total, twice.agg(F.sum("n")))})),
    }
    for name, (good, bad) in cases.items():
        assert good.count() == 0 and bad.count() >= 1, name
    assert K.row_count_audit(df, twice, "t", stamp).first()["status"] == "MISMATCH"
    assert K.row_count_audit(df, df, "t", stamp).first()["status"] == "ok"
    checks = {r["check"]: r["violations"] for r in K.run(reports.publish_checks(audit, stamp)).collect()}
    assert set(checks.values()) == {0}


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, None)], "k string, n int, f boolean")
    assert [tuple(r) for r in A.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert tuple(A.share_of_total(df, "n", "pct").orderBy("n").collect()[2])[-1] == 50.0
    assert A.top_row(df, ["k"], [F.col("n")], ["n", "f"]).filter("k = 'a'").first()["f"] is False
    assert R.latest_batch(df, "n").first()["k"] == "b"
    assert R.last_write(df, "k", [F.col("n")], ["f"]).count() == 2
    assert [r["k"] for r in R.search(df, ["k", "n"], " A ", [F.desc("n")]).collect()] == ["a", "a"]
    assert R.sample_rows(df, 2).count() == 2
    dim = spark.createDataFrame([("a", "x")], "k string, v string")
    salted = J.salted_join(df, dim, ["k"], "left", salt_by=["n"], salts=4)
    assert sorted((r["n"], r["v"]) for r in salted.collect()) == [(1, "x"), (2, "x"), (3, None)]
    assert J.lookup(df, dim, "k", {"v": "none"}).filter("v = 'none'").count() == 1
    assert tuple(J.match_coverage(df, dim, ["k"], F.col("f").isNotNull()).first()) == (3, 2, 2)
    rates = A.blank_rates(spark.createDataFrame([("", "-"), ("x", None)], "a string, b string"), {"a": [""], "b": V.BLANK_MARKS})
    assert tuple(rates.first()) == (50.0, 100.0)


def test_two_models_with_one_prompt_are_two_systems(spark):
    gold = spark.createDataFrame(
        [("1", "c", "t", "supports", "unclear", "dev"), ("2", "c", "t", "opposes", "unclear", "dev")],
        "id string, company string, title string, label string, rule_label string, split string",
    )
    runs = spark.createDataFrame(
        [("a__p", "1", "supports"), ("a__p", "2", "opposes"), ("b__p", "1", "opposes"), ("b__p", "2", "maybe")],
        "run string, id string, label string",
    )
    out = evaluation.evaluate(gold, runs, "dev")
    got = {r["system"]: (r["proposals"], r["accuracy"]) for r in out["scores"].collect()}
    assert got["Rules, then a / p where rules are unclear"] == (2, 100.0)
    assert got["Rules, then b / p where rules are unclear"] == (2, 0.0)
    said = {(r["system"], r["truth"]): r for r in out["confusion"].collect()}
    assert said["b / p", "opposes"]["other"] == 1 and said["a / p", "opposes"]["other"] == 0


def test_crosstabs_keep_null_labels_and_count_what_is_not_listed(spark):
    from pyspark.errors import PySparkException

    from rollcall.operators import aggregates as A

    rows = spark.createDataFrame([(0, "x"), (None, "x"), (0, "z"), (1, None)], "a int, b string")
    got = {r["a"]: (r["x"], r["y"], r["other"]) for r in A.crosstab(rows, "a", "b", ["x", "y"], "other").collect()}
    assert got == {0: (1, 0, 1), None: (1, 0, 0), 1: (0, 0, 0)}
    both = {r["a"]: tuple(r)[1:] for r in A.crosstab_margins(rows.selectExpr("string(a) a", "b"), "a", "b", ["x", "y"], other="other").collect()}
    assert both == {"0": (1, 0, 1, 2), "All": (1, 0, 1, 2)}
    with pytest.raises(PySparkException, match="unlisted"):
        A.crosstab(rows, "a", "b", ["x", "y"]).collect()
