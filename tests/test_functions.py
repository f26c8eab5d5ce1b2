"""Cleaning functions on hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import dates, decide, numbers, replies, text


def apply(spark, column, values, schema="x string"):
    """The results of a column expression over ``x``, in input order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["y"] for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


def test_answers_are_standardised(spark):
    cases = {
        "For": "FOR", " f ": "FOR", "YES": "FOR", "for  all": "FOR", "With-hold": "OTHER", "WITHHELD": "WITHHOLD",
        "1-Year": "1 YEAR", "1YR": "1 YEAR", "1.0": "1 YEAR", "one year": "1 YEAR", "Non-Voting": "NOT VOTED",
        "N/A": "NOT VOTED", "TNA": "NOT VOTED", "": "UNKNOWN", None: "UNKNOWN", "maybe": "OTHER",
    }
    got = apply(spark, decide.standardise(text.upper_key("x"), V.ANSWERS, V.ANSWER_OTHER, V.ANSWER_BLANK), cases)
    assert got == list(cases.values())


def test_dates_in_many_layouts(spark):
    day = dt.date(2024, 7, 6)
    cases = {
        "7/6/2024": day, "07/06/24": day, "6-Jul-2024": day, "6-jul-24": day, "20240706": day,
        "02/30/2024": None, "2024-07-06": None, None: None, "01/05/99": dt.date(1999, 1, 5), "": None,
    }
    assert apply(spark, dates.parse_date_any("x"), cases) == list(cases.values())


def test_dates_outside_the_window_are_dropped(spark):
    got = apply(spark, dates.clamp_date(dates.parse_date_any("x"), *V.MEETING_WINDOW),
                ["01/01/2019", "07/01/2023", "12/31/2026", "01/01/2027"])
    assert got == [None, dt.date(2023, 7, 1), dt.date(2026, 12, 31), None]


def test_numbers_from_text(spark):
    assert apply(spark, numbers.safe_double("x"), ["1,000", " 12.5 ", "12d", "1e3", "x", None, "inf"]) == [
        None, 12.5, None, 1000.0, None, None, float("inf")]
    assert apply(spark, numbers.safe_int("x"), ["2025", "2025.0", "2024.5", "x", None]) == [2025, 2025, 2025, None, None]


def test_rounding(spark):
    assert apply(spark, numbers.round_half_up("x", 2), [1.005, 2.675, -1.255, -0.001, None], "x double") == [
        1.0, 2.68, -1.25, 0.0, None]
    assert apply(spark, numbers.round_half_up("x", 1), [0.25, 0.35, -0.25, 2.0], "x double") == [0.3, 0.4, -0.3, 2.0]
    assert apply(spark, numbers.round_half_even("x", 1), [0.25, 0.35, 59.94], "x double") == [0.2, 0.4, 59.9]


def test_identifiers(spark):
    assert apply(spark, text.validated_code("x", 9), ["000123456", " 00012345a ", "123", None]) == [
        "000123456", "00012345A", None, None]


def test_trim_strips_unicode_spaces_only(spark):
    assert apply(spark, text.trim("x"), ["  a ", "\ta "]) == ["a", "\ta"]


def test_theme_words_need_ascii_boundaries(spark):
    # An accented letter is no word character here, so it ends a word.
    cases = {
        "Growth Greenway": False, "Green Bond": True, "Sustainable Équité": True, "Éesg Fund": True,
        "esgx": False, "x_esg": False, None: None,
    }
    assert apply(spark, text.matches_word("x", V.THEME_WORDS), cases) == list(cases.values())


def test_reference_house_tolerates_a_missing_fund_name_only(spark):
    rows = spark.createDataFrame([(None, "Domini Trust"), ("Calvert X", None), ("a", "b")], "f string, h string")
    got = [r[0] for r in rows.select(text.matches_any_of("f", "h", V.REFERENCE_HOUSES)).collect()]
    assert got == [True, None, False]


def similarity(spark, a, b):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    sets = [text.word_set(text.normalise_title(c)) for c in ("a", "b")]
    return rows.select(text.title_similarity(*sets)).first()[0]


def test_similarity_of_titles(spark):
    long = "3. Stockholder Proposal Regarding Report on Water Use"
    assert similarity(spark, long, "Report on water use (4)") >= 0.9
    assert similarity(spark, "Report on water use", "Independent chair policy") < 0.5
    assert similarity(spark, "", "water use") == 0.0
    assert similarity(spark, "water", "water use plan") == pytest.approx(1 / 3)
    assert similarity(spark, "Al oversight", "A.I. oversight") == pytest.approx(1.0)


def test_company_names_match_across_spellings(spark):
    got = apply(spark, text.company_key("x"),
                ["Example Holdings, Inc.", "EXAMPLE HOLDING INC", "The Sample-Widget Company", "Sample Widget Co."])
    assert got[0] == got[1] == "example" and got[2] == got[3] == "sample widget"


def test_opposing_rules_win(spark):
    got = apply(spark, text.rule_label("x"), [
        "Report on methane emissions", "Report on risks created by the company's diversity, equity and inclusion goals",
        "Revisit packaging goals", "Independent chair", "Cease DEI programmes", "Report on Al oversight"])
    assert got == [V.SUPPORTS, V.OPPOSES, V.OPPOSES, V.UNCLEAR, V.OPPOSES, V.SUPPORTS]


def test_arranged_patterns_find_what_a_flat_list_finds(spark):
    lists = [V.OPPOSES_PATTERNS, V.SUPPORTS_PATTERNS, V.OPPOSES_PATTERNS + V.SUPPORTS_PATTERNS, [r"\bab\b", "a?b", "c", "cd"]]
    cases = [None, "", "ab", "xab", "ab x", "b", "cd", "roi", "heroic", "the roi ", "dei", "deity", "ghg x", "h 1b"]
    for part in {a for patterns in lists for a in text._alternatives("|".join(patterns))}:
        said = part.replace("\\b", "").replace("?", "").replace("\\w*", "e").replace(".*", " and ")
        said = said.replace("(", "").replace(")", "").replace("|", " ")
        cases += [said, "x" + said, said + "x", said[1:], said[:-1]]
    for patterns in lists:
        arranged = apply(spark, F.col("x").rlike(text.any_of(patterns)), cases)
        assert arranged == apply(spark, F.col("x").rlike("|".join(patterns)), cases)


def test_titles_lose_what_the_steps_name(spark):
    cases = [
        None, "", "  ", "Item 4a) Report on the Al risks", "A.I. and a i (4)  ", "at the 2024 annual meeting",
        "If properly presented at the 2024 annual meeting of Sample", "at the annual shareholder meeting",
        "s h sh shp shareholders shareholdersx xshp", "security-holder non-binding", "a\0b", "boards' reports", "\u0661 \u00e9t\u00e9",
    ]
    steps = F.lower("x")
    for pattern, replacement in V.TITLE_STEPS:
        steps = F.regexp_replace(steps, "(?U)" + pattern, replacement)
    got = apply(spark, text.normalise_title("x"), cases)
    assert got == apply(spark, F.trim(F.regexp_replace(steps, " +", " ")), cases)
    assert got[3:6] == ["ai risks", "ai ai", "at 2024 meeting"]


def test_symbols_go_from_any_text(spark):
    cases = ["A-b\0c", "\u00c9t\u00e9 1", "\u212aelvin", "", None, "a\tb  c"]
    pattern = F.regexp_replace(F.lower("x"), "[^a-z0-9 ]", "#")
    assert apply(spark, text.plain("x", "#"), cases) == apply(spark, pattern, cases)


def test_thresholds_and_resolution(spark):
    rows = spark.createDataFrame(
        [(0, 2, 100.0), (1, 5, 60.0), (2, 5, 59.94), (3, 5, 15.0), (4, 5, 40.0), (5, 5, 59.95)], "i int, n int, pct double"
    )
    label = decide.threshold_label("pct", "n")
    out = rows.select("i", decide.resolve(label, F.lit(V.SUPPORTS)).alias("r")).orderBy("i").select("r.*").collect()
    assert [tuple(r) for r in out] == [
        (V.SUPPORTS, V.BY_WORDING), (V.SUPPORTS, V.BY_REFERENCE), (V.SPLIT, V.BY_REFERENCE),
        (V.OPPOSES, V.BY_REFERENCE), (V.SPLIT, V.BY_REFERENCE), (V.SUPPORTS, V.BY_REFERENCE)]


def test_replies(spark):
    good = 'Sure:\n{"labels": [{"id": "a", "label": " Supports "}, {"id": 7, "label": "opposes"},' \
           ' {"id": "b", "label": "yes"}, {"label": "unclear"}]} done'
    cases = [good, "no json", '{"labels": [}', '{"other": 1}', None]
    got = apply(spark, replies.parse_labels("x"), cases)
    assert [tuple(p) for p in got[0]] == [("a", "supports"), ("7", "opposes")]
    assert got[1] == [] and got[2] == [] and got[3] == []


def test_bands_bins_and_suppression(spark):
    assert apply(spark, numbers.band("x", V.SUPPORT_BANDS), [0.0, 0.1, 0.3, 0.5, 0.75, 1.0], "x double") == [
        "a) under 10%", "b) 10 to 25%", "c) 25 to 50%", "d) 50 to 75%", "e) 75% and over", "e) 75% and over"]
    assert apply(spark, numbers.equal_bins("x"), [0.0, 4.99, 5.0, 100.0], "x double") == [0, 0, 1, 19]
    assert apply(spark, numbers.suppress(F.lit(1.5), "x", 20), [19, 20], "x int") == [None, 1.5]


def test_keys_and_tokens(spark):
    assert apply(spark, text.safe_token("x"), ["maker/model-1.0", "--a--"]) == ["maker-model-1-0", "a"]
    assert apply(spark, text.shape("x"), ["07/06/24", "6-Jul"]) == ["99/99/99", "9-aaa"]
    rows = spark.createDataFrame(
        [("1", "Acme", dt.date(2024, 1, 2), "Report!"), (None, "Acme", None, "re port"), (None, None, None, "x")],
        "c string, n string, d date, t string")
    keys = [r[0] for r in rows.select(text.proposal_key("c", "n", "d", "t")).collect()]
    assert keys[0].startswith("1|2024-01-02|") and keys[1].startswith("ACME||") and keys[2] is None
    assert keys[0].split("|")[2] == keys[1].split("|")[2]


def test_hash_split_is_stable(spark):
    got = apply(spark, replies.hash_split("x"), [str(i) for i in range(200)])
    assert got == apply(spark, replies.hash_split("x"), [str(i) for i in range(200)])
    assert 30 <= got.count("dev") <= 90


def test_shared_starts_match_the_same_texts(spark):
    import re

    for patterns in (V.OPPOSES_PATTERNS, V.SUPPORTS_PATTERNS):
        flat, grouped = "|".join(patterns), text.any_of(patterns)
        words = ["risk", "risks of esg", "de bank", "debank", "h 1b", "nonfiduciary", "anti esg", "roi", "heroic", "paris",
                 "dei", "deity", "coal", "coalition", "water", "waterfall", "cost of net zero", "lgbtq risk", "eliminate the goals",
                 "eliminates", "ai board", "ai", "c", "", "gun", "begun", "tax practices", "vote", "voters"]
        for word in words:
            assert bool(re.search(flat, word)) == bool(re.search(grouped, word)), word


def test_symbols_go_without_a_bound_variable(spark):
    # A bound variable is evaluated outside the compiled code, row by row.
    texts = ["Héllo, World-2!", "PLAIN & simple", "a\0b", "Kelvin", "", None, "tab\there", "Straße  №5"]
    for symbol, spaces, pattern in [(" ", True, r"[^a-z0-9 ]"), ("", True, r"[^a-z0-9 ]"), ("", False, r"[^a-z0-9]")]:
        want = apply(spark, F.regexp_replace(F.lower("x"), pattern, symbol), texts)
        assert apply(spark, text.plain("x", symbol, spaces), texts) == want
        assert apply(spark, text.swap_symbols(F.lower("x"), symbol, spaces), texts) == want
    plan = spark.range(1).selectExpr("cast(id AS string) AS x").select(text.wording_key("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
