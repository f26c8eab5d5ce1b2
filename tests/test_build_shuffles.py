"""What the build shuffles: votes and funds meet their filings without a shuffle that an earlier one has made needless."""

import re

from pyspark.sql import functions as F

from demos import filings_analogue
from demos.registry import Tables
from rollcall.operators import aggregates as A
from rollcall.plans import marts, staging
from rollcall.session import TABLE_SETTINGS

SMALLEST = "/root/testdata/sf0.001"


def _shuffles(df, threshold="-1"):
    """The keys of all shuffles in the plan, with every join as one of two large tables."""
    spark = df.sparkSession
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def _size(text):
    return int(text.removesuffix("m"))


def test_hash_joins_are_heeded():
    # Spark compares the two, and heeds the first only if it is no smaller; the second is 64 MB by default.
    threshold = _size(TABLE_SETTINGS["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"])
    assert threshold >= _size(TABLE_SETTINGS.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))


def test_votes_are_shuffled_by_filing_once(spark):
    t = Tables(spark, SMALLEST)
    filings = staging.filings(filings_analogue.raw_filings(t))
    votes = marts.votes(staging.clean_votes(filings_analogue.raw_votes(t), filings_analogue.WINDOW), filings)
    keys = _shuffles(votes)
    # Lines and orders by accession, filings by filing_id; the joined votes not again.
    assert keys.count("accession") == 2 and keys.count("filing_id") == 1


def test_series_are_shuffled_by_filing_once(spark):
    t = Tables(spark, SMALLEST)
    filings = staging.filings(filings_analogue.raw_filings(t))
    # The suppliers alone are small.
    keys = _shuffles(marts.funds(staging.series(filings_analogue.raw_series(t)), filings), "4000")
    # Lines and orders by accession, filings by filing_id; the distinct lines and the joined series not again.
    assert keys.count("accession") == 2 and keys.count("filing_id") == 1
    assert not any("l_orderkey" in k or "o_orderkey" in k for k in keys)


def test_groups_that_hold_texts_are_sorted_by_a_number_first(spark):
    rows = spark.createDataFrame([("S1", "a"), ("S1", "b"), (None, "c"), (None, None)], "fund_id string, name string")
    folded = A.fold(rows, ["fund_id"], A.any_answer("name").alias("name"), F.count_distinct("name").alias("n"))
    assert sorted(map(tuple, folded.collect()), key=str) == [("S1", "a", 2), (None, "c", 1)]
    assert re.search(r"Sort \[_\w+#\d+L ASC", folded._jdf.queryExecution().executedPlan().toString())


def test_funds_fold_before_the_shuffle(spark):
    series = spark.createDataFrame(
        [("f1", "S1", "Old"), ("f2", "S1", "New"), ("f3", "S1", "Late"), ("f4", "S1", None), ("f5", "S2", "Undated"), ("f9", "S3", "Lost")],
        "filing_id string, fund_id string, fund_name string",
    )
    filings = spark.sql(
        """SELECT * FROM VALUES ('f1', 'c1', 'H1', 2020, date'2020-01-01'), ('f2', 'c1', 'H1', 2021, date'2021-01-01'),
        ('f2', 'c2', 'H2', 2021, date'2021-01-01'), ('f3', 'c3', 'H3', 2022, NULL), ('f4', 'c4', 'H4', 2023, date'2023-01-01'),
        ('f5', 'c5', 'H5', NULL, NULL) AS t(filing_id, filer_cik, filer_name, report_year, filed_date)"""
    )
    funds = marts.funds(series, filings)
    rows = {r["fund_id"]: r for r in funds.collect()}
    assert set(rows) == {"S1", "S2"}
    # Each value is the latest that is not missing; of equal dates the last filer wins.
    assert rows["S1"].asDict() == {
        "fund_id": "S1", "fund_name": "New", "filer_name": "H4", "filer_cik": "c4", "names_used": 3,
        "first_report_year": 2020, "last_report_year": 2023, "is_esg_named": False,
    }
    assert (rows["S2"]["fund_name"], rows["S2"]["names_used"], rows["S2"]["first_report_year"]) == (None, 1, None)
    assert not any("filer_cik" in keys for keys in _shuffles(funds))
