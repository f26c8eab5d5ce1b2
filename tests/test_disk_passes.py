"""Tables that are written in passes, and what stays on the disk behind them."""

import time
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from demos import builds, exchange, filings_analogue
from rollcall import session
from rollcall.session import durable_dir
from rollcall.sources import filing_documents, sinks

PATTERN = r"accession=([^/]+)/"


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def gone(spark, before):
    """Whether all that was shuffled since went, but for a few numbers, as of a count."""
    for _ in range(100):
        if sum(size for name, size in shuffle_files(spark).items() if name not in before) < 2000:
            return True
        time.sleep(0.1)
    return False


@pytest.fixture
def lines(spark):
    """Orders of four lines each, among them a filing that breaks off, one with a broken table, and one without votes."""
    return spark.range(2400).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4 * 2 + 1).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"),
        (F.col("id") % 7).alias("l_suppkey"), F.lit(6.0).alias("l_quantity"), F.lit("2025-01-02").cast("timestamp_ntz").alias("l_shipdate"),
        F.lit("O").alias("l_linestatus"), F.lit("N").alias("l_returnflag"),
    )


def test_vote_files_read_in_several_passes_give_the_same_and_go(spark, lines, monkeypatch):
    orders = lines.select(F.col("l_orderkey").alias("o_orderkey"))
    store, read, written = Path(urlparse(durable_dir(spark)).path), {}, []
    write = exchange.vote_files
    monkeypatch.setattr(exchange, "vote_files", lambda t, folder, part=None: (written.append(folder), write(t, folder, part)))
    for lines_a_pass in (10_000, 500):
        monkeypatch.setattr(exchange, "LINES_A_PASS", lines_a_pass)
        votes, readings = exchange.read_back_votes(SimpleNamespace(spark=spark, lineitem=lines, orders=orders))
        assert not list(store.glob("vote-files-*"))
        read[lines_a_pass] = rows(votes), rows(readings)
    assert len(written) == 1 + 5
    assert read[500] == read[10_000]
    # Lines 5 and 7 of filings that break off or hold a broken table are lost, and filings without votes.
    lost = (exchange.CUT, exchange.MANGLED)
    kept = [(k, n) for k in range(600) for n in (1, 3, 5, 7) if k % 10 != exchange.NOTICE and not (k % 10 in lost and n > exchange.LAST_LINE)]
    assert len(read[500][0]) == sum(2 if n % 3 == 2 else 1 for _, n in kept)
    assert len(read[500][1]) == 54 and sum(status == filing_documents.UNREAD for _, status in read[500][1]) == 12


def test_vote_files_leave_no_shuffle_files(spark, lines, tmp_path):
    before = shuffle_files(spark)
    exchange.vote_files(SimpleNamespace(lineitem=lines), str(tmp_path / "out"))
    assert gone(spark, before)


def test_line_breaks_between_tables_are_not_kept(spark, tmp_path):
    file = tmp_path / "accession=A1" / "votes.xml"
    file.parent.mkdir()
    file.write_text("<proxyVoteTable>\n" + "<proxyTable><cusip>1</cusip></proxyTable>\r\n \t" * 100 + "</proxyVoteTable>")
    pieces = filing_documents._told_apart(filing_documents._pieces(spark, str(file), PATTERN))
    assert pieces.filter("table is not null").count() == 100
    assert [r.around.strip() for r in pieces.filter("around is not null").collect()] == ["<proxyVoteTable>", "</proxyVoteTable>"]
    votes, readings = filing_documents.read_votes(spark, str(file), accession_pattern=PATTERN)
    assert votes.count() == 100 and [r.status for r in readings.collect()] == [filing_documents.READ]


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    key = session._SHUFFLES_GO
    set_before, before = spark.conf.get(key), shuffle_files(spark)
    wide = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition("h")
    assert rows(session.stored(wide)) == rows(sinks.write_curated(wide, str(tmp_path / "t")))
    assert gone(spark, before)
    with session.shuffles_dropped(spark), session.shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == set_before
    with pytest.raises(ZeroDivisionError), session.shuffles_dropped(spark):
        1 / 0
    assert spark.conf.get(key) == set_before


def test_a_table_written_in_passes_is_whole(spark, tmp_path):
    given = spark.range(500).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("v"))
    given = given.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    assert rows(sinks.write_curated(given, str(tmp_path / "a"), passes=3, dealt_by=["k"])) == rows(given)
    assert rows(sinks.write_curated(given, str(tmp_path / "a"), ["k"], 2, ["v"]).select("k", "v")) == rows(given)


def test_a_build_in_passes_is_the_build(spark, monkeypatch):
    monkeypatch.setattr(filings_analogue, "LINES_A_PASS", 2500)
    t = builds.Tables(spark, "/root/testdata/sf0.001")
    lazy, kept = filings_analogue.built(t), filings_analogue.built_in_store(t)
    assert lazy.keys() == kept.keys()
    for name in ("votes", "funds", "fund_es_votes", "fund_scorecard", "topic_trends"):
        assert rows(kept[name].select(lazy[name].columns)) == rows(lazy[name]), name
