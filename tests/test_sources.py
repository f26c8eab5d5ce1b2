"""Readers, writers and incremental ingest on small files."""

import csv
import gzip
import io

import pytest
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.operators.profile import stored_size
from rollcall.sources import answers, filing_documents, sinks, text_tables
from rollcall.streaming import ingest

VOTES_XML = """<?xml version="1.0"?>
<p:proxyVoteTable xmlns:p="urn:example">
<p:proxyTable><p:issuerName>Acme
  Mining  Corp</p:issuerName><p:cusip>000123456</p:cusip><p:meetingDate>07/06/2024</p:meetingDate>
<p:voteDescription>Report on water</p:voteDescription>
<p:voteCategories><p:voteCategory><p:categoryType>ENVIRONMENT OR CLIMATE</p:categoryType></p:voteCategory>
<p:voteCategory><p:categoryType>HUMAN RIGHTS</p:categoryType></p:voteCategory></p:voteCategories>
<p:voteSource>SECURITY HOLDER</p:voteSource><p:sharesVoted>100</p:sharesVoted><p:sharesOnLoan>0</p:sharesOnLoan>
<p:vote><p:voteRecord><p:howVoted>FOR</p:howVoted><p:sharesVoted>60</p:sharesVoted>
<p:managementRecommendation>AGAINST</p:managementRecommendation></p:voteRecord>
<p:voteRecord><p:howVoted>AGAINST</p:howVoted><p:sharesVoted>40</p:sharesVoted>
<p:managementRecommendation>FOR</p:managementRecommendation></p:voteRecord></p:vote>
<p:voteManager><p:x>ignored</p:x></p:voteManager><p:voteSeries>S000000001</p:voteSeries></p:proxyTable>
<p:proxyTable><p:issuerName>No Answer Inc</p:issuerName></p:proxyTable>
"""
COVER_XML = """<?xml version="1.0"?><e:submission xmlns:e="urn:example"><e:head><e:registrantType>RMIC</e:registrantType>
<e:periodOfReport>06/30/2025</e:periodOfReport></e:head><e:form><e:reportCalendarYear>2025</e:reportCalendarYear>
<e:reportType>FUND  VOTING REPORT</e:reportType></e:form><e:s><e:r><e:idOfSeries>S1</e:idOfSeries>
<e:nameOfSeries>First &amp; Green</e:nameOfSeries></e:r><e:r><e:idOfSeries>S2</e:idOfSeries></e:r><e:r>
<e:idOfSeries>S3</e:idOfSeries><e:nameOfSeries>Third</e:nameOfSeries></e:r></e:s></e:submission>"""


def csv_text(header, rows):
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def vote_file(folder, accession, n, columns=V.VOTE_COLUMNS):
    rows = [[{"accession": accession, "issuer_name": f'The "{c}" Co, {i}', "cusip": "000123456"}.get(c, c) for c in columns]
            for i in range(n)]
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / f"{accession}.csv.gz", "wt", newline="") as handle:
        handle.write(csv_text(columns, rows))


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text(["accession", "series_id", "series_name"], [["1", "007", 'a "q", b']]))
    (tmp_path / "b.csv").write_text(csv_text(["series_name", "accession"], [["two\nlines", "2"]]))
    rows = {r["accession"]: r for r in text_tables.read_text_csv(spark, f"{tmp_path}/*.csv", V.SERIES_COLUMNS).collect()}
    assert tuple(rows["1"]) == ("1", "007", 'a "q", b')
    assert tuple(rows["2"]) == ("2", None, "two\nlines")


def test_csv_headers_of_any_length_and_shape(spark, tmp_path):
    wide = [f"column {i:05d} with a long name" for i in range(3500)] + ["accession"]  # over 90 KB
    (tmp_path / "wide.csv").write_text(csv_text(wide, [["x"] * 3500 + ["1"], ["a\nb", *["x"] * 3499, "2"]]))
    (tmp_path / "broken.csv").write_text(csv_text(["two\nlines\nof name", "accession", "series_name"], [["x", "3", "n"]]).replace("\r\n", "\n"))
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "late.csv.gz", "wt", newline="") as handle:
        handle.write("\r\n" + csv_text(["series_name", "series_id", "accession"], [["m", "s", "4"]]))
    rows = text_tables.read_text_csv(spark, f"{tmp_path}/*.csv*", V.SERIES_COLUMNS).collect()
    assert sorted(map(tuple, rows)) == [("1", None, None), ("2", None, None), ("3", None, "n"), ("4", "s", "m")]


def test_csv_files_of_many_layouts_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_tables, "BROADCAST_FILES", 0)
    for i in range(6):
        order = V.SERIES_COLUMNS[i % 3 :] + V.SERIES_COLUMNS[: i % 3]
        (tmp_path / f"{i}.csv").write_text(csv_text(order, [[f"{c}{i}" for c in order]]))
    rows = text_tables.read_text_csv(spark, str(tmp_path), V.SERIES_COLUMNS).collect()
    assert sorted(map(tuple, rows)) == [tuple(f"{c}{i}" for c in V.SERIES_COLUMNS) for i in range(6)]


def test_raw_folder_and_seed(spark, tmp_path):
    (tmp_path / "filings.csv").write_text(csv_text(V.FILING_COLUMNS, [["1"] * len(V.FILING_COLUMNS)]))
    (tmp_path / "series.csv").write_text(csv_text(V.SERIES_COLUMNS, []))
    vote_file(tmp_path / "votes", "0001-25-000001", 3)
    vote_file(tmp_path / "votes", "0001-25-000002", 2, V.VOTE_COLUMNS[::-1])
    raw = text_tables.load_raw(spark, str(tmp_path))
    assert [raw[k].count() for k in ("filings", "series", "votes")] == [1, 0, 5]
    assert {r["cusip"] for r in raw["votes"].collect()} == {"000123456"}
    (tmp_path / "seed.csv").write_text(
        "cusip,meeting_date,report_year,wording_key,proposal_id,direction,basis\n,2024-07-06,2025,,p|1,split,wording only\n")
    row = text_tables.load_seed(spark, str(tmp_path / "seed.csv"), text_tables.LABELS_SCHEMA).first()
    assert row["cusip"] is None and row["wording_key"] is None and row["report_year"] == 2025


def test_vote_xml(spark, tmp_path):
    for name, body in {"whole": VOTES_XML + "</p:proxyVoteTable>", "cut": VOTES_XML[:1000]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "table.xml").write_text(body)
    df = filing_documents.read_vote_xml(spark, f"{tmp_path}/*/table.xml")
    assert df.columns == V.VOTE_COLUMNS
    whole = sorted((r for r in df.collect() if r["accession"] == "whole"), key=lambda r: r["shares_voted"], reverse=True)
    assert [r["how_voted"] for r in whole] == ["FOR", "AGAINST", ""]
    first = whole[0]
    assert first["issuer_name"] == "Acme Mining Corp" and first["cusip"] == "000123456"
    assert first["categories"] == "ENVIRONMENT OR CLIMATE|HUMAN RIGHTS" and first["series_id"] == "S000000001"
    assert first["shares_voted_total"] == "100" and first["other_info"] == ""
    assert df.filter((F.col("accession") == "cut") & (F.col("issuer_name") == "")).count() == 0


def test_covers_and_index(spark, tmp_path):
    pages = {"f1": COVER_XML, "f2": "<not finished", "f3": COVER_XML[:200]}
    for name, body in pages.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "primary_doc.xml").write_text(body)
    covers = filing_documents.read_covers(spark, f"{tmp_path}/*/primary_doc.xml")
    rows = {r["accession"]: r for r in covers.collect()}
    good = rows["f1"]
    assert (good["registrant_type"], good["report_type"], good["report_year"]) == ("RMIC", "FUND VOTING REPORT", "2025")
    assert [tuple(s) for s in good["series"]] == [("S1", "First & Green"), ("S3", "Third")]
    for name in ("f2", "f3"):
        assert rows[name]["status"] == "no cover page" and rows[name]["series"] == [] and rows[name]["report_type"] == ""
    assert {tuple(r) for r in filing_documents.raw_series(covers).collect()} == {
        ("f1", "S1", "First & Green"), ("f1", "S3", "Third")}

    (tmp_path / "form.idx").write_text(
        "Form Type   Company\n----\nN-PX        Acme Funds  Trust    1234    2025-08-01  edgar/data/1234/f1.txt\n"
        "N-PX/A      Other Co    55    2025-08-02  edgar/data/55/f9.txt\nN-PX-X      No    1    2  x/y.txt\nN-PX  short\n")
    index = filing_documents.read_filing_index(spark, str(tmp_path / "form.idx"))
    got = sorted(tuple(r) for r in index.collect())
    assert len(got) == 1 or got[0][0] == "N-PX"
    filings = {r["accession"]: r for r in filing_documents.raw_filings(index, covers).collect()}
    assert filings["f9"]["status"] == "no cover page" and filings["f9"]["form_type"] == "N-PX/A"
    assert filings["f9"]["series_count"] == "0"


def test_last_answer_wins(spark, tmp_path):
    (tmp_path / "m__p.jsonl").write_text('{"id": "a", "label": "x"}\n\n{"id": "b", "label": "y"}\n{"id": "a", "label": "z"}\n')
    got = {(r["run"], r["id"]): r["label"] for r in answers.read_labels_jsonl(spark, f"{tmp_path}/*.jsonl").collect()}
    assert got == {("m__p", "a"): "z", ("m__p", "b"): "y"}
    for label in ("first", "second"):
        sinks.append_jsonl(spark.createDataFrame([("a", label)], "id string, label string"), str(tmp_path / "run"))
    assert answers.read_run(spark, str(tmp_path / "run")).first()["label"] == "second"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "n int, t string")
    back = sinks.write_curated(df, str(tmp_path / "t"))
    assert back.count() == 2
    assert stored_size(spark, str(tmp_path / "t")).first()[0] is not None
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 1
    assert sinks.materialise(df, "some_view", "view").count() == spark.table("some_view").count()

    stamp = F.lit("2026-01-02 03:04:05").cast("timestamp")
    plan = sinks.publish({"t": df}, str(tmp_path / "out"), stamp, dry_run=True)
    assert plan.first()["local_rows"] == 2 and not (tmp_path / "out").exists()
    audit = sinks.publish({"t": df, "u": df.limit(1)}, str(tmp_path / "out"), stamp)
    assert {(r["table_name"], r["status"], r["cloud_rows"]) for r in audit.collect()} == {("t", "ok", 2), ("u", "ok", 1)}
    assert sinks.publish({"t": df}, str(tmp_path / "out"), stamp).count() == 3


def test_each_file_is_ingested_once(spark, tmp_path):
    folder, target, audit = tmp_path / "in", str(tmp_path / "votes"), str(tmp_path / "audit")

    def run(checkpoint="cp"):
        return ingest.ingest_available(spark, str(folder), target, str(tmp_path / checkpoint), audit=audit)

    vote_file(folder, "0001-25-000001", 3)
    vote_file(folder, "0001-25-000002", 2, V.VOTE_COLUMNS[::-1])
    assert run() == {"new_vote_files": 2, "new_votes": 5, "total_votes": 5}
    assert run() == {"new_vote_files": 0, "new_votes": 0, "total_votes": 5}
    vote_file(folder, "0001-25-000003", 4)
    vote_file(folder, "0001-25-000004", 0)
    assert run() == {"new_vote_files": 2, "new_votes": 4, "total_votes": 9}
    # A lost checkpoint offers every file again; only the empty one is not known yet.
    assert run("another") == {"new_vote_files": 1, "new_votes": 0, "total_votes": 9}
    rows = ingest.read_ingested(spark, target)
    assert rows.columns == V.VOTE_COLUMNS
    assert rows.groupBy("accession").count().count() == 3
    assert {r["status"] for r in spark.read.parquet(audit).collect()} == {"ok"}


def test_refresh_logs_every_run(spark, tmp_path):
    vote_file(tmp_path / "in", "0001-25-000001", 3)
    args = [str(tmp_path / d) for d in ("in", "votes", "cp", "log")]
    ingest.refresh(spark, *args, then=lambda votes: votes.count())

    def fail(_):
        raise RuntimeError("rebuild failed")

    with pytest.raises(RuntimeError):
        ingest.refresh(spark, *args, then=fail)
    log = spark.read.schema(ingest.RUN_SCHEMA).json(args[3]).orderBy("run_at").collect()
    assert [(r["status"], r["new_votes"], r["total_votes"]) for r in log] == [("ok", 3, 3), ("failed", 0, 3)]


def table_xml(name, tag="p:proxyTable"):
    return f"<{tag}><p:issuerName>{name}</p:issuerName><p:vote><p:voteRecord><p:howVoted>FOR</p:howVoted></p:voteRecord></p:vote></{tag.split()[0]}>"


VOTE_PAGES = {
    # filing: (pages, issuers that are read, whether all of it could be read)
    "whole": ([f"<?xml version='1.0'?>\n<!-- a --><p:votes xmlns:p='u'>\n{table_xml('A')} <!-- b -->\n{table_xml('B')}</p:votes>\n<!-- c -->"], "AB", True),
    "plain": ([f"<votes>{table_xml('A', 'proxyTable')}<other><x>1</x></other>{table_xml('B', 'proxyTable')}</votes>"], "AB", True),
    "attributes": ([f"<p:votes xmlns:p='u'>{table_xml('A', 'p:proxyTable id=\"1\"')}\n<p:note/>{table_xml('B', 'p:proxyTable id=\"2\"')}</p:votes>"], "AB", True),
    "blank": (["<p:votes xmlns:p='u'><p:proxyTable/><p:proxyTable id='1' /><p:proxyTable></p:proxyTable></p:votes>"], ["", "", ""], True),
    "none": (["<p:votes xmlns:p='u'/>", "<p:votes xmlns:p='u'></p:votes>"], "", True),
    "cut": ([f"<p:votes xmlns:p='u'>{table_xml('A')}{table_xml('B')[:40]}"], "A", False),
    "cut-behind": ([f"<p:votes xmlns:p='u'>{table_xml('A')}{table_xml('B')}"], "AB", False),
    "cut-name": ([f"<p:votes xmlns:p='u'>{table_xml('A')}</p:vot"], "A", False),
    "mangled": ([f"<p:votes xmlns:p='u'>{table_xml('A')}{table_xml('B & C')}{table_xml('D')}</p:votes>"], "A", False),
    "crossed": ([f"<p:votes xmlns:p='u'>{table_xml('A')}<p:proxyTable><p:cusip></p:isin></p:proxyTable>{table_xml('D')}</p:votes>"], "A", False),
    "one-of-two": ([f"<p:votes xmlns:p='u'>{table_xml('A')}</p:votes>", ""], "A", False),
    "no-xml": (["no votes here"], "", False),
    "notice": ([f"<p:votes xmlns:p='u'>{table_xml('A')}</p:votes>"], None, None),
}


@pytest.mark.parametrize("split", [None, "64"])
def test_vote_files_and_how_their_reading_ended(spark, tmp_path, split):
    for name, (pages, *_) in VOTE_PAGES.items():
        (tmp_path / name).mkdir()
        for i, page in enumerate(pages):
            (tmp_path / name / f"{i}.xml").write_text(page)
    covers = spark.createDataFrame([(n, "notice" if n == "notice" else "Fund Voting Report") for n in VOTE_PAGES], "accession string, report_type string")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        votes, readings = filing_documents.read_votes(spark, f"{tmp_path}/*/*.xml", covers)
        rows = votes.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {n: sorted(r["issuer_name"] for r in rows if r["accession"] == n) for n in VOTE_PAGES}
    assert got == {n: sorted(issuers or []) for n, (_, issuers, _) in VOTE_PAGES.items()}
    status = {r["accession"]: r["status"] for r in readings.collect()}
    assert status == {n: filing_documents.READ if fine else filing_documents.UNREAD for n, (_, _, fine) in VOTE_PAGES.items() if fine is not None}


def test_reading_status_reaches_the_filings(spark):
    index = spark.createDataFrame([(n, "N-PX", "1", "c", "d") for n in ("a", "b", "c")], "accession string, form_type string, cik string, company string, date_filed string")
    covers = filing_documents.parse_cover(filing_documents.cover_xml(spark.createDataFrame(
        [(n, "RMIC", "FUND VOTING REPORT", "06/30/2025", "2025", [("S1", "A & B")]) for n in ("a", "b")],
        "accession string, registrant_type string, report_type string, period_of_report string, report_year string, series array<struct<series_id:string,series_name:string>>")))
    readings = spark.createDataFrame([("a", filing_documents.READ), ("b", filing_documents.UNREAD)], "accession string, status string")
    rows = {r["accession"]: r["status"] for r in filing_documents.raw_filings(index, covers, readings).collect()}
    assert rows == {"a": "ok", "b": "a table could not be read", "c": "no cover page"}


def test_headers_are_read_without_the_rest_of_a_file(spark, tmp_path):
    (tmp_path / "a b.csv").write_text(csv_text(["accession", "series_id"], [["1", "x" * 90]] * 60_000))
    with gzip.open(tmp_path / "long.csv.gz", "wt", newline="") as handle:
        handle.write(csv_text(["series_id", "accession"], [["x" * 90, "1"]] * 60_000))
    (tmp_path / "open.csv").write_text('accession,"series_id\n')
    (tmp_path / "late.csv").write_text(' \n\n"two ""quoted""\nlines",accession\n1,2\n')
    (tmp_path / "empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = text_tables.headers(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("headers")  # no scan of any file
    assert {f.rsplit("/", 1)[1]: h for f, h in found.items()} == {
        "a%20b.csv": "accession,series_id", "long.csv.gz": "series_id,accession", "open.csv": 'accession,"series_id', "late.csv": '"two ""quoted""\nlines",accession',
    }
    both = [str(tmp_path / "a b.csv"), str(tmp_path / "long.csv.gz")]
    assert text_tables.read_text_csv(spark, both, V.SERIES_COLUMNS).filter("accession = '1'").count() == 120_000
