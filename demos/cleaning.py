"""Projection, cleaning and text operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import dates, decide, numbers, replies, text
from rollcall.operators import aggregates as A
from rollcall.operators import ranking as R
from rollcall.plans.staging import drop_headings
from rollcall.sources import filing_documents as D

from .registry import query

ANTI = "|".join(V.OPPOSES_PATTERNS)
PRO = "|".join(V.SUPPORTS_PATTERNS)


def _nested(start: str, steps) -> str:
    """SQL for a chain of global regex replacements."""
    for pattern, replacement in steps:
        start = f"regexp_replace({start}, '{pattern}', '{replacement}', 'g')"
    return start


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fund' WHEN 'O' THEN 'manager' ELSE 'unknown' END AS kind FROM orders""")
def code_decode(t):
    return t.orders.select("o_orderkey", decide.decode("o_orderstatus", {"F": "fund", "O": "manager"}, "unknown").alias("kind"))


@query("""
SELECT word, count(*) AS n FROM (SELECT CASE WHEN event_type ILIKE '%IGN%' THEN 'notice' WHEN event_type ILIKE '%i%' THEN 'combination'
  WHEN event_type ILIKE '%ERR%' THEN 'voting' ELSE 'unknown' END AS word FROM events) GROUP BY word""")
def substring_class(t):
    word = decide.first_match("event_type", [("IGN", "notice"), ("i", "combination"), ("ERR", "voting")], "unknown")
    return t.events.groupBy(word.alias("word")).agg(A.count_all().alias("n"))


@query("""
SELECT event_id, try_cast(v AS double) AS as_double, try_cast(v AS integer) AS as_int, try_cast(d AS date) AS as_date FROM (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || value WHEN 1 THEN '1,' || value WHEN 2 THEN value || '0'
    WHEN 3 THEN '1_' || floor(value)::bigint ELSE 'x' END AS v,
    CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-') || '32' END AS d FROM events)""")
def safe_casts(t):
    written = t.events.selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN concat(' ', value) WHEN 1 THEN concat('1,', value) WHEN 2 THEN concat(value, '0')"
        " WHEN 3 THEN concat('1_', floor(value)) ELSE 'x' END AS v",
        "if(event_id % 3 = 0, date_format(ts, 'yyyy-MM-dd'), concat(date_format(ts, 'yyyy-MM-'), '32')) AS d",
    )
    return written.select(
        "event_id",
        numbers.safe_double("v").alias("as_double"),
        numbers.safe_int("v").alias("as_int"),
        dates.safe_date("d").alias("as_date"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN o_orderdate::date END AS d FROM orders")
def multi_format_dates(t):
    written = t.orders.selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yy')"
        " WHEN 2 THEN date_format(o_orderdate, 'd-MMM-yyyy') WHEN 3 THEN upper(date_format(o_orderdate, 'dd-MMM-yy'))"
        " WHEN 4 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE date_format(o_orderdate, 'yyyy.MM.dd') END AS written",
    )
    return written.select("o_orderkey", dates.parse_date_any("written").alias("d"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7')")
def heading_row_filter(t):
    return drop_headings(t.nation.drop("n_regionkey"), {"n_name": ["NATION_3", "NATION_7"]})


@query("""
SELECT p_partkey, CASE WHEN length(p_brand) = 7 THEN upper(p_brand) END AS code,
  CASE WHEN length(p_name) = 9 THEN upper(p_name) END AS name_code FROM part""")
def validated_codes(t):
    spaced = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))
    return t.part.select(
        "p_partkey", text.validated_code(spaced, 7).alias("code"), text.validated_code("p_name", 9).alias("name_code")
    )


@query("""
SELECT answer, versus, proposer, count(*) AS n FROM (SELECT
  CASE l_returnflag WHEN 'A' THEN ['FOR', 'AGAINST', 'WITHHOLD', 'OTHER', 'NOT VOTED', 'UNKNOWN', '2 YEARS'][l_linenumber]
    WHEN 'N' THEN 'FOR' ELSE 'AGAINST' END AS answer,
  CASE l_returnflag WHEN 'A' THEN ['WITH', 'NONE', 'NONE', 'NONE', 'NONE', 'NONE', 'NONE'][l_linenumber]
    WHEN 'N' THEN 'WITH' ELSE 'AGAINST' END AS versus,
  CASE WHEN l_linestatus = 'O' THEN 'shareholder' WHEN l_linenumber < 4 THEN 'company' ELSE 'unknown' END AS proposer
  FROM lineitem) GROUP BY ALL""")
def standardise_values(t):
    lines = t.lineitem.select("l_returnflag", "l_linenumber", "l_linestatus")
    written = lines.selectExpr(
        "CASE l_returnflag WHEN 'A' THEN CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'AGAINST-' WHEN 3 THEN 'withold'"
        " WHEN 4 THEN 'maybe' WHEN 5 THEN 'did   not-vote' WHEN 6 THEN ' ' ELSE 'two-years' END"
        " WHEN 'N' THEN if(l_linenumber < 4, ' for', 'F') ELSE if(l_linenumber < 4, 'no', 'Against ') END AS a",
        "CASE l_returnflag WHEN 'A' THEN if(l_linenumber = 1, 'Yes', 'n/a') WHEN 'N' THEN 'for' ELSE 'A' END AS v",
        "if(l_linestatus = 'O', 'security holder ', if(l_linenumber < 4, 'Mgmt', 'other')) AS p",
    )
    keys = written.select(text.upper_key("a").alias("a"), text.upper_key("v").alias("v"), text.upper_key("p").alias("p"))
    return keys.groupBy(
        decide.standardise("a", V.ANSWERS, V.ANSWER_OTHER, V.ANSWER_BLANK).alias("answer"),
        decide.standardise("v", V.VERSUS_MANAGEMENT, "NONE").alias("versus"),
        decide.standardise("p", V.PROPOSERS, "unknown").alias("proposer"),
    ).agg(A.count_all().alias("n"))


@query("""
SELECT CASE WHEN l_shipdate::date BETWEEN date '1996-07-01' AND date '1999-12-31' THEN l_shipdate::date END AS d,
  count(*) AS n FROM lineitem GROUP BY 1""")
def date_window_clamp(t):
    day = dates.clamp_date(F.col("l_shipdate").cast("date"), "1996-07-01", "1999-12-31")
    return t.lineitem.groupBy(day.alias("d")).agg(A.count_all().alias("n"))


FLAGS_SQL = """
SELECT p_partkey, p_name LIKE '%red%' OR p_name LIKE '%blue%' AS is_coloured, p_name LIKE '%gear%' AS is_gear,
  p_name LIKE '%old%' AS is_old FROM part"""


def _flags(t):
    return t.part.select(
        "p_partkey",
        text.has_any("p_name", ["red", "blue"]).alias("is_coloured"),
        text.has_any("p_name", ["gear"]).alias("is_gear"),
        text.has_any("p_name", ["old"]).alias("is_old"),
    )


@query(FLAGS_SQL)
def topic_flags(t):
    return _flags(t)


@query(f"""
SELECT topic, count(*) AS n FROM (SELECT CASE WHEN is_coloured THEN 'Colour' WHEN is_gear THEN 'Gear' WHEN is_old THEN 'Old'
  ELSE 'Other' END AS topic FROM ({FLAGS_SQL})) GROUP BY topic""")
def topic_precedence(t):
    topic = decide.first_true([("is_coloured", "Colour"), ("is_gear", "Gear"), ("is_old", "Old")], "Other")
    return _flags(t).groupBy(topic.alias("topic")).agg(A.count_all().alias("n"))


@query("""
SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS flag, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def tri_state_bool(t):
    return t.lineitem.groupBy("l_returnflag", decide.word_to_bool("l_returnflag", "A", "R").alias("flag")).agg(
        A.count_all().alias("n")
    )


@query(r"""
SELECT p_partkey, regexp_matches(lower(p_name), '\b(red|old|gear\w*|bol)\b') AS whole,
  regexp_matches(lower(p_name), 'red|old|gear|bol') AS loose FROM part""")
def name_regex_flag(t):
    return t.part.select(
        "p_partkey",
        text.matches_word("p_name", r"red|old|gear\w*|bol").alias("whole"),
        F.lower("p_name").rlike("red|old|gear|bol").alias("loose"),
    )


@query("""
SELECT s_suppkey, regexp_matches(lower(coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_name END, '') || ' '
  || CASE WHEN s_suppkey % 5 > 0 THEN n_name END), 'nation_1|000007|nation_9') AS is_reference
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def reference_house_flag(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("fund"),
        F.when(F.col("s_suppkey") % 5 > 0, F.col("n_name")).alias("house"),
    )
    return rows.select("s_suppkey", text.matches_any_of("fund", "house", "nation_1|000007|nation_9").alias("is_reference"))


@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring brand#2')""")
def name_search(t):
    found = R.search(t.part, ["p_name", "p_brand"], " Ring Brand#2", [F.desc("p_retailprice"), F.col("p_partkey")])
    return found.select("p_partkey", "p_name", "p_brand")


RULES_SQL = f"""
SELECT doc_id, CASE WHEN regexp_matches(x, '{ANTI}') THEN 'opposes ESG' WHEN regexp_matches(x, '{PRO}') THEN 'supports ESG'
  ELSE 'unclear' END AS direction
FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\b(al|a i)\\b', 'ai', 'g') AS x
  FROM documents)"""


@query(RULES_SQL)
def keyword_rules(t):
    docs = t.documents.select("doc_id", "text")
    return docs.select("doc_id", text.rule_label("text").alias("direction"))


@query(r"""
SELECT doc_id, length(one) AS n, md5(one) AS squeezed, md5(lower(regexp_replace(one, '[ -]+', ' ', 'g'))) AS keyed,
  coalesce(nullif(upper(trim(lang)), 'EN'), 'none') AS lang,
  regexp_replace(regexp_replace('/' || source || '.v1 ' || lang || '/', '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS token
FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')) AS one FROM documents)""")
def string_cleanup(t):
    docs = t.documents.select("doc_id", "text", "lang", "source").withColumn("one", text.trim(text.squeeze("text")))
    name = F.concat(F.lit("/"), "source", F.lit(".v1 "), "lang", F.lit("/"))
    return docs.select(
        "doc_id",
        F.length("one").cast("long").alias("n"),
        F.md5("one").alias("squeezed"),
        F.md5(F.lower(text.squeeze("one", "[ -]+"))).alias("keyed"),
        F.coalesce(F.nullif(F.upper(text.trim("lang")), F.lit("EN")), F.lit("none")).alias("lang"),
        text.safe_token(name).alias("token"),
    )


@query("""
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, upper(lang)) || '|'
    || coalesce(CASE WHEN doc_id % 4 > 0 THEN '2024-01-02' END, '') || '|'
    || md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS proposal_key,
  md5(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS wording FROM documents""")
def proposal_key(t):
    docs = t.documents.select("doc_id", "text", "lang", "source").selectExpr(
        "doc_id", "text", "lang",
        "if(doc_id % 3 > 0, source, NULL) AS code",
        "if(doc_id % 4 > 0, date'2024-01-02', NULL) AS day",
    )
    return docs.select(
        "doc_id",
        text.proposal_key("code", "lang", "day", "text").alias("proposal_key"),
        F.md5(text.wording_key("text")).alias("wording"),
    )


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'supplier ' || lpad(s_suppkey::varchar, 9, '0')
  WHEN 1 THEN 'supplier ' || lpad(s_suppkey::varchar, 9, '0') || ' intl' ELSE 'supplier ' || lpad(s_suppkey::varchar, 9, '0')
  END AS company FROM supplier""")
def company_key(t):
    written = F.expr(
        "CASE s_suppkey % 4 WHEN 0 THEN concat('The ', s_name, ' Holdings, Inc.') WHEN 1 THEN concat(s_name, ' Intl. Co')"
        " WHEN 2 THEN concat(upper(s_name), ' CORPORATION (Class A)') ELSE concat(s_name, '.com Group, N.V.') END"
    )
    return t.supplier.select("s_suppkey", text.company_key(written).alias("company"))


@query("SELECT doc_id, md5(trim(regexp_replace(" + _nested("lower(text)", V.TITLE_STEPS) + ", ' +', ' ', 'g'))) AS title FROM documents")
def title_normalise(t):
    docs = t.documents.select("doc_id", "text")
    return docs.select("doc_id", F.md5(text.normalise_title("text")).alias("title"))


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'N-PX/A' ELSE 'N-PX' END AS form_type, 'House ' || o_custkey AS company,
  o_custkey::varchar AS cik, strftime(o_orderdate, '%Y-%m-%d') AS date_filed,
  lpad(o_orderkey::varchar, 10, '0') || '-' || year(o_orderdate) AS accession FROM orders WHERE o_orderkey % 7 <> 0""")
def index_line_split(t):
    lines = t.orders.selectExpr(
        "concat(if(o_orderkey % 7 = 0, 'N-PX-X', if(o_orderkey % 3 = 0, 'N-PX/A', 'N-PX')), '     House ', o_custkey, '   ',"
        " o_custkey, '  ', date_format(o_orderdate, 'yyyy-MM-dd'), '    edgar/data/', lpad(cast(o_orderkey AS string), 10, '0'),"
        " '-', year(o_orderdate), '.txt') AS value"
    )
    return D.parse_filing_index(lines)


@query("""
SELECT year(q)::integer AS year, quarter(q)::integer AS quarter, count(o_orderkey) AS filings
FROM (SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)),
  INTERVAL 3 MONTH)) AS q FROM orders) LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = q GROUP BY ALL""")
def quarter_calendar(t):
    bounds = t.orders.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    filed = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        A.count_all().alias("filings")
    )
    return D.quarters(bounds, "first", "last").join(filed, ["year", "quarter"], "left").fillna({"filings": 0})


@query("""
SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100 < 30 THEN 'dev' ELSE 'test' END AS split
FROM documents""")
def hash_split(t):
    return t.documents.select("doc_id", replies.hash_split("doc_id").alias("split"))
