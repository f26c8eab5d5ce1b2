"""Joins, aggregates, ordering and checks on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import decide, numbers
from rollcall.operators import aggregates as A
from rollcall.operators import checks as K
from rollcall.operators import joins as J
from rollcall.operators import profile as P
from rollcall.operators import ranking as R
from rollcall.session import durable_dir
from rollcall.sources import sinks
from rollcall.streaming import ingest

from .registry import query

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


# Joins ---------------------------------------------------------------------------


@query("""
SELECT l_returnflag, o_orderstatus, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def parent_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_returnflag", "l_quantity")
    joined = J.with_parent(lines, t.orders.select(F.col("o_orderkey").alias("key"), "o_orderstatus"), "key")
    return joined.groupBy("l_returnflag", "o_orderstatus").agg(A.count_all().alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
SELECT quality, count(*) AS n, sum(n_chars)::bigint AS chars
FROM (SELECT coalesce(quality, -1) AS quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def left_lookup_default(t):
    docs = J.lookup(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id", {"quality": -1})
    return docs.groupBy("quality").agg(A.count_all().alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT k, o_orderpriority, o_orderstatus, n, r.total FROM (SELECT CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS k,
    o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) l
  LEFT JOIN (SELECT CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS k, o_orderpriority, count(*) AS total FROM orders
    GROUP BY ALL) r ON r.k IS NOT DISTINCT FROM l.k AND r.o_orderpriority = substr(l.o_orderpriority, 1)""".replace(
    "SELECT k, o_orderpriority,", "SELECT l.k, l.o_orderpriority,"))
def null_safe_lookup(t):
    keyed = t.orders.select(
        F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")).alias("k"), "o_orderpriority", "o_orderstatus"
    )
    left = keyed.groupBy("k", "o_orderpriority", "o_orderstatus").agg(A.count_all().alias("n"))
    right = keyed.groupBy("k", "o_orderpriority").agg(A.count_all().alias("total"))
    return J.null_safe_lookup(left, right, {"k": "k"}, {"o_orderpriority": F.trim("o_orderpriority")})


@query("""
SELECT o_orderkey, l_suppkey, l_partkey, l_linenumber FROM (SELECT o_orderkey, l_suppkey, l_partkey, l_linenumber,
  dense_rank() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R') WHERE r = 1""")
def latest_filing_only(t):
    lines = t.lineitem.filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey", "l_linenumber"
    )
    rows = J.with_parent(lines, t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    latest = J.keep_latest(rows, ["o_custkey", "l_suppkey"], "o_orderkey", "o_orderdate")
    return latest.select("o_orderkey", "l_suppkey", "l_partkey", "l_linenumber")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE lang = 'en') AS with_key,
  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS with_match FROM documents""")
def match_coverage(t):
    return J.match_coverage(t.documents, t.labels.filter("toxic = 0"), ["doc_id"], F.col("lang") == "en")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_anti_join(t):
    return J.todo(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("""
SELECT count(*) AS orders, sum(o_totalprice::decimal(18, 2))::double AS total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_total(t):
    keys = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    price = F.sum(F.col("o_totalprice").cast("decimal(18, 2)")).cast("double")
    return J.semi(t.orders, keys, "o_custkey").agg(A.count_all().alias("orders"), price.alias("total"))


@query("""
SELECT s_suppkey, s_name, l.lines, p.cheap FROM supplier
LEFT JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS lines FROM lineitem GROUP BY 1) l USING (s_suppkey)
LEFT JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS cheap FROM lineitem WHERE l_extendedprice < 5000 GROUP BY 1) p
USING (s_suppkey)""")
def attach_aggregates(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    parts = [
        lines.groupBy("s_suppkey").agg(A.count_all().alias("lines")),
        lines.filter("l_extendedprice < 5000").groupBy("s_suppkey").agg(A.count_all().alias("cheap")),
    ]
    return J.attach(t.supplier.select("s_suppkey", "s_name"), parts, "s_suppkey")


# Aggregates ------------------------------------------------------------------------


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def value_counts(t):
    return A.value_counts(t.events, "event_type", "user_id")


@query("""
SELECT l_suppkey, count(*) AS votes, floor(100.0::double * count(*) FILTER (WHERE l_returnflag = 'N') / count(*) * 10 + 0.5) / 10
  AS pct_for FROM lineitem GROUP BY 1 HAVING count(*) >= 40 ORDER BY pct_for, votes DESC, l_suppkey LIMIT 25""")
def top_k_groups(t):
    rates = t.lineitem.groupBy("l_suppkey").agg(
        A.count_all().alias("votes"),
        numbers.percent(F.count_if(F.col("l_returnflag") == "N"), A.count_all(), 1).alias("pct_for"),
    )
    order = [F.asc_nulls_last("pct_for"), F.desc("votes"), F.asc("l_suppkey")]
    return R.top_k(A.having(rates, 40), order, 25)


@query("SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, 'red|old') ORDER BY p_name LIMIT 10")
def distinct_top(t):
    return R.distinct_top(t.part.filter(F.col("p_name").rlike("red|old")), "p_name", 10)


@query("""
SELECT 'orders' AS item, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem
UNION ALL SELECT 'orders with lines', count(DISTINCT l_orderkey) FROM lineitem""")
def labelled_counts(t):
    return A.labelled_counts(
        {"orders": t.orders, "lines": t.lineitem, "orders with lines": t.lineitem.select("l_orderkey").distinct()}
    )


@query("""
SELECT l_shipmonth, count(*) AS n, floor(100.0::double * count(*) / (SELECT count(*) FROM lineitem) * 100 + 0.5) / 100 AS pct
FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1""")
def share_of_total(t):
    months = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(A.count_all().alias("n"))
    return A.share_of_total(months, "n", "pct", 2)


@query("""
SELECT quality, count(*) FILTER (WHERE toxic = 0) AS "0", count(*) FILTER (WHERE toxic = 1) AS "1" FROM labels GROUP BY 1""")
def confusion_matrix(t):
    return A.crosstab(t.labels, "quality", "toxic", [0, 1])


@query("""
SELECT n_name AS nation, count(*) AS funds, sum(n)::bigint AS votes,
  floor(100.0::double * sum(n_for) / sum(n) * 100 + 0.5) / 100 AS pct_for_all_votes,
  floor(100 * avg(n_for / n::double) * 100 + 0.5) / 100 AS pct_for_average_fund
FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS n_for FROM lineitem GROUP BY 1)
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def two_level_rate(t):
    # Rates per supplier exist before any join, so the join moves suppliers and not lines.
    flags = t.lineitem.select("l_suppkey", (F.col("l_returnflag") == "N").alias("supported"))
    nations = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation")
    )
    return A.two_level_rate(flags.join(nations, "l_suppkey"), ["nation"], "l_suppkey", "supported")


@query("""
SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority, min(o_orderdate)::date AS first_day,
  max(o_orderdate)::date AS last_day, count(DISTINCT o_orderstatus) AS statuses,
  count(DISTINCT CASE WHEN o_totalprice > 250000 THEN o_orderpriority END) AS large_priorities FROM orders GROUP BY 1""")
def latest_by(t):
    return t.orders.groupBy("o_custkey").agg(
        A.latest_by("o_orderpriority", "o_orderdate", "o_orderkey").alias("last_priority"),
        F.min("o_orderdate").cast("date").alias("first_day"),
        F.max("o_orderdate").cast("date").alias("last_day"),
        F.count_distinct("o_orderstatus").alias("statuses"),
        numbers.count_distinct_where("o_orderpriority", F.col("o_totalprice") > 250000).alias("large_priorities"),
    )


@query("""
SELECT l_orderkey, l_partkey, arg_max(l_returnflag, (l_quantity, l_returnflag)) AS l_returnflag,
  bool_or(l_linestatus = 'O') AS any_open, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2""")
def settled_answers(t):
    rows = t.lineitem.withColumn("any_open", F.col("l_linestatus") == "O")
    return A.one_answer(rows, ["l_orderkey", "l_partkey"], "l_returnflag", "l_quantity", ["l_linenumber"], ["any_open"])


@query("""
SELECT p_brand, p_partkey, p_name, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC,
  p_partkey DESC) AS r FROM part) WHERE r = 1""")
def top_row(t):
    return A.top_row(t.part, ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], ["p_partkey", "p_name", "p_type"])


@query("""
SELECT p_brand, string_agg(p_name, ' || ' ORDER BY best DESC, p_name) AS names FROM (
  SELECT p_brand, p_name, max(p_retailprice) AS best,
    row_number() OVER (PARTITION BY p_brand ORDER BY max(p_retailprice) DESC, p_name) AS r FROM part GROUP BY 1, 2)
WHERE r <= 12 GROUP BY 1""")
def top_distinct_texts(t):
    return A.top_texts(t.part, ["p_brand"], "p_name", [-F.col("p_retailprice")], name="names")


# Windows and samples ---------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)")
def latest_batch(t):
    return R.latest_batch(t.events.withColumn("day", F.date_trunc("day", "ts")), "day").select("event_id", "user_id")


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE (r - 1) % 40 = 0""")
def stride_sample(t):
    return R.every_nth(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 40).select("event_id")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events) WHERE r = 1""")
def last_write_wins(t):
    return R.last_write(t.events, "user_id", [F.col("ts"), F.col("event_id")], ["event_id", "event_type"])


# Inventory, checks and ingest ----------------------------------------------------------


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n_rows, count(*)::integer AS n_columns"
    f" FROM (DESCRIBE {name})" for name in TABLES))
def table_inventory(t):
    return P.table_inventory({name: getattr(t, name) for name in TABLES})


@query("SELECT * FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NULL")
def check_not_null(t):
    docs = J.lookup(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id")
    return K.not_null(docs, "quality")


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def check_unique(t):
    return K.unique(t.lineitem, "l_orderkey")


@query("SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def check_accepted_values(t):
    return K.accepted_values(t.events, "event_type", ["view", "click"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def check_relationships(t):
    return K.relationships(t.documents.select("doc_id", "lang"), "doc_id", t.labels.filter("quality = 1"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique_combo(t):
    return K.unique_combination(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def check_between(t):
    return K.between(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0, 9000)


@query("""
SELECT pct FROM (SELECT floor(100.0::double * count(*) FILTER (WHERE event_type = 'error') / count(*) * 1000 + 0.5) / 1000 AS pct
  FROM events) WHERE pct > 1""")
def check_metric_threshold(t):
    errors = F.count_if(F.col("event_type") == "error")
    return K.metric_at_most(t.events.agg(numbers.percent(errors, A.count_all(), 3).alias("pct")), "pct", V.MAX_UNRECOGNISED_PCT)


@query("""
SELECT strftime(last_publish, '%Y-%m-%d') AS last_publish FROM (SELECT max(o_orderdate) AS last_publish FROM orders)
WHERE date_diff('day', last_publish, timestamp '2002-01-01') > 45""")
def check_freshness(t):
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    late = K.fresh(orders, "o_orderdate", V.MAX_PUBLISH_AGE_DAYS, F.lit("2002-01-01 00:00:00").cast("timestamp"))
    return late.select(F.date_format("last_publish", "yyyy-MM-dd").alias("last_publish"))


@query("""
SELECT name AS table_name, a AS local_rows, b AS cloud_rows, CASE WHEN a = b THEN 'ok' ELSE 'MISMATCH' END AS status FROM (
  SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM orders) AS b UNION ALL
  SELECT 'ordered', (SELECT count(*) FROM orders), (SELECT count(DISTINCT l_orderkey) FROM lineitem))""")
def publish_audit(t):
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    target = f"{durable_dir(t.spark)}/publish-{uuid.uuid4().hex}"
    sent = sinks.publish({"orders": t.orders}, target, stamp).drop("cloud_mb")
    short = K.row_count_audit(t.orders, t.lineitem.select("l_orderkey").distinct(), "ordered", stamp)
    return sent.unionByName(short).drop("published_at")


@query("SELECT 'a' || lpad(user_id::varchar, 9, '0') AS accession, count(*) AS votes FROM events GROUP BY 1")
def incremental_ingest(t):
    """Events written as vote files, one accession per user, and ingested in two runs."""
    place = f"{durable_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    accession = F.concat(F.lit("a"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    given = {"accession": accession, "issuer_name": F.col("event_type"), "shares_voted": F.col("value").cast("string")}
    rows = t.events.select(*[given.get(c, F.lit("")).alias(c) for c in V.VOTE_COLUMNS])
    # The two halves arrive one after the other; files are told apart by their names.
    for half in (0, 1):
        part = rows.filter(F.pmod(F.xxhash64("accession"), F.lit(2)) == half)
        part.write.mode("append").option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{place}/in")
        ingest.ingest_available(t.spark, f"{place}/in", f"{place}/votes", f"{place}/checkpoint")
    return ingest.read_ingested(t.spark, f"{place}/votes").groupBy("accession").agg(A.count_all().alias("votes"))


@query("""
SELECT s_suppkey, CASE WHEN round(a) = round(b) THEN 'same as siblings' WHEN a > b THEN 'ESG fund more supportive'
  ELSE 'ESG fund less supportive' END AS outcome, a - b AS gap, CASE WHEN n >= 20 THEN a END AS shown
FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, avg((l_returnflag = 'N')::integer) AS a,
  avg(CASE WHEN l_linestatus = 'O' THEN (l_returnflag <> 'R')::integer END) AS b FROM lineitem GROUP BY 1)""")
def rate_outcome(t):
    rates = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        A.count_all().alias("n"),
        numbers.rate(F.col("l_returnflag") == "N").alias("a"),
        numbers.rate(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O").alias("b"),
    )
    return rates.select(
        "s_suppkey", decide.outcome("a", "b").alias("outcome"), (F.col("a") - F.col("b")).alias("gap"),
        numbers.suppress("a", "n", 20).alias("shown"),
    )
