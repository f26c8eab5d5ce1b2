"""The URL filter against a plain walk over the rules."""

import random

from rollcall.llm import urls
from rollcall.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def pages(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "page_id long, url string")


def rules_table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x", "http://a.b.example.org/en/12?x#y", "http://org", "http://org/",
    "http://xorg/", "ftp://u@h.com:80/fr/", "http://x.com/de/#f", "http://x.com?/de/", "a://b://c.org/", "http://x.com/de/\nz", "http://.org/",
    "http://é.example.org/es/é",
]


def test_urls_against_a_plain_walk(spark, clashing):
    rng = random.Random(3)
    more = [f"http://{rng.choice(['a.', '', 'b.c.'])}{rng.choice(['example.org', 'x.com', 'y.net'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randint(0, 30)}" for _ in range(200)]
    found = URLS + more + URLS[4:6]
    got = urls.judge(clashing(pages(spark, found)), rules_table(spark, URL_RULES)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain(u, URL_RULES)) for i, u in enumerate(found)), key=repr)


def test_rows_repeated_in_full_come_back_as_often(spark):
    twice = spark.createDataFrame([(1, "http://a.org/es/"), (1, "http://a.org/es/"), (None, None), (None, None)], "page_id long, url string")
    assert urls.judge(twice, rules_table(spark, URL_RULES)).count() == 4


def test_many_rules(spark):
    rules = [(f"h{i}.org", "/p" * (i % 4), "block") for i in range(500)] + [(None, "/", "block"), ("h1.org", None, "block"), ("h2.org", "/p/p", "allow")]
    usable = [(h, p or "", v) for h, p, v in rules if h]
    usable = [r for r in usable if r != ("h2.org", "/p/p", "allow")]  # the same rule with block wins
    found = [f"http://x.h{i}.org/p/p/p/{i}" for i in range(0, 700, 7)]
    got = urls.judge(pages(spark, found), rules_table(spark, rules)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain(u, usable)) for i, u in enumerate(found))


def test_empty_list_and_empty_table(spark):
    none = rules_table(spark, [])
    assert {r.verdict for r in urls.judge(pages(spark, URLS), none, default="block").collect()} == {"block"}
    assert urls.judge(pages(spark, URLS).where("false"), rules_table(spark, URL_RULES)).count() == 0


def test_the_filter_holds_every_key(spark):
    from pyspark.sql import functions as F

    listed = urls.canonical_rules(rules_table(spark, [(f"h{i}.net", "/", "block") for i in range(300)]))
    one, blocks = urls.bloom(listed, 300)
    both = listed.select("key").withColumn("listed", F.lit(True)).unionByName(
        spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key"), F.lit(False).alias("listed"))
    )
    rows = both.withColumn("f", one.scalar()).groupBy("listed").agg(F.avg(urls.may_hold(F.col("f"), blocks, F.col("key")).cast("int")).alias("share")).collect()
    share = {r.listed: r.share for r in rows}
    assert share[True] == 1.0 and share[False] < 0.05
