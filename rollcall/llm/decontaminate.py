"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of ``n`` words of the training text is hashed and looked up in the set of the
benchmark's windows, which travels with the plan; a hit is verified word by word in the same
row. Nothing is exploded but verified hits, and no text is shuffled.

Defined results: null and empty texts have no words and are never hit. A benchmark item of
fewer than ``n`` words, but not none, is one window of its length; items without words match
nothing. Items with null ids or repeated items count like others (a null id is not reported).
Documents repeated with the same id and text come back as often as they came; other columns
of either table play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import broadcast_below, hex_digest, let, places, words

WINDOW = 10
# Windows that one pass holds as its broadcast set (about 100 bytes each, so 2 MB). A larger
# benchmark takes more passes over the documents, each with its share of the windows.
SET_ROWS = 20_000
# Rows of (window, items) that may be broadcast to name the items; beyond, Spark chooses.
BROADCAST_ROWS = 100_000


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(gram, len, key, item_ids): each distinct window of the benchmark with the items that hold it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = items.select("item_id", "w", F.explode(places(F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("p"))
    gram = F.slice("w", F.col("p"), F.least(F.size("w"), F.lit(n)))
    return (
        spans.select("item_id", gram.alias("g"))
        .select("item_id", F.array_join("g", " ").alias("gram"), F.size("g").alias("len"), window_key(word_keys(F.col("g"))).alias("key"))
        .groupBy("gram", "len", "key")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def word_keys(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def window_key(keys: Column) -> Column:
    """One hash for a window, from the hashes of its words."""
    return F.xxhash64(keys)


def hits(ws: Column, windows: list[tuple[str, int, int]]) -> Column:
    """Array of (start, len, gram): where one of ``windows`` (gram, len, key) stands in the words; starts count from 1."""
    kind = "array<struct<start:int,len:int,gram:string>>"
    by_len: dict[int, list[tuple[str, int]]] = {}
    for gram, length, key in windows:
        by_len.setdefault(length, []).append((gram, key))
    if not by_len:
        return F.array().cast(kind)

    def of_length(ws: Column, hs: Column, length: int, known: list[tuple[str, int]]) -> Column:
        grams, keys = sorted({g for g, _ in known}), sorted({k for _, k in known})
        gram_at = lambda i: F.array_join(F.slice(ws, i, length), " ")
        found = F.filter(
            places(F.size(ws) - length + 1),
            lambda i: window_key(F.slice(hs, i, length)).isin(keys) & gram_at(i).isin(grams),
        )
        return F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(length).alias("len"), gram_at(i).alias("gram")))

    return let(
        ws, lambda ws: let(word_keys(ws), lambda hs: F.concat(*[of_length(ws, hs, n, known) for n, known in sorted(by_len.items())]))
    ).cast(kind)


def covered(found: Column) -> Column:
    """How many words stand inside any of the (start, len) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"] - 1
        new = F.greatest(F.lit(0), end - F.greatest(h["start"], acc["upto"] + 1) + 1)
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(found), start, step)["n"].cast("long")


def passes(windows: DataFrame) -> tuple[int, list[list[tuple[str, int, int]]]]:
    """The number of windows, and the windows by pass: SET_ROWS or so for each, by hash."""
    total = windows.count()
    n = max(1, -(-total // SET_ROWS))
    # A pass's windows are bounded by SET_ROWS; they become literals of its plan.
    return total, [
        [tuple(r) for r in windows.where(F.pmod("key", F.lit(n)) == p).select("gram", "len", "key").collect()] for p in range(n)
    ]


def scan(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``_found``, an array of verified hits (start, len, gram), and the number of windows."""
    total, chunks = passes(windows)
    ws = words(F.col("text"))
    found = let(ws, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), reduce(F.concat, [hits(ws, c) for c in chunks]).alias("at")))
    return docs.withColumn("_found", found), total


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document: its words, hit words, and the benchmark items whose windows it holds."""
    windows = item_windows(benchmark, n)
    found, total = scan(docs.select("doc_id", "text"), windows)
    rows = found.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        F.col("_found.n").alias("n_words"),
        let(F.col("_found.at"), covered).alias("n_hit"),
        F.array_distinct(F.transform("_found.at", lambda h: h["gram"])).alias("grams"),
    )
    each = rows.withColumn("per", F.greatest(F.size("grams"), F.lit(1))).withColumn("gram", F.explode_outer("grams")).drop("grams")
    named = each.join(broadcast_below(windows.select("gram", "item_ids"), total, BROADCAST_ROWS), "gram", "left")
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("item_ids"))), lambda i: i.cast("string")))
    return (
        named.groupBy("doc_id", "same", "n_words", "n_hit", "per")
        .agg(ids.alias("ids"), F.count(F.lit(1)).alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("per")).cast("int"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("ids").cast("long").alias("n_items"),
            hex_digest(F.array_join("ids", ",")).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, spans: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; or, with ``spans``, without the hit words alone.

    Cutting spans keeps all other characters as they were, and the breaks after a hit word go with it.
    """
    found, _ = scan(docs, item_windows(benchmark, n))
    hit = F.size("_found.at") > 0
    if not spans:
        return found.where(~hit).drop("_found")
    return found.withColumn("text", F.when(hit, _without(F.col("text"), F.col("_found.at"))).otherwise(F.col("text"))).drop("_found")


def _without(text: Column, found: Column) -> Column:
    breaks = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # WORD_BREAK for text that keeps its capitals
    lead = F.regexp_extract(text, f"^{breaks}", 0)
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    merged = F.aggregate(
        F.array_sort(found),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, h: let(
            F.struct(h["start"].alias("a"), (h["start"] + h["len"] - 1).alias("b")),
            lambda s: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"] - 1),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))),
                ),
            ).otherwise(F.concat(acc, F.array(s))),
        ),
    )
    return let(
        merged,
        lambda cuts: F.concat(
            lead,
            F.array_join(F.filter(pieces, lambda p, i: ~F.exists(cuts, lambda c: (i + 1 >= c["a"]) & (i + 1 <= c["b"]))), ""),
        ),
    )
