"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A list names (host, path, verdict). A rule fits its host and all subdomains, where the URL's
path starts with the rule's; the longest fitting rule wins. Every URL is turned into the keys a rule for it could
have (each host suffix with each path prefix of a listed length); the filter drops the keys
that no rule has, and the exact join removes what it let through by mistake.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no
rule. Rows repeated in full come back as often as they came. Null hosts in the list are
dropped, null paths are empty; of rules repeated with different verdicts, ``block`` wins.
An empty list gives every URL the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import broadcast_below, let, lower_ascii, places

BITS_PER_RULE = 16
WORDS_IN_BLOCK = 8  # 512 bits: one cache line
PROBES = 6
# A filter of this many blocks takes 64 MB; a longer list is filtered with more false hits, not wrongly.
MOST_BLOCKS = 1 << 20
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\u0000"), path)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict): one row per listed (host, path)."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    listed = rules.where(F.col("host").isNotNull()).select(host.alias("host"), path.alias("path"), "verdict")
    return listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        rule_key(F.col("host"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length("path").alias("path_chars"),
        "verdict",
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> Column:
    """Eight longs with PROBES bits set among them, all from one second hash."""
    shift = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    none = F.lit(0).cast("long")

    def in_word(bits: list[Column], w: int) -> Column:
        out = none
        for b in bits:
            out = out.bitwiseOR(F.when(F.shiftright(b, 6) == w, shift(b.bitwiseAND(F.lit(63)))).otherwise(none))
        return out

    def words_of(second: Column) -> Column:
        bits = [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)]
        return F.array(*[in_word(bits, w) for w in range(WORDS_IN_BLOCK)])

    return let(F.xxhash64(key, F.lit(1)), words_of)


def bloom(rules: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with ``filter``: the blocks in order, each an array of eight longs; and the number of blocks."""
    blocks = min(MOST_BLOCKS, max(1, -(-count * BITS_PER_RULE // (64 * WORDS_IN_BLOCK))))
    bits = rules.select(_block(F.col("key"), blocks).alias("block"), _masks(F.col("key")).alias("m"))
    ors = [F.bit_or(F.col("m")[w]).alias(f"w{w}") for w in range(WORDS_IN_BLOCK)]
    filled = bits.groupBy("block").agg(*ors).select("block", F.array(*[f"w{w}" for w in range(WORDS_IN_BLOCK)]).alias("w"))
    every = rules.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    whole = every.join(filled, "block", "left").select(
        "block", F.coalesce("w", F.array_repeat(F.lit(0).cast("long"), WORDS_IN_BLOCK)).alias("w")
    )
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "w"))), lambda x: x["w"]).alias("filter")), blocks


def may_hold(filter_: Column, blocks: int, key: Column) -> Column:
    """Whether the filter may hold a key; never wrong about a key it holds."""
    return F.forall(
        F.zip_with(filter_[_block(key, blocks)], _masks(key), lambda have, need: have.bitwiseAND(need) == need), lambda ok: ok
    )


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that rules fitting this URL could have."""
    return let(
        F.split(host, r"\."),
        lambda labels: F.flatten(
            F.transform(
                F.when(host != "", places(F.size(labels))).otherwise(places(F.lit(0))),
                lambda i: F.transform(
                    F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
                    lambda n: rule_key(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.substring(path, F.lit(1), n)),
                ),
            )
        ),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page; ``default`` where no rule fits."""
    listed = canonical_rules(rules)
    count = listed.count()
    # One number per length of a listed path; bounded by the longest path.
    lengths = sorted(r[0] for r in listed.select("path_chars").distinct().collect())
    urls = pages.select("page_id", F.xxhash64("url").alias("same"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not count:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    one, blocks = bloom(listed, count)
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    possible = urls.withColumn("bloom", one.scalar()).withColumn(
        "possible", let(F.col("bloom"), lambda f: F.filter(keys, lambda k: may_hold(f, blocks, k)))
    )
    each = (
        possible.drop("bloom")
        .withColumn("per", F.greatest(F.size("possible"), F.lit(1)))
        .withColumn("key", F.explode_outer("possible"))
        .drop("possible")
    )
    exact = each.join(broadcast_below(listed.select("key", "rule", "verdict"), count, BROADCAST_ROWS), "key", "left")
    longest = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.length("key").alias("k"), "rule", "verdict")))
    return (
        exact.groupBy("page_id", "same", "host", "path", "per")
        .agg(longest.alias("won"), F.count(F.lit(1)).alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("per")).cast("int"))))
        .select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
    )
