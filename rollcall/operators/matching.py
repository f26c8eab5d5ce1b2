"""Leader clustering of word sets inside blocks: exact, whatever the size of a block.

Rows are taken in rank order; each joins the best earlier leader that scores at
least the threshold (the earliest on ties), or becomes a leader itself. Only
leaders influence later rows, and a copy of an earlier word set never becomes one.
So the work is done once per distinct word set.

Two sets that reach the threshold share so many words that one of the rarest of the smaller set, as many as its
size leaves over, must be in the other. These words are its keys: sets meet on them by an equi join, and only sets that
meet are scored. Leaders are found in rounds. The first ``chunk`` sets of each block are folded in one task, which is
all that most blocks need. What no leader has taken goes on to further rounds of twice as many sets each, which are
compared with each other by their keys. At last all sets meet all leaders by their keys, once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions.numbers import bind
from rollcall.functions.text import similarity_from, word_overlap
from rollcall.session import cut_lineage

from .joins import salted_join
from .ranking import with_position

# Word sets of one block that are folded in one task, and that a later round takes at most.
CHUNK, MOST = 256, 8192
_SET = ["_block", "_node", "words", "keys", "first"]


def _score(a: Column, b: Column) -> Column:
    """Similarity; the shared-word count is bound, as a lambda shares no common subexpressions."""
    return bind(word_overlap(a, b), lambda shared: similarity_from(shared, F.size(a), F.size(b)))


def _joins(score: Column, threshold: float) -> Column:
    return (score > 0) & (score >= threshold)


def _shared_at_least(size: Column, threshold: float) -> Column:
    """How many words a set shares with any larger one that it reaches the threshold with."""
    jaccard = F.lit(2 * threshold / (1 + threshold)) * size
    overlap = F.when(size >= 2, F.lit(threshold / V.OVERLAP_WEIGHT) * size)
    return F.greatest(F.lit(1), F.ceil(F.least(jaccard, overlap) - 1e-6).cast("int"))


def _keyed(nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` with their ``keys``: the words that are rarest in the block, one of which any match has to share."""
    said = nodes.select("_block", "_node", F.explode("words").alias("word"))
    known = said.groupBy("_block", "word").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = said.join(known, ["_block", "word"]).groupBy("_block", "_node").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("rare"))
    enough = F.size("rare") - _shared_at_least(F.size("rare"), threshold) + 1
    keys = by_rarity.select("_block", "_node", F.transform(F.slice("rare", F.lit(1), enough), lambda r: r["word"]).alias("keys"))
    none = F.array().cast("array<string>")
    return nodes.join(keys, ["_block", "_node"], "left").withColumn("keys", F.coalesce("keys", none))


def _matches(sets: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a set and another one (its columns begin with ``o_``) that reach the threshold, each once, with ``score``."""
    renamed = others.select(*[F.col(c).alias(c if c == "_block" else f"o_{c}") for c in others.columns])

    def met(mine: str, theirs: str, small: str, large: str, sizes: Column) -> DataFrame:
        left = sets.withColumn("_met", F.explode(mine))
        pairs = left.join(renamed.withColumn("_met", F.explode(theirs)), ["_block", "_met"])
        # A pair that shares several keys is taken at the first of them.
        return pairs.filter(sizes & (F.col("_met") == F.get(F.array_intersect(F.col(small), F.col(large)), F.lit(0))))

    pairs = met("keys", "o_words", "keys", "o_words", F.size("words") <= F.size("o_words")).unionByName(
        met("words", "o_keys", "o_keys", "words", F.size("words") > F.size("o_words"))
    )
    scored = pairs.drop("_met").withColumn("score", _score(F.col("words"), F.col("o_words")))
    return scored.filter(_joins(F.col("score"), threshold))


def _folded(head: DataFrame, threshold: float, rank_type: str) -> DataFrame:
    """The leaders among a bounded number of sets of each block, by a fold in rank order."""
    own = f"struct<first:{rank_type},_node:string,words:array<string>,keys:array<string>>"

    def step(leaders: Column, item: Column) -> Column:
        taken = F.exists(leaders, lambda h: _joins(_score(h["words"], item["words"]), threshold))
        return F.when(taken, leaders).otherwise(F.concat(leaders, F.array(item)))

    items = F.sort_array(F.collect_list(F.struct("first", "_node", "words", "keys"))).cast(f"array<{own}>")
    leaders = F.aggregate(items, F.array().cast(f"array<{own}>"), step)
    return head.groupBy("_block").agg(leaders.alias("l")).select("_block", F.inline("l")).select(*_SET)


def _without(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("_block", "_node"), ["_block", "_node"], "left_anti")


def _unlike(head: DataFrame, threshold: float) -> DataFrame:
    """The leaders among sets of which many are unlike: those that match no earlier leader, from the matches alone."""
    later = _matches(head, head, threshold).filter(F.col("o_first") < F.col("first"))
    links = cut_lineage(later.select("_block", "_node", "o__node"))
    open_, found = head, []
    while not links.isEmpty():
        # What no open set before it matches leads; what matches a leader is taken.
        lead = cut_lineage(_without(open_, links))
        found.append(lead)
        taken = links.join(lead.select("_block", F.col("_node").alias("o__node")), ["_block", "o__node"], "left_semi")
        open_ = cut_lineage(_without(_without(open_, lead), taken))
        both = links.join(open_.select("_block", "_node"), ["_block", "_node"], "left_semi")
        links = cut_lineage(both.join(open_.select("_block", F.col("_node").alias("o__node")), ["_block", "o__node"], "left_semi"))
    return reduce(DataFrame.unionByName, found, open_)


def _leaders(sets: DataFrame, threshold: float, chunk: int, rank_type: str) -> DataFrame:
    """All leaders of all blocks. The rank filter runs before the shuffle, so a round moves what it takes of a block."""
    open_ = cut_lineage(sets.filter(F.size("words") > 0))
    found, size = [sets.filter(F.size("words") == 0)], chunk
    next_up = Window.partitionBy("_block").orderBy("first")
    while not open_.isEmpty():
        head = cut_lineage(open_.withColumn("_pos", F.row_number().over(next_up)).filter(F.col("_pos") <= size).drop("_pos"))
        lead = cut_lineage(_folded(head, threshold, rank_type) if size <= chunk else _unlike(head, threshold))
        found.append(lead)
        rest = _without(open_, head)
        # All that is left comes after the new leaders, so any match takes it.
        open_ = cut_lineage(_without(rest, _matches(rest, lead, threshold).select("_block", "_node")))
        size = min(max(MOST, chunk), 2 * size)
    return reduce(DataFrame.unionByName, found)


def leader_cluster(
    df: DataFrame,
    block: str,
    words: str,
    order: Sequence[Column],
    threshold: float = V.MATCH_THRESHOLD,
    name: str = "proposal_id",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add the cluster id ``block|n``, n being the leader's number within its block.

    ``words`` is an array column from :func:`word_set`, ``order`` an ascending total
    order of the rows of a block. An empty word set matches nothing and leads itself.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    # Rows without a block are a block of their own, and its name in the id is empty.
    named = F.when(F.col(block).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(block).cast("string")))
    ranked = df.withColumn("_rank", rank).withColumn("_block", named)
    node = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(
        F.concat(F.lit("\t"), F.to_json("_rank"))
    )
    rows = cut_lineage(ranked.withColumn("_node", node))
    nodes = rows.groupBy("_block", F.col("_node"), F.col(words).alias("words")).agg(
        F.min("_rank").alias("first"), F.max("_rank").alias("last")
    )
    ladders = _ladders(cut_lineage(_keyed(nodes, threshold)), threshold, chunk, rows.schema["_rank"].dataType.simpleString())

    rung = F.try_element_at(F.filter("ladder", lambda r: r["rank"] <= F.col("_rank")), F.lit(-1))["no"]
    matched = salted_join(rows, ladders, ["_block", "_node"], "inner", salt_by=["_rank"])
    number = F.coalesce(rung, F.col("own")).cast("string")
    return matched.withColumn(
        name, F.concat(F.coalesce(F.col(block).cast("string"), F.lit("")), F.lit("|"), number)
    ).drop("_rank", "_block", "_node", "ladder", "own")


def _ladders(nodes: DataFrame, threshold: float, chunk: int, rank_type: str) -> DataFrame:
    """For each set the ladder of ever better leaders, in rank order, that it meets up to its last row; ``own`` is its own number as a leader.

    A row's leader is the highest rung not above its own rank.
    """
    leaders = _leaders(nodes.select(*_SET), threshold, chunk, rank_type)
    numbered = with_position(leaders, [F.col("first")], "no", within=["_block"]).withColumn("no", F.col("no").cast("int"))
    met = _matches(nodes, numbered.select(*_SET, "no"), threshold).filter(F.col("o_first") <= F.col("last"))
    rungs = f"array<struct<rank:{rank_type},no:int,score:double>>"

    def step(ladder: Column, s: Column) -> Column:
        better = (F.size(ladder) == 0) | (s["score"] > F.try_element_at(ladder, F.lit(-1))["score"])
        return F.when(better, F.concat(ladder, F.array(s))).otherwise(ladder)

    every = F.sort_array(F.collect_list(F.struct(F.col("o_first").alias("rank"), F.col("o_no").alias("no"), "score"))).cast(rungs)
    ladder = met.groupBy("_block", "_node").agg(F.aggregate(every, F.array().cast(rungs), step).alias("ladder"))
    own = numbered.select("_block", "_node", F.col("no").alias("own"))
    out = nodes.select("_block", "_node").join(ladder, ["_block", "_node"], "left").join(own, ["_block", "_node"], "left")
    return out.withColumn("ladder", F.coalesce("ladder", F.array().cast(rungs)))
