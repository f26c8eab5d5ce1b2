"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Tokens are words between white space, as written. Every word of the trusted text is told apart and
has a number; a word that it does not hold stands for its shape (case, marks, length). The model is made from
the trusted documents alone: their word pairs are counted in shards by a hash, and each word's entry holds its number and
its statistics as a first and as a second word of pairs. Entries are kept in shards by a hash of the word.

All documents travel to the model in blocks. A block asks each shard once for the entries of its distinct words, and then for the
counts of those distinct pairs whose first word has pairs and whose second word is a second word somewhere; any other pair has
count 0. Answers hold what is not 0. Only a few sums over the whole model go to every task. A document is rejected if its
perplexity lies above a quantile of that of all trusted documents in its language: those which the model was not trained on, and
the others under the model without their own counts.

A block is known by a hash of all that it holds. One pass over the texts writes blocks and their questions to one table, so a repeated task
can not cut them otherwise than they asked; were a block's answers not there, the job would fail rather than score wrongly.
Rows are sorted by a hash of id and text, and a table of documents that was shuffled to find its trusted rows is stored first.

Defined results: documents without tokens (null, empty or blank) have no perplexity and are
not kept. A document is trusted if all of its labels say quality 1 and none says toxic 1. Null languages
are one language. Every language has a threshold of its own, however few its trusted documents (the largest of their perplexities below
200); of a language without any, all documents with tokens are kept, and the threshold is infinite. Rows that repeat a doc_id are scored
each, and each is kept or not by its own text; so are rows without an id. Other columns play no part.
"""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import broadcast_below, discard, stored

# Trusted words of a shard of entries, and trusted tokens of a shard of pairs, on average at most: shards follow the model.
SHARD_WORDS, SHARD_TOKENS = 100_000, 1_000_000
# Characters in a block of documents; a longer document is a block of its own.
BLOCK_CHARS = 6_000_000
# Documents are scored in so many parts, one after the other; what they ask and hear lies on disk for one part at a time.
SLICES = 4
# Blocks that one task looks up in a shard; more blocks make more tasks.
BLOCKS_A_TASK = 256
HELD_OUT = 10  # one trusted document in so many
QUANTILE = 0.995
# Short texts are drawn to the mean of trusted text by so many tokens.
PRIOR_TOKENS = 10
BROADCAST_ROWS = 1_000_000

CASES, MARKS, LENGTHS = 5, 3, 4
SHAPES = CASES * MARKS * LENGTHS

# Numbers: START stands before the first token; shapes and words follow. A pair is one number, the first word in its high half.
START = 0
FIRST_SHAPE = 1
FIRST_WORD = FIRST_SHAPE + SHAPES
HALF, LOW = np.int64(32), np.int64(0xFFFFFFFF)
# What an entry holds: pairs (v, .), how many of them occur once, twice, more often, and the kinds of pairs (., v).
STATISTICS = ("total", "ones", "twos", "more", "left")
TOTAL, ONES, TWOS, MORE, LEFT = range(5)

Batches = Iterator[pa.RecordBatch]

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shape(word: str) -> int:
    n = len(word)
    length = (n > 4) + (n > 9) + (n > 16)
    if word.isalpha() and word.islower():  # most words
        return length
    core = word.rstrip(".,;:!?")
    case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3 if any(c.isalpha() for c in core) else 4
    marks = 2 if not core.isalpha() else 1 if n > len(core) + 1 else 0
    return (case * MARKS + marks) * LENGTHS + length


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the shuffles behind the table go at once, as nothing reads them again."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.set(key, before)


def word_shards(words: list[str], shards: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % shards


def pair_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places in ascending order) of every shard that has some."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts)).tolist()]


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0, all their lowest bytes first, then the next ones: the high bytes are mostly alike."""
    whole = np.ascontiguousarray(values, dtype="<i8")
    width = max(1, (int(whole.max()).bit_length() + 7) // 8) if len(whole) else 1
    planes = whole.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def spread_out(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    whole[:, : data[0]] = planes.T
    return whole.view("<i8").ravel()


def rising(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return squeezed(np.diff(values, prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(spread_out(data))


def squeezed_words(words: list[str]) -> bytes:
    # Tokens hold no white space.
    return zlib.compress("\n".join(words).encode(), 1)


def words_of(data: bytes) -> list[str]:
    return zlib.decompress(data).decode().split("\n")


# Documents ----------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held): documents that all their labels call good and none calls toxic; ``held`` are kept out of training."""
    toxic = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("t")
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), toxic).where("q = 1 and not t")
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))


def row_key() -> Column:
    """Stands for a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def flagged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, row, lang, text, role): role 1 trains the model, 2 is held out, 0 is only scored; and the table to delete, if one was stored."""
    ids = trusted_ids(labels)
    n = ids.count()
    known = docs.select(
        F.col("doc_id").cast("long"), row_key().alias("row"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    role = F.when(F.col("held"), F.lit(2)).when(~F.col("held"), F.lit(1)).otherwise(F.lit(0)).alias("role")
    flags = known.join(broadcast_below(ids, n, BROADCAST_ROWS), "doc_id", "left").select("doc_id", "row", "lang", "text", role)
    if n <= BROADCAST_ROWS:
        return flags.sortWithinPartitions("row"), None
    whole = stored(flags, "flagged")
    return whole.sortWithinPartitions("row"), whole


class Block:
    """Documents that travel together: their tokens are places in a list of words."""

    def __init__(self, part: pa.RecordBatch):
        held: dict[str, int] = defaultdict()
        held.default_factory = held.__len__
        texts = part.column("text").to_pylist()
        ids = [np.fromiter(map(held.__getitem__, said), np.int64, len(said)) for said in (t.split() for t in texts)]
        self.part = part
        self.counts = np.array([len(x) for x in ids], dtype=np.int64)
        self.ids, self.words = np.concatenate(ids), list(held)
        # All that it holds, in its order: two blocks of one name are one block.
        name = xxhash.xxh64(np.array(part.column("row").to_pylist(), dtype=np.int64).tobytes())
        name.update(self.counts.tobytes())
        self.name = name.intdigest() - (1 << 63)

def blocks(batches: Batches) -> Iterator[Block]:
    for batch in batches:
        sizes = [len(t) for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(sizes):
            to, chars = at, 0
            while to < len(sizes) and (to == at or chars + sizes[to] <= BLOCK_CHARS):
                chars += sizes[to]
                to += 1
            yield Block(batch.slice(at, to - at))
            at = to


CUT_ROWS = (
    "block long, shard int, places binary, words binary, row array<long>, doc_ids array<long>, langs array<string>, roles array<int>, counts array<int>, ids binary"
)


def cut(docs: DataFrame, shards: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table of blocks, written in one pass over the texts, and its two kinds of rows.

    (block, row, doc_ids, langs, roles, counts, ids) of each block, and what it asks each shard of words: (block, shard, places in its list, words).
    """

    def run(batches: Batches) -> Batches:
        schema = pa.schema(
            [("block", pa.int64()), ("shard", pa.int32()), ("places", pa.binary()), ("words", pa.binary()), ("row", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
             ("langs", pa.list_(pa.string())), ("roles", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary())]
        )
        for b in blocks(batches):
            of = {c: b.part.column(c).to_pylist() for c in ("row", "doc_id", "lang", "role")}
            whole = {"row": of["row"], "doc_ids": of["doc_id"], "langs": of["lang"], "roles": of["role"], "counts": b.counts.tolist(), "ids": squeezed(b.ids)}
            parts = by_shard(word_shards(b.words, shards), shards)
            asked = [{"shard": s, "places": rising(p), "words": squeezed_words([b.words[i] for i in p])} for s, p in parts]
            yield pa.RecordBatch.from_pylist([{"block": b.name, **row} for row in (whole, *asked)], schema)

    table = written(docs.mapInArrow(run, CUT_ROWS), name)
    return (
        table,
        table.where("shard is null").select("block", "row", "doc_ids", "langs", "roles", "counts", "ids"),
        table.where("shard is not null").select("block", "shard", "places", "words"),
    )


def tokens(text: Column) -> Column:
    """As ``str.split`` has them."""
    return F.array_remove(F.split(text, r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"), "")


# Asking and answering -------------------------------------------------------------


def turns_for(n_blocks: int) -> int:
    return max(1, -(-n_blocks // BLOCKS_A_TASK))


def met(ask: DataFrame, tell: DataFrame, turns: int) -> DataFrame:
    """Questions and shards by shard and turn, sorted so that what a shard tells comes before the blocks that ask: it is held, the blocks pass by."""
    turn = F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int")
    told = tell.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("block", F.lit(None).cast("long"))
    both = ask.withColumn("turn", turn).unionByName(told, allowMissingColumns=True)
    return both.repartition("shard", "turn").sortWithinPartitions("shard", "turn", F.col("block").asc_nulls_first())


def entries_told(asked: DataFrame, entries: DataFrame, turns: int) -> DataFrame:
    """(block, places, told): number and statistics of the words that each block asked for, one after the other; a word without an entry has the number of its shape."""

    def run(batches: Batches) -> Batches:
        known, table, now = {}, None, None
        for batch in batches:
            for row in batch.to_pylist():
                # Each turn is told the whole shard anew, in parts; what an earlier turn in the same task was told must not stay.
                if (row["shard"], row["turn"]) != now:
                    known, table, now = {}, np.zeros((1 + len(STATISTICS), 0), np.int64), (row["shard"], row["turn"])
                words = words_of(row["words"])
                if row["block"] is None:
                    known.update(zip(words, range(len(known), len(known) + len(words))))
                    table = np.concatenate((table, spread_out(row["entries"]).reshape(1 + len(STATISTICS), -1)), axis=1)
                    continue
                at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                told = np.zeros((1 + len(STATISTICS), len(words)), dtype=np.int64)
                told[:, at >= 0] = table[:, at[at >= 0]]
                told[0, at < 0] = [FIRST_SHAPE + shape(words[i]) for i in np.flatnonzero(at < 0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([row["places"]], pa.binary()), pa.array([squeezed(told.ravel())], pa.binary())], ["block", "places", "told"]
                )

    return met(asked, entries, turns).mapInArrow(run, "block long, places binary, told binary")


def told_apart(ids: bytes, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a block as numbers of the whole model, and the entries (number and statistics) of its words."""
    own = spread_out(ids)
    n = int(own.max()) + 1 if len(own) else 0
    table, seen = np.zeros((1 + len(STATISTICS), n), dtype=np.int64), 0
    # Blocks that are the same ask the same, each for itself.
    answers = answers.drop_duplicates("places")
    for places, told in zip(answers["places"], answers["told"]):
        at = risen(places)
        table[:, at] = spread_out(told).reshape(1 + len(STATISTICS), -1)
        seen += len(at)
    if seen != n:
        raise RuntimeError("a block of documents was cut otherwise than when it asked; its rows come in no fixed order")
    return table[0][own], table


def by_number(table: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order, and their statistics; words that share a shape are one, START is told apart."""
    numbers, first = np.unique(table[0], return_index=True)
    return np.concatenate(([START], numbers)), np.concatenate((start[:, None], table[1:, first]), axis=1)


def pairs_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Every token with the one before it, as one number."""
    before = np.concatenate((ids[:1], ids[:-1]))
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return (before << HALF) | ids


def worth_asking(keys: np.ndarray, numbers: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which pairs may have been counted: the first word has pairs, and the second comes second somewhere."""
    before, now = np.searchsorted(numbers, keys >> HALF), np.searchsorted(numbers, keys & LOW)
    return (told[TOTAL][before] > 0) & (told[LEFT][now] > 0)


# The model ------------------------------------------------------------------------


def vocabulary(flags: DataFrame) -> tuple[DataFrame, int, int]:
    """(shard, word, number) of the words of the training text, how many shards there are, and how many tokens.

    A word's number is its rank in its shard and the shard; so numbers are dense, and need no order of all words.
    """
    words = flags.where("role = 1").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(words, "words")
    n, n_tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_WORDS))

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        words = sorted(frame["word"])
        return pd.DataFrame({"shard": frame["shard"].iloc[0], "word": words, "number": np.arange(len(words), dtype=np.int64) * shards + int(frame["shard"].iloc[0]) + FIRST_WORD})

    shard = (F.crc32(F.col("word").cast("binary")) % shards).cast("int").alias("shard")
    numbers = written(counts.select(shard, "word").groupBy("shard").applyInPandas(number, "shard int, word string, number long"), "numbers")
    discard(counts)
    return numbers, shards, n_tokens


def packed_entries(entries: DataFrame) -> DataFrame:
    """(shard, words, entries): a row for each shard and part of it, from (shard, word, number, statistics)."""

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            for s, rows in batch.to_pandas().groupby("shard"):
                told = np.stack([rows[c].to_numpy(dtype=np.int64) for c in ("number", *STATISTICS)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([squeezed_words(list(rows["word"]))], pa.binary()), pa.array([squeezed(told.ravel())], pa.binary())],
                    ["shard", "words", "entries"],
                )

    return entries.repartition("shard").sortWithinPartitions("shard").mapInArrow(pack, "shard int, words binary, entries binary")


def pairs_trained(train: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, n): the distinct pairs of each block of training documents, and how often they occur."""

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            ids, _ = told_apart(row["ids"], answers)
            keys, n = np.unique(pairs_of(ids, np.array(row["counts"], dtype=np.int64)), return_counts=True)
            out += [(s, rising(keys[p]), squeezed(n[p])) for s, p in by_shard(pair_shards(keys, shards), shards)]
        return pd.DataFrame(out, columns=["shard", "keys", "n"])

    return train.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "shard int, keys binary, n binary")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return keys, n


def counted(rows: DataFrame) -> DataFrame:
    """Sums of (keys, n) of each shard, read as a stream: a task holds the pairs of one shard, not its blocks."""

    def run(batches: Batches) -> Batches:
        parts, now, size = [], None, 0

        def out() -> pa.RecordBatch:
            keys, n = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([rising(keys)], pa.binary()), pa.array([squeezed(n)], pa.binary())], ["shard", "keys", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if parts:
                        yield out()
                    now, parts, size = row["shard"], [], 0
                parts.append((risen(row["keys"]), spread_out(row["n"])))
                size += len(parts[-1][0])
                if size > 4 * len(parts[0][0]) + 1_000_000:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
        if parts:
            yield out()

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, keys binary, n binary")


def statistics(counts: DataFrame) -> DataFrame:
    """(number, statistics) of every word, START too: a shard's pairs say a part of each, which Spark adds up."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = risen(row["keys"]), spread_out(row["n"])
                before = keys >> HALF
                first = np.flatnonzero(np.diff(before, prepend=-1))
                now, kinds = np.unique(keys & LOW, return_counts=True)
                told = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)]
                zeros = [np.zeros(len(now), np.int64)] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((before[first], now))), *(pa.array(np.concatenate(x)) for x in zip(told, zeros)), pa.array(np.concatenate((np.zeros(len(first), np.int64), kinds)))],
                    ["number", *STATISTICS],
                )

    kind = ", ".join(f"{c} long" for c in ("number", *STATISTICS))
    return counts.mapInArrow(run, kind).groupBy("number").agg(*[F.sum(c).alias(c) for c in STATISTICS])


class Model:
    """What Kneser-Ney needs beside the counts of the pairs and the statistics of the words: a few sums."""

    def __init__(self, of_counts: np.ndarray, of_left: np.ndarray, n_words: int):
        """How many pairs occur once to five times or more, how many words have one to five or more kinds of pairs (., v), and the number of words."""
        self.discounts, self.lower = discounts(of_counts), discounts(of_left)
        self.pairs = max(1, int(of_counts.sum()))
        at_least_3 = float(of_left[2:].sum())
        taken = self.lower[0] * of_left[0] + self.lower[1] * of_left[1] + self.lower[2] * at_least_3
        self.uniform = (taken if of_counts.sum() else 1.0) / self.pairs / max(1, n_words + SHAPES)

    def plain(self) -> tuple:
        """The sums as plain numbers: what goes to the workers must not need this package there."""
        return self.discounts, self.lower, self.pairs, self.uniform


def discounts(of_counts: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many pairs occur one to four times."""
    n1, n2, n3, n4 = (float(x) for x in of_counts[:4])
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def log_probability(model: tuple, counts: np.ndarray, total: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of a word after one with ``total`` pairs; ``left`` is of the word itself, the others of the word before."""
    of_pairs, of_left, pairs, uniform = model
    base = discounted(left, of_left) / pairs + uniform
    rest = (of_pairs[0] * ones + of_pairs[1] * twos + of_pairs[2] * more) / np.maximum(1, total)
    return np.log(discounted(counts, of_pairs) / np.maximum(1, total) + np.where(total > 0, rest, 1.0) * base)


def model_of(counts: DataFrame, told: DataFrame, n_words: int) -> Model:
    """The sums over all shards of pairs and over all words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.bincount(np.minimum(spread_out(row["n"]), 5), minlength=6)[1:]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, 6)), pa.array(n)], ["k", "n"])

    of_counts, of_left = np.zeros(5, dtype=np.int64), np.zeros(5, dtype=np.int64)
    for k, n in counts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # five rows
        of_counts[k - 1] = n
    for k, n in told.where("left > 0").groupBy(F.least("left", F.lit(5)).alias("k")).agg(F.count(F.lit(1))).collect():  # five rows
        of_left[k - 1] = n
    return Model(of_counts, of_left, n_words)


# Scoring --------------------------------------------------------------------------


def pairs_asked(block: DataFrame, answers: DataFrame, shards: int, start: list[int]) -> DataFrame:
    """(block, shard, keys): the distinct pairs of each block that may have been counted."""

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.iloc[:1].itertuples():
            keys = questions(row, answers, start)[0]
            out += [(row.block, s, rising(keys[p])) for s, p in by_shard(pair_shards(keys, shards), shards)]
        return pd.DataFrame(out, columns=["block", "shard", "keys"])

    return block.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "block long, shard int, keys binary")


def questions(row, answers: pd.DataFrame, start: list[int]) -> tuple[np.ndarray, ...]:
    """The pairs worth asking for, and: all distinct pairs, which of them were asked for, each token's pair, numbers and statistics."""
    ids, table = told_apart(row.ids, answers)
    keys, at = np.unique(pairs_of(ids, np.array(row.counts, dtype=np.int64)), return_inverse=True)
    numbers, told = by_number(table, np.array(start, dtype=np.int64))
    worth = worth_asking(keys, numbers, told)
    return keys[worth], keys, worth, at, numbers, told


def looked_up(asked: DataFrame, counts: DataFrame, turns: int) -> DataFrame:
    """(block, shard, at, found): which of the keys that a block asked for were counted, by their places, and how often."""

    def run(batches: Batches) -> Batches:
        keys, n, now = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                if now != row["shard"]:
                    keys, n, now = np.zeros(0, np.int64), np.zeros(0, np.int64), row["shard"]
                if row["block"] is None:
                    keys, n = risen(row["keys"]), spread_out(row["n"])
                    continue
                if not len(keys):
                    continue
                want = risen(row["keys"])
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == want)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]]), pa.array([row["shard"]], pa.int32()), pa.array([rising(hit)], pa.binary()), pa.array([squeezed(n[at[hit]])], pa.binary())],
                        ["block", "shard", "at", "found"],
                    )

    return met(asked, counts, turns).mapInArrow(run, "block long, shard int, at binary, found binary")


def without_own(model: tuple, keys: np.ndarray, at: np.ndarray, n: np.ndarray, told: np.ndarray, left: np.ndarray, counts: np.ndarray, training: np.ndarray) -> np.ndarray:
    """Log probability of each training document under the model less the document's own pairs; the sums over the whole model stay. 0 for the others.

    ``n`` counts the pairs ``keys``, ``told`` has the four statistics of their first words, ``left`` that of their second; ``at`` are the tokens' pairs.
    """
    pick = np.repeat(training, counts)
    if not pick.any():
        return np.zeros(len(counts))
    doc = np.repeat(np.arange(len(counts)), counts)[pick]
    pairs, own = np.unique(doc * len(keys) + at[pick], return_counts=True)
    doc, pairs = np.divmod(pairs, len(keys))
    before, now = keys[pairs] >> HALF, keys[pairs] & LOW
    was, rest = n[pairs], n[pairs] - own
    # A document's pairs are sorted, so those with the same first word are a run.
    starts = (np.diff(before, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
    first, run = np.flatnonzero(starts), np.cumsum(starts) - 1
    changes = (-own, *((rest == k).astype(np.int64) - (was == k) for k in (1, 2)), (rest > 2).astype(np.int64) - (was > 2))
    told = [told[k][pairs] + np.add.reduceat(c, first)[run] for k, c in enumerate(changes)]
    _, same = np.unique(doc * (int(now.max()) + 1) + now, return_inverse=True)
    gone = np.bincount(same, weights=rest == 0).astype(np.int64)
    logs = log_probability(model, rest, *told, left[pairs] - gone[same])
    return np.bincount(doc, weights=own * logs, minlength=len(counts))


def scored(block: DataFrame, answers: DataFrame, found: DataFrame, model: tuple, shards: int, start: list[int]) -> DataFrame:
    """(doc_id, row, lang, role, n_tokens, log_probability, left_out) of every document, from the entries and the counts that its block asked for."""
    both = answers.unionByName(found, allowMissingColumns=True)

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"doc_id": pd.array([], "Int64"), "row": [], "lang": [], "role": [], "n_tokens": [], "log_probability": [], "left_out": []})]
        if len(rows):
            counts_found = answers[answers["shard"].notna()].sort_values("shard")
            row = next(rows.iloc[:1].itertuples())
            asked, keys, worth, at, numbers, told = questions(row, answers[answers["shard"].isna()], start)
            in_shard = dict(by_shard(pair_shards(asked, shards), shards))
            n_asked = np.zeros(len(asked), dtype=np.int64)
            for s, where, n in zip(counts_found["shard"], counts_found["at"], counts_found["found"]):
                n_asked[in_shard[int(s)][risen(where)]] = spread_out(n)
            of_pairs = np.zeros(len(keys), dtype=np.int64)
            of_pairs[worth] = n_asked
            first, second = np.searchsorted(numbers, keys >> HALF), np.searchsorted(numbers, keys & LOW)
            context, left = told[:4, first], told[LEFT][second]
            logs = np.concatenate(([0.0], np.cumsum(log_probability(model, of_pairs, *context, left)[at])))
            counts, roles = np.array(row.counts, dtype=np.int64), np.array(row.roles)
            ends = np.cumsum(counts)
            each = logs[ends] - logs[ends - counts]
            unseen = np.where(roles == 1, without_own(model, keys, at, of_pairs, context, left, counts, roles == 1), each)
            # A block that comes twice, rows repeated in full, answers once and is scored as often as it comes.
            whole = pd.DataFrame(
                {
                    "doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "row": list(row.row), "lang": list(row.langs), "role": roles, "n_tokens": counts,
                    "log_probability": each, "left_out": np.where(roles == 0, np.nan, unseen),
                }
            )
            out += [whole] * len(rows)
        return pd.concat(out[1:] or out)

    return block.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
        run, "doc_id long, row long, lang string, role int, n_tokens long, log_probability double, left_out double"
    )


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row, lang, role, n_tokens, log_probability) of every document under the model of the trusted ones; ``left_out`` is that of a trusted one if it does not train."""
    flags, kept_order = flagged(docs, labels)
    train = flags.where("role = 1")
    numbers, word_shards_, n_tokens = vocabulary(flags)
    n_words = numbers.count()
    zeros = numbers.select("shard", "word", "number", *[F.lit(0).cast("long").alias(c) for c in STATISTICS])
    plain = written(packed_entries(zeros), "plain-entries")
    table, block, asked = cut(train, word_shards_, "blocks-of-training")
    answers = written(entries_told(asked, plain, turns_for(block.count())), "told-in-training")
    pair_shards_ = max(1, -(-n_tokens // SHARD_TOKENS))
    counts = written(counted(pairs_trained(block, answers, pair_shards_)), "counts")
    discard(table, answers, plain)
    told = written(statistics(counts), "statistics")
    model = model_of(counts, told, n_words).plain()
    first = told.where(F.col("number") == START).select(*STATISTICS).first()
    start = list(first) if first else [0] * len(STATISTICS)
    known = numbers.join(told, "number", "left").select("shard", "word", "number", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in STATISTICS])
    entries = written(packed_entries(known), "entries")
    discard(numbers, told)
    scores = []
    for k in range(SLICES):
        part = flags.where(F.pmod("row", F.lit(SLICES)) == k)
        table, block, asked = cut(part, word_shards_, "blocks")
        turns = turns_for(block.count())
        answers = written(entries_told(asked, entries, turns), "told")
        found = written(looked_up(pairs_asked(block, answers, pair_shards_, start), counts, turns), "found")
        scores.append(written(scored(block, answers, found, model, pair_shards_, start), "scores"))
        discard(table, answers, found)
    discard(entries, counts, *([kept_order] if kept_order is not None else []))
    return reduce(DataFrame.unionByName, scores)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``judge`` with ``row``, which stands for a row's id and text."""
    scores = perplexities(docs, labels)
    trusted = F.sum(F.when(F.col("role") == 1, F.col("log_probability"))) / F.sum(F.when(F.col("role") == 1, F.col("n_tokens")))
    mean = scores.agg(F.coalesce(trusted, F.lit(0.0))).first()[0]
    drawn = lambda of: F.exp(-(F.col(of) + mean * PRIOR_TOKENS) / (F.col("n_tokens") + PRIOR_TOKENS))
    each = scores.withColumn("perplexity", F.when(F.col("n_tokens") > 0, drawn("log_probability")))
    own = scores.where("role > 0 and n_tokens > 0").groupBy("lang").agg(F.percentile_approx(drawn("left_out"), quantile, 10_000).alias("threshold"))
    named = each.join(own, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return named.select("doc_id", "row", "lang", "n_tokens", "perplexity", "threshold", keep.alias("keep"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) of every document."""
    return judged(docs, labels, quantile).drop("row")


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns as they were.

    A row is known by its id and text. Keys of rejected rows are broadcast up to a bound.
    """
    rejected = stored(judged(docs, labels, quantile).where(~F.col("keep")).select("row").distinct(), "rejected")
    gone = broadcast_below(rejected, rejected.count(), BROADCAST_ROWS).withColumnRenamed("row", "_rejected")
    return docs.join(gone, row_key() == F.col("_rejected"), "left_anti").select(*docs.columns)
