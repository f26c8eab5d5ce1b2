"""Phrase collocations from an FM-index per shard over word ids.

Documents of a language are cut into shards: a list of words, and the sequence of their places in it,
with breaks where phrases end. A shard is indexed by sorting its suffixes as deep as a phrase is long. A phrase is then an
interval of suffixes; the words before them (the Burrows-Wheeler transform) extend it to the left, and the
intervals nested in it are its extensions to the right. Going one word deeper keeps both directions in
step: a phrase is told apart by the phrases left by cutting its last and its first word.

Counts are summed across shards depth by depth. A shard asks about each of its phrases once, with its count, in buckets;
a bucket sums what all shards asked and answers with the number and the count of the phrases that reach the
least count. Only those are made deeper, which loses nothing, as no phrase is more frequent than its parts.
At last one shard for each phrase, the first that has it, names its words, cuts it and says what it extends.

Defined results: null and empty texts have no words; null languages are ``und``. Repeated rows count as often
as they come. An empty table gives no rows. Other columns, the id too, play no part. A passage without a
break is never divided, so it has to fit in a task.
"""

from __future__ import annotations

import string
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm.common import discard
from rollcall.llm.quality import spread_out, squeezed, written

LEAST, LONGEST, TOP = 30, 4, 2000
INSIDE = 80  # percent of its count with which a longer phrase makes a phrase superfluous
SCALE = 2_000_000
# Words in a shard, and phrases that a bucket sums on average at most.
SHARD_WORDS, BUCKET_WORDS = 2_000_000, 2_000_000
TEXT_BYTES = 4_000_000  # text that is split into words at a time

# Upper-case letters give way to lower-case ones, so one of them can stand for a break.
BREAK = b"A"
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b"\t.,;:!?\x0b\x0c\r", string.ascii_lowercase.encode() + b" " + b"\n" * 9)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASKED = "bucket int, shard long, lang string, a binary, b binary, n binary"
ANSWERED = "depth int, bucket int, shard long, places binary, numbers binary, counts binary, own binary"
FOUND = "lang string, depth int, number long, phrase string, a long, l long, r long, score long, side string"


def word_lists(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of all texts in order, BREAK where a phrase ends; a part at a time, each but the first begins with a break."""
    data, at = b"\n".join(texts).translate(PLAIN), 0
    while at < len(data):
        end = data.find(b"\n", at + TEXT_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b"\n", b" " + BREAK + b" ").split()
        at = end


class Shard:
    """Words of one language as they come in."""

    def __init__(self):
        self.places: dict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.places[BREAK] = 0
        self.parts, self.held = [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)))
        self.held += len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        ids = without_repeats(np.concatenate([np.zeros(1, np.int64), *self.parts, np.zeros(1, np.int64)]))
        words = list(self.places)[1:]
        return pa.RecordBatch.from_pydict(
            {"shard": [number], "lang": [lang], "n": [int((ids > 0).sum())], "words": [zlib.compress(b"\n".join(words), 1)], "ids": [squeezed(ids)]}
        )


def without_repeats(ids: np.ndarray) -> np.ndarray:
    """One break where several follow each other."""
    return ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, n, words, ids): the texts of each language in shards; n counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, open_ = TaskContext.get().partitionId(), 0, defaultdict(Shard)

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return open_.pop(lang).row((task << 32) | made, lang)

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                texts = batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))
                ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1):
                    open_[lang].add([BREAK])
                    for words in word_lists(texts.take(pa.array(part)).to_pylist()):
                        open_[lang].add(words)
                        while sum(s.held for s in open_.values()) > SHARD_WORDS:
                            yield closed(max(open_, key=lambda x: (open_[x].held, x)))
                        # The next part begins with a break, so a new shard may begin with it.
        for lang in sorted(open_):
            yield closed(lang)

    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "shard long, lang string, n long, words binary, ids binary")


class Index:
    """The FM-index of a sequence of symbols; 0 is a break, and stands at both ends."""

    def __init__(self, text: np.ndarray, depth: int = LONGEST):
        rank, sorted_by = text, 1
        while sorted_by < depth:
            # Cyclic, which never matters: what reaches over the end holds a break.
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -sorted_by)
            sorted_by *= 2
            if sorted_by < depth:
                rank = np.unique(key, return_inverse=True)[1]
            else:
                rank = key
        order = np.argsort(rank)
        self.order, self.first, self.before = order, text[order], text[order - 1]
        # Where the suffix that is longer by one word stands.
        self.longer = np.empty(len(text), dtype=np.int64)
        self.longer[np.argsort(self.before, kind="stable")] = np.arange(len(text))

    def symbols(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the intervals of the symbols 1..n."""
        cuts = np.searchsorted(self.first, np.arange(1, n + 2))
        return cuts[:-1], np.diff(cuts)

    def extended(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of phrases in order: start, size, prefix and suffix of those one word longer that begin and end with one of them."""
        who = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(who))
        word = self.before[at] > 0
        label = np.full(len(self.order), -1, dtype=np.int64)
        label[self.longer[at[word]]] = who[word]
        # Suffixes that begin alike and go on with the same phrase are the interval of the longer one.
        starts = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (self.first[1:] != self.first[:-1]))))
        sizes = np.diff(np.append(starts, len(label)))
        # It lies inside the interval of its prefix, if that is one of the phrases.
        prefix = np.searchsorted(lo, starts, side="right") - 1
        some = (label[starts] >= 0) & (prefix >= 0)
        some[some] = starts[some] < lo[prefix[some]] + size[prefix[some]]
        return starts[some], sizes[some], prefix[some], label[starts[some]]


class Level:
    """The phrases of one depth in a shard that reach the least count: intervals, parts, and what the buckets said."""

    def __init__(self, lo, size, prefix, suffix, told: dict[str, np.ndarray]):
        p = told["places"]
        self.lo, self.size, self.prefix, self.suffix = (x if x is None else x[p] for x in (lo, size, prefix, suffix))
        self.numbers, self.counts, self.own = told["numbers"], told["counts"], told["own"]


def bucket_of_words(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def bucket_of(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def parted(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by bucket, and where each bucket's begin."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def told_of(answers: pd.DataFrame, bucket: np.ndarray, buckets: int) -> dict[str, np.ndarray]:
    """What all buckets answered about the phrases of one depth, in the order of the phrases."""
    order, cuts = parted(bucket, buckets)
    rows = [(spread_out(p) + cuts[b], spread_out(n), spread_out(c), spread_out(o)) for b, p, n, c, o in zip(*(answers[x] for x in ("bucket", "places", "numbers", "counts", "own")))]
    at, numbers, counts, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*rows) if rows else [()] * 4))
    places = order[at]
    back = np.argsort(places)
    return {"places": places[back], "numbers": numbers[back], "counts": counts[back], "own": own[back] > 0}


def walked(row: pd.Series, answers: pd.DataFrame, buckets: int, longest: int, known: int) -> tuple[list[bytes], Index, list[Level], tuple | None]:
    """The shard's words, its index, its phrases of the ``known`` depths, and (prefix, suffix, size) of those one deeper."""
    words = zlib.decompress(row["words"]).split(b"\n")
    told = told_of(answers[answers["depth"] == 1], bucket_of_words(words, buckets), buckets)
    symbol = np.zeros(len(words) + 1, dtype=np.int64)
    symbol[told["places"] + 1] = np.arange(1, len(told["places"]) + 1)
    index = Index(without_repeats(symbol[spread_out(row["ids"])]), longest)
    lo, size = index.symbols(len(told["places"]))
    words = [words[i] for i in told["places"]]
    levels = [Level(lo, size, None, None, told | {"places": np.arange(len(words))})]
    while len(levels) < longest:
        last = levels[-1]
        lo, size, prefix, suffix = index.extended(last.lo, last.size)
        if len(levels) == known:
            return words, index, levels, (prefix, suffix, size)
        bucket = bucket_of(last.numbers[prefix], last.numbers[suffix], buckets)
        levels.append(Level(lo, size, prefix, suffix, told_of(answers[answers["depth"] == len(levels) + 1], bucket, buckets)))
    return words, index, levels, None


def questions(shard: int, lang: str, bucket: np.ndarray, buckets: int, packed) -> pd.DataFrame:
    """A row for each bucket that is asked something; ``packed`` gives a, b and n of some places."""
    order, cuts = parted(bucket, buckets)
    some = [(b, order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts))]
    return pd.DataFrame([(int(b), shard, lang, *packed(p)) for b, p in some], columns=["bucket", "shard", "lang", "a", "b", "n"])


def words_asked(table: DataFrame, buckets: int) -> DataFrame:
    """Each shard's words with their counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                if not row["n"]:
                    continue
                words = zlib.decompress(row["words"]).split(b"\n")
                n = np.bincount(spread_out(row["ids"]), minlength=len(words) + 1)[1:]
                pack = lambda p, words=words, n=n: (zlib.compress(b"\n".join([words[i] for i in p]), 1), b"", squeezed(n[p]))
                yield questions(row["shard"], row["lang"], bucket_of_words(words, buckets), buckets, pack)

    return table.mapInPandas(run, ASKED)


def phrases_asked(table: DataFrame, answers: DataFrame, buckets: int, longest: int, known: int) -> DataFrame:
    """Each shard's phrases of the depth after the ``known`` ones: the numbers of prefix and suffix, and the count."""

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(answers):
            return pd.DataFrame(columns=["bucket", "shard", "lang", "a", "b", "n"])
        row = frame.iloc[0]
        _, _, levels, (prefix, suffix, size) = walked(row, answers, buckets, longest, known)
        a, b = levels[-1].numbers[prefix], levels[-1].numbers[suffix]
        return questions(row["shard"], row["lang"], bucket_of(a, b, buckets), buckets, lambda p: (squeezed(a[p]), squeezed(b[p]), squeezed(size[p])))

    return table.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(run, ASKED)


def codes(rows: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What all rows ask about as one sequence of codes, alike where the question is, and the size of each row."""
    if depth == 1:
        held: dict[tuple[str, bytes], int] = {}
        asked = [[(lang, w) for w in zlib.decompress(a).split(b"\n")] for lang, a in zip(rows["lang"], rows["a"])]
        # In order of words, so that a bucket that is summed again gives the same numbers.
        held.update((k, i) for i, k in enumerate(sorted(set().union(*asked))))
        parts = [np.fromiter(map(held.__getitem__, x), np.int64, len(x)) for x in asked]
        return np.concatenate(parts), np.array([len(x) for x in parts])
    a, b = ([spread_out(x) for x in rows[c]] for c in ("a", "b"))
    sizes = np.array([len(x) for x in a])
    a, b = np.concatenate(a), np.concatenate(b)
    if max(int(a.max()), int(b.max())) >> 31:
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
    return (a << 31) | b, sizes


def answered(asked: DataFrame, depth: int, buckets: int, least: int) -> DataFrame:
    """For each shard and bucket what reaches the least count over all shards: its place in the question, number and count, and whether the shard is the first to have it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        code, sizes = codes(rows, depth)
        n = np.concatenate([spread_out(x) for x in rows["n"]])
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, at, n)
        enough = total >= least
        number = (np.cumsum(enough) - 1) * buckets + int(rows["bucket"].iloc[0])
        out, start = [], 0
        for shard, size in zip(rows["shard"], sizes):
            mine = at[start : start + size]
            p = np.flatnonzero(enough[mine])
            if len(p):
                own = (first[mine[p]] >= start) & (first[mine[p]] < start + size)
                out.append((depth, int(rows["bucket"].iloc[0]), shard, squeezed(p), squeezed(number[mine[p]]), squeezed(total[mine[p]]), squeezed(own.astype(np.int64))))
            start += size
        return pd.DataFrame(out, columns=["depth", "bucket", "shard", "places", "numbers", "counts", "own"])

    return asked.groupBy("bucket").applyInPandas(run, ANSWERED)


def best_cut(levels: list[Level], depth: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, r and score of phrases at the cut that scores lowest, the first of such cuts."""
    heads, tails = [None] * depth, [None] * depth  # counts of the first and of the last j words
    pre, suf = who, who
    for j in range(depth - 1, 0, -1):
        pre, suf = levels[j].prefix[pre], levels[j].suffix[suf]
        heads[j], tails[j] = (levels[j - 1].counts[x].astype(object) for x in (pre, suf))
    a = levels[depth - 1].counts[who].astype(object)  # Python's numbers have no bound
    l, r = heads[1], tails[depth - 1]
    score = SCALE * a // (l + r)
    for j in range(2, depth):
        other = SCALE * a // (heads[j] + tails[depth - j])
        lower = other < score
        l, r, score = np.where(lower, heads[j], l), np.where(lower, tails[depth - j], r), np.where(lower, other, score)
    return l, r, score


def found(table: DataFrame, answers: DataFrame, buckets: int, longest: int) -> DataFrame:
    """Each phrase once, with its best cut (``side`` null); and for what it extends, on which ``side``, and its count as ``a``."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=names)]
        if len(frame) and len(answers):
            lang = frame["lang"].iloc[0]
            words, index, levels, _ = walked(frame.iloc[0], answers, buckets, longest, longest)
            text = np.empty(len(index.order), dtype=np.int64)
            text[index.order] = index.first
            for depth in range(2, len(levels) + 1):
                now, last = levels[depth - 1], levels[depth - 2]
                who = np.flatnonzero(now.own)
                if not len(who):
                    continue
                at = index.order[now.lo[who]]
                said = [b" ".join([words[s - 1] for s in text[i : i + depth]]).decode(errors="replace") for i in at]
                l, r, score = best_cut(levels, depth, who)
                out.append(pd.DataFrame({"lang": lang, "depth": depth, "number": now.numbers[who], "phrase": said, "a": now.counts[who], "l": l, "r": r, "score": score, "side": None}))
                if depth > 2:
                    for side, part in (("right", now.prefix), ("left", now.suffix)):
                        out.append(pd.DataFrame({"lang": lang, "depth": depth - 1, "number": last.numbers[part[who]], "a": now.counts[who], "side": side}))
        return pd.concat([x.reindex(columns=names).astype({c: "Int64" for c in ("depth", "number", "a", "l", "r", "score")}) for x in out])

    return table.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(run, FOUND)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, n_left, n_right) of every phrase of two words or more that is not dropped.

    ``n_left`` and ``n_right`` count its extensions by one word that reach the least count themselves.
    """
    table = written(shards(docs), "shards")
    totals = written(table.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")  # a row for each language
    n_words = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-n_words // BUCKET_WORDS))
    told: list[DataFrame] = []
    for depth in range(1, longest + 1):
        answers = reduce(DataFrame.unionByName, told) if told else None
        asked = written(phrases_asked(table, answers, buckets, longest, depth - 1) if told else words_asked(table, buckets), "phrases-asked")
        told.append(written(answered(asked, depth, buckets, least), "phrases-told"))
        discard(asked)
    every = written(found(table, reduce(DataFrame.unionByName, told), buckets, longest), "phrases")
    discard(table, *told)
    beyond = every.where("side is not null").groupBy("depth", "number").agg(
        F.max("a").alias("most"), F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right")
    )
    # A phrase inside a longer one lies inside one that is longer by a word and at least as frequent.
    phrases = every.where("side is null").drop("side").join(beyond, ["depth", "number"], "left")
    kept = phrases.where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * inside))
    return kept.join(totals, "lang").select(
        "lang", "phrase", "a", "l", "r", "n", "score", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")
    )


def top(mined: DataFrame, k: int = TOP) -> DataFrame:
    """The first ``k`` of each language with their ``rank``; Spark cuts to as many before it shuffles."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return mined.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
