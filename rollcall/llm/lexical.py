"""Ranked lexical search, reversed: documents are streamed through an index of the items.

The items are few beside the documents, so their terms make the inverted index: for every term the items that hold it, and how often. It is
broadcast, in parts of a bounded number of entries; each part is a pass of its own over the documents. A first
pass counts documents and words, and in how many documents each indexed term occurs. In the second, every
task streams its documents' term counts through the index, adds up the scores of all items they meet, and keeps a bounded heap of
the best for each item. The heaps of all tasks are merged by a rank that Spark cuts before it shuffles.

Defined results: null and empty texts have no terms; such documents are never found and such items find nothing. Rows with
the same item_id, null too, are one item with the terms of all of them. Rows that repeat a doc_id are
documents of their own; equal scores are in order of doc_id, null last. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import math
import string
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm.common import stored

TOP = 10
# Entries (a term of an item) in one broadcast index; more of them take more passes.
INDEX_ENTRIES = 1_000_000
# Scores that a task holds at a time, and text that it splits at a time.
CELLS, TEXT_BYTES = 2_000_000, 4_000_000

# What parts terms, as in the pattern of a term, becomes a space; upper case becomes lower case.
_PARTS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + _PARTS, string.ascii_lowercase.encode() + b" " * len(_PARTS))

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def terms(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def plain(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def entries(items: DataFrame) -> DataFrame:
    """(id, term, n): how often each item holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                held = Counter(terms(text))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["id", "term", "n"])

    return plain(items, "item_id").mapInArrow(run, "id long, term binary, n long").groupBy("id", "term").agg(F.sum("n").alias("n"))


class Terms:
    """The part of the inverted index that is sent to every task: plain numbers and words."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]]):
        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(self.items)}
        self.place = {t: k for k, t in enumerate(sorted({r[1] for r in rows}))}
        order = sorted((self.place[t], number[i], n) for i, t, n in rows)
        self.item, self.times = (np.array([r[k] for r in order], dtype=np.int64) for k in (1, 2))
        self.start = np.searchsorted(np.array([r[0] for r in order]), np.arange(len(self.place) + 1))

    def state(self) -> tuple:
        return self.place, self.start, self.item, self.times, len(self.items)


def met(batches: Iterator[pa.RecordBatch], place: dict[bytes, int], documents: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """So many documents at a time: ids, words in each, and for each term met the document, the term's place and its count."""
    ids, words, which, at, tf, size = [], [], [], [], [], 0

    def out():
        return ids, np.array(words, dtype=np.int64), np.array(which, dtype=np.int64), np.array(at, dtype=np.int64), np.array(tf, dtype=np.int64)

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            said = terms(text)
            for t, n in Counter(filter(place.__contains__, said)).items():
                which.append(len(ids))
                at.append(place[t])
                tf.append(n)
            ids.append(i)
            words.append(len(said))
            size += len(text)
            if len(ids) >= documents or size > TEXT_BYTES:
                yield out()
                ids, words, which, at, tf, size = [], [], [], [], [], 0
    if ids:
        yield out()


def counted(docs: DataFrame, sent) -> DataFrame:
    """(term, n): documents that hold the term at a place; at -1 documents with a term, at -2 all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value[0]
        total = np.zeros(len(place) + 2, dtype=np.int64)
        for _, words, _, at, _ in met(batches, place, 10_000):
            total[:-2] += np.bincount(at, minlength=len(place))
            total[-1] += (words > 0).sum()
            total[-2] += words.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < len(place), some, some - len(total))), pa.array(total[some])], ["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def first_of(item: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` best of their item, in order of item and rank."""
    order = np.lexsort((ids, no_id, -score, item))
    item = item[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return order[rank < k]


class Heaps:
    """The best documents of each item so far; what cannot be among them is not held."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, dtype=np.int64)
        self.best = [np.zeros(0, dtype=np.int64)] * 4  # item, score, id, whether there is no id
        self.more, self.held = [], 0

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        which, item = np.nonzero((scores > 0) & (scores >= self.least))
        no_id = np.array([i is None for i in ids], dtype=np.int64)
        given = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.more.append((item, scores[which, item], given[which], no_id[which]))
        self.held += len(item)
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.merged()

    def merged(self) -> list[np.ndarray]:
        every = [np.concatenate(x) for x in zip(self.best, *self.more)]
        pick = first_of(*every, self.k)
        self.best, self.more, self.held = [x[pick] for x in every], [], 0
        item, score = self.best[:2]
        last = np.flatnonzero(np.bincount(item, minlength=len(self.least))[item] == self.k)
        self.least[:] = 0
        # The last of an item's full heap comes last, so it stays.
        self.least[item[last]] = score[last]
        return self.best


def scored(docs: DataFrame, sent, weights, documents: int, words: int, items: list[int | None], k: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of every task for every item of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, start, item, times, n_items = sent.value
        weight = weights.value
        heaps = Heaps(n_items, k)
        for ids, n, which, at, tf in met(batches, place, max(1, CELLS // n_items)):
            m = 25 + (75 * n * documents) // words
            each = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[which]))
            # Every term met adds to all items that hold it.
            size = start[at + 1] - start[at]
            entry = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            scores = np.zeros(len(ids) * n_items, dtype=np.int64)
            np.add.at(scores, np.repeat(which, size) * n_items + item[entry], np.repeat(each, size) * times[entry])
            heaps.add(scores.reshape(len(ids), n_items), ids)
        item, score, ids, no_id = heaps.merged()
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[i] for i in item], pa.int64()), pa.array(ids, pa.int64(), mask=no_id > 0), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"]
        )

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` documents of the highest score above 0."""
    spark = docs.sparkSession
    index = stored(entries(items), "item-terms")
    texts = plain(docs, "doc_id")
    passes = max(1, -(-index.count() // INDEX_ENTRIES))
    part = F.pmod(F.xxhash64("id"), F.lit(passes))
    out = None
    for p in range(passes):
        # About INDEX_ENTRIES rows; an item is never divided.
        rows = [(r["id"], bytes(r["term"]), r["n"]) for r in index.where(part == p).collect()]
        if not rows:
            continue
        terms_ = Terms(rows)
        sent = spark.sparkContext.broadcast(terms_.state())
        total = {r["term"]: r["n"] for r in counted(texts, sent).collect()}  # a row for each term of the index
        documents, words = total.get(-1, 0), total.get(-2, 0)
        if not documents:
            continue
        held = np.array([total.get(t, 0) for t in range(len(terms_.place))])
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], dtype=np.int64)
        best = scored(texts, sent, spark.sparkContext.broadcast(weights), documents, words, terms_.items, k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return index.select(F.col("id").alias("item_id"), F.lit(1).alias("rank"), F.col("id").alias("doc_id"), F.col("n").alias("score")).where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
