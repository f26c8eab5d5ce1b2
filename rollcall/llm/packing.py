"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest length are cut into pieces of it. The pieces are dealt into
shards by a hash, each of some SHARD_ROWS rows, and packed shard by shard, longest first: a
piece goes to the open bin with the least room that still holds it; where none does, the bin
size with the least cost for each token that can still fill it is opened. This is tried with every permitted length
as the ceiling for new bins, the cheapest outcome is kept, and each bin is then cut down
to the shortest permitted length that holds its contents.

Defined results: every piece is in one bin. Documents of length null, zero or below are listed
without a bin. Repeated rows are packed as often as they come; ties are in order of id (null first) and piece.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# Cost of a sequence in token units: a fixed part, one for each place, and attention, which grows with the square.
FIXED_COST, ATTENTION_AT = 32.0, 65536.0
# Rows that one task packs at a time; more rows make more shards.
SHARD_ROWS = 8192

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_tokens(text: Column) -> Column:
    """Length of a text in words and marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s\p{P}\p{S}]+|[\p{P}\p{S}]"))


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / ATTENTION_AT


def best_fit(lengths: Sequence[int], capacities: Sequence[int], ceiling: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``, which run from long to short; new bins are no larger than the ceiling, if that holds the piece."""
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[list[int]] = []
    left = sum(lengths)
    for at, n in enumerate(lengths):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(at)
        else:
            sizes = [c for c in capacities if n <= c <= ceiling] or [min(c for c in capacities if c >= n)]
            free, b = min(sizes, key=lambda c: (cost(c) / min(c, left), c)), len(bins)
            bins.append([at])
        if free > n:
            insort(room, (free - n, b))
        left -= n
    return bins


def downsized(contents: int, capacities: Sequence[int]) -> int:
    return min(c for c in capacities if c >= contents)


def pack_shard(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """The cheapest packing over all ceilings: the bins and their final sizes; of equals, the one with the lowest ceiling."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for ceiling in sorted(capacities):
        bins = best_fit(lengths, capacities, ceiling)
        sizes = [downsized(sum(lengths[i] for i in b), capacities) for b in bins]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, bins, sizes
    return best[1], best[2]


def pack(docs: DataFrame, capacities: Iterable[int] = CAPACITIES) -> DataFrame:
    """(doc_id, piece, n_tokens, pack, capacity, start) of ``docs`` (doc_id, n_tokens).

    ``pack`` names the sequence, ``start`` is the piece's place in it; ``piece`` counts from 0.
    """
    caps = sorted(set(capacities))
    most = caps[-1]
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    sized = docs.select("doc_id", n.alias("n"))
    pieces = sized.where("n > 0").select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece")
    ).select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("int").alias("n_tokens"))
    shards = max(1, -(-pieces.count() // SHARD_ROWS))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first").reset_index(drop=True)
        lengths = rows["n_tokens"].tolist()
        bins, sizes = pack_shard(lengths, caps)
        name, size, start = [""] * len(rows), [0] * len(rows), [0] * len(rows)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                name[i], size[i], start[i] = f"{rows['shard'].iloc[0]}-{b}", sizes[b], at
                at += lengths[i]
        return rows.assign(pack=name, capacity=size, start=start)[["doc_id", "piece", "n_tokens", "pack", "capacity", "start"]]

    shape = "doc_id long, piece long, n_tokens int, pack string, capacity int, start int"
    packed = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(run, shape)
    )
    empty = sized.where("n <= 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).alias("n_tokens"),
        F.lit(None).cast("string").alias("pack"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("start"),
    )
    return packed.unionByName(empty)
