"""Packing against a plain quadratic best fit, and what must hold of any packing."""

import random

from rollcall.llm import packing


def plain(lengths, capacities):
    """The same rules, worked out by looking at every bin every time."""
    best = None
    for ceiling in sorted(capacities):
        bins, left = [], sum(lengths)
        for at, n in enumerate(lengths):
            open_ = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n]
            if open_:
                b = bins[min(open_)[1]]
            else:
                sizes = [c for c in capacities if n <= c <= ceiling] or [min(c for c in capacities if c >= n)]
                size = min(sizes, key=lambda c: (packing.cost(c) / min(c, left), c))
                b = {"room": size, "items": []}
                bins.append(b)
            b["room"] -= n
            b["items"].append(at)
            left -= n
        sizes = [min(c for c in capacities if c >= sum(lengths[i] for i in b["items"])) for b in bins]
        total = sum(packing.cost(c) for c in sizes)
        if best is None or total < best[0]:
            best = total, [b["items"] for b in bins], sizes
    return best[1], best[2]


def test_against_a_plain_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        caps = sorted(rng.sample(range(4, 70), 3))
        lengths = sorted((rng.randint(1, caps[-1]) for _ in range(rng.randint(1, 60))), reverse=True)
        assert packing.pack_shard(lengths, caps) == plain(lengths, caps)


def test_every_token_has_one_place(spark, clashing):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200, 1000])) for i in range(400)] + [(None, 7), (None, 7), (1, None), (2, -3), (3, 3), (3, 3)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, n_tokens long"))
    got = packing.pack(table, (16, 32, 64)).collect()
    assert sum(r.n_tokens for r in got) == sum(max(n or 0, 0) for _, n in rows)
    assert sum(r.pack is None for r in got) == sum((n or 0) <= 0 for _, n in rows)
    bins = {}
    for r in got:
        if r.pack:
            bins.setdefault(r.pack, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert members[0].capacity == packing.downsized(at, (16, 32, 64)) and len({m.capacity for m in members}) == 1
    long = sorted((r.piece, r.n_tokens) for r in got if r.doc_id == next(i for i, n in rows if n == 200 and i > 10))
    assert long == [(0, 64), (1, 64), (2, 64), (3, 8)]


def test_shards_pack_alike_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    table = spark.range(300).selectExpr("id as doc_id", "1 + id * 37 % 90 as n_tokens")
    a = sorted(map(tuple, packing.pack(table, (64, 128)).collect()))
    assert a == sorted(map(tuple, packing.pack(table.repartition(5), (64, 128)).collect()))
    assert len({r[3].split("-")[0] for r in a}) > 3


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
