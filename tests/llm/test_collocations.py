"""Collocations against all phrases counted plainly."""

import re
import string
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import collocations

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least, longest=4):
    """(lang, phrase) -> (a, l, r, n, score) of the phrases that are kept."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in candidates.items():
        lang, ws = g[0], g[1:]
        inside = any(
            h[0] == lang and len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(ws)] == ws for i in range(1, len(h)))
            for h, b in candidates.items()
        )
        if not inside:
            cuts = [(f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws))]
            score, _, (l, r) = min((2_000_000 * a // (l + r), k, (l, r)) for k, (l, r) in enumerate(cuts))
            out[lang, " ".join(ws)] = (a, l, r, n[lang], score)
    return out


def told(df):
    rows = df.collect()
    assert len({(r.lang, r.phrase) for r in rows}) == len(rows)
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows}


def prose(rng, n, words=12):
    vocabulary = [f"{a}{b}" for a in "kLm" for b in ("a", "é", "I")] + ["new york city", "of the"]
    marks = [" ", "  ", "\t", " ", " ", ". ", ", ", "\n", " ?! "]
    return "".join(str(vocabulary[i]) + marks[j] for i, j in zip(rng.integers(0, len(vocabulary), n * words), rng.integers(0, len(marks), n * words)))


@pytest.mark.parametrize("shard, bucket", [(2_000_000, 2_000_000), (300, 200)])
def test_against_brute_force(spark, docs, clashing, monkeypatch, shard, bucket):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 2000 if shard < 1000 else 4_000_000)
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(1, 12))), ["en", "de", None][int(rng.integers(0, 3))]) for i in range(60)]
    rows += [(None, None, "en"), (5, "", None), (6, "new york city new york city", "xx"), (6, "...\n,,\t", "yy")] + [(7, "of the new of the new", "en")] * 40
    table = clashing(docs(*rows)).repartition(6)
    got = told(collocations.mine(table, least=8))
    want = brute([(lang, text) for _, text, lang in rows], 8)
    assert got == want and {len(p.split()) for _, p in want} == {2, 3, 4}


def test_shards_keep_all_words(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 64)
    table = docs((0, "a b c. " * 100, "en"), (1, "a b c " * 100, "en"), (2, "x", "de")).coalesce(1)
    shards = collocations.shards(table).collect()
    assert len(shards) > 3 and sum(r.n for r in shards) == 601 and len({r.shard for r in shards}) == len(shards)
    assert told(collocations.mine(table)) == brute([("en", "a b c. " * 100), ("en", "a b c " * 100), ("de", "x")], 30)


def test_overlaps_count_and_large_counts_stay_exact(spark, docs, monkeypatch):
    assert told(collocations.mine(docs((0, "a " * 50, "en")), least=30)) == brute([("en", "a " * 50)], 30)
    big = np.array([10**15, 10**14], dtype=np.int64)
    none = collocations.Level(None, None, None, None, {"places": np.arange(2), "numbers": big, "counts": big * 3, "own": big})
    pair = collocations.Level(big, big, np.array([0, 1]), np.array([1, 0]), {"places": np.arange(2), "numbers": big, "counts": big, "own": big})
    l, r, score = collocations.best_cut([none, pair], 2, np.arange(2))
    assert score.tolist() == [2_000_000 * int(a) // (3 * 10**15 + 3 * 10**14) for a in big] and l.tolist() == [3 * 10**15, 3 * 10**14]


def test_rank_is_by_score_count_and_bytes(spark):
    rows = [("en", "b b", 30, 9), ("en", "a z", 30, 9), ("en", "é a", 30, 9), ("en", "c c", 31, 9), ("en", "d d", 50, 8), ("de", "q q", 30, 1)]
    mined = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(r.lang, r.phrase) for r in collocations.top(mined, 4).orderBy("lang", "rank").collect()]
    assert got == [("de", "q q"), ("en", "c c"), ("en", "a z"), ("en", "b b"), ("en", "é a")]


def test_extensions_are_counted(spark, docs):
    text = ". ".join(["a b c"] * 10 + ["x a b"] * 9 + ["y a b"] * 8 + ["a b"] * 40)
    rows = {r.phrase: r for r in collocations.mine(docs((0, text)), least=5).collect()}
    assert (rows["a b"].n_left, rows["a b"].n_right, rows["a b"].a) == (2, 1, 67)


def test_empty_table(spark, docs):
    assert collocations.top(collocations.mine(docs((0, "a b")).where("false"))).count() == 0
    assert collocations.mine(docs((0, None), (1, "rare words"))).count() == 0
