"""Ranked search against plain scoring of every document for every item."""

import math
import re
import string
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import lexical

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    told = [(i, terms(t)) for i, t, *_ in docs]
    n_docs, n_words = sum(bool(ws) for _, ws in told), sum(len(ws) for _, ws in told)
    df = Counter(t for _, ws in told for t in set(ws))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for item, q in asked.items():
        found = []
        for doc, ws in told:
            if not ws:
                continue
            tf, m = Counter(ws), 100 - 75 + (75 * len(ws) * n_docs) // n_words
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, n in q.items() if t in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        if found:
            out[item] = [(doc, -s) for s, _, _, doc in sorted(found, key=lambda x: x[:3])[:k]]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize("entries, cells, size", [(1_000_000, 2_000_000, 4_000_000), (40, 100, 500)])
def test_against_brute_force(spark, docs, clashing, monkeypatch, entries, cells, size):
    for name, value in (("INDEX_ENTRIES", entries), ("CELLS", cells), ("TEXT_BYTES", size)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}" for a in "abcdefg" for b in ("x", "É", "7", "Q")]
    say = lambda n: "".join(str(rng.choice(vocabulary, p=None)) + str(rng.choice([" ", "-", "\n", "_", " \x00"])) for _ in range(n))
    rows = [(int(rng.integers(0, 300)), say(int(rng.integers(0, 40)))) for _ in range(400)]
    rows += [(None, "ax bx"), (None, None), (1, ""), (2, "..."), (3, say(3000))] + [(10, "aq bq cq")] * 30
    items = [(i, say(int(rng.integers(1, 15)))) for i in range(25)] + [(3, "ax ax bq"), (None, "cq"), (40, None), (41, "nowhere"), (42, ""), (43, "bq bq aq")]
    table = clashing(docs(*rows)).repartition(7)
    got = told(lexical.search(table, clashing(spark.createDataFrame(items, ITEMS))))
    want = brute(rows, items)
    # Rows that repeat a doc_id have equal places where their scores are equal.
    assert got == want and len(want) > 20


def test_equal_scores_are_in_order_of_id(spark, docs):
    rows = [(i, "same words here") for i in (9, 3, 30, 1, 12)] + [(None, "same words here")]
    got = told(lexical.search(docs(*rows, (50, "other"), (51, "more other")), spark.createDataFrame([(0, "words")], ITEMS), 6))
    assert [i for i, _ in got[0]] == [1, 3, 9, 12, 30, None]


def test_heaps_stay_bounded():
    heaps = lexical.Heaps(3, 2)
    for start in range(0, 400_000, 1000):
        heaps.add(np.arange(start, start + 3000).reshape(1000, 3), list(range(start, start + 1000)))
        assert heaps.held <= 4 * 2 * 3 + 100_000 + 3000
    item, score, ids, _ = heaps.merged()
    assert item.tolist() == [0, 0, 1, 1, 2, 2] and ids.tolist() == [399_999, 399_998] * 3 and score[0] == 399_000 + 2997


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(0, "a")], ITEMS)
    assert lexical.search(docs((0, "a")).where("false"), items).count() == 0
    assert lexical.search(docs((0, None)), items).count() == 0
    assert lexical.search(docs((0, "a")), items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
