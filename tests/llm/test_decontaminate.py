"""Benchmark windows against a plain search, and the cases that data may bring."""

import hashlib
import random
import re

import pytest

from rollcall.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            i = words(item)
            size = min(n, len(i))
            grams = {tuple(i[p : p + size]) for p in range(len(i) - size + 1)} if i else set()
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in grams:
                    hit.update(range(p, p + size))
                    found.add(item_id)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), len({i for i in found if i is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


CASES = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "ONE, two; three-four five six seven eight nine TEN eleven twelve"),
    (3, None),
    (4, ""),
    (5, "short item here and short ITEM"),
    (6, "--- !!!"),
    (7, "eins zwei " * 30),
    (7, "eins zwei " * 30),
    (None, "x short item y"),
    (8, "é ñ 🙂 short item"),
]
ITEMS = [
    (10, "two three four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, None),
    (4, "..."),
    (5, "zwei eins zwei eins zwei eins zwei eins zwei eins zwei eins"),
    (6, "short item"),
]


def test_cases_against_a_plain_search(spark, docs, clashing):
    got = decontaminate.report(clashing(docs(*CASES)), clashing(items_table(spark, ITEMS))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(CASES, ITEMS)


def test_random_texts_against_a_plain_search(spark, docs):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["a", "b", "c."]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 80))) for i in range(40)]
    items = [(i, say(rng.randint(0, 12))) for i in range(6)]
    got = decontaminate.report(docs(*rows), items_table(spark, items), n=4).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, items, 4)


def test_a_large_benchmark_takes_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "SET_ROWS", 2)
    got = decontaminate.report(docs(*CASES), items_table(spark, ITEMS)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(CASES, ITEMS)


@pytest.mark.parametrize("items", [[], [(1, None)]])
def test_nothing_to_find(spark, docs, items):
    rows = decontaminate.report(docs(*CASES), items_table(spark, items)).collect()
    assert len(rows) == len(CASES) and not any(r.contaminated for r in rows)
    assert decontaminate.report(docs(*CASES).where("false"), items_table(spark, ITEMS)).count() == 0


def test_removal_of_documents_and_of_spans(spark, docs):
    d, items = docs(*CASES), items_table(spark, ITEMS)
    hit = {r[0] for r in plain(CASES, ITEMS) if r[5]}
    kept = decontaminate.remove(d, items)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in CASES if i not in hit)
    cut = {r.doc_id: r.text for r in decontaminate.remove(d, items, spans=True).collect()}
    assert cut[1] == "one " and cut[5] == "here and " and cut[3] is None and cut[8] == "é ñ 🙂 "
    assert cut[2] == "ONE, "
