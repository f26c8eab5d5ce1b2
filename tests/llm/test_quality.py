"""The language model against a plain one, and what the classifier keeps."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import quality
from rollcall.llm.common import batches_of

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice("abcdefgh") + rng.choice(["ing", "er", "ed"])
    good = [(i, " ".join(word() for _ in range(rng.randint(20, 60))), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice("QXZ") * 6 + "##!" for _ in range(40)), "en") for i in range(20)]
    labels = [(i, 1, 0) for i, _, _ in good[:250]] + [(i, 0, 0) for i, _, _ in junk[:5]]
    return good + junk, labels


def plain(rows, labels, held):
    """Interpolated modified Kneser-Ney with dictionaries."""
    trusted = {i for i, q, _ in labels if q == 1} - {i for i, q, _ in labels if q != 1}
    train = [t.split() for i, t, _ in rows if i in trusted and i not in held]
    known = {w for t in train for w in t}
    name = lambda w: w if w in known else quality.shape(w)
    pairs = Counter(p for t in train for p in zip([None] + [name(w) for w in t], [name(w) for w in t]))
    total, ones, twos, more, left = Counter(), Counter(), Counter(), Counter(), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        left[w] += 1
        (ones if n == 1 else twos if n == 2 else more)[v] += 1
    many = lambda c: np.array([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    d, low = quality.discounts(many(pairs)), quality.discounts(many(left))
    cut = lambda n, by: max(0.0, n - (0, *by)[min(n, 3)])
    entries, all_left = len(known) + quality.SHAPES, sum(left.values())
    freed = 1 - sum(cut(n, low) for n in left.values()) / all_left

    def log_probability(v, w):
        base = cut(left[w], low) / all_left + freed / entries
        if not total[v]:
            return math.log(base)
        rest = (d[0] * ones[v] + d[1] * twos[v] + d[2] * more[v]) / total[v]
        return math.log(cut(pairs[v, w], d) / total[v] + rest * base)

    return {i: sum(log_probability(v, w) for v, w in zip([None] + [name(w) for w in t.split()], [name(w) for w in t.split()])) for i, t, _ in rows}


@pytest.mark.parametrize("words, tokens, block, turns, broadcast", [(100_000, 1_000_000, 12_000_000, 256, 1_000_000), (5, 300, 500, 2, 0)])
def test_perplexities_against_a_plain_model(spark, docs, monkeypatch, words, tokens, block, turns, broadcast):
    for name, value in (("SHARD_WORDS", words), ("SHARD_TOKENS", tokens), ("BLOCK_CHARS", block), ("BLOCKS_A_TASK", turns), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(quality, name, value)
    rows, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    held = {r.doc_id for r in quality.trusted_ids(table).where("held").collect()}
    assert 5 < len(held) < 60
    want = plain(rows, labels, held)
    for r in quality.perplexities(docs(*rows), table).collect():
        assert math.isclose(r.log_probability, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
        assert r.role == (2 if r.doc_id in held else 1 if r.doc_id < 250 else 0)


def test_a_task_with_several_turns_of_a_shard_in_parts_answers_each_turn_rightly(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 500)
    monkeypatch.setattr(quality, "BLOCKS_A_TASK", 2)
    rows, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    held = {r.doc_id for r in quality.trusted_ids(table).where("held").collect()}
    want = plain(rows, labels, held)
    with batches_of(spark, 7):  # a part of a shard holds seven words then
        got = quality.perplexities(docs(*rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.log_probability, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)


def test_junk_goes_and_clean_text_stays(spark, docs, clashing):
    rows, labels = corpus()
    d = clashing(docs(*rows))
    kept = quality.kept(d, clashing(spark.createDataFrame(labels, LABELS)))
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [i for i in ids if i >= 1000] and len([i for i in ids if i < 300]) >= 297


def test_defined_cases(spark, docs):
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, " \n "), (None, "the of and"), (5003, "the of", None), (5004, "the " * 5000), (5005, "of and"), (5005, "of and")]
    more = labels + [(0, 0, 0), (0, 1, 0), (None, 1, 0), (9999, 1, 0), (5003, None, None)]
    got = quality.judge(docs(*rows, *odd), spark.createDataFrame(more, LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].perplexity is None and not by[i].keep and by[i].n_tokens == 0 for i in (5000, 5001, 5002))
    assert by[5003].lang == "" and by[5003].threshold is not None and by[None].perplexity > 0


def test_no_labels_and_no_documents(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert {r.keep for r in quality.judge(docs((1, "some words"), (2, "more")), none).collect()} == {True}
    assert quality.judge(docs((1, "x")).where("false"), none).count() == 0


def test_rare_trusted_words_are_told_from_random_strings_however_many_there_are(spark, docs):
    word = lambda n: "".join("abcdefghij"[int(c)] for c in f"{n:07d}")
    rows = [(i, " ".join(word(1000 * i + k) for k in range(1000))) for i in range(80)]
    table = spark.createDataFrame([(i, 1, 0) for i, _ in rows], LABELS)
    held = {r.doc_id for r in quality.trusted_ids(table).where("held").collect()}
    assert 1000 * (80 - len(held)) > 65_000
    last = max(i for i, _ in rows if i not in held)
    rare, random_one, parted = word(1000 * last + 999), "jihgfed", "\u2003".join([word(1000 * last + 998)] * 2)
    got = {r.doc_id: r for r in quality.perplexities(docs(*rows, (900, rare), (901, random_one), (902, parted)), table).collect()}
    assert quality.shape(rare) == quality.shape(random_one)
    assert got[900].log_probability > got[901].log_probability and got[902].n_tokens == 2


def test_every_language_has_its_own_threshold(spark, docs):
    rows, labels = corpus()
    rng = random.Random(4)
    few = [(2000 + i, " ".join(rng.choice(["der", "die", "und", "haus", f"wort{i}{k}"]) for k in range(30)), "de") for i in range(12)]
    none = [(3000 + i, f"nunca visto {i} texto ajeno", "es") for i in range(5)]
    table = spark.createDataFrame(labels + [(i, 1, 0) for i, _, _ in few], LABELS)
    held = {r.doc_id for r in quality.trusted_ids(table).where("held").collect()}
    scores = {r.doc_id: r for r in quality.perplexities(docs(*rows, *few, *none), table).collect()}
    got = {r.doc_id: r for r in quality.judge(docs(*rows, *few, *none), table).collect()}
    assert all(got[i].keep and math.isinf(got[i].threshold) for i, _, _ in none)
    assert got[2000].threshold != got[0].threshold and all(got[i].keep for i, _, _ in few)

    # A training document under the counts of all others, with the whole model's sums.
    texts = {i: [None] + t.split() for i, t, _ in rows + few}
    trusted = {i for i, q, _ in labels if q == 1} | {i for i, _, _ in few}
    count = lambda ids: Counter(p for i in ids for p in zip(texts[i], texts[i][1:]))
    whole = count(trusted - held)
    left = Counter(w for _, w in whole)
    many = lambda c: np.array([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    d, low = quality.discounts(many(whole)), quality.discounts(many(left))
    cut = lambda n, by: max(0.0, n - (0, *by)[min(n, 3)])
    freed = 1 - sum(cut(n, low) for n in left.values()) / len(whole)
    for i in [x for x in (0, 1, 2, 2000, 2001, 2005) if x not in held]:
        others = count(trusted - held - {i})
        kinds = Counter(w for _, w in others)
        want = 0.0
        for v, w in zip(texts[i], texts[i][1:]):
            after = [n for (x, _), n in others.items() if x == v]
            base = cut(kinds[w], low) / len(whole) + freed / (len(left) + quality.SHAPES)
            rest = sum(d[min(n, 3) - 1] for n in after) / sum(after) if after else 1.0
            want += math.log((cut(others[v, w], d) / sum(after) if after else 0.0) + rest * base)
        assert math.isclose(scores[i].left_out, want, rel_tol=1e-9)


def test_toxic_documents_are_not_trusted(spark):
    table = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 1, 0), (4, 1, 1), (5, 0, 0)], LABELS)
    assert {r.doc_id for r in quality.trusted_ids(table).collect()} == {1, 3}


def test_rows_in_another_order_and_repeated_blocks_give_the_same_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 400)
    rows, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    score = lambda d: sorted((r.doc_id, round(r.log_probability, 9), round(r.left_out, 9)) for r in quality.perplexities(d, table).collect() if r.left_out is not None)
    once = score(docs(*rows).coalesce(1))
    assert score(docs(*rows[::-1]).repartition(5)) == once
    # The same partition twice: its blocks have one name.
    both = docs(*rows).coalesce(1)
    twice = quality.perplexities(both.unionByName(both), table).collect()
    assert len(twice) == 2 * len(rows) and {r.doc_id for r in twice} == {i for i, *_ in rows}
    assert len({(r.doc_id, round(r.log_probability, 9)) for r in twice}) == len(rows)


def test_a_block_that_is_cut_otherwise_fails(spark, docs):
    rows, labels = corpus()
    flags, _ = quality.flagged(docs(*rows), spark.createDataFrame(labels, LABELS))
    _, block, _ = quality.cut(flags, 1, "blocks")
    none = spark.createDataFrame([], "block long, places binary, told binary")
    with pytest.raises(Exception, match="cut otherwise"):
        quality.pairs_asked(block, none, 1, [0] * 5).collect()


def test_rows_are_kept_by_their_own_text(spark, docs):
    rows, labels = corpus()
    junk = "QQQQQQ##! " * 40
    odd = [(270, junk), (None, junk), (None, ""), (None, rows[3][1]), (7000, rows[4][1]), (7000, None)]
    kept = {(r.doc_id, r.text) for r in quality.kept(docs(*rows, *odd), spark.createDataFrame(labels, LABELS)).collect()}
    assert (270, rows[270][1]) in kept and (None, rows[3][1]) in kept and (7000, rows[4][1]) in kept
    assert not {(270, junk), (None, junk), (None, ""), (7000, None)} & kept


def test_works_from_another_folder_without_the_package_on_the_workers_path(tmp_path):
    """As a plain cluster submit: the driver finds the package, the workers do not."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path / "shared")!r})
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from rollcall.llm import quality
from rollcall.llm.common import batches_of
docs = spark.createDataFrame([(i, "the cat and the dog " * (i + 1), "en") for i in range(20)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
print("rows", quality.judge(docs, labels).count())
""")
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 20" in done.stdout, done.stderr[-2000:]
