"""License phrases against a plain search, and templates with words changed."""

import pytest

from rollcall.llm import licenses
from tests.llm.test_decontaminate import words

MIT = licenses.TEMPLATES[0][1].split()
TEXTS = [
    None, "", "mit", "under the MIT license under the mit license", "CC-BY-NC cc by nc", "x", "Under the  apache License, Version 2 and cc by",
    "under the mit under the mit license", "cc by nc " * 200, " ".join(MIT), " ".join(MIT[:20] + ["one", "two"] + MIT[24:]), " ".join(MIT[:10]),
    "é under the mit license é", "under the mit license under the mit license",
    "under the mit under the mit", "copies of the software and " * 40, "permission is hereby " * 60, "x " * 50 + " ".join(MIT[:60]) + " y" * 50 + " " + " ".join(MIT[60:]),
    " ".join(w for i in range(0, len(MIT), 6) for w in [*MIT[i : i + 6], "and", "so", "on", "and", "on"]), " ".join(MIT) + " " + "word " * 3000 + " ".join(MIT[:30]),
]


def plain(text):
    w, at = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


@pytest.fixture(scope="module")
def found(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("x")).withColumn("template", F.lit("y"))
    return rows, licenses.scan(table).collect()


def test_base_phrases(found):
    rows, got = found
    assert sorted(((r.doc_id, *tuple(r)[1:6]) for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_templates_with_words_changed(found):
    by = {r.doc_id: r for r in found[1]}
    assert by[9].labels == "mit" and by[9].score == 1.0 and by[9].base_labels == ""
    assert by[10].labels == "mit" and 0.8 < by[10].score < 1.0
    assert by[11].labels == "" and 0 < by[11].score < licenses.ENOUGH
    assert by[0].labels == "" and by[0].score == 0.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found[1])


def aligned(text, template):
    """The share of a template's k-grams in the best span, plainly: hits by diagonal, near ones merged, distinct places counted."""
    w, p, k = words(text), template.split(), licenses.K
    grams = [tuple(p[j : j + k]) for j in range(len(p) - k + 1)]
    by = {}
    for i in range(len(w) - k + 1):
        for j, g in enumerate(grams):
            if tuple(w[i : i + k]) == g:
                by.setdefault(i - j, set()).add(j)
    best, span, first, last = 0, set(), None, None
    for d in sorted(by):
        if last is None or d - last > licenses.APART or d - first > max(licenses.APART, int(licenses.DRIFT * len(grams))):
            span, first = set(), d
        span, last = span | by[d], d
        best = max(best, len(span))
    return best / len(grams)


def test_labels_and_score_against_plain_alignment(found):
    rows, got = found
    want = []
    for i, text in rows:
        shares = [(aligned(text, " ".join(ws)), label) for _, label, ws, _ in licenses.templates()]
        labels = {label for share, label in shares if share >= licenses.ENOUGH} | set(filter(None, plain(text)[4].split(",")))
        want.append((i, ",".join(sorted(labels)), max(share for share, _ in shares)))
    assert sorted(((r.doc_id, r.labels, r.score) for r in got), key=repr) == sorted(want, key=repr)


def test_words_that_come_again_and_again_are_no_license(found):
    by = {r.doc_id: r for r in found[1]}
    assert [by[i].labels for i in (14, 15, 16)] == ["", "", ""] and by[16].score < 0.1
    assert by[17].score < 0.7 and by[18].labels == "" and by[19].labels == "mit"


def test_empty_table(docs):
    assert licenses.scan(docs((1, "x")).where("false")).count() == 0
