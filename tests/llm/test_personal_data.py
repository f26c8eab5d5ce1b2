"""Base spans against the plain patterns, and what weak supervision adds."""

import hashlib
import re

import pytest

from rollcall.llm import personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else (2 * int(d) if int(d) < 5 else 2 * int(d) - 9) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), order, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


TEXTS = [
    "a@b.com_x@y.org", "mail a@b@c.d.e x", "1.2.3.4.5.6.7.8 999.1.1.1", "001.002.003.255 1.2.3.256", "4111 1111 1111 1111", "4111 1111 1111 1111 1 2",
    "call +1 (555) 123-4567 now", "tel (555) 123-4567 today", "joe [at] mail [dot] com", None, "", "é🙂 x@y.zz 4111-1111-1111-1111",
    "+12.34 56", "1 " * 3000, "a" * 20000 + "@b.c", "+" + "1" * 9000, "v 1.2.3.400", "x@y", "@@..@a.b", "+1 234 567 8901 2345 6789",
    "call +1 (555) 123-4567 now", "no data here", "378282246310005 and 4111.1111.1111.1111", "10[.]0[.]0[.]1 host",
] + [f"mail u{i}@mail.example.com or +1 (555) 123-45{i:02d} from 10.0.0.{i}" for i in range(30)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def model(table):
    return personal_data.train(table)


def test_base_spans_are_those_of_the_plain_patterns(table, model, clashing):
    for r in personal_data.report(clashing(table), model).collect():
        want = plain(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_wide_candidates_are_added_and_failed_checks_are_not(table, model):
    spans = {TEXTS[r.doc_id]: r.spans for r in personal_data.report(table, model).collect()}
    assert spans["joe [at] mail [dot] com"] in ("", "email:0:23")  # too rare a form here to be sure of
    assert spans["tel (555) 123-4567 today"] == "phone:4:18"
    assert spans["v 1.2.3.400"] == "" and spans["no data here"] == "" and spans["x@y"] == ""


def test_labelers_that_agree_weigh_more(spark):
    rows = [(0, 1, 1, 1, 1, 90), (0, -1, -1, 1, -1, 60), (0, 1, 1, -1, 1, 85), (0, -1, -1, -1, -1, 65)]
    votes = spark.createDataFrame(rows, "kind int, check int, gazetteer int, context int, edges int, n long")
    from pyspark.sql import functions as F

    score = sum((F.col(c) for c in personal_data.LABELERS), F.lit(0.0))
    for _ in range(personal_data.ROUNDS):
        odds, prior = personal_data._learned(votes.withColumn("p", 1 / (1 + F.exp(-score))), personal_data.LABELERS)
        score = personal_data._weights(odds, prior, F.col, personal_data.LABELERS)
    assert odds[0, "check", 1] > 2 and odds[0, "edges", -1] < -2
    assert abs(odds[0, "context", 1]) < 0.5


def test_masking_replaces_spans_and_nothing_else(table, model):
    text = {TEXTS[r.doc_id]: r.text for r in personal_data.masked(table, model).collect()}
    assert text["mail a@b@c.d.e x"] == "mail a@[EMAIL] x"
    assert text["a@b.com_x@y.org"] == "[EMAIL][EMAIL]"
    assert text["no data here"] == "no data here" and text[""] == "" and text[None] is None
    assert text["é🙂 x@y.zz 4111-1111-1111-1111"] == "é🙂 [EMAIL] [CARD]"


def test_no_candidates_at_all(spark, docs):
    only = docs((1, "words"), (2, None), (1, "words"))
    assert [r.spans for r in personal_data.report(only).collect()] == ["", "", ""]
    assert personal_data.report(only.where("false")).count() == 0
    assert personal_data.masked(only).columns == only.columns
