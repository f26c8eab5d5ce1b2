"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone, by pattern and check) always stay. Beside them, wider patterns
give candidates. Four labelers vote on every candidate, base ones included: the
pattern's own check, a gazetteer (domains, card issuers, dialling codes), cue words before the
span, and the characters around it. Expectation-maximisation over the counts of vote patterns
estimates what each labeler's vote is worth for each kind; its posteriors train a naive Bayes
classifier on features of the span, and that classifier decides on the wider candidates that pass their check.

Votes and features are counted over all documents; a candidate's row has a fixed
number of forms, so what is counted has a bounded size. Finding spans is one pass without shuffle.

Defined results: null and empty texts have no spans. Positions are code points from 0, ends
exclusive. Matches that fail their check are dropped without another try. Rows are judged one by one, so repeated
rows give equal results. Where no candidate exists, nothing is added. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import hex_digest, let, places, stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Look-behinds, \\G and possessive loops save time and stack; they match what the plain patterns match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: written-out addresses, numbers without a country code, octets in brackets.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
# Of a text without these, no pattern of the kind can match.
NEEDS = {
    "email": lambda t: t.contains("@") | t.contains("[at]") | t.contains("(at)"),
    "ip": lambda t: t.rlike(r"[0-9][.\[]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}|[0-9]{4}[./][0-9]{4}[./]"),
    "phone": lambda t: t.contains("+") | t.rlike(r"[0-9][)]?[\x20.-][0-9]{3}"),
}
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CUES = {
    "email": r"(?i)(?:mail|contact|write to|reach|courriel|correo)",
    "ip": r"(?i)(?:\bip\b|address|server|host|login|from|adresse)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|anruf|appel|llam)",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|ticket|\bid\b|\bno\.|[=#$])\W*$"
BEFORE = 24  # characters of context
ROUNDS = 10
LABELERS = ("check", "gazetteer", "context", "edges")
FEATURES = ("check", "chars", "digits", "marks", "before", "after", "context")

SPAN = "struct<start:int,end:int,kind:int,base:boolean,wide:boolean,check:int,gazetteer:int,context:int,edges:int,chars:int,digits:int,marks:int,before:int,after:int>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of every match, from what stands between the matches."""

    def at(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        pieces = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
        return F.aggregate(
            pieces,
            zero,
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + F.length(p["value"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["value"].alias("value")))).alias("out"),
            ),
        )["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(i: Column, back: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = let(F.reverse(digits), lambda back: F.aggregate(places(F.length(back)), F.lit(0), lambda acc, i: acc + part(i, back)))
    return total % 10 == 0


def octets(value: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return let(only_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(only_digits(value)).between(10, 15)


def listed(kind: str, value: Column) -> Column:
    """The gazetteer's vote."""
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*DOMAIN_ENDS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(value.rlike(r"^0*(?:0|127|255)[.\[]"), -1).otherwise(0)
    if kind == "card":
        return F.when(only_digits(value).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"), 1).otherwise(-1)
    return F.when(value.startswith("+"), F.when(value.rlike(r"^\+[1-9]"), 1).otherwise(-1)).otherwise(0)


def char_class(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 mark."""
    return (
        F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)
    )


def described(text: Column, kind: str, found: Column, base: bool) -> Column:
    """The matches of a kind with check, votes and features."""

    def one(m: Column) -> Column:
        value, start = m["value"], m["start"]
        end = start + F.length(value)
        ahead = F.substring(text, F.greatest(start - BEFORE + 1, F.lit(1)), F.least(start, F.lit(BEFORE)))

        def of(before: Column) -> Column:
            near, far = F.substring(before, F.lit(-1), F.lit(1)), F.substring(text, end + 1, F.lit(1))
            cue = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
            edges = F.when(near.rlike(r"[\p{L}0-9=#_/]") | far.rlike(r"[\p{L}0-9_/]"), -1).otherwise(1)
            ok = valid(kind, value)
            digits = F.length(only_digits(value))
            marks = F.length(F.regexp_replace(value, r"[\p{L}0-9]", ""))
            return let(
                ok,
                lambda ok: F.struct(
                    start.alias("start"),
                    end.alias("end"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (ok if base else F.lit(False)).alias("base"),
                    F.lit(not base).alias("wide"),
                    F.when(ok, 1).otherwise(-1).alias("check"),
                    listed(kind, value).alias("gazetteer"),
                    cue.alias("context"),
                    edges.alias("edges"),
                    F.least(F.floor(F.length(value) / 4), F.lit(8)).cast("int").alias("chars"),
                    F.least(digits, F.lit(20)).alias("digits"),
                    F.least(marks, F.lit(6)).alias("marks"),
                    char_class(near).alias("before"),
                    char_class(far).alias("after"),
                ),
            )

        return let(ahead, of)

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """All candidates of a text; wide ones that touch a match of the base pattern are left out."""

    def of_kind(text: Column, kind: str) -> Column:
        def both(own: Column) -> Column:
            wide = described(text, kind, matches(text, WIDE[kind]), base=False)
            clear = F.filter(wide, lambda w: ~F.exists(own, lambda o: (w["start"] < o["end"]) & (o["start"] < w["end"])))
            return F.concat(own, clear)

        return F.when(NEEDS[kind](text), let(described(text, kind, matches(text, BASE[kind]), base=True), both)).otherwise(
            F.array().cast(f"array<{SPAN}>")
        )

    def of(text: Column) -> Column:
        return F.concat(*[of_kind(text, kind) for kind in KINDS]).cast(f"array<{SPAN}>")

    return let(F.coalesce(text, F.lit("")), of)


def vote_counts(docs: DataFrame) -> DataFrame:
    """How often each form of a candidate (kind, votes, features) occurs in all documents."""
    each = docs.select(F.explode(candidates(F.col("text"))).alias("s")).select("s.*").where("chars > 0")
    return each.groupBy("kind", *dict.fromkeys(LABELERS + FEATURES)).agg(F.count(F.lit(1)).alias("n"))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _weights(odds: dict[tuple[int, str, int], float], prior: dict[int, float], of: Callable[[str], Column], names: tuple[str, ...]) -> Column:
    """Log odds of a row: the prior of its kind and a weight for each named value."""
    flat = [F.lit(x) for (k, name, v), w in sorted(odds.items()) for x in (f"{k}|{name}|{v}", float(w))]
    base = [F.lit(x) for k in range(len(KINDS)) for x in (k, float(prior.get(k, 0.0)))]
    table = F.create_map(*flat) if flat else F.create_map().cast("map<string,double>")
    total = F.create_map(*base)[of("kind")]
    for name in names:
        total = total + F.coalesce(table[F.concat_ws("|", of("kind").cast("string"), F.lit(name), of(name).cast("string"))], F.lit(0.0))
    return total


def _learned(weighted: DataFrame, names: tuple[str, ...]) -> tuple[dict, dict]:
    """Log odds of each value, and of each kind, from rows with a count ``n`` and a probability ``p``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("x")
    rows = (
        weighted.select("kind", "n", "p", pairs)
        .groupBy("kind", "x.name", "x.value")
        .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        .collect()  # bounded: kinds, names and values are fixed
    )
    totals: dict[tuple[int, str], list[float]] = {}
    for r in rows:
        t = totals.setdefault((r["kind"], r["name"]), [0.0, 0.0, 0.0])
        t[0], t[1], t[2] = t[0] + r["yes"], t[1] + r["no"], t[2] + 1
    odds = {
        (r["kind"], r["name"], r["value"]): math.log(
            (r["yes"] + 1) / (totals[r["kind"], r["name"]][0] + totals[r["kind"], r["name"]][2] + 1)
        )
        - math.log((r["no"] + 1) / (totals[r["kind"], r["name"]][1] + totals[r["kind"], r["name"]][2] + 1))
        for r in rows
    }
    prior = {k: logit((t[0] + 1) / (t[0] + t[1] + 2)) for (k, name), t in totals.items() if name == names[0]}
    return odds, prior


def train(docs: DataFrame) -> tuple[dict, dict]:
    """The classifier: log odds of feature values and of kinds, from EM over the labelers' votes in ``docs``."""
    counts = stored(vote_counts(docs), "votes")
    # The first guess is the sum of the votes; then labelers are weighed by how they agree with the posterior.
    score = sum((F.col(c) for c in LABELERS), F.lit(0.0))
    for _ in range(ROUNDS):
        odds, prior = _learned(counts.withColumn("p", 1 / (1 + F.exp(-score))), LABELERS)
        score = _weights(odds, prior, F.col, LABELERS)
    return _learned(counts.withColumn("p", 1 / (1 + F.exp(-score))), FEATURES)


def found(text: Column, model: tuple[dict, dict]) -> Column:
    """Array of (start, kind, end, base): the base spans, and the candidates that the classifier takes."""
    odds, prior = model

    def taken(s: Column) -> Column:
        # A match of a base pattern that failed its check only teaches; it is never taken.
        return s["base"] | (s["wide"] & (s["check"] == 1) & (_weights(odds, prior, lambda c: s[c], FEATURES) > 0))

    # Of candidates that are no base spans, those that touch one of any kind give way.
    def apart(all_: Column) -> Column:
        base = F.filter(all_, lambda s: s["base"])
        return F.filter(all_, lambda s: s["base"] | ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))

    kept = let(F.filter(candidates(text), taken), apart)
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, model: tuple[dict, dict] | None = None) -> DataFrame:
    """Per document the number of base spans by kind, their digest, and all spans."""
    model = model or train(docs)

    def row(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
        return F.struct(*[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], hex_digest(written(base)).alias("base_sha256"), written(spans).alias("spans"))

    return docs.select("doc_id", let(found(F.col("text"), model), row).alias("r")).select("doc_id", "r.*")


def masked(docs: DataFrame, model: tuple[dict, dict] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one, under the first one's kind."""
    model = model or train(docs)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewritten(text: Column, spans: Column) -> Column:
        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            clear = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
            return F.when(s["start"] >= acc["at"], F.struct(clear.alias("out"), s["end"].alias("at"))).otherwise(
                F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
            )

        done = F.aggregate(spans, zero, step)
        return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))

    spans = let(found(F.col("text"), model), lambda s: F.when(F.size(s) > 0, rewritten(F.col("text"), s)).otherwise(F.col("text")))
    return docs.withColumn("text", spans)
