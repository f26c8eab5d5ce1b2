"""Decisions: code tables, ordered rules and labels as one ``when`` chain each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall import values as V

from .numbers import as_column, round_half_even


def _chain(cases, default) -> Column:
    out = None
    for condition, answer in cases:
        out = F.when(condition, answer) if out is None else out.when(condition, answer)
    return F.lit(default) if out is None else out.otherwise(default)


def decode(code, words: Mapping[str, str], default: str) -> Column:
    """Word of a code, or the default."""
    code = as_column(code)
    return _chain([(code == key, word) for key, word in words.items()], default)


def first_match(text, cases: Sequence[tuple[str, str]], default: str) -> Column:
    """Word of the first substring found, ignoring case."""
    text = as_column(text)
    return _chain([(text.ilike(f"%{part}%"), word) for part, word in cases], default)


def first_true(cases: Sequence[tuple], default: str) -> Column:
    """Word of the first flag that is true."""
    return _chain([(as_column(flag), word) for flag, word in cases], default)


def standardise(text, spellings: Mapping[str, Sequence[str]], other, blank=None) -> Column:
    """The standard answer for a known spelling, one word for blank text and one for all others.

    One map lookup rather than a chain of comparisons: a filter on the answer is pushed
    below the projection that makes it, and would repeat the key in every comparison.
    """
    table = {known: standard for standard, known_as in spellings.items() for known in known_as}
    if blank is not None:
        table[""] = blank
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, as_column(text)), F.lit(other))


def word_to_bool(word, yes: str, no: str) -> Column:
    """True, false or NULL."""
    word = as_column(word)
    return F.when(word == yes, True).when(word == no, False)


def fund_group(is_reference, is_themed) -> Column:
    """Yardstick houses first, then themed funds, then the rest; a NULL flag counts as not set."""
    yardstick, themed, rest = V.FUND_GROUPS
    return first_true([(is_reference, yardstick), (is_themed, themed)], rest)


def outcome(rate_a, rate_b) -> Column:
    """Same majority, or which side was more supportive."""
    same, more, less = V.SIBLING_OUTCOMES
    a, b = as_column(rate_a), as_column(rate_b)
    return F.when(F.round(a) == F.round(b), same).when(a > b, more).otherwise(less)


def threshold_label(
    pct,
    n,
    min_n: int = V.MIN_REFERENCE_VOTES,
    high: float = V.SUPPORTS_FROM_PCT,
    low: float = V.OPPOSES_UP_TO_PCT,
) -> Column:
    """Direction from how the reference group voted, on the percent rounded to one digit."""
    pct = round_half_even(pct, 1)
    return (
        F.when(as_column(n) < min_n, V.TOO_FEW_VOTES)
        .when(pct >= high, V.SUPPORTS)
        .when(pct <= low, V.OPPOSES)
        .otherwise(V.UNCLEAR)
    )


def resolve(by_reference, by_wording) -> Column:
    """Final direction and its basis: reference votes decide where there are enough of them."""
    reference = as_column(by_reference)
    clear = reference.isin(V.SUPPORTS, V.OPPOSES)
    split = reference == V.UNCLEAR
    direction = F.when(clear, reference).when(split, V.SPLIT).otherwise(as_column(by_wording))
    basis = F.when(clear | split, V.BY_REFERENCE).otherwise(V.BY_WORDING)
    return F.struct(direction.alias("direction"), basis.alias("basis"))


def hybrid(rule, model) -> Column:
    """The rule's label, or the model's where the rule gives none."""
    rule = as_column(rule)
    return F.when(rule == V.UNCLEAR, as_column(model)).otherwise(rule)


def any_wrong(truth, said) -> Column:
    """True where one of several systems disagrees with the truth; a missing answer is wrong."""
    truth = as_column(truth)
    out = F.lit(False)
    for answer in said:
        out = out | ~as_column(answer).eqNullSafe(truth)
    return out
