"""Text cleaning, keys and similarity, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall import values as V

from .numbers import as_column, bind

# Every Unicode space separator, and no tabs: what a SQL trim is expected to strip.
SPACE_SEPARATORS = "".join(
    chr(c) for c in [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
)
# White space in a pattern, spelled out because engines disagree on the vertical tab.
BLANKS = r"[ \t\n\f\r]"


# Every ASCII character that is neither a letter, a digit nor a space.
ASCII_SYMBOLS = "".join(chr(c) for c in range(1, 128) if c != 0x20 and not chr(c).isalnum())
# Of the letters that a list of patterns starts with, how many one range of the alphabet covers.
LETTERS_PER_RANGE = 5


def plain(text, symbol: str = " ", keep_spaces: bool = True) -> Column:
    """Lower-cased text with every character but a-z, 0-9 (and the space) replaced.

    ASCII symbols go by character translation, which is several times quicker than a
    pattern. Only a text that holds more than ASCII (or the NUL, which ``translate`` cannot
    name) is searched by the pattern as well. The text itself tells which, so nothing has to be
    bound, and the whole is compiled code.
    """
    text = as_column(text)
    translated, pattern = _translated(F.lower(text), symbol, keep_spaces)
    return F.when(_all_ascii(text), translated).otherwise(F.regexp_replace(translated, pattern, symbol))


def swap_symbols(lowered: Column, symbol: str = " ", keep_spaces: bool = True) -> Column:
    """The same for a text that is in lower case already, and made in steps that are best taken once."""
    translated, pattern = _translated(lowered, symbol, keep_spaces)
    return bind(translated, lambda t: F.when(_all_ascii(t), t).otherwise(F.regexp_replace(t, pattern, symbol)))


def _translated(lowered: Column, symbol: str, keep_spaces: bool) -> tuple[Column, str]:
    """The text without ASCII symbols, and the pattern of what is still to be replaced in it."""
    known = ASCII_SYMBOLS if keep_spaces else ASCII_SYMBOLS + " "
    return F.translate(lowered, known, symbol * len(known)), r"[^a-z0-9 ]" if keep_spaces else r"[^a-z0-9]"


def _all_ascii(text: Column) -> Column:
    return (F.octet_length(text) == F.char_length(text)) & ~text.contains("\0")


def trim(text) -> Column:
    """Strip Unicode spaces from both ends; all-ASCII text takes the quicker plain trim."""
    text = as_column(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.trim(text)).otherwise(F.btrim(text, F.lit(SPACE_SEPARATORS)))


def squeeze(text, pattern: str = BLANKS + "+", replacement: str = " ") -> Column:
    """Replace every run that matches ``pattern``."""
    return F.regexp_replace(as_column(text), pattern, replacement)


def collapse(text) -> Column:
    """Any Unicode white space to single spaces, ends stripped; NULL becomes empty text."""
    return F.coalesce(F.trim(F.regexp_replace(as_column(text), r"(?U)\s+", " ")), F.lit(""))


def upper_key(text) -> Column:
    """Comparison key of a short answer: blanks and hyphens squeezed, trimmed, upper case."""
    squeezed = squeeze(F.coalesce(as_column(text), F.lit("")), r"[ \t\n\f\r-]+")
    return F.upper(trim(squeezed))


def sized_code(code, length: int) -> Column:
    """A trimmed identifier in upper case where it has exactly ``length`` characters, else NULL."""
    code = as_column(code)
    return F.when(F.length(code) == length, F.upper(code))


def validated_code(text, length: int) -> Column:
    """An identifier, trimmed and in upper case, where it has exactly ``length`` characters, else NULL."""
    return sized_code(trim(text), length)


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word boundaries, whatever letters stand next to it."""
    return rf"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def matches_word(text, pattern: str) -> Column:
    """True where a whole word (ASCII boundaries) matches, ignoring case."""
    return F.lower(as_column(text)).rlike(whole_word(pattern))


def matches_any_of(first, second, pattern: str) -> Column:
    """Search two columns at once; a NULL first column is tolerated, a NULL second gives NULL."""
    joined = F.concat(F.coalesce(as_column(first), F.lit("")), F.lit(" "), as_column(second))
    return F.lower(joined).rlike(pattern)


def has_any(text, words) -> Column:
    """True where the text contains one of the words."""
    text = as_column(text)
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def fingerprint(text) -> Column:
    """md5 of the letters and digits of a text."""
    return F.md5(plain(text, "", keep_spaces=False))


def proposal_key(code, name, day, text) -> Column:
    """Company, meeting day and wording in one key; NULL where company or wording is missing."""
    company = F.coalesce(as_column(code), F.upper(as_column(name)))
    when = F.coalesce(as_column(day).cast("string"), F.lit(""))
    return F.concat(company, F.lit("|"), when, F.lit("|"), fingerprint(text))


def wording_key(text) -> Column:
    """Wording with symbols removed and spaces kept."""
    return plain(text, "")


def company_key(name) -> Column:
    """Company name without symbols and legal suffixes."""
    text = F.regexp_replace(plain(name), V.COMPANY_SUFFIXES, " ")
    return F.trim(F.regexp_replace(text, r" +", " "))


def normalise_title(title) -> Column:
    """Title without boilerplate, numbering, symbols and filler words.

    The steps before symbols go see any Unicode text; those after it see a-z, 0-9 and
    spaces alone. The last step drops single words, so it looks words up and needs no pattern.
    """
    symbols = next(i for i, (pattern, _) in enumerate(V.TITLE_STEPS) if pattern == r"[^a-z0-9 ]")
    text = F.lower(as_column(title))
    for pattern, replacement in V.TITLE_STEPS[:symbols]:
        text = F.regexp_replace(text, "(?U)" + pattern, replacement)
    text = swap_symbols(text, V.TITLE_STEPS[symbols][1])
    for pattern, replacement in V.TITLE_STEPS[symbols + 1 : -1]:
        text = F.regexp_replace(text, whole_words(_listed_words(pattern)), replacement)
    fillers = _listed_words(V.TITLE_STEPS[-1][0])
    kept = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(fillers))
    return F.array_join(kept, " ")


def _listed_words(pattern: str) -> list[str]:
    r"""The alternatives of a pattern of the form ``\b(one|two)\b``."""
    return _alternatives(pattern.removeprefix(r"\b(").removesuffix(r")\b"))


def whole_words(words: Sequence[str]) -> str:
    """One pattern for a list of words or phrases that stand between word boundaries."""
    return rf"(?:{any_of([rf'\b{w}' for w in words])})\b"


def word_set(text) -> Column:
    """Distinct words of a space-separated text, sorted; no words gives an empty array."""
    parts = F.filter(F.split(as_column(text), " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(parts))


def word_overlap(a: Column, b: Column) -> Column:
    """Number of words two word sets share."""
    return F.size(F.array_intersect(a, b))


def similarity_from(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard or the weighted overlap coefficient, whichever is larger; 0 where a set is empty.

    The overlap coefficient counts only where the smaller set has two words or more.
    """
    smaller = F.least(size_a, size_b)
    jaccard = F.try_divide(shared, size_a + size_b - shared)
    overlap = F.when(smaller >= 2, F.try_divide(F.lit(V.OVERLAP_WEIGHT) * shared, smaller))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(F.greatest(jaccard, overlap))


def title_similarity(a: Column, b: Column) -> Column:
    """Similarity of two word sets."""
    return similarity_from(word_overlap(a, b), F.size(a), F.size(b))


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def any_of(patterns: Sequence[str]) -> str:
    r"""One pattern for a list, arranged so that few alternatives are tried at each position of a text.

    A flat list of two hundred costs two hundred looks per character. Here a position first
    asks which part of the alphabet its letter is in, then for the letter, then for the
    next one. A ``\b`` before a letter is asked after the letter has matched.
    """
    by_letter: dict[str, list[str]] = {}
    others = []
    for part in dict.fromkeys(a for p in patterns for a in _alternatives(p)):
        bounded = part.startswith(r"\b")
        word = part[2:] if bounded else part
        if _starts_plainly(word):
            before = rf"(?<=\b{word[0]})" if bounded else ""
            by_letter.setdefault(word[0], []).append(before + word[1:])
        else:
            others.append(part)
    letters = sorted(by_letter)
    ranges = [letters[i : i + LETTERS_PER_RANGE] for i in range(0, len(letters), LETTERS_PER_RANGE)]
    found = [
        f"(?=[{part[0]}-{part[-1]}])(?:" + "|".join(f"{c}(?:{_by_next_letter(by_letter[c])})" for c in part) + ")"
        for part in ranges
    ]
    return "|".join(found + others)


def _starts_plainly(part: str) -> bool:
    return part[:1].isalnum() and part[1:2] not in set("?*+{")


def _by_next_letter(tails: Sequence[str]) -> str:
    """Alternatives that go on alike, tried as one."""
    groups: dict[str, list[str]] = {}
    single = []
    for tail in tails:
        end = tail.index(")") + 1 if tail.startswith("(?<=") else 0
        if _starts_plainly(tail[end:]):
            groups.setdefault(tail[: end + 1], []).append(tail[end + 1 :])
        else:
            single.append(tail)
    return "|".join([f"{start}(?:{'|'.join(rest)})" for start, rest in groups.items()] + single)


def rule_label(text, opposes=None, supports=None) -> Column:
    """Direction by wording. A text that hits both lists opposes, because opponents borrow the vocabulary.

    Texts that hit neither list cost most, as they are read to their end: one search for
    both lists at once settles them.
    """
    against = list(opposes or V.OPPOSES_PATTERNS)
    in_favour = list(supports or V.SUPPORTS_PATTERNS)
    return bind(
        F.regexp_replace(plain(text), whole_words(["al", "a i"]), "ai"),
        lambda t: F.when(t.isNull() | ~t.rlike(any_of(against + in_favour)), V.UNCLEAR)
        .when(t.rlike(any_of(against)), V.OPPOSES)
        .otherwise(V.SUPPORTS),
    )


def safe_token(name) -> Column:
    """A name as a file-name token."""
    return F.regexp_replace(F.regexp_replace(as_column(name), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", "")


def shape(text) -> Column:
    """Digits to 9 and letters to a, to see which layouts a text column holds."""
    digits = F.regexp_replace(as_column(text), r"[0-9]", "9")
    return F.regexp_replace(digits, r"[A-Za-z]", "a")
