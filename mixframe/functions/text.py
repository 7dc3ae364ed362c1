"""Text, key and number expressions."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that become a space and the characters that vanish.
WIDE_BLANKS = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ZERO_WIDTH = "\\u200b-\\u200d\\ufeff"

# Latin letters whose decomposition is a plain letter and marks, and that letter.
_LATIN = [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]
_FOLDED = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in _LATIN
           if chr(p).islower() and unicodedata.normalize("NFD", chr(p))[0] in string.ascii_lowercase]
FOLD_FROM, FOLD_TO = "".join(a for a, _ in _FOLDED), "".join(b for _, b in _FOLDED)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def js_int(c) -> Column:
    """Leading integer of a string, NULL when it does not start with a digit."""
    return F.regexp_extract(col(c), r"^\s*(\d+)", 1).try_cast("int")


def pad_left(c, width) -> Column:
    """Zero-pad to ``width`` without ever cutting a longer value."""
    text = col(c).cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def div(a, b: int) -> Column:
    """Integer division of non-negative whole numbers."""
    return F.floor(col(a) / F.lit(b)).cast("int")


def strip_chars(c) -> Column:
    """One line ending, one kind of space, nothing invisible (ends are left alone)."""
    out = F.regexp_replace(col(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, f"[{WIDE_BLANKS}]", " ")
    out = F.regexp_replace(out, f"[{ZERO_WIDTH}]", "")
    return F.regexp_replace(out, "[ \t]+", " ")


def clean_text(c) -> Column:
    return F.regexp_replace(strip_chars(c), r"^\s+|\s+\z", "")


def squeeze(c) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    # a single space is left as it is, so that most texts need no copy
    return F.trim(F.regexp_replace(col(c), r"\s{2,}|[^\S ]", " "))


def name_key(c) -> Column:
    """Compare key of a name: accents folded, lower case, only letters a-z and digits."""
    folded = F.translate(F.lower(col(c)), FOLD_FROM, FOLD_TO)
    # decomposed spellings carry the accent as a character of its own, dropped here as well
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def replace_all(c, rules) -> Column:
    """Apply ``(pattern, replacement)`` pairs in order."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, col(c))


def replacing(pattern: str, replacement: str, hint=None):
    """A step ``text -> text`` that replaces only where ``hint(text)`` holds, which it must for every text that the pattern changes."""
    def step(t):
        changed = F.regexp_replace(t, pattern, replacement)
        return F.when(hint(t), changed).otherwise(t) if hint else changed

    return step


def squeezing(t: Column) -> Column:
    """``squeeze`` as a step for texts of which few hold more than single spaces."""
    return F.when(contains_any(t, "  ", "\t", "\n", "\v", "\f", "\r"), squeeze(t)).otherwise(F.trim(t))


def contains_any(t: Column, *words: str) -> Column:
    return reduce(Column.__or__, [t.contains(w) for w in words])


def in_steps(c, steps) -> Column:
    """One step after the other as one expression, each value read from the step before.

    A column of a projection per step would be compiled, but Spark's planner copies such a chain when it infers or pushes filters.
    """
    return reduce(let, steps, col(c))


def hms(seconds) -> Column:
    """Seconds as h:mm:ss."""
    s = col(seconds)
    return F.concat(div(s, 3600).cast("string"), F.lit(":"), pad_left(div(s % 3600, 60), 2),
                    F.lit(":"), pad_left((s % 60).cast("int"), 2))
