"""Dates written in titles: every pattern's readings, scored by distance to the upload date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, pad_left

# Month names in English and German.
MONTHS = {
    "jan": 1, "januar": 1, "january": 1, "feb": 2, "februar": 2, "february": 2, "mar": 3,
    "march": 3, "mär": 3, "märz": 3, "maerz": 3, "mrz": 3, "apr": 4, "april": 4, "may": 5,
    "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "aug": 8,
    "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "okt": 10,
    "oktober": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "dez": 12, "dezember": 12,
}
# Fixed value: the characters that separate the parts of a title.
SEPARATORS = r"\-–—|:/\\"
FIRST_YEAR = 1950
# The patterns in the order they are tried; the first that reads a valid date wins.
YEAR4 = r"(?:19|20)\d{2}"
PATTERNS = [
    ("isoFull", rf"(?:^|[^\d])({YEAR4})[-./](\d{{1,2}})[-./](\d{{1,2}})(?!\d)"),
    ("textualDMY", rf"(?i)(?:^|[^\w])(\d{{1,2}})(?!\d)(?:st|nd|rd|th|\.)?\s+([a-zäöü]{{3,9}})\.?,?\s+({YEAR4}|\d{{2}})(?!\d)"),
    ("textualMDY", rf"(?i)(?:^|[^\w])([a-zäöü]{{3,9}})\.?\s+(\d{{1,2}})(?!\d)(?:st|nd|rd|th)?,?\s+({YEAR4}|\d{{2}})(?!\d)"),
    ("sepY4", rf"(?:^|[^\d])(\d{{1,2}})[-./](\d{{1,2}})[-./]({YEAR4})(?!\d)"),
    ("compact8", r"(?:^|[^\d])(\d{8})(?!\d)"),
    ("sepY2", r"(?:^|[^\d])(\d{1,2})[-./](\d{1,2})[-./](\d{2})(?!\d)"),
    ("compact6", r"(?:^|[^\d])(\d{6})(?!\d)"),
    ("monthYearGroup", rf"(?i)(?:^|[{SEPARATORS}]+\s*)([a-zäöü]{{3,9}})\.?\s+({YEAR4})(?!\d)\s*(?=[{SEPARATORS}]|$)"),
]


def month_number(name: Column) -> Column:
    table = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.regexp_replace(F.lower(name), r"\.$", ""))


def _year(text: Column, this_year: Column) -> Column:
    n = text.try_cast("int")
    short = F.when(n <= (this_year % 100) + 1, n + 2000).otherwise(n + 1900)
    return F.when(F.length(text) == 2, short).otherwise(n)


def _readings(name: str, match: Column, pattern: str, this_year: Column) -> list[Column]:
    """(year, month, day) columns of each reading, in order of preference."""
    g = lambda i: F.regexp_extract(match, pattern, i)
    n = lambda c: c.try_cast("int")
    y = lambda c: _year(c, this_year)
    cut = lambda a, b: F.substring(g(1), a, b)
    if name == "isoFull":
        return [(n(g(1)), n(g(2)), n(g(3)))]
    if name == "textualDMY":
        return [(y(g(3)), month_number(g(2)), n(g(1)))]
    if name == "textualMDY":
        return [(y(g(3)), month_number(g(1)), n(g(2)))]
    if name == "sepY4":
        return [(n(g(3)), n(g(2)), n(g(1))), (n(g(3)), n(g(1)), n(g(2)))]
    if name == "compact8":
        return [(n(cut(1, 4)), n(cut(5, 2)), n(cut(7, 2))), (n(cut(5, 4)), n(cut(3, 2)), n(cut(1, 2))),
                (n(cut(5, 4)), n(cut(1, 2)), n(cut(3, 2)))]
    if name == "sepY2":
        return [(y(g(3)), n(g(2)), n(g(1))), (y(g(3)), n(g(1)), n(g(2))), (y(g(1)), n(g(2)), n(g(3)))]
    if name == "compact6":
        return [(y(cut(5, 2)), n(cut(3, 2)), n(cut(1, 2))), (y(cut(5, 2)), n(cut(1, 2)), n(cut(3, 2))),
                (y(cut(1, 2)), n(cut(3, 2)), n(cut(5, 2)))]
    return [(n(g(2)), month_number(g(1)), F.lit(1))]


def _candidate(name, order, ymd, match, reference, this_year) -> Column:
    # each step is bound once: inside a function over arrays nothing is shared by itself
    def written(d):
        return F.concat(pad_left(d["y"], 4), F.lit("-"), pad_left(d["m"], 2), F.lit("-"), pad_left(d["d"], 2))

    def dated(r):
        out = F.substring(r["iso"], 1, 7) if name == "monthYearGroup" else r["iso"]
        return let(F.datediff(r["date"], reference), lambda diff: F.struct(
            (F.coalesce(F.abs(diff) + F.when(diff > 0, 0.5).otherwise(0.0), F.lit(0.0)) + F.lit(order * 0.001)).cast("double").alias("score"),
            out.alias("out"), r["iso"].alias("iso"), F.lit(name).alias("pattern"), match.alias("matched")))

    def read(d):
        valid = d["y"].between(F.lit(FIRST_YEAR), this_year + 1)
        return F.when(valid, let(let(written(d), lambda iso: F.struct(iso.alias("iso"), F.try_to_date(iso, "yyyy-MM-dd").alias("date"))),
                                 lambda r: F.when(r["date"].isNotNull(), dated(r))))

    return let(F.struct(*[c.alias(k) for k, c in zip("ymd", ymd)]), read)


def find_date(text, reference, this_year: Column | None = None) -> Column:
    """STRUCT<score, out, iso, pattern, matched, readings, runner_up>, NULL without a date.

    Only the first pattern with a valid reading counts; among its readings the one closest to
    ``reference`` wins, a date after it by half a day worse.
    """
    t, ref = col(text), col(reference)
    now = this_year if this_year is not None else F.year(F.current_date())

    def scan(name, pattern):
        def per_match(m):
            cands = F.array(*[_candidate(name, i, r, m, ref, now)
                              for i, r in enumerate(_readings(name, m, pattern, now))])
            return F.filter(cands, lambda c: c.isNotNull())

        groups = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), per_match)
        return let(groups, lambda g: let(F.flatten(g), lambda every: F.when(
            F.size(every) > 0, let(F.array_min(every), lambda best: finish(g, every, best)))))

    def finish(groups, every, best):
        others = F.filter(every, lambda c: c["out"] != best["out"])
        own = F.filter(groups, lambda g: F.array_contains(F.transform(g, lambda c: c["out"]), best["out"])
                       & F.array_contains(F.transform(g, lambda c: c["matched"]), best["matched"]))
        return F.struct(*[best[f].alias(f) for f in ("score", "out", "iso", "pattern", "matched")],
                        F.size(F.array_distinct(F.transform(own[0], lambda c: c["out"]))).alias("readings"),
                        F.array_min(others)["score"].alias("runner_up"))

    return F.coalesce(*[scan(n, p) for n, p in PATTERNS])
