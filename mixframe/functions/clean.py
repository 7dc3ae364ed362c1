"""Clean-up of artist, title and label fields, as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, contains_any, in_steps, let, replace_all, replacing, squeeze, squeezing
from .track_text import COUNTRY_CODE, POINTLESS_VERSION

# In front of a pattern that begins with ``.+``: it matches from the start of a line or nowhere in it, so no other place is tried.
LINE_START = r"(?<![^\n\r\u0085\u2028\u2029])"
# Fixed values: (pattern, replacement) in the order they apply.
TITLE_RULES = [
    (r"\)\[", ") ["),
    (r"(?i)\s*-\s*(?:feat(?:\.|uring)?)\s+(.+?)(?=$|\s*\()", " (featuring $1)"),
    (r" \(\d+ - Remaster\)$", ""),
    (r"^(.+) [\(\[](.+) - (?:\d+ )?Remaster(?:ed|ing)?(?: \d+)?[\)\]]", "$1 ($2)"),
    (r"(?i)\s*[\(\[][^\(\[\)]*(?:Digital\s+Remaster|Mastering)[^\)\]]*[\)\]]", ""),
    (r"(?i)^(.+) [\(\[]Re-?master(?:ed|ing|is[ée])?(?: En)?(?:\s'?\d{2,4})?[\)\]]", "$1"),
    (LINE_START + r"(.+) - (.+ (?:Remix|Mix|Version))", "$1 ($2)"),
    (r"^\(([^()]+)\)$", "$1"),
    (r"^(.+)-\d{4,5}$", "$1"),
    (r"^(.+) - (.+)$", "$1 ($2)"),
    (LINE_START + r"(.+) \((?:\d+ )?Remaster(?:ed|ing)?(?: \d+)?\)$", "$1"),
    (r"(?i)" + LINE_START + r"(.+) \((?:\d+ )?(?:[A-Za-z]+ )?(?:\s*Re-?master(?:ed|ing|;)?)(?:\s*(?:Mix|Version|Edition))?\)$", "$1"),
    (r"(?i)\s+\(Mixed\)", ""),
    (r" \[(.+)\] \[Mixed\]", " ($1)"),
    (r"(?i)\((.+);Mixed\)", "($1)"),
    (r"(?i)\s*\((?=Original)[^()]*?(?:\([^()]*\)[^()]*)*\)", ""),
]
LABEL_RULES = [
    (r"\s*\n\s*", " "), (r"Records \(Distribution\)", "Records"), (r"[\[\]]", ""), (r"\d+$", ""),
    (r"(?i)(^|, )(.+) S\.?r\.?l\.?", "$1$2"), (r"(?i)(^|, )(.+) GmbH", "$1$2"), (r"(?i)^(.+), LLC", "$1"),
    (r"(?i)^(.+) (?:UK|US)", "$1"),
]
# Our own label rules: a re-issue is filed under the label it re-issues, a catalogue is no label.
LABEL_RULES += [(r"(?i)(^|, )([^,]+?)\s+(?:back catalog(?:ue)?|re-?issues?)$", "$1$2"), (r"(?i)(?:^|, )[^,]*\bcatalog(?:ue)?$", "")]


def _any_case(t: Column, *words: str) -> Column:
    return contains_any(F.lower(t), *words)


# What a text must contain for the rule of the same place to change it: most texts contain none of it, and a look for a
# word costs a small part of a pattern.  ``None``: the pattern is always tried.
_TITLE_HINTS = [
    lambda t: t.contains(")["),
    lambda t: t.contains("-") & _any_case(t, "feat"),
    lambda t: t.contains(" - Remaster)"),
    lambda t: t.contains(" - ") & t.contains("Remaster"),
    lambda t: contains_any(t, "(", "[") & _any_case(t, "master"),
    lambda t: contains_any(t, " (", " [") & _any_case(t, "master"),
    lambda t: t.contains(" - ") & contains_any(t, "Remix", "Mix", "Version"),
    lambda t: t.startswith("("),
    lambda t: t.contains("-"),
    lambda t: t.contains(" - "),
    lambda t: t.contains(" (") & t.contains("Remaster"),
    lambda t: t.contains(" (") & _any_case(t, "master"),
    lambda t: t.contains("(") & _any_case(t, "(mixed)"),
    lambda t: t.contains("] [Mixed]"),
    lambda t: t.contains(";") & _any_case(t, ";mixed)"),
    lambda t: t.contains("(") & _any_case(t, "(original"),
]
_LABEL_HINTS = [
    lambda t: t.contains("\n"), lambda t: t.contains("Records (Distribution)"), lambda t: contains_any(t, "[", "]"), None,
    lambda t: _any_case(t, " srl", " s.rl", " sr.l", " s.r.l"), lambda t: _any_case(t, " gmbh"), lambda t: _any_case(t, ", llc"),
    lambda t: _any_case(t, " uk", " us"),
    lambda t: _any_case(t, "back catalog", "reissue", "re-issue"), lambda t: _any_case(t, "catalog"),
]
_HINTS = {pattern: hint for rules, hints in ((TITLE_RULES, _TITLE_HINTS), (LABEL_RULES, _LABEL_HINTS))
          for (pattern, _), hint in zip(rules, hints, strict=True)}
#: All field rules as rows (field, order, pattern, replacement); a user's rows go in between by their order.
FIELD_RULES = [(field, 10 * i, pattern, replacement) for field, rules in (("title", TITLE_RULES), ("label", LABEL_RULES))
               for i, (pattern, replacement) in enumerate(rules, 1)]
# Marks of free downloads and premieres in upload titles, and frequent misspellings.
TITLE_NOISE = [(r"(?i)\[\s*free\s*(?:download|dl)?\s*\]", " "), (r"(?i)\(\s*free\s*(?:download|dl)?\s*\)", " "),
               (r"(?i)\*+\s*free\s*(?:download|dl)?\s*\*+", " "), (r"(?i)\bfree\s*(?:download|dl)\b", " "),
               (r"(?i)\[\s*(?:premiere|exclusive)\s*\]", " "), (r"(?i)\(\s*(?:premiere|exclusive)\s*\)", " ")]
TYPO_FIXES = [(r"\b(?:podcats|podast|pocast)\b", "podcast"), (r"\b(?:Podcats|Podast|Pocast)\b", "Podcast"),
              (r"\b(?:PODCATS|PODAST|POCAST)\b", "PODCAST")]
# What a search leaves out of a title, in the order in which it is taken out; rules for one site are not among them.
SEARCH_RULES = [
    (r"[|-]", " "), (r" [-@] ", " "), (r"[-().]", " "), (r"  ", " "), (r"(?:#|\[|\]|\(|\)|\.|\*| I )", " "),
    (r" (?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(?: |-|$)", " "),
    (r"\s+", " "), (r"/", " "), (r" on ", " "), (r"RA (\d)", "RA.$1"), (r"Radio 1's", ""),
]
# Our own rules for what surrounds a track in a video's title: each takes one kind of clutter out.
_KIND = r"(?:official|unofficial|full|lyrics?|music|audio|video|visuali[sz]er|clip|snippet|teaser|premiere|promo|forthcoming|out now|hd|hq|4k|\d{3,4}p)"
VIDEO_RULES = [
    (r"_+", " "),
    (r"(?i)\.(?:mp4|avi|wmv|mkv)\b", " "),
    (r"(?i)[\[({]\s*\d+\s*kbps\s*[\])}]", " "),
    (rf"(?i)[\[({{]\s*(?:{_KIND}[\s:!&/-]*)+[\])}}]", " "),  # a bracket that only says what kind of upload it is
    (rf"(?i)^(?:{_KIND}[\s!]*)+\s*[:|]\s*", ""),
    (rf"(?i)(?:\s+{_KIND}!*)+\s*$", ""),
    (r"\[[^\[\]]+\]\s*\[[A-Z0-9-]{3,11}\]", " "),  # label and catalogue number
    (r"[\[(][A-Z]{2,6}[-: /]*\d+[\])]", " "),
    (r"^\s*[\[(]?(?:19|20)\d{2}[\])]\s*(?=.+ - )", ""),
    (r"(?<= - )(.+?)\s*[\[(](?:19|20)\d{2}[\])]\s*$", "$1"),
    (r"^([^|]+?)\s*\|\s*([^|]+)$", "$1 - $2"),
    (r"\s*-{2,}\s*", " - "),
    (r"\s+", " "),
    (r"[\s-]+$", ""),
]


def _distinct(t: Column) -> Column:
    names = F.filter(F.transform(F.split(t, ","), lambda a: F.trim(a)), lambda a: a != "")
    once = F.aggregate(names, F.array().cast("array<string>"), lambda acc, a: F.when(
        F.array_contains(F.transform(acc, lambda x: F.lower(x)), F.lower(a)), acc).otherwise(F.concat(acc, F.array(a))))
    return F.when(t.contains(","), F.array_join(once, ", ")).otherwise(F.trim(t))


def _trim(t: Column) -> Column:
    return F.trim(t)  # a step of one argument: ``transform`` hands a second one the index


_COUNTRY_STEPS = [replacing(COUNTRY_CODE, " ", lambda t: contains_any(t, "(", "[")), squeezing,
                  replacing(r"\s+([,.;:!?])", "$1", lambda t: contains_any(t, " ,", " .", " ;", " :", " !", " ?")), _trim]


def distinct_artists(c) -> Column:
    """Comma-separated names, each once, first spelling kept."""
    return let(col(c), _distinct)


def without_country_codes(c) -> Column:
    return in_steps(c, _COUNTRY_STEPS)


def _brackets_once(t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(r"[\(\[][^()\[\]]*[\)\]]"), 0)
    text = lambda b: F.trim(F.substr(b, F.lit(2), F.length(b) - 2))
    twice = let(F.transform(found, text), lambda names: F.filter(
        F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))

    def drop(acc, n):
        parts = F.split(acc, F.concat(F.lit(r"[\(\[]\s*\Q"), n, F.lit(r"\E\s*[\)\]]")))
        return F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ""), F.lit("("), n, F.lit(")"), F.element_at(parts, -1))

    # no two brackets where none opens behind one that closes
    return F.when(t.rlike(r"[)\]][^(\[]*[(\[]"), F.aggregate(twice, t, drop)).otherwise(t)


def without_duplicate_brackets(c) -> Column:
    """Equal bracket texts once, in round brackets: the last one stays."""
    return in_steps(c, [_brackets_once, squeezing])


def rules_of(field: str, rows: list | None = None) -> list[tuple[str, str]]:
    """The rules of a field in their order, those given among the built-in ones (behind one of the same order)."""
    every = FIELD_RULES + [tuple(r) for r in rows or []]
    return [(pattern, replacement) for f, _, pattern, replacement in sorted(every, key=lambda r: r[1]) if f == field]


def _rule_steps(field: str, rows: list | None) -> list:
    return [replacing(pattern, replacement, _HINTS.get(pattern)) for pattern, replacement in rules_of(field, rows)]


def title_steps(rows: list | None = None) -> list:
    """The steps of ``clean_title``."""
    pointless = lambda t: t.contains(" (") & _any_case(t, " (vocal", " (main", " (radio", " (album", " (single")
    return [squeezing, *_rule_steps("title", rows), replacing(POINTLESS_VERSION, "", pointless), _brackets_once, squeezing]


def label_steps(artist, rows: list | None = None) -> list:
    """The steps of ``clean_label``: a label that is the artist's own says nothing."""
    name = replacing(r"(?i)\s+(?:Records|Recordings|Music|Label)$", "", lambda t: _any_case(t, "record", "music", "label"))
    return [*_rule_steps("label", rows), _trim, lambda t: F.when(F.lower(name(t)) == F.lower(col(artist)), "").otherwise(t)]


def clean_title(c, rows: list | None = None) -> Column:
    return in_steps(c, title_steps(rows))


def clean_label(c, artist, rows: list | None = None) -> Column:
    return in_steps(c, label_steps(artist, rows))


def search_terms(c) -> Column:
    return F.trim(replace_all(c, SEARCH_RULES))


def streaming_title(c) -> Column:
    out = replace_all(c, [(r"\[", "("), (r"\]", ")"), (r" \(Mixed\)", ""), (r"ID\d+( \(from.+\))?", "ID"), (r"ID / ID", "ID")])
    return F.regexp_replace(out, r"\s+", " ")


def video_title(c) -> Column:
    return F.trim(replace_all(c, VIDEO_RULES))


def upload_title(c) -> Column:
    """Underscores to blanks, misspellings fixed, download and premiere marks out."""
    return squeeze(replace_all(F.regexp_replace(col(c), "_+", " "), TYPO_FIXES + TITLE_NOISE))
