"""Text cleaning and splitting (T1-T9).  Every function maps a Column to a Column."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.patterns import (
    LINE_BREAK,
    NOT_WS,
    WORD,
    WS,
    WS_CHARS,
    WS_RUN_TO_COLLAPSE,
    all_matches,
    java_regex,
)


def strip(col: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def strip_text(col: Column) -> Column:
    """``strip`` for a column at hand, which is asked several times.

    ``btrim`` lists all characters of a text, so it is left for texts that show whitespace at an end.
    """
    return F.when(_opens_with_ws(col) | _opens_with_ws(col, -1), strip(col)).otherwise(col)


def strip_page(col: Column) -> Column:
    """``strip`` for long texts: only the ends are looked at, where ``strip_text`` counts all characters.

    Whatever opens or closes a text in UTF-8 is told by its bytes there.
    """
    at_end = [f(col, F.lit(c)) for c in WS_CHARS for f in (F.startswith, F.endswith)]
    return F.when(functools.reduce(Column.__or__, at_end), strip(col)).otherwise(col)


def is_blank(col: Column) -> Column:
    return F.coalesce(strip_text(col) == "", F.lit(True))


def holds(col: Column, term: str) -> Column:
    """``term`` stands somewhere in the text.

    Bytes are searched: Spark passes over an array of them faster than over its strings.
    """
    return F.contains(col.cast("binary"), F.lit(term.encode()))


def words(col: Column) -> Column:
    """Whitespace-separated words; [] for a blank text."""
    return stripped_words(strip_text(col))


def stripped_words(text: Column) -> Column:
    """``words`` of a text without whitespace at its ends."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(text, f"{WS}+", -1))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(f"{NOT_WS}+"))


def normalise(col: Column) -> Column:
    """T4: lower case, whitespace runs to one space, ends trimmed."""
    return F.regexp_replace(F.lower(strip_page(col)), WS_RUN_TO_COLLAPSE, " ")


def clip(col: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(col, 1, n)


# --- T1 / T2 / T3: line cleaning ------------------------------------------


def _opens_with_ws(line: Column, at: int = 1) -> Column:
    """Whitespace, or nothing, stands at a place of the line."""
    return F.contains(F.lit(WS_CHARS), F.substring(line, at, 1))


def _holds(*terms: str):
    def test(line: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(line, F.lit(t))
        return out

    return test


# What every line that a pattern of NOISE_LINE_PATTERNS matches shows to a plain search, in
# their order; lower case only for letters that no other sign is equal to, ignoring case.
_NOISE_GATES = (
    _holds("Szz0H", "rreDF", "Orie"),
    lambda line: F.contains(F.lower(line), F.lit("aadhaar")),
    lambda line: F.startswith(line, F.lit("Date:")),
    lambda line: F.contains(F.lower(line), F.lit("cec")),
    lambda line: _opens_with_ws(line, 2),
    lambda line: F.length(line) <= 4,
)


def is_noise_line(line: Column) -> Column:
    """T1 predicate on one trimmed, non-empty line."""
    tracking_token = (
        (F.length(line) >= 20)
        & F.rlike(line, F.lit(java_regex(r"\d", ignore_case=False)))
        & F.rlike(line, F.lit("[A-Za-z]"))
        & (word_count(line) <= 2)
    )
    out = tracking_token
    for (pattern, ignore_case), gate in zip(fv.NOISE_LINE_PATTERNS, _NOISE_GATES, strict=True):
        out = out | (gate(line) & F.rlike(line, F.lit(java_regex(pattern, ignore_case))))
    return out


# Every line that a pattern of LINE_FIXES changes holds one of these, or begins with an "e".
_FIXED_PARTS = _holds("%", '10"', "érsons", "7<«")


def fix_line(line: Column) -> Column:
    """Known misreadings put right, in order."""
    touched = _FIXED_PARTS(line) | F.startswith(line, F.lit("e")) | _opens_with_ws(line)
    fixed = line
    for pattern, replacement in fv.LINE_FIXES:
        fixed = F.regexp_replace(fixed, java_regex(pattern, ignore_case=False), replacement)
    return strip(F.when(touched, fixed).otherwise(line))


def _lines(col: Column) -> Column:
    return F.transform(F.split(col, LINE_BREAK, -1), strip)


def drop_noise_lines(col: Column) -> Column:
    """Text without its noise lines; blank lines stay."""
    kept = F.filter(_lines(col), lambda x: (x == "") | ~is_noise_line(x))
    return F.array_join(kept, "\n")


def clean_text(col: Column) -> Column:
    """T1 + T2 + T3; null gives the empty string."""

    def cleaned(line: Column) -> Column:
        fixed = F.nullif(fix_line(line), F.lit(""))
        return F.when(line == "", line).when(~is_noise_line(line), fixed)

    joined = F.array_join(F.transform(_lines(F.coalesce(col, F.lit(""))), cleaned), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


# --- T5: sentences ---------------------------------------------------------

# Stands for a protected dot.  Made of word characters, so that word
# boundaries next to a protected abbreviation vanish as they should.
_DOT = "_ꙮ_"


def _dot_regex(abbreviations, decimals: bool) -> str:
    """Matches every dot to protect.  It starts at the dot and looks back, so
    only dots cost anything."""
    edge = f"(?<!{WORD})"
    ends = "|".join(a[:-1].replace(".", r"\.") for a in abbreviations)
    cases = [f"(?<={edge}(?:{ends})\\.)"]
    for a in abbreviations:
        if a.count(".") == 2:
            first, second = a.split(".")[:2]
            cases.append(f"(?<={edge}{first}\\.)(?={second}\\.)")
    if decimals:
        cases.append(r"(?<=\p{Nd}\.)(?=\p{Nd})")
    return r"(?iu)\.(?:" + "|".join(cases) + ")"


def protect_dots(col: Column) -> Column:
    """Dots of decimals and abbreviations replaced by the marker.

    One pass is exact unless abbreviations touch ("No.Rs."): a protected one
    hides the boundary of its neighbour, so list order matters there, and those
    rare texts take one pass per abbreviation.
    """
    ends = "|".join(a.replace(".", r"\.") for a in fv.ABBREVIATIONS)
    touching = F.rlike(col, F.lit(f"(?iu)\\.(?<=(?:{ends}))(?:{ends})"))
    in_order = F.regexp_replace(col, r"(?<=\p{Nd})\.(?=\p{Nd})", _DOT)
    for a in fv.ABBREVIATIONS:
        in_order = F.regexp_replace(in_order, _dot_regex([a], decimals=False), _DOT)
    one_pass = F.regexp_replace(col, _dot_regex(fv.ABBREVIATIONS, decimals=True), _DOT)
    return F.when(touching, in_order).otherwise(one_pass)


def sentences(col: Column) -> Column:
    """T5: array of trimmed, non-empty sentences."""
    # Only these signs open a break; elsewhere its branches need not be tried.
    at_break = r"(?=[.?!;\n])" + java_regex(fv.SENTENCE_BREAK, ignore_case=False)
    parts = F.split(protect_dots(col), at_break, -1)
    restored = F.transform(parts, lambda s: F.replace(strip_text(s), F.lit(_DOT), F.lit(".")))
    return F.coalesce(F.filter(restored, lambda s: s != ""), F.array().cast("array<string>"))


# --- T6 / T7: line kinds ---------------------------------------------------


def is_heading(col: Column) -> Column:
    return F.rlike(strip(col), F.lit(java_regex(fv.SECTION_HEADING)))


def is_footer(col: Column) -> Column:
    low = F.lower(col)
    out = F.rlike(low, F.lit(java_regex(fv.FOOTER_DATE, ignore_case=False)))
    for word in fv.FOOTER_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


# --- T8: token sets --------------------------------------------------------


def token_set(col: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(F.coalesce(col, F.lit(""))), f"{WORD}+"))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Set Jaccard of two token-set columns, 0.0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_of_sets(token_set(a), token_set(b))
