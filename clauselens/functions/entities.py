"""Entity extraction (E1-E7): one document text in, one struct out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.patterns import WS, all_matches, first_group, java_regex
from clauselens.functions.text import strip, words


def _distinct(matches: Column, most: int | None) -> Column:
    found = F.array_distinct(F.transform(matches, strip))
    return found if most is None else F.slice(found, 1, most)


def amounts(col: Column, most: int | None = None) -> Column:
    """All different amounts, or the first ``most``."""
    return _distinct(all_matches(col, java_regex(fv.AMOUNT_PATTERN)), most)


def dates(col: Column, most: int | None = None) -> Column:
    """All hits of the first pattern, then of the second, and so on, or the first ``most``."""
    hits = F.concat(*[all_matches(col, java_regex(p)) for p in fv.DATE_PATTERNS])
    return _distinct(hits, most)


def _title(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.split(col, f"(?<={WS})(?=[A-Za-z])", -1)
    cased = F.transform(
        runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    )
    return F.array_join(cased, "")


def _first_place(col: Column, patterns) -> Column:
    found = [_title(strip(first_group(col, java_regex(p), 1))) for p in patterns]
    return F.coalesce(*found, F.lit(fv.NOT_SPECIFIED))


def governing_law(col: Column) -> Column:
    """E2."""
    return _first_place(col, fv.GOVERNING_LAW_PATTERNS)


def jurisdiction(col: Column) -> Column:
    """E3."""
    return _first_place(col, fv.JURISDICTION_PATTERNS)


def _party_name(side: Column, most_words: int | None) -> Column:
    side = strip(side)
    leading = strip(first_group(side, java_regex(fv.LEADING_NAME, ignore_case=False), 1))
    named = words(side) if most_words is None else F.slice(words(side), 1, most_words)
    first_words = F.array_join(named, " ")
    return F.rtrim(F.coalesce(leading, first_words), F.lit(","))


def _party(side: Column, most_words: int | None) -> Column:
    name = _party_name(side, most_words)
    term = strip(first_group(side, java_regex(fv.DEFINED_TERM), 1))
    labelled = F.when(term.isNotNull(), F.concat(name, F.lit(" ("), term, F.lit(")")))
    return F.when(name != "", F.coalesce(labelled, name))


def block_parties(col: Column, most_words: int | None = None) -> Column:
    """E5: parties named in a "between X and Y" block; null when there is none.

    The text is cut after its last closing word first.  A block that starts can
    then be closed, and the lazy pattern never tries every "and" in vain, which
    would take time that grows with the square of the text.
    """
    regex = java_regex(fv.PARTY_BLOCK, dot_all=True)
    until_last = F.regexp_extract(col, java_regex(f"^.*(?:{fv.PARTY_BLOCK_END})", dot_all=True), 0)
    cut = F.when(F.contains(F.lower(col), F.lit("between")), until_last)
    first = F.regexp_extract(cut, regex, 1)
    sides = F.when(first != "", F.array(first, F.regexp_extract(cut, regex, 2)))
    none = F.array().cast("array<string>")
    return F.nullif(F.array_compact(F.transform(sides, lambda side: _party(side, most_words))), none)


def offer_parties(col: Column) -> Column:
    """Employer and employee of an offer letter."""
    employer = F.nullif(strip(first_group(col, java_regex(fv.OFFER_EMPLOYER), 1)), F.lit(""))
    employee = F.nullif(
        strip(first_group(col, java_regex(fv.OFFER_EMPLOYEE, ignore_case=False), 1)), F.lit(""))
    role = F.nullif(strip(first_group(col, java_regex(fv.OFFER_ROLE), 1)), F.lit(""))
    return F.array_compact(F.array(
        F.concat(employer, F.lit(" (Employer)")),
        F.concat(employee, F.lit(" ("), F.coalesce(role, F.lit("Employee")), F.lit(")")),
    ))


def parties(col: Column, most_words: int | None = None) -> Column:
    return F.coalesce(block_parties(col, most_words), offer_parties(col))


def key_entities(
    col: Column, most_amounts: int | None = None, most_dates: int | None = None, most_name_words: int | None = None,
) -> Column:
    """The entity struct of a report; nothing is cut unless a limit is given."""
    text = F.coalesce(col, F.lit(""))
    return F.struct(
        parties(text, most_name_words).alias("parties"),
        dates(text, most_dates).alias("effective_dates"),
        governing_law(text).alias("governing_law"),
        jurisdiction(text).alias("jurisdiction"),
        amounts(text, most_amounts).alias("monetary_amounts"),
    )


def extract_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("key_entities", key_entities(F.col(text)))
