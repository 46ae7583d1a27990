"""Rule tables and category resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens import schemas
from clauselens.functions.patterns import WORD, quote
from clauselens.functions.text import strip


@dataclass(frozen=True)
class Definition:
    key: str
    phrases: tuple
    pattern: str
    context_terms: tuple
    keywords: tuple


DEFINITIONS = {d[0]: Definition(*d) for d in fv.DEFINITIONS}

# Every text a definition can match (by phrase or by pattern) holds one of these
# in its normalised form.  They are plain byte searches, far fewer than the
# phrases, and spare most texts both the phrases and the regex.
STEMS = {
    "indemnity": ("indemn", "harmless"),
    "termination": (
        "terminat", "dismiss", "severance", "resign", "without cause", "notice", "in lieu"),
    "liability": ("liabilit", "damages"),
    "eviction": ("evict", "vacat", "possession", "forfeiture"),
    "late rent": ("late", "overdue", "default", "delayed", "penalty"),
    "deposit": ("deposit",),
    "non-compete": ("compet", "solicit", "restrai", "restrictive"),
    "auto": ("auto",),
    "governing law": ("govern", "jurisdiction", "courts of", "laws of"),
    "confidentiality": ("confident", "disclosure", "nda", "secret", "proprietary"),
    "arbitration": ("arbitra",),
    "force majeure": ("majeure", "act of god", "reasonable control", "unforeseen", "frustration"),
    "rent escalation": ("escalat", "increment", "increase", "rent revision"),
    "subleas": ("sublet", "subleas", "assign", "possession"),
    "maintenance": ("repair", "maint", "wear and tear"),
    "landlord entry": ("entry", "inspect", "enter", "access"),
    "utilit": ("utilit", "electricity", "charge", "maintenance", "bill"),
    "probation": ("probation", "confirmation of"),
    "intellectual property": (
        "intellectual", "assignment", "work for hire", "work product", "invention",
        "proprietary"),
}


def default_rules(spark: SparkSession) -> DataFrame:
    """The seed rules, numbered from 1, all active, without keywords."""
    rows = [
        (i, *seed, None, True) for i, seed in enumerate(fv.RULE_SEEDS, start=1)
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def definitions(spark: SparkSession) -> DataFrame:
    rows = [(k, list(p), r, list(c), list(w)) for k, p, r, c, w in fv.DEFINITIONS]
    return spark.createDataFrame(rows, schemas.DEFINITIONS)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.CATEGORY_ALIASES), schemas.ALIASES)


# Up to this many rules count as configuration that every task may hold.
PIN_LIMIT = 200


def pin_rules(rules: DataFrame) -> DataFrame:
    """A rules table of checked, small size as local data; larger ones as they are.

    Spark knows the size of local data, so joins with it are broadcast and never
    shuffle the texts by rule.
    """
    table = rules.limit(PIN_LIMIT + 1).toArrow()
    if table.num_rows > PIN_LIMIT:
        return rules
    return rules.sparkSession.createDataFrame(table, rules.schema)


def definition_key(category: Column) -> Column:
    """R1 as an expression: alias, else whole-word key, else substring key.

    Keys are tried longest first.  The tables are fixed, so no join is needed
    and a rules table of any size is resolved in place.
    """
    name = F.lower(strip(category))
    by_alias = F.element_at(
        F.create_map(*[F.lit(v) for pair in fv.CATEGORY_ALIASES for v in pair]), name)
    longest_first = sorted(DEFINITIONS, key=len, reverse=True)
    whole_word = [
        F.when(F.rlike(name, F.lit(f"(?<!{WORD}){quote(k)}(?!{WORD})")), F.lit(k))
        for k in longest_first
    ]
    guarded, guard = fv.SUBSTRING_GUARD
    substring = []
    for k in longest_first:
        hit = F.contains(name, F.lit(k))
        if k == guarded:
            hit = hit & ~F.contains(name, F.lit(guard))
        substring.append(F.when(hit, F.lit(k)))
    return F.when(category != "", F.coalesce(by_alias, *whole_word, *substring))


def resolve_rules(rules: DataFrame) -> DataFrame:
    """Rules + ``def_key`` (null when no definition applies)."""
    return rules.withColumn("def_key", definition_key(F.col("category")))


def keyword_list(keywords: Column) -> Column:
    """R2: comma list to array; order and duplicates stay, null gives []."""
    parts = F.split(F.coalesce(keywords, F.lit("")), ",", -1)
    return F.filter(F.transform(parts, lambda k: F.lower(strip(k))), lambda k: k != "")


def explode_keywords(rules: DataFrame) -> DataFrame:
    """R2: one row per (rule_id, position, keyword)."""
    return rules.select(
        "rule_id", F.posexplode(keyword_list(F.col("keywords"))).alias("position", "keyword"))


def threshold(col: Column) -> Column:
    """A missing or zero threshold means the default."""
    return F.when(F.coalesce(col, F.lit(0.0)) == 0, F.lit(fv.DEFAULT_THRESHOLD)).otherwise(col)


def snippet_keywords(rules: DataFrame) -> DataFrame:
    """Resolved rules + ``snippet_keywords``: phrases, keywords, custom keywords.

    Entries that stand in two lists stay twice, so they score twice.
    """
    by_definition = F.create_map(*[
        x
        for d in DEFINITIONS.values()
        for x in (F.lit(d.key), F.lit(list(d.phrases + d.keywords)))
    ])
    own = F.coalesce(
        F.element_at(by_definition, F.col("def_key")), F.array(F.lower("category")))
    listed = F.concat(own, keyword_list(F.col("keywords")))
    return rules.withColumn("snippet_keywords", F.filter(listed, lambda k: k != ""))


def _roots(d: Definition) -> list[str]:
    """Words of which every snippet keyword of a definition holds one, and every match of its pattern that
    lower case turns into plain letters."""
    roots = {max(stem.split(), key=len) for stem in STEMS[d.key]}
    for k in d.phrases + d.keywords:
        if not any(r in k for r in roots):
            roots.add(max(k.split(), key=len))
    return sorted(r for r in roots if not any(o != r and o in r for o in roots))


def snippet_roots(keywords: Column, def_key: Column) -> Column:
    """The few texts one of which is in every lower-case sentence that scores for a rule."""
    by_definition = F.create_map(*[x for d in DEFINITIONS.values() for x in (F.lit(d.key), F.lit(_roots(d)))])
    none = F.array().cast("array<string>")
    own = F.coalesce(F.element_at(by_definition, def_key), none)
    covered = lambda k: F.exists(own, lambda r: F.contains(k, r))
    return F.concat(own, F.array_distinct(F.filter(keywords, lambda k: ~covered(k))))
