"""Where on the page a clause stands (L1-L4).

Blocks are (doc_id, page_number, x0, y0, x1, y1, text); clauses have doc_id,
clause_id, category, explanation, clause_text and page_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.text import is_footer, is_heading, words
from clauselens.operators.containment import containing_pairs


def clause_terms(category: Column, explanation: Column) -> Column:
    """L1: the words to look for, distinct."""
    combined = F.lower(F.concat(category, F.lit(" "), F.coalesce(explanation, F.lit(""))))
    none = F.array().cast("array<string>")
    lists = [
        F.when(F.contains(combined, F.lit(k)), F.lit(list(terms))).otherwise(none)
        for k, terms in fv.LOCATION_TERMS
    ]
    mapped = F.concat(*lists)
    own = F.transform(
        F.filter(words(category), lambda w: F.length(w) >= fv.LOCATION_MIN_WORD), F.lower)
    return F.array_distinct(F.when(F.size(mapped) > 0, mapped).otherwise(own))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order, without footers, with their paragraph (L3).

    Adds ``idx`` (0-based on the page), ``paragraph``, ``low`` and ``drawable``.
    Neighbouring blocks belong together when the lower one follows within the
    line gap and is no heading, so paragraphs are islands of a running sum.
    Windows are per page.
    """
    page = Window.partitionBy("doc_id", "page_number")
    order = page.orderBy(F.round("y0", 1), F.round("x0", 1), "y1", "x1", "text")
    footer = is_footer(F.col("text"))
    body = (
        blocks.withColumn("_footer", footer)
        .withColumn("_bodies", F.count_if(~F.col("_footer")).over(page))
        .filter(~F.col("_footer") | (F.col("_bodies") == 0))
        .drop("_footer", "_bodies")
    )
    gap = F.col("y0") - F.lag("y1").over(order)
    joined = (gap >= 0) & (gap <= fv.BLOCK_MAX_GAP) & ~is_heading(F.col("text"))
    return (
        body.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("_opens", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
        .withColumn("paragraph", F.sum("_opens").over(
            order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .withColumn("low", F.lower("text"))
        .withColumn(
            "drawable",
            (F.col("x1") - F.col("x0") > fv.BLOCK_MIN_EXTENT)
            & (F.col("y1") - F.col("y0") > fv.BLOCK_MIN_EXTENT))
        .drop("_opens")
    )


def _term_score(terms: Column, low: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def _opening(clause_text: Column, prefix_words: int | None) -> Column:
    """A clause in lower case, or its first words, null when there are fewer; null for no word."""
    ws = words(F.coalesce(clause_text, F.lit("")))
    taken = ws if prefix_words is None else F.slice(ws, 1, prefix_words)
    return F.when(F.size(ws) >= (prefix_words or 1), F.lower(F.array_join(taken, " ")))


def _term_hits(placed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Best block per (doc, page, kind): most terms, then earliest.

    A kind is one (category, explanation); a document has at most as many as
    there are rules, so this join multiplies blocks by a small number.
    """
    scored = (
        placed.select("doc_id", "page_number", "idx", "low")
        .join(kinds, "doc_id")
        .withColumn("score", _term_score(F.col("terms"), F.col("low")))
        .filter("score > 0")
    )
    best = F.max(F.struct("score", (-F.col("idx")).alias("neg")))
    return (
        scored.groupBy("doc_id", "page_number", "kind").agg(best.alias("_b"))
        .select("doc_id", "page_number", "kind", (-F.col("_b.neg")).alias("idx"))
    )


def _with_kind(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn(
        "kind", F.sha2(F.concat_ws("\n", "category", "explanation"), 256))


def _kinds(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("doc_id", "kind").agg(
        F.first(clause_terms(F.col("category"), F.col("explanation"))).alias("terms"))


def _prefix_hits(placed: DataFrame, clauses: DataFrame, term_hits: DataFrame, prefix_words: int | None) -> DataFrame:
    """First block holding the clause or its first words, on pages without a term hit."""
    hays = placed.select(
        "doc_id", F.struct("page_number", "idx").alias("hay_id"), F.col("low").alias("hay"))
    needles = clauses.select(
        "doc_id", F.struct("clause_id", "kind").alias("needle_id"),
        _opening(F.col("clause_text"), prefix_words).alias("needle")).filter("needle is not null")
    return (
        containing_pairs(hays, needles, ["doc_id"])
        .groupBy("doc_id", F.col("needle_id.clause_id").alias("clause_id"),
                 F.col("needle_id.kind").alias("kind"),
                 F.col("hay_id.page_number").alias("page_number"))
        .agg(F.min("hay_id.idx").alias("idx"))
        .join(term_hits, ["doc_id", "page_number", "kind"], "left_anti")
    )


def best_block(blocks: DataFrame, clauses: DataFrame, prefix_words: int | None = None) -> DataFrame:
    """L2: (doc_id, clause_id, page_number, idx) on the clause's own page.

    Where no block has one of its terms, a clause is looked for by its whole
    text, or by its first ``prefix_words`` words.
    """
    placed = page_blocks(blocks)
    kinded = _with_kind(clauses)
    by_terms = _term_hits(placed, _kinds(kinded))
    own = kinded.select("doc_id", "clause_id", "kind", "page_number")
    found = own.join(by_terms, ["doc_id", "page_number", "kind"])
    by_prefix = _prefix_hits(placed, kinded, by_terms, prefix_words).join(
        own.drop("kind"), ["doc_id", "clause_id", "page_number"])
    columns = ["doc_id", "clause_id", "page_number", "idx"]
    return found.select(*columns).unionByName(by_prefix.select(*columns))


def expand_block(blocks: DataFrame, best: DataFrame) -> DataFrame:
    """L3: all drawable blocks of the paragraph around each best block."""
    placed = page_blocks(blocks)
    keys = ["doc_id", "page_number"]
    chosen = best.join(placed.select(*keys, "idx", "paragraph"), [*keys, "idx"]).drop("idx")
    return (
        chosen.join(placed.filter("drawable"), [*keys, "paragraph"])
        .select("doc_id", "clause_id", "page_number", "idx", "x0", "y0", "x1", "y1")
    )


def locate(blocks: DataFrame, clauses: DataFrame, prefix_words: int | None = None) -> DataFrame:
    """L4: like L2 + L3, going on to the other pages when the own page has nothing.

    A page beyond the document means page 1.  Term hits are kept per kind and
    page, so the search over pages is an aggregate and never clause x page.
    """
    placed = page_blocks(blocks)
    keys = ["doc_id", "page_number"]
    # Only paragraphs with something to draw count as found.
    solid = placed.groupBy(*keys, "paragraph").agg(F.bool_or("drawable").alias("_d")) \
        .filter("_d").drop("_d")
    solid_idx = placed.select(*keys, "idx", "paragraph").join(solid, [*keys, "paragraph"]) \
        .drop("paragraph")

    last = blocks.groupBy("doc_id").agg(F.max("page_number").alias("_last"))
    target = F.coalesce(F.nullif("page_number", F.lit(0)), F.lit(1))
    kinded = (
        _with_kind(clauses).withColumn("_target", target).join(last, "doc_id", "left")
        .withColumn("_target", F.when(
            (F.col("_target") < 1) | (F.col("_target") > F.coalesce("_last", F.lit(0))), 1
        ).otherwise(F.col("_target")))
        .drop("_last")
    )
    term_hits = _term_hits(placed, _kinds(kinded))
    by_terms = term_hits.join(solid_idx, [*keys, "idx"])
    by_prefix = _prefix_hits(placed, kinded, term_hits, prefix_words).join(solid_idx, [*keys, "idx"])

    own = kinded.select("doc_id", "clause_id", "kind", "_target")
    first = F.min(F.struct("page_number", "idx"))
    kind_first = by_terms.groupBy("doc_id", "kind").agg(first.alias("_kind_first"))
    at_target = by_terms.withColumnsRenamed({"page_number": "_target", "idx": "_kind_idx"})
    prefix_target = F.min(F.when(
        F.col("page_number") == F.col("_target"), F.struct("page_number", "idx")))
    prefix_first = (
        by_prefix.drop("kind").join(own.drop("kind"), ["doc_id", "clause_id"])
        .groupBy("doc_id", "clause_id")
        .agg(prefix_target.alias("_prefix_target"), first.alias("_prefix_first"))
    )
    on_target = F.when(
        F.col("_kind_idx").isNotNull(),
        F.struct(F.col("_target").alias("page_number"), F.col("_kind_idx").alias("idx")))
    chosen = (
        own.join(at_target, ["doc_id", "kind", "_target"], "left")
        .join(kind_first, ["doc_id", "kind"], "left")
        .join(prefix_first, ["doc_id", "clause_id"], "left")
        .withColumn("_at", F.coalesce(
            on_target, F.col("_prefix_target"),
            F.least(F.col("_kind_first"), F.col("_prefix_first"))))
        .filter("_at is not null")
        .select("doc_id", "clause_id", F.col("_at.page_number").alias("page_number"),
                F.col("_at.idx").alias("idx"))
    )
    return expand_block(blocks, chosen)
