"""The report pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens import schemas
from clauselens.functions.entities import extract_entities
from clauselens.functions.text import is_blank
from clauselens.operators.chunking import chunk
from clauselens.operators.clauses import (
    assemble_clauses,
    collapse_clauses,
    rule_facts,
    with_sentences,
    with_snippet,
    with_texts,
)
from clauselens.operators.matching import (
    apply_threshold,
    confidence,
    match_rules,
    merge_labels,
)
from clauselens.operators.rules import pin_rules
from clauselens.operators.scoring import choose_advice, score_documents, summary
from clauselens.sources.pages import assemble_pages


@dataclass
class Analysis:
    chunks: DataFrame
    clauses: DataFrame
    reports: DataFrame
    failed: DataFrame


def split_failures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and the rest with an error message.

    A bad document is data, not an exception, so the others carry on.
    """
    blank = is_blank(F.col("text"))
    failed = docs.filter(blank).select(
        "doc_id", F.lit("failed").alias("status"),
        F.lit(fv.EMPTY_TEXT_MESSAGE).alias("error_message"))
    return docs.filter(~blank), failed


def raw_clauses(
    chunks: DataFrame, rules: DataFrame, labels: DataFrame | None = None, hits: DataFrame | None = None,
) -> DataFrame:
    """Clauses before the collapse.

    Without labels this is one narrow pass.  With labels, only ids and evidence
    are shuffled for the union; the text is joined back for the hits that stay.
    ``hits`` of the chunks, where they are known, are taken for that.
    """
    rules = pin_rules(rules)
    if labels is None:
        hits = match_rules(chunks, rules, ["chunk_text", "_sentences"], with_sentences)
        kept = apply_threshold(hits.withColumn("confirmed", F.lit(False)), rules)
        return assemble_clauses(kept, rules)
    hits = (match_rules(chunks, rules) if hits is None else hits).drop("page_number")
    kept = apply_threshold(merge_labels(hits, labels, rules), rules)
    return assemble_clauses(with_texts(kept, chunks), rules)


def document_entities(pages: DataFrame, single_page: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key_entities) of the usable documents, and the failed ones."""
    docs = (
        pages.select("doc_id", "text") if single_page
        else assemble_pages(pages).select("doc_id", F.col("full_text").alias("text"))
    )
    usable, failed = split_failures(docs)
    return extract_entities(usable).drop("text"), failed


def analyse(
    pages: DataFrame,
    rules: DataFrame,
    labels: DataFrame | None = None,
    advice: DataFrame | None = None,
    single_page: bool = False,
) -> Analysis:
    """Pages (doc_id, page_number, text) to chunks, clauses and reports.

    ``single_page`` says that every document is one row.
    """
    entities, failed = document_entities(pages, single_page)
    chunks = chunk(pages, single_page=single_page)
    clauses = choose_advice(collapse_clauses(raw_clauses(chunks, rules, labels)), advice)
    return Analysis(chunks, clauses, score_documents(entities, clauses), failed)


@dataclass
class Stored:
    """What an analysis leaves behind, in the declared schemas of the stored tables and beyond."""

    reports: DataFrame
    clauses: DataFrame
    documents: DataFrame


def clause_ids(clauses: DataFrame) -> DataFrame:
    """Clauses + ``clause_id``; a document has at most one clause of a rule in a chunk, so it names them for good."""
    return clauses.withColumn("clause_id", F.concat_ws(":", "doc_id", "chunk_index", "rule_id"))


def complete(
    analysis: Analysis, documents: DataFrame, summaries: DataFrame | None = None, at: Column | None = None,
    seconds: Column | None = None,
) -> Stored:
    """R21's end: whole report rows, clauses with their ids, documents in their new state.

    ``documents`` (doc_id, original_filename, status, error_message, ...) are the
    uploads; reported ones are ``completed`` without a message, failed ones
    ``failed`` with theirs, and those that the analysis has not seen stay as they
    are.  ``summaries`` (doc_id, response) are a model's; the stock sentence
    stands in for missing ones.  ``at`` and ``seconds`` say when the run ended
    (now, if not given) and how long it took (null).  A report whose document is
    not among the uploads is kept, with a summary that names no file.
    """
    counts = analysis.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    named = analysis.reports.join(documents.select("doc_id", "original_filename"), "doc_id", "left").withColumn(
        "original_filename", F.coalesce("original_filename", F.lit("")))
    reports = (
        summary(named, counts, summaries)
        .withColumn("processing_time_seconds", (F.lit(None) if seconds is None else seconds).cast("double"))
        .withColumn("completed_at", (F.current_timestamp() if at is None else at).cast("timestamp"))
        .select(*schemas.REPORTS.fieldNames())
    )
    ended = analysis.reports.select(
        "doc_id", F.lit("completed").alias("_status"), F.lit(None).cast("string").alias("_message"),
    ).unionByName(analysis.failed.select("doc_id", F.col("status").alias("_status"), F.col("error_message").alias("_message")))
    moved = documents.join(ended, "doc_id", "left")
    seen = F.col("_status").isNotNull()
    states = moved.withColumn("status", F.coalesce("_status", "status")).withColumn(
        "error_message", F.when(seen, F.col("_message")).otherwise(F.col("error_message")))
    return Stored(reports, clause_ids(analysis.clauses), states.select(*documents.columns))


def reports_from_chunks(
    chunks: DataFrame, rules: DataFrame, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clauses and reports from stored chunks: no parsing, no chunking."""
    clauses = choose_advice(collapse_clauses(raw_clauses(chunks, rules, labels)))
    docs = chunks.select("doc_id").distinct()
    return clauses, score_documents(docs, clauses)


def reanalyse(
    chunks: DataFrame, rules: DataFrame, previous: DataFrame, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New reports under the given rules, and what changed against
    ``previous`` (doc_id, overall_risk, composite_risk_score)."""
    _, reports = reports_from_chunks(chunks, rules, labels)
    return reports, report_changes(reports, previous)


def report_changes(reports: DataFrame, previous: DataFrame) -> DataFrame:
    """Documents whose level or score differs from ``previous``, with both; one without an earlier report counts."""
    old = previous.select(
        "doc_id", F.col("overall_risk").alias("old_risk"),
        F.col("composite_risk_score").alias("old_score"))
    return (
        reports.select(
            "doc_id", F.col("overall_risk").alias("new_risk"),
            F.col("composite_risk_score").alias("new_score"))
        .join(old, "doc_id", "left")
        .filter(
            ~F.col("new_risk").eqNullSafe(F.col("old_risk"))
            | ~F.col("new_score").eqNullSafe(F.col("old_score")))
    )


def override_keywords(rules: DataFrame, override: str | None) -> DataFrame:
    """Rules whose category stands in the override text take it as keywords."""
    if not override:
        return rules
    applies = F.contains(F.lit(override.lower()), F.lower("category"))
    return rules.withColumn(
        "keywords", F.when(applies, F.lit(override)).otherwise(F.col("keywords")))


def simulate(texts: DataFrame, rules: DataFrame, override: str | None = None) -> DataFrame:
    """What every active rule would find in every text (doc_id, text).

    Matches below the threshold stay, marked; the threshold is taken as it is.
    """
    tried = override_keywords(pin_rules(rules), override)
    chunks = texts.select(
        "doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("page_number"),
        F.col("text").alias("chunk_text"))
    hits = match_rules(chunks, tried, ["chunk_text", "_sentences"], with_sentences)
    facts = rule_facts(tried).join(tried.select("rule_id", "confidence_threshold"), "rule_id")
    return (
        with_snippet(hits.join(facts, "rule_id"), out="snippet")
        .withColumn("confidence_score", confidence(F.col("evidence"), F.lit(False)))
        .select(
            "doc_id", "category", F.col("default_risk_level").alias("risk_level"), "weight",
            "confidence_threshold", F.col("evidence").alias("evidence_type"), "confidence_score",
            (F.col("confidence_score") >= F.col("confidence_threshold")).alias("passed_threshold"),
            "snippet",
        )
    )


