"""Document scores, advice and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens import fixed_values as fv


def severity_multiplier(level: Column) -> Column:
    out = F.lit(fv.SEVERITY_MULTIPLIER_OTHER)
    for name, factor in fv.SEVERITY_MULTIPLIERS.items():
        out = F.when(F.upper(level) == name, factor).otherwise(out)
    return out


def overall_risk(score: Column, has_high: Column) -> Column:
    return (
        F.when(has_high | (score >= fv.HIGH_SCORE), "High")
        .when(score >= fv.MEDIUM_SCORE, "Medium")
        .otherwise("Low")
    )


def clause_totals(clauses: DataFrame) -> DataFrame:
    """Per document: score sum, high flag and clause count (partial aggregation
    first, so a document of very many clauses sends one row per task)."""
    return clauses.groupBy("doc_id").agg(
        F.sum(F.col("rule_weight") * severity_multiplier(F.col("risk_level"))).alias("_sum"),
        F.max(F.upper("risk_level") == "HIGH").alias("_high"),
        F.count(F.lit(1)).alias("total_risks_found"),
    )


def score_documents(docs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Docs + composite_risk_score, overall_risk, total_risks_found.

    A document without clauses gets 0.0 and Low.
    """
    score = F.round(F.coalesce("_sum", F.lit(0.0)), 2)
    return (
        docs.join(clause_totals(clauses), "doc_id", "left")
        .withColumn("composite_risk_score", score)
        .withColumn("overall_risk", overall_risk(
            F.col("composite_risk_score"), F.coalesce("_high", F.lit(False))))
        .withColumn("total_risks_found", F.coalesce("total_risks_found", F.lit(0)).cast("long"))
        .drop("_sum", "_high")
    )


def curated_text(category: Column) -> Column:
    """The first listed key inside the lower-case category decides."""
    low = F.lower(category)
    listed = [F.when(F.contains(low, F.lit(k)), F.lit(text)) for k, text in fv.CURATED_ADVICE]
    return F.coalesce(*listed, F.format_string(fv.GENERIC_ADVICE, category))


def curated_advice(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("recommendation", curated_text(F.col("category")))


def choose_advice(clauses: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Model advice by exact category, then ignoring case, then curated.

    ``advice`` has (doc_id, advice map<string,string>), at most one row per
    document; an empty text counts as missing.
    """
    if advice is None:
        return curated_advice(clauses)
    given = F.col("_advice")
    present = lambda c: F.nullif(c, F.lit(""))
    # Only the first key that is equal ignoring case is looked at.
    same = F.filter(
        F.map_entries(given), lambda e: F.lower(e["key"]) == F.lower(F.col("category")))
    return (
        clauses.join(advice.select("doc_id", F.col("advice").alias("_advice")), "doc_id", "left")
        .withColumn("recommendation", F.coalesce(
            present(F.element_at(given, F.col("category"))),
            present(F.get(same, F.lit(0))["value"]),
            curated_text(F.col("category")),
        ))
        .drop("_advice")
    )


def summary(docs: DataFrame, chunk_counts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Docs (doc_id, original_filename) + ``executive_summary``.

    ``chunk_counts`` has (doc_id, chunks); ``summaries`` (doc_id, response) the
    model's texts, where a missing one gives the stock sentence.
    """
    stock = F.format_string(
        fv.GENERIC_SUMMARY, "original_filename", F.coalesce("chunks", F.lit(0)).cast("long"))
    out = docs.join(chunk_counts.select("doc_id", "chunks"), "doc_id", "left")
    if summaries is None:
        return out.withColumn("executive_summary", stock).drop("chunks")
    return (
        out.join(summaries.select("doc_id", F.col("response").alias("_text")), "doc_id", "left")
        .withColumn("executive_summary", F.coalesce("_text", stock))
        .drop("_text", "chunks")
    )
