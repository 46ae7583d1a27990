"""Relational queries over documents, reports, clauses and chunks (Q1-Q22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.operators.containment import containing_pairs
from clauselens.sources.tables import export_reports, materialise

# --- documents and chunks of a user ----------------------------------------


def documents_of(docs: DataFrame, owner: str | DataFrame) -> DataFrame:
    """Q1: documents of one owner, or of all owners in a table (user_id), newest first."""
    if isinstance(owner, DataFrame):
        mine = docs.join(owner.select("user_id").distinct(), "user_id", "left_semi")
    else:
        mine = docs.filter(F.col("user_id") == owner)
    return mine.orderBy("user_id", F.desc("uploaded_at"), "doc_id")


def guarded(df: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Q2: ``requests`` (key, user_id) against ``df`` (key, owner).

    Adds ``access``: ok, forbidden (exists, other owner) or missing.
    """
    owners = df.select(key, F.col("user_id").alias("_owner"))
    return (
        requests.join(owners, key, "left")
        .withColumn("access", F.when(F.col("_owner").isNull(), "missing")
                    .when(F.col("_owner") == F.col("user_id"), "ok").otherwise("forbidden"))
        .drop("_owner")
    )


def chunks_of(chunks: DataFrame, doc_id) -> DataFrame:
    """Q3: chunks of one document, or of all documents in a table (doc_id), in order."""
    if isinstance(doc_id, DataFrame):
        wanted = chunks.join(doc_id.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        wanted = chunks.filter(F.col("doc_id") == doc_id)
    return wanted.orderBy("doc_id", "chunk_index").select(
        "doc_id", "chunk_index", "page_number", "token_count", "chunk_text")


# --- reports ---------------------------------------------------------------


def newest_reports(reports: DataFrame) -> DataFrame:
    """The newest report per document, by aggregation (no window, no sort)."""
    return (
        reports.groupBy("doc_id")
        .agg(F.max_by(F.struct(*reports.columns), "completed_at").alias("_r"))
        .select("_r.*")
    )


def latest_reports(reports: DataFrame, clauses: DataFrame) -> DataFrame:
    """Q4: newest report per document with nested clauses."""
    return export_reports(newest_reports(reports), clauses)


def report_state(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """Q5: ready, pending/processing, failed (with message) or missing."""
    known = reports.select("doc_id").distinct().withColumn("_ready", F.lit(True))
    state = (
        F.when(F.col("_ready").isNotNull(), "ready")
        .when(F.col("status").isin("pending", "processing"), F.col("status"))
        .when(F.col("status") == "failed", "failed")
        .otherwise("missing")
    )
    message = F.when(
        F.col("state") == "failed",
        F.concat(F.lit("Document analysis failed: "), F.coalesce("error_message", F.lit("None"))))
    return (
        docs.join(known, "doc_id", "left").withColumn("state", state)
        .select("doc_id", "state", message.alias("message"))
    )


# --- administration --------------------------------------------------------


def user_document_counts(users: DataFrame, docs: DataFrame) -> DataFrame:
    """Q6: documents are counted per owner first, then joined to the users."""
    counts = docs.groupBy("user_id").agg(F.count("doc_id").alias("document_count"))
    return (
        users.join(counts, "user_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)).cast("long"))
        .orderBy(F.desc("created_at"), "user_id")
    )


def portfolio(docs: DataFrame, users: DataFrame, reports: DataFrame) -> DataFrame:
    """Q7: documents with owner mail and report figures, newest first."""
    mails = users.select("user_id", F.col("email").alias("user_email"))
    figures = reports.select(
        "doc_id", "overall_risk", "composite_risk_score", "total_risks_found")
    return (
        docs.join(mails, "user_id").join(figures, "doc_id", "left")
        .withColumn("total_risks_found", F.coalesce("total_risks_found", F.lit(0)).cast("long"))
        .select(
            "doc_id", "original_filename", "file_type", "file_size_bytes", "status", "user_id",
            "user_email", "overall_risk", "composite_risk_score", "total_risks_found",
            "uploaded_at")
        .orderBy(F.desc("uploaded_at"), "doc_id")
    )


def system_stats(users: DataFrame, docs: DataFrame, reports: DataFrame, clauses: DataFrame) -> DataFrame:
    """Q8: one conditional aggregate per table, put side by side (one row each)."""
    is_risk = lambda level: F.count_if(F.col("overall_risk") == level)
    parts = [
        users.agg(
            F.count(F.lit(1)).alias("total_users"),
            F.count_if("is_active").alias("active_users")),
        docs.agg(
            F.count(F.lit(1)).alias("total_documents"),
            F.count_if(F.col("status") == "completed").alias("completed_analyses"),
            F.count_if(F.col("status") == "failed").alias("failed_analyses")),
        reports.agg(
            is_risk("High").alias("high_risk_documents"),
            is_risk("Medium").alias("medium_risk_documents"),
            is_risk("Low").alias("low_risk_documents"),
            F.round(F.nullif(F.avg("processing_time_seconds"), F.lit(0.0)), 2)
            .alias("avg_processing_time_seconds")),
        clauses.agg(F.count(F.lit(1)).alias("total_risk_clauses")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def list_rules(rules: DataFrame) -> DataFrame:
    """Q9: by category, equal ones by id."""
    return rules.orderBy("category", "rule_id")


def risk_distribution(reports: DataFrame, docs: DataFrame) -> DataFrame:
    """Q10: reports per level and their share of the completed documents."""
    done = docs.agg(F.count_if(F.col("status") == "completed").alias("_done"))
    levels = reports.filter(F.col("overall_risk").isin("High", "Medium", "Low")) \
        .groupBy("overall_risk").agg(F.count(F.lit(1)).alias("documents"))
    share = F.when(
        F.col("_done") > 0, F.floor(100 * F.col("documents") / F.col("_done") + 0.5)
    ).otherwise(0)
    return (
        levels.withColumn("_one", F.lit(1)).join(done.withColumn("_one", F.lit(1)), "_one")
        .select("overall_risk", "documents", share.cast("long").alias("percent"))
    )


# --- dashboard -------------------------------------------------------------


def search_documents(docs: DataFrame, term: str = "", level: str = "ALL") -> DataFrame:
    """Q11: name or owner mail contains the term; ``ALL`` lets every level pass."""
    low = term.lower()
    named = F.contains(F.lower("original_filename"), F.lit(low))
    if "user_email" in docs.columns:
        named = named | F.contains(F.lower("user_email"), F.lit(low))
    return docs.filter(named if level == "ALL" else named & (F.upper("overall_risk") == level))


def dashboard_counts(docs: DataFrame) -> DataFrame:
    """Q12."""
    return docs.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("overall_risk").isin("High", "HIGH")).alias("high_risk_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"))


def clauses_by(clauses: DataFrame, category: str = "ALL", severity: str = "ALL") -> DataFrame:
    """Q13."""
    out = clauses
    if category != "ALL":
        out = out.filter(F.col("category") == category)
    if severity != "ALL":
        out = out.filter(F.upper("risk_level") == severity)
    return out


def severity_counts(clauses: DataFrame) -> DataFrame:
    """Q13: clauses per severity, with an ALL row."""
    return (
        clauses.select(F.upper(F.coalesce("risk_level", F.lit(""))).alias("severity"))
        .rollup("severity").agg(F.count(F.lit(1)).alias("clauses"))
        .withColumn("severity", F.coalesce("severity", F.lit("ALL")))
        .filter(F.col("severity").isin("ALL", "HIGH", "MEDIUM", "LOW"))
    )


# --- report viewer ---------------------------------------------------------


def _page(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit(0)), F.lit(1))


def chunks_by_page(chunks: DataFrame) -> DataFrame:
    """Q14: chunks of a page in order; the array is bounded by the page's text."""
    return (
        chunks.groupBy("doc_id", _page(F.col("page_number")).alias("page_number"))
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("chunks"))
    )


def page_numbers(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Q15: pages of chunks and locations, and always page 1."""
    page = _page(F.col("page_number")).alias("page_number")
    return (
        chunks.select("doc_id", page)
        .union(locations.select("doc_id", "page_number"))
        .union(chunks.select("doc_id", F.lit(1)))
        .distinct()
    )


def risks_per_page(clauses: DataFrame) -> DataFrame:
    """Q16."""
    return clauses.groupBy("doc_id", _page(F.col("page_number")).alias("page_number")) \
        .agg(F.count(F.lit(1)).alias("risks"))


# Whitespace as the report viewer knows it.
_VIEWER_WS = r"[\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _viewer_form(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), _VIEWER_WS, " ")


def link_chunks(chunks: DataFrame, clauses: DataFrame, prefix_chars: int | None = None) -> DataFrame:
    """Q17: (doc_id, chunk_index, clause_id) when one holds the other, or the first ``prefix_chars`` of it.

    Both directions are one search: every text is written once and then stands as
    a hay in one direction and as a needle in the other.
    """
    ch = chunks.filter("chunk_text != ''").select(
        "doc_id", F.lit(0).alias("_side"), F.col("chunk_index").cast("string").alias("id"),
        _viewer_form(F.col("chunk_text")).alias("text"))
    cl = clauses.select(
        "doc_id", F.lit(1).alias("_side"), F.col("clause_id").cast("string").alias("id"),
        _viewer_form(F.col("clause_text")).alias("text"))
    texts = materialise(ch.unionByName(cl), "link-texts")
    start = F.col("text") if prefix_chars is None else F.substring("text", 1, prefix_chars)
    hays = texts.select("doc_id", "_side", F.col("id").alias("hay_id"), F.col("text").alias("hay"))
    needles = texts.select(
        "doc_id", (1 - F.col("_side")).alias("_side"), F.col("id").alias("needle_id"), start.alias("needle"))
    in_chunk = F.col("_side") == 0
    kinds = dict(chunks.dtypes)["chunk_index"], dict(clauses.dtypes)["clause_id"]
    return containing_pairs(hays, needles, ["doc_id", "_side"]).select(
        "doc_id", F.when(in_chunk, F.col("hay_id")).otherwise(F.col("needle_id")).cast(kinds[0]).alias("chunk_index"),
        F.when(in_chunk, F.col("needle_id")).otherwise(F.col("hay_id")).cast(kinds[1]).alias("clause_id")).distinct()


def chunk_severity(links: DataFrame, clauses: DataFrame) -> DataFrame:
    """Q18: highest severity among the linked clauses of each chunk."""
    level = F.upper("risk_level")
    rank = F.when(level == "HIGH", 3).when(level == "MEDIUM", 2).otherwise(1)
    top = F.max("_rank")
    return (
        links.join(clauses.select("doc_id", "clause_id", rank.alias("_rank")), ["doc_id", "clause_id"])
        .groupBy("doc_id", "chunk_index")
        .agg(F.when(top == 3, "HIGH").when(top == 2, "MEDIUM").otherwise("LOW").alias("severity"))
    )


def search_chunks(chunks: DataFrame, term: str) -> DataFrame:
    """Q19."""
    return chunks.filter(F.contains(F.lower("chunk_text"), F.lit(term.lower()))) if term else chunks


def select_clauses(clauses: DataFrame, ids: DataFrame | None = None, key: str = "clause_id") -> DataFrame:
    """Q20: the clauses of an id list; none given means all."""
    return clauses if ids is None else clauses.join(ids.select(key).distinct(), key, "left_semi")


# --- health ----------------------------------------------------------------


def data_health(spark: SparkSession, names, rules: DataFrame | None = None) -> DataFrame:
    """Q21: PASS or FAIL per required table; WARNING for a rules table without rows."""
    rows = [(n, "PASS" if spark.catalog.tableExists(n) else "FAIL") for n in names]
    checks = spark.createDataFrame(rows, "name string, status string")
    if rules is None:
        return checks
    seeded = rules.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit("seeded rules").alias("name"),
        F.when(F.col("_n") > 0, "PASS").otherwise("WARNING").alias("status"))
    return checks.unionByName(seeded)


def rollup_checks(checks: DataFrame) -> DataFrame:
    """Q22: counts per outcome and the overall status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.agg(
        F.count(F.lit(1)).alias("total_tests"), n("PASS").alias("passed"),
        n("FAIL").alias("failed"), n("WARNING").alias("warnings"),
        F.when(n("FAIL") == 0, "ALL_SYSTEMS_OPERATIONAL").otherwise("SYSTEM_DEGRADED")
        .alias("overall_status"))
