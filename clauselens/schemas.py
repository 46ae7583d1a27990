"""Stored tables (S1).  The document key is whatever the source uses; LONG here."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_TEXTS = ArrayType(StringType())

USERS = _struct(
    ("user_id", StringType()), ("email", StringType()), ("full_name", StringType()),
    ("role", StringType()), ("is_active", BooleanType()), ("created_at", TimestampType()),
)
DOCUMENTS = _struct(
    ("doc_id", LongType()), ("user_id", StringType()), ("original_filename", StringType()),
    ("file_type", StringType()), ("file_size_bytes", LongType()),
    ("file_hash_sha256", StringType()), ("status", StringType()),
    ("error_message", StringType()), ("uploaded_at", TimestampType()),
)
PAGES = _struct(("doc_id", LongType()), ("page_number", IntegerType()), ("text", StringType()))
CHUNKS = _struct(
    ("doc_id", LongType()), ("chunk_index", IntegerType()), ("page_number", IntegerType()),
    ("chunk_text", StringType()), ("token_count", IntegerType()),
    ("embedding", ArrayType(FloatType())),
)
KEY_ENTITIES = _struct(
    ("parties", _TEXTS), ("effective_dates", _TEXTS), ("governing_law", StringType()),
    ("jurisdiction", StringType()), ("monetary_amounts", _TEXTS),
)
REPORTS = _struct(
    ("doc_id", LongType()), ("executive_summary", StringType()), ("key_entities", KEY_ENTITIES),
    ("overall_risk", StringType()), ("composite_risk_score", DoubleType()),
    ("total_risks_found", LongType()), ("processing_time_seconds", DoubleType()),
    ("completed_at", TimestampType()),
)
CLAUSES = _struct(
    ("doc_id", LongType()), ("chunk_index", IntegerType()), ("rule_id", IntegerType()),
    ("category", StringType()), ("clause_text", StringType()), ("explanation", StringType()),
    ("risk_level", StringType()), ("rule_weight", DoubleType()),
    ("confidence_score", DoubleType()), ("page_number", IntegerType()),
    ("recommendation", StringType()),
)
RULES = _struct(
    ("rule_id", IntegerType()), ("category", StringType()), ("default_risk_level", StringType()),
    ("confidence_threshold", DoubleType()), ("weight", DoubleType()),
    ("description", StringType()), ("keywords", StringType()), ("is_active", BooleanType()),
)
DEFINITIONS = _struct(
    ("def_key", StringType()), ("multi_word", _TEXTS), ("primary_pattern", StringType()),
    ("context_terms", _TEXTS), ("keywords", _TEXTS),
)
ALIASES = _struct(("alias", StringType()), ("def_key", StringType()))

TABLES = {
    "users": USERS,
    "documents": DOCUMENTS,
    "document_chunks": CHUNKS,
    "analysis_reports": REPORTS,
    "risk_clauses": CLAUSES,
    "risk_rules_config": RULES,
    "document_pages": PAGES,
}
