"""Stored tables: scan, idempotent replace, nested export."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clauselens import schemas
from clauselens.session import checkpoint_dir

BUCKETS = 256


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One stored table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{directory}/{name}")


# Folders that ``materialise`` has made in this process, oldest first.
_made: list[str] = []


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path, compression=compression)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Deletes what ``materialise`` has written for these frames; nothing may read them any more."""
    for df in stored:
        _delete(df.sparkSession, df.stored_at)
        _made.remove(df.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what ``materialise`` has stored inside; frames that read it are then void."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bucket(key: str, buckets: int):
    """The hash bucket of a key, under the name that stored tables use."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("doc_bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_results(
    df: DataFrame, path: str, ids: DataFrame, key: str = "doc_id", buckets: int = BUCKETS
) -> None:
    """Replaces all rows of the documents in ``ids`` by those in ``df``.

    Running it again gives the same table.  The table is partitioned by a hash
    bucket of the key; only the buckets that hold one of the ids are rewritten.
    The merged rows are written to the shared folder first, so the table is
    never read and overwritten by the same job.
    """
    spark = df.sparkSession
    new = df.withColumn("doc_bucket", bucket(key, buckets))
    if not _exists(spark, path):
        new.hint("rebalance", "doc_bucket").write.partitionBy("doc_bucket").parquet(path)
        return
    ids = ids.select(key).distinct()
    touched = [  # at most ``buckets`` small integers
        r[0] for r in ids.select(bucket(key, buckets)).distinct().limit(buckets).collect()
    ]
    kept = (
        spark.read.schema(new.schema).parquet(path)
        .filter(F.col("doc_bucket").isin(touched))
        .join(ids, key, "left_anti")
    )
    merged = materialise(kept.unionByName(new), "replace")
    (
        merged.hint("rebalance", "doc_bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("doc_bucket").parquet(path)
    )
    # Dynamic overwrite leaves partitions alone that get no row at all.
    filled = {r[0] for r in merged.select("doc_bucket").distinct().limit(buckets).collect()}
    for b in set(touched) - filled:
        _delete(spark, f"{path}/doc_bucket={b}")


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table of ``write_results`` without its bucket column."""
    stored = StructType([*schema.fields, StructField("doc_bucket", IntegerType())])
    return spark.read.schema(stored).parquet(path).drop("doc_bucket")


_NESTED = (
    "chunk_index", "rule_id", "category", "clause_text", "explanation", "risk_level",
    "confidence_score", "page_number", "recommendation",
)


def nest_clauses(clauses: DataFrame, chunks_per_part: int | None = None) -> DataFrame:
    """(doc_id, part, risk_clauses): clause arrays in chunk order, one row per document.

    With ``chunks_per_part`` a document's clauses go on in a further row (part)
    after so many chunks.
    """
    fields = [c for c in _NESTED if c in clauses.columns]
    return (
        clauses.withColumn("part", _part(chunks_per_part))
        .groupBy("doc_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("risk_clauses"))
    )


def _part(chunks: int | None):
    return F.lit(0) if chunks is None else F.floor(F.col("chunk_index") / chunks).cast("int")


def export_reports(reports: DataFrame, clauses: DataFrame, chunks_per_part: int | None = None) -> DataFrame:
    """Reports with their clauses nested; no clause gives an empty array."""
    nested = nest_clauses(clauses, chunks_per_part)
    kind = nested.schema["risk_clauses"].dataType.simpleString()
    return (
        reports.join(nested, "doc_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("risk_clauses", F.coalesce("risk_clauses", F.array().cast(kind)))
    )


def report_json(nested: DataFrame) -> DataFrame:
    """One JSON text per nested report row."""
    return nested.select("doc_id", "part", F.to_json(F.struct(*nested.columns)).alias("report"))


def reset(spark: SparkSession, directory: str, rules: DataFrame) -> None:
    """M9: empties the derived tables and stores the given seed rules."""
    for name in ("document_chunks", "analysis_reports", "risk_clauses"):
        spark.createDataFrame([], schemas.TABLES[name]).write.mode("overwrite") \
            .parquet(f"{directory}/{name}")
    rules.write.mode("overwrite").parquet(f"{directory}/risk_rules_config")
