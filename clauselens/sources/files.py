"""Raw files: scan, ingest gate, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens import fixed_values as fv


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, original_filename, file_size_bytes, modified_at, content)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
        .select(
            "path", F.element_at(F.split("path", "/"), -1).alias("original_filename"),
            F.col("length").alias("file_size_bytes"),
            F.col("modificationTime").alias("modified_at"), "content")
    )


def file_extension(name: Column) -> Column:
    return F.when(
        F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))
    ).otherwise("")


def check_upload(files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """S3: files + ``file_type`` and ``reason`` (null when the file is fine)."""
    extension = file_extension(F.col("original_filename"))
    size = F.col("file_size_bytes")
    reason = (
        F.when(~extension.isin(*fv.ALLOWED_EXTENSIONS), "unsupported format")
        .when(size > max_bytes, "too large")
        .when(size == 0, "empty file")
    )
    return files.withColumn("file_type", F.upper(extension)).withColumn("reason", reason)


def validate(files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, rejected with ``reason``)."""
    checked = check_upload(files, max_bytes)
    return (
        checked.filter("reason is null").drop("reason"),
        checked.filter("reason is not null"),
    )


def fingerprint(df: DataFrame, col: str = "content") -> DataFrame:
    """Adds the SHA-256 of a column."""
    return df.withColumn("file_hash_sha256", F.sha2(F.col(col).cast("binary"), 256))


def exact_duplicates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contents that occur more than once: (hash, copies, first key).

    Only hashes, counts and smallest keys are shuffled, after a partial
    aggregation, so a content with very many copies is no hot spot.
    """
    return (
        df.groupBy("file_hash_sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias(f"first_{key}"))
        .filter("copies > 1")
    )
