"""Incremental analysis of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from clauselens import schemas
from clauselens.operators.chunking import chunk
from clauselens.operators.clauses import collapse_clauses
from clauselens.operators.scoring import choose_advice, score_documents
from clauselens.plans.report import document_entities, raw_clauses
from clauselens.sources.tables import BUCKETS, bucket, materialise, scratch, write_results


def store_analysis(pages: DataFrame, rules: DataFrame, out: str, single_page: bool = False,
                   buckets: int = BUCKETS) -> None:
    """Analyses pages and replaces the results of their documents.

    Every table is written before the next one is built from it, so texts are
    parsed and matched once.
    """
    ids = pages.select("doc_id").distinct()
    entities, failed = document_entities(pages, single_page)
    chunks = materialise(chunk(pages, single_page=single_page), "chunks")
    raw = materialise(raw_clauses(chunks, rules), "clauses")
    clauses = materialise(choose_advice(collapse_clauses(raw)), "collapsed")
    reports = score_documents(entities, clauses)
    for df, name in (
        (chunks, "document_chunks"), (clauses, "risk_clauses"), (reports, "analysis_reports"),
        (failed, "failed_documents"),
    ):
        write_results(df, f"{out}/{name}", ids, buckets=buckets)


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages arriving as Parquet files."""
    reader = spark.readStream.schema(schemas.PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def arrived_pages(spark: SparkSession, pages: str, schema: StructType, number: int, buckets: int = BUCKETS) -> DataFrame:
    """All stored pages in the buckets of the documents of a batch, with their ``batch``."""
    schema = StructType([*(f for f in schema.fields if f.name != "doc_bucket"), StructField("batch", LongType()),
                         StructField("doc_bucket", IntegerType())])
    stored = spark.read.schema(schema).option("basePath", pages).parquet(f"{pages}/batch=*")
    own = stored.filter(F.col("batch") == number).select("doc_bucket").distinct().limit(buckets)
    # At most as many small numbers as there are buckets; the scan opens their folders alone.
    return stored.filter(F.col("doc_bucket").isin([r[0] for r in own.collect()]))


def stream_analysis(
    stream: DataFrame, rules: DataFrame, out: str, checkpoint: str,
    single_page: bool = False, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Analyses what has arrived and stops.

    Arriving pages are stored first, by batch and by a hash bucket of their
    document; then every document that the batch touches is analysed from all its
    stored pages, so pages of one document may come in any number of batches, and
    only the buckets of touched documents are read.  Of a page number that arrives
    again, the newest batch counts; pages without a number all stay.  A replayed
    batch overwrites its own partition and its documents' results.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, pages = batch.sparkSession, f"{out}/arrived_pages"
        arrived = batch.withColumn("doc_bucket", bucket("doc_id", buckets))
        arrived.write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{pages}/batch={number}")
        stored = arrived_pages(spark, pages, arrived.schema, number, buckets)
        touched = stored.filter(F.col("batch") == number).select("doc_id").distinct()
        newest = Window.partitionBy("doc_id", "page_number").orderBy(F.desc("batch"))
        numbered, bare = stored.filter("page_number IS NOT NULL"), stored.filter("page_number IS NULL")
        latest = numbered.withColumn("_age", F.rank().over(newest)).filter("_age = 1").drop("_age")
        current = latest.unionByName(bare).join(touched, "doc_id", "left_semi").select(*batch.columns)
        with scratch(spark):
            store_analysis(materialise(current, "touched-pages"), rules, out, single_page, buckets)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_status_counts(stream: DataFrame) -> DataFrame:
    """Documents per status, for ``complete`` output mode."""
    return stream.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))
