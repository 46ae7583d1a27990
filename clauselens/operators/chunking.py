"""Sliding-window chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.text import strip_page, stripped_words, word_count

# Pages numbered together when chunk numbers are summed up across a document.
PAGE_BLOCK = 1000


def _windows(tokens: Column, stripped: Column, size: int, stride: int) -> Column:
    """Array of (text, token_count) for one page; empty for a blank page."""
    n = F.size(tokens)
    whole = F.array(F.struct(stripped.alias("chunk_text"), n.alias("token_count")))
    last = F.ceil((n - size) / F.lit(stride)).cast("int")

    def window(i: Column) -> Column:
        # The slice takes in the whole array each time, so the count is not read from a second one.
        return F.struct(
            F.array_join(F.slice(tokens, i * stride + 1, F.lit(size)), " ").alias("chunk_text"),
            F.least(F.lit(size), n - i * stride).alias("token_count"))

    return (
        F.when(n == 0, F.slice(whole, 1, 0))
        .when(n <= size, whole)
        .otherwise(F.transform(F.sequence(F.lit(0), last), window))
    )


def chunk(
    pages: DataFrame,
    size: int = fv.CHUNK_WORDS,
    overlap: int = fv.CHUNK_OVERLAP_WORDS,
    single_page: bool = False,
    order: str = "page_number",
) -> DataFrame:
    """Chunks of pages (doc_id, page_number, text).

    ``chunk_index`` runs across the pages of a document in the order of the
    numeric column ``order``, null first and equal ones by text.  With
    ``single_page`` (one row per document) it is the position on the page and
    nothing is shuffled.  Otherwise pages are shuffled once by document and
    block of pages, so a document of very many pages spreads over the cluster.
    """
    stride = max(size - overlap, 1)
    if single_page:
        placed = pages.withColumn("_offset", F.lit(0))
    else:
        placed = _with_offsets(pages, size, stride, order)
    return (
        placed.select("doc_id", "page_number", "_offset", strip_page(F.col("text")).alias("_page"))
        .withColumn("_tokens", stripped_words(F.coalesce(F.col("_page"), F.lit(""))))
        .select(
            "doc_id", "page_number", "_offset",
            F.posexplode(_windows(F.col("_tokens"), F.col("_page"), size, stride))
            .alias("_pos", "_w"),
        )
        .select(
            "doc_id",
            (F.col("_offset") + F.col("_pos")).cast("int").alias("chunk_index"),
            F.col("page_number").cast("int").alias("page_number"),
            F.col("_w.chunk_text").alias("chunk_text"),
            F.col("_w.token_count").alias("token_count"),
        )
    )


def _window_count(text: Column, size: int, stride: int) -> Column:
    """Windows of a page, from the word count alone."""
    n = word_count(F.coalesce(text, F.lit("")))
    more = F.ceil((n - size) / F.lit(stride)) + 1
    return (
        F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(more)
        .cast("long").alias("_count")
    )


def _with_offsets(pages: DataFrame, size: int, stride: int, order: str) -> DataFrame:
    """Adds ``_offset``, the windows of all earlier pages of the document.

    Every page row gets its own running sum, whatever its number.  The sum has
    two levels, so that no task holds more than PAGE_BLOCK pages of one document
    at the lower level (or those without a number) and one row per block at the
    upper.
    """
    block = F.floor(F.coalesce(F.col(order), F.lit(-1)) / PAGE_BLOCK)
    blocked = pages.select(
        "doc_id", "page_number", "text", F.col(order).alias("_order"), block.alias("_block"),
        _window_count(F.col("text"), size, stride))
    in_block = (
        Window.partitionBy("doc_id", "_block")
        .orderBy(F.asc_nulls_first("_order"), F.asc_nulls_first("text"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before_block = (
        Window.partitionBy("_d").orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = (
        blocked.groupBy(F.col("doc_id").alias("_d"), F.col("_block").alias("_b"))
        .agg(F.sum("_count").alias("_total"))
        .select("_d", "_b", (F.sum("_total").over(before_block) - F.col("_total")).alias("_before"))
    )
    return (
        blocked.withColumn("_within", F.sum("_count").over(in_block) - F.col("_count"))
        .join(totals, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b")))
        .withColumn("_offset", F.col("_before") + F.col("_within"))
    )
