"""Parsed pages (S5-S7): what a file parser hands over, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.text import clean_text, strip


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text, pages): pages in order, joined by a blank line.

    Pages without text are left out.  The result is one text value per
    document, so a document is bounded here by the upload limit of ``validate``;
    chunking and matching never need it and read the pages.
    """
    text = F.coalesce("text", F.lit(""))
    item = F.when(text != "", F.struct("page_number", text.alias("text")))
    return (
        pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_pages"))
        .select(
            "doc_id",
            F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n").alias("full_text"),
            F.size("_pages").alias("pages"),
        )
    )


def merge_text_layers(pages: DataFrame) -> DataFrame:
    """One text per page from its own layer and a recognised one.

    The second layer counts only where the page has little text for its size or
    is mostly image.  Pages that stay empty are dropped.
    """
    area = F.greatest(F.col("area_sqin"), F.lit(fv.MIN_PAGE_AREA_SQIN))
    sparse = F.length("_direct") / area < fv.SPARSE_CHARS_PER_SQIN
    needed = sparse | (F.coalesce("image_ratio", F.lit(0.0)) >= fv.IMAGE_DOMINANCE_RATIO)
    second = F.when(needed, F.col("_second")).otherwise("")
    merged = (
        F.when(second == "", F.col("_direct"))
        .when(F.col("_direct") == "", second)
        .when(F.contains("_direct", second), F.col("_direct"))
        .otherwise(F.concat("_direct", F.lit("\n\n"), second))
    )
    return (
        pages.withColumn("_direct", clean_text(strip(F.col("direct_text"))))
        .withColumn("_second", clean_text(F.col("ocr_text")))
        .select("doc_id", "page_number", clean_text(merged).alias("text"))
        .filter(F.col("text") != "")
    )


def flatten_rows(rows: DataFrame) -> DataFrame:
    """Table rows (doc_id, row_number, cells) to lines of text."""
    cells = F.filter(F.transform("cells", strip), lambda c: c != "")
    return (
        rows.select("doc_id", "row_number", F.array_join(cells, " | ").alias("line"))
        .filter(F.col("line") != "")
    )
