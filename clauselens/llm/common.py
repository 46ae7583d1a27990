"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.functions.once import compute_once
from clauselens.sources.tables import materialise

__all__ = ["bounded_sample", "compute_once", "keep_rows", "materialise", "source_rows", "table", "word_array"]

# White space between words: space and the controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) alone, under these two names; all other columns stay behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def word_array(text: Column) -> Column:
    """Words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose keys come first by hash; the same ones in any run.

    Every task passes on only rows that can be among them: those with a hash
    below the share that is wanted and six standard errors more.
    """
    n, span = rows.count(), 1 << 30
    if n <= limit:
        return rows
    place = F.pmod(F.xxhash64(key), F.lit(span))
    likely = rows.filter(place < int(min(1.0, (limit + 6 * limit ** 0.5 + 20) / n) * span))
    return likely.orderBy(place, key).limit(limit)


def keep_rows(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on a key column that may be null; ``df`` keeps its columns."""
    named = keys.select(F.col(keys.columns[0]).alias("_llm_key"))
    return df.join(named, df[key].eqNullSafe(named["_llm_key"]), how)


def batches(frames: Iterable, rows: int) -> Iterator:
    """Cuts Arrow frames into pieces of at most ``rows`` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]
