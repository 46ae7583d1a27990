"""Token counts: an exact histogram of encoded lengths.

Documents are encoded whole and counted by length, so the histogram has one row
per different length, however many documents there are.  Sums from the long end
answer, for every context limit that is a length in the table, how many
documents and tokens fit, and how many tokens remain if longer documents are cut
there; a limit between two lengths has the answer of ``at_limits``.

Null texts count as empty and have length 0 plus the end id, if one is given.
Repeated rows count once each.  An empty table gives an empty histogram.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import materialise, source_rows
from clauselens.llm.encode import default_tokenizer, encoder_of


def token_lengths(
    docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None, key: str = "doc_id",
    text: str = "text", special_as_text: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    import pandas as pd

    tokenizer = tokenizer or default_tokenizer("byte_bpe_50k.json")
    extra = int(end_id is not None)

    def run(frames):
        encoder = encoder_of(tokenizer, special_as_text)
        for frame in frames:
            for at in range(0, len(frame), 256):
                piece = frame.iloc[at:at + 256]
                yield pd.DataFrame({"doc_id": piece["doc_id"].array,
                                    "n_tokens": [len(x) // 4 + extra for x in encoder(piece["text"].tolist())]})

    return source_rows(docs, key, text).mapInPandas(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length with its suffix sums.

    n_tokens, n_docs; docs_longer and tokens_longer (strictly longer documents);
    docs_within and tokens_within (documents of at most this length);
    truncated_total (tokens left when every document is cut to this length);
    total_docs, total_tokens.

    Lengths lie in bands of an eighth of a power of two; sums run inside a band
    and over the few bands, so no task sees all lengths.
    """
    # Stored: the counts are read twice, and texts must be encoded once.
    counts = materialise(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-counts")
    counts = counts.withColumn("band", F.floor(F.log2(F.col("n_tokens") + 1) * 8).cast("int"))
    tokens = F.col("n_docs") * F.col("n_tokens")
    bands = counts.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum(tokens).alias("band_tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    bands = bands.select(
        F.col("band").alias("of_band"), F.coalesce(F.sum("band_docs").over(above), zero).alias("above_docs"),
        F.coalesce(F.sum("band_tokens").over(above), zero).alias("above_tokens"),
        F.sum("band_docs").over(everything).alias("total_docs"),
        F.sum("band_tokens").over(everything).alias("total_tokens"))
    longer = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each eighth of a power of two.
    summed = counts.join(F.broadcast(bands), F.col("band") == F.col("of_band")).select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("above_docs") + F.coalesce(F.sum("n_docs").over(longer), zero)).alias("docs_longer"),
        (F.col("above_tokens") + F.coalesce(F.sum(tokens).over(longer), zero)).alias("tokens_longer"))
    within = F.col("total_tokens") - F.col("tokens_longer")
    return summed.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_within"), within.alias("tokens_within"),
        (within + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"), "total_docs", "total_tokens")


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, truncated_total) for the few limits a user asks about."""
    sums = []
    for limit in limits:
        fits = F.when(F.col("n_tokens") <= limit, F.col("n_docs")).otherwise(F.lit(0))
        cut = F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit)))
        sums.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), F.sum(fits).alias("docs_within"),
                             cut.alias("truncated_total")))
    return histogram.agg(F.array(*sums).alias("found")).select(F.inline("found"))


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of documents does not exceed."""
    reached = [
        F.min(F.when(F.col("docs_within") >= F.ceil(F.col("total_docs") * F.lit(q)), F.col("n_tokens")))
        for q in shares
    ]
    row = histogram.agg(F.array(*reached).alias("found"))
    return row.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(q)) for q in shares]).alias("share"),
                                            F.col("found").alias("n_tokens"))))
