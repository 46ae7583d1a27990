"""Packing: concatenate all documents' ids and cut fixed windows.

Pass one stores each document's ids with its place inside its part; the totals
per part, summed up in part order, give every part's global offset.  Pass two
adds both and cuts at the multiples of the window.  Every sequence but the last
is full, so at most ``window - 1`` positions are padding in all.

Null texts count as empty: such a document is its end id alone.  Repeated rows
are packed once each.  An empty table gives no pieces.  Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import compute_once, materialise, source_rows
from clauselens.llm.encode import default_tokenizer, encoded, part_bases

WINDOW = 4096
END_ID = 2


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text", special_as_text: bool = False,
) -> DataFrame:
    """One row per piece: a boundary record and the piece's ids.

    doc_id, start (ids of the document before the piece), length, doc_tokens,
    sequence_id, offset (place in the sequence) and ids (unsigned little-endian
    32-bit values).
    """
    tokenizer = tokenizer or default_tokenizer("word_bpe_49k.json")
    tokens = materialise(encoded(
        source_rows(docs, key, text), tokenizer, end_id, special_as_text=special_as_text), "pack-ids", "zstd")
    # One row for each part of the input: some bytes for a gigabyte of text.
    placed = tokens.join(F.broadcast(part_bases(tokens)), F.col("part") == F.col("base_part"))
    at = F.col("base") + F.col("local_start")
    # Windows touched by the document, first to last.
    first, last = F.floor(at / window), F.floor((at + F.col("n_tokens") - 1) / window)
    cut = placed.filter(F.col("n_tokens") > 0).select(
        "doc_id", "n_tokens", "ids", at.alias("at"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0))
    end = F.least((F.col("sequence_id") + 1) * window - F.col("at"), F.col("n_tokens"))
    pieces = compute_once(cut, start=start, end=end)
    return pieces.select(
        "doc_id", "start", (F.col("end") - F.col("start")).alias("length"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        F.substring("ids", (F.col("start") * 4 + 1).cast("int"), ((F.col("end") - F.col("start")) * 4).cast("int"))
        .alias("ids"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Boundary records with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
