"""Byte-level BPE by one global shuffle of distinct words, and decoding.

Every text is split by the vocabulary's pattern.  Each task gives the different
words of a block of documents numbers and writes the documents as lists of those
numbers (the positions) to the shared folder, so that a word leaves its block
once, however often it occurs.  The words go, dealt by a hash into shards, through
the only shuffle of words: all occurrences of a word meet in one shard, where it
is merged into ids once.  The ids go back to the blocks, which put their
documents together again by position.  Decoding joins the token-byte table: its
size is that of the vocabulary, so every task holds it and probes it with whole
lists of ids.

Which characters are letters, numbers or white space is asked of the tiktoken
library itself, since other libraries follow other releases of Unicode.

Null and empty texts have no ids and decode to nothing.  Repeated rows and rows
without a key are encoded once each.  An empty table gives no rows.  Other
columns of the input are ignored, whatever their names.  A text of any length
is split as a whole; memory holds one block, or one text if that is longer.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import materialise, source_rows
from clauselens.llm.stores import new_folder, read_arrow, write_arrow

# Characters of a block, and shards of words.  A worker holds one block's
# different words, or one shard's: 4,096 shards serve about 10^10 different words.
BLOCK_CHARS = 1 << 24
SHARDS = 4096
# Ids that are put together at once.
SLICE = 1 << 17


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


# --- splitting ---------------------------------------------------------------


def class_members(name: str) -> str:
    """The characters that tiktoken takes for a class, as ranges inside brackets."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)},
                              special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.array([ord(c) for c in bytes(probe.encode_ordinary(every)).decode()], np.int64)
    ends = np.flatnonzero(np.diff(found) != 1)
    first, last = found[np.append(0, ends + 1)], found[np.append(ends, len(found) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))


_CLASS = re.compile(r"\\p\{\w+\}|\\s|\\S|\\.|\[|\]", re.S)
_PORTABLE: dict[str, str] = {}


def portable(pattern: str) -> str:
    """The pattern with its classes written out, for Python's own matcher."""
    if pattern not in _PORTABLE:
        out, at, inside = [], 0, False
        for m in _CLASS.finditer(pattern):
            out.append(pattern[at:m.start()])
            at, part = m.end(), m[0]
            if part in "[]":
                inside = part == "["
            elif part.startswith("\\p") or part == r"\s":
                part = class_members(part) if inside else f"[{class_members(part)}]"
            elif part == r"\S":
                if inside:
                    raise ValueError(r"\S inside brackets is not known")
                part = f"[^{class_members(r'\s')}]"
            out.append(part)
        _PORTABLE[pattern] = "".join(out) + pattern[at:]
    return _PORTABLE[pattern]


def _blocks(frames: Iterator[pd.DataFrame], chars: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text) of about so many characters."""
    held, size = [], 0
    for frame in frames:
        for key, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
            held.append((key, text or ""))
            size += len(held[-1][1])
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def _joined(words: list[str]) -> tuple[bytes, bytes]:
    """The words' bytes, one after another, and how many each has."""
    raw = [w.encode() for w in words]
    return b"".join(raw), _narrow(np.array([len(x) for x in raw], np.uint32))


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in one, two or four bytes each, after that width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def _numbered(words: list[str], counts: np.ndarray, shards: int) -> tuple[np.ndarray, dict[int, list[str]]]:
    """A number for each word, frequent words first in their shard, and the words by shard."""
    order = np.argsort(-counts, kind="stable")
    by_shard: dict[int, list[str]] = {0: []}
    number = np.zeros(len(words), np.int32)
    for i in order.tolist():
        shard = zlib.crc32(words[i].encode()) % shards
        own = by_shard.setdefault(shard, [])
        number[i] = len(own) * shards + shard
        own.append(words[i])
    return number, by_shard


def split_words(docs: DataFrame, pattern: str, folder: str, block_chars: int, shards: int) -> DataFrame:
    """(block, shard, words, lengths) of ``docs`` (doc_id, text); the documents go to files named by block.

    Keys go through Python as strings, which keep nulls apart from numbers.
    """
    spaced = portable(pattern)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        find = re.compile(spaced).findall
        for block in _blocks(frames, block_chars):
            seen: dict[str, int] = defaultdict(count().__next__)
            places = [np.fromiter(map(seen.__getitem__, find(text)), np.int32) for _, text in block]
            ends = np.cumsum([0, *map(len, places)])
            every = np.concatenate(places)
            words = list(seen)
            number, by_shard = _numbered(words, np.bincount(every, minlength=len(words)), shards)
            table = pa.table({
                "doc_id": pa.array([key for key, _ in block], pa.string()),
                "words": pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(number[every], pa.int32()))})
            name = write_arrow(folder, table, compression="zstd", use_dictionary=False,
                               use_byte_stream_split=["words.list.element"])
            rows = [_joined(own) for own in by_shard.values()]
            yield pd.DataFrame({"block": name, "shard": list(by_shard), "words": [r[0] for r in rows],
                                "lengths": [r[1] for r in rows]})

    return docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "block string, shard int, words binary, lengths binary")


# --- encoding ----------------------------------------------------------------


def encode_words(rows: DataFrame, ranks: str) -> DataFrame:
    """(block, shard, ids, sizes): the ids of every row's words, one after another, and how many each has.

    A shard's rows come together, and each different word of it is encoded once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # Words come whole, so nothing is left to split.
        encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks), special_tokens={})
        shard, known = None, {}
        for frame in frames:
            ids, sizes = [], []
            for own, raw, lengths in zip(frame["shard"].tolist(), frame["words"].tolist(), frame["lengths"].tolist()):
                if own != shard:
                    shard, known = own, {}
                ends = np.cumsum(_wide(lengths), dtype=np.int64).tolist()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                for word in set(words).difference(known):
                    known[word] = encoding._encode_single_piece(word)
                parts = [known[w] for w in words]
                ids.append(_narrow(np.array([i for p in parts for i in p], np.uint32)))
                sizes.append(_narrow(np.array([len(p) for p in parts], np.uint32)))
            yield pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "ids": ids, "sizes": sizes})

    return rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(
        run, "block string, shard int, ids binary, sizes binary")


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``values`` that begin at ``starts``, one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _assembled(places: np.ndarray, ends: np.ndarray, values: np.ndarray, starts: np.ndarray,
               sizes: np.ndarray) -> list[bytes]:
    """For each list of places the pieces there, joined; ``ends`` are the lists' ends, 0 first."""
    out, at = [], 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        own = places[ends[at]:ends[to]]
        raw = _gather(values, starts[own], sizes[own]).tobytes()
        cuts = np.append(0, np.cumsum(sizes[own]))[ends[at:to + 1] - ends[at]] * values.itemsize
        out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        at = to
    return out


def assemble(encoded: DataFrame, folder: str, shards: int) -> DataFrame:
    """(doc_id, ids) of all documents, put together block by block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = read_arrow(folder, frame["block"].iloc[0])
        places = [_wide(x) for x in frame["sizes"]]
        size = np.zeros(max(map(len, places)) * shards, np.int64)
        start, base = np.zeros_like(size), 0
        for shard, own in zip(frame["shard"].tolist(), places):
            at = np.arange(len(own)) * shards + shard
            size[at] = own
            start[at] = base + np.cumsum(own, dtype=np.int64) - own
            base += int(own.sum())
        values = np.concatenate([_wide(x) for x in frame["ids"]])
        words = table["words"].combine_chunks()
        if hasattr(words, "chunks"):
            words = words.chunk(0)
        ids = _assembled(words.values.to_numpy(), words.offsets.to_numpy().astype(np.int64), values, start, size)
        return pd.DataFrame({"doc_id": table["doc_id"].to_pylist(), "ids": ids})

    return encoded.groupBy("block").applyInPandas(run, "doc_id string, ids binary").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id",
           text: str = "text", block_chars: int = BLOCK_CHARS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit values."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    folder = new_folder(docs.sparkSession, "bpe-documents")
    words = materialise(split_words(source_rows(docs, key, text), pattern, folder, block_chars, shards), "bpe-words", "zstd")
    found = assemble(encode_words(words, ranks), folder, shards)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


# --- decoding ----------------------------------------------------------------


def decode(tokens: DataFrame, ranks: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the bytes of its ids joined.  Null ids count as none.

    An id that the vocabulary lacks ends the job with an error.
    """
    ranks = ranks or default_ranks()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = {i: token for token, i in read_ranks(ranks).items()}
        tokens = [table.get(i, b"") for i in range(max(table) + 1)]
        size = np.array([len(x) for x in tokens], np.int64)
        start, values = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                own = [np.frombuffer(x or b"", "<u4") for x in part["ids"].tolist()]
                places, ends = np.concatenate(own), np.cumsum([0, *map(len, own)])
                if (size[places] == 0).any():
                    raise ValueError("an id is not in the vocabulary")
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": part["ids"],
                                    "decoded": _assembled(places, ends, values, start, size)})

    rows = tokens.select(F.col(key).cast("long").cast("string").alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInPandas(run, "doc_id string, ids binary, decoded binary").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def round_trip(docs: DataFrame, ranks: str | None = None, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, its ids decoded again."""
    back = decode(encode(docs, ranks, **options), ranks)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
