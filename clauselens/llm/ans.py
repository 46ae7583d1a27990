"""Token ids in a binary archive, coded by a static range asymmetric numeral system.

One frequency table, from the counts of all ids of all documents, is shared by
every block.  A block holds whole documents, at least ``block`` ids if more
follow, dealt to ``lanes`` coders that work side by side: lane j codes ids j, j + lanes, ...  Every coder keeps a state
of 64 bits and moves 32 bits out or in at a time, so one pass of array
operations codes one id of every lane.  Blocks need nothing but the table, so
they decode in any order and in parallel.

File: magic ``RANSIDS1``, then blocks.  A block is a header of little-endian
numbers (ids u32, lanes u32, number of 32-bit words u32, CRC-32 of the ids u32,
position of its first id in the file u64), the final states (u64 per lane), and
the words in the order in which the decoder reads them.  The table beside the
files holds the checkpoints: for every document its file, the byte offset and
size of its block, its first id there and its number of ids.  A block whose ids
do not give its checksum is an error.

Null texts count as empty.  Repeated rows are written once each.  A null key
comes first.  An empty table gives no files and no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import materialise, source_rows
from clauselens.llm.encode import default_tokenizer, encoder_of
from clauselens.llm.stores import Reader, Writer, new_folder

MAGIC = b"RANSIDS1"
HEADER = struct.Struct("<IIIIQ")
BITS = 20
LANES = 4096
BLOCK = 1 << 19
END_ID = 2
_LOW = np.uint64(1 << 32)


class Table:
    """Frequencies that add up to 1 << bits, one at least for every id that occurs."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        ids = sorted(counts)
        if len(ids) > 1 << bits:
            raise ValueError("more different ids than the table has places")
        self.bits = bits
        self.ids = np.array(ids, dtype=np.uint32)
        self.freq = self._shares(np.array([counts[i] for i in ids], dtype=np.float64), 1 << bits)
        self.start = np.cumsum(self.freq) - self.freq
        self._slot_of = self._place_of = None

    @staticmethod
    def _shares(counts: np.ndarray, total: int) -> np.ndarray:
        if not len(counts):
            return np.zeros(0, np.int64)
        share = np.maximum(1, np.floor(counts / counts.sum() * total).astype(np.int64))
        # What rounding left over goes to, or comes from, the most frequent ids.
        order, left = np.argsort(-counts, kind="stable"), total - int(share.sum())
        at = 0
        while left:
            i = order[at % len(order)]
            step = left if left > 0 else -min(-left, int(share[i]) // 2)
            share[i] += step
            left -= step
            at += 1
        return share

    def to_bytes(self) -> bytes:
        return struct.pack("<BI", self.bits, len(self.ids)) + self.ids.astype("<u4").tobytes() + \
            self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        bits, n = struct.unpack_from("<BI", raw)
        table = cls({}, bits)
        table.ids = np.frombuffer(raw, "<u4", n, 5)
        table.freq = np.frombuffer(raw, "<u4", n, 5 + 4 * n).astype(np.int64)
        table.start = np.cumsum(table.freq) - table.freq
        return table

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Row of each id in the table."""
        if self._place_of is None:
            self._place_of = np.full(int(self.ids.max()) + 1, -1, np.int32)
            self._place_of[self.ids] = np.arange(len(self.ids))
        return self._place_of[ids]

    def slots(self) -> np.ndarray:
        if self._slot_of is None:
            self._slot_of = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq)
        return self._slot_of


def encode_block(ids: np.ndarray, table: Table, first: int, lanes: int = LANES) -> bytes:
    """One block of ids (unsigned 32-bit), the first of which is number ``first`` of its file."""
    lanes = max(1, min(lanes, len(ids)))
    at = table.places(ids)
    freq, start = table.freq[at].astype(np.uint64), table.start[at].astype(np.uint64)
    state, out = np.full(lanes, _LOW, np.uint64), []
    bits, room = np.uint64(table.bits), np.uint64(64 - table.bits)
    # Coders run backwards, so that the decoder runs forwards.
    for row in range((len(ids) - 1) // lanes, -1, -1):
        f, s = freq[row * lanes:(row + 1) * lanes], start[row * lanes:(row + 1) * lanes]
        x = state[:len(f)]
        full = np.flatnonzero((x >> room) >= f)
        if len(full):
            moved = x[full]
            out.append(moved.astype("<u4"))  # the lower half
            x[full] = moved >> np.uint64(32)
        q = x // f
        state[:len(f)] = (q << bits) + (x - q * f) + s
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    raw = ids.astype("<u4").tobytes()
    return HEADER.pack(len(ids), lanes, len(words), zlib.crc32(raw), first) + state.astype("<u8").tobytes() + \
        words.tobytes()


def decode_block(raw: bytes, table: Table) -> tuple[int, np.ndarray]:
    """(number of the first id, ids), checked."""
    n, lanes, n_words, crc, first = HEADER.unpack_from(raw)
    state = np.frombuffer(raw, "<u8", lanes, HEADER.size).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", n_words, HEADER.size + 8 * lanes).astype(np.uint64)
    slots, out = table.slots(), np.empty(n, np.int32)
    freq, start = table.freq.astype(np.uint64), table.start.astype(np.uint64)
    bits, mask, at = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    for row in range(0, n, lanes):
        x = state[:min(lanes, n - row)]
        low = x & mask
        place = slots[low]
        out[row:row + lanes] = place
        x = freq[place] * (x >> bits) + low - start[place]
        short = np.flatnonzero(x < _LOW)
        if len(short):
            x[short] = (x[short] << np.uint64(32)) | words[at:at + len(short)]
            at += len(short)
        state[:len(x)] = x
    ids = table.ids[out].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block does not give its checksum")
    return first, ids


@dataclass(frozen=True)
class Archive:
    """Where an archive's files are, the frequency table, and the checkpoints."""

    folder: str
    table: bytes
    spans: DataFrame  # doc_id, file, offset, size, first_id, n_ids, start


def _packed(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids) with compressed ids, kept small for the store and the sort."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(frames):
        encoder, shrink = encoder_of(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for frame in frames:
            for at in range(0, len(frame), 256):
                piece = frame.iloc[at:at + 256]
                found = encoder(piece["text"].tolist())
                yield pd.DataFrame({"doc_id": piece["doc_id"].array, "ids": [shrink(x + end) for x in found]})

    return docs.mapInPandas(run, "doc_id long, ids binary")


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<u4")


def write_archive(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID,
                  key: str = "doc_id", text: str = "text", block: int = BLOCK, lanes: int = LANES) -> Archive:
    """Encodes whole texts and writes their ids in ascending key order, one file per task."""
    tokenizer = tokenizer or default_tokenizer("byte_bpe_50k.json")
    tokens = materialise(_packed(source_rows(docs, key, text), tokenizer, end_id), "ids", "uncompressed")
    shared = Table(_counts(tokens)).to_bytes()
    # Ranges of keys, in order.
    parts = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(frames):
        from pyspark import TaskContext

        part, table, file = TaskContext.get().partitionId(), Table.from_bytes(shared), None
        names, held, n_held, first = [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal names, held, n_held, first
            lengths = np.array([len(x) for x in held], np.int64)
            raw = encode_block(np.concatenate(held), table, first, lanes)
            out = pd.DataFrame({
                "part": part, "doc_id": pd.array(names, "Int64"), "file": file.name, "offset": file.write(raw),
                "size": len(raw), "first_id": np.cumsum(lengths) - lengths, "n_ids": lengths,
                "local_start": first + np.cumsum(lengths) - lengths})
            names, held, n_held, first = [], [], 0, first + n_held
            return out

        for frame in frames:
            if file is None and len(frame):
                file = Writer(folder, ".rans")
                file.write(MAGIC)
            for doc, raw in zip(frame["doc_id"].astype("Int64"), frame["ids"]):
                names.append(doc)
                held.append(_unpacked(raw))
                n_held += len(held[-1])
                if n_held >= block or len(names) >= block:
                    yield flush()
        if file is not None:
            if names:
                yield flush()
            file.close()

    kind = ("part int, doc_id long, file string, offset long, size long, first_id long, n_ids long, "
            "local_start long")
    index = materialise(ordered.select("doc_id", "ids").mapInPandas(write, kind), "checkpoints")
    # One row for each file.
    spans = index.join(F.broadcast(_bases(index)), F.col("part") == F.col("base_part")).select(
        "doc_id", "file", "offset", "size", "first_id", "n_ids", (F.col("base") + F.col("local_start")).alias("start"))
    return Archive(folder, shared, spans)


def _bases(index: DataFrame) -> DataFrame:
    """(base_part, base): ids in all earlier files, summed up in their order."""
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("base_part"),
                         F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has ids."""

    def count(frames):
        total = np.zeros(0, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 512):
                found = np.bincount(np.concatenate([_unpacked(x) for x in frame["ids"].iloc[at:at + 512]]))
                if len(found) < len(total):
                    found, total = total, found
                found[:len(total)] += total
                total = found
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    counted = tokens.select("ids").mapInPandas(count, "id long, n long")
    return {r[0]: r[1] for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def read_documents(archive: Archive) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids as little-endian 32-bit bytes."""
    folder, shared = archive.folder, archive.table
    document = F.struct("first_id", "n_ids", "doc_id", "start")
    blocks = archive.spans.groupBy("file", "offset", "size").agg(F.collect_list(document).alias("docs"))

    def read(frames):
        table, reader = Table.from_bytes(shared), Reader(folder)
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = decode_block(reader.read(r.file, r.offset, r.size), table)[1]
                docs = pd.DataFrame(list(r.docs))
                raw = [ids[a:a + n].tobytes() for a, n in zip(docs["first_id"], docs["n_ids"])]
                yield pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "start": docs["start"],
                                    "n_tokens": docs["n_ids"], "ids": raw})

    return blocks.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def document_digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes an archive into the shared folder and reads its documents back."""
    spark = docs.sparkSession
    return read_documents(write_archive(docs, new_folder(spark, "token-archive"), **options))
