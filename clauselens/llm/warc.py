"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress alone; a bundle ends with a seek
table, a skippable frame with the compressed and raw size of every frame before
it, so any reader of plain Zstandard can read the whole and a seeking one can
jump.  A stored index maps every record identifier to its bundle, frame and
offset in the raw frame.

Of pages with equal payloads, that with the largest key is written as a response
and the others as revisits that name it; this is found by one grouping on the
digest before anything is written.  A revisit keeps the payload's length among
its HTTP header lines and its digest in the record header.

Null html counts as empty; empty payloads are equal to each other.  Pages with a
null key are written under the identifier ``none`` and stand behind all others
of their group.  Repeated rows (equal key and payload) are records of one
identifier; one of them is the response.  An empty table gives no bundles.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import materialise
from clauselens.llm.stores import Reader, Writer, new_folder

# Raw bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME = 1 << 20
BUNDLE = 1 << 28
LEVEL = 3
DATE = "2025-01-01T00:00:00Z"

# Fixed values of the two formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = "<urn:page:{}>"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -----------------------------------------------------------------


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit of that page."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID.format('none' if page is None else page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    """A header value stays on its line."""
    return " ".join((url or "").split())


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header lines by lower-case name, block, place after the record)."""
    end = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    start = end + 4
    stop = start + int(head["content-length"])
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return head, raw[start:stop], stop + 4


def read_page(head: dict[str, str], block: bytes) -> dict:
    """What one record says of its page; a response's digest is computed from its payload."""
    lines, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in lines.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response":
        if digest32(payload) != digest or len(payload) != size:
            raise ValueError("a payload does not match its record")
    return {"page_id": _page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": size,
            "payload_digest": digest, "record_type": kind,
            "refers_to": _page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "payload": payload if kind == "response" else None}


def _page_of(identifier: str) -> int | None:
    name = identifier.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


# --- bundles -----------------------------------------------------------------


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed size, raw size) of every frame."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(reader: Reader, name: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of every frame, from the end of a bundle."""
    size = reader.size(name)
    n, _, magic = struct.unpack("<IBI", reader.read(name, size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    raw = reader.read(name, size - 9 - 8 * n, 8 * n)
    found, at = [], 0
    for packed, whole in struct.iter_unpack("<II", raw):
        found.append((at, packed, whole))
        at += packed
    return found


def read_frame(reader: Reader, name: str, at: int, size: int, whole: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(reader.read(name, at, size), max_output_size=whole)


@dataclass(frozen=True)
class Bundles:
    """Where bundles are, and the index of their records."""

    folder: str
    index: DataFrame  # page_id, bundle, frame, offset, length


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to) of every row; refers_to is null for responses."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Rows without a key may be the only ones of their group: then none is a revisit.
    last = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    # Stored, so that the join's sides are a scan and a plain shuffle, of which Spark can split a hot payload, or
    # a broadcast where the copies are few: only payloads with copies have a row here.
    last = materialise(last.filter("copies > 1 AND last IS NOT NULL").select(F.col("sha").alias("of_sha"), "last"),
                       "repeated-payloads")
    found = rows.join(last, F.col("sha") == F.col("of_sha"), "left")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return found.select("page_id", "url", "payload", F.when(other, F.col("last")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                  frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL) -> Bundles:
    """Writes all pages; every task writes bundles of its own."""
    rows = with_revisits(pages, key, url, html)

    def write(frames):
        shrink = zstandard.ZstdCompressor(level=level)
        out, raw, sizes, index = None, bytearray(), [], []

        def close_frame() -> pd.DataFrame:
            nonlocal index
            packed = shrink.compress(bytes(raw))
            out.write(packed)
            sizes.append((len(packed), len(raw)))
            raw.clear()
            done = pd.DataFrame(index, columns=["page_id", "frame", "offset", "length"]).astype({"page_id": "Int64"})
            index = []
            return done.assign(bundle=out.name)[["page_id", "bundle", "frame", "offset", "length"]]

        def close_bundle() -> None:
            nonlocal out, sizes
            out.write(seek_table(sizes))
            out.close()
            out, sizes = None, []

        for pages in frames:
            pages = pages.astype({"page_id": "Int64", "refers_to": "Int64"})
            for page, address, payload, to in zip(pages["page_id"], pages["url"], pages["payload"], pages["refers_to"]):
                if out is None:
                    out = Writer(folder, ".warc.zst")
                made = record(None if page is pd.NA else int(page), address, payload, digest32(payload),
                              None if to is pd.NA else int(to))
                index.append((page, len(sizes), len(raw), len(made)))
                raw += made
                if len(raw) >= frame:
                    yield close_frame()
                    if out.at >= bundle:
                        close_bundle()
        if out is not None:
            if raw:
                yield close_frame()
            close_bundle()

    index = rows.mapInPandas(write, "page_id long, bundle string, frame int, offset long, length long")
    return Bundles(folder, materialise(index, "warc-index"))


def read_bundles(bundles: Bundles) -> DataFrame:
    """Every record of the bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Frames are read alone, through the bundle's own seek table.
    """
    folder = bundles.folder
    frames = bundles.index.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("records"))

    def read(parts):
        reader, tables = Reader(folder), {}
        for part in parts:
            for r in part.sort_values(["bundle", "frame"]).itertuples(index=False):
                if r.bundle not in tables:
                    tables = {r.bundle: read_seek_table(reader, r.bundle)}
                raw, rows, place = read_frame(reader, r.bundle, *tables[r.bundle][r.frame]), [], 0
                while place < len(raw):
                    head, block, place = parse_record(raw, place)
                    rows.append(read_page(head, block))
                if len(rows) != r.records:
                    raise ValueError("a frame does not hold the records that the index says")
                yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    return frames.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long, payload binary")


def read_records(bundles: Bundles, keys: DataFrame) -> DataFrame:
    """The records of some pages (column page_id), each by its frame and its offset there."""
    folder = bundles.folder
    wanted = bundles.index.join(keys.select("page_id").distinct(), "page_id")

    def read(parts):
        reader, tables, last, raw = Reader(folder), {}, None, b""
        for part in parts:
            for r in part.sort_values(["bundle", "frame", "offset"]).itertuples(index=False):
                if r.bundle not in tables:
                    tables = {r.bundle: read_seek_table(reader, r.bundle)}
                if last != (r.bundle, r.frame):
                    last, raw = (r.bundle, r.frame), read_frame(reader, r.bundle, *tables[r.bundle][r.frame])
                head, block, _ = parse_record(raw, r.offset)
                yield pd.DataFrame([read_page(head, block)]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return wanted.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes bundles into the shared folder and reads their records back."""
    return read_bundles(write_bundles(pages, new_folder(pages.sparkSession, "warc-bundles"), **options))
