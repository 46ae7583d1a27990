"""SimHash near-duplicates by vantage-point trees.

Every document gets a 64-bit fingerprint: bit b is one if it is one in over half
of its shingles' XXH64 values.  Equal fingerprints collapse first.  A tree of
vantage points, drawn from a bounded sample, then cuts the different
fingerprints into shards: at a node with vantage point v and radius r, those
with distance d(x, v) <= r go inside, the others outside.  By the triangle
inequality two fingerprints at most k apart can lie on both sides only if the
outer one has d <= r + k, so just those outer ones are copied to the inside.
Every pair at most k apart thus meets in one shard, whatever the sample was; the
sample only decides how even the shards are.  Shards go on with the same rule in
memory, down to small leaves that are compared in full.  A leaf yields one link
per fingerprint, to the smallest one of its group there, so groups of any size
yield no more links than members.  Links are joined into components by rounds of
small stars on small rows.

Null texts have no words and fingerprint zero, like empty ones.  A repeated row
gets the result of the first.  A null key is never the smallest if another is
there.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import bounded_sample, keep_rows, materialise, source_rows
from clauselens.operators.components import components

SHINGLE = 3
RADIUS = 2
# Fingerprints from which vantage points and radii are drawn.
SAMPLE = 32_768
# Fingerprints a shard should hold, and those that are compared without a tree.
SHARD = 4_096
LEAF = 256
SEED = 42


# --- fingerprints ------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six white-space bytes.
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.append(0, gaps[:len(words) - shingle] + 1).tolist()
        ends = np.append(gaps[shingle - 1:], len(joined)).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([fingerprint(t, shingle) for t in frame["text"].tolist()], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "fp": found.view(np.int64)})

    return source_rows(docs, key, text).mapInPandas(run, "doc_id long, fp long")


# --- the tree ----------------------------------------------------------------


def _distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v)


class Node:
    """Vantage point and radius; leaves have a shard number alone."""

    __slots__ = ("vantage", "radius", "inside", "outside", "shard")

    def __init__(self, vantage=None, radius=None, inside=None, outside=None, shard=None):
        self.vantage, self.radius, self.inside, self.outside, self.shard = vantage, radius, inside, outside, shard


def split(x: np.ndarray, k: int, vantage) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Radius, and masks of what goes inside and outside, or None if this point separates too little."""
    d = _distance(x, vantage)
    radius = int(np.median(d))
    inside, outside = d <= radius + k, d > radius
    if max(inside.sum(), outside.sum()) > 0.9 * len(x):
        return None
    return radius, inside, outside


def grow(sample: np.ndarray, leaves: int, k: int, rng: np.random.Generator) -> Node:
    """A tree of about ``leaves`` shards over a sample."""
    shards = iter(range(1 << 30))

    def build(x: np.ndarray, left: int) -> Node:
        if left > 1 and len(x) > 8:
            for _ in range(8):
                vantage = x[rng.integers(len(x))]
                if (cut := split(x, k, vantage)) is not None:
                    radius, inside, outside = cut
                    return Node(vantage, radius, build(x[inside], left // 2), build(x[outside], left - left // 2))
        return Node(shard=next(shards))

    return build(sample, leaves)


def route(node: Node, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in x) for all shards that x reaches."""
    stack = [(node, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if len(at) == 0:
            continue
        if node.shard is not None:
            yield node.shard, at
            continue
        d = _distance(x[at], node.vantage)
        stack.append((node.inside, at[d <= node.radius + k]))
        stack.append((node.outside, at[d > node.radius]))


def near_pairs(x: np.ndarray, k: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs at most k apart, leaf by leaf; a pair may come up again."""
    stack = [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) > LEAF:
            for _ in range(8):
                if (cut := split(x[at], k, x[at[rng.integers(len(at))]])) is not None:
                    stack += [at[cut[1]], at[cut[2]]]
                    break
            else:
                yield from _compare(x, at, k)
            continue
        yield from _compare(x, at, k)


def _compare(x: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = x[at]
    for i in range(0, len(at), LEAF):
        d = np.bitwise_count(own[i:i + LEAF, None] ^ own[None, i:])
        a, b = np.nonzero(d <= k)
        keep = a < b
        yield at[i + a[keep]], at[i + b[keep]]


def spanning_links(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest of its group here) for members that are not the smallest."""
    parent = np.arange(len(x))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in near_pairs(x, k, np.random.default_rng(SEED)):
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(x))], dtype=np.int64)
    moved = np.flatnonzero(roots != np.arange(len(x)))
    return x[moved], x[roots[moved]]


def near_links(distinct: DataFrame, k: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b) links that span all groups of different fingerprints (column fp) at most k apart."""
    spark = distinct.sparkSession
    n = distinct.count()
    drawn = sorted(r[0] for r in bounded_sample(distinct.select("fp"), "fp", sample).collect())
    points = np.array(drawn, dtype=np.int64).view(np.uint64)
    leaves = max(1, min(-(-n // shard), sample // 16))
    tree = spark.sparkContext.broadcast(grow(points, leaves, k, np.random.default_rng(SEED)))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame["fp"].to_numpy().view(np.uint64)
            for to, at in route(tree.value, x, k):
                yield pd.DataFrame({"shard": np.full(len(at), to, np.int32), "fp": x[at].view(np.int64)})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(np.unique(frame["fp"].to_numpy().view(np.uint64)), k)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInPandas(send, "shard int, fp long")
    return sent.groupBy("shard").applyInPandas(search, "a long, b long")


# --- groups ------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, k: int = RADIUS,
    sample: int = SAMPLE, shard: int = SHARD,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links."""
    marked = materialise(fingerprints(docs, key, text, shingle), "fingerprints")
    first = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(near_links(first, k, sample, shard))
    # A group's smallest doc_id, over all its fingerprints, its root included.
    grouped = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    member = first.join(grouped, first["fp"] == grouped["node"]).select("fp", "root", "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = member.join(least, "root").select("fp", "component_id")
    named = first.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # Stored, so that the join's sides are plain shuffles and a hot fingerprint can be split.
    named = materialise(named, "fingerprint-names")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _united(*groups: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the groups that overlapping groups of the same rows make up together."""
    first, *others = groups
    links = first.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    for g in others:
        links = links.unionByName(g.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    found = components(links)
    return first.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", also=None, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group: its smallest key, once.

    Groups are those of ``near_duplicates``.  ``also`` names further groups of the
    rows, in the same form; groups that share a row are then one.
    Equal texts under one key count once; different texts under one key stay
    together.  Rows without a key stand behind all others of their group; among
    themselves a hash of the text decides.
    """
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), nameless).alias("id"),
                        F.col(text).alias("body"), F.xxhash64(text).alias("digest"))
    found = near_duplicates(named, "id", "body", **options)
    if also is not None:
        found = _united(found, also(named, "id", "body"))
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    return keep_rows(named.drop("body"), "id", stay, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
