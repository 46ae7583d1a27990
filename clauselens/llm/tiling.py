"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case.  Every run of ``match``
words of a test item is a seed; documents are joined with the seeds on the
hash of such a run (an item with fewer words is one seed as a whole).  A pair of
document and item that shares seeds goes on with the places of these seeds
alone: equal substrings of at least ``match`` words are exactly the runs of
seeds that follow each other in both texts.

On each pair, greedy string tiling marks the longest match whose words are still
unmarked in both, again and again, down to ``match`` words.  Matches of a length
are found by running Karp-Rabin: a rolling hash over the seeds in the item fills
a table, the one over the document looks it up, and hits are compared.  Tiles
may stand in any order, so moved passages still count.  The share of the item's
words under tiles is its coverage; a document is contaminated by every item
whose coverage reaches the threshold.

Null and empty texts, of documents or items, share nothing.  Repeated rows of a
key count as one document (their seeds are pooled when texts differ).  Rows with
a null key have their matches pooled under null.  Empty tables give no rows.
Other columns are ignored, or kept whole by ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import compute_once, keep_rows, materialise

MATCH = 5
COVERAGE = 0.8
# Seeds up to this many rows (40 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_SEEDS = 500_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _runs(words: str, size: int) -> Column:
    """Hash of every run of ``size`` words, by place; null where no whole run begins."""
    last = F.size(words) - size
    return F.transform(words, lambda w, i: F.when(
        i <= last, F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)])))


def item_seeds(items: DataFrame, key: str = "item_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """(item_id, n_words, size, seed, places): places of each different seed in its item."""
    df = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    df = compute_once(df, _words=_words(F.col("text"))).filter(F.size("_words") > 0)
    # Of items that share a key, each row is tiled; equal rows are one.
    df = df.select("item_id", "_words").dropDuplicates()
    out = None
    for size in range(match, 0, -1):
        part = df.filter(F.size("_words") >= match) if size == match else df.filter(F.size("_words") == size)
        part = part.select("item_id", F.size("_words").alias("n_words"), F.lit(size).alias("size"),
                           F.posexplode(_runs("_words", size)).alias("place", "seed"))
        out = part if out is None else out.unionByName(part)
    return out.filter("seed IS NOT NULL").groupBy("item_id", "n_words", "size", "seed").agg(
        F.array_sort(F.collect_list("place")).alias("places"))


def shared_seeds(docs: DataFrame, seeds: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, item_id, n_words, size, place, seed) of all seeds that documents share with items."""
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most ``match`` numbers
    small = seeds.select("seed", "size", "item_id", "n_words")
    if small.count() <= BROADCAST_SEEDS:
        small = F.broadcast(small)
    df = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    df = compute_once(df, _words=_words(F.col("text"))).drop("text")
    out = None
    for size in sizes or [MATCH]:
        part = df.select("doc_id", F.posexplode(_runs("_words", size)).alias("place", "seed"))
        part = part.filter("seed IS NOT NULL").join(small.filter(F.col("size") == size), "seed")
        out = part if out is None else out.unionByName(part)
    return out


def tiles(doc_places: np.ndarray, doc_seeds: np.ndarray, item_seeds_at: np.ndarray, item_places: np.ndarray,
          match: int) -> list[tuple[int, int, int]]:
    """(place in document, place in item, words): the tiles of one pair.

    Each side is a list of places with the seed that begins there; a seed spans
    ``match`` words.
    """
    d_seed = dict(zip(doc_places.tolist(), doc_seeds.tolist()))
    t_seed = dict(zip(item_places.tolist(), item_seeds_at.tolist()))
    d_marked: set[int] = set()
    t_marked: set[int] = set()
    base, mod = 1_000_003, (1 << 61) - 1

    def free_runs(seed_at: dict[int, int], marked: set[int]):
        """Stretches of consecutive seeds none of whose words is marked."""
        run: list[int] = []
        for p in sorted(seed_at):
            if any(q in marked for q in range(p, p + match)):
                continue
            if run and p != run[-1] + 1:
                yield run
                run = []
            run.append(p)
        if run:
            yield run

    def rolling(run: list[int], seed_at: dict[int, int], n: int):
        """(first place, hash) of every window of n seeds of a stretch."""
        if len(run) < n:
            return
        top, h = pow(base, n - 1, mod), 0
        for i, p in enumerate(run):
            if i >= n:
                h = (h - seed_at[run[i - n]] * top) % mod
            h = (h * base + seed_at[p]) % mod
            if i >= n - 1:
                yield run[i - n + 1], h

    def matches(n: int):
        """Pairs of places where n seeds agree, in document order."""
        table: dict[int, list[int]] = {}
        for run in free_runs(t_seed, t_marked):
            for p, h in rolling(run, t_seed, n):
                table.setdefault(h, []).append(p)
        for run in free_runs(d_seed, d_marked):
            for p, h in rolling(run, d_seed, n):
                for q in table.get(h, ()):
                    if all(d_seed[p + k] == t_seed[q + k] for k in range(n)):
                        yield p, q

    found: list[tuple[int, int, int]] = []
    longest = max((len(r) for r in free_runs(t_seed, t_marked)), default=0)
    # Halve the search length until something matches, then go down from the longest match.
    n = longest
    while n >= 1:
        hits = sorted(matches(n))
        if not hits:
            n = n // 2 if not found and n > 1 else n - 1
            if n < 1:
                break
            continue
        if not found:
            # A match of n seeds may be part of a longer one: start at the longest.
            while more := sorted(matches(n + 1)):
                n, hits = n + 1, more
        size = n + match - 1
        for p, q in hits:
            if not any(x in d_marked for x in range(p, p + size)) and not any(
                    x in t_marked for x in range(q, q + size)):
                d_marked.update(range(p, p + size))
                t_marked.update(range(q, q + size))
                found.append((p, q, size))
        n -= 1
    return found


def tile_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", match: int = MATCH) -> DataFrame:
    """(doc_id, item_id, n_words, n_tiles, covered, coverage) of every pair that shares a seed."""
    seeds = materialise(item_seeds(items, item_key, item_text, match), "item-seeds")
    shared = shared_seeds(docs, seeds, key, text).select("doc_id", "item_id", "n_words", "size", "place", "seed")
    pairs = shared.groupBy("doc_id", "item_id", "n_words", "size").agg(
        F.array_sort(F.collect_set(F.struct("place", "seed"))).alias("hits"))
    own = seeds.groupBy("item_id", "n_words", "size").agg(
        F.collect_list(F.struct("seed", "places")).alias("own"))
    both = pairs.join(own, pairs["item_id"].eqNullSafe(own["item_id"]) & (pairs["n_words"] == own["n_words"])
                      & (pairs["size"] == own["size"])).select(
        "doc_id", pairs["item_id"], pairs["n_words"], pairs["size"],
        F.col("hits.place").alias("place"), F.col("hits.seed").alias("seed"),
        F.col("own.seed").alias("own_seed"), F.col("own.places").alias("own_places"))

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                lengths = [len(p) for p in r.own_places]
                found = tiles(np.asarray(r.place), np.asarray(r.seed),
                              np.repeat(np.asarray(r.own_seed), lengths), np.concatenate(r.own_places), r.size)
                rows.append((r.doc_id, r.item_id, r.n_words, len(found), sum(t[2] for t in found)))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_tiles", "covered"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    done = both.mapInPandas(run, "doc_id long, item_id long, n_words long, n_tiles long, covered long")
    return done.withColumn("coverage", F.round(F.col("covered") / F.col("n_words"), 6))


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """The pairs whose coverage reaches the threshold."""
    return tile_pairs(docs, items, **options).filter(F.col("covered") >= F.col("n_words") * F.lit(coverage))


def keep_clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, key: str = "doc_id",
               text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    bad = contaminated(docs, items, coverage, key=key, text=text, **options).select("doc_id").distinct()
    return keep_rows(docs, key, materialise(bad, "contaminated"), "left_anti")
