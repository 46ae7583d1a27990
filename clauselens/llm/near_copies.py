"""Near copies by word shingles: groups joined by links of exact Jaccard similarity.

Two documents are linked if their sets of 5-word shingles have a Jaccard
similarity of 0.8 or more; groups are the connected components.  The search is
exact, not a sketch: shingles stand in one global order, and two sets that are
similar enough share a shingle among the first ``n - ceil(0.8 n) + 1`` of each
(prefix filter), at places that leave room for the overlap they need (positional
filter).  The order puts shingles first that a bounded sample of documents does
not repeat; any order gives the same links, the sample only decides how many
candidates there are.

A document is shingled once: its set's name and first shingles are stored in one
row, once for equal sets of a task.  The first shingles go through one shuffle,
which only lets through those of several sets; shingles that the sample found
common go there in salted parts, whose smallest sets then meet.  Candidates are
compared in two steps.  First every set is compared with the smallest one of
each shingle it shares, which is no more pairs than rows and joins large groups of
copies.  Then pairs of a shingle that are still in different groups are compared,
only those of like size: sets fall in steps of the similarity, and meet those of
their own step and the next; a shingle of many sets goes block against block.  Before texts are fetched, how many shingles a set has
in each of 256 hash buckets bounds what two sets can have in common from above;
candidates that pass are compared whole, from their texts.

Null texts have no words; they and empty ones are copies of each other.  Texts
of fewer words than a shingle are one shingle.  Repeated rows get one result.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import bounded_sample, materialise, source_rows
from clauselens.llm.vptree import SEED
from clauselens.operators.components import components
from clauselens.sources.tables import discard

SHINGLE = 5
SIMILARITY = Fraction(8, 10)
# Documents from which common shingles are taken, and how many of those at most; both only order shingles.
SAMPLE = 16_384
COMMON = 1 << 18
# Sets that a task remembers.
REMEMBERED = 1 << 19
# Parts of a common shingle.
SALTS = 64
# Hash buckets of a set's profile; sets of more shingles than a byte each can count go without one.
BUCKETS, MOST_PROFILED = 256, 255
# Sets of a shingle that are paired by a join, and sets of a block where there are more.
FEW, BLOCK = 32, 1024
# Slots of the filter of keys whose texts are fetched: as many rows are broadcast at most.
SLOTS = 1 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles of one whole text, sorted."""
    from xxhash import xxh64_intdigest

    # As in fingerprints: ASCII case and white space.
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        found = [xxh64_intdigest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.append(0, gaps[:len(words) - shingle] + 1).tolist()
        ends = np.append(gaps[shingle - 1:], len(joined)).tolist()
        found = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def _digest(grams: np.ndarray) -> int:
    """The signed 64-bit name of a set; 0 for the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(grams.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(grams) else 0


def prefix_length(n: int, similarity: Fraction = SIMILARITY) -> int:
    """How many first shingles a set of n must show."""
    return n + 1 + (-n * similarity.numerator) // similarity.denominator if n else 0


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray,
           similarity: Fraction = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first shingles in the global order, rare ones first, then by hash; and how many are not common."""
    rank = np.zeros(len(grams), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, counts[at], 0)
    first = np.lexsort((grams, rank))[:prefix_length(len(grams), similarity)]
    return grams[first], int((rank[first] == 0).sum())


def _common(rows: DataFrame, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in several of the sampled documents, sorted, and in how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                several = [shingles(text, shingle) for text in frame["text"].iloc[at:at + 64].tolist()]
                yield pd.DataFrame({"gram": np.concatenate(several)})

    # What a limit leaves lies in one partition.
    drawn = bounded_sample(rows, "doc_id", sample).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    counts = drawn.mapInPandas(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    counts = materialise(counts, "common-shingles")
    found = bounded_sample(counts, "gram", COMMON).toPandas().sort_values("gram")
    discard(counts)
    return found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _profile(grams: np.ndarray) -> bytes | None:
    """How many shingles lie in each bucket, or nothing if a count needs more than a byte."""
    counts = np.bincount(grams.view(np.uint64) & np.uint64(BUCKETS - 1), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if len(grams) and counts.max() <= MOST_PROFILED else None


def _sets(rows: DataFrame, shingle: int, similarity: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, name, n, rare, first, profile) of every row: its set's name and size, and its first shingles in order.

    The first ``rare`` of them are not among the common ones.  A set that the
    task has met before comes without its shingles and profile.
    """
    order = rows.sparkSession.sparkContext.broadcast(common)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for frame in frames:
            for at in range(0, len(frame), 512):
                part, out = frame.iloc[at:at + 512], []
                for text in part["text"].tolist():
                    grams = shingles(text, shingle)
                    name, first, rare, profile = _digest(grams), None, 0, None
                    if name not in met:
                        first, rare = prefix(grams, *order.value, similarity)
                        profile = _profile(grams)
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(name)
                    out.append((name, len(grams), rare, first, profile))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, **{
                    c: [r[i] for r in out] for i, c in enumerate(("name", "n", "rare", "first", "profile"))}})

    return rows.mapInPandas(run, "doc_id long, name long, n int, rare int, first array<long>, profile binary")


def _possible(similarity: Fraction, n: Column, at: Column, m: Column, place: Column) -> Column:
    """Whether sets of n and m whose first common shingle is at these places can be similar enough."""
    up, down = F.lit(similarity.numerator).cast("long"), F.lit(similarity.denominator).cast("long")
    return (F.least(n - at, m - place) * (up + down) >= (n + m) * up) & (F.least(n, m) * down >= F.greatest(n, m) * up)


def _promising(pairs: DataFrame, profiles: DataFrame, similarity: Fraction) -> DataFrame:
    """The stored pairs (a, b) whose profiles allow for the similarity; ``profiles`` has (name, n, profile) of each set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Only numbers of shingles count where a set has no profile.
            both = np.minimum(frame["left_n"].to_numpy(), frame["right_n"].to_numpy()).astype(np.int64)
            known = np.flatnonzero((frame["left"].notna() & frame["right"].notna()).to_numpy())
            x, y = (np.frombuffer(b"".join(frame[c].iloc[known]), np.uint8).reshape(-1, BUCKETS) for c in ("left", "right"))
            both[known] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            total = frame["left_n"].to_numpy().astype(np.int64) + frame["right_n"].to_numpy()
            yield frame.loc[both * (similarity.numerator + similarity.denominator) >= total * similarity.numerator, ["a", "b"]]

    side = lambda of, to: profiles.select(
        F.col("name").alias(of), F.col("n").alias(f"{to}_n"), F.col("profile").alias(to))
    joined = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return materialise(joined.mapInPandas(run, "a long, b long"), "promising-pairs")


def _texts(rows: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """One (name, text) for every set in the stored pairs; stored."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    able = sets.select("doc_id", "name").join(wanted, "name", "left_semi")
    able = materialise(able.groupBy("name").agg(F.min("doc_id").alias("id")), "candidate-keys")
    # Most texts are not wanted: a filter of bounded size keeps them out of the shuffle.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = able.select(slot("id").alias("slot")).distinct()
    likely = rows.join(F.broadcast(slots), slot("doc_id") == F.col("slot"), "left_semi")
    held = likely.join(able, likely["doc_id"].eqNullSafe(able["id"])).select("name", "text")
    # Rows of one key may differ in text: the one of the set is meant.
    texts = materialise(held.mapInPandas(_of_their_set(shingle), "name long, text string").dropDuplicates(["name"]),
                        "candidate-texts", "zstd")
    discard(able)
    return texts


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, profiles: DataFrame, shingle: int,
              similarity: Fraction) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough; stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def grams(name: int, text: str | None) -> np.ndarray:
            if name not in known:
                if len(known) >= 256:
                    known.clear()
                known[name] = shingles(text, shingle)
            return known[name]

        for frame in frames:
            good = []
            for a, b, left, right in zip(*(frame[c].tolist() for c in ("a", "b", "left", "right"))):
                x, y = grams(a, left), grams(b, right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * (similarity.numerator + similarity.denominator)
                            >= (len(x) + len(y)) * similarity.numerator)
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    every = materialise(pairs, "candidates")
    likely = _promising(every, profiles, similarity)
    texts = _texts(rows, sets, likely, shingle)
    left = likely.join(texts.select(F.col("name").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("name").alias("b"), F.col("text").alias("right")), "b")
    found = materialise(both.mapInPandas(run, "a long, b long"), "similar-pairs")
    discard(every, likely, texts)
    return found


def _shared(sets: DataFrame) -> DataFrame:
    """(gram, name, n, at, lead, hot): first shingles that several sets show, with the smallest set of their part."""
    rows = sets.filter(F.col("first").isNotNull()).select("name", "n", "rare", F.posexplode("first").alias("at", "gram"))
    # One long for size and place: the rows are many.
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    part = F.when(F.col("at") >= F.col("rare"), F.pmod("name", F.lit(SALTS)) + 1).otherwise(F.lit(0))
    rows = rows.select("gram", part.cast("int").alias("part"), "name", packed.alias("packed"))
    group = Window.partitionBy("gram", "part")
    rows = rows.withColumn("lead", F.min(F.struct("name", "packed")).over(group)).withColumn(
        "last", F.max("name").over(group)).filter((F.col("part") > 0) | (F.col("lead.name") < F.col("last")))
    size, place = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)))
    return rows.select("gram", "name", size(F.col("packed")).alias("n"), place(F.col("packed")).alias("at"), F.struct(
        F.col("lead.name").alias("name"), size(F.col("lead.packed")).alias("n"), place(F.col("lead.packed")).alias("at")
    ).alias("lead"), (F.col("part") > 0).alias("hot")).distinct()


def links(rows: DataFrame, sets: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(a, b) links between names of sets that span all groups of similar sets; ``sets`` is stored."""
    shared = materialise(_shared(sets), "shared-shingles")
    # Equal sets of several tasks have equal profiles.
    held = sets.filter(F.col("first").isNotNull()).select("name", "n", "profile").join(
        shared.select("name").distinct(), "name", "left_semi")
    profiles = materialise(held.dropDuplicates(["name"]), "profiles")

    # Every set with the smallest of its part, and the smallest of all parts of a common shingle with each other.
    tops = shared.filter("hot").select("gram", "lead").distinct()
    top = tops.groupBy("gram").agg(F.min("lead").alias("top"))
    parts = tops.join(top, "gram").select("lead.name", "lead.n", "lead.at", F.col("top").alias("lead"))
    near = shared.select("name", "n", "at", "lead").unionByName(parts)
    fits = _possible(similarity, F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"))
    first = _verified(near.filter("name <> lead.name").filter(fits).select(
        F.col("name").alias("a"), F.col("lead.name").alias("b")).distinct(), rows, sets, profiles, shingle, similarity)
    # Parts of one group whose smallest sets differ too much meet through another set of the shingle.
    joined = _rooted(shared, components(first))
    lead = joined.groupBy("gram").agg(F.min(F.struct(F.xxhash64("name", F.lit(1)), "name", "n", "at", "root")).alias("lead"))
    lead = materialise(lead, "shingle-leads")
    fits = _possible(similarity, F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"))
    second = _verified(joined.join(lead, "gram").filter(F.col("root") != F.col("lead.root")).filter(fits).select(
        F.least("name", "lead.name").alias("a"), F.greatest("name", "lead.name").alias("b")).distinct(),
        rows, sets, profiles, shingle, similarity)
    discard(joined, lead)
    some = materialise(first.unionByName(second), "similar-sets")

    joined = _rooted(shared, components(some))
    apart = joined.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"))
    apart = materialise(apart.filter("low < high").select("gram", "m"), "shingles-apart")
    # A little wider than the similarity, so that rounding never puts two similar sizes two steps apart.
    step = F.floor(F.log("n") / F.lit(-1.0001 * math.log(similarity))).cast("int")
    open_ = materialise(joined.join(apart, "gram").withColumn("step", step), "shingles-open")
    rest = _few(open_.filter(F.col("m") <= FEW), similarity).unionByName(
        _blocked(open_.filter(F.col("m") > FEW), profiles, similarity)).distinct()
    found = materialise(some.unionByName(_verified(rest, rows, sets, profiles, shingle, similarity)), "similar-sets")
    discard(shared, profiles, first, second, some, joined, apart, open_)
    return found


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, name, n, at, root) of the shared shingles; a set without links is its own root.  Stored."""
    joined = shared.select("gram", "name", "n", "at").join(roots.withColumnRenamed("node", "name"), "name", "left")
    return materialise(joined.withColumn("root", F.coalesce("root", "name")), "shingle-groups")


def _few(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) of shingles with few sets: a join with so few rows each."""
    x = rows.withColumn("step", F.explode(F.array("step", F.col("step") + 1))).alias("x")
    y = rows.alias("y")
    fits = _possible(similarity, F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
    smaller = F.struct("x.n", "x.name") < F.struct("y.n", "y.name")
    found = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.step") == F.col("y.step")) & smaller
                   & (F.col("x.root") != F.col("y.root")) & fits)
    return found.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))


def _blocked(rows: DataFrame, profiles: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) of shingles with many sets, block against block, by their profiles; only those that may be similar leave a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        up, down = similarity.numerator, similarity.numerator + similarity.denominator
        x, y = frame[frame["side"] == 0], frame[frame["side"] == 1]
        n, at, root, name = (y[c].to_numpy().astype(np.int64) for c in ("n", "at", "root", "name"))
        empty = bytes(BUCKETS)
        known = y["profile"].notna().to_numpy()
        right = np.frombuffer(b"".join(p if p is not None else empty for p in y["profile"]), np.uint8).reshape(-1, BUCKETS)
        a, b = [], []
        for own, size, place, group, profile in zip(*(x[c].tolist() for c in ("name", "n", "at", "root", "profile"))):
            fits = ((size < n) | ((size == n) & (own < name))) & (root != group) & (
                np.minimum(size - place, n - at) * down >= (size + n) * up)
            at_ = np.flatnonzero(fits)
            both = np.minimum(size, n[at_])
            if profile is not None and len(at_):
                sums = np.minimum(right[at_], np.frombuffer(profile, np.uint8)).sum(axis=1, dtype=np.int64)
                both = np.where(known[at_], sums, both)
            good = at_[both * down >= (size + n[at_]) * up]
            a += [own] * len(good)
            b += name[good].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    held = rows.join(profiles.select("name", "profile"), "name")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own, other = F.pmod("name", blocks), F.explode(F.sequence(F.lit(0), blocks - 1))
    columns = ("gram", "name", "n", "at", "root", "profile")
    x = held.select(*columns, F.lit(0).alias("side"), F.explode(F.array("step", F.col("step") + 1)).alias("step"),
                    own.cast("int").alias("bx"), blocks.alias("blocks"))
    x = x.select(*columns, "side", "step", "bx", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("by"))
    y = held.select(*columns, F.lit(1).alias("side"), "step", other.alias("bx"), own.cast("int").alias("by"))
    return x.unionByName(y).groupBy("gram", "step", "bx", "by").applyInPandas(run, "a long, b long")


def _of_their_set(shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [_digest(shingles(t, shingle)) for t in frame["text"].tolist()]
            yield frame[np.array(own, np.int64) == frame["name"].to_numpy()]

    return run


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                similarity: Fraction = SIMILARITY, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id reachable over links."""
    rows = source_rows(docs, key, text)
    sets = materialise(_sets(rows, shingle, similarity, _common(rows, shingle, sample)), "sets")
    first = materialise(sets.groupBy("name").agg(F.min("doc_id").alias("first_id")), "distinct-sets")
    found = components(links(rows, sets, shingle, similarity))
    grouped = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    member = first.join(grouped, first["name"] == grouped["node"]).select("name", "root", "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = member.join(least, "root").select("name", "component_id")
    named = first.join(moved, "name", "left").select(
        "name", F.coalesce("component_id", "first_id").alias("component_id"))
    # Stored, so that the join's sides are plain shuffles and a hot name can be split.
    named = materialise(named, "set-groups")
    discard(first)
    return sets.join(named, "name").select("doc_id", "component_id")
