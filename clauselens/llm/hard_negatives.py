"""Hard negatives by rotated one-bit codes with exact residual intervals.

Vectors become whole numbers, floor(256 x).  Every vector v is turned by one fixed
random rotation and kept as the signs of its turned components: the code c, a unit
vector of +-1/sqrt(d).  Stored with it are the alignment a = <v, c> and the length
of what is left, |v - a c|.  A query q is turned too and its components are cut
to whole steps of a fixed grid, so that <q, c> comes from popcounts of bit planes.
Then <q, v> = a <q, c> + <q - <q, c> c, v - a c>, and by Cauchy and Schwarz the
second term lies within the product of both lengths; what the grid cut off is
bounded the same way.  That interval is certain, not likely: rows whose interval misses what is
asked for are passed over, all others are scored as whole numbers.  The result
is exact for any rotation.

The anchors are the query set: they go over all rows in chunks of bounded size,
which are broadcast one after another.  A pass first draws thresholds from a
bounded pilot of rows; a task then keeps the best rows per anchor, so only a few
rows per anchor and task are shuffled.

A row without a key, a label or a vector takes no part, nor one with a null, NaN or
infinite component.  Of rows of one key one takes part, that of the least label,
then vector.  Missing components of shorter vectors count as zero; empty vectors
score zero.  Components beyond 2^26 after scaling count as 2^26.  Ties go to the
smaller key.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import bounded_sample, materialise

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
LARGEST = 1 << 26
# Anchors of a pass (a few MB broadcast), pilot rows, and rows compared at once.
CHUNK = 2048
PILOT = 8192
ROWS = 1024
# Bits of a query's component on the grid.
GRID_BITS = 7
SEED = 42


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds whole numbers."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall(
        "x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    v = F.transform("x", lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), c * float(SCALE))))
    v = F.transform(v, lambda c: F.floor(c).cast("int"))
    best = rows.select("vec_id", F.struct("label", v.alias("v")).alias("row")).groupBy("vec_id").agg(
        F.min("row").alias("row"))
    return best.select("vec_id", "row.label", "row.v")


# --- codes -------------------------------------------------------------------


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions, as float64."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), bool)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def matrix(vectors, d: int) -> np.ndarray:
    """Vectors as rows of d whole numbers, short ones filled up with zeros."""
    if len(vectors) and all(len(v) == d for v in vectors):
        return np.stack(vectors).astype(np.int64)
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def codes(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits, alignment with the code, length of the rest) of every row."""
    turned = v @ turn.T
    align = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
    rest = np.sqrt(np.maximum((turned ** 2).sum(axis=1) - align ** 2, 0))
    return _packed(turned > 0), align, rest


class Queries:
    """Anchors with their turned components on a grid, as bit planes."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, bits: int = GRID_BITS):
        turned, top = v @ turn.T, 2 ** bits - 1
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-9)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        self.planes = [_packed((level >> j & 1) > 0) for j in range(bits)]
        self.level_sum = level.sum(axis=1)
        grid = self.low[:, None] + self.step[:, None] * level
        self.grid_square, self.square = (grid ** 2).sum(axis=1), (turned ** 2).sum(axis=1)
        self.cut = np.sqrt(((turned - grid) ** 2).sum(axis=1))
        self.d = v.shape[1]

    def intervals(self, bits: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Certain bounds of all inner products, (rows, anchors)."""
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # At most 2^bits * d, which 32 bits hold.
        hit = np.zeros((len(bits), len(self.low)), np.uint32)
        for j, plane in enumerate(self.planes):
            for w in range(bits.shape[1]):
                hit += np.bitwise_count(bits[:, w, None] & plane[None, :, w]) * np.uint32(1 << j)
        hit = hit.astype(np.float64)
        # <grid point, code>: components are low + step * level, code components +-1/sqrt(d).
        on_code = (self.low * (2 * ones - self.d)[:, None] + self.step * (2 * hit - self.level_sum)) / np.sqrt(self.d)
        middle = align[:, None] * on_code
        beside = np.sqrt(np.maximum(self.grid_square - on_code ** 2, 0)) * rest[:, None]
        length = np.sqrt(align ** 2 + rest ** 2)
        # What the grid cut off, and room for the rounding of floating point.
        slack = beside + length[:, None] * (self.cut + 1e-9 * np.sqrt(self.square)) + 1e-6
        return middle - slack, middle + slack


# --- passes over all rows ----------------------------------------------------


def _score(v: np.ndarray, anchors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact inner products of the given pairs."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 17):
        to = slice(at, at + (1 << 17))
        out[to] = np.einsum("ij,ij->i", v[rows[to]], anchors[cols[to]])
    return out


def _best(frame: pd.DataFrame, group: list[str], k: int) -> pd.DataFrame:
    """The k highest scores of each group, ties by the smaller key."""
    frame = frame.sort_values([*group, "score", "vec_id"], ascending=[True] * len(group) + [False, True])
    return frame[frame.groupby(group).cumcount() < k]


def _pass(rows: DataFrame, d: int, anchors: pd.DataFrame, wanted: Callable, group: list[str], k: int) -> DataFrame:
    """(*group, vec_id, score): the best ``k`` of each group that each task has met, over stored ``rows``.

    ``wanted(anchors, low, high, labels, keys, floors)`` gives the mask of pairs that may count by their
    intervals, and for each column of groups its name and the scores' test; ``floors`` holds the
    least score of every group that is full.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, turn = sent.value, rotation(d)
        points, names = matrix(own["v"].tolist(), d), own["vec_id"].to_numpy()
        queries, kept = Queries(points, turn), None
        floors: dict = {}
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at:at + ROWS]
                v, keys = matrix(part["v"].tolist(), d), part["vec_id"].to_numpy()
                may, tests = wanted(own, *queries.intervals(*codes(v, turn)), part["label"].to_numpy(), keys, floors)
                i, j = np.nonzero(may)
                # Each surviving pair is scored once, whatever number of groups it may belong to.
                score, found = _score(v, points, i, j), []
                for columns, test in tests:
                    good = np.flatnonzero(test(score, j))
                    if len(good):
                        found.append(pd.DataFrame({
                            "anchor_id": names[j[good]], **{c: x[j[good]] for c, x in columns.items()},
                            "vec_id": keys[i[good]], "score": score[good]}))
                if not found:
                    continue
                met = pd.concat(found if kept is None else [kept, *found])
                kept = _best(met, group, k)
                full = kept[kept.groupby(group).cumcount() == k - 1]
                floors = dict(zip(full[group].itertuples(index=False, name=None), full["score"]))
        if kept is not None:
            yield kept[[*group, "vec_id", "score"]]

    columns = ", ".join(f"{g} long" for g in group)
    return rows.mapInPandas(run, f"{columns}, vec_id long, score long")


def _ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(most: int) -> Callable:
    def wanted(own, low, high, labels, keys, floors):
        floor = np.array([floors.get((a,), f) for a, f in zip(own["vec_id"].tolist(), own["floor"].tolist())])
        may = (high >= floor) & (labels[:, None] == own["label"].to_numpy()) & (keys[:, None] != own["vec_id"].to_numpy())
        return may, [({}, lambda score, j: score >= floor[j])]

    return wanted


_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _negatives(low_share: int, high_share: int) -> Callable:
    def wanted(own, low, high, labels, keys, floors):
        names = own["vec_id"].tolist()
        least, most, tests = np.full(len(own), _HIGHEST), np.full(len(own), _LOWEST), []
        for n in range(max((len(p) for p in own["positives"]), default=0)):
            # An anchor without an nth positive asks for nothing: its range is empty.
            who, floor, top = np.full(len(own), -1), np.full(len(own), _HIGHEST), np.full(len(own), _LOWEST)
            for i, (p, s, f) in enumerate(zip(own["positives"], own["scores"], own["floors"])):
                if n < len(p):
                    full = floors.get((names[i], p[n]), _LOWEST)
                    start = f[n] if n < len(f) and f[n] is not None else _LOWEST
                    who[i], floor[i], top[i] = p[n], max(-(-low_share * s[n] // 100), start, full), high_share * s[n] // 100
            least, most = np.minimum(least, floor), np.maximum(most, top)
            tests.append(({"positive_id": who}, lambda score, j, a=floor, b=top: (score >= a[j]) & (score <= b[j])))
        may = (high >= least) & (low <= most) & (labels[:, None] != own["label"].to_numpy())
        return may, tests

    return wanted


def _chunks(rows: DataFrame, chunk: int) -> Iterator[DataFrame]:
    """The rows in pieces of about ``chunk``, by a hash of the key; stored rows."""
    parts = -(-rows.count() // chunk)
    for part in range(parts):
        yield rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)


def mine(df: DataFrame, is_anchor: Column, new_label: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, pilot: int = PILOT,
         key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``is_anchor`` and ``new_label`` are conditions on ``vec_id`` and ``label``.
    """
    rows = whole_vectors(df, key, vector, label)
    if new_label is not None:
        rows = rows.withColumn("label", new_label.cast("int"))
    rows = materialise(rows, "whole-vectors", "zstd")
    d = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    anchors = materialise(rows.filter(is_anchor), "anchors")
    few = materialise(bounded_sample(rows, "vec_id", pilot).repartition(rows.rdd.getNumPartitions()), "pilot")
    results = []
    for part in _chunks(anchors, chunk):
        # At most about ``chunk`` anchors with their vectors.
        own = part.toPandas().sort_values("vec_id", ignore_index=True)
        if own.empty:
            continue
        lowest = np.iinfo(np.int64).min
        own["floor"] = lowest
        first = _ranked(_pass(few, d, own, _positives(positives), ["anchor_id"], positives), ["anchor_id"], positives)
        starts = {r["anchor_id"]: r["score"] for r in first.filter(F.col("rank") == positives).collect()}
        own["floor"] = [starts.get(a, lowest) for a in own["vec_id"].tolist()]
        found = materialise(_ranked(
            _pass(rows, d, own, _positives(positives), ["anchor_id"], positives), ["anchor_id"], positives), "positives")
        # At most ``positives`` rows for each anchor of the chunk.
        best = found.orderBy("anchor_id", "rank").toPandas().groupby("anchor_id").agg(list)
        own["positives"] = [best["vec_id"].get(a, []) for a in own["vec_id"].tolist()]
        own["scores"] = [best["score"].get(a, []) for a in own["vec_id"].tolist()]
        own["floors"] = [[] for _ in range(len(own))]
        group = ["anchor_id", "positive_id"]
        first = _ranked(_pass(few, d, own, _negatives(low, high), group, negatives), group, negatives)
        starts = {(r["anchor_id"], r["positive_id"]): r["score"] for r in first.filter(F.col("rank") == negatives).collect()}
        own["floors"] = [[starts.get((a, p)) for p in ps] for a, ps in zip(own["vec_id"].tolist(), own["positives"])]
        met = _ranked(_pass(rows, d, own, _negatives(low, high), group, negatives), group, negatives)
        scores = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        results.append(materialise(met.join(scores, group).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    if not results:
        return df.sparkSession.createDataFrame([], (
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
