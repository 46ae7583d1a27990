"""Nearest neighbours by cosine distance (V1, V2)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.functions.once import compute_once
from clauselens.sources import tables

# More query vectors than this are spread over tasks instead of being broadcast.
BROADCAST_QUERIES = 2000
_GRID = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per query.  The rank filter cuts each task down to k rows
    per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "vec_id", "distance", "rank")
    )


def _units(df: DataFrame, key: str, out: str, partition: str | None) -> DataFrame:
    extra = [F.col(partition).alias("_part")] if partition else []
    return df.select(F.col(key).alias(out), unit(F.col("embedding")).alias(f"_{out}"), *extra)


def cosine_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 1, partition: str | None = None
) -> DataFrame:
    """V1: (query_id, vec_id, distance, rank), exact.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding.
    With ``partition`` only vectors that agree with the query in that column
    count.  A checked, small set of queries is broadcast and the vectors are
    passed over once.  A larger set is met block by block: every vector goes to
    one block, every query to all blocks.
    """
    v = _units(vectors, "vec_id", "vec_id", partition)
    q = _units(queries, "query_id", "query_id", partition)
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        on = ["_part"] if partition else ["_block"]
        if not partition:
            v, q = v.withColumn("_block", F.lit(0)), q.withColumn("_block", F.lit(0))
        q = F.broadcast(q)
    else:
        on = ["_part", "_block"] if partition else ["_block"]
        v = v.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(_GRID)))
        blocks = F.sequence(F.lit(0).cast("long"), F.lit(_GRID - 1).cast("long"))
        q = q.withColumn("_block", F.explode(blocks))
    pairs = v.join(q, on).select(
        "query_id", "vec_id", (1.0 - dot(F.col("_vec_id"), F.col("_query_id"))).alias("distance"))
    return _top(pairs, k)


def _directed(df: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not null, empty or zero, every number finite."""
    length = norm(F.col("embedding"))
    return df.filter((length > 0) & (length < F.lit(float("inf"))))


def _cell_centers(units: DataFrame, cells: int):
    """Up to ``cells`` different unit vectors of a bounded sample (32 rows a cell, by hash of the id).

    The search is exact for any centers; they only decide how much is compared.
    """
    sample = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(32 * cells).collect()
    return list(dict.fromkeys(tuple(r["_vec_id"]) for r in sample))[:cells]


def _cells(rows) -> Column:
    """Cells as a constant: few rows, whatever the input."""
    schema = "array<struct<cell:int,u:array<double>,n:bigint,radius:double,blocks:int>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _by_distance(of: Column, cells: Column) -> Column:
    """The cells with the Euclidean distance of a unit vector to their centers, nearest first."""
    away = lambda c: F.sqrt(F.greatest(2.0 - 2.0 * dot(of, c["u"]), F.lit(0.0)))
    return F.array_sort(F.transform(
        cells, lambda c: F.struct(away(c).alias("d"), c["cell"], c["n"], c["radius"], c["blocks"])))


# Products that are held at a time, and how far matrix products may lie from sums in order.
_PRODUCTS, _ROUNDING = 1 << 23, 1e-9


def _nearest_of(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest vectors (vec_id, _vec_id) of every query (query_id, _query_id) of a block.

    A matrix product finds all that may be among them; their distances are then
    summed up in the order of the components, as ``dot`` does, so that equal vectors tie.
    """
    ids, queries, found = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), []
    if len(ids) and len(queries):
        v, q = np.stack(left["_vec_id"].to_numpy()), np.stack(right["_query_id"].to_numpy())
        step = max(1, _PRODUCTS // len(ids))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            close = part @ v.T
            least = np.partition(close, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(part), -np.inf)
            for i, row in enumerate(close):
                may = np.flatnonzero(row >= least[i] - _ROUNDING)
                far = 1.0 - np.cumsum(v[may] * part[i], axis=1)[:, -1]
                first = np.lexsort((ids[may], far))[:k]
                found.append((np.full(len(first), queries[at + i]), ids[may[first]], far[first]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), columns)))


def cell_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 1,
    cells: int = 64, rows_per_block: int = 50_000, slack: float = 1e-6,
) -> DataFrame:
    """V1 for many queries, exact: (query_id, vec_id, distance, rank).

    Every vector lies in the cell of its nearest center.  A query first meets the
    nearest cells that hold ``k`` vectors; the distance of its k-th one there is a bound,
    and of the other cells only those are met whose center is nearer than the bound
    plus the cell's radius (triangle inequality between unit vectors).  Queries and
    vectors of a cell are compared as matrices.  A cell of many rows is split into blocks of about ``rows_per_block``, so copies of one vector
    spread over tasks.  Vectors without a direction (null, empty, zero, not finite) are
    in no result; no vectors or no queries give no rows; ties go by vec_id.
    """
    v = _units(_directed(vectors), "vec_id", "vec_id", None)
    q = _units(_directed(queries), "query_id", "query_id", None)
    centers = [{"cell": i, "u": u} for i, u in enumerate(_cell_centers(v, cells))]
    near = F.element_at(_by_distance(F.col("_vec_id"), _cells(centers)), 1)
    placed = tables.materialise(
        compute_once(v, _near=near).select("vec_id", "_vec_id", "_near.cell", "_near.d"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()
    known = [
        {**centers[r["cell"]], "n": r["n"], "radius": r["radius"], "blocks": -(-r["n"] // rows_per_block)}
        for r in sizes
    ]
    split = F.create_map(*[F.lit(x) for c in known for x in (c["cell"], c["blocks"])]) if known else F.lit(None)
    blocks = F.element_at(split, F.col("cell")) if known else F.lit(1)
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")) \
        .select("cell", "_block", "vec_id", "_vec_id")

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((v, "vec_id"), (q, "query_id"))]
    parts = max(1, -(-q.count() // rows_per_block))

    # How many of the nearest cells hold k vectors.
    count = F.aggregate(
        "_ways", F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("taken")),
        lambda s, c: F.when(s["held"] >= k, s).otherwise(
            F.struct((s["held"] + c["n"]).alias("held"), (s["taken"] + 1).alias("taken"))))
    ways = compute_once(q, _ways=_by_distance(F.col("_query_id"), _cells(known))) \
        .withColumn("_taken", count["taken"])

    def compared(met: DataFrame) -> DataFrame:
        # A block of vectors and a block of queries meet in memory; k rows per query leave it.
        every = met.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
            .withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        there = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["cell", "_block", "_part"]
        pairs = there.groupBy(*keys).cogroup(every.select(*keys, "query_id", "_query_id").groupBy(*keys)).applyInPandas(
            lambda left, right: _nearest_of(left, right, k), f"query_id {kinds[1]}, vec_id {kinds[0]}, distance double")
        return _top(pairs, k)

    nearest = ways.select("query_id", "_query_id", F.inline(F.slice("_ways", F.lit(1), F.col("_taken"))))
    first = tables.materialise(compared(nearest), "nearest-cells")
    bounds = first.filter(F.col("rank") == k).select(
        "query_id", F.sqrt(F.greatest(2.0 * F.col("distance"), F.lit(0.0))).alias("_bound"))
    others = F.filter(
        F.slice("_ways", F.col("_taken") + 1, F.size("_ways")),
        lambda c: F.col("_bound").isNull() | (c["d"] - c["radius"] <= F.col("_bound") + slack))
    rest = compared(ways.join(bounds, "query_id", "left").select("query_id", "_query_id", F.inline(others)))
    return _top(first.drop("rank").unionByName(rest.drop("rank")), k)


def approx_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 1,
    tables: int = 32, bits: int = 3, bucket_length: float = 0.5, seed: int = 7,
) -> DataFrame:
    """V2: like V1, from hash candidates with an exact re-rank.

    On unit vectors Euclidean order is cosine order, so random-projection
    hashing applies.  A table's key joins ``bits`` projections, which keeps
    buckets small; a vector that shares a key with a query is compared.  More
    tables raise recall, more bits cut work.
    """
    as_vector = lambda df, out: df.withColumn("features", array_to_vector(F.col(f"_{out}")))
    v = as_vector(_units(vectors, "vec_id", "vec_id", None), "vec_id")
    q = as_vector(_units(queries, "query_id", "query_id", None), "query_id")
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=tables * bits, seed=seed)
    model = lsh.fit(v)

    def hashed(df: DataFrame, out: str) -> DataFrame:
        cell = lambda i: vector_to_array(F.col("hashes")[i])[0]
        keys = [
            F.xxhash64(*[cell(i) for i in range(t * bits, (t + 1) * bits)]) for t in range(tables)]
        return model.transform(df).select(out, F.posexplode(F.array(*keys)).alias("_table", "_key"))

    shared = (
        hashed(v, "vec_id").join(hashed(q, "query_id"), ["_table", "_key"])
        .select("query_id", "vec_id").distinct()
    )
    pairs = (
        shared.join(v.select("vec_id", "_vec_id"), "vec_id")
        .join(q.select("query_id", "_query_id"), "query_id")
        .select(
            "query_id", "vec_id",
            (1.0 - dot(F.col("_vec_id"), F.col("_query_id"))).alias("distance"))
    )
    return _top(pairs, k)
