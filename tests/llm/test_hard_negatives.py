"""Hard negatives against scores of all pairs, and the intervals against exact products."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselens.llm import hard_negatives

FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string, anchor_id string"


def plain(rows, d):
    """All pairs; one row for each key, the least (label, vector)."""
    best = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(max(-2 ** 26, min(2 ** 26, 256 * float(np.float32(x))))) for x in vector]
        if key not in best or (label, v) < best[key]:
            best[key] = (label, v)
    best = {k: ((label + 1) % 10 if k % 7 == 0 else label, v + [0] * (d - len(v))) for k, (label, v) in best.items()}
    out = []
    for a, (label, v) in best.items():
        if a % 10:
            continue
        score = {k: sum(x * y for x, y in zip(v, w)) for k, (_, w) in best.items()}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if k != a and best[k][0] == label][:5]:
            fit = [k for k in order if best[k][0] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(a, p, i + 1, k, score[p], score[k]) for i, k in enumerate(fit[:10])]
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, label, **options)
    return [tuple(r[c] for c in FIELDS) for r in found.collect()]


@pytest.mark.parametrize("options", [{}, {"chunk": 13, "pilot": 50}])
def test_against_all_pairs(spark, options):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 20)) / 5
    rows = []
    for i in range(700):
        x = (centres[i % 6] + rng.standard_normal(20) / 6).astype(np.float32).tolist()
        rows.append((i, x, int(rng.integers(0, 4)) if i % 5 else i % 6))
    # Ties, repeated rows and keys, short, empty and broken vectors, missing labels and keys.
    rows += [(1000 + i, rows[0][1], 9) for i in range(40)] + [rows[3]] * 3 + [(3, rows[4][1], 0), (10, rows[11][1], 2)]
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")], 1), (2003, [float("-inf")], 1), (2004, [0.5], None),
             (None, [0.5], 1), (2005, [0.5, 0.5], 1), (2010, [], 2), (2020, [0.25], 3), (2006, [0.0] * 20, 2)]
    want = plain(rows, 20)
    assert len(want) > 200
    assert Counter(mined(spark, rows, **options)) == Counter(want)


def test_few_rows(spark):
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1), (1, [2.0], 1), (2, [1e30], 2), (3, [0.9], 2)]) == [
        (10, 1, 1, 3, 256 * 512, 256 * 230)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("d", [1, 20, 64, 130])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    v = np.concatenate([rng.integers(-300, 300, (500, d)), np.zeros((2, d), np.int64), rng.integers(-2 ** 26, 2 ** 26, (20, d))])
    anchors = np.concatenate([v[:40], v[-5:], np.zeros((1, d), np.int64), np.ones((1, d), np.int64)])
    turn = hard_negatives.rotation(d)
    low, high = hard_negatives.Queries(anchors, turn).intervals(*hard_negatives.codes(v, turn))
    exact = v @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    # The estimate is worth something: its middle is nearer than the trivial bound.
    trivial = np.sqrt((v ** 2).sum(1))[:, None] * np.sqrt((anchors ** 2).sum(1))
    if d >= 20:
        assert np.median((high - low) / np.maximum(trivial, 1)) < 1.6
