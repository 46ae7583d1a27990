"""Quality grades by ordinal cumulative-link regression.

A document's features are its different words (runs of letters and digits in
lower case, and runs of marks), their first letters, and how often a word
follows itself, hashed into a fixed number of places; a feature is there or not,
so a single word counts alike in short and long texts.  One weight vector is
shared by all grades: P(grade > k) = sigmoid(x . w - t_k) with thresholds
t_0 < t_1 < ...  The fit works on a bounded sample of rated documents
(``sample`` keys that come first by hash).  Places whose documents' grades do
not differ from the rest by ``evidence`` standard errors keep weight zero; for
the others adaptive gradient steps minimise the negative log-likelihood.
Scoring covers every document.  Expected grade is the sum of the tail probabilities, and a document
is selected by its probability of reaching a wanted grade.

Null and empty texts have no feature and are scored by the thresholds alone.
Repeated rows are scored alike.  Null keys are scored and never fitted on.
Without ratings, or with one grade alone, there is no model and an error says
so; an empty table of documents gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import bounded_sample, source_rows

PLACES = 1 << 20
SAMPLE = 20_000
STEPS = 500
RATE = 1.0
# Standard errors asked for at a full sample; as many fewer as the root of a smaller one.
EVIDENCE = 12.0
LEAST_EVIDENCE = 3.5
LEAST_PROBABILITY = 0.6
STEM = 4
MOST_REPEATS = 6
FEATURE = re.compile(r"[^\W_]+|[^\w\s]+")
# Words whose place a task remembers.
REMEMBERED = 300_000


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor text; 1: good text that is toxic; 2: good text."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).when(quality == 1, 2)


def features(text: str | None) -> set[str]:
    if not text:
        return set()
    text = text.lower()
    found = set(FEATURE.findall(text))
    found.update(["^" + w[:STEM] for w in found if len(w) > STEM])
    words = text.split()
    most = max((sum(1 for _ in run) for _, run in itertools.groupby(words)), default=0) - 1
    found.update(f"={i}" for i in range(1, min(most, MOST_REPEATS) + 1))
    return found


def place(word: str) -> int:
    return zlib.crc32(word.encode()) & (PLACES - 1)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score (rows) and k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(texts: list[str | None], grades: list[int], **options) -> OrdinalModel:
    """A model of the grades 0 to max(grades), from texts at hand."""
    return fit_places([sorted({place(w) for w in features(t)}) for t in texts], grades, **options)


def fit_places(places: list, grades: list[int], steps: int = STEPS, rate: float = RATE,
               evidence: float = EVIDENCE) -> OrdinalModel:
    """The fit itself, on the places of each document's features."""
    y = np.asarray(grades, np.int64)
    if len(set(grades)) < 2:
        raise ValueError("ratings of two grades at least are needed")
    n, top = len(y), int(y.max())
    row = np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in places])
    col = np.concatenate([np.asarray(p, np.int32) for p in places])
    reached = (y[:, None] > np.arange(top)[None, :]).astype(float)
    share = reached.mean(axis=0).clip(1e-3, 1 - 1e-3)
    # Without weights the error of a document depends on its grade alone; each threshold is asked by itself.
    count = np.maximum(np.bincount(col, minlength=PLACES), 1)
    strength = np.zeros(PLACES)
    for k in range(top):
        error = share[k] - reached[:, k]
        apart = np.abs(np.bincount(col, error[row], PLACES)) / np.sqrt(count * share[k] * (1 - share[k]))
        strength = np.maximum(strength, apart)
    telling = strength >= max(LEAST_EVIDENCE, evidence * math.sqrt(n / SAMPLE))
    row, col = row[telling[col]], col[telling[col]]
    used, col = np.unique(col, return_inverse=True)
    w, w_past = np.zeros(len(used)), np.full(len(used), 1e-12)
    t, t_past = np.log((1 - share) / share), np.full(top, 1e-12)
    t = np.maximum.accumulate(t)
    for _ in range(steps):
        score = np.bincount(row, w[col], n)
        # The likelihood of every "more than k or not": binary cross entropies that share w.
        error = (1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -60, 60))) - reached) / n
        g, gt = np.bincount(col, error.sum(axis=1)[row], len(used)), -error.sum(axis=0)
        w_past += g * g
        t_past += gt * gt
        w -= rate * g / np.sqrt(w_past)
        # In order, whatever a step would do.
        t = np.maximum.accumulate(t - rate * gt / np.sqrt(t_past))
    weights = np.zeros(PLACES, np.float32)
    weights[used] = w
    return OrdinalModel(weights, t)


def fit_on(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
           rating_key: str = "doc_id", rating: str = "grade", **options) -> OrdinalModel:
    """Fits on at most ``sample`` rated documents, drawn by a hash of their keys."""
    rated = ratings.select(F.col(rating_key).cast("long").alias("rated_id"), F.col(rating).cast("int").alias("grade"))
    rated = rated.filter("rated_id IS NOT NULL AND grade IS NOT NULL").groupBy("rated_id").agg(
        F.max("grade").alias("grade"))
    drawn = bounded_sample(rated, "rated_id", sample)
    rows = source_rows(docs, key, text).join(F.broadcast(drawn), F.col("doc_id") == F.col("rated_id"))
    # The sample's texts come to the driver as four bytes per feature, not as texts.
    found = rows.select("doc_id", "text", "grade").mapInPandas(_places, "doc_id long, grade int, places binary")
    got = found.toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["grade"], r["places"]))
    return fit_places([np.frombuffer(r["places"], "<i4") for r in got], [r["grade"] for r in got], **options)


def _places(frames):
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"].array, "grade": frame["grade"].array,
                            "places": [np.array(sorted({place(w) for w in features(t)}), "<i4").tobytes()
                                       for t in frame["text"].tolist()]})


def score(docs: DataFrame, model: OrdinalModel, wanted: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability of ``wanted`` or more) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        model, known = shared.value, {}
        weights = model.weights
        for frame in frames:
            scores = []
            for t in frame["text"].tolist():
                words = features(t)
                new = [w for w in words if w not in known]
                if new:
                    if len(known) > REMEMBERED:
                        known.clear()
                        new = words
                    known.update(zip(new, weights[[place(w) for w in new]].tolist()))
                # fsum is exact, so the order of a set does not matter.
                scores.append(math.fsum(map(known.__getitem__, words)))
            tails = model.tails(np.array(scores, float))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "score": scores,
                                "expected_grade": tails.sum(axis=1), "tail_probability": tails[:, wanted - 1]})

    return source_rows(docs, key, text).mapInPandas(
        run, "doc_id long, score double, expected_grade double, tail_probability double")


def select_by_grade(scored: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """Adds ``kept``: whether the wanted grade is likely enough."""
    return scored.withColumn("kept", F.col("tail_probability") >= least)
