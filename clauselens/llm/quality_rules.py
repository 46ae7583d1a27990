"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Texts are cut into runs of letters and digits and runs of marks; single runs and
neighbouring pairs are hashed into a fixed number of buckets.  Two multinomials
over the buckets, one of trusted documents and one of the whole raw corpus, give
every n-gram a weight, the log of their ratio.  A document's score is the mean
weight of its n-grams; the document is kept if the score reaches a threshold.
A mean does not see a few toxic words, so a second array of weights holds the
log ratio of trusted documents to labelled toxic ones of good quality.  Only
single runs that are clearly on the toxic side count: what their weights lack to
a cut is summed up, and a document is rejected if the sum exceeds a threshold
times the root of its number of runs, so long texts do not dilute a passage as a
mean would.  Without any toxic label this second test is left out.
Weights are whole thousandths, so sums and verdicts are the same in any order of
execution.

Everything is column expressions.  The corpus counts cover every document.  The
weights come back as one small array whose length is the number of buckets.
Trusted and toxic documents are bounded sets: the ``trusted_limit`` labelled keys
of each that come first by hash.  Without any trusted document the base rules alone decide.

Null texts have no words and fail the base rules.  Repeated rows are judged
alike.  Null keys are never trusted.  An empty table gives no rows.  Other
columns of the input are ignored, or kept whole by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.llm.common import bounded_sample, compute_once, word_array

BUCKETS = 1 << 16
TRUSTED_LIMIT = 100_000
# Occurrences in the raw corpus that stand for no difference at all.
SMOOTHING = 1.0
# Least mean weight per n-gram, in thousandths of a nat.
THRESHOLD = -200
SCALE = 1000
# Weights against toxic documents below the cut count, in thousandths, and the most they may sum up to under the cut
# for a text of one run.
TOXIC_CUT = -1000
TOXIC_THRESHOLD = 130
# The bucket of all pairs of equal runs: stuttering has one weight.
SAME = 0

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
RUN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = "#*$%&|<>"


def trusted_keys(labels: DataFrame, limit: int = TRUSTED_LIMIT, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` keys of labelled documents of good quality that are not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(key).cast("long").alias("trusted_id"))
    good = good.filter("trusted_id IS NOT NULL").distinct()
    return bounded_sample(good, "trusted_id", limit)


def toxic_keys(labels: DataFrame, limit: int = TRUSTED_LIMIT, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` keys of labelled documents of good quality that are toxic."""
    toxic = labels.filter("quality = 1 AND toxic = 1").select(F.col(key).cast("long").alias("toxic_id"))
    return bounded_sample(toxic.filter("toxic_id IS NOT NULL").distinct(), "toxic_id", limit)


def _runs(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))


def _single(run: Column, buckets: int) -> Column:
    return F.xxhash64(run).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _pair(run: Column, after: Column, buckets: int) -> Column:
    """The bucket of two neighbouring runs."""
    return F.when(run == after, F.lit(SAME)).otherwise(
        F.xxhash64(run, after).bitwiseAND(F.lit(buckets - 1)).cast("int"))


def gram_counts(docs: DataFrame, trusted: DataFrame, toxic: DataFrame, key: str, text: str,
                buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target, toxic) counts over all documents, over trusted ones and over toxic ones."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # The keys are bounded by ``trusted_limit``.
    rows = rows.join(F.broadcast(trusted), F.col("id") == F.col("trusted_id"), "left").join(
        F.broadcast(toxic), F.col("id") == F.col("toxic_id"), "left").select(
        "text", F.col("trusted_id").isNotNull().cast("long").alias("good"),
        F.col("toxic_id").isNotNull().cast("long").alias("bad"))
    rows = compute_once(rows, _runs=_runs("text"))
    grams = F.concat(
        F.transform("_runs", lambda r: _single(r, buckets)),
        F.transform("_runs", lambda r, i: F.when(i > 0, _pair(F.get("_runs", i - 1), r, buckets))))
    grams = rows.select("good", "bad", F.explode(grams).alias("bucket")).filter("bucket IS NOT NULL")
    return grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"), F.sum("bad").alias("toxic"))


def gram_weights(
    counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
) -> tuple[list[int] | None, list[int] | None]:
    """Two weights of every bucket, in thousandths: trusted documents against all, and against toxic ones.

    Both are None if nothing is trusted, the second also if nothing is toxic.
    """
    found = {r[0]: (r[1], r[2], r[3]) for r in counts.collect()}  # at most ``buckets`` rows of four numbers
    total = [sum(v[i] for v in found.values()) for i in range(3)]
    from math import log

    def against(other: int) -> list[int] | None:
        if not total[1] or not total[other]:
            return None
        # Both counts shrink towards the same share, so rare n-grams and small tables stay near zero.
        scale = total[other] / total[1]
        return [
            round(SCALE * log((found[b][1] * scale + smoothing) / (found[b][other] + smoothing))) if b in found else 0
            for b in range(buckets)
        ]

    return against(0), against(2)


def _base_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts that the base rules and their report need, all prefixed with ``_``."""
    words = word_array(F.col(text))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = compute_once(df, _words=words, _lines=lines)
    df = compute_once(
        df, _n_words=F.size("_words").cast("long"), _word_chars=F.length(F.array_join("_words", "")).cast("long"),
        _n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        _hashed=F.transform("_words", lambda w: F.xxhash64(w)))
    whole = F.size("_hashed") - (REPEAT_WINDOW - 1)
    windows = F.transform("_hashed", lambda h, i: F.when(
        i < whole, F.xxhash64(h, *[F.get("_hashed", i + k) for k in range(1, REPEAT_WINDOW)])))
    # Nulls stand at the end, where no whole window begins.
    df = compute_once(df.drop("_words", "_lines"), _windows=F.array_compact(windows))
    # Windows in order of hash: those equal to a neighbour occur twice or more.
    ordered = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = compute_once(df.drop("_hashed"), _ordered=ordered)
    twice = F.filter("_ordered", lambda x, i: (
        x["h"].eqNullSafe(F.get("_ordered", i - 1)["h"]) | x["h"].eqNullSafe(F.get("_ordered", i + 1)["h"])))
    df = compute_once(df.drop("_windows"), _starts=F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(
            F.lit(REPEAT_WINDOW), F.coalesce(F.get("_starts", i + 1) - s, F.lit(REPEAT_WINDOW)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return compute_once(df.drop("_ordered"), _n_repeat_words=F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")


def _weight_array(weights: list[int]) -> Column:
    """The weights as one constant."""
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str, threshold: int, trusted_limit: int,
            buckets: int, label_key: str, smoothing: float, toxic_threshold: int) -> DataFrame:
    """(row, id, text counts, verdicts) of every row; ``row`` holds the input row whole."""
    trusted = trusted_keys(labels, trusted_limit, label_key)
    toxic = toxic_keys(labels, trusted_limit, label_key)
    weights, against_toxic = gram_weights(
        gram_counts(docs, trusted, toxic, key, text, buckets), buckets, smoothing)
    df = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    df = _base_columns(df, "text")
    failed = (F.col("_n_words") < MIN_WORDS) | (
        F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEATED_PERCENT)
    df = df.withColumn("_base_failed", failed)
    if weights is None:
        return df.withColumn("_score", F.lit(None).cast("long")).withColumn("_kept", ~F.col("_base_failed"))
    df, table = compute_once(df, _runs=_runs("text")), _weight_array(weights)
    df = compute_once(df, _ones=F.transform("_runs", lambda r: _single(r, buckets)))
    weighed = F.transform("_runs", lambda r, i: F.get(table, F.get("_ones", i)) + F.when(
        i > 0, F.get(table, _pair(F.get("_runs", i - 1), r, buckets))).otherwise(F.lit(0)))
    toxic_sum = F.lit(0).cast("long")
    if against_toxic is not None:
        lacking = _weight_array([max(TOXIC_CUT - w, 0) for w in against_toxic])
        toxic_sum = F.aggregate("_ones", F.lit(0).cast("long"), lambda a, b: a + F.get(lacking, b))
    df = compute_once(df, _total=F.aggregate(weighed, F.lit(0).cast("long"), lambda a, b: a + b),
                      _toxic=toxic_sum, _n_runs=F.size("_runs").cast("long"),
                      _n_grams=F.greatest(F.size("_runs").cast("long") * 2 - 1, F.lit(0).cast("long")))
    score = F.when(F.col("_n_grams") > 0, F.floor(F.col("_total") / F.col("_n_grams")))
    enough = F.col("_total") >= F.col("_n_grams") * threshold
    clean = F.col("_toxic") <= F.lit(toxic_threshold) * F.sqrt("_n_runs")
    return df.drop("_runs", "_ones").withColumn("_score", score).withColumn(
        "_kept", ~F.col("_base_failed") & enough & clean)


def judge_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
    trusted_limit: int = TRUSTED_LIMIT, buckets: int = BUCKETS, label_key: str = "doc_id",
    smoothing: float = SMOOTHING, toxic_threshold: int = TOXIC_THRESHOLD,
) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the score in thousandths."""
    df = _judged(docs, labels, key, text, threshold, trusted_limit, buckets, label_key, smoothing, toxic_threshold)
    zero = F.lit(0).cast("long")
    return df.select(
        F.col("id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.coalesce("_n_symbols", zero).alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_score").alias("score_milli"))


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
    trusted_limit: int = TRUSTED_LIMIT, buckets: int = BUCKETS, label_key: str = "doc_id",
    smoothing: float = SMOOTHING, toxic_threshold: int = TOXIC_THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    df = _judged(docs, labels, key, text, threshold, trusted_limit, buckets, label_key, smoothing, toxic_threshold)
    return df.filter("_kept").select("row.*")
