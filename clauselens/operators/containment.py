"""Which text contains which, without comparing all pairs of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.functions.once import compute_once
from clauselens.sources.tables import materialise

_GRAM = 3
# Winnowing: of every _WINDOW runs of _RUN words that begin one after another, a
# hay keeps the smallest hash.
_RUN, _WINDOW = 4, 4
_LEAST_WORDS = _RUN + _WINDOW - 1

_ANCHORED, _WORDY, _TINY = 0, 1, 2


def _key(kind: int, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def _runs(words: Column) -> Column:
    """Hashes of all runs of words, of at least ``_LEAST_WORDS`` words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - _RUN + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, _RUN)))


def _winnowed(runs: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(runs) - _WINDOW + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_min(F.slice(runs, i, _WINDOW)))


def _longest(words: Column) -> Column:
    """The longest word, or null if all are empty."""
    sized = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(F.filter(sized, lambda x: x["n"] > 0))["w"]


def _with_needle_key(needles: DataFrame) -> DataFrame:
    """Adds ``_kind`` and ``_key``, one of the keys that every hay with this needle has.

    Wherever a needle occurs, its words but the first and the last are whole words
    there as well.  The smallest of all their runs is the smallest of each window
    it is in, so every hay keeps it.  Too few words leave the longest one, and
    none the needle's first letters.
    """
    parts = F.split("needle", " ", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    cut = compute_once(needles, _inner=inner)
    longest = _longest(F.col("_inner"))
    kind = F.when(F.size("_inner") >= _LEAST_WORDS, _ANCHORED).when(longest.isNotNull(), _WORDY).otherwise(_TINY)
    key = (
        F.when(F.col("_kind") == _ANCHORED, _key(_ANCHORED, F.array_min(_runs(F.col("_inner")))))
        .when(F.col("_kind") == _WORDY, _key(_WORDY, longest))
        .otherwise(_key(_TINY, F.substring("needle", 1, _GRAM)))
    )
    return cut.withColumn("_kind", kind).withColumn("_key", key).drop("_inner")


def _hay_keys(hays: DataFrame, asked: DataFrame, group) -> DataFrame:
    """(group, hay_id, _key): winnowed runs, and all words or short grams where a needle of the group asks for these.

    Runs are worked out where the hays are read, before the groups meet.
    """
    cut = compute_once(hays, _words=F.split("hay", " ", -1))
    cut = compute_once(cut, _all=F.when(F.size("_words") >= _LEAST_WORDS, _runs(F.col("_words"))))
    cut = compute_once(cut, _kept=F.array_distinct(_winnowed(F.col("_all")))).drop("_words", "_all").join(asked, group)
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(1), F.greatest(F.length("hay"), F.lit(1)))
    grams = F.concat(
        F.array(F.lit("")),
        F.flatten(F.transform(
            F.sequence(F.lit(1), F.lit(_GRAM)),
            lambda n: F.transform(starts, lambda i: F.substring(F.col("hay"), i, n)))))
    keys = F.concat(
        F.coalesce(F.transform("_kept", lambda x: _key(_ANCHORED, x)), none),
        F.when(F.col("_wordy"), F.transform(F.split("hay", " ", -1), lambda w: _key(_WORDY, w))).otherwise(none),
        F.when(F.col("_tiny"), F.transform(grams, lambda g: _key(_TINY, g))).otherwise(none))
    return cut.select(*group, "hay_id", F.explode(F.array_distinct(keys)).alias("_key"))


# --- keys that only hays with a needle's key keep ---------------------------

# Letters of a needle's first and last word that its key shows, and bits of the filter: a table of fixed size,
# in which a key has the bits that three parts of it name.
_SHOWN, _FILTER_BITS, _SHIFTS = 2, 24, (40, 16, 0)
_EDGES = ("e1", "e2", "s1", "s2")


def _hashed_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_w``: hashes of the words, of their one and two last letters and of their one and two first ones."""
    cut = compute_once(df, _words=F.split(text, " ", -1))
    of = lambda f: F.transform("_words", lambda w: F.xxhash64(f(w)))
    return compute_once(cut, _w=F.struct(
        of(lambda w: w).alias("w"), of(lambda w: F.right(w, F.lit(1))).alias("e1"), of(lambda w: F.right(w, F.lit(2))).alias("e2"),
        of(lambda w: F.left(w, F.lit(1))).alias("s1"), of(lambda w: F.left(w, F.lit(2))).alias("s2")))


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """The hashed words of a batch of texts, one after the other."""

    def __init__(self, words: pa.StructArray):
        of = {name: words.field(name) for name in ("w", *_EDGES)}
        self.n = np.diff(of["w"].offsets.to_numpy())
        self.hashes = {k: v.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for k, v in of.items()}
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.start = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.row)) - self.start[self.row]

    def runs(self, at, size):
        """A hash of so many words from each of the places on."""
        out, words = np.full(len(at), size, np.uint64), self.hashes["w"]
        for k in range(size):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        return out

    def least_runs(self, at, size):
        """The smallest of the hashes of _RUN words that begin at so many places from each place on."""
        return np.minimum.reduce([self.runs(at + k, _RUN) for k in range(size)])

    def wordy(self, at, size, first, last):
        """Keys of so many words between ends of the word before and beginnings of the word behind."""
        out = self.runs(at, size) + np.uint64(9 * size + 3 * first + last + 1)
        if first:
            out = _mixed(out + self.hashes[f"e{first}"][at - 1])
        if last:
            out = _mixed(out ^ self.hashes[f"s{last}"][at + size])
        return _mixed(out)


def _shape(size, first, last):
    return 9 * size + 3 * first + last


def _needle_keys(words: pa.Array, shape: pa.Array) -> pa.Array:
    """The key of a needle: the smallest run of its inner words (shape 0), or its few inner words and the letters around."""
    texts, shapes = _Words(words), shape.to_numpy(zero_copy_only=False)
    keys = np.zeros(len(shapes), np.uint64)
    for form in np.unique(shapes[shapes >= 0]):
        rows = np.flatnonzero(shapes == form)
        if form:
            keys[rows] = texts.wordy(texts.start[rows] + 1, form // 9, form // 3 % 3, form % 3)
        else:
            # Windows of the inner words cover all of their runs.
            inner = np.flatnonzero((shapes[texts.row] == 0) & (texts.place >= 1) & (texts.place + _RUN <= texts.n[texts.row] - 1))
            opens = np.flatnonzero(np.diff(texts.row[inner], prepend=-1))
            keys[rows] = np.minimum.reduceat(texts.runs(inner, _RUN), opens)
    return pa.array(keys.view(np.int64))


def _hay_keys_kept(shapes, bits):
    """A function of hashed words to the different keys of a hay that the filter lets through."""

    @F.arrow_udf("array<bigint>")
    def kept(words: pa.Array) -> pa.Array:
        texts, let = _Words(words), bits.value
        rows, found = [], []

        def keep(at, keys):
            for shift in _SHIFTS:
                slot = (keys >> np.uint64(shift)).astype(np.int64) & ((1 << _FILTER_BITS) - 1)
                passed = np.flatnonzero(let[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                at, keys = at[passed], keys[passed]
            rows.append(texts.row[at])
            found.append(keys)

        left = texts.n[texts.row] - texts.place
        for form in shapes:
            if form:
                at = np.flatnonzero((texts.place >= 1) & (left > form // 9))
                keep(at, texts.wordy(at, form // 9, form // 3 % 3, form % 3))
            else:
                at = np.flatnonzero(left >= _LEAST_WORDS)
                keep(at, texts.least_runs(at, _WINDOW))
        row = np.concatenate([np.empty(0, np.int64), *rows])
        key = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = (np.diff(row, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(texts.n)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[new]))

    return kept


def _filtered_keys(hays: DataFrame, needles: DataFrame, group) -> tuple[DataFrame, DataFrame]:
    """Keys of hays (group, hay_id, _key) and of needles (group, needle_id, needle, _key).

    A needle of few words has all its inner words as its key, and the letters that its
    outer words show to a hay.  Hays keep only keys that some needle may have, by a
    table of bits of fixed size, so that the rest is neither stored nor shuffled.
    """
    spark = hays.sparkSession
    parts = F.split("needle", " ", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    cut = compute_once(needles, _inner=inner, _first=F.get(parts, F.lit(0)), _last=F.element_at(parts, -1))
    shown = lambda w: F.least(F.length(w), F.lit(_SHOWN))
    shape = (
        F.when(F.size("_inner") >= _LEAST_WORDS, 0)
        .when(_longest(F.col("_inner")).isNotNull(), _shape(F.size("_inner"), shown("_first"), shown("_last")))
        .otherwise(-1))
    cut = cut.withColumn("_shape", shape.cast("int")).drop("_inner", "_first", "_last")
    cut = _hashed_words(cut, "needle").withColumn("_word_key", F.arrow_udf(_needle_keys, "bigint")("_w", "_shape"))
    tiny = F.col("_shape") == -1
    keyed = materialise(cut.select(*needles.columns, "_shape", F.when(
        tiny, _key(_TINY, F.substring("needle", 1, _GRAM))).otherwise(F.col("_word_key")).alias("_key")), "needles")

    shapes = sorted(r[0] for r in keyed.select("_shape").distinct().collect())  # 55 at most
    part = lambda shift: F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << _FILTER_BITS) - 1)).cast("int")
    slots = keyed.filter(~tiny).select(F.explode(F.array(*[part(x) for x in _SHIFTS])).alias("slot"))
    bytes_ = slots.groupBy(F.shiftright("slot", 3).alias("at")).agg(
        F.expr("bit_or(shiftleft(1, pmod(slot, 8)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    bits[bytes_["at"].to_numpy()] = bytes_["bits"].to_numpy()
    kept = _hay_keys_kept([x for x in shapes if x >= 0], spark.sparkContext.broadcast(bits))
    keys = _hashed_words(hays, "hay").select(*group, "hay_id", F.explode(kept("_w")).alias("_key"))
    if -1 in shapes:
        asked = keyed.filter(tiny).select(*group).distinct().withColumn("_wordy", F.lit(False)).withColumn("_tiny", F.lit(True))
        short = _hay_keys(hays, asked, group).join(keyed.filter(tiny).select(*group, "_key").distinct(), [*group, "_key"], "left_semi")
        keys = keys.unionByName(short).distinct()
    return keys, keyed.drop("_shape")


def containing_pairs(hays: DataFrame, needles: DataFrame, group, filtered: bool = False) -> DataFrame:
    """(group, hay_id, needle_id) for every needle inside a hay of its group.

    ``hays`` has the group columns, ``hay_id`` and ``hay``; ``needles`` has
    ``needle_id`` and ``needle`` likewise.  Candidates meet on a winnowed run of
    words, so common words bring nothing together; needles of few words meet on
    their longest inner word or their first letters, for which only the hays of
    their groups give keys.  An empty needle is in every hay, a null one in none.

    ``filtered`` gives the same pairs where hays are many and stored: it stores the keys of
    the needles first, and hays leave out the keys that no needle has.
    """
    group = list(group)
    needles = needles.filter("needle is not null")
    if filtered:
        keys, keyed = _filtered_keys(hays, needles, group)
    else:
        keyed = _with_needle_key(needles)
        asked = keyed.groupBy(*group).agg(
            F.max(F.col("_kind") == _WORDY).alias("_wordy"), F.max(F.col("_kind") == _TINY).alias("_tiny"))
        keys, keyed = _hay_keys(hays, asked, group), keyed.drop("_kind")
    # Only keys and ids of hays are multiplied; their texts join the candidates afterwards.
    candidates = keys.join(keyed, [*group, "_key"])
    return (
        candidates.join(hays, [*group, "hay_id"])
        .filter(F.contains("hay", F.col("needle")))
        .select(*group, "hay_id", "needle_id")
    )
