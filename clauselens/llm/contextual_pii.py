"""Personal data by bootstrapped contextual extraction.

Fixed patterns find seed entities: e-mail and IP addresses, payment cards, phone
numbers, and, as a further kind ``secret``, keys of known issuers and values behind
a word for a password.  What stands around a seed are its lexical patterns: the two
words before it; the word before with the word after; its label (a word with a
colon or an equals sign) with the value's shape, which is its sort of characters and
its length; and that shape behind any label.  All other identifier-like runs of
characters (with several digits) are instances without a kind, with patterns of
the same make.  Patterns and instances form a graph.  In every round a pattern's
confidence is the mean score of its instances, if enough different ones with a
score of ``min_confidence`` stand behind it, and an instance's score is the chance that at
least one of its patterns is right; seeds keep score one.  Instances found in one
round thus stand behind further patterns in the next.  After the last round an unseen
identifier in a trusted pattern becomes a span of its own kind ``context``.

Everything is column expressions, joins and aggregates.  Only documents with a
digit or an at sign take part in the search; the graph holds one narrow row per
pattern and instance.  The patterns below match what the plain forms match, but
never run twice over the same characters, however long a text is.

Null and empty texts have no spans.  Repeated rows get the same spans once each.
Rows with a null key are told apart by their texts.  An empty table gives no
rows.  Other columns are ignored, or kept whole by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import compute_once, materialise

KINDS = ("email", "ip", "card", "phone")
# Seeds beyond the four, and what is discovered.
SECRET, CONTEXT = "secret", "context"
SEEDS = (*KINDS, SECRET)

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_PATTERNS = {
    # local@label.label...; starts only where a run of local characters starts, or where the last match ended
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?=\.[{_HOST}])"
             rf"(?:(?!\.(?![{_HOST}]))[{_HOST}.])++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # digits with single spaces or hyphens between them
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# --- fixed values: how well-known issuers write their keys, and words for a password ---
_KEYS = (
    "(?:AKIA|ASIA)[A-Z0-9]{16}", "gh[opsu]_[A-Za-z0-9]{36}", "glpat-[A-Za-z0-9_-]{20}", "AIza[A-Za-z0-9_-]{35}",
    "sk_live_[A-Za-z0-9]{24}", "xox[abprs]-[A-Za-z0-9-]{10,80}")
_LABELS = "password|passwd|pwd|secret|token|api_key|apikey|access_key"
_RUN = "A-Za-z0-9+/_-"
# A value stands where a run of its characters starts, so no character is tried twice.
_PATTERNS[SECRET] = (
    rf"(?<![{_RUN}])(?:(?:{'|'.join(_KEYS)})(?![{_RUN}])"
    rf"|(?<=(?i:\b(?:{_LABELS}))[\"']?[\x20\t]{{0,2}}[:=][\x20\t]{{0,2}}[\"']?)[{_RUN}]{{8,}}+)")
# A run with a digit; starts only at the start of a run.
_NUMBERED = rf"(?<![{_RUN}])[A-Za-z+/_-]*+[0-9][{_RUN}]*+"
_LABELLED = r"""(?:^|[^\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_-]*)["']?\s*[:=]\s*["'(]?$"""
# Sorts of characters, the first that fits.
_SORTS = (("d", "[0-9]+"), ("h", "[0-9a-f]+"), ("h", "[0-9A-F]+"), ("a", "[0-9a-z]+"), ("A", "[0-9A-Z]+"), ("m", "[0-9A-Za-z]+"))
# Stands for characters of a seed while other identifiers are looked for.
_COVER = "\ue000"
# Characters around an entity in which its context words are looked for.
_REACH = 80

MIN_DIGITS = 4
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.9
ROUNDS = 5


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(_OCTETS)
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == SECRET:
        return (F.length(digits) >= 2) & found.rlike("[A-Za-z]")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _split(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Adds ``_found``, all matches in order, and ``_gaps``, the text around them."""
    return compute_once(df, _found=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        _gaps=F.split(text, pattern, -1))


def _entities(df: DataFrame, text: str, kind: Column, pattern: str, valid) -> DataFrame:
    """One row per match: its number, the length of the gap before, the match and the text around it."""
    df = _split(df, text, pattern).filter(F.size("_found") > 0)
    rows = F.transform("_found", lambda m, i: F.struct(
        i.alias("number"), F.length(F.get("_gaps", i)).alias("gap"), F.length(m).alias("size"), m.alias("found"),
        F.right(F.get("_gaps", i), F.lit(_REACH)).alias("before"),
        F.left(F.get("_gaps", i + 1), F.lit(_REACH)).alias("after")))
    df = df.select("doc_id", "text_hash", kind.alias("kind"), F.inline(rows))
    return df.withColumn("valid", valid(F.col("found")))


def _covered(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Column ``text`` with every seed of these kinds covered; positions stay as they are."""
    for kind in kinds:
        df = _split(df, "text", _PATTERNS[kind])
        ends = F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.when(
            _valid(kind, F.get("_found", i)), F.repeat(F.lit(_COVER), F.length(F.get("_found", i)))
        ).otherwise(F.get("_found", i)), F.lit(""))))
        df = compute_once(df, _cover=F.when(F.size("_found") > 0, F.array_join(ends, "")).otherwise(F.col("text")))
        df = df.select("doc_id", "text_hash", F.col("_cover").alias("text"))
    return df


def _word(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"{_COVER}+", "<id>")


def _entity_rows(docs: DataFrame) -> DataFrame:
    """Seeds and unseen identifiers: doc_id, text_hash, kind, start, size, found, left2, left1, right1, label.

    Stored in the shared folder: everything later reads these narrow rows.
    """
    some = docs.filter(F.col("text").rlike("[0-9@]"))
    parts = [_entities(some, "text", F.lit(k), _PATTERNS[k], lambda m, k=k: _valid(k, m)) for k in KINDS]
    enough = lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= MIN_DIGITS
    # Further kinds are looked for in what the four leave, and unseen ones in what all leave.
    other = _covered(some.filter(F.col("text").rlike(r"[0-9]")), KINDS)
    parts.append(_entities(other, "text", F.lit(SECRET), _PATTERNS[SECRET], lambda m: _valid(SECRET, m)))
    other = _covered(other, (SECRET,))
    parts.append(_entities(other, "text", F.lit(CONTEXT), _NUMBERED, enough))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # Repeated rows of the input yield equal rows; one of each counts.
    own = ["doc_id", "text_hash", "kind"]
    rows = rows.dropDuplicates([*own, "number"])
    order = Window.partitionBy(*own).orderBy("number")
    past = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.regexp_extract("before", r"(?:(?<!\S)(\S++)\s++)?(\S++)\s*+$", 0)
    rows = rows.withColumn("start", past - F.col("size")).filter("valid").withColumn("_left", F.split(F.trim(
        F.regexp_replace(left, r"\s+", " ")), " "))
    return rows.select(
        *own, "start", "size", "found",
        _word(F.coalesce(F.get("_left", F.size("_left") - 2), F.lit(""))).alias("left2"),
        _word(F.coalesce(F.get("_left", F.size("_left") - 1), F.lit(""))).alias("left1"),
        _word(F.regexp_extract("after", r"^\s*+(\S*+)", 1)).alias("right1"),
        F.lower(F.regexp_extract("before", _LABELLED, 1)).alias("label"))


def _shape() -> Column:
    """The sort of an identifier's characters and its length."""
    sort = F.lit("x")
    for name, form in reversed(_SORTS):
        sort = F.when(F.col("found").rlike(f"^{form}$"), F.lit(name)).otherwise(sort)
    return F.concat(sort, F.length("found"))


def _with_patterns(rows: DataFrame) -> DataFrame:
    """A row for every pattern of every entity."""
    left, labelled = F.col("left1") != "", F.col("label") != ""
    patterns = F.array(
        F.when(left & (F.col("left2") != ""), F.concat_ws(" ", "left2", "left1", F.lit("_"))),
        F.when(left & (F.col("right1") != ""), F.concat_ws(" ", "left1", F.lit("_"), "right1")),
        F.when(labelled, F.concat(F.col("label"), F.lit("="), _shape())),
        F.when(labelled, F.concat(F.lit("="), _shape())))
    return rows.withColumn("pattern", F.explode(F.array_compact(patterns)))


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, instance, seed): the graph, each edge once."""
    return _with_patterns(rows).select(
        "pattern", F.lower("found").alias("instance"), (F.col("kind") != CONTEXT).cast("int").alias("seed")).groupBy(
        "pattern", "instance").agg(F.max("seed").alias("seed"))


def pattern_confidence(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, confidence) of the patterns that stay trusted after the last round."""
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for last in [*[False] * (rounds - 1), True]:
        trusted = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum(
            (F.col("score") >= min_confidence).cast("int")).alias("behind"))
        trusted = trusted.filter((F.col("behind") >= min_seeds) & (
            F.col("confidence") >= (min_confidence if last else min_confidence / 2)))
        trusted = trusted.select("pattern", F.round("confidence", 9).alias("confidence"))
        if last:
            return trusted
        # The chance that one pattern at least is right, as a sum of logarithms.
        wrong = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999999))))
        unseen = scored.filter("seed = 0").select("pattern", "instance")
        gained = unseen.join(trusted, "pattern").groupBy("instance").agg((1.0 - F.exp(wrong)).alias("gained"))
        scored = edges.join(gained, "instance", "left").select(
            "pattern", "instance", "seed",
            F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.coalesce("gained", F.lit(0.0))).alias("score"))


def find_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(doc_id, text_hash, kind, start, end): seeds and discovered identifiers, each span once.

    Positions count code points; ``end`` is exclusive.  ``text_hash`` is
    xxhash64 of the text.
    """
    named = _named(docs, key, text).select("doc_id", "text_hash", "text")
    rows = materialise(_entity_rows(named), "entities")
    unseen = rows.filter(F.col("kind") == CONTEXT)
    trusted = pattern_confidence(materialise(_edges(rows), "pattern-graph"), rounds, min_seeds, min_confidence)
    hits = _with_patterns(unseen).join(trusted, "pattern").select("doc_id", "text_hash", "kind", "start", "size").distinct()
    spans = rows.filter(F.col("kind") != CONTEXT).select("doc_id", "text_hash", "kind", "start", "size")
    return spans.unionByName(hits).select(
        "doc_id", "text_hash", "kind", "start", (F.col("start") + F.col("size")).alias("end"))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"))


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _rank() -> Column:
    order = F.lit(len(SEEDS))
    for i, kind in reversed(list(enumerate(SEEDS))):
        order = F.when(F.col("kind") == kind, F.lit(i)).otherwise(order)
    return order


def private_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: spans per kind and in all, base_sha256 of the four kinds' list, and all spans as one string."""
    spans = find_spans(docs, key, text, **options)
    item = F.struct(F.col("start"), _rank().alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("label"))
    lists = spans.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(item)).alias("all"),
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in (*SEEDS, CONTEXT)],
        F.count(F.lit(1)).alias("n_spans"))
    rows = _named(docs, key, text).select("doc_id", "text_hash")
    joined = rows.join(lists, _same_text(rows, lists), "left").select(rows["doc_id"], *lists.columns[2:])
    base = F.filter("all", lambda x: x["rank"] < len(KINDS))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["label"]), ","), F.lit(""))
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in (f"n_{SECRET}", f"n_{CONTEXT}", "n_spans")])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None,
           **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets.

    Where spans overlap, the earlier one is replaced and the later one loses its
    share of it.  ``length`` names a column that holds the text's code points.
    """
    spans = find_spans(docs, key, text, **options).withColumn("rank", _rank())
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "rank", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("done", F.coalesce(before, F.lit(0).cast("long"))).filter("end > done")
    piece = F.struct(F.greatest("start", "done").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                     F.col("done").cast("int").alias("done"), F.col("kind"), (F.col("start") >= F.col("done")).alias("own"))
    lists = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(piece)).alias("cuts"))
    rows = _named(docs, key, text)
    joined = rows.join(lists, _same_text(rows, lists), "left").select("row", "text", "cuts")
    parts = F.transform("cuts", lambda c: F.concat(
        F.substring(F.col("text"), c["done"] + 1, c["start"] - c["done"]),
        F.when(c["own"], F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(F.lit(""))))
    rest = F.substring(F.col("text"), F.element_at("cuts", -1)["end"] + 1, F.length("text"))
    joined = compute_once(joined, _clean=F.when(
        F.col("cuts").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(f"row.{text}")))
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col("_clean").alias(name))
        elif name == length:
            columns.append(F.when(F.col("cuts").isNotNull(), F.length("_clean").cast(docs.schema[name].dataType))
                           .otherwise(F.col(f"row.`{name}`")).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return joined.select(*columns)
