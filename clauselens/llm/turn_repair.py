"""Repair of conversation structure by a grammar-compressed dynamic programme.

Every turn becomes a symbol: its role's initial and its first fault.  A repair
keeps, re-roles or deletes turns and inserts empty ones so that the initials read
``(s?(ua)+)?``; what it costs to get through a turn from each state of that
automaton to each other is a min-plus matrix, whose entries are (cost, audit) with
the audit as a rope.  Matrices multiply along a conversation.  Re-Pair builds one
grammar for all conversations: Spark counts neighbouring symbols over all different
sequences and the most frequent pairs become rules, round by round.  A rule's matrix
is computed once, bottom-up, from those of its two sides, and shared by all
sequences.  Long conversations are cut into segments, whose products are multiplied
in a tree, so no conversation is collected in one task; only its SHA-256, which is
defined one byte after another, reads a conversation in order, as a stream.

Order and ties: turns without a number first; at the same turn by role, then text;
equal rows stand together, and all but the first are duplicates.  Null roles and
texts count as one space, null keys and turns as one space in the damage's hash.
Conversations without a key are one conversation.  A role that begins with none of
s, u and a can be re-roled or deleted.  Of cheapest audits the least in ASCII wins;
no audit of equal cost begins another one, so the choice can be made piece by piece.
An empty table gives no rows.  Other columns are ignored.  The grammar only decides
how much work is shared: any number of rules gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.common import compute_once, materialise

_BLANK = "\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# Symbols of a segment, rules a round, rounds, and segments multiplied at once.
SEGMENT = 4096
RULES, ROUNDS = 16, 10
FAN = 16
# Rules are written as characters from here on.
_FIRST_RULE = 0xE000


# --- rows --------------------------------------------------------------------


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def conversation_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """(conv, turn, role, text) alone: the key as text, "" for null, and one space for a null role or text."""
    return df.select(F.coalesce(F.col(conv).cast("long").cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"),
                     _known(role).alias("role"), _known(text).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """The rows after damage, with ``copies``: how many of each now stand there."""
    key = F.concat_ws(":", F.when(F.col("conv") == "", F.lit(" ")).otherwise(F.col("conv")), _known("turn"))
    hit = compute_once(rows, _hit=(F.crc32(key.cast("binary")) % 20).cast("int")).filter("_hit <> 0")
    text = F.when(F.col("_hit") == 1, F.lit("")).when(
        F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select("conv", "turn", F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.when(F.col("_hit") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with ``copies``, ``blank``, ``cut`` (truncated) and ``again``.

    ``again`` tells that an earlier turn says the same.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    one = materialise(one.withColumn("digest", F.sha2("text", 256)), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = one.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that both sides of the join are plain shuffles and a hot text can be split.
    first = materialise(first.filter("n > 1").select(
        "conv", "role", "digest", "first"), "repeated-turns")
    joined = one.join(first, ["conv", "role", "digest"], "left")
    return joined.select(
        "conv", "turn", "role", "text", "copies", (~F.col("text").rlike(f"[^{_BLANK}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_BLANK}]*\z")).alias("cut"),
        (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"))


def counts(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of every conversation with rows, from ``faults``."""
    once, free = F.col("copies"), ~F.col("blank")
    by_turn = turns.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), once).otherwise(0)).alias("blank"),
        F.sum(F.when(free, once - 1 + F.col("again").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((free & ~F.col("again") & F.col("cut")).cast("long")).alias("truncated"))
    return by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


def _symbol() -> Column:
    """Of a row's first copy: d must go, s u a x as the role begins, upper case if truncated."""
    initial = F.substring("role", 1, 1)
    free = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(F.col("blank") | F.col("again"), F.lit("d")).when(F.col("cut"), F.upper(free)).otherwise(free)


# --- segments ----------------------------------------------------------------

_LEGAL = frozenset(("su", "ua", "au"))


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv, part, number, symbols, illegal, first, last): the conversations' symbols in order, cut up.

    ``illegal`` counts within the segment; ``first`` and ``last`` are initials.
    """
    narrow = turns.select("conv", "turn", "role", "text", "copies", _symbol().alias("symbol"))
    # Texts only break ties: their beginnings deal the rows out, whole ones sort them.
    dealt = narrow.repartitionByRange(
        int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held, out = TaskContext.get().partitionId(), 0, None, []

        def end() -> None:
            nonlocal number
            if held is not None:
                conv, symbols, illegal, first, last = held
                out.append((conv, part, number, "".join(symbols), illegal, first, last))
                number += 1

        for frame in frames:
            for conv, role, copies, symbol in zip(*(frame[c].tolist() for c in ("conv", "role", "copies", "symbol"))):
                initial = role[:1]
                while copies:
                    if held is None or held[0] != conv or len(held[1]) >= size:
                        end()
                        held = [conv, [], 0, initial, initial]
                    elif held[4] + initial not in _LEGAL:
                        held[2] += 1
                    take = min(copies, size - len(held[1]))
                    held[1].append(symbol)
                    held[1] += "d" * (take - 1)
                    held[2] += (take - 1) * (initial + initial not in _LEGAL)
                    held[4], copies, symbol = initial, copies - take, "d"
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        end()
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["conv", "part", "number", "symbols", "illegal", "first", "last"]
    return ordered.select("conv", "role", "copies", "symbol").mapInPandas(
        run, "conv string, part int, number int, symbols string, illegal long, first string, last string")


# --- the grammar -------------------------------------------------------------


def re_pair(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(symbols, n, packed) and the grammar of ``sequences`` (symbols, n).

    Rule i is the character 0xE000 + i and stands for its pair.  A round turns
    the most frequent pairs that share no symbol into rules.
    """
    grammar: list[tuple[str, str]] = []
    packed = sequences.withColumn("packed", F.col("symbols"))
    for _ in range(rounds):
        pairs = packed.filter(F.length("packed") > 1).select("n", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring(F.col("packed"), i, F.lit(2)))).alias("pair"))
        # A few rows: what is looked at is bounded by a round's rules.
        top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(
            4 * rules).collect()
        left, right, chosen = set(), set(), []
        for a, b in (r["pair"] for r in top):
            # Replacing one chosen pair must not break another one up.
            if len(chosen) < rules and a not in right and b not in left and a != b or not chosen:
                chosen.append((a, b))
                left.add(a)
                right.add(b)
                if a == b:
                    break
        if not chosen:
            break
        now = F.col("packed")
        for a, b in chosen:
            now = F.replace(now, F.lit(a + b), F.lit(chr(_FIRST_RULE + len(grammar))))
            grammar.append((a, b))
        packed = materialise(packed.withColumn("packed", now), "packed-sequences")
    return packed, grammar


# --- min-plus matrices -------------------------------------------------------


class Rope:
    """An audit as a tree of joined pieces; shared, never copied."""

    __slots__ = ("left", "right", "size", "code")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = len(left) + len(right)
        self.code = hash((_code(left), _code(right), self.size))

    def __len__(self) -> int:
        return self.size

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
            else:
                stack += (top.right, top.left)
        return "".join(out)


def _code(rope) -> int:
    return hash(rope) if isinstance(rope, str) else rope.code


def joined(a, b):
    return Rope(a, b) if len(a) and len(b) else a if len(a) else b


def less(a, b) -> bool:
    """Whether audit a comes before b; equal subtrees at the same place are skipped."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q or len(p) == len(q) and _code(p) == _code(q) and str(p) == str(q):
            continue
        if not isinstance(p, str) and (len(p) >= len(q) or isinstance(q, str)):
            x += (p.right, p.left)
            y.append(q)
        elif not isinstance(q, str):
            x.append(p)
            y += (q.right, q.left)
        else:
            n = min(len(p), len(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            x += [p[n:]] * (len(p) > n)
            y += [q[n:]] * (len(q) > n)
    return not x and bool(y)


# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may be the end.
STATES, FINAL = 4, (0, 3)
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
Matrix = dict  # (from, to) -> (cost, audit)


def _better(out: Matrix, at: tuple[int, int], cost: int, audit) -> None:
    old = out.get(at)
    if old is None or cost < old[0] or cost == old[0] and less(audit, old[1]):
        out[at] = (cost, audit)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for (k2, j), (more, rest) in b.items():
            if k == k2:
                old = out.get((i, j))
                if old is None or cost + more <= old[0]:
                    _better(out, (i, j), cost + more, joined(audit, rest))
    return out


def _inserts() -> Matrix:
    """Any number of inserts; no path is longer than the states are many."""
    once: Matrix = {(i, i): (0, "") for i in range(STATES)}
    for c in "ua":
        for i, j in _STEPS[c].items():
            _better(once, (i, j), INSERT, "I")
    out = once
    for _ in range(STATES):
        out = times(out, once)
    return out


INSERTS = _inserts()
IDENTITY: Matrix = {(i, i): (0, "") for i in range(STATES)}


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then one turn."""
    own, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    turn: Matrix = {(i, i): (DELETE, "D") for i in range(STATES)}
    if own != "d":
        for c in "ua":
            for i, j in _STEPS[c].items():
                _better(turn, (i, j), REROLE + more, "R")
        for i, j in _STEPS.get(own, {}).items():
            _better(turn, (i, j), KEEP + more, "K")
    return times(INSERTS, turn)


def rule_matrices(grammar: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of every symbol and rule, each from those before it."""
    known = {c: symbol_matrix(c) for c in "dsuaxSUAX"}
    for i, (a, b) in enumerate(grammar):
        known[chr(_FIRST_RULE + i)] = times(known[a], known[b])
    return known


def product(matrices: list[Matrix]) -> Matrix:
    """All in order, in a tree: factors of like size."""
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2:]
    return matrices[0] if matrices else IDENTITY


_ENTRIES = [(i, j) for i in range(STATES) for j in range(STATES)]


def _stored(m: Matrix) -> tuple[list, list]:
    return [m[e][0] if e in m else None for e in _ENTRIES], [str(m[e][1]) if e in m else None for e in _ENTRIES]


def _loaded(cost, audit) -> Matrix:
    return {e: (int(c), a) for e, c, a in zip(_ENTRIES, cost, audit) if a is not None}


def sequence_matrices(packed: DataFrame, grammar: list[tuple[str, str]]) -> DataFrame:
    """(symbols, costs, audits) of every different sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = rule_matrices(grammar)
        for frame in frames:
            rows = [_stored(product([known[c] for c in p])) for p in frame["packed"].tolist()]
            yield pd.DataFrame({"symbols": frame["symbols"], "costs": [r[0] for r in rows], "audits": [r[1] for r in rows]})

    return packed.select("symbols", "packed").mapInPandas(
        run, "symbols string, costs array<long>, audits array<string>")


def _multiplied(pieces: DataFrame, fan: int) -> DataFrame:
    """(conv, place, costs, audits) with ``fan`` neighbours made one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        costs, audits = _stored(product([_loaded(c, a) for c, a in zip(frame["costs"], frame["audits"])]))
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "place": frame["place"].iloc[:1] // fan,
                             "costs": [costs], "audits": [audits]})

    return pieces.groupBy("conv", F.floor(F.col("place") / fan)).applyInPandas(
        run, "conv string, place long, costs array<long>, audits array<string>")


def cheapest(pieces: DataFrame, rules: int = RULES, rounds: int = ROUNDS, fan: int = FAN) -> DataFrame:
    """(conv, cost, audit) of every conversation in stored ``segments``."""
    packed, grammar = re_pair(materialise(
        pieces.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences"), rules, rounds)
    matrices = materialise(sequence_matrices(packed, grammar), "sequence-matrices")
    order = Window.partitionBy("conv").orderBy("part", "number")
    placed = pieces.select("conv", (F.row_number().over(order) - 1).cast("long").alias("place"), "symbols")
    # Stored, so that both sides of the join are plain shuffles and a hot sequence can be split.
    placed = materialise(placed, "segment-places")
    whole = materialise(placed.join(matrices, "symbols").select("conv", "place", "costs", "audits"), "segment-matrices")
    longest = placed.agg(F.max("place")).first()[0] or 0
    cut = placed.filter("place = 1").select("conv")
    many, one = whole.join(cut, "conv", "left_semi"), whole.join(cut, "conv", "left_anti")
    while longest:
        many, longest = materialise(_multiplied(many, fan), "segment-matrices"), longest // fan

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            last = [times(_loaded(c, a), INSERTS) for c, a in zip(frame["costs"], frame["audits"])]
            best = []
            for m in last:
                ends: Matrix = {}
                for j in FINAL:
                    if (0, j) in m:
                        _better(ends, (0, 0), *m[0, j])
                best.append(ends[0, 0])
            yield pd.DataFrame({"conv": frame["conv"], "cost": [b[0] for b in best], "audit": [str(b[1]) for b in best]})

    return one.unionByName(many).mapInPandas(run, "conv string, cost long, audit string")


# --- the repaired conversations ----------------------------------------------


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str | None, str]]:
    """Rows of ``_with_audits`` with their edits done: (conv, role, text).

    A conversation begins with a row without a role.
    """
    edits, at, state = "", 0, 0
    for frame in frames:
        for conv, role, text, copies in zip(*(frame[c].tolist() for c in ("conv", "role", "text", "copies"))):
            if copies == 0:
                edits, at, state = text, 0, 0
                yield conv, None, ""
            for _ in range(max(copies, 1)):
                if copies:
                    edit, at = edits[at], at + 1
                    if edit != "D":
                        own = role if edit == "K" else ROLES["a" if state == 2 else "u"]
                        state = _STEPS[own[0]][state]
                        yield conv, own, text
                while edits[at:at + 1] == "I":
                    own, at = ROLES["a" if state == 2 else "u"], at + 1
                    state = _STEPS[own[0]][state]
                    yield conv, own, ""


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 4096) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str]]:
    conv, digest, begun = None, None, False
    for key, role, text in _edited(frames):
        if role is None:
            if digest is not None:
                yield conv, digest.hexdigest()
            conv, digest, begun = key, hashlib.sha256(), False
        else:
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
    if digest is not None:
        yield conv, digest.hexdigest()


def _with_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit and then its rows, in order and in one partition."""
    rows = turns.select("conv", "turn", "role", "text", "copies").unionByName(audits.select(
        "conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(0).cast("long").alias("copies")))
    return rows.repartition("conv").sortWithinPartitions(
        "conv", F.col("copies") > 0, F.col("turn").asc_nulls_first(), "role", "text")


def _key() -> Column:
    return F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")


def _audited(df: DataFrame, damaged: bool, size: int, rules: int, rounds: int, fan: int, columns: dict[str, str]):
    """The given rows, their faults, segments and audits; the last three stored."""
    rows = conversation_rows(df, **columns)
    turns = materialise(faults(damage(rows) if damaged else rows), "turn-faults")
    pieces = materialise(segments(turns, size), "segments")
    return rows, turns, pieces, materialise(cheapest(pieces, rules, rounds, fan), "audits")


def repair(df: DataFrame, damaged: bool = False, size: int = SEGMENT, rules: int = RULES, rounds: int = ROUNDS,
           fan: int = FAN, **columns: str) -> DataFrame:
    """One row per conversation of ``df``: its faults, the cheapest audit and the repair's hash.

    ``damaged`` applies ``damage`` first.  ``columns`` renames conv, turn, role and text.
    """
    rows, turns, pieces, audits = _audited(df, damaged, size, rules, rounds, fan, columns)
    hashes = _with_audits(turns, audits).mapInPandas(
        lambda frames: _frames(_digests(frames), ["conv", "repaired_sha256"]), "conv string, repaired_sha256 string")
    order = Window.partitionBy("conv").orderBy("part", "number")
    edge = F.concat(F.lag("last").over(order), F.col("first"))
    illegal = pieces.select("conv", (F.col("illegal") + F.coalesce(
        ~edge.isin(*_LEGAL), F.lit(False)).cast("long")).alias("illegal")).groupBy("conv").agg(
        F.sum("illegal").alias("illegal"))
    out = rows.select("conv").distinct()
    for part in (counts(turns), illegal, audits, hashes):
        out = out.join(part, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(_key(), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce(
        "repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repaired(df: DataFrame, damaged: bool = False, size: int = SEGMENT, rules: int = RULES, rounds: int = ROUNDS,
             fan: int = FAN, **columns: str) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves, turn by turn."""
    _, turns, _, audits = _audited(df, damaged, size, rules, rounds, fan, columns)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        place = 0
        for conv, role, text in _edited(frames):
            if role is None:
                place = 0
            else:
                yield conv, place, role, text
                place += 1

    found = _with_audits(turns, audits).mapInPandas(
        lambda frames: _frames(numbered(frames), ["conv", "place", "role", "text"]),
        "conv string, place long, role string, text string")
    return found.select(_key(), "place", "role", "text")
