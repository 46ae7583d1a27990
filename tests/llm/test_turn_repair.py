"""Conversation repair against a plain search over whole conversations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clauselens.llm import turn_repair

NONE = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
        "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def plain_repair(rows):
    """rows (turn, role, text) of one conversation: every (cost, audit, roles) that is cheapest so far, state by state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, found, symbols = set(), Counter(), []
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        found[fault] += 1
        symbols.append(fault)
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    names = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for c, move in steps.items():
                    if c != "s" and state in move:
                        new = (cost + 2, audit + "I", [*out, (names[c], "")])
                        if move[state] not in best or new[:2] < best[move[state]][:2]:
                            best[move[state]] = new
        return best

    best = insert({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, symbols):
        after = {}

        def put(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, out) in best.items():
            put(state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if state in steps.get(role[:1], {}):
                put(steps[role[0]][state], (cost + more, audit + "K", [*out, (role, text)]))
            for c, name in names.items():
                if state in steps[c]:
                    put(steps[c][state], (cost + 2 + more, audit + "R", [*out, (name, text)]))
        best = insert(after)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: found[k] for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def expected(rows, damaged):
    kept, out = defaultdict(list), {}
    for conv, *rest in plain_damage(rows) if damaged else [
            (c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        kept[conv].append(tuple(rest))
    for conv in {r[0] for r in rows}:
        out[conv] = plain_repair(kept[conv]) if conv in kept else NONE
    return out


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher", "User"]
    texts = ["yes.", "no", " \n", "", None, "why?\n ", "a longer one. and", "same!", "é.\x0b", "x "]
    rows = []
    for conv in [None, 2 ** 60 + 1, *range(n)]:
        for _ in range(rng.integers(1, 12)):
            turn = [None, int(rng.integers(0, 9))][rng.random() < 0.9]
            row = (conv, turn, roles[rng.choice(10, p=[.1, .3, .3, .05, .05, .05, .05, .02, .04, .04])], texts[rng.integers(0, 10)])
            rows += [row] * int(rng.choice([1, 1, 1, 2]))
    return rows


def check(got, want):
    assert Counter(r.conv_id for r in got) == Counter(list(want))
    for r in got:
        assert {k: r[k] for k in NONE} == want[r.conv_id], r.conv_id


@pytest.mark.parametrize("options", [{}, {"size": 2, "rules": 3, "rounds": 2, "fan": 2}])
def test_against_plain_search(spark, options):
    rows = random_rows(250, 3)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "conv_id long, turn long, role string, text string, conv string, copies string")
    for damaged in (False, True):
        check(turn_repair.repair(df, damaged, **options).collect(), expected(rows, damaged))


def test_long_conversation(spark):
    """One conversation of many segments, with very many copies of one turn."""
    rng = np.random.default_rng(9)
    rows = [(1, t, ["user", "assistant"][rng.integers(2)], f"turn {t}" + ".!"[t % 2] * (t % 3 > 0)) for t in range(3000)]
    rows += [(1, 7, "user", "again and again.")] * 500 + [(2, 0, "user", "alone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(turn_repair.repair(df, size=50, fan=4).collect(), expected(rows, False))
    out = turn_repair.repaired(df, size=50).orderBy("conv_id", "place").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in out if r.conv_id == 1)
    assert hashlib.sha256(text.encode()).hexdigest() == expected(rows, False)[1]["repaired_sha256"]
    assert [(r.place, r.role, r.text) for r in out if r.conv_id == 2] == [(0, "user", "alone."), (1, "assistant", "")]


def test_ropes():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        texts = ["".join(rng.choice(list("DIKR"), rng.integers(1, 9), p=[.7, .1, .1, .1])) for _ in range(2)]

        def rope(text):
            if len(text) < 2 or rng.random() < 0.2:
                return text
            at = int(rng.integers(1, len(text)))
            return turn_repair.joined(rope(text[:at]), rope(text[at:]))

        a, b = map(rope, texts)
        assert str(a) == texts[0] and turn_repair.less(a, b) == (texts[0] < texts[1])


def test_grammar_unpacks(spark):
    texts = ["uauauaua", "suauau", "ddddddddd", "u", "uadua", "uauauaua"]
    rows = [(t, n) for t, n in Counter(texts).items()]
    packed, grammar = turn_repair.re_pair(spark.createDataFrame(rows, "symbols string, n long"))
    assert grammar
    for r in packed.collect():
        out = r.packed
        for i in reversed(range(len(grammar))):
            out = out.replace(chr(0xE000 + i), "".join(grammar[i]))
        assert out == r.symbols
    assert any(len(r.packed) < len(r.symbols) for r in packed.collect())


def test_nothing(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(nothing, True).count() == 0
