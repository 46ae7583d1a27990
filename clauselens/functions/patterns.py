r"""Regex dialect bridge.

The fixed patterns use ``\b \w \s \d`` with Unicode meaning.  Java's shorthand
classes are ASCII unless ``(?U)`` is set, and ``(?U)\w`` also takes combining
marks, so the classes are spelled out instead.  ``(?d)`` limits line ends to
``\n``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_BODY_NO_SPACE = (
    r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WS_BODY = r"\x20" + _WS_BODY_NO_SPACE
_WORD_BODY = r"\p{L}\p{N}_"

# The same sets without nesting, for RE2.
PLAIN_WS = f"[{_WS_BODY}]"
PLAIN_NOT_WS = f"[^{_WS_BODY}]"
PLAIN_WORD = f"[{_WORD_BODY}]"

# Java looks single characters up to 0xff in one table and asks other members of a
# class one after the other; so those come singly, and the others behind one bound.
_TABLED_WS = r"\x20\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x{85}\x{a0}"
_TABLED_WORD = string.ascii_letters + string.digits + "_"
WS = f"[{_TABLED_WS}[[^\\x00-\\x{{167f}}]&&[\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]]]"
NOT_WS = f"[[!-~][^{_WS_BODY}]]"
WORD = f"[{_TABLED_WORD}[[^\\x00-\\x7f]&&[\\p{{L}}\\p{{N}}]]]"
# A whitespace run that is anything else than one plain space.  It begins with a class,
# so that Java passes over other characters without trying two branches at each.
WS_RUN_TO_COLLAPSE = f"{WS}(?:(?<=\\x20){WS}+|(?<!\\x20){WS}*)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_NOT_AFTER_WORD = f"(?<!{WORD})"


def expand_classes(pattern: str, boundary, ws: str = WS, word: str = WORD) -> str:
    r"""Spell out ``\w \s \d``; ``boundary(pattern, position)`` renders ``\b``."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "w":
                out.append(_WORD_BODY if in_class else word)
            elif n == "s":
                out.append(_WS_BODY if in_class else ws)
            elif n == "d":
                out.append(r"\p{Nd}")
            elif n == "b" and not in_class:
                out.append(boundary(pattern, i))
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


# Letters outside ASCII that are equal to one of ASCII, ignoring case.
_SAME_LETTER = {"i": r"\x{130}\x{131}", "k": r"\x{212a}", "s": r"\x{17f}"}


def _branches(body: str) -> list[str]:
    """The alternatives of a pattern, split at the bars that stand in no group or class."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(body[start:i])
            start = i + 1
        i += 1
    return [*out, body[start:]]


def _group_end(body: str) -> int:
    """Where the group that opens a pattern is closed."""
    return next(i for i in range(1, len(body)) if body[i] == ")" and len(_branches(body[: i + 1] + "|")) == 2)


def _openings(pattern: str, ignore_case: bool) -> str | None:
    """The members of a class that holds every first character of a match; null when that cannot be told."""
    found = ""
    for b in _branches(pattern):
        b = b.removeprefix(r"\b")
        if b.startswith("(") and not b.startswith(("(?=", "(?!", "(?<")):
            end = _group_end(b)
            first = _openings(b[1:end].removeprefix("?:"), ignore_case)
            rest = b[end + 1:]
            if first is not None and rest[:1] == "?":
                more = _openings(rest[1:], ignore_case)
                first = None if more is None else first + more
            elif rest[:1] in ("*", "{"):
                first = None
        elif b.startswith(r"\d"):
            first = r"\p{Nd}" if b[2:3] not in ("?", "*") and b[2:4] != "{0" else None
        else:
            c = b[1:2] if b.startswith("\\") else b[:1]
            plain = c.isalnum() if not b.startswith("\\") else c != "" and not c.isalnum()
            plain = plain or c in ("₹", "€", "£")
            after = b[2:3] if b.startswith("\\") else b[1:2]
            if not plain or after in ("?", "*", "{") or not (c.isascii() or c in "₹€£"):
                first = None
            elif c.isalpha() and ignore_case:
                first = c.lower() + c.upper() + _SAME_LETTER.get(c.lower(), "")
            else:
                first = "\\" + c if not c.isalnum() and c.isascii() else c
        if first is None:
            return None
        found += first
    return found


def _java_boundary(pattern: str, at: int) -> str:
    following = pattern[at + 2:].lstrip("(").removeprefix("?:")
    starts_a_word = following[:1].isalnum() or following[:2] == r"\d"
    return _NOT_AFTER_WORD if at == 0 and starts_a_word else _BOUNDARY


def java_regex(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    """The pattern for Java, behind a look at the first character where only some can begin a match.

    Most places of a text fail there, before boundaries and branches are tried.
    """
    flags = "d" + ("iu" if ignore_case else "") + ("s" if dot_all else "")
    first = _openings(pattern, ignore_case) if pattern.startswith((r"\b", "(", r"\d")) else None
    look = f"(?=(?-iu:[{first}]))" if first else ""
    body = expand_classes(pattern, _java_boundary)
    return f"(?{flags})" + (f"{look}(?:{body})" if look else body)


def quote(text: str) -> str:
    r"""Literal text as a Java regex (``\E`` inside the text is handled)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def starts_word(text: str) -> str:
    """Java regex for ``text`` with a word boundary before it."""
    head = text[:1]
    edge = _NOT_AFTER_WORD if head.isalnum() or head == "_" else f"(?<={WORD})"
    # The text first, for which Java searches fast; the edge is looked at where it stands.
    return f"(?d){quote(text)}(?<={edge}{quote(text)})"


def first_group(col: Column, regex: str, group: int = 1) -> Column:
    """A group of the first match, null when the pattern does not match.

    The group must not be able to match nothing; so one run of the regex tells.
    """
    return F.nullif(F.regexp_extract(col, regex, group), F.lit(""))


def all_matches(col: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(regex), F.lit(group))
