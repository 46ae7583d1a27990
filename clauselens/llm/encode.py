"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

A text is cut where the tokenizer's own splitting always cuts (at single
spaces and line ends), every different piece is encoded once per task, and the pieces' bytes
are joined.  The ids are those of encoding the text in one go with the library as it
is: the name of a special token in a text becomes that token, and such a text is
encoded whole.  ``special_as_text`` takes those names for ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pieces remembered by one task, and the longest piece worth remembering.
REMEMBERED = 800_000
LONGEST_REMEMBERED = 40

# Western letters and common marks: the tokenizers here change nothing in them
# but case, and split them alike in every release of Unicode.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%$&#*|()<>-"
_ODD = re.compile(rf"[^\x20\n{_LETTERS}{_MARKS}]")
_SPACED = re.compile(rf"\x20?[{_LETTERS}]+|\x20?[{_MARKS}]+|[\x20\n]+(?![^\x20\n])|[\x20\n]+")
# The same where some words hold other characters: such a word is one piece.
_OTHER = rf"(?=[^\x20\n]*[^\x20\n{_LETTERS}{_MARKS}])[^\x20\n]+"
_SPACED_MIXED = re.compile(rf"\x20?{_OTHER}|\x20?[{_LETTERS}]+|\x20?[{_MARKS}]+|\n")
_BARE_MIXED = re.compile(rf"{_OTHER}|[{_LETTERS}]+|[{_MARKS}]+")
_BARE = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+")
_SPACED_WORD = re.compile(rf"\x20[{_LETTERS}]+").fullmatch
_BARE_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
_CUT = re.compile(r"(?<=\S)(?=[\x20\n]\S)|(?<=\S\n)(?=\S)")


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts by one tokenizer file, whole texts at a time."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A normaliser may lower a text before its special tokens are looked for.
        self.special = re.compile("|".join(map(re.escape, names)), re.I).search if names else None
        # Byte-level vocabularies keep white space inside tokens; word vocabularies drop it.
        self.keeps_space = bool(self.tokenizer.encode("a b", add_special_tokens=False).ids
                                != self.tokenizer.encode("a  b", add_special_tokens=False).ids)
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("AÉ") == "aé"
        self.plain = self.lowers or normal is None
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin a word (written with U+0120 for its space) or end one
        first, last = "\u0120", getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith(first) if self.keeps_space else bool(last) and token.endswith(last)
        self.plain = self.plain and (self.keeps_space or bool(last))
        self.known: dict[str, bytes] = {"": b""}

    def _pieces(self, text: str) -> list[str]:
        """What is encoded alone, in order."""
        if self.plain and not _ODD.search(text):
            return _SPACED.findall(text) if self.keeps_space else _BARE.findall(text.lower())
        if not self.keeps_space:
            return _BARE_MIXED.findall(text) if self.plain else text.replace("\n", " ").split(" ")
        if " ".join(text.split()) != text.replace("\n", " ") or not self.plain:
            return _CUT.split(text)
        return _SPACED_MIXED.findall(text)

    def _learn_words(self, words: list[str]) -> None:
        """Many words in one call; the ids tell where a word begins or ends."""
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            joined = "".join(part) if self.keeps_space else " ".join(part)
            got = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(got, dtype="<u4")
            if self.keeps_space:
                cuts = np.append(np.flatnonzero(self.edge[ids]), len(ids)) * 4
            else:
                cuts = np.append(0, np.flatnonzero(self.edge[ids]) + 1) * 4
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer does not mark where words begin")
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _learn(self, pieces: set[str]) -> list[str]:
        """Adds the ids of pieces; returns those that are no plain words."""
        words = []
        if self.plain:
            word = _SPACED_WORD if self.keeps_space else _BARE_WORD
            words = list(filter(word, pieces))
            self._learn_words(words)
        other = list(pieces.difference(words))
        self._learn_by_library(other)
        return other

    def _learn_by_library(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at:at + 4096]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(got.ids, dtype="<u4")
            owner = np.asarray(got.word_ids, dtype=np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)) * 4
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """One bytes value per text; null counts as empty."""
        whole = {i for i, t in enumerate(texts) if t and self.special is not None and self.special(t)}
        cut = [self._pieces(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        new = set().union(*cut).difference(self.known) if cut else set()
        unusual = self._learn(new)
        known = self.known.__getitem__
        out = [b"".join(map(known, pieces)) for pieces in cut]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        for piece in unusual:
            if len(piece) > LONGEST_REMEMBERED:
                del self.known[piece]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder that this Python worker keeps for its tasks."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, rows: int = 256,
            special_as_text: bool = False) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids) of ``docs`` (doc_id, text).

    ``part`` numbers the task and ``local_start`` counts the ids of the task's
    earlier rows, so totals per part are all that a global offset needs.  Store
    the result before using the numbers: they belong to one run.
    """
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer, special_as_text)
        for frame in frames:
            for at in range(0, len(frame), rows):
                piece = frame.iloc[at:at + rows]
                ids = [x + end for x in encoder(piece["text"].tolist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = seen + np.cumsum(n) - n
                seen += int(n.sum())
                yield pd.DataFrame({"doc_id": piece["doc_id"].array, "part": np.full(len(n), part, np.int32),
                                    "local_start": starts, "n_tokens": n, "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, part int, local_start long, n_tokens long, ids binary")


def part_bases(tokens: DataFrame) -> DataFrame:
    """(base_part, base): ids before each part; one row per part."""
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("base_part"),
                         F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
