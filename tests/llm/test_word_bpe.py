"""Byte-level BPE against the tiktoken library, text by text."""

import hashlib
from collections import Counter

import numpy as np
import tiktoken

from clauselens.llm import word_bpe

LONG = "word stream of many parts, " * 4000
FIXED = [None, "", " ", "\n", " \n\t  x", "it's we'll I'D 'tis", LONG, "a" * 3000, " " * 2000 + "b", "Größe ÇA 日本語 x",
         "\x1c\x1dx\x85y\u00a0\u3000z", "\u0558\u058b\uab6c \U00011de0\U0001247f1", "👩‍👩‍👧 e\u0301", "<|endoftext|>", "\x00\x00"]


def library():
    return tiktoken.Encoding("own", pat_str=word_bpe.default_pattern(),
                             mergeable_ranks=word_bpe.read_ranks(word_bpe.default_ranks()), special_tokens={})


def random_texts(n):
    rng = np.random.default_rng(5)
    letters = [*"abcé 'st.,\n\t\x1c0１二", "  ", "\n\n", "\u0558", "\u2028", "ﬀ", "'ll", " the"]
    return ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(n)]


def test_ids_are_those_of_the_library(spark):
    texts = FIXED + random_texts(1500)
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "no key", "x", "y", "z"), (5, FIXED[5], "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block string, words string").repartition(5)
    plain = library()
    # Small blocks and few shards: words of one shard come from many blocks.
    for options in ({"block_chars": 500, "shards": 7}, {}):
        got = word_bpe.encode(docs, **options).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        by_key = dict((r[0], r[1]) for r in rows)
        for r in got:
            ids = plain.encode_ordinary(by_key[r.doc_id] or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids), repr(by_key[r.doc_id])


def test_classes_are_those_of_the_library():
    """Texts that put every character between letters and blanks are cut alike."""
    import re

    plain, cut = library(), re.compile(word_bpe.portable(word_bpe.default_pattern())).findall
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for at in range(0, len(every), 4096):
        text = "".join(f"a{c} {c}1{c}{c}\n" for c in every[at:at + 4096])
        pieces = cut(text)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in plain._encode_single_piece(p)] == plain.encode_ordinary(text)


def test_decoding(spark):
    texts = FIXED + random_texts(50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in word_bpe.round_trip(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        ids = np.array(library().encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert (r.ids_sha256, r.n_tokens) == (hashlib.sha256(ids).hexdigest(), len(ids) // 4)
    bare = spark.createDataFrame([(1, None, "x")], "doc_id long, ids binary, decoded string")
    assert [r.decoded for r in word_bpe.decode(bare).collect()] == [b""]


def test_each_word_is_encoded_once(spark):
    docs = spark.createDataFrame([(i, "the same words in every text") for i in range(40)], "doc_id long, text string")
    from clauselens.llm.stores import new_folder

    folder = new_folder(spark, "test")
    rows = word_bpe.split_words(docs.repartition(4), word_bpe.default_pattern(), folder, 60, 16).collect()
    shards, blocks = {}, Counter()
    for r in rows:
        at = 0
        for n in word_bpe._wide(bytes(r.lengths)).tolist():
            word, at = bytes(r.words[at:at + n]), at + n
            blocks[word] += 1
            assert shards.setdefault(word, r.shard) == r.shard
    assert max(blocks.values()) == len({r.block for r in rows}) > 4


def test_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert word_bpe.round_trip(nothing).count() == 0
