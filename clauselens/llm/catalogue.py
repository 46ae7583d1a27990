"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.llm import (
    ans, contextual_pii, hard_negatives, ordinal, packing, quality_rules, tag_paths, tiling, token_counts,
    turn_repair, vptree, warc, word_bpe,
)
from clauselens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_token_counts")
def op1(s, d):
    return token_counts.length_histogram(token_counts.token_lengths(table(s, d, "documents")))


@query("op2_quality_rules")
def op2(s, d):
    return quality_rules.judge_quality(table(s, d, "documents"), table(s, d, "labels"))


@query("op3_string_tiling")
def op3(s, d):
    found = tiling.contaminated(table(s, d, "documents"), table(s, d, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_tiles", "covered", "coverage")


@query("op4_ordinal_quality")
def op4(s, d):
    labels = table(s, d, "labels")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    docs = table(s, d, "documents")
    return ordinal.select_by_grade(ordinal.score(docs, ordinal.fit_on(docs, ratings))).select(
        "doc_id", F.round("expected_grade", 6).alias("expected_grade"),
        F.round("tail_probability", 6).alias("tail_probability"), "kept")


@query("op5_packing")
def op5(s, d):
    return packing.piece_digests(packing.pack(table(s, d, "documents")))


@query("op6_tag_paths")
def op6(s, d):
    return tag_paths.extract_text(table(s, d, "pages"))


@query("op7_ans_archive")
def op7(s, d):
    return ans.document_digests(ans.round_trip(table(s, d, "documents")))


# Base32 of a SHA-1: eight groups of five hexadecimal digits, four letters of five bits from each.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(sha, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1) for i in range(32)], '')"""


@query("op8_warc_bundles", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM l""")
def op8(s, d):
    return warc.round_trip(table(s, d, "pages")).drop("payload", "url")


@query("op9_contextual_pii")
def op9(s, d):
    return contextual_pii.private_data(table(s, d, "documents"))


@query("op10_simhash_vptree")
def op10(s, d):
    found = vptree.near_duplicates(table(s, d, "documents"))
    return found.select("doc_id", vptree.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query("op11_turn_repair")
def op11(s, d):
    return turn_repair.repair(table(s, d, "conversations"), damaged=True)


@query("op12_word_bpe")
def op12(s, d):
    return word_bpe.round_trip(table(s, d, "documents"))


@query("op13_hard_negatives", """
WITH w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM w WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, w.vec_id, a.label = w.label AS same,
  list_sum(list_transform(list_zip(a.v, w.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM a JOIN w ON a.vec_id <> w.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER n::INTEGER AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW n AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER n <= 10""")
def op13(s, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(s, d, "embeddings"), F.col("vec_id") % 100 == 0, label)
