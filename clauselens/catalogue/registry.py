"""Every operator as a query over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.catalogue import fixtures as fx
from clauselens.catalogue import sql as q
from clauselens.functions import text as tx
from clauselens.functions.entities import key_entities
from clauselens.operators import clauses as cl
from clauselens.operators import locate as loc
from clauselens.operators import maintenance as mt
from clauselens.operators import matching as ma
from clauselens.operators import prompts as pr
from clauselens.operators import rules as ru
from clauselens.operators import scoring as sc
from clauselens.operators import vectors as ve
from clauselens.operators.chunking import chunk
from clauselens.plans import difference as di
from clauselens.plans import portfolio as pf
from clauselens.plans import report as rp
from clauselens.plans import scored as so
from clauselens.session import checkpoint_dir
from clauselens.sources import files, pages, tables
from clauselens.streaming import incremental as inc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- shared pieces ---------------------------------------------------------


def _chunks(s, d):
    return chunk(fx.contracts(s, d), single_page=True)


def _page_chunks(s, d):
    return chunk(fx.contract_pages(s, d))


def _raw(s, d):
    return rp.raw_clauses(_chunks(s, d), fx.rules(s))


def _collapsed(s, d):
    return cl.collapse_clauses(_raw(s, d))


def _analysis(s, d, **kw):
    return rp.analyse(fx.contracts(s, d), fx.rules(s), single_page=True, **kw)


def _page_analysis(s, d):
    return rp.analyse(fx.contract_pages(s, d), fx.rules(s))


def _with_ids(df):
    return rp.clause_ids(df)


def _when_page(df):
    at = F.pmod("chunk_index", F.lit(3))
    return df.withColumn("page_number", F.when(at == 0, F.col("page_number"))
                         .when(at == 1, F.col("page_number") + 50).otherwise(1).cast("int"))


def _block_clauses(s, d):
    """Stored clauses, as the operators on clauses expect them."""
    made = _when_page(_with_ids(rp.raw_clauses(_page_chunks(s, d), fx.rules(s))))
    return tables.materialise(made, "block-clauses")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_CLAUSE = ["doc_id", "chunk_index", "rule_id", "category", "clause_text", "risk_level",
           "confidence_score", "page_number"]
_CLAUSE_SQL = "SELECT {} FROM {{}}".format(", ".join(_CLAUSE))
_REPORT = ["doc_id", "overall_risk", "composite_risk_score", "total_risks_found"]
_REPORT_SQL = "SELECT {} FROM {{}}".format(", ".join(_REPORT))

# --- sources (S) -----------------------------------------------------------


@query("s1_load", q.build("SELECT rule_id, category, default_risk_level, keywords, is_active FROM tenant_rules", "tenant_rules"))
def s1(s, d):
    """A stored table, read back with its declared schema."""
    base = f"{checkpoint_dir(s)}/s1-{uuid.uuid4().hex}"
    fx.tenant_rules(s, d).write.parquet(f"{base}/risk_rules_config")
    return tables.load(s, base, "risk_rules_config").select(
        "rule_id", "category", "default_risk_level", "keywords", "is_active")


@query("s2_read_files", """
SELECT coalesce(source, '') AS source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, count(*) AS lines
FROM (SELECT source, replace(text, chr(10), ' ') AS text FROM documents) GROUP BY 1""")
def s2(s, d):
    """Documents written as files of up to 1,000 lines in a folder of each source, read back as binary files."""
    base = f"{checkpoint_dir(s)}/s2-{uuid.uuid4().hex}"
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line")
    fx.table(s, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), line).write.partitionBy(
        "source").option("maxRecordsPerFile", 1000).text(base)
    folder = F.regexp_extract("path", "/source=([^/]*)/", 1)
    breaks = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\n]", ""))
    return files.read_files(s, base, "*.txt").groupBy(
        F.when(folder == "__HIVE_DEFAULT_PARTITION__", "").otherwise(folder).alias("source")).agg(
        F.sum("file_size_bytes").alias("bytes"), F.sum(breaks).alias("lines"))


@query("s9_replace", """
SELECT doc_id, source, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1000000 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 6 <> 0""")
def s9(s, d):
    """A third of the documents replaced in a stored table, half of these by nothing; done twice, which changes nothing."""
    path = f"{checkpoint_dir(s)}/s9-{uuid.uuid4().hex}"
    rows = fx.table(s, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    again = rows.filter("doc_id % 3 = 0")
    tables.write_results(rows, path, rows, buckets=16)
    for _ in range(2):
        tables.write_results(
            again.filter("doc_id % 6 <> 0").withColumn("n_chars", F.col("n_chars") + 1000000), path, again, buckets=16)
    return tables.read_results(s, path, rows.schema)


@query("s3_ingest_gate", q.build("""
SELECT doc_id, CASE WHEN contains(original_filename, '.') THEN upper(string_split(original_filename, '.')[-1]) ELSE '' END AS file_type,
  CASE WHEN doc_id % 4 = 3 THEN 'unsupported format' WHEN file_size_bytes > 52428800 THEN 'too large'
    WHEN file_size_bytes = 0 THEN 'empty file' END AS reason FROM uploads""", "uploads"))
def s3(s, d):
    return files.check_upload(fx.uploads(s, d)).select("doc_id", "file_type", "reason")


@query("s4_exact_duplicates", """
SELECT file_hash_sha256, copies, first_doc_id FROM (SELECT sha256(text) AS file_hash_sha256, count(*) AS copies,
  min(doc_id) AS first_doc_id FROM documents GROUP BY 1) WHERE copies > 1""")
def s4(s, d):
    return files.exact_duplicates(files.fingerprint(fx.table(s, d, "documents"), "text"))


@query("s5_assemble_pages", q.build("""
SELECT doc_id, count(*) AS pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_number)) AS text_md5
FROM contract_pages GROUP BY doc_id""", "contract_pages"))
def s5(s, d):
    return pages.assemble_pages(fx.contract_pages(s, d)).select(
        "doc_id", F.col("pages").cast("long").alias("pages"), F.md5("full_text").alias("text_md5"))


def _layers(s, d):
    t, i = F.col("text"), F.col("page_number")
    return fx.contract_pages(s, d).select(
        "doc_id", "page_number",
        F.when(i % 4 == 0, "").when(i % 4 == 1, F.substring(t, 1, 40)).otherwise(t).alias("direct_text"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, F.substring(t, 1, 20)).otherwise(F.reverse(t)).alias("ocr_text"),
        F.when(i % 5 == 0, 0.0).otherwise(93.5).alias("area_sqin"),
        F.when(i % 2 == 0, 0.1).otherwise(0.35).alias("image_ratio"))


@query("s6_merge_text_layers", q.build(f"""
SELECT doc_id, page_number, text FROM (
  SELECT doc_id, page_number, {q.clean("CASE WHEN o = '' THEN d WHEN d = '' THEN o WHEN contains(d, o) THEN d ELSE d || chr(10) || chr(10) || o END")} AS text
  FROM (SELECT doc_id, page_number, d, CASE WHEN length(d) / greatest(a, 0.01) < 6 OR r >= 0.35 THEN o ELSE '' END AS o FROM (
    SELECT doc_id, page_number,
      {q.clean("CASE WHEN page_number % 4 = 0 THEN '' WHEN page_number % 4 = 1 THEN text[1:40] ELSE text END")} AS d,
      {q.clean("CASE WHEN page_number % 3 = 0 THEN '' WHEN page_number % 3 = 1 THEN text[1:20] ELSE reverse(text) END")} AS o,
      CASE WHEN page_number % 5 = 0 THEN 0.0 ELSE 93.5 END AS a, CASE WHEN page_number % 2 = 0 THEN 0.1 ELSE 0.35 END AS r
    FROM contract_pages))) WHERE text <> ''""", "contract_pages"))
def s6(s, d):
    return pages.merge_text_layers(_layers(s, d))


@query("s7_flatten_rows", f"""
SELECT o_orderkey AS doc_id, array_to_string(list_filter([trim(o_orderpriority), o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END],
  lambda c: c <> ''), ' | ') AS line FROM orders""")
def s7(s, d):
    cells = F.array(F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n")), F.col("o_orderstatus"), F.lit(" "),
                    F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""))
    rows = fx.table(s, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("row_number"), cells.alias("cells"))
    return pages.flatten_rows(rows).select("doc_id", "line")


@query("s10_export_reports", q.build("""
SELECT doc_id, 0 AS part, overall_risk, total_risks_found, coalesce(clauses, '') AS clauses FROM reports LEFT JOIN (
  SELECT doc_id, string_agg(category || '@' || page_number, '|' ORDER BY chunk_index, rule_id) AS clauses
  FROM collapsed GROUP BY doc_id) USING (doc_id)""", "reports"))
def s10(s, d):
    a = _analysis(s, d)
    nested = tables.export_reports(a.reports, a.clauses)
    return nested.select("doc_id", "part", "overall_risk", "total_risks_found", F.array_join(F.transform(
        "risk_clauses", lambda c: F.concat(c["category"], F.lit("@"), c["page_number"].cast("string"))), "|").alias("clauses"))


# --- text (T) --------------------------------------------------------------


@query("t1_t3_clean_text", q.build(f"SELECT doc_id, {q.clean('text')} AS text FROM noisy", "noisy"))
def t123(s, d):
    return fx.noisy_texts(s, d).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("t4_normalise", q.build(f"SELECT doc_id, {q.norm('text')} AS text FROM contracts", "contracts"))
def t4(s, d):
    return fx.contracts(s, d).select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query("t5_sentences", q.build(f"""
SELECT doc_id, CAST(len(x) AS BIGINT) AS n, array_to_string(x, '|') AS joined
FROM (SELECT doc_id, {q.sentences('text')} AS x FROM contracts)""", "contracts"))
def t5(s, d):
    x = tx.sentences(F.col("text"))
    return fx.contracts(s, d).select("doc_id", x.alias("x")).select(
        "doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("joined"))


@query("t6_t7_line_kinds", q.build(f"""
SELECT doc_id, page_number, count(*) AS lines, count(*) FILTER (WHERE regexp_matches({q.strip('text')}, {q._heading})) AS headings,
  count(*) FILTER (WHERE {q._footer}) AS footers FROM blocks GROUP BY ALL""", "blocks"))
def t67(s, d):
    return fx.blocks(fx.contract_pages(s, d)).groupBy("doc_id", "page_number").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(tx.is_heading(F.col("text"))).alias("headings"),
        F.count_if(tx.is_footer(F.col("text"))).alias("footers"))


@query("t8_jaccard", f"""
SELECT a.doc_id, round({q.jaccard('a.t', 'b.t')}, 6) AS similarity
FROM (SELECT doc_id, {q.tokens('text')} AS t FROM documents) a JOIN (SELECT doc_id, {q.tokens('text')} AS t FROM documents) b
  ON b.doc_id = a.doc_id + 1""")
def t8(s, d):
    sets = fx.texts(s, d, "documents").select("doc_id", tx.token_set(F.col("text")).alias("a"))
    nxt = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return sets.join(nxt, "doc_id").select(
        "doc_id", F.round(tx.jaccard_of_sets(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("t9_clip", q.build(f"SELECT doc_id, text[1:{fv.SUMMARY_PROMPT_CHARS}] AS start FROM contracts", "contracts"))
def t9(s, d):
    return fx.contracts(s, d).select("doc_id", tx.clip(F.col("text"), fv.SUMMARY_PROMPT_CHARS).alias("start"))


# --- chunks and entities (C, E) --------------------------------------------

_CHUNK_SQL = "SELECT doc_id, chunk_index, CAST(page_number AS INTEGER) AS page_number, chunk_text, token_count FROM {}"


@query("c1_c3_chunks", q.build(_CHUNK_SQL.format("chunks"), "chunks"))
def c1(s, d):
    return _chunks(s, d)


@query("c2_page_chunks", q.build(_CHUNK_SQL.format("pchunks"), "pchunks"))
def c2(s, d):
    return _page_chunks(s, d)


@query("c2_odd_page_numbers", q.build("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) - 1 AS INTEGER) AS chunk_index, page_number, chunk_text
FROM (SELECT conv_id AS doc_id, turn, page_number, i,
    CASE WHEN len(w) <= 20 THEN page ELSE array_to_string(w[i * 10 + 1 : i * 10 + 20], ' ') END AS chunk_text
  FROM (SELECT *, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 20 THEN [0]
      ELSE range(0, CAST(ceil((len(w) - 20) / 10.0) AS BIGINT) + 1) END) AS i
    FROM (SELECT conv_id, turn, CAST(CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE turn END AS INTEGER) AS page_number,
      """ + q.strip("text") + " AS page, " + q.words("text") + """ AS w FROM conversations)))"""))
def c2_odd(s, d):
    """Null and repeated page numbers, with a column of its own for the order."""
    at = F.pmod("turn", F.lit(3))
    pages = fx.texts(s, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", "text",
        F.when(at == 1, 7).when(at == 2, F.col("turn")).cast("int").alias("page_number"))
    return chunk(pages, 20, 10, order="turn").select("doc_id", "chunk_index", "page_number", "chunk_text")


@query("c1_small_windows", q.build(f"""
SELECT doc_id, i AS chunk_index,
  CASE WHEN len(w) <= 20 THEN {q.strip('text')} ELSE array_to_string(w[i * 10 + 1 : i * 10 + 20], ' ') END AS chunk_text FROM (
  SELECT doc_id, text, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 20 THEN [0]
    ELSE range(0, CAST(ceil((len(w) - 20) / 10.0) AS BIGINT) + 1) END) AS i
  FROM (SELECT doc_id, text, {q.words('text')} AS w FROM documents))"""))
def c1_small(s, d):
    docs = fx.texts(s, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return chunk(docs, 20, 10, single_page=True).select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


def _entity_columns(df, e):
    lists = ("parties", "effective_dates", "monetary_amounts")
    return df.select("doc_id", *[
        (F.array_join(e[n], "|") if n in lists else e[n]).alias(n)
        for n in ("parties", "effective_dates", "governing_law", "jurisdiction", "monetary_amounts")])


_ENTITY_SQL = ", ".join(f"{x} AS {n}" for n, x in q.entities("text").items())


@query("e1_e7_entities", q.build(f"SELECT doc_id, {_ENTITY_SQL} FROM contracts", "contracts"))
def e17(s, d):
    df = fx.contracts(s, d).select("doc_id", key_entities(F.col("text")).alias("e"))
    return _entity_columns(df, F.col("e"))


@query("e7_page_entities", q.build(f"""
SELECT doc_id, {_ENTITY_SQL} FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text
  FROM contract_pages GROUP BY doc_id)""", "contract_pages"))
def e7(s, d):
    ok, _ = rp.document_entities(fx.contract_pages(s, d))
    return _entity_columns(ok, F.col("key_entities"))


# --- rules and matching (R1-R12) -------------------------------------------


@query("r1_resolve_rules", q.build(
    f"SELECT rule_id, category, {q.definition_key('category')} AS def_key FROM tenant_rules", "tenant_rules"))
def r1(s, d):
    return ru.resolve_rules(fx.tenant_rules(s, d)).select("rule_id", "category", "def_key")


@query("r2_keywords", q.build(f"""
SELECT rule_id, CAST(i - 1 AS INTEGER) AS position, k[i] AS keyword FROM (
  SELECT rule_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT rule_id, {q.keyword_list('keywords')} AS k FROM tenant_rules))""",
  "tenant_rules"))
def r2(s, d):
    return ru.explode_keywords(fx.tenant_rules(s, d))


_HIT_SQL = "SELECT doc_id, chunk_index, rule_id, evidence FROM {}"
_HIT = ["doc_id", "chunk_index", "rule_id", "evidence"]


@query("r3_r7_hits", q.build(_HIT_SQL.format("hits"), "hits"))
def r7(s, d):
    return ma.match_rules(_chunks(s, d), fx.rules(s)).select(*_HIT)


@query("r7_hits_by_join", q.build(_HIT_SQL.format("phits"), "phits"))
def r7_join(s, d):
    return ma.match_rules_by_join(_page_chunks(s, d), fx.rules(s)).select(*_HIT)


@query("r7_hits_many_rules", q.build(_HIT_SQL.format("many_hits"), "many_hits"))
def r7_many(s, d):
    # Each text has many hits here, so a few large tasks would leave cores idle at the end.
    chunks = chunk(fx.contracts(s, d, least=3), single_page=True)
    return ma.match_rules(chunks, fx.many_rules(s, d)).select(*_HIT)


@query("r8_r9_threshold", q.build(
    "SELECT doc_id, chunk_index, rule_id, evidence, confidence_score FROM lkept_hits", "lkept_hits"))
def r89(s, d):
    hits = ma.match_rules(_chunks(s, d), fx.rules(s)).drop("page_number")
    return ma.apply_threshold(ma.merge_labels(hits, fx.model_labels(s, d), fx.rules(s)), fx.rules(s)) \
        .select(*_HIT, "confidence_score")


@query("r10_model_candidates", q.build("""
SELECT doc_id, chunk_index, matched FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, matched ORDER BY chunk_index) AS r FROM (
    SELECT c.doc_id, c.chunk_index, token_count, h.doc_id IS NOT NULL AS matched FROM chunks c
    LEFT JOIN (SELECT DISTINCT doc_id, chunk_index FROM hits) h ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index)
  WHERE matched OR token_count >= 30)""", "hits"))
def r10(s, d):
    chunks = _chunks(s, d)
    return ma.model_candidates(chunks, ma.match_rules(chunks, fx.rules(s))).select(
        "doc_id", "chunk_index", "matched")


@query("r11_merge_labels", q.build("SELECT doc_id, chunk_index, rule_id, evidence, confirmed FROM merged", "merged"))
def r11(s, d):
    hits = ma.match_rules(_chunks(s, d), fx.rules(s)).drop("page_number")
    return ma.merge_labels(hits, fx.model_labels(s, d), fx.rules(s)).select(*_HIT, "confirmed")


def _responses(s, d):
    """Answers as a model might give them: fenced, plain, broken, no list."""
    i = F.col("doc_id")
    answers = ('```json\n["Indemnity", "Nope"]\n```', '["Arbitration","Termination","Force Majeure"]', "I am not sure.",
               '{"a": 1}', " [] ", "```[\"Switched Off\"]```")
    return fx.table(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), fx._pick(answers, i).alias("response"))


@query("r12_parse_labels", """
SELECT doc_id, (['Indemnity', 'Arbitration|Force Majeure', NULL, NULL, '', ''])[doc_id % 6 + 1] AS categories FROM documents""")
def r12(s, d):
    return ma.parse_labels(_responses(s, d), fx.rules(s)).select(
        "doc_id", F.array_join("categories", "|").alias("categories"))


_START = 200


def _around(s, d, value):
    """One JSON value for each document, as models give them: fenced, plain, or with something behind it."""
    n = F.col("doc_id") % 6
    tail = F.regexp_extract("text", r"^\S*", 0)
    response = F.when(n == 0, F.concat(F.lit("```json\n"), value, F.lit("\n```"))).when(n == 1, value).when(
        n == 2, F.concat(value, F.lit("} "), tail)).when(n == 3, F.concat(value, F.lit('}{"v":'), value)).when(
        n == 4, F.concat(value, F.lit(", "), value)).otherwise(F.concat(value, F.lit("]")))
    return fx.table(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text", response.alias("response"))


@query("r12_label_texts", f"""
SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN md5(text[1:{_START}]) END AS named,
  CASE WHEN doc_id % 6 < 2 THEN 'Indemnity|Arbitration' END AS categories FROM documents""")
def r12_texts(s, d):
    """Categories stand around the start of a document, with whatever quotes and brackets it has."""
    answers = _around(s, d, F.to_json(F.array(F.lit("Indemnity"), F.substring("text", 1, _START), F.lit("Arbitration"))))
    named = answers.select("doc_id", F.md5(F.get(ma.parse_label_array(F.col("response")), F.lit(1))).alias("named"))
    read = ma.parse_labels(answers, fx.rules(s)).select("doc_id", F.array_join("categories", "|").alias("categories"))
    return named.join(read, "doc_id")


@query("b5_advice_texts", f"""
SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN md5(text[1:{_START}]) END AS advice FROM documents""")
def b5_texts(s, d):
    answers = _around(s, d, F.to_json(F.create_map(F.lit("Indemnity"), F.substring("text", 1, _START))))
    return pr.parse_advice(answers).select("doc_id", F.md5(F.element_at("advice", "Indemnity")).alias("advice"))


# --- clauses, scores, reports (R13-R23) ------------------------------------


@query("r13_r14_clauses", q.build(
    "SELECT doc_id, chunk_index, rule_id, category, clause_text, explanation, risk_level, rule_weight, confidence_score, "
    "CAST(page_number AS INTEGER) AS page_number, evidence FROM clauses", "clauses"))
def r14(s, d):
    return _raw(s, d)


@query("r15_collapse", q.build(_CLAUSE_SQL.format("collapsed"), "collapsed"))
def r15(s, d):
    return _collapsed(s, d).select(*_CLAUSE)


@query("r15_collapse_pages", q.build(_CLAUSE_SQL.format("pcollapsed"), "pcollapsed"))
def r15_pages(s, d):
    return cl.collapse_clauses(rp.raw_clauses(_page_chunks(s, d), fx.rules(s))).select(*_CLAUSE)


@query("r15_collapse_large")
def r15_large(s, d):
    """All turns of all conversations as clauses of one category in one document."""
    turns = fx.table(s, d, "conversations")
    rows = turns.select(
        F.lit(1).cast("long").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("place"),
        "conv_id", "turn", "text")
    clauses = rows.select(
        "doc_id", (F.col("conv_id") * 1000 + F.col("place")).cast("int").alias("chunk_index"), F.lit(1).alias("rule_id"),
        F.lit("Turn").alias("category"), F.col("text").alias("clause_text"), F.lit("").alias("explanation"),
        F.lit("Low").alias("risk_level"), F.lit(1.0).alias("rule_weight"),
        F.when(F.col("turn") % 2 == 0, 0.88).otherwise(0.78).alias("confidence_score"),
        (F.col("turn") + 1).cast("int").alias("page_number"))
    return cl.collapse_in_pieces(clauses).select("chunk_index", "page_number", "clause_text", "confidence_score")


@query("r16_scores", q.build(_REPORT_SQL.format("reports"), "reports"))
def r16(s, d):
    return sc.score_documents(fx.contracts(s, d).select("doc_id"), _collapsed(s, d)).select(*_REPORT)


@query("r17_curated_advice", q.build(
    f"SELECT rule_id, category, {q.curated('category')} AS recommendation FROM tenant_rules", "tenant_rules"))
def r17(s, d):
    return sc.curated_advice(fx.tenant_rules(s, d)).select("rule_id", "category", "recommendation")


def _advice_texts(s, d):
    i = F.col("doc_id")
    answers = ('```json\n{"Indemnity": "Cap it.", "arbitration": "Pick a seat."}\n```', '{"Indemnity": ""}', "no idea", '["x"]',
               '{"ARBITRATION": "", "arbitration": "Too late."}')
    return fx.table(s, d, "documents").select("doc_id", fx._pick(answers, i).alias("response"))


@query("r18_choose_advice", q.build(f"""
SELECT doc_id, chunk_index, rule_id, CASE
  WHEN category = 'Indemnity' AND doc_id % 5 = 0 THEN 'Cap it.' WHEN category = 'Arbitration' AND doc_id % 5 = 0 THEN 'Pick a seat.'
  ELSE {q.curated('category')} END AS recommendation FROM clauses""", "clauses"))
def r18(s, d):
    advice = pr.parse_advice(_advice_texts(s, d)).select("doc_id", "advice")
    return sc.choose_advice(_raw(s, d), advice).select("doc_id", "chunk_index", "rule_id", "recommendation")


@query("r19_summary", q.build("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A model text.' ELSE 'Summary of ' || original_filename || ': Legal agreement containing '
  || n || ' clause sections.' END AS executive_summary
FROM uploads JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)""", "uploads", "chunks"))
def r19(s, d):
    counts = _chunks(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    model = fx.table(s, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "A model text.").alias("response"))
    return sc.summary(fx.uploads(s, d), counts, model).select("doc_id", "executive_summary")


@query("r20_simulate", q.build(f"""
SELECT doc_id, category, default_risk_level AS risk_level, evidence AS evidence_type, confidence_score,
  confidence_score >= confidence_threshold AS passed_threshold, clause_text AS snippet
FROM ({q.snippet('(SELECT *, ' + q.confidence('false') + ' AS confidence_score FROM shits)', 'ssentenced', 'srules')})""",
  "shits", "ssentenced"))
def r20(s, d):
    return rp.simulate(fx.contracts(s, d), fx.rules(s), fx.OVERRIDE).select(
        "doc_id", "category", "risk_level", "evidence_type", "confidence_score", "passed_threshold", "snippet")


def _report_columns(a):
    e = F.col("key_entities")
    return a.reports.select(
        *_REPORT, F.array_join(e["parties"], "|").alias("parties"), e["governing_law"].alias("governing_law"))


def _full_sql(pre, source):
    return (f"SELECT {', '.join(_REPORT)}, e.parties, e.governing_law FROM {pre}reports r "
            f"JOIN (SELECT doc_id, {_ENTITY_SQL} FROM {source}) e USING (doc_id)")


@query("r21_reports", q.build(_full_sql("", "contracts"), "reports"))
def r21(s, d):
    return _report_columns(_analysis(s, d))


def _completed(s, d):
    """The end of an analysis in which every tenth document is blank, with a model's summary for every third."""
    i = F.col("doc_id")
    pages = fx.contracts(s, d).withColumn("text", F.when(i % 10 == 3, " ").otherwise(F.col("text")))
    texts = fx.table(s, d, "documents").filter(i % 3 == 0).select("doc_id", F.lit("A model text.").alias("response"))
    return rp.complete(rp.analyse(pages, fx.rules(s), single_page=True), fx.uploads(s, d), texts,
                       at=F.lit("2024-05-01 00:00:00"), seconds=F.lit(2.5))


@query("r21_complete_reports", q.build(f"""
SELECT {', '.join(_REPORT)}, CASE WHEN doc_id % 3 = 0 THEN 'A model text.' ELSE 'Summary of ' || original_filename
  || ': Legal agreement containing ' || n || ' clause sections.' END AS executive_summary, 2.5::DOUBLE AS processing_time_seconds,
  '2024-05-01 00:00:00' AS completed_at
FROM reports JOIN uploads USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)
WHERE doc_id % 10 <> 3""", "reports", "uploads", "chunks"))
def r21_complete(s, d):
    return _completed(s, d).reports.select(
        *_REPORT, "executive_summary", "processing_time_seconds", _stamp("completed_at").alias("completed_at"))


@query("r21_document_states", f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN doc_id % 10 = 3 THEN {q.text(fv.EMPTY_TEXT_MESSAGE)} END AS error_message FROM documents""")
def r21_states(s, d):
    return _completed(s, d).documents.select("doc_id", "status", "error_message")


@query("r21_labelled_reports", q.build(_REPORT_SQL.format("lreports"), "lreports"))
def r21_labels(s, d):
    return _analysis(s, d, labels=fx.model_labels(s, d)).reports.select(*_REPORT)


@query("r21_page_reports", q.build(_full_sql(
    "p", "(SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM contract_pages GROUP BY doc_id)"),
    "preports"))
def r21_pages(s, d):
    return _report_columns(_page_analysis(s, d))


@query("r21_page_clauses", q.build("SELECT doc_id, chunk_index, rule_id, clause_text, page_number, recommendation FROM pcollapsed",
                                   "pcollapsed"))
def r21_clauses(s, d):
    return _page_analysis(s, d).clauses.select(
        "doc_id", "chunk_index", "rule_id", "clause_text", "page_number", "recommendation")


@query("r22_reanalyse", q.build("""
SELECT doc_id, new_risk, new_score, old_risk, old_score FROM (
  SELECT doc_id, overall_risk AS new_risk, composite_risk_score AS new_score,
    (['High', 'Medium', 'Low'])[doc_id % 3 + 1] AS old_risk, CAST(doc_id % 7 AS DOUBLE) AS old_score FROM preports)
WHERE new_risk <> old_risk OR new_score <> old_score""", "preports"))
def r22(s, d):
    i = F.col("doc_id")
    old = fx.contract_pages(s, d).select("doc_id").distinct().select(
        "doc_id", fx._pick(("High", "Medium", "Low"), i).alias("overall_risk"),
        (i % 7).cast("double").alias("composite_risk_score"))
    return rp.reanalyse(_page_chunks(s, d), fx.rules(s), old)[1].select(
        "doc_id", "new_risk", "new_score", "old_risk", "old_score")


def _older_rules(rules):
    """The rules as they stood before four of them were changed: keywords, weight, one switched on, one off."""
    i = F.col("rule_id")
    return (
        rules.withColumn("keywords", F.when(i == 1, "the, rent").otherwise(F.col("keywords")))
        .withColumn("weight", F.when(i == 2, 7.5).otherwise(F.col("weight")))
        .withColumn("is_active", F.when(i == 100, False).when(i == 106, True).otherwise(F.col("is_active")))
    )


@query("r22_delta", q.build(_REPORT_SQL.format("preports"), "preports"))
def r22_delta(s, d):
    """New reports after a change of four rules, from the old hits and reports; the SQL is a full run."""
    rules, chunks = fx.rules(s), tables.materialise(_page_chunks(s, d), "chunks")
    old = _older_rules(rules)
    previous = tables.materialise(rp.reports_from_chunks(chunks, old)[1], "reports")
    return di.reanalyse_changed(chunks, di.match_all(chunks, old), old, rules, previous)[0].select(*_REPORT)


@query("r23_failures", f"""
SELECT doc_id, 'failed' AS status, {q.text(fv.EMPTY_TEXT_MESSAGE)} AS error_message FROM documents WHERE doc_id % 10 = 3""")
def r23(s, d):
    blanked = fx.table(s, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 10 == 3, " \n\t ").otherwise(F.col("text")).alias("text"))
    return rp.split_failures(blanked)[1]


# --- prompts (B) -----------------------------------------------------------

@query("b1_classify_prompts", q.build(f"SELECT doc_id, chunk_index, {q.CLASSIFY} AS prompt FROM pchunks", "pchunks", "rules"))
def b1(s, d):
    return pr.classify_prompts(_page_chunks(s, d), fx.rules(s))


def _b2_sql(clauses):
    return f"""
SELECT doc_id, {q.prompt(pr.ADVICE_TEMPLATE, clauses='lines')} AS prompt FROM (
  SELECT doc_id, string_agg('- Category: "' || category || '" | Excerpt: "' || {q.strip("replace(clause_text, chr(10), ' ')")} || '"',
    chr(10) ORDER BY r) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, rule_id) AS r FROM {clauses}) GROUP BY doc_id)"""


@query("b2_advice_prompts", q.build(_b2_sql("clauses"), "clauses"))
def b2(s, d):
    return pr.advice_prompts(_raw(s, d))


@query("b3_summary_prompts", q.build(
    f"SELECT doc_id, {q.prompt(pr.SUMMARY_TEMPLATE, passage='text')} AS prompt FROM contracts", "contracts"))
def b3(s, d):
    return pr.summary_prompts(fx.contracts(s, d))


def _stub(prompts):
    """A stand-in for a model: fails on prompts of even length."""
    import pandas as pd

    def one(p):
        if len(p) % 2 == 0:
            raise ValueError("even")
        return f"<think>hm\n</think> {len(p)}"

    return pd.Series([one(p) for p in prompts])


@query("b4_score_prompts", q.build(f"""
SELECT doc_id, CASE WHEN length(p) % 2 = 1 THEN CAST(length(p) AS VARCHAR) END AS response, CASE WHEN length(p) % 2 = 0 THEN 'even' END AS error
FROM (SELECT doc_id, {q.prompt(pr.SUMMARY_TEMPLATE, passage='text')} AS p FROM contracts)""", "contracts"))
def b4(s, d):
    return pr.score_prompts(pr.summary_prompts(fx.contracts(s, d)), _stub)


@query("b5_parse_advice", """
SELECT doc_id, (['Cap it.', '', NULL, NULL, NULL])[doc_id % 5 + 1] AS indemnity,
  (['Pick a seat.', NULL, NULL, NULL, 'Too late.'])[doc_id % 5 + 1] AS arbitration FROM documents""")
def b5(s, d):
    a = pr.parse_advice(_advice_texts(s, d))
    return a.select("doc_id", F.element_at("advice", "Indemnity").alias("indemnity"),
                    F.element_at("advice", "arbitration").alias("arbitration"))


def _label_model(prompts):
    """A stand-in for a model that names categories: by the prompt's length, failing on every fourth."""
    import pandas as pd

    def one(p):
        if len(p) % 4 == 2:
            raise ValueError("no answer")
        return ('```json\n["Indemnity", "Nope"]\n```', '["Arbitration", "Force Majeure"]', None, "I am not sure.")[len(p) % 4]

    return pd.Series([one(p) for p in prompts])


def _advice_model(prompts):
    import pandas as pd

    return pd.Series([('{"Indemnity": "Cap it.", "arbitration": "Pick a seat."}', "none")[len(p) % 2] for p in prompts])


@query("r21_scored_reports", q.build(f"""
SELECT r.doc_id, overall_risk, composite_risk_score, total_risks_found, chunk_index, rule_id, CASE
  WHEN category = 'Indemnity' AND length(prompt) % 2 = 0 THEN 'Cap it.' WHEN category = 'Arbitration' AND length(prompt) % 2 = 0
  THEN 'Pick a seat.' ELSE {q.curated('category')} END AS recommendation
FROM mreports r LEFT JOIN mcollapsed c ON r.doc_id = c.doc_id LEFT JOIN ({_b2_sql('mcollapsed')}) p ON r.doc_id = p.doc_id""",
  "mreports", "mcollapsed"))
def r21_scored(s, d):
    """Every candidate chunk and every document with clauses goes to a model; its answers decide clauses and advice."""
    made, _ = so.analyse_scored(fx.contracts(s, d), fx.rules(s), _label_model, _advice_model, single_page=True)
    return made.reports.select(*_REPORT).join(
        made.clauses.select("doc_id", "chunk_index", "rule_id", "recommendation"), "doc_id", "left")


# --- relational queries (Q) ------------------------------------------------


def _places(df, group):
    """Adds ``place``, the number of a row among its group's in the order in which the rows come."""
    came = df.withColumn("_came", F.monotonically_increasing_id())
    return came.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_came"))).drop("_came")


@query("q1_documents_of", q.build(
    f"SELECT user_id, doc_id, original_filename, status, {STAMP.format('uploaded_at')} AS uploaded_at, "
    "row_number() OVER (PARTITION BY user_id ORDER BY uploads.uploaded_at DESC, doc_id) AS place FROM uploads "
    "WHERE user_id IN (SELECT user_id FROM users)", "uploads", "users"))
def q1(s, d):
    return _places(pf.documents_of(fx.uploads(s, d), fx.users(s, d)), "user_id").select(
        "user_id", "doc_id", "original_filename", "status", _stamp("uploaded_at").alias("uploaded_at"), "place")


@query("q2_guarded", q.build("""
SELECT doc_id * 2 AS doc_id, 'src' || doc_id % 20 AS user_id, CASE WHEN o IS NULL THEN 'missing' WHEN o = 'src' || doc_id % 20 THEN 'ok' ELSE 'forbidden' END AS access
FROM (SELECT d.doc_id, u.user_id AS o FROM documents d LEFT JOIN uploads u ON u.doc_id = d.doc_id * 2)""", "uploads"))
def q2(s, d):
    asked = fx.table(s, d, "documents").select(
        (F.col("doc_id") * 2).alias("doc_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("user_id"))
    return pf.guarded(fx.uploads(s, d), asked)


@query("q3_chunks_of", q.build("""
SELECT doc_id, chunk_index, page_number, token_count, chunk_text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS place
FROM pchunks WHERE doc_id IN (SELECT doc_id FROM labels)""", "pchunks"))
def q3(s, d):
    return _places(pf.chunks_of(_page_chunks(s, d), fx.table(s, d, "labels")), "doc_id")


def _dated(reports):
    """Reports with an older version of each beside them."""
    stamp = F.expr("timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 1000 as int))")
    now = reports.withColumn("completed_at", stamp).withColumn(
        "processing_time_seconds", (F.col("doc_id") % 9).cast("double"))
    old = now.withColumn("completed_at", F.expr("completed_at - make_dt_interval(1)")).withColumn("overall_risk", F.lit("Old"))
    return now.unionByName(old)


@query("q4_latest_reports", q.build("""
SELECT doc_id, overall_risk, (SELECT count(*) FROM pcollapsed c WHERE c.doc_id = r.doc_id) AS clauses FROM preports r""", "preports"))
def q4(s, d):
    a = _page_analysis(s, d)
    return pf.latest_reports(_dated(a.reports.drop("key_entities")), a.clauses).groupBy("doc_id", "overall_risk").agg(
        F.sum(F.size("risk_clauses")).alias("clauses"))


@query("q5_report_state", q.build("""
SELECT doc_id, state, CASE WHEN state = 'failed' THEN 'Document analysis failed: ' || coalesce(error_message, 'None') END AS message FROM (
  SELECT u.*, CASE WHEN l.doc_id IS NOT NULL THEN 'ready' WHEN status IN ('pending', 'processing') THEN status WHEN status = 'failed' THEN 'failed'
    ELSE 'missing' END AS state FROM uploads u LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))""", "uploads"))
def q5(s, d):
    return pf.report_state(fx.uploads(s, d), fx.table(s, d, "labels"))


@query("q6_user_document_counts", q.build(f"""
SELECT u.user_id, u.email, u.role, u.is_active, n AS document_count, {STAMP.format('u.created_at')} AS created_at FROM users u
JOIN (SELECT u.user_id, count(d.doc_id) AS n FROM users u LEFT JOIN uploads d USING (user_id) GROUP BY 1) USING (user_id)""", "users", "uploads"))
def q6(s, d):
    return pf.user_document_counts(fx.users(s, d), fx.uploads(s, d)).select(
        "user_id", "email", "role", "is_active", "document_count", _stamp("created_at").alias("created_at"))


_PORTFOLIO_SQL = """
SELECT d.doc_id, original_filename, status, email AS user_email, overall_risk, composite_risk_score, coalesce(total_risks_found, 0) AS total_risks_found
FROM uploads d JOIN users u USING (user_id) LEFT JOIN preports r ON r.doc_id = d.doc_id"""
_PORTFOLIO = ["doc_id", "original_filename", "status", "user_email", "overall_risk", "composite_risk_score", "total_risks_found"]


def _portfolio(s, d):
    return pf.portfolio(fx.uploads(s, d), fx.users(s, d), _page_analysis(s, d).reports)


@query("q7_portfolio", q.build(_PORTFOLIO_SQL, "uploads", "users", "preports"))
def q7(s, d):
    return _portfolio(s, d).select(*_PORTFOLIO)


@query("q8_system_stats", q.build("""
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM users WHERE is_active) AS active_users,
  (SELECT count(*) FROM uploads) AS total_documents, (SELECT count(*) FROM uploads WHERE status = 'completed') AS completed_analyses,
  (SELECT count(*) FROM uploads WHERE status = 'failed') AS failed_analyses,
  (SELECT count(*) FROM preports WHERE overall_risk = 'High') AS high_risk_documents,
  (SELECT count(*) FROM preports WHERE overall_risk = 'Medium') AS medium_risk_documents,
  (SELECT count(*) FROM preports WHERE overall_risk = 'Low') AS low_risk_documents,
  (SELECT round(avg(doc_id % 9), 2) FROM preports) AS avg_processing_time_seconds,
  (SELECT count(*) FROM pcollapsed) AS total_risk_clauses""", "users", "uploads", "preports"))
def q8(s, d):
    a = _page_analysis(s, d)
    timed = a.reports.withColumn("processing_time_seconds", (F.col("doc_id") % 9).cast("double"))
    return pf.system_stats(fx.users(s, d), fx.uploads(s, d), timed, a.clauses)


@query("q9_list_rules", q.build("SELECT rule_id, category, default_risk_level, keywords FROM tenant_rules", "tenant_rules"))
def q9(s, d):
    return pf.list_rules(fx.tenant_rules(s, d)).select("rule_id", "category", "default_risk_level", "keywords")


@query("q10_risk_distribution", q.build("""
SELECT overall_risk, count(*) AS documents, CAST(floor(100 * count(*) / nullif((SELECT count(*) FROM uploads WHERE status = 'completed'), 0)::DOUBLE + 0.5) AS BIGINT) AS percent
FROM preports GROUP BY 1""", "uploads", "preports"))
def q10(s, d):
    return pf.risk_distribution(_page_analysis(s, d).reports, fx.uploads(s, d))


@query("q11_search_documents", q.build(f"""
SELECT doc_id, user_email, overall_risk FROM ({_PORTFOLIO_SQL}) WHERE (contains(lower(original_filename), 'src1') OR contains(lower(user_email), 'src1'))
  AND upper(overall_risk) = 'HIGH'""", "uploads", "users", "preports"))
def q11(s, d):
    return pf.search_documents(_portfolio(s, d), "SRC1", "HIGH").select("doc_id", "user_email", "overall_risk")


@query("q12_dashboard_counts", q.build(f"""
SELECT count(*) AS total_count, count(*) FILTER (WHERE overall_risk = 'High') AS high_risk_count,
  count(*) FILTER (WHERE status = 'completed') AS completed_count FROM ({_PORTFOLIO_SQL})""", "uploads", "users", "preports"))
def q12(s, d):
    return pf.dashboard_counts(_portfolio(s, d))


@query("q13_clauses_by", q.build(
    "SELECT doc_id, chunk_index, rule_id, clause_text FROM pclauses WHERE category = 'Indemnity' AND upper(risk_level) = 'HIGH'", "pclauses"))
def q13(s, d):
    raw = rp.raw_clauses(_page_chunks(s, d), fx.rules(s))
    return pf.clauses_by(raw, "Indemnity", "HIGH").select("doc_id", "chunk_index", "rule_id", "clause_text")


@query("q13_severity_counts", q.build("""
SELECT upper(risk_level) AS severity, count(*) AS clauses FROM clauses GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM clauses""", "clauses"))
def q13_counts(s, d):
    return pf.severity_counts(_raw(s, d))


@query("q14_chunks_by_page", q.build("""
SELECT doc_id, page_number, CAST(count(*) AS BIGINT) AS n, md5(string_agg(chunk_text, '|' ORDER BY chunk_index)) AS chunks_md5 FROM chunks GROUP BY 1, 2""", "chunks"))
def q14(s, d):
    return pf.chunks_by_page(_chunks(s, d)).select(
        "doc_id", "page_number", F.size("chunks").cast("long").alias("n"),
        F.md5(F.array_join(F.transform("chunks", lambda c: c["chunk_text"]), "|")).alias("chunks_md5"))


@query("q15_page_numbers", q.build("""
SELECT doc_id, page_number FROM pchunks UNION SELECT doc_id, page_number FROM block_clauses UNION SELECT doc_id, 1 FROM pchunks""",
  "pchunks", "block_clauses"))
def q15(s, d):
    return pf.page_numbers(_page_chunks(s, d), _block_clauses(s, d))


@query("q16_risks_per_page", q.build("SELECT doc_id, page_number, count(*) AS risks FROM pcollapsed GROUP BY 1, 2", "pcollapsed"))
def q16(s, d):
    return pf.risks_per_page(_page_analysis(s, d).clauses)


_VIEW = "regexp_replace(lower({}), {}, ' ', 'g')"
_V = lambda x: _VIEW.format(x, q.text(pf._VIEWER_WS))
_LINKS = f"""SELECT DISTINCT h.doc_id, h.chunk_index, c.clause_id, c.risk_level FROM
  (SELECT *, {_V('chunk_text')} AS a FROM pchunks) h
  JOIN (SELECT *, doc_id || ':' || chunk_index || ':' || rule_id AS clause_id, {_V('clause_text')} AS b FROM pclauses) c ON h.doc_id = c.doc_id
  WHERE contains(a, b) OR contains(b, a)"""


def _links(s, d):
    chunks = _page_chunks(s, d)
    clauses = tables.materialise(_with_ids(rp.raw_clauses(chunks, fx.rules(s))), "linked-clauses")
    return pf.link_chunks(chunks, clauses), clauses


@query("q17_link_chunks", q.build(f"SELECT doc_id, chunk_index, clause_id FROM ({_LINKS})", "pchunks", "pclauses"))
def q17(s, d):
    return _links(s, d)[0]


@query("q18_chunk_severity", q.build(f"""
SELECT doc_id, chunk_index, (['LOW', 'MEDIUM', 'HIGH'])[max(CASE upper(risk_level) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)] AS severity
FROM ({_LINKS}) GROUP BY 1, 2""", "pchunks", "pclauses"))
def q18(s, d):
    return pf.chunk_severity(*_links(s, d))


@query("q19_search_chunks", q.build(
    "SELECT doc_id, chunk_index FROM chunks WHERE contains(lower(chunk_text), 'security deposit')", "chunks"))
def q19(s, d):
    return pf.search_chunks(_chunks(s, d), "Security Deposit").select("doc_id", "chunk_index")


@query("q20_select_clauses", q.build(
    "SELECT doc_id, chunk_index, rule_id FROM clauses JOIN labels USING (doc_id) WHERE toxic = 1", "clauses"))
def q20(s, d):
    chosen = fx.table(s, d, "labels").filter("toxic = 1").select("doc_id")
    return pf.select_clauses(_raw(s, d), chosen, "doc_id").select("doc_id", "chunk_index", "rule_id")


@query("q22_rollup_checks", """
SELECT count(*) AS total_tests, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'error')) AS warnings,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'ALL_SYSTEMS_OPERATIONAL' ELSE 'SYSTEM_DEGRADED' END AS overall_status FROM events""")
def q22(s, d):
    t = F.col("event_type")
    return pf.rollup_checks(fx.table(s, d, "events").select(
        F.when(t.isin("view", "click"), "PASS").when(t == "error", "FAIL").otherwise("WARNING").alias("status")))


# --- maintenance (M) -------------------------------------------------------


def _old_and_new(s, d):
    """Tenant rules with names made unique: those of odd customers exist already."""
    named = fx.tenant_rules(s, d).withColumn("category", F.concat("category", F.lit(" "), (F.col("rule_id") % 500).cast("string")))
    return named.filter("rule_id % 2 = 1"), named


_NAMED = "(SELECT * REPLACE (category || ' ' || rule_id % 500 AS category) FROM tenant_rules)"


@query("m1_seed_missing", q.build(f"""
SELECT rule_id, category FROM {_NAMED} WHERE rule_id % 2 = 1 UNION ALL SELECT rule_id, category FROM {_NAMED} n
WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} o WHERE o.rule_id % 2 = 1 AND o.category = n.category)""", "tenant_rules"))
def m1(s, d):
    return mt.seed_missing(*_old_and_new(s, d)).select("rule_id", "category")


@query("m2_create_rules", q.build(f"""
SELECT rule_id, category, conflict FROM (
  SELECT *, rule_id % 2 = 0 AND (r > 1 OR EXISTS (SELECT 1 FROM {_NAMED} o WHERE o.rule_id % 2 = 1 AND o.category = n.category)) AS conflict
  FROM (SELECT *, row_number() OVER (PARTITION BY rule_id % 2, category ORDER BY rule_id) AS r FROM {_NAMED}) n)""", "tenant_rules"))
def m2(s, d):
    old, named = _old_and_new(s, d)
    stored, clash = mt.create_rules(old, named.filter("rule_id % 2 = 0"))
    cols = ["rule_id", "category"]
    return stored.select(*cols, F.lit(False).alias("conflict")).unionByName(clash.select(*cols, F.lit(True).alias("conflict")))


@query("m3_update_rules", q.build("""
SELECT rule_id, CASE WHEN rule_id % 3 = 0 THEN 0.9 ELSE weight END AS weight, CASE WHEN rule_id % 3 <> 2 THEN NULL ELSE keywords END AS keywords, description
FROM tenant_rules""", "tenant_rules"))
def m3(s, d):
    rules = fx.tenant_rules(s, d)
    i = F.col("rule_id")
    updates = rules.filter(i % 3 != 2).select(
        "rule_id", F.lit(0.9).alias("weight"), F.lit(None).cast("string").alias("keywords"), F.lit("x").alias("description"),
        F.when(i % 3 == 0, F.array(F.lit("weight"), F.lit("keywords"))).otherwise(F.array(F.lit("keywords"))).alias("supplied"))
    return mt.update_rules(rules, updates).select("rule_id", "weight", "keywords", "description")


@query("m4_delete_cascade", q.build("""
SELECT 'documents' AS name, count(*) AS n FROM uploads WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'clauses', count(*) FROM clauses WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", "uploads", "clauses"))
def m4(s, d):
    left = mt.delete_cascade(
        {"documents": fx.uploads(s, d), "chunks": _chunks(s, d), "clauses": _raw(s, d)},
        fx.table(s, d, "labels").filter("toxic = 1"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("m5_update_users", q.build("""
SELECT user_id, CASE n % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' ELSE role END AS role,
  CASE WHEN n % 2 = 0 AND user_id <> 'src4' THEN NOT is_active ELSE is_active END AS is_active
FROM (SELECT *, ascii(right(user_id, 1)) + length(email) AS n FROM users)""", "users"))
def m5(s, d):
    users = fx.users(s, d)
    n = F.ascii(F.right("user_id", F.lit(1))) + F.length("email")
    updates = users.select("user_id", fx._pick(("admin", "user", "owner", "root"), n).alias("role"), (n % 2 == 0).alias("toggle_active"))
    return mt.update_users(users, updates, "src4").select("user_id", "role", "is_active")


@query("m6_recover_stranded", q.build(f"""
SELECT doc_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'processing' THEN {q.text(fv.STRANDED_MESSAGE)} ELSE error_message END AS error_message FROM uploads""", "uploads"))
def m6(s, d):
    return mt.recover_stranded(fx.uploads(s, d))[0].select("doc_id", "status", "error_message")


@query("m7_runnable", q.build("SELECT doc_id, status FROM uploads WHERE status <> 'processing'", "uploads"))
def m7(s, d):
    return mt.runnable(fx.uploads(s, d)).select("doc_id", "status")


@query("m8_duplicate_keys", q.build(
    "SELECT category, count(*) AS copies FROM tenant_rules GROUP BY 1 HAVING count(*) > 1", "tenant_rules"))
def m8(s, d):
    return mt.duplicate_keys(fx.tenant_rules(s, d), ["category"])


# --- vectors (V) -----------------------------------------------------------


def _centroids(s, d):
    """The mean vector of every label, as query vectors."""
    e = fx.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding")) \
        .select(F.col("label").alias("query_id"), "label", "embedding")


_CENTROIDS = """(SELECT label, list(x ORDER BY i) AS embedding FROM (SELECT label, i, avg(x) AS x FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_TOP = """SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (
  SELECT q.label AS query_id, vec_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding) AS distance
  FROM embeddings v JOIN {} q ON {})) WHERE r <= 10"""


@query("v1_cosine_topk", _TOP.format(_CENTROIDS, "true"))
def v1(s, d):
    return ve.cosine_topk(fx.table(s, d, "embeddings"), _centroids(s, d), 10).select(
        F.col("query_id").alias("query_id"), "vec_id", F.round("distance", 6).alias("distance"))


@query("v1_cosine_topk_filtered", _TOP.format(_CENTROIDS, "q.label = v.label"))
def v1_filtered(s, d):
    return ve.cosine_topk(fx.table(s, d, "embeddings"), _centroids(s, d), 10, "label").select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"))


_EVERY_50TH = "(SELECT vec_id AS label, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id % 50 = 0)"


@query("v1_cosine_topk_many", _TOP.format(_EVERY_50TH, "true"))
def v1_many(s, d):
    """Every 50th vector against all, by cells."""
    vectors = fx.table(s, d, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ve.cell_topk(vectors, queries, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("v2_approx_topk", f"""
SELECT query_id, vec_id, distance, true AS recalled FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM ({_TOP.format(_CENTROIDS, "true")})) WHERE r = 1""")
def v2(s, d):
    """The nearest vector of every query, and whether 9 of the 10 true nearest ones were found."""
    vectors, queries = fx.table(s, d, "embeddings"), tables.materialise(_centroids(s, d), "centroids")
    found = tables.materialise(ve.approx_topk(vectors, queries, 10), "approx")
    exact = ve.cosine_topk(vectors, queries, 10).select("query_id", "vec_id")
    recall = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left") \
        .groupBy("query_id").agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    nearest = found.groupBy("query_id").agg(F.min(F.struct("distance", "vec_id")).alias("n"))
    return nearest.join(recall, "query_id").select(
        "query_id", "n.vec_id", F.round("n.distance", 6).alias("distance"), "recalled")


# --- locating clauses (L) --------------------------------------------------


@query("l1_clause_terms", q.build(f"""
SELECT rule_id, array_to_string(list_sort({q.clause_terms('category', 'description')}), '|') AS terms FROM tenant_rules""", "tenant_rules"))
def l1(s, d):
    terms = loc.clause_terms(F.col("category"), F.col("description"))
    return fx.tenant_rules(s, d).select("rule_id", F.array_join(F.array_sort(terms), "|").alias("terms"))


@query("l2_best_block", q.build("SELECT doc_id, clause_id, page_number, idx FROM page_best WHERE page_number = own_page", "page_best"))
def l2(s, d):
    return loc.best_block(fx.blocks(fx.contract_pages(s, d)), _block_clauses(s, d), fv.LOCATION_PREFIX_WORDS)


@query("l2_whole_clause", q.build("SELECT doc_id, clause_id, page_number, idx FROM whole_best WHERE page_number = own_page", "whole_best"))
def l2_whole(s, d):
    return loc.best_block(fx.blocks(fx.contract_pages(s, d)), _block_clauses(s, d))


_RECTS = """SELECT f.doc_id, f.clause_id, f.page_number, p.idx, p.y0, p.y1 FROM ({}) f
JOIN placed p ON p.doc_id = f.doc_id AND p.page_number = f.page_number AND p.paragraph = f.paragraph AND p.drawable"""


@query("l3_expand_block", q.build(_RECTS.format("SELECT * FROM page_best WHERE page_number = own_page"), "page_best", "placed"))
def l3(s, d):
    blocks = fx.blocks(fx.contract_pages(s, d))
    return loc.expand_block(blocks, loc.best_block(blocks, _block_clauses(s, d), fv.LOCATION_PREFIX_WORDS)).select(
        "doc_id", "clause_id", "page_number", "idx", "y0", "y1")


@query("l4_locate", q.build(_RECTS.format("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY page_number <> target, page_number) AS k FROM (
  SELECT b.*, CASE WHEN own_page < 1 OR own_page > last THEN 1 ELSE own_page END AS target FROM page_best b
  JOIN (SELECT doc_id, max(page_number) AS last FROM blocks GROUP BY 1) USING (doc_id))) WHERE k = 1"""), "page_best", "placed", "blocks"))
def l4(s, d):
    return loc.locate(fx.blocks(fx.contract_pages(s, d)), _block_clauses(s, d), fv.LOCATION_PREFIX_WORDS).select(
        "doc_id", "clause_id", "page_number", "idx", "y0", "y1")


# --- streaming (X) ---------------------------------------------------------


@query("x1_stream_analysis", q.build(_REPORT_SQL.format("preports"), "preports"))
def x1(s, d):
    """Odd and even turns of the conversations arrive in two batches, the second one twice."""
    base = f"{checkpoint_dir(s)}/x1-{uuid.uuid4().hex}"
    turns = fx.table(s, d, "conversations")
    source = s.readStream.schema(turns.schema).parquet(f"{base}/in/*")
    for part in ("first", "second", "again"):
        rest = 0 if part == "first" else 1
        turns.filter(F.col("turn") % 2 == rest).write.parquet(f"{base}/in/{part}")
        inc.stream_analysis(fx.as_contract_pages(source), fx.rules(s), f"{base}/out", f"{base}/state", buckets=8) \
            .awaitTermination()
    return s.read.parquet(f"{base}/out/analysis_reports").select(*_REPORT)


@query("x2_stream_status_counts", "SELECT event_type AS status, count(*) AS documents FROM events GROUP BY 1")
def x2(s, d):
    base = f"{checkpoint_dir(s)}/x2-{uuid.uuid4().hex}"
    source = s.readStream.schema(fx.table(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    counts = inc.stream_status_counts(source.withColumnRenamed("event_type", "status"))
    (counts.writeStream.outputMode("complete")
     .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
     .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination())
    return s.read.parquet(f"{base}/out")


@query("x1_null_pages", q.build("SELECT doc_id, count(*) AS chunks FROM pchunks GROUP BY doc_id", "pchunks"))
def x1_null_pages(s, d):
    """Every third page has no number; pages arrive in two batches, and none is lost."""
    base = f"{checkpoint_dir(s)}/x1-{uuid.uuid4().hex}"
    turns = fx.table(s, d, "conversations")
    for part in (0, 1):
        turns.filter(F.col("turn") % 2 == part).write.parquet(f"{base}/in/{part}")
        arrived = fx.as_contract_pages(s.readStream.schema(turns.schema).parquet(f"{base}/in/*")).withColumn(
            "page_number", F.when(F.col("page_number") % 3 != 0, F.col("page_number")))
        inc.stream_analysis(arrived, fx.rules(s), f"{base}/out", f"{base}/state", buckets=8).awaitTermination()
    return s.read.parquet(f"{base}/out/document_chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
