"""Hand-worked expectations per operator."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions import text as tx
from clauselens.functions.entities import key_entities
from clauselens.operators import clauses as cl
from clauselens.operators import containment
from clauselens.operators import matching as ma
from clauselens.operators import prompts as pr
from clauselens.operators import rules as ru
from clauselens.operators import scoring as sc
from clauselens.operators import vectors as ve
from clauselens.operators.chunking import PAGE_BLOCK, chunk
from clauselens.operators.containment import containing_pairs
from clauselens.plans import report as rp
from clauselens.sources import files, tables

PAGE = "doc_id long, page_number int, text string"
CLAUSE = ("doc_id long, chunk_index int, rule_id int, category string, clause_text string, explanation string, "
          "risk_level string, rule_weight double, confidence_score double, page_number int")


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]


def match(spark, category, text, keywords=None):
    rules = spark.createDataFrame(
        [(1, category, "High", 0.5, 1.0, "d", keywords, True)], ru.default_rules(spark).schema)
    pages = spark.createDataFrame([(1, 1, text)], PAGE)
    row = ma.match_rules(chunk(pages, single_page=True), rules).first()
    return row["evidence"] if row else None


def clause_rows(spark, items):
    rows = [(1, i, 1, c, t, "e", "High", 2.0, s, p) for i, (c, p, t, s) in enumerate(items)]
    return spark.createDataFrame(rows, CLAUSE)


def test_sentences_keep_abbreviations_and_decimals(spark):
    got = value(
        spark, "Pay Rs. 900/- per month. See Sec. 3(1) of the Act. ABC Co. Ltd. opens at 9.5 AM. The end.", tx.sentences)
    assert got == ["Pay Rs. 900/- per month", "See Sec. 3(1) of the Act", "ABC Co. Ltd. opens at 9.5 AM", "The end."]


def test_sentences_touching_abbreviations_follow_list_order(spark):
    # "No." stands after "Rs." in the list, so it no longer starts a word there.
    assert value(spark, "Rs.No. 5 is due. Yes.", tx.sentences) == ["Rs.No", "5 is due", "Yes."]
    assert value(spark, "No.Rs. 5 is due. Yes.", tx.sentences) == ["No.Rs. 5 is due", "Yes."]


@pytest.mark.parametrize("n", [0, 1, 300, 301, 570, 571, 1000])
def test_window_count_and_cover(spark, n):
    words = [f"w{i}" for i in range(n)]
    pages = spark.createDataFrame([(1, 1, "  ".join(words))], PAGE)
    rows = chunk(pages, single_page=True).orderBy("chunk_index").collect()
    expected = 0 if n == 0 else 1 if n <= 300 else math.ceil((n - 300) / 270) + 1
    assert len(rows) == expected
    assert {w for r in rows for w in r["chunk_text"].split()} == set(words)
    assert all(r["token_count"] == len(r["chunk_text"].split()) for r in rows)


def test_short_page_keeps_its_text(spark):
    pages = spark.createDataFrame([(1, 1, "  a  b\n c ")], PAGE)
    assert chunk(pages, single_page=True).first()["chunk_text"] == "a  b\n c"


def test_chunk_numbers_run_across_pages_and_blocks(spark):
    rows = [(1, p, "x " * (301 if p % 500 == 0 else 1)) for p in range(1, 2 * PAGE_BLOCK + 5)]
    rows += [(2, None, "first"), (2, 1, "second"), (3, 1, " ")]
    got = chunk(spark.createDataFrame(rows, PAGE)).orderBy("doc_id", "page_number", "chunk_index").collect()
    one = [r["chunk_index"] for r in got if r["doc_id"] == 1]
    assert one == list(range(len(one))) and len(one) == 2 * PAGE_BLOCK + 4 + 4
    assert [r["chunk_text"] for r in got if r["doc_id"] == 2] == ["first", "second"]
    assert not [r for r in got if r["doc_id"] == 3]


def test_seed_rules_resolve(spark):
    got = {r["category"]: r["def_key"] for r in ru.resolve_rules(ru.default_rules(spark)).collect()}
    assert got["Rent Escalation & Auto-Increase"] == "rent escalation"
    assert got["Utilities & Maintenance Fee Liabilities"] == "utilit"
    assert got["Confidentiality / NDA"] == "confidentiality"
    assert None not in got.values() and len(set(got.values())) == 19


def test_stems_cover_phrases():
    for key, d in ru.DEFINITIONS.items():
        for phrase in d.phrases:
            assert any(stem in phrase for stem in ma.STEMS[key]), (key, phrase)


@pytest.mark.parametrize("category, text, keywords, expected", [
    ("Rent Escalation & Auto-Increase", "The rent shall increase by 5% each year.", None, "exact_phrase"),
    ("Utilities & Maintenance Fee Liabilities", "The tenant pays electricity.", None, "contextual"),
    ("Unilateral Termination", "It ends with compensation in\nlieu thereof.", None, "exact_phrase"),
    ("Late Rent Payment & Default Penalty", "The default setting stays unless changed.", None, None),
    ("Landlord Entry & Inspection Rights", "Staff have access to the office premises.", None, None),
    ("Arbitration", "The arbitrator met us.", None, None),
    ("Arbitration", "The arbitrator met another arbitrator.", None, "contextual"),
    ("GDPR Compliance", "European (GDPR) standards on personal data.", None, None),
    ("GDPR Compliance", "European (GDPR) standards on personal data.", "gdpr, personal data", "contextual"),
    ("GDPR Compliance", "European (GDPR) standards on personal data.", "personal data, gdpr", "exact_phrase"),
    ("Indemnity", "Hold harmless the agent (a+b).", "agen, x", "contextual"),
    ("Odd", "Cost (a+b) is due.", "a+b", "contextual"),
    ("Late Rent", "A penalty for non-payment of rent.", None, "contextual"),
])
def test_matching(spark, category, text, keywords, expected):
    assert match(spark, category, text, keywords) == expected


def test_noise_and_fixes_with_and_without_gates(spark):
    """Plain searches before the patterns change nothing, odd case forms included."""
    from clauselens.functions import patterns as pa

    lines = ["Szz0H x", "a Orie  rre", "eſigned uſing AADHAAR", "ESIGNED\u00a0USING aadhaar", "Date: Mon Jan 12", "BR pe AE CECITET",
             "br Pe ae cecıtet", "x 12 hiſ /", "K 5", "\u212a\u20037", "é 5", "ee", "OE", "e\n", "eee", "04Q55120987765401239abc", "\u0660" * 20 + "a b",
             "Pay %500", 'the 10" day', "all érsons", "7<« x", "ee Mrs.", "e NOW", " ee x", "\u3000e THIS", "E NOW", "plain", ""]
    df = spark.createDataFrame([(x,) for x in lines], "x string").repartition(1)
    x, bare = F.col("x"), F.lit(False)
    for p, i in fv.NOISE_LINE_PATTERNS:
        bare = bare | F.rlike(x, F.lit(pa.java_regex(p, i)))
    token = (F.length(x) >= 20) & (tx.word_count(x) <= 2) & F.rlike(x, F.lit(r"\p{Nd}")) & F.rlike(x, F.lit("[A-Za-z]"))
    fixed = x
    for p, r in fv.LINE_FIXES:
        fixed = F.regexp_replace(fixed, pa.java_regex(p, False), r)
    rows = df.select(x, tx.is_noise_line(x), token | bare, tx.fix_line(x), tx.strip(fixed)).collect()
    assert [r[0] for r in rows if r[1] != r[2] or r[3] != r[4]] == [] and sum(r[1] for r in rows) >= 12
    # Lines without a part that is fixed are not searched by the patterns of the fixes.
    assert "CASE WHEN" in df.select(tx.fix_line(x))._jdf.queryExecution().analyzed().toString()


def test_candidates_join_texts_once(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "a", 40), (1, 1, 1, "b", 5), (1, 2, 1, "c", 5)],
                                   "doc_id long, chunk_index int, page_number int, chunk_text string, token_count int")
    hits = spark.createDataFrame([(1, 1, 7), (1, 1, 8)], "doc_id long, chunk_index int, rule_id int")
    got = ma.model_candidates(chunks, hits)
    assert sorted((r["chunk_index"], r["matched"], r["chunk_text"]) for r in got.collect()) == [(0, False, "a"), (1, True, "b")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_match_by_join_agrees(spark):
    texts = ["hold harmless the tenant", "pay rent in paris", "the premises; vacate them", "a\tb c", "parental leave", "É rent",
             "", "pre-pay (a+b) and -pay", "US$500 or $500", "x\x01pay", "the   tenant\npays now", "_pay; 日本語 text"]
    chunks = chunk(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], PAGE), single_page=True)
    extra = [(50, "Renting", "Low", 0.1, 1.0, "", "rent, a", True), (51, "b c", "Low", 0.1, 1.0, "", None, True),
             (52, "Off", "Low", 0.1, 1.0, "", "the", False), (53, "X", "Low", 0.1, 1.0, "", "in paris,paris", True),
             (54, None, "Low", 0.1, 1.0, "", None, True), (55, "", "Low", 0.1, 1.0, "", " , ", True),
             (56, "Y", "Low", 0.1, 1.0, "", "(,p,.", True), (57, None, "Low", 0.1, 1.0, None, "rent", True),
             (57, None, "Low", 0.1, 1.0, None, "rent", True), (57, "Aren", "Low", 0.1, 1.0, None, "ant pay,-pay", True),
             (58, "e-p", "Low", 0.1, 1.0, "", "$500,zz", True), (59, "+", "Low", 0.1, 1.0, "", "pay-x, b) a", True),
             (60, "ar", "Low", 0.1, 1.0, "", "日本, s n", True), (61, "zz", "Low", 0.1, 1.0, "", "(a+, y;", True)]
    rules = ru.default_rules(spark).unionByName(spark.createDataFrame(extra, ru.default_rules(spark).schema))
    cols = ["doc_id", "rule_id", "evidence"]
    compiled, joined = ma.match_rules(chunks, rules), ma.match_rules_by_join(chunks, rules)
    assert compiled.schema["rule_id"].dataType == joined.schema["rule_id"].dataType
    one = sorted(tuple(r) for r in compiled.select(*cols).collect())
    two = sorted(tuple(r) for r in joined.select(*cols).collect())
    assert one == two and len({r for r in one if r[1] == 54}) == len({r[0] for r in one})
    assert len(one) > len(set(one))
    # Several blocks of rules give the same, and neither texts nor hits are shuffled.
    blocks = ma.match_rules_by_join(chunks.coalesce(1), rules, ["chunk_text"], rules_per_block=9)
    assert sorted(tuple(r) for r in blocks.select(*cols).collect()) == one
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_match_by_join_agrees_on_random_terms(spark):
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("aab  b,_\t\n\x01é²日") for _ in range(n))
    pages = [(i, 1, make(rnd.randint(0, 25))) for i in range(60)]
    chunks = chunk(spark.createDataFrame(pages, PAGE), single_page=True)
    extra = [(i, rnd.choice([None, "", make(2), make(4)]), "Low", 0.1, 1.0, "", ",".join(
        make(rnd.randint(1, 6)).replace(",", "") for _ in range(rnd.randint(0, 3))), True) for i in range(150)]
    rules = spark.createDataFrame(extra, ru.default_rules(spark).schema)
    cols = ["doc_id", "chunk_index", "rule_id", "evidence"]
    one, two = (sorted(tuple(r) for r in f(chunks, rules).select(*cols).collect()) for f in (ma.match_rules, ma.match_rules_by_join))
    assert one == two and len(one) > 1000


def test_terms_of_two_words_are_looked_up_by_words(spark, monkeypatch):
    rows = [{"rule_id": i, "def_key": None, "terms": [
        {"position": 0, "keyword": f"w{i} the", "kind": "phrase"}, {"position": 1, "keyword": f"v{i}", "kind": "start"}]} for i in range(5000)]
    block = ma._RuleBlock(pa.Table.from_pylist(rows), ma._word_turns(spark), [])
    monkeypatch.setattr(ma._RuleBlock, "_occurs", lambda *_: pytest.fail("a term was looked for whole"))
    text = "aw7 then,v9 the w12 the xv3"
    at, exact = block.hits(text, text, "")
    assert at.tolist() == [7, 12, 9] and exact == 2


@pytest.mark.parametrize("evidence, confirmed, expected", [
    ("exact_phrase", True, .95), ("contextual", True, .95), ("exact_phrase", False, .88), ("llm_only", False, .82),
    ("contextual", False, .78), ("fallback", False, .72), ("llm_only", True, .82)])
def test_confidence(spark, evidence, confirmed, expected):
    assert spark.range(1).select(ma.confidence(F.lit(evidence), F.lit(confirmed))).first()[0] == expected


def test_threshold_null_or_zero_is_default(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (0.85,)], "t double").select(ru.threshold(F.col("t"))).collect()
    assert [r[0] for r in rows] == [fv.DEFAULT_THRESHOLD, fv.DEFAULT_THRESHOLD, 0.85]


def test_snippet(spark):
    chunks = spark.createDataFrame([(
        "9. INDEMNITY. The Tenant agrees to hold harmless the Landlord against all claims. "
        "The Landlord hands over two keys. Utility bills are due in five days.",
        ["hold harmless", "indemnif", "indemnity"], "none")], "chunk_text string, snippet_keywords array<string>, def_key string")
    got = cl.with_snippet(cl.with_sentences(chunks)).first()["clause_text"]
    assert got == "INDEMNITY The Tenant agrees to hold harmless the Landlord against all claims"


COLLAPSE = [
    ("Indemnity", 2, "The lessee covers every loss that its guests cause in the flat.", .88),
    ("Indemnity", 2, "The lessee covers every loss that its guests cause in the flat.", .88),
    ("Indemnity", 4, "A contractor pays the firm back for patent suits brought by strangers.", .95),
    ("Indemnity", 5, "Both sides hold each other free of harm from reckless acts.", .78),
    ("Arbitration", 6, "A panel of three seated in Pune decides any quarrel for good.", .88)]


def test_collapse_keeps_distinct_pages(spark):
    got = cl.collapse_clauses(clause_rows(spark, COLLAPSE)).collect()
    assert sorted((r["category"], r["page_number"]) for r in got) == [
        ("Arbitration", 6), ("Indemnity", 2), ("Indemnity", 4), ("Indemnity", 5)]
    again = cl.collapse_clauses(cl.collapse_clauses(clause_rows(spark, COLLAPSE)))
    assert again.count() == len(got)


def greedy(items):
    """The fold, written independently for checking."""
    import re

    sets = lambda t: set(re.findall(r"\w+", t.lower()))
    plain = lambda t: " ".join(t.lower().split())
    kept = []
    for cat, page, text, conf in items:
        for k in kept:
            if k[0].lower() != cat.lower():
                continue
            a, b = sets(text), sets(k[2])
            j = len(a & b) / len(a | b) if a and b else 0.0
            x, y = plain(text), plain(k[2])
            if x == y or (page == k[1] and (j > .65 or x in y or y in x)) or (page != k[1] and j > .75):
                pages = [p for p in (page, k[1]) if p is not None]
                low = min(pages) if pages and any(pages) else None
                if (conf, len(text)) > (k[3], len(k[2])):
                    k[2], k[3] = text, conf
                k[1] = low
                break
        else:
            kept.append([cat, page, text, conf])
    return sorted(map(repr, ((k[1], k[2], k[3]) for k in kept)))


@pytest.mark.parametrize("seed", range(4))
def test_collapse_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = "rent due late fee paid pay tenant owner notice month".split()
    items = [("Cat", rnd.choice([None, 1, 2, 3]), " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 6))), rnd.choice([.78, .88, .95]))
             for _ in range(120)]
    df = clause_rows(spark, items)
    folded = cl.collapse_clauses(df)
    assert sorted(repr((r["page_number"], r["clause_text"], r["confidence_score"])) for r in folded.collect()) == greedy(items)
    plan = folded._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_collapse_in_pieces_against_brute_force(spark, seed):
    rnd = random.Random(10 + seed)
    words = [f"word{i}" for i in range(60)] + "rent due late fee".split()
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 14))) for _ in range(60)]
    items = []
    for _ in range(160):
        text = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        text = text[:rnd.randint(1, len(text))] if rnd.random() < 0.2 else text
        items.append(("Cat", rnd.choice([None, 1, 2, 3]), " ".join(text).upper() if rnd.random() < 0.1 else " ".join(text),
                      rnd.choice([.78, .88, .95])))
    items += [("Cat", 2, "", .78)] * (seed % 2)
    folded = cl.collapse_in_pieces(clause_rows(spark, items))
    assert sorted(repr((r["page_number"], r["clause_text"], r["confidence_score"])) for r in folded.collect()) == greedy(items)


def test_collapse_by_blocks_gives_the_same_rows(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(30)]
    items = [("Cat", rnd.choice([None, 1, 2]), " ".join(rnd.choices(words[:rnd.choice([8, 30])], k=rnd.randint(1, 12))), rnd.choice([.78, .88]))
             for _ in range(120)]
    folded = cl.collapse_in_pieces(clause_rows(spark, items), large=0, per_block=20)
    assert sorted(repr((r["page_number"], r["clause_text"], r["confidence_score"])) for r in folded.collect()) == greedy(items)


@pytest.mark.parametrize("seed", range(2))
def test_large_pieces_fold_alike(spark, seed):
    rnd = random.Random(30 + seed)
    words = [f"word{i}" for i in range(12)]
    items = [("Cat", rnd.choice([None, 0, 1, 2]), " ".join(rnd.choices(words[:rnd.choice([4, 12])], k=rnd.randint(0, 9))), rnd.choice([.78, .88]))
             for _ in range(200)]
    folded = cl.collapse_in_pieces(clause_rows(spark, items), large_piece=0)
    assert sorted(repr((r["page_number"], r["clause_text"], r["confidence_score"])) for r in folded.collect()) == greedy(items)


def test_fold_of_a_large_piece_compares_few_keepers(monkeypatch):
    """Of 2,000 clauses on one page none repeats another: bits tell all but few of 1,999,000 pairs apart."""
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(40)) for _ in range(2000)]
    looked = []

    class Text(str):
        def __eq__(self, other):
            looked.append(1)
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    norms = [Text(t) for t in texts]
    got = cl._fold_large(norms, [list(dict.fromkeys(t.split())) for t in texts], [1] * 2000, [.88] * 2000, [len(t) for t in texts])
    assert got == [(i, 1) for i in range(2000)] and len(looked) < 20_000


def test_similar_forms_meet_on_rare_tokens_only(spark, monkeypatch):
    """Forms of a large group that share frequent words alone never come to a matrix, similar ones are linked."""
    monkeypatch.setattr(cl, "_alike_crowded", lambda *_: pytest.fail("compared block against block"))
    rows = [(1, "turn", i, "", [f"c{(i + k) % 20}" for k in range(12)] + [f"x{i // 2}y{k}" for k in range(20)] + [f"z{i}"]) for i in range(400)]
    forms = spark.createDataFrame(rows, "doc_id long, _category string, node long, norm string, tokens array<string>")
    links = {(r["a"], r["b"]) for r in cl._alike(forms, large=100).collect()}
    assert links == {(i, i + 1) for i in range(0, 400, 2)}


def test_links_of_large_groups_are_no_pairs(spark):
    """Nodes that are all alike are connected by a link each, where all pairs would be 44,850."""
    rows = [(1, "turn", i, "", [f"w{k}" for k in range(30)] + [f"x{i}"]) for i in range(300)]
    forms = spark.createDataFrame(rows, "doc_id long, _category string, node long, norm string, tokens array<string>")
    links = {(r["a"], r["b"]) for r in cl._alike(forms, large=100).collect()}
    assert len(links) == 299 and {n for x in links for n in x} == set(range(300))


@pytest.mark.parametrize("text", [
    '["Indemnity"] Hope this helps', "['Indemnity']", '["Indemnity"] ["Arbitration"]', '{"Indemnity":"x"} trailing',
    "{'Indemnity':'x'}", '["a"], "w": ["b"]', '["a"', "", None, '["Indemnity"]} Hope', '["a"]}{"v":["b"]', '["a"]} ',
    '{"a":"b"}} Hope', '["a"], ["b"]', '["a"]]', '{"a":"b"}, {"a":"c"}'])
def test_text_that_is_not_json_gives_nothing(spark, text):
    assert value(spark, text, ma.parse_label_array) is None
    assert value(spark, text, pr.parse_advice_text) is None


def test_json_answers_are_read(spark):
    assert value(spark, '```json\n["Indemnity", "Nope"]\n```', ma.parse_label_array) == ["Indemnity", "Nope"]
    assert value(spark, ' {"Indemnity": "Cap it."} ', pr.parse_advice_text) == {"Indemnity": "Cap it."}


def test_pages_with_null_and_repeated_numbers(spark):
    rows = [(1, None, "a b"), (1, None, "c d"), (1, 1, "e f"), (1, 1, "g h"), (1, 1, "g h"), (1, 2001, "i"), (1, None, None)]
    got = chunk(spark.createDataFrame(rows, "doc_id long, page_number int, text string")).collect()
    assert sorted((r.chunk_index, r.chunk_text) for r in got) == [
        (0, "a b"), (1, "c d"), (2, "e f"), (3, "g h"), (4, "g h"), (5, "i")]


@pytest.mark.parametrize("clauses, level, score", [
    ([("High", 2.0)], "High", 6.0), ([("High", 2.0), ("High", 1.8)], "High", 11.4),
    ([("Medium", 1.4), ("Medium", 1.0)], "Medium", 4.8), ([("Low", 0.8)], "Low", 0.8), ([], "Low", 0.0), ([("odd", 4.0)], "High", 8.0)])
def test_scores(spark, clauses, level, score):
    rows = [(1, i, 1, "c", "t", "e", lv, w, .9, 1) for i, (lv, w) in enumerate(clauses)]
    docs = spark.createDataFrame([(1,)], "doc_id long")
    r = sc.score_documents(docs, spark.createDataFrame(rows, CLAUSE)).first()
    assert (r["overall_risk"], r["composite_risk_score"], r["total_risks_found"]) == (level, score, len(clauses))


def test_entities(spark):
    e = value(spark, "Fee offers 30 and $120000, Rs. 5 lakh. governed by the laws of new york\ncity. Dated 3rd May 2024, 01/02/2024.", key_entities)
    assert e["monetary_amounts"] == ["rs 30", "$120", "Rs. 5 lakh"]
    assert e["governing_law"] == "New York\nCity" and e["jurisdiction"] == "Not Specified"
    assert e["effective_dates"] == ["3rd May 2024", "01/02/2024"]


def test_clean_text(spark):
    got = value(spark, "a\n\n\n\nb\n04Q55120987765401239\nPay %500 on the 10\" day\nee Mrs. Rao\n", tx.clean_text)
    assert got == "a\n\nb\nPay ₹500 on the 10th day\nMrs. Rao"
    assert value(spark, None, tx.clean_text) == ""


def test_upload_gate(spark):
    rows = [("a.PDF", 5), ("b", 5), ("c.docx", 0), ("d.doc", fv.MAX_FILE_BYTES + 1), ("e.tar.pdf", 1)]
    ok, bad = files.validate(spark.createDataFrame(rows, "original_filename string, file_size_bytes long"))
    assert sorted(r[0] for r in ok.select("original_filename").collect()) == ["a.PDF", "e.tar.pdf"]
    assert bad.count() == 3


def test_read_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"abc")
    row = files.fingerprint(files.read_files(spark, str(tmp_path))).first()
    assert (row["original_filename"], row["file_size_bytes"], len(row["file_hash_sha256"])) == ("x.pdf", 3, 64)


def test_replace_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, v string")
    read = lambda: sorted(map(tuple, tables.read_results(spark, path, frame([]).schema).collect()))
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    tables.write_results(frame([(1, "a"), (1, "b"), (2, "c"), (3, "d")]), path, ids, buckets=4)
    for _ in range(2):
        tables.write_results(frame([(1, "n")]), path, ids, buckets=4)
        assert read() == [(1, "n"), (3, "d")]
    everything = spark.createDataFrame([(1,), (3,)], "doc_id long")
    tables.write_results(frame([]), path, everything, buckets=4)
    assert read() == []


def test_containing_pairs_against_all_pairs(spark):
    rnd = random.Random(3)
    make = lambda n: " ".join(rnd.choices(["ab", "abc", "b", "ca", "", "bca"], k=n))
    hays = [(i % 2, i, make(rnd.randint(1, 8))) for i in range(40)]
    needles = [(i % 2, i, make(rnd.randint(0, 4))) for i in range(40)]
    got = containing_pairs(
        spark.createDataFrame(hays, "g int, hay_id int, hay string"),
        spark.createDataFrame(needles, "g int, needle_id int, needle string"), ["g"])
    expected = {(g, h, n) for g, h, a in hays for k, n, b in needles if g == k and b in a}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


@pytest.mark.parametrize("seed", range(2))
def test_filtered_keys_give_the_same_pairs(spark, seed):
    rnd = random.Random(20 + seed)
    make = lambda n: " ".join(rnd.choices(["the", "of", "rent", "a", "lease", "é日", ""], k=n))
    hays = [(i % 3, i, make(rnd.randint(1, 40))) for i in range(80)]
    cut = []
    for _, _, text in hays:
        start = rnd.randrange(len(text) + 1)
        cut.append(text[start:start + rnd.choice([0, 1, 2, 5, 9, 12, 17, 25, 33, 40, 60])])
    needles = [(rnd.randrange(3), i, x) for i, x in enumerate([*cut, *cut, make(9), "of", "", None])]
    hay_rows = spark.createDataFrame(hays, "g int, hay_id int, hay string")
    got = containing_pairs(hay_rows, spark.createDataFrame(needles, "g int, needle_id int, needle string"), ["g"], filtered=True)
    expected = {(g, h, n) for g, h, a in hays for k, n, b in needles if g == k and b is not None and b in a}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    # Without tiny needles a hay gives no key that no needle has.
    few = spark.createDataFrame([(0, 1, "the of rent a"), (0, 2, make(30))], "g int, needle_id int, needle string")
    keys, _ = containment._filtered_keys(hay_rows, few, ["g"])
    assert keys.count() < len(hays)


def test_keys_of_no_needle_hardly_pass_the_filter(spark):
    """With many needles of all shapes, a hay still keeps hardly a key but its own."""
    rnd = random.Random(9)
    make = lambda lo, hi: " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(lo, hi)))
    rows = lambda lo, hi, n, name: spark.createDataFrame([(0, i, make(lo, hi)) for i in range(n)], f"g int, {name}_id int, {name} string")
    keys, _ = containment._filtered_keys(rows(60, 90, 1000, "hay"), rows(4, 12, 30_000, "needle"), ["g"])
    assert keys.count() < 100


@pytest.mark.parametrize("seed", range(2))
def test_long_needles_against_all_pairs(spark, seed):
    """Needles cut anywhere out of long hays, inside words too, around the least number of winnowed words."""
    rnd = random.Random(seed)
    make = lambda n: " ".join(rnd.choices(["the", "of", "rent", "a", "lease", ""], k=n))
    hays = [(i % 3, i, make(rnd.randint(1, 60))) for i in range(60)]
    cut = []
    for _, _, text in hays:
        start = rnd.randrange(len(text) + 1)
        cut.append(text[start:start + rnd.choice([0, 1, 2, 9, 25, 33, 40, 60, 200])])
    needles = [(rnd.randrange(3), i, x) for i, x in enumerate(cut + [make(9), "of", ""])]
    got = containing_pairs(
        spark.createDataFrame(hays, "g int, hay_id int, hay string"),
        spark.createDataFrame([*needles, (1, 999, None)], "g int, needle_id int, needle string"), ["g"])
    expected = {(g, h, n) for g, h, a in hays for k, n, b in needles if g == k and b in a}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_links_against_all_pairs(spark):
    """Either way round, with one-word, empty and null texts; a plan of few scans and exchanges."""
    from clauselens.plans import portfolio as pf

    long = " ".join(f"word{i % 7} the" for i in range(40))
    chunks = [(1, 0, long + " End."), (1, 1, "Rent"), (1, 2, ""), (1, 3, None), (2, 0, "the  rent\nis due now and here as agreed by all"), (2, 1, "RENT")]
    clauses = [(1, "a", long[30:150]), (1, "b", "X " + long + " end. y"), (1, "c", "rent"), (1, "d", ""), (1, "e", None),
               (2, "f", "rent is due"), (2, "g", "the rent is due now and here as agreed by all"), (2, "h", "a")]
    form = lambda x: " ".join((x or "").lower().split())
    expected = {(d, i, c) for d, i, a in chunks if a for e, c, b in clauses
                if d == e and (form(a) in form(b) or form(b) in form(a))}
    got = pf.link_chunks(
        spark.createDataFrame(chunks, "doc_id long, chunk_index int, chunk_text string"),
        spark.createDataFrame(clauses, "doc_id long, clause_id string, clause_text string"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4 and plan.count("Join ") == 3


def test_topk_grid_equals_broadcast_and_lsh_recall(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = key(ve.cosine_topk(e, q, 5))
    approx = key(ve.approx_topk(e, q, 5, tables=16, bits=3))
    assert len(exact & approx) >= 0.9 * len(exact)
    monkeypatch.setattr(ve, "BROADCAST_QUERIES", 10)
    assert key(ve.cosine_topk(e, q, 5)) == exact


def test_failures_are_data(spark):
    docs = spark.createDataFrame([(1, "x"), (2, " \n"), (3, None)], "doc_id long, text string")
    ok, failed = rp.split_failures(docs)
    assert ok.count() == 1 and {r["doc_id"] for r in failed.collect()} == {2, 3}


def test_collapse_reads_one_exchange(spark):
    """One shuffle of the clauses, by document and category, and matching runs once."""
    from clauselens.catalogue import fixtures as fx

    chunks = chunk(fx.contracts(spark, "/root/testdata/sf0.001"), single_page=True)
    df = cl.collapse_clauses(rp.raw_clauses(chunks, fx.rules(spark)))
    df.collect()
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(formatted)
    final = plan[:plan.index("== Initial Plan ==")]
    assert final.count("+- Exchange") == 2  # pages to tasks, clauses to their groups
    assert final.count("Scan parquet") == 1


def test_matching_plan_is_narrow(spark):
    """No Python, no shuffle and no product between chunks and hits."""
    path = "/root/testdata/sf0.001/documents.parquet"
    pages = spark.read.parquet(path).select("doc_id", F.lit(1).alias("page_number"), "text")
    plan = rp.raw_clauses(chunk(pages, single_page=True), ru.default_rules(spark))._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange hash", "Cartesian", "NestedLoop", "Python", "SortMergeJoin"):
        assert word not in plan, word
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_health_reset_and_seeds(spark, tmp_path):
    from clauselens.plans import portfolio as pf

    rules = ru.default_rules(spark)
    assert rules.count() == 19
    tables.reset(spark, str(tmp_path), rules)
    assert tables.load(spark, str(tmp_path), "risk_rules_config").count() == 19
    assert tables.load(spark, str(tmp_path), "risk_clauses").count() == 0
    spark.range(1).createOrReplaceTempView("present_table")
    checks = pf.data_health(spark, ["present_table", "absent_table"], rules)
    got = {r["name"]: r["status"] for r in checks.collect()}
    assert got == {"present_table": "PASS", "absent_table": "FAIL", "seeded rules": "PASS"}
    assert pf.rollup_checks(checks).first()["overall_status"] == "SYSTEM_DEGRADED"


def test_nested_parts_are_whole(spark):
    reports = spark.createDataFrame([(1, "High"), (2, "Low")], "doc_id long, overall_risk string")
    rows = tables.export_reports(reports, clause_rows(spark, COLLAPSE), chunks_per_part=2).collect()
    assert sorted((r["doc_id"], r["part"], len(r["risk_clauses"])) for r in rows) == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 0)]
    whole = tables.export_reports(reports, clause_rows(spark, COLLAPSE))
    assert sorted((r["doc_id"], r["part"], len(r["risk_clauses"])) for r in whole.collect()) == [(1, 0, 5), (2, 0, 0)]
    assert tables.report_json(whole).count() == 2


@pytest.mark.parametrize("text, expected", [
    ("Lease between A Co and B Co. WHEREAS it is so", ["A Co", "B Co."]),
    ("WHEREAS first, then between us and them", []),
    ("IN WITNESS of a deal between X and Y; NOW THEREFORE z. between P and Q", ["X", "Y;"]),
    ("between " + "x and " * 60000, []),
    ("WHEREAS " + "between a and b " * 30000, []),
])
def test_parties(spark, text, expected):
    assert value(spark, text, key_entities)["parties"] == expected


def test_scratch_folders_go(spark):
    with tables.scratch(spark):
        kept = tables.materialise(spark.range(3), "scratch-test")
        folder = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 3 and tables._exists(spark, folder)
    assert not tables._exists(spark, folder)


@pytest.mark.parametrize("labelled", [False, True])
def test_reanalysis_by_difference(spark, monkeypatch, labelled):
    """Equal to a full run; only rules that look for something else are matched again; other columns stay."""
    from clauselens.catalogue import fixtures as fx
    from clauselens.catalogue.registry import _older_rules
    from clauselens.plans import difference as di

    sf = "/root/testdata/sf0.001"
    chunks = tables.materialise(chunk(fx.contracts(spark, sf), single_page=True), "test-chunks")
    labels = fx.model_labels(spark, sf) if labelled else None
    rules = fx.rules(spark)
    old = _older_rules(rules)
    previous = tables.materialise(
        rp.reports_from_chunks(chunks, old, labels)[1].withColumn("key_entities", F.lit("kept")), "test-reports")
    before = di.match_all(chunks, old)
    matched = []
    plain = di.match_rules
    monkeypatch.setattr(di, "match_rules", lambda c, r: matched.extend(x["rule_id"] for x in r.collect()) or plain(c, r))
    reports, changes, after = di.reanalyse_changed(chunks, before, old, rules, previous, labels)
    assert sorted(matched) == [1, 100]
    rows = lambda x, *cols: sorted(map(tuple, x.select(*cols).collect()), key=repr)
    report = ["doc_id", "composite_risk_score", "overall_risk", "total_risks_found"]
    full, full_changes = rp.reanalyse(chunks, rules, previous, labels)
    assert rows(reports, *report) == rows(full, *report)
    assert rows(changes, *full_changes.columns) == rows(full_changes, *full_changes.columns) != []
    assert {r["key_entities"] for r in reports.collect()} == {"kept"}
    hit = ["doc_id", "chunk_index", "rule_id", "evidence"]
    assert rows(after.hits, *hit) == rows(ma.match_rules(chunks, rules), *hit)
    matched.clear()
    same = di.reanalyse_changed(chunks, after, rules, rules, reports, labels)
    assert matched == [] and same[1].count() == 0 and rows(same[0], *report) == rows(full, *report)


def test_a_failing_batch_is_halved(spark, tmp_path):
    """One bad prompt of 64 costs few further calls; a wrong number of answers is a failure."""
    import pandas as pd

    log = str(tmp_path)

    def model(asked):
        import os
        import uuid

        open(os.path.join(log, f"{uuid.uuid4().hex}-{len(asked)}"), "w").close()
        if "p13" in set(asked):
            raise ValueError("thirteen")
        return pd.Series([x for x in asked if x != "p40"])

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(64)], "id int, prompt string").coalesce(1)
    rows = {r["id"]: r for r in pr.score_prompts(prompts, model).collect()}
    assert rows[13]["error"] == "thirteen" and rows[40]["error"] == "0 answers to 1 prompts"
    assert all(rows[i]["response"] == f"p{i}" and rows[i]["error"] is None for i in range(64) if i not in (13, 40))
    assert len(list(tmp_path.iterdir())) == 1 + 2 * 6 + 2 * 5  # both halves at each step; the first step is shared


def test_every_prompt_is_asked_once(spark, tmp_path):
    """Repeated and known prompts are not asked; failed ones are asked again; null ones never."""
    import pandas as pd

    log = str(tmp_path)

    def model(asked):
        import os
        import uuid

        for p in asked:
            open(os.path.join(log, f"{p}-{uuid.uuid4().hex}"), "w").close()
            if p == "bad":
                raise ValueError("bad")
        return pd.Series([p.upper() for p in asked])

    asked = lambda: sorted(f.name.split("-")[0] for f in tmp_path.iterdir())
    of = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id int, prompt string").repartition(4)
    scored, answers = pr.score_distinct(of(["a", "b", "a", None, "a", "a"]), model)
    rows = lambda df: {r["id"]: r["response"] for r in df.collect()}
    assert rows(scored) == rows(scored) == {0: "A", 1: "B", 2: "A", 3: None, 4: "A", 5: "A"}
    assert asked() == ["a", "b"]
    scored, answers = pr.score_distinct(of(["a", "bad", "c"]), model, answers)
    assert rows(scored) == {0: "A", 1: None, 2: "C"} and set(asked()) == {"a", "b", "bad", "c"}
    before = len(asked())
    assert rows(pr.score_distinct(of(["c", "a", "bad"]), model, answers)[0]) == {0: "C", 1: "A", 2: None}
    assert asked().count("bad") > 0 and len(asked()) == before + 1


def test_completed_analysis(spark):
    """Whole report rows in the stored schema; only documents that were analysed move; a report without upload stays."""
    from clauselens import schemas

    pages = spark.createDataFrame(
        [(1, 1, "The Tenant shall indemnify the Landlord against all claims."), (2, 1, " "), (9, 1, "Nothing.")], PAGE)
    uploads = spark.createDataFrame(
        [(1, "a.pdf", "processing", "old", "x"), (2, "b.pdf", "processing", None, "y"), (3, "c.pdf", "pending", "wait", "z")],
        "doc_id long, original_filename string, status string, error_message string, more string")
    made = rp.complete(rp.analyse(pages, ru.default_rules(spark)), uploads)
    reports = {r["doc_id"]: r for r in made.reports.collect()}
    assert made.reports.columns == schemas.REPORTS.fieldNames() and set(reports) == {1, 9}
    assert reports[1]["executive_summary"] == "Summary of a.pdf: Legal agreement containing 1 clause sections."
    assert reports[1]["completed_at"] is not None and reports[1]["processing_time_seconds"] is None
    assert [r["clause_id"] for r in made.clauses.collect()] == [
        f"1:0:{r['rule_id']}" for r in made.clauses.collect()] != []
    assert sorted(map(tuple, made.documents.collect())) == [
        (1, "a.pdf", "completed", None, "x"), (2, "b.pdf", "failed", fv.EMPTY_TEXT_MESSAGE, "y"),
        (3, "c.pdf", "pending", "wait", "z")]


def test_cell_search_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        at = i % 6
        rows.append((i, [float(j == at) * 3 + rng.gauss(0, .2) for j in range(6)]))
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)]  # copies, more than a block holds
    odd = [(5000, None), (5001, []), (5002, [0.0] * 6), (5003, [float("nan")] * 6), (5004, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, e) for i, e in rows[::25]] + odd, "query_id long, embedding array<double>")
    got = {}
    for r in ve.cell_topk(vectors, queries, 7, cells=12, rows_per_block=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["distance"], 9)))
    length = lambda a: sum(x * x for x in a) ** .5
    cosine = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / length(a) / length(b)
    assert set(got) == {i for i, _ in rows[::25]}
    for i, e in rows[::25]:
        near = sorted(round(cosine(e, o), 9) for _, o in rows)[:7]
        assert [d for _, _, d in sorted(got[i])] == pytest.approx(near, abs=1e-8)
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, 8))
    copies = {v for _, v, _ in got[1000]}
    assert len(copies) == 7 and min(copies) >= 1000
    none = vectors.limit(0)
    assert ve.cell_topk(none, queries, 3).count() == 0 and ve.cell_topk(vectors, queries.limit(0), 3).count() == 0
    assert ve.cell_topk(vectors, queries.limit(1), 10_000).count() == len(rows)  # fewer vectors than k


def test_cell_search_makes_no_row_per_pair(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:4], "query_id long, embedding array<double>")
    found = ve.cell_topk(vectors, queries, 3, cells=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and found.count() == 12
    # Equal vectors tie exactly, so the smaller ids come first.
    assert [r["vec_id"] for r in found.orderBy("query_id", "rank").collect()][:3] == [0, 21, 42]


@pytest.mark.parametrize("text", [
    "the tenant shall İndemnify", "ındemnity", "no diſmiſſal here, ſeverance", "xterminate", "re-terminate _dismiss",
    "Late fee", "10% increase and ١% increase", "évict evicté", "riKt", "", "work\nproduct", "DEPOSIT", "áauto-renew"])
def test_patterns_behind_a_first_look_find_the_same(spark, text):
    from clauselens.functions.patterns import _java_boundary, expand_classes, java_regex

    ws = "[\\x20\\x09-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    for d in ru.DEFINITIONS.values():
        assert java_regex(d.pattern).startswith("(?diu)(?=")
        plain = "(?diu)" + expand_classes(d.pattern, _java_boundary, ws, "[\\p{L}\\p{N}_]")
        found = spark.range(1).select(
            F.regexp_extract(F.lit(text), java_regex(d.pattern), 0).alias("a"), F.regexp_extract(F.lit(text), plain, 0).alias("b"),
            F.rlike(F.lit(text), F.lit(plain)).alias("hit"), cl._may_match(d, F.lit(text), F.lower(F.lit(text))).alias("may")).first()
        assert found["a"] == found["b"] and (found["may"] or not found["hit"]), d.key


def test_sentences_are_split_once_for_all_hits_of_a_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, 1, "One. Two."), (1, 1, 1, "Three.")], "doc_id long, chunk_index int, page_number int, chunk_text string")
    hits = spark.createDataFrame([(1, 0, 1, "e"), (1, 0, 2, "e"), (1, 0, 2, "e"), (1, 1, 1, None)],
                                 "doc_id long, chunk_index int, rule_id int, evidence string")
    got = cl.with_texts(hits, chunks)
    rows = sorted((r.chunk_index, r.rule_id, len(r["_sentences"])) for r in got.collect())
    assert rows == [(0, 1, 2), (0, 2, 2), (0, 2, 2), (1, 1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("_sentences", plan.index("Generate inline"))


def test_snippet_keywords_are_tried_only_behind_the_roots_of_a_rule(spark):
    for d in ru.DEFINITIONS.values():
        roots = ru._roots(d)
        assert len(roots) <= 8 and all(any(r in k for r in roots) for k in d.phrases + d.keywords), d.key
    rows = [
        ("One day. They diſmiſſed him early. Another day.", ["zzz"], "termination", "They diſmiſſed him early"),  # by the pattern alone
        ("One day. The meter is old. Another day.", ["meter"], None, "The meter is old"),
        ("One day. A DEFEND act. Another day.", ["defend", "hold harmless"], "indemnity", "A DEFEND act"),
        ("One day. Nothing here. Another day.", ["defend", "own words"], "indemnity", "One day Nothing here"),
    ]
    hits = spark.createDataFrame([r[:3] for r in rows], "chunk_text string, snippet_keywords array<string>, def_key string")
    found = cl.with_snippet(cl.with_sentences(hits))
    assert {r["clause_text"] for r in found.collect()} == {r[3] for r in rows}
    assert "exists" in found._jdf.queryExecution().analyzed().toString()
    facts = cl.rule_facts(ru.default_rules(spark).limit(1)).first()
    assert facts["snippet_roots"] == ["defend", "harmless", "indemn"]


def test_terms_of_a_definition_are_one_list(spark):
    """Generated code with a branch for each term gets too long to be compiled."""
    for stems in ru.STEMS.values():
        assert all(ma.rare_part(s) in s and len(ma.rare_part(s)) >= min(5, len(s)) for s in stems)
    text = spark.createDataFrame([("The parties stand by the agenda.",), ("NDA: the recipient keeps a secret",), (None,)], "t string")
    norm = F.lower("t")
    found = text.select(*[ma.definition_evidence(F.col("t"), norm, k).alias(k.replace(" ", "_")) for k in ru.DEFINITIONS])
    assert [r["confidentiality"] for r in found.collect()] == [None, "contextual", None]
    plan = found._jdf.queryExecution().analyzed().toString()
    terms = sum(len(d.phrases) + len(d.context_terms) for d in ru.DEFINITIONS.values())
    assert plan.lower().count("contains(") < terms  # 366 and more with one for each


def test_strip_page_and_window_counts(spark):
    texts = [f"{a}a b{b}" for a in ("", *tx.WS_CHARS, "\u200b", "\xe9") for b in ("", "\u3000", "\x85", "\u0405", "\n")] + ["", " ", " \x1c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.strip_page(F.col("t")).alias("a"), tx.strip(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())
    page = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 9, 10, 11, 17, 18, 19, 40)], "doc_id long, page_number int, text string")
    made = chunk(page, size=10, overlap=2, single_page=True)
    assert all(len(r["chunk_text"].split()) == r["token_count"] for r in made.collect())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("array_join(slice") == 1
    assert made._jdf.queryExecution().optimizedPlan().toString().count("slice(") <= 2
