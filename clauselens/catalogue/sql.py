"""The registered queries in plain SQL, for checking results with DuckDB.

``build(final, *names)`` puts the named common table expressions, and those
they need, in front of a final SELECT.
"""

from __future__ import annotations

from clauselens import fixed_values as fv
from clauselens.catalogue import fixtures as fx
from clauselens.functions import patterns
from clauselens.functions.patterns import PLAIN_NOT_WS, PLAIN_WORD, PLAIN_WS, WS_CHARS
from clauselens.operators.prompts import CLASSIFY_TEMPLATE

NOT_W = "[^" + PLAIN_WORD[1:]
START, END = f"(?:^|{NOT_W})", f"(?:$|{NOT_W})"
DOT = "_ꙮ_"


def expand_classes(pattern: str, boundary) -> str:
    return patterns.expand_classes(pattern, boundary, PLAIN_WS, PLAIN_WORD)


def text(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def texts(xs) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]"


def re2(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    """A fixed pattern for RE2; word boundaries become edge groups."""

    def edge(p: str, i: int) -> str:
        return START if i == 0 else (END if i == len(p) - 2 else r"\b")

    flags = ("i" if ignore_case else "") + ("s" if dot_all else "")
    return (f"(?{flags})" if flags else "") + expand_classes(pattern, edge)


def body(pattern: str) -> str:
    """A definition's pattern without edges and without capturing groups."""
    core = pattern.removeprefix(r"\b").removesuffix(r"\b")
    out = []
    for i, c in enumerate(core):
        out.append("(?:" if c == "(" and core[i + 1] != "?" and core[i - 1:i] != "\\" else c)
    return expand_classes("".join(out), lambda p, i: r"\b")


def strip(x: str) -> str:
    return f"trim({x}, {text(WS_CHARS)})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {text(PLAIN_WS + '+')}, ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {text(PLAIN_NOT_WS + '+')})"


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {text(PLAIN_WORD + '+')}))"


def jaccard(a: str, b: str) -> str:
    """Of two distinct token lists."""
    shared = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"{shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END)")


def join_texts(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, {text(sep)})"


# --- expressions -----------------------------------------------------------


def sentences(x: str) -> str:
    one_dot = "|".join(a[:-1] for a in fv.ABBREVIATIONS if a.count(".") == 1)
    out = x
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1{DOT}\\2', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(?i)(^|{NOT_W})({one_dot})\\.', '\\1\\2{DOT}', 'g')"
    for a in fv.ABBREVIATIONS:
        if a.count(".") == 2:
            p, r = a.split(".")[:2]
            out = f"regexp_replace({out}, '(?i)(^|{NOT_W})({p})\\.({r})\\.', '\\1\\2{DOT}\\3{DOT}', 'g')"
    parts = f"string_split_regex({out}, {text(expand_classes(fv.SENTENCE_BREAK, lambda p, i: ''))})"
    clean = f"list_transform({parts}, lambda s: replace({strip('s')}, '{DOT}', '.'))"
    return f"list_filter({clean}, lambda s: s <> '')"


def definition_key(category: str) -> str:
    name = f"lower({strip(category)})"
    keys = sorted((d[0] for d in fv.DEFINITIONS), key=len, reverse=True)
    alias = " ".join(f"WHEN {text(a)} THEN {text(k)}" for a, k in fv.CATEGORY_ALIASES)
    whole = " ".join(f"WHEN regexp_matches({name}, {text(START + k + END)}) THEN {text(k)}" for k in keys)
    guarded, guard = fv.SUBSTRING_GUARD
    sub = " ".join(
        f"WHEN contains({name}, {text(k)})"
        + (f" AND NOT contains({name}, {text(guard)})" if k == guarded else "")
        + f" THEN {text(k)}" for k in keys)
    return f"coalesce(CASE {name} {alias} END, CASE {whole} END, CASE {sub} END)"


def keyword_list(x: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), "
            f"lambda k: lower({strip('k')})), lambda k: k <> '')")


def noise(line: str) -> str:
    tests = [f"(length({line}) >= 20 AND len({words(line)}) <= 2 AND regexp_matches({line}, '\\p{{Nd}}') "
             f"AND regexp_matches({line}, '[A-Za-z]'))"]
    tests += [f"regexp_matches({line}, {text(re2(p, ic))})" for p, ic in fv.NOISE_LINE_PATTERNS]
    return "(" + " OR ".join(tests) + ")"


def fixed_line(line: str) -> str:
    steps = (
        ("%(\\p{Nd}+)", "₹\\1"), ('\\b10"' + PLAIN_WS + "+day\\b", "10th day"),
        (f"(^|{NOT_W})érsons\\b", "\\1persons"), (f"7<«{PLAIN_WS}*", ""), (f"^{PLAIN_WS}*ee{PLAIN_WS}+", ""),
        (f"^{PLAIN_WS}*e{PLAIN_WS}+(Mrs\\.|Mr\\.|THIS|NOW)", "\\1"),
    )
    for pattern, replacement in steps:
        line = f"regexp_replace({line}, {text(pattern)}, {text(replacement)}, 'g')"
    return strip(line)


LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def clean(x: str) -> str:
    lines = f"list_transform(string_split_regex(coalesce({x}, ''), {text(LINES)}), lambda r: {strip('r')})"
    fixed = (f"list_transform({lines}, lambda l: CASE WHEN l = '' THEN l "
             f"WHEN NOT {noise('l')} THEN nullif({fixed_line('l')}, '') END)")
    joined = f"array_to_string(list_filter({fixed}, lambda l: l IS NOT NULL), chr(10))"
    return strip(f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _distinct(matches: str) -> str:
    """Trimmed, distinct in order, joined."""
    t = f"list_transform({matches}, lambda m: {strip('m')})"
    d = f"list_filter({t}, lambda m, i: list_position({t}, m) = i)"
    return f"array_to_string({d}, '|')"


def _title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')"
    return (f"array_to_string(list_transform({runs}, "
            "lambda w: upper(w[1:1]) || lower(w[2:])), '')")


def _place(x: str, patterns) -> str:
    tries = " ".join(
        f"WHEN regexp_matches({x}, {text(re2(p))}) THEN "
        + _title(strip(f"regexp_extract({x}, {text(re2(p))}, 1)")) for p in patterns)
    return f"CASE {tries} ELSE {text(fv.NOT_SPECIFIED)} END"


def _name(side: str) -> str:
    lead = text(re2(fv.LEADING_NAME, ignore_case=False))
    return (f"CASE WHEN regexp_matches({side}, {lead}) THEN "
            f"rtrim({strip(f'regexp_extract({side}, {lead}, 1)')}, ',') ELSE "
            f"rtrim(array_to_string({words(side)}, ' '), ',') END")


def _party(side: str) -> str:
    term = text(re2(fv.DEFINED_TERM))
    return (f"CASE WHEN {_name(side)} <> '' THEN {_name(side)} || CASE WHEN regexp_matches({side}, {term}) "
            f"THEN ' (' || {strip(f'regexp_extract({side}, {term}, 1)')} || ')' ELSE '' END END")


def entities(x: str) -> dict[str, str]:
    dates = "list_concat(list_concat({}, {}), list_concat({}, {}))".format(
        *[f"regexp_extract_all({x}, {text('(?i)' + expand_classes(p, lambda q, i: chr(92) + 'b'))})"
          for p in fv.DATE_PATTERNS])
    block = text("(?is)" + expand_classes(fv.PARTY_BLOCK, lambda p, i: r"\b"))
    sides = [strip(f"regexp_extract({x}, {block}, {g})") for g in (1, 2)]
    got = lambda p, ic: strip(f"regexp_extract({x}, {text(re2(p, ic))}, 1)")
    employer, employee, role = (
        got(fv.OFFER_EMPLOYER, True), got(fv.OFFER_EMPLOYEE, False), got(fv.OFFER_ROLE, True))
    offer = (f"array_to_string(list_filter([nullif({employer}, '') || ' (Employer)', nullif({employee}, '') "
             f"|| ' (' || coalesce(nullif({role}, ''), 'Employee') || ')'], lambda p: p IS NOT NULL), '|')")
    block_parties = (f"array_to_string(list_filter([{_party(sides[0])}, {_party(sides[1])}], "
                     "lambda p: p IS NOT NULL), '|')")
    return {
        "parties": f"coalesce(nullif(CASE WHEN regexp_matches({x}, {block}) THEN {block_parties} END, ''), {offer})",
        "effective_dates": _distinct(dates),
        "governing_law": _place(x, fv.GOVERNING_LAW_PATTERNS),
        "jurisdiction": _place(x, fv.JURISDICTION_PATTERNS),
        "monetary_amounts": _distinct(f"regexp_extract_all({x}, {text(re2(fv.AMOUNT_PATTERN))})"),
    }


def clause_terms(category: str, explanation: str) -> str:
    combined = f"lower({category} || ' ' || coalesce({explanation}, ''))"
    lists = ", ".join(
        f"CASE WHEN contains({combined}, {text(k)}) THEN {texts(v)} ELSE [] END" for k, v in fv.LOCATION_TERMS)
    mapped = f"flatten([{lists}])"
    own = f"list_transform(list_filter({words(category)}, lambda w: length(w) >= 4), lambda w: lower(w))"
    return f"list_distinct(CASE WHEN len({mapped}) > 0 THEN {mapped} ELSE {own} END)"


def curated(category: str) -> str:
    tries = " ".join(f"WHEN contains(lower({category}), {text(k)}) THEN {text(v)}" for k, v in fv.CURATED_ADVICE)
    return f"CASE {tries} ELSE replace({text(fv.GENERIC_ADVICE)}, '%s', {category}) END"


MULTIPLIER = "CASE upper(risk_level) WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 1.0 ELSE 2.0 END"
RISK = "CASE WHEN {high} OR {score} >= 8.0 THEN 'High' WHEN {score} >= 3.5 THEN 'Medium' ELSE 'Low' END"

# --- common table expressions ----------------------------------------------

CTES: dict[str, tuple[tuple, str]] = {}


def cte(name: str, needs: tuple, sql: str) -> None:
    CTES[name] = (needs, sql)


def build(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    # A recursive query refers to itself and is kept anyway.
    _named = lambda n: f"{n} AS {'' if 'folded' in n else 'MATERIALIZED '}({CTES[n][1]})"
    head = "WITH RECURSIVE " if any("folded" in n for n in order) else "WITH "
    return head + ",\n".join(_named(n) for n in order) + "\n" + final


def _rule_values() -> str:
    rows = [(i, *s, None, True) for i, s in enumerate(fv.RULE_SEEDS, start=1)]
    rows += [(100 + i, *r) for i, r in enumerate(fx.PROBE_RULES)]
    out = []
    for rid, cat, level, thr, weight, desc, kws, active in rows:
        t = "NULL::DOUBLE" if thr is None else f"{thr}::DOUBLE"
        out.append(f"({rid}, {text(cat)}, {text(level)}, {t}, {weight}::DOUBLE, {text(desc)}, {text(kws)}, {active})")
    return ", ".join(out)


_BANK = [c for _, c in fx.CLAUSES]
cte("contracts", (), f"""
SELECT doc_id, 1 AS page_number, ({texts(fx.PREAMBLES)})[doc_id % 8 + 1] || chr(10) || text || chr(10)
  || ({texts(fx.group_texts())})[doc_id % 8 + 1] AS text FROM documents""")
cte("contract_pages", (), f"""
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number,
  text || chr(10) || chr(10) || ({texts(_BANK)})[(conv_id + turn // 2) % {len(_BANK)} + 1] AS text
FROM conversations""")
cte("rules", (), f"""
SELECT *, {definition_key('category')} AS def_key FROM (VALUES {_rule_values()})
  t(rule_id, category, default_risk_level, confidence_threshold, weight, description, keywords, is_active)""")
cte("defs", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({text(k)}, {texts(p)}, {texts(c)}, {texts(w)})"
    for k, p, _, c, w in fv.DEFINITIONS) + ") t(def_key, phrases, context, words)")

cte("srules", ("rules",), f"""
SELECT * REPLACE (CASE WHEN contains(lower({text(fx.OVERRIDE)}), lower(category)) THEN {text(fx.OVERRIDE)} ELSE keywords END AS keywords)
FROM rules""")
cte("schunks", ("contracts",), "SELECT doc_id, 0 AS chunk_index, 1 AS page_number, text AS chunk_text FROM contracts")


def confidence(confirmed: str) -> str:
    return (f"CASE WHEN {confirmed} AND evidence IN ('exact_phrase', 'contextual') THEN 0.95 "
            "WHEN evidence = 'exact_phrase' THEN 0.88 WHEN evidence = 'llm_only' THEN 0.82 "
            "WHEN evidence = 'contextual' THEN 0.78 ELSE 0.72 END::DOUBLE")


LIMIT = "CASE WHEN coalesce(confidence_threshold, 0) = 0 THEN 0.65 ELSE confidence_threshold END"


def _chunk_ctes(src: str, pre: str) -> None:
    cte(pre + "tokened", (src,), f"""
SELECT doc_id, page_number, page, w, len(w) AS n FROM (
  SELECT doc_id, page_number, {strip('text')} AS page, {words('text')} AS w FROM {src})""")
    cte(pre + "chunks", (pre + "tokened",), f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, i) - 1 AS INTEGER) AS chunk_index,
  page_number, CASE WHEN n <= 300 THEN page ELSE array_to_string(w[i * 270 + 1 : i * 270 + 300], ' ') END AS chunk_text,
  CAST(CASE WHEN n <= 300 THEN n ELSE len(w[i * 270 + 1 : i * 270 + 300]) END AS INTEGER) AS token_count
FROM (SELECT *, unnest(CASE WHEN n = 0 THEN [] WHEN n <= 300 THEN [0]
        ELSE range(0, CAST(ceil((n - 300) / 270.0) AS BIGINT) + 1) END) AS i FROM {pre}tokened)""")


def _by_definition(make) -> str:
    """CASE over the definitions: constant patterns are compiled once."""
    return "CASE d.def_key " + " ".join(
        f"WHEN {text(k)} THEN {make(body(r), r.endswith(chr(92) + 'b'))}" for k, _, r, _, _ in fv.DEFINITIONS) + " END"


def _single_keywords():
    lists = [r[5] for r in fx.PROBE_RULES] + [fx.OVERRIDE]
    found = {k.strip().lower() for x in lists if x for k in x.split(",")}
    return sorted(k for k in found if k and " " not in k)


_CUT = _by_definition(lambda b, closed: "string_split(regexp_replace(chunk_text, "
                      + text(f"(?i)(^|{NOT_W})({b})" + (f"($|{NOT_W})" if closed else "()"))
                      + ", '\\1' || chr(1) || '\\2' || chr(1) || '\\3'), chr(1))")
_HAS = "len(list_filter({}, lambda p: contains(nt, p))) > 0"
_IN_CONTEXT = """len(cut) > 1 AND len(list_filter(context, lambda t: contains(nt, t)
      AND (t <> lower(cut[2]) OR contains(lower(cut[1]) || ' ' || lower(cut[3]), t)))) > 0"""
# Evidence of every definition in every chunk of ``c`` (chunks with lo and nt).
_DEFINITION_HITS = f"""SELECT doc_id, chunk_index, def_key, CASE WHEN {_HAS.format('phrases')} THEN 'exact_phrase' ELSE 'contextual' END AS evidence
  FROM (SELECT c.*, d.def_key, d.phrases, d.context, {_CUT} AS cut FROM c CROSS JOIN defs d)
  WHERE {_HAS.format('phrases')} OR {_IN_CONTEXT}"""


def _hit_ctes(pre: str, rules: str) -> None:
    starts = " ".join(f"WHEN {text(k)} THEN regexp_matches(lo, {text(START + k)})" for k in _single_keywords())
    custom = f"CASE WHEN contains(k, ' ') THEN contains(lo, k) OR contains(nt, k) ELSE CASE k {starts} END END"
    cte(pre + "hits", (pre + "chunks", rules, "defs"), f"""
SELECT doc_id, chunk_index, page_number, chunk_text, rule_id, evidence FROM (
  SELECT *, CASE
    WHEN first_kw IS NOT NULL THEN CASE WHEN contains(first_kw, ' ') THEN 'exact_phrase' ELSE 'contextual' END
    WHEN def_key IS NULL THEN CASE WHEN contains(lo, lower(category)) OR contains(nt, lower(category)) THEN 'contextual' END
    WHEN {_HAS.format('phrases')} THEN 'exact_phrase'
    WHEN {_IN_CONTEXT} THEN 'contextual' END AS evidence
  FROM (
    SELECT c.*, r.rule_id, r.category, r.def_key, d.phrases, d.context,
      list_filter({keyword_list('r.keywords')}, lambda k: {custom})[1] AS first_kw,
      {_CUT} AS cut
    FROM (SELECT *, lower(chunk_text) AS lo, {norm('chunk_text')} AS nt FROM {pre}chunks) c
    CROSS JOIN {rules} r LEFT JOIN defs d ON r.def_key = d.def_key WHERE r.is_active))
WHERE evidence IS NOT NULL""")
    cte(pre + "sentenced", (pre + "chunks",),
        f"SELECT doc_id, chunk_index, {sentences('chunk_text')} AS sents FROM {pre}chunks")
    cte(pre + "kept_hits", (pre + "hits", rules), f"""
SELECT h.*, false AS confirmed, {confidence('false')} AS confidence_score
FROM {pre}hits h JOIN {rules} USING (rule_id) WHERE {confidence('false')} >= {LIMIT}""")


_chunk_ctes("contracts", "")
_chunk_ctes("contract_pages", "p")
for _pre, _rules in (("", "rules"), ("p", "rules"), ("s", "srules")):
    _hit_ctes(_pre, _rules)

# Model labels on contracts
cte("labelled", (), """
SELECT DISTINCT doc_id, 0 AS chunk_index, unnest(list_filter([CASE WHEN toxic = 1 THEN 'Indemnity' END,
  CASE WHEN quality = 1 THEN 'Arbitration' END, 'No Such Category'], lambda x: x IS NOT NULL)) AS category FROM labels""")


def label_ctes(pre: str, labelled: str) -> None:
    """Hits united with model labels: ``{pre}merged`` and ``{pre}kept_hits``."""
    merged = "merged" if pre == "l" else pre + "merged"
    cte(merged, ("hits", labelled, "rules"), f"""
SELECT coalesce(h.doc_id, l.doc_id) AS doc_id, coalesce(h.chunk_index, l.chunk_index) AS chunk_index,
  coalesce(h.rule_id, l.rule_id) AS rule_id, coalesce(evidence, 'llm_only') AS evidence, l.rule_id IS NOT NULL AS confirmed
FROM hits h FULL OUTER JOIN (SELECT doc_id, chunk_index, rule_id FROM {labelled} JOIN rules USING (category) WHERE is_active) l
  ON h.doc_id = l.doc_id AND h.chunk_index = l.chunk_index AND h.rule_id = l.rule_id""")
    cte(pre + "kept_hits", (merged, "chunks", "rules"), f"""
SELECT m.doc_id, m.chunk_index, c.page_number, c.chunk_text, m.rule_id, m.evidence, m.confirmed,
  {confidence('confirmed')} AS confidence_score
FROM {merged} m JOIN rules USING (rule_id) JOIN chunks c USING (doc_id, chunk_index)
WHERE {confidence('confirmed')} >= {LIMIT}""")


label_ctes("l", "labelled")

# A pretended model's labels, by the length of its prompt.
RULE_LINES = ("(SELECT string_agg('- ' || category || ': ' || coalesce(nullif(description, ''), 'No description provided.'), "
              "chr(10) ORDER BY rule_id) FROM rules WHERE is_active)")


def prompt(template: str, **parts: str) -> str:
    out = text(template)
    for n, x in parts.items():
        out = f"replace({out}, '{{{n}}}', {x})"
    return out


CLASSIFY = prompt(CLASSIFY_TEMPLATE, categories=RULE_LINES, passage="chunk_text")
cte("answered", ("chunks", "hits", "rules"), f"""
SELECT DISTINCT doc_id, chunk_index, unnest(CASE length({CLASSIFY}) % 4 WHEN 0 THEN ['Indemnity']
  WHEN 1 THEN ['Arbitration', 'Force Majeure'] ELSE [] END) AS category
FROM (SELECT c.* FROM chunks c WHERE token_count >= 30
  OR EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = c.doc_id AND h.chunk_index = c.chunk_index))""")
label_ctes("m", "answered")


def snippet(hits: str, sentenced: str, rules: str = "rules") -> str:
    """Rows of ``hits`` with the snippet as ``clause_text``."""
    points = ("CASE WHEN contains(lower(s), k) THEN CASE WHEN contains(k, ' ') THEN 3 ELSE 1 END ELSE 0 END")
    wc = lambda s: f"len({words(s)})"
    hit = _by_definition(
        lambda b, closed: f"regexp_matches(s, {text(f'(?i){START}(?:{b})' + (END if closed else ''))})")
    return f"""
SELECT *, CASE WHEN {strip('chunk_text')} = '' THEN '' WHEN len(sents) = 0 THEN {strip('chunk_text')}
  WHEN len(sents) = 1 THEN sents[1]
  WHEN top = 0 THEN CASE WHEN {wc('sents[1]')} < 25 THEN sents[1] || ' ' || sents[2] ELSE sents[1] END
  WHEN b < len(sents) AND (scores[b + 1] > 0 OR ends_with(sents[b], ':')) AND {wc('sents[b]')} + {wc('sents[b + 1]')} <= 65
    THEN sents[b] || ' ' || sents[b + 1]
  WHEN b > 1 AND scores[b - 1] > 0 AND {wc('sents[b]')} + {wc('sents[b - 1]')} <= 65 THEN sents[b - 1] || ' ' || sents[b]
  ELSE sents[b] END AS clause_text
FROM (SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS b FROM (
  SELECT h.*, r.category, r.default_risk_level, r.weight, r.description, r.confidence_threshold, s.sents,
    list_transform(s.sents, lambda s: CASE WHEN {hit} THEN 4 ELSE 0 END + coalesce(list_sum(list_transform(list_concat(CASE WHEN d.def_key IS NULL THEN [lower(r.category)] ELSE list_concat(d.phrases, d.words) END,
          {keyword_list('r.keywords')}), lambda k: {points})), 0)) AS scores
  FROM {hits} h JOIN {rules} r USING (rule_id) LEFT JOIN defs d ON r.def_key = d.def_key
  JOIN {sentenced} s USING (doc_id, chunk_index)))"""


for pre, hits, sent in (("", "kept_hits", "sentenced"), ("p", "pkept_hits", "psentenced"), ("l", "lkept_hits", "sentenced"),
                        ("m", "mkept_hits", "sentenced")):
    cte(pre + "clauses", (hits, sent, "rules", "defs"), f"""
SELECT doc_id, chunk_index, rule_id, category, clause_text,
  coalesce(nullif(description, ''), replace({text(fv.GENERIC_EXPLANATION)}, '%s', category)) AS explanation,
  default_risk_level AS risk_level, weight AS rule_weight, confidence_score, page_number, evidence
FROM ({snippet(hits, sent)})""")
    cte(pre + "ordered", (pre + "clauses",), f"""
SELECT doc_id, lower(category) AS cat, row_number() OVER (PARTITION BY doc_id, lower(category)
  ORDER BY chunk_index, rule_id) AS pos, {{'ci': chunk_index, 'rid': rule_id, 'txt': clause_text, 'conf': confidence_score,
  'page': page_number, 'nt': {norm('clause_text')}, 'tok': {tokens('clause_text')}}} AS c FROM {pre}clauses""")
    dup = (f"(k.nt = o.c.nt OR CASE WHEN k.page IS NOT DISTINCT FROM o.c.page THEN {jaccard('k.tok', 'o.c.tok')} > 0.65 "
           f"OR contains(k.nt, o.c.nt) OR contains(o.c.nt, k.nt) ELSE {jaccard('k.tok', 'o.c.tok')} > 0.75 END)")
    wins = "(k.conf < o.c.conf OR (k.conf = o.c.conf AND length(k.txt) < length(o.c.txt)))"
    take = "{'ci': w.ci, 'rid': w.rid, 'txt': w.txt, 'conf': w.conf, 'page': least(k.page, o.c.page), 'nt': w.nt, 'tok': w.tok}"
    merged_item = f"CASE WHEN {wins} THEN {take.replace('w.', 'o.c.')} ELSE {take.replace('w.', 'k.')} END"
    at = f"coalesce(list_position(list_transform(f.ks, lambda k: {dup}), true), 0)"
    cte(pre + "folded_kept", (pre + "ordered",), f"""
SELECT doc_id, cat, pos, [c] AS ks FROM {pre}ordered WHERE pos = 1
UNION ALL
SELECT f.doc_id, f.cat, o.pos, CASE WHEN {at} = 0 THEN list_append(f.ks, o.c)
  ELSE list_transform(f.ks, lambda k, i: CASE WHEN i = {at} THEN {merged_item} ELSE k END) END
FROM {pre}folded_kept f JOIN {pre}ordered o ON o.doc_id = f.doc_id AND o.cat = f.cat AND o.pos = f.pos + 1""")
    cte(pre + "collapsed", (pre + "folded_kept", pre + "clauses"), f"""
SELECT c.doc_id, c.chunk_index, c.rule_id, c.category, c.clause_text, c.explanation, c.risk_level, c.rule_weight,
  c.confidence_score, k.page AS page_number, {curated('c.category')} AS recommendation
FROM (SELECT doc_id, unnest(ks) AS k FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, cat) AS last FROM {pre}folded_kept)
      WHERE pos = last) f
JOIN {pre}clauses c ON c.doc_id = f.doc_id AND c.chunk_index = k.ci AND c.rule_id = k.rid""")
    docs = {"": "contracts", "l": "contracts", "m": "contracts", "p": "(SELECT DISTINCT doc_id FROM contract_pages)"}[pre]
    doc_cte = {"": "contracts", "l": "contracts", "m": "contracts", "p": "contract_pages"}[pre]
    cte(pre + "reports", (pre + "collapsed", doc_cte), f"""
SELECT doc_id, score AS composite_risk_score, total AS total_risks_found, {RISK.format(high='high', score='score')} AS overall_risk
FROM (SELECT d.doc_id, round(coalesce(sum(rule_weight * {MULTIPLIER}), 0.0)::DOUBLE, 2) AS score, count(c.doc_id) AS total,
        coalesce(bool_or(upper(risk_level) = 'HIGH'), false) AS high
      FROM {docs} d LEFT JOIN {pre}collapsed c USING (doc_id) GROUP BY d.doc_id)""")

# Relational inputs
cte("uploads", (), """
SELECT doc_id, source AS user_id, 'doc_' || doc_id || '.' || (['pdf', 'DOCX', 'doc', 'txt'])[doc_id % 4 + 1] AS original_filename,
  upper((['pdf', 'DOCX', 'doc', 'txt'])[doc_id % 4 + 1]) AS file_type,
  CAST(CASE WHEN doc_id % 50 = 0 THEN 0 WHEN doc_id % 97 = 0 THEN 62914560 ELSE n_chars END AS BIGINT) AS file_size_bytes,
  (['completed', 'pending', 'processing', 'failed'])[doc_id % 4 + 1] AS status,
  CASE WHEN doc_id % 4 = 3 THEN 'broken file' END AS error_message,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS uploaded_at, text FROM documents""")
cte("users", (), """
SELECT user_id, user_id || '@example.org' AS email, 'User ' || user_id AS full_name,
  CASE WHEN n % 5 = 0 THEN 'admin' ELSE 'user' END AS role, n % 3 <> 0 AS is_active,
  TIMESTAMP '2023-06-01 00:00:00' + to_hours(ascii(right(user_id, 1))) AS created_at
FROM (SELECT user_id, length(user_id) + ascii(right(user_id, 1)) AS n
      FROM (SELECT DISTINCT source AS user_id FROM documents UNION ALL SELECT c_name FROM customer))""")
_seeds = texts(s[0] for s in fv.RULE_SEEDS)
cte("tenant_rules", (), f"""
SELECT CAST(c_custkey AS INTEGER) AS rule_id, CASE c_custkey % 6 WHEN 0 THEN b WHEN 1 THEN upper(b) WHEN 2 THEN '  ' || b || ' '
    WHEN 3 THEN 'Old ' || b WHEN 4 THEN b || ' & auto-increase' ELSE c_mktsegment || ' rules' END AS category,
  (['High', 'Medium', 'Low'])[c_custkey % 3 + 1] AS default_risk_level, 0.7::DOUBLE AS confidence_threshold,
  1.0::DOUBLE AS weight, c_name AS description, c_mktsegment || ', Rent ,,' || c_name AS keywords, c_custkey % 7 <> 0 AS is_active
FROM (SELECT *, ({_seeds})[c_custkey % {len(fv.RULE_SEEDS)} + 1] AS b FROM customer)""")
cte("many_rules", (), f"""
SELECT CAST(c_custkey - CASE WHEN c_custkey % 100 = 1 THEN 1 ELSE 0 END AS INTEGER) AS rule_id, c_custkey % 7 <> 0 AS is_active,
  CASE WHEN c_custkey % 300 = 1 THEN NULL WHEN c_custkey % 300 = 2 THEN '' WHEN c_custkey % 20 = 3 THEN b
    WHEN c_custkey % 20 = 4 THEN '  ' || upper(b) ELSE coalesce(w[6] || ' ' || w[7], c_mktsegment || ' rules') END AS category,
  concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN w[2] END, ' ' || w[3] || ' ' || w[4],
    CASE WHEN c_custkey % 50 = 0 THEN 'Rent' END, c_name) AS keywords
FROM (SELECT c.*, string_split(text, ' ') AS w, ({_seeds})[c_custkey % {len(fv.RULE_SEEDS)} + 1] AS b
      FROM customer c LEFT JOIN documents ON doc_id = c_custkey)""")
cte("many_resolved", ("many_rules",), f"""
SELECT *, row_number() OVER (ORDER BY rule_id, category, keywords) AS rid, {definition_key('category')} AS def_key, {keyword_list('keywords')} AS kws
FROM many_rules WHERE is_active""")
# Word starts marked, so that a keyword's own place is a plain search.
_STARTS = lambda x: f"regexp_replace({x}, {text(f'({NOT_W})({PLAIN_WORD})')}, '\\1' || chr(1) || '\\2', 'g')"
_QUOTED = "regexp_replace(k, '([[:punct:]])', '\\\\\\1', 'g')"
cte("many_hits", ("chunks", "defs", "many_resolved"), f"""
WITH c AS MATERIALIZED (SELECT *, lower(chunk_text) AS lo, {norm('chunk_text')} AS nt, {_STARTS("chr(10) || lower(chunk_text)")} AS starts FROM chunks),
terms AS MATERIALIZED (SELECT k, chr(1) || {_STARTS('k')} AS start, regexp_matches(k, {text('^' + PLAIN_WORD)}) AS opens
  FROM (SELECT DISTINCT unnest(kws) AS k FROM many_resolved)),
found AS (SELECT doc_id, chunk_index, k FROM c JOIN terms ON CASE WHEN contains(k, ' ') THEN contains(lo, k) OR contains(nt, k)
  WHEN opens THEN contains(starts, start) WHEN contains(lo, k) THEN regexp_matches(lo, {text(PLAIN_WORD)} || {_QUOTED}) END),
own AS (SELECT doc_id, chunk_index, rid, arg_min(k, pos) AS k FROM found
  JOIN (SELECT rid, unnest(kws) AS k, generate_subscripts(kws, 1) AS pos FROM many_resolved) USING (k) GROUP BY ALL),
base AS (SELECT doc_id, chunk_index, rid, evidence FROM ({_DEFINITION_HITS}) JOIN many_resolved USING (def_key)
  UNION ALL SELECT doc_id, chunk_index, rid, 'contextual' FROM c JOIN many_resolved ON def_key IS NULL
    AND (contains(lo, lower(coalesce(category, ''))) OR contains(nt, lower(coalesce(category, '')))))
SELECT doc_id, chunk_index, rule_id, CASE WHEN contains(k, ' ') THEN 'exact_phrase' WHEN k IS NOT NULL THEN 'contextual'
  ELSE evidence END AS evidence
FROM (SELECT * FROM own FULL JOIN base USING (doc_id, chunk_index, rid)) JOIN many_resolved USING (rid)""")
cte("noisy", (), f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  x || chr(10) || ({texts(fx.NOISE_LINES)})[(i - 1 + doc_id) % {len(fx.NOISE_LINES)} + 1]), chr(10)) AS text FROM documents""")
cte("blocks", ("contract_pages",), f"""
SELECT doc_id, page_number, 50.0::DOUBLE AS x0, y0, 50.0::DOUBLE + length(text) AS x1, y0 + 10.0 AS y1, text
FROM (SELECT doc_id, page_number, l.t AS text, ((l.i - 1) * 12.0 + ((l.i - 1) // 5) * 40.0)::DOUBLE AS y0 FROM (
  SELECT doc_id, page_number, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'i': i, 't': t}})) AS l FROM contract_pages))
WHERE {strip('text')} <> ''""")
cte("block_clauses", ("pclauses",), f"""
SELECT doc_id, doc_id || ':' || chunk_index || ':' || rule_id AS clause_id, category, explanation, clause_text,
  lower(array_to_string((words)[1:4], ' ')) AS prefix, lower(array_to_string(words, ' ')) AS whole, len(words) AS n_words, terms,
  CAST(CASE WHEN chunk_index % 3 = 0 THEN page_number WHEN chunk_index % 3 = 1 THEN page_number + 50 ELSE 1 END AS INTEGER) AS page_number
FROM (SELECT p.*, t.terms, {words('p.clause_text')} AS words FROM pclauses p JOIN (
  SELECT category, explanation, {clause_terms('category', 'explanation')} AS terms
  FROM (SELECT DISTINCT category, explanation FROM pclauses)) t
  ON t.category = p.category AND t.explanation = p.explanation)""")
_heading = text(re2(fv.SECTION_HEADING))
_footer = " OR ".join([f"contains(lower(text), {text(w)})" for w in fv.FOOTER_WORDS]
                      + [f"regexp_matches(lower(text), {text(re2(fv.FOOTER_DATE, False))})"])
cte("placed", ("blocks",), f"""
SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_number ORDER BY idx) AS INTEGER) AS paragraph FROM (
  SELECT *, CASE WHEN gap >= 0 AND gap <= 22 AND NOT regexp_matches({strip('text')}, {_heading}) THEN 0 ELSE 1 END AS opens FROM (
    SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, y0 - lag(y1) OVER w AS gap, lower(text) AS low,
      x1 - x0 > 2 AND y1 - y0 > 2 AS drawable
    FROM (SELECT *, {_footer} AS footer, sum(CASE WHEN {_footer} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number) AS bodies FROM blocks)
    WHERE NOT footer OR bodies = 0 WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY round(y0, 1), round(x0, 1), y1, x1, text)))""")
cte("scored_blocks", ("placed", "block_clauses"), f"""
SELECT b.doc_id, c.clause_id, c.page_number AS own_page, b.page_number, b.idx, b.paragraph,
  len(list_filter(c.terms, lambda t: contains(b.low, t))) AS score, c.n_words >= 4 AND contains(b.low, c.prefix) AS prefixed,
  c.n_words > 0 AND contains(b.low, c.whole) AS held
FROM placed b JOIN block_clauses c USING (doc_id)""")
cte("page_best", ("scored_blocks",), """
SELECT doc_id, clause_id, own_page, page_number, idx, paragraph FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id, page_number ORDER BY score DESC, idx) AS r
  FROM scored_blocks WHERE score > 0 OR prefixed)
WHERE r = 1""")
cte("whole_best", ("scored_blocks",), """
SELECT doc_id, clause_id, own_page, page_number, idx, paragraph FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id, page_number ORDER BY score DESC, idx) AS r
  FROM scored_blocks WHERE score > 0 OR held)
WHERE r = 1""")
