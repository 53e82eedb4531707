"""Equivalent SQL for the registered queries, written independently of the Spark plans.

``sql(body)`` puts the common table expressions that a body mentions in front of
it. Only the fixed value tables are shared with the library.
"""

from __future__ import annotations

import re

from civiltext.plans import planted
from civiltext.values import rules, terms

W = r"[\p{L}\p{N}_]+"
NW = r"[^\p{L}\p{N}_]"
SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NSP = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({cols})"


def one_of(items: list[str]) -> str:
    return "(" + ", ".join(map(lit, items)) + ")"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SP}+|{SP}+$', '', 'g')"


def n_of(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, {lit(pattern)}))"


def n_words(e: str) -> str:
    return n_of(e, NSP + "+")


def blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, '{NSP}'))"


def any_contains(e: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(i)})" for i in items) + ")"


def rank(e: str) -> str:
    return f"coalesce(list_position(['none','low','medium','high','critical'], {e}) - 1, 0)"


def name(e: str) -> str:
    return f"(['none','low','medium','high','critical'])[{e} + 1]"


def points(*cases: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in cases) + " ELSE 0.0::DOUBLE END"


CTES: dict[str, str] = {}


def sql(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with every common table expression it needs, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for cte in re.findall(r"\bc_\w+\b", text):
            if cte in CTES and cte not in needed:
                visit(CTES[cte])
                if cte not in needed:
                    needed.append(cte)

    visit(body)
    if not needed:
        return body
    # materialised: each relation is computed once however often it is read
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    if body.lstrip().upper().startswith("WITH"):
        rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{body}"


# -- planted messages and mined terms ----------------------------------------------------

CTES["c_snip"] = values(planted.SNIPPETS, "k, mode, snippet")
CTES["c_msgs"] = """
SELECT d.doc_id, d.doc_id * 2 AS msg_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 37) AS ts,
       d.doc_id % 97 AS user_id, d.doc_id % 211 AS conv_id, d.lang,
       CASE WHEN s.mode = 'append' THEN concat(d.text, ' ', s.snippet) ELSE d.text END AS text
FROM documents d LEFT JOIN c_snip s ON d.doc_id % 24 = s.k
UNION ALL
SELECT d.doc_id, d.doc_id * 2 + 1, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 37),
       d.doc_id % 97, d.doc_id % 211, d.lang, s.snippet
FROM documents d JOIN c_snip s ON d.doc_id % 24 = s.k AND s.mode = 'bare'"""
CTES["c_toklist"] = f"SELECT msg_id, regexp_extract_all(lower(text), '{W}') AS w FROM c_msgs"
CTES["c_tok"] = "SELECT msg_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM c_toklist"
CTES["c_minedoc"] = "SELECT doc_id, lang, text FROM documents"
CTES["c_toxtok"] = f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang, unnest(w) AS token, generate_subscripts(w, 1) AS pos
FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '{W}') AS w FROM c_minedoc)"""
CTES["c_mined"] = """
SELECT term, kind, lang, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity
FROM (
  SELECT DISTINCT doc_id, lang, token AS term, 'word' AS kind FROM c_toxtok
  UNION ALL
  SELECT DISTINCT a.doc_id, a.lang, concat(a.token, ' ', b.token), 'phrase'
  FROM c_toxtok a JOIN c_toxtok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
) GROUP BY term, kind, lang"""
CTES["c_vocab"] = f"""
SELECT DISTINCT CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang, term
FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents)"""

# -- packaged lexicon ---------------------------------------------------------------------


def _rows(languages: dict, prio: int) -> list[tuple]:
    out = []
    for lang, d in languages.items():
        for key, kind in (("words", "word"), ("phrases", "phrase"), ("patterns", "pattern")):
            out += [(t, kind, lang, None, prio) for t in d[key]]
        out += [(t, "severity", lang, s, prio) for t, s in d["severity"].items()]
    return out


CTES["c_default"] = values(_rows(terms.DEFAULT_LANGUAGES, 0), "term, kind, lang, severity, prio")
CTES["c_shipped"] = values(_rows(terms.SHIPPED_LANGUAGES, 1), "term, kind, lang, severity, prio")
CTES["c_levels"] = """
SELECT lang, term, arg_max(severity, prio) AS sev
FROM (SELECT * FROM c_default UNION ALL SELECT * FROM c_shipped) WHERE kind = 'severity' GROUP BY ALL"""
CTES["c_lex"] = """
SELECT DISTINCT r.lang, r.kind, r.term, coalesce(l.sev, 'medium') AS severity
FROM (SELECT * FROM c_default UNION ALL SELECT * FROM c_shipped) r LEFT JOIN c_levels l USING (lang, term)
WHERE r.kind <> 'severity' AND NOT (r.kind = 'word' AND r.lang = 'english' AND r.term IN ('nobody', 'die', 'kill'))"""
CTES["c_native"] = values(
    [(t, l, s) for l, m in terms.NATIVE_PHRASES.items() for t, s in m.items()], "term, lang, severity"
)
CTES["c_slex"] = """
SELECT s.lang, s.kind, s.term, coalesce(m.severity, 'medium') AS severity
FROM c_shipped s LEFT JOIN (SELECT lang, term, severity FROM c_shipped WHERE kind = 'severity') m USING (lang, term)
WHERE s.kind <> 'severity'"""

# -- matching -------------------------------------------------------------------------------


def gap_ctes(prefix: str, tok: str, phrases: str, max_gap: str = "2") -> None:
    """First greedy gapped match per (message, phrase) as a chain of nearest positions."""
    CTES[f"{prefix}1"] = f"""
SELECT t.msg_id, p.lang, p.term, p.severity, string_split(p.term, ' ') AS w, len(string_split(p.term, ' ')) AS n,
       t.pos AS p1, t.pos AS e FROM {tok} t JOIN {phrases} p ON t.token = string_split(p.term, ' ')[1]"""
    for k in (2, 3, 4):
        CTES[f"{prefix}{k}"] = f"""
SELECT g.msg_id, g.lang, g.term, g.severity, g.w, g.n, g.p1, min(t.pos) AS e
FROM {prefix}{k - 1} g JOIN {tok} t
  ON t.msg_id = g.msg_id AND t.token = g.w[{k}] AND t.pos > g.e AND t.pos <= g.e + {max_gap} + 1
WHERE g.n >= {k} GROUP BY ALL"""
    parts = " UNION ALL ".join(f"SELECT * FROM {prefix}{k} WHERE n = {k}" for k in (1, 2, 3, 4))
    CTES[f"{prefix}first"] = f"""
SELECT msg_id, lang, term, any_value(severity) AS severity, any_value(n) AS n, min(p1) AS p1, arg_min(e, p1) AS e
FROM ({parts}) GROUP BY msg_id, lang, term"""


CTES["c_phr"] = "SELECT * FROM c_lex WHERE kind = 'phrase'"
gap_ctes("c_gap", "c_tok", "c_phr")
CTES["c_pathits"] = """
SELECT m.msg_id, p.lang, p.term AS pattern, len(regexp_extract_all(lower(m.text), '(?i)' || p.term)) AS hits
FROM c_msgs m CROSS JOIN (SELECT * FROM c_lex WHERE kind = 'pattern') p"""
CTES["c_present"] = """
SELECT DISTINCT msg_id, lang FROM (
  SELECT t.msg_id, l.lang FROM c_tok t JOIN c_lex l ON l.kind = 'word' AND l.term = t.token
  UNION ALL SELECT m.msg_id, p.lang FROM c_msgs m JOIN c_phr p ON contains(lower(m.text), p.term)
  UNION ALL SELECT msg_id, lang FROM c_pathits WHERE hits > 0
  UNION ALL SELECT msg_id, 'hindi' FROM c_msgs WHERE regexp_matches(text, '[\\x{0900}-\\x{097F}]')
  UNION ALL SELECT msg_id, 'english' FROM c_msgs
) JOIN (SELECT msg_id FROM c_msgs WHERE NOT """ + blank("text") + """) USING (msg_id)"""
CTES["c_alldet"] = """
SELECT t.msg_id, 'single_word' AS type, t.token AS value, l.lang, l.severity,
       CASE l.severity WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.4 ELSE 0.8 END AS confidence
FROM c_tok t JOIN c_lex l ON l.kind = 'word' AND l.term = t.token
UNION ALL
SELECT msg_id, 'phrase', term, lang, severity, (0.3::DOUBLE + 0.2 * n / (e - p1 + 1)) * 1.5 FROM c_gapfirst
UNION ALL
SELECT m.msg_id, 'native_phrase', n.term, n.lang, n.severity, CASE n.severity WHEN 'medium' THEN 0.4::DOUBLE ELSE 0.5 END
FROM c_msgs m JOIN c_native n ON contains(m.text, n.term)
UNION ALL
SELECT msg_id, 'pattern', pattern, lang, 'medium', 0.4::DOUBLE FROM c_pathits, range(hits) r"""
CTES["c_det"] = "SELECT d.* FROM c_alldet d JOIN c_present p USING (msg_id, lang)"
CTES["c_multi"] = f"""
SELECT m.msg_id, m.doc_id, m.ts, m.user_id, m.conv_id, m.text, coalesce(d.n, 0) AS n_detections,
       CASE WHEN coalesce(d.n, 0) > 2 THEN least(least(d.total, 1.0) * 1.2, 1.0) ELSE least(coalesce(d.total, 0.0), 1.0) END AS confidence,
       coalesce(d.r, 0) AS r, {blank('m.text')} AS is_blank
FROM c_msgs m LEFT JOIN (
  SELECT msg_id, count(*) AS n, sum(confidence) AS total, max({rank('severity')}) AS r FROM c_det GROUP BY msg_id
) d USING (msg_id)"""
CTES["c_score"] = f"""
SELECT * EXCLUDE (r, is_blank), NOT is_blank AND confidence >= 0.3 AS is_bullying,
       CASE WHEN NOT is_blank AND confidence >= 0.3 THEN {name('r')} ELSE 'none' END AS severity FROM c_multi"""
# the same profile over the bare documents
for _c in ("toklist", "tok", "gap1", "gap2", "gap3", "gap4", "gapfirst", "pathits", "present", "alldet", "det", "multi", "score"):
    CTES[f"c_d{_c}"] = re.sub(
        r"\bc_(msgs|toklist|tok|gap1|gap2|gap3|gap4|gapfirst|pathits|present|alldet|det|multi|score)\b", r"c_d\1", CTES[f"c_{_c}"]
    )
CTES["c_dmsgs"] = "SELECT doc_id, doc_id AS msg_id, NULL AS ts, 0 AS user_id, 0 AS conv_id, lang, text FROM documents"
for _c in ("toklist", "tok", "gap1", "gap2", "gap3", "gap4", "gapfirst", "pathits", "present", "alldet", "det", "multi", "score"):
    CTES[f"c_v{_c}"] = re.sub(
        r"\bc_(msgs|toklist|tok|gap1|gap2|gap3|gap4|gapfirst|pathits|present|alldet|det|multi|score)\b", r"c_v\1", CTES[f"c_{_c}"]
    )
CTES["c_vmsgs"] = "SELECT turn AS doc_id, conv_id * 100000 + turn AS msg_id, NULL AS ts, 0 AS user_id, conv_id, 'en' AS lang, text FROM conversations"

# -- normalising ------------------------------------------------------------------------------


def runs(cte: str, source: str, keep: int, vowels: bool) -> None:
    """Shorten runs of 3+ equal characters to ``keep``, then vowel runs to one, character by character."""
    CTES[f"{cte}_ch"] = f"""
SELECT msg_id, unnest(c) AS ch, generate_subscripts(c, 1) AS i
FROM (SELECT msg_id, regexp_extract_all({source}, '(?s).') AS c FROM c_msgs)"""
    CTES[f"{cte}_isl"] = f"""
SELECT *, sum(new) OVER (PARTITION BY msg_id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY msg_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM {cte}_ch)"""
    CTES[f"{cte}_run"] = f"SELECT msg_id, g, any_value(ch) AS ch, count(*) AS n FROM {cte}_isl GROUP BY msg_id, g"
    length = f"CASE WHEN n >= 3 AND ch <> chr(10) THEN {keep} ELSE n END"
    if vowels:
        length = f"CASE WHEN ch IN ('a','e','i','o','u') THEN 1 ELSE {length} END"
    CTES[cte] = f"""
SELECT m.msg_id, coalesce(s.t, '') AS t FROM c_msgs m LEFT JOIN (
  SELECT msg_id, string_agg(repeat(ch, ({length})::BIGINT), '' ORDER BY g) AS t FROM {cte}_run GROUP BY msg_id) s USING (msg_id)"""


def rewrite(e: str, variants: list[tuple[str, str]]) -> str:
    """Nested replacements, one per neighbouring group of variants with one target."""
    groups: list[tuple[list[str], str]] = []
    for v, target in variants:
        if groups and groups[-1][1] == target:
            groups[-1][0].append(v)
        else:
            groups.append(([v], target))
    for vs, target in groups:
        e = f"regexp_replace({e}, {lit(chr(92) + 'b(?:' + '|'.join(re.escape(v) for v in vs) + ')' + chr(92) + 'b')}, {lit(target)}, 'g')"
    return e


def leet(e: str, profile: str) -> str:
    source, target = rules.LEET[profile]
    return f"translate({e}, {lit(source)}, {lit(target)})"


def shapes(e: str, profile: str) -> str:
    for shape, letter in rules.SHAPES[profile]:
        e = f"replace({e}, {lit(shape)}, {lit(letter)})"
    return e


def punct(e: str, profile: str) -> str:
    dots = "4" if profile == "config" else "3"
    e = f"regexp_replace(regexp_replace(regexp_replace({e}, '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g'), '\\.{{{dots},}}', '...', 'g')"
    return f"regexp_replace(regexp_replace({e}, '-{{2,}}', '-', 'g'), '\\*{{2,}}', '*', 'g')" if profile == "category" else e


def separators(e: str) -> str:
    return f"regexp_replace({e}, '([a-z])[-_*@#$%^&+=|~`]([a-z])', '\\1\\2', 'g')"


def edges(e: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(regexp_extract_all({e}, '{NSP}+'), "
        f"lambda x: regexp_replace(x, '^{NW}+|{NW}+$', '', 'g')), lambda x: x <> ''), ' ')"
    )


runs("c_sq2", "lower(text)", 2, True)
CTES["c_ncat1"] = f"SELECT msg_id, {rewrite('t', rules.CATEGORY_VARIANTS)} AS t FROM c_sq2"
CTES["c_ncat2"] = f"SELECT msg_id, array_to_string(regexp_extract_all({shapes(leet('t', 'category'), 'category')}, '{NSP}+'), ' ') AS t FROM c_ncat1"
CTES["c_ncat"] = f"SELECT msg_id, {edges(separators(punct('t', 'category')))} AS t FROM c_ncat2"
CTES["c_ncfg1"] = f"SELECT msg_id, {shapes(leet(rewrite('lower(text)', rules.CONFIG_VARIANTS), 'config'), 'config')} AS t FROM c_msgs"
CTES["c_cfgch"] = "SELECT msg_id, unnest(c) AS ch, generate_subscripts(c, 1) AS i FROM (SELECT msg_id, regexp_extract_all(t, '(?s).') AS c FROM c_ncfg1)"
CTES["c_cfgisl"] = """
SELECT *, sum(new) OVER (PARTITION BY msg_id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY msg_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM c_cfgch)"""
CTES["c_cfgrun"] = "SELECT msg_id, g, any_value(ch) AS ch, count(*) AS n FROM c_cfgisl GROUP BY msg_id, g"
CTES["c_ncfg2"] = """
SELECT m.msg_id, coalesce(s.t, '') AS t FROM c_msgs m LEFT JOIN (
  SELECT msg_id, string_agg(repeat(ch, (CASE WHEN n >= 3 AND ch <> chr(10) THEN 1 ELSE n END)::BIGINT), '' ORDER BY g) AS t
  FROM c_cfgrun GROUP BY msg_id) s USING (msg_id)"""
CTES["c_ncfg"] = f"SELECT msg_id, {strip(punct('t', 'config'))} AS t FROM c_ncfg2"
CTES["c_nleg"] = f"SELECT msg_id, {punct(leet('lower(' + strip('text') + ')', 'legacy'), 'legacy')} AS t FROM c_msgs"

# -- features -------------------------------------------------------------------------------------


def feature(cte: str, inner: str, groups: list[list[tuple[str, float, str]]], extra: str = "") -> None:
    score = " + ".join("(" + points(*[(c, p) for c, p, _ in g]) + ")" for g in groups)
    names = ", ".join(
        "CASE " + " ".join(f"WHEN {c} THEN {lit(n)}" for c, _, n in g) + " END" for g in groups
    )
    CTES[cte] = f"SELECT msg_id, {score} AS score, coalesce(array_to_string([{names}], ','), '') AS indicators{extra} FROM ({inner})"


def within(p: str) -> str:
    return rf"(^|{NW})(?:{p})({NW}|$)"


feature(
    "c_fcaps",
    f"""SELECT *, CASE WHEN letters > 0 THEN capitals / letters ELSE 0.0 END AS ratio, CASE WHEN letters > 0 THEN r ELSE 0 END AS seqs
    FROM (SELECT msg_id, {n_of('text', chr(92) + 'p{L}')} AS letters, {n_of('text', chr(92) + 'p{Lu}')} AS capitals, {n_of('text', '[A-Z]{4,}')} AS r FROM c_msgs)""",
    [
        [("ratio > 0.7", 0.25, "excessive_caps"), ("ratio > 0.5", 0.15, "high_caps"), ("ratio > 0.3", 0.1, "moderate_caps")],
        [("seqs > 2", 0.15, "multiple_caps_sequences"), ("seqs > 0", 0.1, "caps_sequence")],
    ],
    ", round(ratio, 6) AS caps_ratio, seqs AS caps_sequences",
)
feature(
    "c_fpunct",
    f"""SELECT *, (b + q + x) / greatest(n, 1) AS density FROM (SELECT msg_id, {n_of('text', '!{2,}')} AS b, {n_of('text', chr(92) + '?{2,}')} AS q,
    {n_of('text', '[?!]{3,}')} AS x, {n_of('text', chr(92) + '.{4,}')} AS d, {n_words('text')} AS n FROM c_msgs)""",
    [
        [("b > 2", 0.2, "very_excessive_exclamation"), ("b > 0", 0.1, "excessive_exclamation")],
        [("x > 0", 0.15, "mixed_aggressive_punctuation")],
        [("d > 0", 0.05, "ellipsis_abuse")],
        [("n < 10 AND density > 0.5", 0.1, "high_punctuation_density")],
    ],
    ", b AS excessive_exclamation, q AS excessive_question, x AS mixed_punct",
)
feature(
    "c_ftarget",
    f"""SELECT *, s / greatest(n, 1) AS density, CASE WHEN n < 10 THEN 0.4 ELSE 0.3 END AS hi, CASE WHEN n < 10 THEN 0.2 ELSE 0.15 END AS med
    FROM (SELECT msg_id, {n_of('lower(text)', rules.SECOND_PERSON)} AS s, regexp_matches(lower(text), {lit(rules.DIRECT_ADDRESS)}) AS da,
    {n_of('lower(text)', rules.POSSESSIVE_ATTACK)} AS pa, len(regexp_split_to_array({strip('text')}, '[.!?]+')) AS sn, {n_words('text')} AS n FROM c_msgs)""",
    [
        [("density > hi", 0.25, "high_personal_targeting"), ("density > med", 0.15, "moderate_personal_targeting")],
        [("da", 0.2, "direct_aggressive_address")],
        [("pa > 0", 0.3, "possessive_attack_pattern")],
        [("s > 3 AND sn <= 2", 0.1, "concentrated_targeting")],
    ],
    ", round(density, 6) AS targeting_density, s AS second_person_count, pa AS possessive_attacks",
)
feature(
    "c_fcmd",
    f"""SELECT msg_id, {n_of('lower(text)', rules.AGGRESSIVE_COMMANDS)} AS a, {n_of('lower(text)', rules.DEMANDS)} AS d,
    {n_of('lower(text)', rules.THREAT_IMPERATIVES)} AS t FROM c_msgs""",
    [
        [("a > 0", 0.4, "aggressive_commands")], [("d > 0", 0.2, "demanding_language")],
        [("t > 0", 0.5, "threatening_imperatives")],
    ],
    ", a AS aggressive_commands, d AS demands, t AS threats",
)
CTES["c_wswords"] = f"SELECT msg_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT msg_id, regexp_extract_all(text, '{NSP}+') AS w FROM c_msgs)"
CTES["c_wordrep"] = """
SELECT msg_id, count(*) FILTER (WHERE lower(word) = nxt AND length(word) > 2) AS n FROM (
  SELECT *, lower(lead(word) OVER (PARTITION BY msg_id ORDER BY pos)) AS nxt FROM c_wswords) GROUP BY msg_id"""
runs("c_raw", "text", 1, False)
CTES["c_charrep"] = "SELECT msg_id, count(*) FILTER (WHERE n >= 4 AND ch <> chr(10)) AS n FROM c_raw_run GROUP BY msg_id"
feature(
    "c_femph",
    f"""SELECT m.msg_id, coalesce(w.n, 0) AS wr, coalesce(c.n, 0) AS cr,
    regexp_matches(m.text, {lit('(^|' + NW + ')[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]' + chr(92) + 's+[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]' + chr(92) + 's+[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_](' + NW + '|$)')}) AS sp
    FROM c_msgs m LEFT JOIN c_wordrep w USING (msg_id) LEFT JOIN c_charrep c USING (msg_id)""",
    [
        [("wr > 1", 0.1, "word_repetition")],
        [("cr > 2", 0.15, "excessive_character_repetition"), ("cr > 0", 0.05, "character_repetition")],
        [("sp", 0.1, "spaced_emphasis")],
    ],
    ", wr AS word_repetition, cr AS char_repetition",
)
CTES["c_capswords"] = f"""
SELECT msg_id, count(*) FILTER (WHERE regexp_full_match(t, '[A-Z]{{3,}}')) AS n
FROM (SELECT msg_id, unnest(regexp_extract_all(text, '{W}')) AS t FROM c_msgs) GROUP BY msg_id"""
feature(
    "c_fstruct",
    f"""SELECT *, CASE WHEN n > 0 THEN c / n END AS ratio FROM (
    SELECT m.msg_id, {n_words('m.text')} AS n, coalesce(k.n, 0) AS c,
      len(list_filter(regexp_extract_all(m.text, '{NSP}+'), lambda x: upper(x) = x AND length(x) > 2)) > 0 AS shout,
      len(regexp_split_to_array({strip('m.text')}, '[.!?]+')) AS parts,
      len(list_filter(regexp_split_to_array({strip('m.text')}, '[.!?]+'), lambda x: len(regexp_extract_all(x, '{NSP}+')) > 2)) = 0 AS short
    FROM c_msgs m LEFT JOIN c_capswords k USING (msg_id))""",
    [
        [("n <= 3 AND shout", 0.1, "short_caps_message")],
        [("parts > 3 AND short", 0.05, "fragmented_aggressive_structure")],
        [("c > 0 AND c < n AND ratio BETWEEN 0.2 AND 0.6", 0.1, "selective_caps_emphasis")],
    ],
    ", n AS word_count, c AS caps_words",
)
CTES["c_ctx"] = """
SELECT msg_id, least(a.score + b.score + c.score + d.score + e.score + f.score, 1.0) AS score,
  array_to_string(list_filter([a.indicators, b.indicators, c.indicators, d.indicators, e.indicators, f.indicators], lambda x: x <> ''), ',') AS indicators
FROM c_fcaps a JOIN c_fpunct b USING (msg_id) JOIN c_ftarget c USING (msg_id) JOIN c_fcmd d USING (msg_id)
JOIN c_femph e USING (msg_id) JOIN c_fstruct f USING (msg_id)"""
_intent = {
    i: " + ".join(
        ["0.0::DOUBLE"] + [f"CASE WHEN regexp_matches(lower(text), {lit(p)}) THEN {w} ELSE 0.0 END" for n, p, w in rules.INTENT_RULES if n == i]
    )
    for i in rules.INTENT_ORDER
}
CTES["c_intent"] = "SELECT msg_id, " + ", ".join(f"{e} AS {i}" for i, e in _intent.items()) + " FROM c_msgs"
CTES["c_polite"] = f"""
SELECT m.msg_id, {any_contains('lower(m.text)', rules.POLITE_PHRASES)} OR list_has_any(t.w, [{', '.join(map(lit, rules.POLITE_WORDS))}]) AS polite
FROM c_msgs m JOIN c_cattok t USING (msg_id)"""
CTES["c_cattok"] = f"SELECT msg_id, regexp_extract_all(t, '{W}') AS w, len(regexp_extract_all(t, '{W}')) AS n FROM c_ncat"
CTES["c_cattoks"] = "SELECT msg_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos, n FROM c_cattok"

# -- category profile ------------------------------------------------------------------------------

CTES["c_cat"] = values([(n, s["severity"], s["boost"]) for n, s in terms.CATEGORY_SETTINGS.items()], "category, severity, boost")
CTES["c_catpat"] = values([(n, p) for n, s in terms.CATEGORY_SETTINGS.items() for p in s["patterns"]], "category, pattern")
CTES["c_catlist"] = f"""
SELECT DISTINCT CASE WHEN {any_contains('term', terms.THREAT_STEMS)} THEN 'threats' ELSE 'direct_insults' END AS category, term
FROM c_shipped WHERE kind = 'word'
UNION ALL {values([(n, w) for n, s in terms.CATEGORY_SETTINGS.items() for w in s['words']], 'category, term')}"""
CTES["c_catword"] = "SELECT DISTINCT category, term FROM c_catlist"
CTES["c_catphr"] = f"""
SELECT DISTINCT CASE WHEN {any_contains('term', terms.THREAT_PHRASES)} THEN 'threats' ELSE 'direct_insults' END AS lang, term, 'x' AS severity
FROM c_shipped WHERE kind = 'phrase'"""


def adaptive_ctes(prefix: str, tok: str, sizes: str, phrases: str) -> None:
    """Candidate matches with adaptive windows and strength for phrases of two to four words."""
    def importance(w: str, k: str) -> str:
        edge = f"least({k}, n - 1 - {k})"
        return (
            f"greatest(0.1, least(1.0, 0.5::DOUBLE + CASE WHEN {w} IN {one_of(rules.STRONG_WORDS)} THEN 0.4 WHEN {w} IN {one_of(rules.ADDRESS_WORDS)} THEN 0.2 ELSE 0.0 END"
            f" + CASE {edge} WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0.0 END"
            f" + CASE WHEN length({w}) <= 2 THEN -0.2 WHEN length({w}) >= 6 THEN 0.1 ELSE 0.0 END))"
        )

    flex = f"CASE WHEN list_has_any(w, [{', '.join(map(lit, rules.FLEXIBLE_WORDS))}]) THEN 1.3::DOUBLE ELSE 1.0 END"
    CTES[f"{prefix}p"] = f"SELECT *, {flex} AS flex, CASE WHEN n <= 2 THEN 1.0::DOUBLE WHEN n <= 4 THEN 1.2 ELSE 1.5 END AS lf FROM (SELECT term, lang, string_split(term, ' ') AS w, len(string_split(term, ' ')) AS n FROM {phrases})"
    CTES[f"{prefix}1"] = f"""
SELECT t.msg_id, p.term, p.lang, p.w, p.n, z.n AS size, p.flex, p.lf,
  greatest(1, least(5, trunc(2 * p.lf * (CASE WHEN z.n < 10 THEN 0.8::DOUBLE WHEN z.n < 20 THEN 1.0 ELSE 1.2 END) * p.flex)))::INT AS lim,
  t.pos AS p1, t.pos AS e, 0 AS gaps, 0.0::DOUBLE AS pen
FROM {tok} t JOIN {prefix}p p ON t.token = p.w[1] JOIN {sizes} z ON z.msg_id = t.msg_id"""
    for k in (2, 3, 4):
        win = f"greatest(1, least(8, trunc(g.lim * (0.5::DOUBLE + imp) * (CASE WHEN {k} = g.n THEN 1.3::DOUBLE ELSE 1.0 END))))::INT"
        CTES[f"{prefix}i{k}"] = f"SELECT *, {importance(f'w[{k}]', str(k - 1))} AS imp FROM {prefix}{k - 1} WHERE n >= {k}"
        CTES[f"{prefix}{k}"] = f"""
SELECT msg_id, term, lang, w, n, size, flex, lf, lim, p1, nxt AS e, gaps + (nxt - e - 1) AS gaps,
  pen + CASE WHEN nxt - e - 1 = 0 THEN 0.0::DOUBLE ELSE least(0.8, least((nxt - e - 1) * 0.15::DOUBLE, 0.6) + (1.0 - imp) * 0.3) END AS pen
FROM (SELECT g.*, min(t.pos) AS nxt FROM {prefix}i{k} g JOIN {tok} t
  ON t.msg_id = g.msg_id AND t.token = g.w[{k}] AND t.pos > g.e AND t.pos <= g.e + {win} + 1 GROUP BY ALL)"""
    parts = " UNION ALL ".join(f"SELECT * FROM {prefix}{k} WHERE n = {k}" for k in (2, 3, 4))
    avg = "(" + " + ".join(f"CASE WHEN n >= {k} THEN {importance(f'w[{k}]', str(k - 1))} ELSE 0.0 END" for k in (1, 2, 3, 4)) + ") / n"
    CTES[f"{prefix}m"] = f"""
SELECT msg_id, term, lang, p1 AS start, e AS "end", gaps, greatest(0.1, least(1.0,
  n / (e - p1 + 1) * 0.3 + {avg} * 0.25 + (1.0 - pen / n) * 0.25
  + (1.0 - least(p1 / size, (size - e) / size) * 0.1) * 0.2 + least(n * 0.05, 0.15))) AS strength FROM ({parts})"""
    overlap = "greatest(0, least(k.\"end\", x[1].\"end\") - greatest(k.start, x[1].start) + 1) / (least(k.\"end\" - k.start, x[1].\"end\" - x[1].start) + 1) > 0.5"
    CTES[f"{prefix}kept"] = f"""
SELECT msg_id, term, lang, unnest(kept, recursive := true) FROM (
  SELECT msg_id, term, lang, list_reduce(cand, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {overlap})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
  FROM (SELECT msg_id, term, lang, list([{{'start': start, 'end': "end", 'gaps': gaps, 'strength': strength}}] ORDER BY -strength, start) AS cand
        FROM {prefix}m GROUP BY msg_id, term, lang))"""


adaptive_ctes("c_cad", "c_cattoks", "c_cattok", "c_catphr")
CTES["c_catdet"] = f"""
SELECT k.msg_id, w.category, w.term AS item, c.boost * (CASE WHEN w.category = 'direct_insults' THEN 1.5::DOUBLE ELSE 1.0 END) AS s
FROM c_cattoks k JOIN c_catword w ON w.term = k.token JOIN c_cat c USING (category) JOIN c_polite p USING (msg_id) JOIN c_ctx x USING (msg_id)
WHERE NOT (k.n = 1 AND k.token IN {one_of(rules.NEVER_ALONE)})
  AND NOT (w.category = 'social_exclusion' AND (p.polite OR x.score < 0.2))
  AND NOT (w.category = 'threats' AND w.term IN ('you', 'your', 'yourself') AND (p.polite OR (k.n <= 3 AND x.score < 0.3)))
UNION ALL
SELECT k.msg_id, k.lang, k.term, c.boost * 1.5 * k.strength FROM c_cadkept k JOIN c_cat c ON c.category = k.lang
UNION ALL
SELECT m.msg_id, p.category, p.pattern, c.boost * 2.0 FROM c_msgs m JOIN c_catpat p ON regexp_matches(lower(m.text), p.pattern) JOIN c_cat c USING (category)"""
CTES["c_catscore"] = f"""
SELECT d.msg_id, d.category, sum(d.s) AS score, any_value(c.severity) AS severity
FROM c_catdet d JOIN c_cat c USING (category) JOIN c_msgs m USING (msg_id) WHERE NOT {blank('m.text')} GROUP BY d.msg_id, d.category"""
_maxint = "greatest(" + ", ".join(f"i.{n}" for n in rules.INTENT_ORDER) + ")"
CTES["c_catraw"] = f"""
SELECT m.msg_id, m.text, {blank('m.text')} AS is_blank, k.n = 1 AS single, {n_words('m.text')} AS ws, x.score AS ctx, x.indicators, {_maxint} AS mi,
  i.threat, i.insult, i.exclusion, coalesce(s.n, 0) AS n, coalesce(s.r, 0) AS r, s.names,
  coalesce(s.sq / s.total, 0.0) * CASE WHEN coalesce(s.n, 0) > 1 THEN 1.0 + 0.1::DOUBLE * s.n / (1.0 + 0.05::DOUBLE * s.n) ELSE 1.0 END
  + CASE WHEN x.score > 0.2 THEN least(x.score * 0.4, 0.25) ELSE 0.0 END
  + CASE WHEN {_maxint} > 0.2 THEN least({_maxint} * 0.5, 0.3) ELSE 0.0 END AS base
FROM c_msgs m JOIN c_cattok k USING (msg_id) JOIN c_ctx x USING (msg_id) JOIN c_intent i USING (msg_id)
LEFT JOIN (SELECT msg_id, count(*) AS n, sum(score) AS total, sum(score * score) AS sq, max({rank('severity')}) AS r,
  string_agg(category, ', ' ORDER BY list_position(['direct_insults','threats','social_exclusion','harassment'], category)) AS names FROM c_catscore GROUP BY msg_id) s USING (msg_id)"""
CTES["c_catcal"] = """
SELECT *, CASE WHEN is_blank OR NOT (n > 0 OR ctx > 0.3 OR mi > 0.3) THEN 0.0
  WHEN b < 0.1 THEN b WHEN b < 0.3 THEN least(b * CASE WHEN n > 0 AND ctx > 0.3 THEN 1.1 ELSE 1.0 END, 0.35)
  WHEN b < 0.7 THEN b * 0.95 WHEN n > 1 OR (n > 0 AND ctx > 0.4) THEN b ELSE least(b * 0.85, 0.8) END AS conf
FROM (SELECT *, least(base * CASE WHEN single AND n > 0 THEN 0.7::DOUBLE WHEN single THEN 0.3 ELSE 1.0 END, 1.0) AS b FROM c_catraw)"""
CTES["c_catres"] = f"""
SELECT msg_id, ctx, mi, n, names, indicators, threat, insult, exclusion, flag AS is_bullying,
  CASE WHEN ws < 3 AND conf > 0.5 THEN conf * 0.8 ELSE conf END AS confidence, conf AS unreduced, ws < 3 AS short, is_blank,
  CASE WHEN NOT flag THEN 'none' WHEN n = 0 THEN 'none' WHEN threat > 0.5 THEN 'critical' ELSE {name('r')} END AS severity
FROM (SELECT *, NOT is_blank AND (n > 0 OR (NOT single AND (conf >= 0.3 OR mi > 0.3))) AS flag FROM c_catcal)"""

# -- config profile ---------------------------------------------------------------------------------

CTES["c_cfglang"] = "SELECT DISTINCT msg_id, lang FROM (" + " UNION ALL ".join(
    f"""SELECT msg_id, {lit(l)} AS lang FROM c_msgs WHERE NOT {blank('text')} AND (regexp_matches(text, {lit(s['script'])})
  OR len(list_filter(regexp_extract_all(lower(text), '{NSP}+'), lambda x: x IN {one_of(s['words'])})) >= 2 OR {any_contains('lower(text)', s['phrases'])})"""
    for l, s in rules.LANGUAGE_INDICATORS.items()
) + ")"
CTES["c_cfglangs"] = f"""
SELECT msg_id, lang FROM c_cfglang UNION ALL
SELECT msg_id, 'english' FROM c_msgs WHERE NOT {blank('text')} AND msg_id NOT IN (SELECT msg_id FROM c_cfglang)"""
CTES["c_cfgtok"] = f"SELECT msg_id, list_filter(regexp_extract_all(t, '{W}'), lambda x: length(x) BETWEEN 2 AND 50) AS w FROM c_ncfg"
CTES["c_cfgtoks"] = "SELECT msg_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM c_cfgtok"
CTES["c_cfgphr"] = "SELECT * FROM c_slex WHERE kind = 'phrase'"
gap_ctes("c_cg", "c_cfgtoks", "c_cfgphr")
_aggr = " + ".join(
    [f"CASE WHEN regexp_matches(m.text, {lit(p)}) THEN {w} ELSE 0.0::DOUBLE END" for _, p, w in rules.CONTEXT_PUNCTUATION]
    + [
        f"CASE WHEN length(m.text) > 0 AND {n_of('m.text', chr(92) + 'p{Lu}')} / length(m.text) >= {low} THEN {w} ELSE 0.0::DOUBLE END"
        for _, low, w in rules.CONTEXT_CAPS
    ]
)
_cmd = " + ".join(f"CASE WHEN list_has_any(t.w, [{', '.join(map(lit, ws))}]) THEN {w} ELSE 0.0::DOUBLE END" for ws, w in rules.CONTEXT_COMMANDS)
CTES["c_cfgctx"] = f"""
SELECT m.msg_id, {_aggr} AS aggression,
  CASE WHEN len(list_filter(t.w, lambda x: x IN {one_of(rules.CONTEXT_PRONOUNS)})) >= 2 THEN 0.2 ELSE 0.0::DOUBLE END AS targeting, {_cmd} AS command
FROM c_msgs m JOIN c_cfgtok t USING (msg_id)"""
CTES["c_cfgdet"] = f"""
SELECT t.msg_id, l.lang, l.severity, 0.3::DOUBLE AS confidence FROM c_cfgtoks t JOIN c_slex l ON l.kind = 'word' AND l.term = t.token JOIN c_cfglangs g ON g.msg_id = t.msg_id AND g.lang = l.lang
UNION ALL
SELECT f.msg_id, f.lang, f.severity, 0.5::DOUBLE * CASE f.e - f.p1 + 1 - f.n WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END
FROM c_cgfirst f JOIN c_cfglangs g ON g.msg_id = f.msg_id AND g.lang = f.lang
UNION ALL
SELECT x.msg_id, x.lang, 'medium', 0.4::DOUBLE FROM (
  SELECT n.msg_id, p.lang, len(regexp_extract_all(n.t, '(?i)' || p.term)) AS hits FROM c_ncfg n CROSS JOIN (SELECT * FROM c_slex WHERE kind = 'pattern') p) x
  JOIN c_cfglangs g ON g.msg_id = x.msg_id AND g.lang = x.lang, range(x.hits) r
UNION ALL
SELECT c.msg_id, 'neutral', 'medium', c.aggression FROM c_cfgctx c JOIN c_msgs m USING (msg_id) WHERE c.aggression > 0.3 AND NOT {blank('m.text')}"""
CTES["c_cfgres"] = f"""
SELECT msg_id, n_detections, n_languages, confidence, is_bullying, CASE WHEN is_bullying THEN {name('r')} ELSE 'none' END AS severity FROM (
  SELECT *, n_detections > 0 AND confidence >= CASE r WHEN 4 THEN 0.9 WHEN 3 THEN 0.7 WHEN 2 THEN 0.4 WHEN 1 THEN 0.2 ELSE 0.3 END AS is_bullying FROM (
    SELECT m.msg_id, coalesce(d.n, 0) AS n_detections, coalesce(d.langs, 0) AS n_languages, coalesce(d.r, 0) AS r,
      CASE WHEN d.n IS NULL THEN 0.0 ELSE least(1.0, d.total * CASE WHEN d.n >= 4 THEN 1.6 WHEN d.n = 3 THEN 1.4 WHEN d.n = 2 THEN 1.2 ELSE 1.0::DOUBLE END
        + least(c.aggression + c.targeting + c.command, 0.3)) END AS confidence
    FROM c_msgs m JOIN c_cfgctx c USING (msg_id) LEFT JOIN (
      SELECT msg_id, count(*) AS n, count(DISTINCT lang) AS langs, sum(confidence) AS total, max({rank('severity')}) AS r FROM c_cfgdet GROUP BY msg_id) d USING (msg_id)))"""

# -- legacy profile -----------------------------------------------------------------------------------

CTES["c_legtok"] = f"SELECT msg_id, t, regexp_extract_all(translate(t, {lit(chr(33) + chr(34) + '#$%&' + chr(39) + '()*+,-./:;<=>?@[' + chr(92) + ']^_`{|}~')}, ''), '{NSP}+') AS w FROM c_nleg"
_levels = "CASE {} " + " ".join(f"WHEN {lit(t)} THEN {lit(s)}" for t, s in terms.LEGACY_SEVERITY.items()) + " ELSE {} END"
_intents = " + ".join(
    f"{0.1}::DOUBLE * {f} * (" + " + ".join(f"(list_contains(w, {lit(k)}) OR contains(t, {lit(k)}))::INT" for k in kws) + ")"
    for kws, f in [(k, {"low": 0.5, "medium": 1.0, "high": 1.5}[s]) for k, s in planted.INTENTS]
)
CTES["c_legint"] = f"SELECT msg_id, least({_intents}, 0.5) AS intent_score FROM c_legtok"
CTES["c_legdet"] = f"""
SELECT msg_id, 0.3::DOUBLE AS s, {_levels.format('token', lit('medium'))} AS severity FROM (SELECT msg_id, unnest(w) AS token FROM c_legtok) WHERE token IN {one_of(terms.LEGACY_WORDS)}
UNION ALL """ + " UNION ALL ".join(
    f"SELECT msg_id, 0.5::DOUBLE, {_levels.format(lit(p), lit('high'))} FROM c_legtok WHERE contains(t, {lit(p)})" for p in terms.LEGACY_PHRASES
)
CTES["c_legres"] = f"""
SELECT msg_id, total_indicators, confidence, is_bullying, CASE WHEN is_bullying THEN {name('r')} ELSE 'none' END AS severity FROM (
  SELECT *, NOT is_blank AND (total_indicators > 0 OR confidence >= 0.3) AS is_bullying FROM (
    SELECT m.msg_id, {blank('m.text')} AS is_blank, coalesce(d.n, 0) AS total_indicators, coalesce(d.r, 0) AS r,
      CASE WHEN {blank('m.text')} THEN 0.0 ELSE least(1.0, coalesce(d.total, 0.0) + i.intent_score) END AS confidence
    FROM c_msgs m JOIN c_legint i USING (msg_id) LEFT JOIN (
      SELECT msg_id, count(*) AS n, sum(s) AS total, max({rank('severity')}) AS r FROM c_legdet GROUP BY msg_id) d USING (msg_id)))"""

# -- verdicts -------------------------------------------------------------------------------------------

CTES["c_rawv"] = "SELECT msg_id, CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(planted.VERDICTS)
) + " ELSE text END AS raw FROM c_msgs"


def verdicts(fallback: str) -> str:
    low = "lower(raw)"
    if fallback == "category":
        flag = any_contains(low, ["bullying", "harassment", "threat"])
        conf, level = f"CASE WHEN {flag} THEN 0.5 ELSE 0.0 END", f"CASE WHEN {flag} THEN 'medium' ELSE 'none' END"
    else:
        flag = any_contains(low, ["yes", "bullying", "harassment", "threat"])
        hi, mid, lo = (any_contains(low, x) for x in (["high", "severe", "serious"], ["medium", "moderate"], ["low", "mild"]))
        conf = f"CASE WHEN {hi} THEN 0.8 WHEN {mid} THEN 0.6 WHEN {lo} THEN 0.4 WHEN {flag} THEN 0.6 ELSE 0.0 END"
        level = f"CASE WHEN {hi} THEN 'high' WHEN {mid} THEN 'medium' WHEN {lo} THEN 'low' ELSE 'none' END"
    j = "CASE WHEN json_valid(raw) AND starts_with(raw, '{') THEN raw::JSON END"
    return f"""
SELECT msg_id, j IS NOT NULL AS parsed,
  CASE WHEN j IS NULL THEN {flag} ELSE coalesce((j->>'is_bullying')::BOOLEAN, false) END AS v_is_bullying,
  (CASE WHEN j IS NULL THEN {conf} ELSE least(greatest(coalesce((j->>'confidence')::DOUBLE, 0.0), 0.0), 1.0) END)::DOUBLE AS v_confidence,
  CASE WHEN j IS NULL THEN {level} ELSE coalesce(j->>'severity', 'none') END AS v_severity,
  CASE WHEN j IS NULL THEN 'other' ELSE coalesce(j->>'primary_category', 'other') END AS v_category,
  CASE WHEN j IS NULL THEN 'ignore' ELSE coalesce(j->>'recommended_action', 'ignore') END AS v_action
FROM (SELECT msg_id, raw, {j} AS j FROM c_rawv)"""


CTES["c_verdict"] = verdicts("category")
CTES["c_verdict1"] = verdicts("legacy")
