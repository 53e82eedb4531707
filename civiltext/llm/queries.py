"""The registered queries of the training-text operators: (spark, sf_dir) to whole results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.bpe import decode, encode
from civiltext.llm.decontam import contaminations
from civiltext.llm.divergence import source_divergence
from civiltext.llm.license_scan import CONFIDENCE, RULES, scan_licenses
from civiltext.llm.neardup import Linking, near_duplicates
from civiltext.llm.pii import find_spans
from civiltext.llm.quality_rank import score_quality
from civiltext.llm.quality_rules import BASE_RULES, METHOD_RULES, STOP_WORDS, Rule, apply_rules
from civiltext.llm.resampling import resample
from civiltext.llm.shards import assign_shards
from civiltext.llm.token_counts import count_tokens
from civiltext.llm.tokenfile import token_file_round_trip
from civiltext.llm.warc import archive_round_trip

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives and back."""
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_spans(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids and back."""
    path = public_tokenizers.path(WORD_BPE)
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle sets of a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), linking=Linking(words=3, percent=85))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids as Huffman-coded files and back."""
    read = token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that set each source apart."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's n-grams, and the documents drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_warc, op2_decontamination, op3_pii, op4_bpe, op5_near_duplicates, op6_token_files, op7_quality_rules,
        op8_quality_rank, op9_histogram_shards, op10_token_counts, op11_license_scan,
        op12_source_divergence, op13_importance_resampling,
    )
}

def rules_sql(rules: list[Rule]) -> str:
    return " AND ".join(f"{r.times} * {r.measure} {r.holds} {r.limit} * {'1' if r.base == 'one' else r.base}" for r in rules)


def signatures_sql() -> str:
    """The signature rules as SQL rows; between words stand two spaces, so that an expression holds its words' own."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    widened = lambda r: quoted(f" (?:{r.regex}) ".replace(" ", "  ")[1:-1])
    return ",\n".join(f"({i}, {quoted(r.label)}, {r.rank}, {str(r.base).lower()}, {widened(r)})" for i, r in enumerate(RULES))


BLANK_SQL = "[\\x20\\x09-\\x0D]"

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r""",
    "op5_near_duplicates": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op7_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{BLANK_SQL}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS k FROM w, unnest(range(1, len(w) - 1)) u(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
gap AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS g FROM dup),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gap GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK_SQL}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'), lambda x: x IN ({', '.join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
  len(list_filter(w, lambda x: regexp_matches(x, '^[^\\p{{L}}]*\\p{{Lu}}{{2}}'))) AS n_capital_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({rules_sql(BASE_RULES)}) AS base_failed,
  {rules_sql(BASE_RULES + METHOD_RULES)} AS kept FROM m""",
    "op12_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS m FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS m FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, k.c, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (g.m + l.v) AS p, 1 + (1000000000 * (k.c + 1)) // (l.m + l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200""",
    "op13_importance_resampling": """
WITH b AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n::BIGINT)) AS t),
d AS (SELECT row_number() OVER () AS r, true AS ours, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), false, NULL, text FROM benchmark),
w AS (SELECT r, ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
f AS (SELECT r, ours, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
k AS (SELECT f, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS k FROM (SELECT DISTINCT f FROM f), b),
n AS (SELECT r, ours, k, count(*) AS n FROM f JOIN k USING (f) GROUP BY ALL),
s AS (SELECT k, coalesce(sum(n) FILTER (ours), 0) AS s, coalesce(sum(n) FILTER (NOT ours), 0) AS t FROM n GROUP BY ALL),
g AS (SELECT k, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM s),
v AS (SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM n JOIN g USING (k) WHERE ours GROUP BY ALL),
o AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(g, 0) AS weight, len(w) >= 20 AS able,
  coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d JOIN w USING (r, ours) LEFT JOIN v USING (r) WHERE ours),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS i, count(*) OVER (PARTITION BY able) AS m FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND i <= 5 * m // 100 THEN i END AS rank FROM p""",
    "op11_license_scan": f"""
WITH rules(i, label, rank, base, regex) AS (VALUES
{signatures_sql()}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
l AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
h AS (SELECT r, t, i, label, rank, base, regex FROM l JOIN rules ON regexp_matches(t, regex)),
g AS (SELECT *, string_split_regex(t, regex) AS gaps, regexp_extract_all(t, regex) AS hits FROM h),
u AS (SELECT r, i, label, rank, base, k, (length(gaps[k]) - length(replace(gaps[k], ' ', ''))) // 2 AS before,
  (length(hits[k]) - length(replace(hits[k], ' ', ''))) // 2 AS n FROM g, unnest(range(1, len(hits) + 1)) x(k)),
f AS (SELECT r, i, label, rank, base, n, (sum(before) OVER o + sum(n) OVER o - n)::BIGINT AS first FROM u WINDOW o AS (PARTITION BY r, i ORDER BY k)),
s AS (SELECT * FROM f a WHERE base OR NOT EXISTS (SELECT 1 FROM f b WHERE b.r = a.r AND b.first <= a.first AND b.first + b.n >= a.first + a.n
  AND ((b.n > a.n AND b.rank <= a.rank) OR (b.n = a.n AND (b.rank < a.rank OR b.rank = a.rank AND b.i < a.i)))))
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (s.base) AS n_base, min(s.first) FILTER (s.base) AS first_word, max(s.first) FILTER (s.base) AS last_word,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label) FILTER (s.base), '') AS base_labels, coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels,
  coalesce(([{', '.join(f'{c}::DOUBLE' for c in CONFIDENCE)}])[min(s.rank) + 1], 0) AS score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id""",
}
