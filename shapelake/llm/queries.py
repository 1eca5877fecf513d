"""The thin queries over the given tables and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, jaccard, license_scan, mixing, prefix_trie, quality, tiff, token_counts, toxicity, url_filter, warc
from .common import Scratch, fold, table
from .license_rules import AFTER, BASE, BEFORE, rules

#: Rules of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    found = quality.classify(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents", "doc_id", "text"), percent=90, words=3)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules=URL_RULES)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = f"{chat.END}{chat.START}assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    digests = chat.digest(chat.format_chats(rows.unionByName(added)))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    found = toxicity.classify(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_tokens", F.coalesce(F.size("segments"), F.lit(0)).alias("n_passages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.refer(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    with Scratch(spark) as scratch:
        archives = warc.write_warc(pages, scratch.path("warc"))
        return scratch.keep(warc.digest(warc.read_warc(archives)), "warc-digest")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(tiff.texts_to_tiff(table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_tiff": op10_tiff,
    "op11_collocations": op11_collocations,
    "op12_licenses": op12_licenses,
    "op13_prefix_trie": op13_prefix_trie,
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BOUND = "(^|[^\\p{L}\\p{N}])%s([^\\p{L}\\p{N}]|$)"


def _any_term(terms: tuple[str, ...]) -> str:
    return _BOUND % f"({'|'.join(terms)})"


ORACLE_SQL: dict[str, str] = {
    # Another way to the same windows: 10 of 12 equal tokens leave a run of at least 4.
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS dw FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS bw FROM benchmark),
dp AS (SELECT doc_id, dw, unnest(range(0, len(dw) - 3)) AS p FROM d),
dg AS (SELECT doc_id, p, array_to_string(dw[p + 1 : p + 4], ' ') AS gram FROM dp),
bp AS (SELECT item_id, bw, unnest(range(0, len(bw) - 3)) AS q FROM b),
bg AS (SELECT item_id, q, array_to_string(bw[q + 1 : q + 4], ' ') AS gram FROM bp),
g AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM dg JOIN bg USING (gram)),
w AS (SELECT doc_id, item_id, dw, bw, shift, unnest(range(0, len(bw) - 11)) AS q FROM g JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (
  SELECT doc_id, item_id, q + shift AS p, 12 - len(list_filter(range(1, 13), lambda k: dw[q + shift + k] = bw[q + k])) AS subs
  FROM w WHERE q + shift >= 0 AND q + shift + 12 <= len(dw))
SELECT doc_id, item_id, count(*) AS n_windows, CAST(min(p) AS INTEGER) AS first_token, CAST(max(p) + 12 AS INTEGER) AS end_token, CAST(min(subs) AS INTEGER) AS fewest_subs
FROM v WHERE subs <= 2 GROUP BY doc_id, item_id
""",
    "op3_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op4_url_filter": f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_A_TO_Z}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_host, rule_path, decision) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
fit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(decision, length(rule_host || rule_path)) AS decision
  FROM u JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
h AS (
  SELECT page_id,
    {' + '.join(f"(length(regexp_replace(lower(url), '{_BOUND % f'({t})'}', chr(1), 'g')) - length(replace(regexp_replace(lower(url), '{_BOUND % f'({t})'}', chr(1), 'g'), chr(1), '')))" for t in url_filter.STRICT_TERMS)} AS strict_hits,
    {' + '.join(f"CAST(regexp_matches(lower(url), '{_any_term((t,))}') AS BIGINT)" for t in url_filter.SOFT_TERMS)} AS soft_terms
  FROM u)
SELECT u.page_id, host, path, fit.rule,
  coalesce(fit.decision, CASE WHEN strict_hits > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_terms AS BIGINT) AS soft_terms
FROM u JOIN h USING (page_id) LEFT JOIN fit USING (page_id)
""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 10 + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
""",
    "op9_mixing": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 3) AS INTEGER) AS bucket
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS fixed,
    (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS free,
    (SELECT sum(source_size) FROM s) AS total
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - fixed) / free) AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0.0 END AS rate
  FROM o, l),
c AS (
  SELECT source, bucket, sum(size) AS words,
    coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, bucket),
p AS (
  SELECT c.source, bucket, source_size, target, CAST(floor(rate) AS BIGINT) AS repeats,
    CASE WHEN words = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((rate - floor(rate)) * source_size - before::DOUBLE) / words::DOUBLE)) END::DOUBLE AS part
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, d.source, source_size, target, repeats, part,
  CAST(least(repeats * size + round(part * size), 3.0 * size) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.bucket = p.bucket
""",
    "op11_collocations": f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_A_TO_Z}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k)),
f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS j FROM f WHERE k > 1),
x AS (
  SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(s[1 : j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(s[j + 1 :], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM x),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE cut = 1 AND NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND f.a = b.a AND length(f.phrase) > length(b.phrase) AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
""",
    "op12_licenses": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t),
r(rule, label, keyword, before, after, priority) AS (VALUES {', '.join(f"({r.number}, '{r.label}', '{r.keyword}', '{r.before}', '{r.after}', {r.priority})" for r in rules())}),
m AS (
  SELECT doc_id, i, rule, label, before, priority, regexp_extract(array_to_string(w[i + 1 : i + {AFTER}], ' ') || ' ', '^(?:' || after || ') ') AS a,
    CASE WHEN before <> '' THEN regexp_extract(' ' || array_to_string(w[greatest(i - {BEFORE}, 0) + 1 : i], ' ') || CASE WHEN i > 0 THEN ' ' ELSE '' END, before || '$') ELSE '' END AS b
  FROM u JOIN r ON w[i + 1] = keyword),
d AS (
  SELECT doc_id, i - greatest(length(b) - length(replace(b, ' ', '')) - 1, 0) AS s, i + length(a) - length(replace(a, ' ', '')) AS e, rule, label, priority
  FROM m WHERE a <> '' AND (before = '' OR b <> '')),
k AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND o.s <= d.s AND o.e >= d.e
      AND (o.priority > d.priority OR o.priority = d.priority AND (o.e - o.s > d.e - d.s OR o.e - o.s = d.e - d.s AND o.rule < d.rule)))),
b AS ({' UNION ALL '.join(f"SELECT doc_id, i, '{label}' AS label FROM u WHERE array_to_string(w[i + 1 : i + {len(p.split())}], ' ') = '{p}'" for p, label, _ in BASE)}),
bd AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
kd AS (SELECT doc_id, count(*) AS n_detections, max(priority) / 100.0 AS score FROM k GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, CASE WHEN n_base > 0 THEN 0.1 END, 0) AS DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections
FROM t LEFT JOIN bd USING (doc_id) LEFT JOIN kd USING (doc_id) LEFT JOIN l USING (doc_id)
""",
    # h by the definition of crc32, bit by bit; prefixes are the digests of their turns, joined.
    "op13_prefix_trie": r"""
WITH o AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS g, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(length(role) || ':' || role || text)) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
i AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM o GROUP BY conv_id),
c AS (
  SELECT conv_id, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(s)), lambda k: (ascii(substr(s, CAST(k // 8 + 1 AS BIGINT), 1)) >> (k % 8)::INTEGER) & 1)),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) % 4 AS h FROM i),
k AS (SELECT c.conv_id, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (
  SELECT k.conv_id, place AS depth, g, words FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 20 AND place <= taken
  UNION ALL SELECT k.conv_id, taken + place - h, g, words FROM k JOIN o ON o.conv_id = k.conv_id AND place > h
  UNION ALL SELECT conv_id, 0, '', 0 FROM k),
p AS (
  SELECT conv_id, depth, words, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, max(depth) OVER (PARTITION BY conv_id) AS last FROM r),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(last) = depth AS leaf, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN depth = last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY depth, prefix),
a AS (
  SELECT p.depth, p.prefix, count(*) FILTER (n.depth = p.depth + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a USING (depth, prefix) LEFT JOIN n b ON b.depth = n.depth - 1 AND b.prefix = left(n.prefix, length(n.prefix) - 32)
""",
}
