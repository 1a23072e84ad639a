"""The queries of this subpackage and the SQL they can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import bytededup, chat, decontaminate, divergence, langid, linededup, lm, packing, quality, simhash, trie, urls, worddedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json() -> str:
    """Definition of the tokenizer that packing uses, read where the query is written."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its neighbour's answer, see :func:`chat.format_swapped`; every turn of the table is used."""
    return chat.digests(chat.format_swapped(_table(spark, sf_dir, "conversations")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["lines"])), F.lit(0)).cast("bigint")
    return out.select("row.doc_id", "n_lines", "n_removed", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("longest_run"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"), held_out())


def op4_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytededup.dedup_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = worddedup.dedup_words(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join("items", ",", "null").alias("item_ids"), "n_tokens")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_json())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(trie.rebuilt(trie.ordered_turns(_table(spark, sf_dir, "conversations"))))
    return nodes.drop("preorder", "subtree_end")


def lm_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"), lm_held_out())


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_preference_format, op2_line_dedup, op3_language_id, op4_byte_dedup, op5_word_dedup, op6_url_filter, op7_simhash, op8_decontaminate, op9_quality_rules, op10_packing, op11_prefix_trie, op12_lm_score, op13_source_divergence)
}

_RENDER = "array_to_string(list_transform({0}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')"
_MASK = "array_to_string(list_transform({0}, lambda t: '0:' || length('<|im_start|>' || t.role || chr(10)) || CASE WHEN t.role = 'assistant' THEN ' 1:' ELSE ' 0:' END || length(t.text || '<|im_end|>') || ' 0:1'), ' ')"
_RANKED = sorted(urls.PATTERNS, key=lambda r: (-r.rank, r.name))
_GENERAL = "CASE " + " ".join(f"WHEN regexp_matches(lower(host || path), '^{v}') THEN '{k}'" for k, v in ((k, "(?:" + "|".join(r.pattern for r in _RANKED if r.verdict == k) + ")") for k in ("allow", "block"))) + " ELSE 'allow' END"
_LAST = "coalesce(list_max(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN i END), lambda i: i IS NOT NULL)) - 1, len({0}))"
_WORDED = r"regexp_matches(line, '[^\x20\x09-\x0D]')"

#: CRC-32 of a decimal number: its digits' bytes, and eight steps after each.
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(({0})::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

#: SQL for the queries that it can express at this size; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_preference_format": f"""
WITH t AS (SELECT conv_id >> 1 AS g, conv_id & 1 = 1 AS r, turn, replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
h AS (SELECT g, coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (NOT r), []) AS a, coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (r), []) AS b FROM t GROUP BY g),
e AS (SELECT 2 * g AS pair_id, a, b FROM h UNION ALL SELECT 2 * g + 1, b, a FROM h),
l AS (SELECT *, {_LAST.format('a')} AS m, {_LAST.format('b')} AS n FROM e WHERE len(a) > 0),
s AS (SELECT pair_id, a AS c, list_concat(a[1:m], b[n+1:]) AS d FROM l),
k AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(c), len(d)) + 1), lambda i: c[i] IS NOT DISTINCT FROM d[i]), false), 0) - 1, len(c)) AS k FROM s)
SELECT pair_id, CASE WHEN len(c) = 0 OR len(d) = 0 THEN 'unpaired' WHEN k = len(c) AND k = len(d) THEN 'identical' ELSE 'pair' END AS status, k AS n_prefix_turns,
 {_RENDER.format('c[1:k]')} AS prompt, {_RENDER.format('c[k+1:]')} AS chosen, {_MASK.format('c[k+1:]')} AS chosen_mask, {_RENDER.format('d[k+1:]')} AS rejected, {_MASK.format('d[k+1:]')} AS rejected_mask FROM k""",
    "op2_line_dedup": rf"""
WITH e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, list(line) OVER near AS ls, list(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER near AS ws FROM e WHERE {_WORDED}
 WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
n AS (SELECT doc_id, p, ls, unnest(list_filter(range(1, len(ws) + 1), lambda k: list_sum(ws[1:k]) >= 8 AND (coalesce(list_sum(ws[1:k-1]), 0) < 8 OR coalesce(list_sum(ws[2:k]), 0) < 8))) AS need FROM w),
f AS (SELECT doc_id, p, need, row_number() OVER (PARTITION BY need, md5(array_to_string(ls[1:need], chr(10))) ORDER BY doc_id, p) > 1 AS later FROM n),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + need)) AS p FROM f WHERE later),
g AS (SELECT doc_id, i, p FROM c JOIN w USING (doc_id, p)),
r AS (SELECT doc_id, count(*) AS n_runs, max(m) AS longest_run FROM (SELECT doc_id, count(*) AS m FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_lines, count(p) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (p IS NULL), '')) AS kept_sha256 FROM e LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, kept_sha256 FROM k LEFT JOIN r USING (doc_id)""",
    "op4_byte_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS f FROM n) WHERE doc_id > f),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM s)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM p),
k AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op5_word_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(13)) AS o FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM n) WHERE doc_id > first)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept FROM x LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_url_filter": rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')) v(rule, verdict, h, s)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, {_GENERAL}) AS verdict FROM q LEFT JOIN b USING (page_id)""",
    "op11_prefix_trie": rf"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS c FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC.format('conv_id')} % 4 AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(b.c, [])[1:h.h], h.c[h.h+1:]) AS c FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, len(c) AS n, md5(coalesce(c[1:d], [])::VARCHAR) AS id, md5(coalesce(c[1:d-1], [])::VARCHAR) AS up, CASE WHEN d > 0 THEN len(regexp_extract_all(c[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT conv_id, c, unnest(range(0, len(c) + 1)) AS d FROM r)),
n AS (SELECT id, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY id, d),
k AS (SELECT up AS id, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (id, d)),
s AS (SELECT m.id, m.d, sum(CASE WHEN a.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((a.n_convs - 1) * a.w)::BIGINT AS saved_tokens FROM a JOIN m ON m.conv_id = a.conv_id AND m.d <= a.d GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256 FROM a JOIN s USING (id, d) LEFT JOIN n p ON p.id = a.up AND p.d = a.d - 1""",
    "op13_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS doc FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM (SELECT lang, source, doc, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v)::HUGEINT) AS p, (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * v)::HUGEINT) AS q FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 10""",
}
