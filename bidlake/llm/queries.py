"""Queries opN_<name>: each operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, decontaminate, hard_negatives, html_text, lexical_search, license_scan, line_runs, ngram_join, piece_codec, quality_rules, secret_scan, unit_dedup, url_filter

MODEL, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.passages(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), vocabulary(RANKS))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.repeated_runs(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat_trees.digest_conversations(rows.unionByName(extra))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits).drop("key", "spans")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary(MODEL))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, F.expr("vec_id % 100 = 0"), positives=5, negatives=5, low=80, high=100, scale=256)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("canonical", "blocked_by")


def base3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the base phrases."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the known forms."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: counts and the base rules."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_ngram_join": op2_ngram_join,
        "op3_license_scan": op3_license_scan,
        "op4_unit_dedup": op4_unit_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_line_runs": op6_line_runs,
        "op7_chat_format": op7_chat_format,
        "op8_decontaminate": op8_decontaminate,
        "op9_piece_codec": op9_piece_codec,
        "op10_quality_rules": op10_quality_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_ranked_search": op12_ranked_search,
        "op13_url_filter": op13_url_filter,
        "base3_licenses": base3_licenses,
        "base5_secrets": base5_secrets,
        "base10_quality": base10_quality,
    }


SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.size + q.size - k)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, r) AS (SELECT x, y FROM both_ways UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways b ON reach.r = b.x)
SELECT doc_id, coalesce(any_value(size), 0) AS n_shingles, least(doc_id, min(r)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY doc_id""",
    # Turns and masked text do not depend on the template; its length does: "### role: text</turn>\n", each "\\" and each "#" before
    # "##" and each "</turn>" of a text one character longer, and the ":" of a role too.
    "op7_chat_format": r"""
WITH said AS (SELECT '\### Assistant: </turn> ok' AS s),
rows AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', s FROM said UNION ALL SELECT -7, 1, 'assistant', s FROM said),
sized AS (SELECT *, length(text) - length(replace(text, '\', '')) + length(regexp_replace(text, '<(/turn>)', 'xx\1', 'g')) - length(text)
  + CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: greatest(0, length(x) - 2))), 0) AS BIGINT) + length(text) AS body,
  length(role) + (length(role) - length(replace(role, ':', ''))) AS head FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op8_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hard_negatives": r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) QUALIFY row_number() OVER w <= 5""",
    "op12_ranked_search": r"""
WITH t AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
asked AS (SELECT item, item_id, unnest(terms) AS term FROM b),
size AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM t WHERE len(words) > 0),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(words) AS n, unnest(words) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, docs),
part AS (SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS impact FROM tf JOIN w USING (term), size),
score AS (SELECT item, item_id, doc, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS INTEGER) AS rank, doc_id, score FROM score
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) <= 50""",
    # The method's globs see canonical paths; this says the same for paths without escapes, dot segments and double slashes.
    "op13_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
p AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, '.' || host AS h, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS c,
 CASE WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches('.' || c, '\.(spam-|adult-|ads-|ads\.|tracker\.)|\..*(casino|porn|viagra)|-pills|-bets') OR regexp_matches(path, '/wp-login\.php$|/affiliate/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
}


SQL |= {
    "base3_licenses": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
h AS (SELECT r, i, 'mit' AS label FROM p WHERE w[i] = 'mit' AND w[i + 1] = 'license' UNION ALL SELECT r, i, 'apache' FROM p WHERE w[i] = 'apache' AND w[i + 1] = 'license'
 UNION ALL SELECT r, i, 'gpl' FROM p WHERE w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'),
g AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (r)""",
    # The place of a match is the first one of its text after the match before: an earlier one would have matched itself.
    "base5_secrets": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, 'assign' AS kind, 1 AS o, t, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS found FROM d
 UNION ALL SELECT r, 'access', 2, t, regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d UNION ALL SELECT r, 'hex', 3, t, regexp_extract_all(t, '[0-9a-f]{24,}') FROM d),

s AS (SELECT r, kind, o, 0 AS k, 0 AS e, 0 AS b, t, found FROM m WHERE len(found) > 0
 UNION ALL SELECT r, kind, o, k + 1, CAST(e + instr(substring(t, e + 1), found[k + 1]) - 1 + length(found[k + 1]) AS INTEGER), CAST(e + instr(substring(t, e + 1), found[k + 1]) - 1 AS INTEGER), t, found FROM s WHERE k < len(found)),
x AS (SELECT r, kind, o, b, e FROM s WHERE k > 0 AND CASE o WHEN 1 THEN length(regexp_extract(found[k], '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 2 THEN e - b >= 20 ELSE true END),
g AS (SELECT r, count(*) FILTER (o = 1) AS a, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS h, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans FROM x GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)""",
    "base10_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
p AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS phrase FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, phrase) AS n FROM p) WHERE n > 1),
q AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM c) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN l USING (r) LEFT JOIN q USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
