"""The numbered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .best_fit import op12_best_fit
from .decontamination import op9_spaced_seeds
from .extraction import op6_page_text
from .language import op10_language_id
from .licenses import op4_license_scan
from .neardup import op1_minhash
from .packing import op2_packing
from .pseudonyms import op5_pseudonyms
from .quality import op3_compression_bands
from .resampling import op11_importance_resampling
from .search import op13_ranked_search
from .sharding import op8_label_propagation
from .token_store import op7_token_store

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_compression_bands": op3_compression_bands,
    "op4_license_scan": op4_license_scan,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_page_text": op6_page_text,
    "op7_token_store": op7_token_store,
    "op8_label_propagation": op8_label_propagation,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_best_fit": op12_best_fit,
    "op13_ranked_search": op13_ranked_search,
}
# What SQL can express of operators whose method it cannot.
QUERIES["base_quality"] = lambda spark, d: op3_compression_bands(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
QUERIES["base_licenses"] = lambda spark, d: op4_license_scan(spark, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
QUERIES["base_shards"] = lambda spark, d: op8_label_propagation(spark, d).groupBy("shard").agg(F.count("*").alias("documents"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))
QUERIES["base_sizes"] = lambda spark, d: op8_label_propagation(spark, d).select("doc_id", "size", "law")

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_AHEAD = "lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(x, 3) OVER w AS d, lead(x, 4) OVER w AS e"
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs),
g AS (SELECT doc_id, x || ' ' || b || ' ' || c || ' ' || d || ' ' || e AS s FROM (SELECT doc_id, x, {_AHEAD} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, s FROM g UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM sets l JOIN sets r ON l.s = r.s AND l.doc_id < r.doc_id GROUP BY 1, 2), links AS (SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "base_quality": f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM docs),
g AS (SELECT doc_id, i, x || ' ' || b || ' ' || c || ' ' || d || ' ' || e AS s FROM (SELECT doc_id, i, x, {_AHEAD} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e IS NOT NULL),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1), inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
b AS (SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(inside.n, 0) AS n_repeat_words FROM docs LEFT JOIN inside USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b""",
    "base_licenses": rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM docs),
h AS (SELECT doc_id, i, CASE WHEN x = 'under' AND b = 'the' AND c = 'mit' AND d = 'license' THEN 'mit' WHEN x = 'apache' AND b = 'license' AND c = 'version' AND d = '2' THEN 'apache-2' WHEN x = 'cc' AND b = 'by' AND c = 'nc' THEN 'cc-by-nc' END AS label FROM (SELECT doc_id, i, x, {_AHEAD} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)))
SELECT docs.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(label) AS n_base, min(i) FILTER (WHERE label IS NOT NULL) AS first_word, max(i) FILTER (WHERE label IS NOT NULL) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM docs LEFT JOIN h ON h.doc_id = docs.doc_id GROUP BY docs.doc_id""",
    "base_shards": "WITH n AS (SELECT count(*) AS total FROM documents) SELECT CAST(s AS INTEGER) AS shard, total // 16 + CASE WHEN s < total % 16 THEN 1 ELSE 0 END AS documents, 0 AS first_slot, total // 16 + CASE WHEN s < total % 16 THEN 1 ELSE 0 END - 1 AS last_slot, total // 16 + CASE WHEN s < total % 16 THEN 1 ELSE 0 END AS slots FROM n, range(16) r(s) WHERE total >= 16 OR s < total",
    "base_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'rows' AS law FROM documents",
    "op11_importance_resampling": f"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS ws FROM documents),
goal AS (SELECT unnest(regexp_extract_all({_LOWER}, {_LETTERS})) AS x FROM benchmark),
u AS (SELECT doc_id, unnest(ws) AS x FROM docs), words AS (SELECT DISTINCT x FROM (SELECT x FROM u UNION ALL SELECT x FROM goal)),
bytes AS (SELECT x, list_transform(range(octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT)) AS b FROM words),
hashed AS (SELECT x, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM u JOIN hashed USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (x) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM u) AS s_all, (SELECT count(*) FROM goal) AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM u JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TERMS}) AS ws FROM documents), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERMS})) AS x FROM benchmark),
u AS (SELECT r, unnest(ws) AS x FROM d), sizes AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0), totals AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM sizes),
p AS (SELECT r, x, count(*) AS tf FROM u GROUP BY 1, 2), w AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, totals GROUP BY x, n_all),
m AS (SELECT r, doc_id, 50 + (50 * n * n_all) // l_all AS m FROM sizes, totals), scored AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (x) JOIN w USING (x) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
}
