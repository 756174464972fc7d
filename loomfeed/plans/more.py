"""Queries over the remaining operators: sources, exports, logs, the store's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assets, filters, joins, metrics, sentiment, snapshots, tables
from ..sources import pages, reviews
from .adapters import DOCS, PRODUCTS, content_docs, product_rows, query, table

WITH = f"WITH {DOCS}"


def _review_rows(spark, d):
    """Documents as rows of a review file."""
    docs = content_docs(spark, d)
    return docs.select("seq", F.col("source_file"), F.upper("platform").alias("platform"), F.when(F.col("seq") % 12 == 0, "").otherwise(F.col("product_id")).alias("product_id"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("product_title")).alias("product_title"), "shop_name", F.lit("").alias("product_url"), "platform_content_id", F.col("content_text_clean").alias("review_text_raw"), F.when(F.col("seq") % 2 == 0, F.col("content_text_clean")).otherwise("").alias("review_text_clean"), "user_name_masked", F.regexp_replace("content_time", "-", "/").alias("review_time"), F.when(F.col("seq") % 4 == 0, F.col("review_date")).otherwise("").alias("review_date"), "sku")


@query(f"""{WITH} SELECT platform, product_id, 'review' AS content_role, platform_content_id, md5(content_text_clean) AS content_text_raw, md5(content_text_clean) AS content_text_clean, '' AS parent_text_clean, user_name_masked, replace(content_time, '-', '/') AS content_time,
  CASE WHEN seq % 4 = 0 AND review_date <> '' THEN review_date WHEN length(content_time) >= 10 THEN substr(content_time, 1, 10) ELSE '' END AS content_date, sku, seq AS content_order FROM docs WHERE seq % 12 <> 0""")
def q_review_contents(spark, d):
    out = reviews.review_contents(reviews.clean_reviews(_review_rows(spark, d)))
    return out.withColumns({c: F.md5(c) for c in ("content_text_raw", "content_text_clean")})


@query(f"{WITH} SELECT platform, product_id, count(*) AS rows, min(seq) AS first_seq FROM docs WHERE seq % 12 <> 0 GROUP BY 1, 2")
def q_review_inputs(spark, d):
    return reviews.review_inputs(reviews.clean_reviews(_review_rows(spark, d)))


@query(f"""{WITH} SELECT source_file, count(DISTINCT platform || '|' || product_id) AS product_count, min(platform) AS platform, min(product_id) AS product_id, CASE WHEN coalesce(arg_min(product_title, seq) FILTER (WHERE seq % 3 <> 0), '') = 'Item src1' THEN '' ELSE coalesce(arg_min(product_title, seq) FILTER (WHERE seq % 3 <> 0), '') END AS product_title,
  arg_min(shop_name, seq) AS shop_name, '' AS product_url FROM docs WHERE seq % 12 <> 0 GROUP BY 1""")
def q_file_identity(spark, d):
    return reviews.file_identity(reviews.clean_reviews(_review_rows(spark, d)), ("Item src1",))


@query(f"{WITH} SELECT content_id, CAST(match_score AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS absent, seq % 3 = 0 AS flag, CASE WHEN seq % 5 < 4 THEN evidence_level ELSE '' END AS evidence_level FROM docs")
def q_console_frame(spark, d):
    raw = content_docs(spark, d).select("content_id", F.concat(F.col("match_score").cast("string"), F.lit("")).alias("score"), F.when(F.col("seq") % 3 == 0, "Yes").otherwise("n/a").alias("flag"), F.lower("evidence_level").alias("ai_influence_level"))
    return reviews.console_frame(raw, ("score", "absent"), ("flag",), ("content_id",)).select("content_id", "score", "absent", "flag", "evidence_level")


@query(f"""{WITH}, c AS (SELECT seq, evidence_level AS level, '### ' || product_title || chr(10) || '- platform: ' || platform || chr(10) || '- role: ' || content_role || chr(10) || '- text: ' || content_text_clean AS t FROM docs WHERE evidence_level IN ('A', 'B', 'C')) SELECT level, seq, md5(t) AS text FROM c UNION ALL SELECT 'X', NULL, md5('(none)')""")
def q_markdown_cases(spark, d):
    return reviews.markdown_cases(content_docs(spark, d).withColumn("matched_keywords", F.lit("")), ("A", "B", "C", "X")).select("level", "seq", F.md5("text").alias("text"))


@query(f"{WITH} SELECT platform, product_id AS platform_product_id, content_id AS local_review_id, user_name_masked, sku, md5(CASE WHEN parent_text_clean <> '' AND content_text_clean <> '' THEN content_text_clean || chr(10) || parent_text_clean ELSE content_text_clean || parent_text_clean END) AS review_text, CASE WHEN content_time = '' THEN NULL ELSE substr(content_time, 1, 10) END AS review_date FROM docs")
def q_downstream_reviews(spark, d):
    docs = content_docs(spark, d).select("platform", F.col("product_id").alias("platform_product_id"), F.col("content_id").alias("local_review_id"), "user_name_masked", F.col("content_time").alias("review_time"), "sku", F.col("content_text_clean").alias("review_text"), F.col("parent_text_clean").alias("append_text"))
    return reviews.downstream_reviews(docs).withColumn("review_text", F.md5("review_text"))


@query(f"{WITH} SELECT content_id, CASE WHEN seq % 3 = 0 OR sku = 'S0' THEN evidence_level ELSE sku END AS final_value FROM docs")
def q_reviewed(spark, d):
    docs = content_docs(spark, d).select("content_id", F.when(F.col("seq") % 3 == 0, "keep").otherwise("no").alias("decision"), F.col("evidence_level").alias("original_value"), F.when(F.col("sku") == "S0", " ").otherwise(F.col("sku")).alias("override_value"))
    return reviews.reviewed(docs).select("content_id", "final_value")


@query(f"{WITH} SELECT content_id, md5(regexp_replace(content_text_clean, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS t FROM docs")
def q_sanitized(spark, d):
    return reviews.sanitized(content_docs(spark, d).select("content_id", "content_text_clean")).select("content_id", F.md5("content_text_clean").alias("t"))


@query(f"{WITH} SELECT content_id FROM docs WHERE match_score > 2 * (seq % 5)")
def q_capture_risk(spark, d):
    docs = content_docs(spark, d)
    return filters.capture_risk(docs.select("content_id", F.col("match_score").cast("string").alias("declared_count"), (F.col("seq") % 5).alias("saved_count"))).select("content_id")


@query(f"{WITH} SELECT content_id, item_key FROM docs WHERE item_key = 'en:src2' ORDER BY seq LIMIT 1")
def q_detail_of(spark, d):
    return filters.detail_of(content_docs(spark, d), "item_key", "en:src2").select("content_id", "item_key")


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def q_unresolved_queue(spark, d):
    e = table(spark, d, "events")
    return snapshots.unresolved(e.select("event_id", F.when(F.col("event_id") % 4 == 0, "TRUE").otherwise("0").alias("resolved"))).select("event_id")


@query(f"{WITH} SELECT content_id FROM docs WHERE platform = 'en'")
def q_project_scope(spark, d):
    return filters.in_project(content_docs(spark, d).withColumnRenamed("platform", "project_id"), "en").select("content_id")


@query(f"{WITH}, f AS (SELECT content_id, seq % 4 AS score FROM docs WHERE seq % 2 = 0), x AS (SELECT content_id, arg_min(n_chars, seq) AS n_chars FROM docs GROUP BY 1) SELECT f.content_id, f.score, x.n_chars, CASE WHEN CAST(f.content_id AS BIGINT) % 6 = 0 THEN 'detail' END AS note FROM f LEFT JOIN x USING (content_id)")
def q_scores_content_detail(spark, d):
    docs = content_docs(spark, d)
    fast = docs.where("seq % 2 = 0").select("content_id", (F.col("seq") % 4).alias("score"))
    detail = docs.where("seq % 6 = 0").select("content_id", "seq", F.lit("detail").alias("note"))
    return joins.scores_content_detail(fast, docs.select("content_id", "seq", "n_chars"), detail).select("content_id", "score", "n_chars", "note")


@query(f"{WITH} SELECT DISTINCT platform, product_id FROM docs")
def q_distinct_pairs(spark, d):
    return tables.distinct_pairs(content_docs(spark, d), "platform", "product_id")


@query(f"{WITH} SELECT content_id FROM docs WHERE product_id NOT IN (SELECT product_id FROM docs WHERE seq % 40 = 0)")
def q_difference(spark, d):
    docs = content_docs(spark, d)
    return tables.difference(docs.select("content_id", "product_id"), docs.where("seq % 40 = 0"), ["product_id"]).select("content_id")


@query(f"{WITH}, t AS (SELECT local, max(n) AS top FROM (SELECT item_key AS local, seq % 5 AS n FROM docs WHERE seq % 3 = 0) GROUP BY 1), f AS (SELECT content_id, item_key AS local, row_number() OVER (PARTITION BY item_key ORDER BY seq) AS n FROM docs WHERE seq % 3 <> 0) SELECT content_id, coalesce(top, 0) + n AS place FROM f LEFT JOIN t USING (local)")
def q_next_index(spark, d):
    docs = content_docs(spark, d)
    out = tables.next_index(docs.where("seq % 3 = 0").select("item_key", (F.col("seq") % 5).alias("place")), docs.where("seq % 3 <> 0").select("content_id", "item_key", "seq"), ["item_key"], "place", "seq")
    return out.select("content_id", "place")


@query(f"{WITH}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE sentiment_label = 'P') AS positive FROM docs) SELECT 'total' AS metric, CAST(7 AS DOUBLE) AS value UNION ALL SELECT 'positive', CAST(positive AS DOUBLE) FROM s")
def q_summarize_sentiment(spark, d):
    docs = content_docs(spark, d)
    named = docs.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit("7").alias("value")), F.struct(F.lit("positive").alias("metric"), F.lit("n/a").alias("value")))).alias("x")).select("x.*").distinct()
    return metrics.summarize_sentiment(named, docs.agg(F.count("*").alias("total"), F.count_if(F.col("sentiment_label") == "P").alias("positive")))


_SOLID = r"regexp_replace(%s, '\s+', '', 'g')"


@query(f"""{WITH}, q AS (SELECT content_id, content_text_clean AS t, {_SOLID % "substr(content_text_clean, 3, 9)"} AS q, {_SOLID % "content_text_clean"} AS s FROM docs),
    p AS (SELECT *, instr(s, q) AS place, list_filter(list_transform(string_split(t, ''), lambda c, i: CASE WHEN regexp_matches(c, '\\S') THEN i END), lambda i: i IS NOT NULL) AS solid FROM q)
    SELECT content_id, CASE WHEN q <> '' AND place > 0 THEN substr(t, solid[place], solid[place + length(q) - 1] - solid[place] + 1) END AS quote FROM p""")
def q_find_quote(spark, d):
    """Nine characters from the third on, with a space among them, sought in their whole text."""
    docs = content_docs(spark, d).select("content_id", F.col("content_text_clean").alias("t"), F.substring("content_text_clean", 3, 9).alias("q"))
    return docs.select("content_id", X.find_quote(F.col("t"), F.concat_ws(" ", F.substring("q", 1, 4), F.substring("q", 5, 5))).alias("quote"))


@query(f"{WITH} SELECT CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS rows FROM docs")
def q_prompts(spark, d):
    """Every row is in one prompt line: texts' characters and rows, read back from the prompts."""
    docs = content_docs(spark, d).select("content_id", "seq", "content_text_clean", "product_title")
    lines = sentiment.prompts(sentiment.batched(docs, 50)).select(F.explode(F.split("prompt", "\n")).alias("l"))
    return lines.agg(F.sum(F.length(F.get_json_object("l", "$.t"))).alias("chars"), F.count_distinct(F.get_json_object("l", "$.i")).alias("rows"))


@query(f"""WITH {PRODUCTS}, n AS (SELECT * FROM p WHERE platform IN ('taobao', 'tmall', 'jd') AND source_mtime % 2 = 0), s AS (SELECT platform || ':' || platform_product_id AS item_key, max(product_title_current) AS t FROM n GROUP BY 1) SELECT item_key, t AS product_title_current, '2024-05-01' AS last_updated_at FROM s UNION ALL SELECT item_key, product_title_current, '' FROM p""")
def q_upsert_products(spark, d):
    products = product_rows(spark, d)
    seen = products.where("source_mtime % 2 = 0").select("project_id", "platform", "platform_product_id", F.col("product_title_current").alias("product_title"), F.col("shop_name_current").alias("shop_name"), F.lit("2024-05-01").alias("capture_time"))
    return snapshots.upsert_products(products, seen).select("item_key", "product_title_current", "last_updated_at")


@query(f"{WITH}, a AS (SELECT content_id, match_score FROM docs WHERE seq % 4 <> 0) SELECT d.content_id, a.match_score AS score, d.product_title FROM docs d LEFT JOIN a USING (content_id)")
def q_content_all(spark, d):
    docs = content_docs(spark, d)
    products = docs.select("item_key", F.col("product_title").alias("product_title_current"), F.lit("s").alias("shop_name_current")).distinct()
    return snapshots.content_all(docs.select("content_id", "item_key"), docs.where("seq % 4 <> 0").select("content_id", F.col("match_score").alias("score")), products).select("content_id", "score", "product_title")


@query(f"{WITH} SELECT content_id AS local_review_id, CASE WHEN seq % 2 = 0 THEN 'old' ELSE parent_text_clean END AS append_text, CAST(CASE WHEN seq % 2 <> 0 AND parent_text_clean <> '' THEN 1 ELSE 0 END AS INTEGER) AS update_count FROM docs")
def q_upsert_reviews(spark, d):
    docs = content_docs(spark, d)
    row = lambda x: docs.select(F.col("content_id").alias("local_review_id"), F.col("content_text_clean").alias("review_text"), x.alias("append_text"), F.lit("").alias("append_time"), "user_name_masked", "sku", F.lit(0).alias("update_count"))
    out = assets.upsert_reviews(row(F.when(F.col("seq") % 2 == 0, "old").otherwise("")), row(F.col("parent_text_clean")))
    return out.select("local_review_id", X.text_or_empty(F.col("append_text")).alias("append_text"), "update_count")


@query(f"{WITH} SELECT content_id AS entity_id, CASE WHEN seq % 5 = 0 THEN 'create' ELSE 'update' END AS operation FROM docs WHERE seq % 5 = 0 OR seq % 3 = 0")
def q_change_rows(spark, d):
    docs = content_docs(spark, d)
    before = docs.where("seq % 5 <> 0").select("content_id", "sku")
    after = docs.select("content_id", F.when(F.col("seq") % 3 == 0, "changed").otherwise(F.col("sku")).alias("sku"))
    return assets.change_rows(before, after, "content_id", "review", "b").select("entity_id", "operation")


@query(f"{WITH}, b AS (SELECT seq, 'rv_' || product_id || '_' || substr(md5(platform), 1, 12) AS base FROM docs), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM b) SELECT seq, CASE WHEN n = 1 THEN base ELSE base || '_' || CAST(n AS VARCHAR) END AS local_review_id FROM n")
def q_local_ids(spark, d):
    docs = content_docs(spark, d).select("seq", F.col("product_id").alias("platform_product_id"), F.md5("platform").alias("review_fingerprint"))
    return assets.local_ids(docs).select("seq", "local_review_id")


@query(f"{WITH} SELECT content_id, CASE WHEN seq % 7 = 0 THEN 'failed' WHEN seq % 12 = 0 OR match_score = 0 THEN 'needs_fix' ELSE 'ready' END AS status FROM docs")
def q_preview_status(spark, d):
    docs = content_docs(spark, d).select("content_id", F.when(F.col("seq") % 7 == 0, "bad").otherwise("").alias("error"), F.when(F.col("seq") % 12 == 0, "").otherwise(F.col("product_id")).alias("platform_product_id"), F.col("match_score").alias("review_count"))
    return assets.preview_status(docs).select("content_id", "status")


@query(f"{WITH} SELECT source_file || CAST(seq AS VARCHAR) AS path, CASE WHEN seq % 3 = 0 THEN 'missing file' ELSE 'unlisted file' END AS problem FROM docs WHERE (seq % 3 = 0) <> (seq % 2 = 0)")
def q_manifest_problems(spark, d):
    docs = content_docs(spark, d).select("seq", F.concat("source_file", F.col("seq").cast("string")).alias("path"))
    return assets.manifest_problems(docs.where("seq % 3 = 0"), docs.where("seq % 2 = 0"))


@query(f"{WITH} SELECT content_id, md5(trim(regexp_replace(content_text_clean, '\\s+', ' ', 'g'))) AS t, CASE WHEN seq % 6 BETWEEN 1 AND 5 THEN seq % 6 END AS rating_value FROM docs")
def q_collector_rows(spark, d):
    docs = content_docs(spark, d).select("content_id", F.col("content_text_clean").alias("text"), F.col("user_name_masked").alias("user"), F.col("content_time").alias("time"), (F.col("seq") % 6).cast("string").alias("rating"), "sku", F.col("product_title").alias("product_name"))
    return pages.collector_rows(docs).select("content_id", F.md5("review_text").alias("t"), F.col("rating_value").cast("long").alias("rating_value"))


@query(f"{WITH}, m AS (SELECT content_id, 's2' AS first FROM docs WHERE seq % 4 <> 0) SELECT d.content_id, CASE WHEN d.seq % 2 = 0 THEN m.first ELSE 's1' END AS snapshot_id FROM docs d JOIN m USING (content_id)")
def q_repoint_scores(spark, d):
    docs = content_docs(spark, d)
    scores = docs.select("content_id", F.when(F.col("seq") % 2 == 0, "gone").otherwise("s1").alias("snapshot_id"))
    master = docs.where("seq % 4 <> 0").select("content_id", F.lit("s2").alias("first_seen_snapshot_id"))
    return snapshots.repoint_scores(scores, master, scores.where("snapshot_id = 'gone'").select("snapshot_id").distinct())


@query(f"{WITH}, c AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, seq) AS n FROM docs WHERE evidence_level = 'A') SELECT content_id FROM c WHERE n <= 25")
def q_detail_budget(spark, d):
    return sentiment.within_budget(content_docs(spark, d).withColumn("short", -F.col("n_chars")), F.col("evidence_level") == "A", 25, ["short", "seq"]).select("content_id")
