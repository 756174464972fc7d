"""Queries over model results, pages and the asset store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets, audit, sentiment
from ..sources import pages as pages_source
from ..sources import reviews as reviews_source
from .adapters import DOCS, content_docs, query, table

WITH = f"WITH {DOCS}"
# Model answers made from the documents: every seventh is broken in one of several ways.
_SCORE = "seq % 10 + 1"
ANSWERS = f"""a AS (SELECT content_id AS i, seq, CASE WHEN seq % 7 = 1 THEN 'X' WHEN sentiment_label <> '' THEN sentiment_label ELSE 'Z' END AS s, CASE WHEN seq % 7 = 2 THEN 11 ELSE {_SCORE} END AS sc, CASE WHEN seq % 7 = 3 THEN '?' WHEN seq % 2 = 0 THEN 'F' ELSE 'P$' END AS p, '-' AS n, CASE WHEN seq % 7 = 4 THEN 0 ELSE seq % 3 + 1 END AS c FROM docs),
ok AS (SELECT * FROM a WHERE s IN ('P', 'N', 'M', 'Z') AND p <> '?' AND sc BETWEEN 1 AND 10 AND c BETWEEN 1 AND 3 AND seq % 7 <> 5)"""


def _lines(spark, d):
    docs = content_docs(spark, d)
    m = F.col("seq") % 7
    row = F.struct(F.col("content_id").alias("i"), F.when(m == 1, "X").when(F.col("sentiment_label") != "", F.col("sentiment_label")).otherwise("Z").alias("s"), F.when(m == 2, 11).otherwise(F.col("seq") % 10 + 1).alias("sc"), F.when(m == 3, "?").when(F.col("seq") % 2 == 0, "F").otherwise("P$").alias("p"), F.lit("-").alias("n"), F.when(m == 4, 0).otherwise(F.col("seq") % 3 + 1).alias("c"))
    line = F.when(m == 5, F.regexp_replace(F.to_json(row), '"c":[0-9]+', '"c":true')).otherwise(F.to_json(row))
    return docs.select(F.floor(F.col("seq") / 50).alias("batch_id"), F.concat(F.lit("some words\n"), line, F.lit("\n")).alias("response"))


@query(f"{WITH}, {ANSWERS} SELECT i, s, sc, p, n, c FROM ok")
def q_fast_validation(spark, d):
    return sentiment.valid_fast(sentiment.parsed_lines(_lines(spark, d))).select("i", "s", F.col("sc").cast("long").alias("sc"), "p", "n", F.col("c").cast("long").alias("c"))


@query(f"{WITH}, {ANSWERS} SELECT content_id FROM docs WHERE content_id NOT IN (SELECT i FROM ok)")
def q_missing_ids_retry(spark, d):
    return sentiment.missing(content_docs(spark, d).select("content_id"), sentiment.valid_fast(sentiment.parsed_lines(_lines(spark, d))))


@query(f"{WITH} SELECT content_id, CASE sentiment_label WHEN 'P' THEN '正向' WHEN 'N' THEN '负向' WHEN 'M' THEN '混合' WHEN 'Z' THEN '中性' END AS sentiment_label_cn, CASE seq % 3 WHEN 0 THEN '功能效果' WHEN 1 THEN '性价比接受' END AS praise_name, CASE seq % 2 WHEN 0 THEN '无' ELSE '品控故障' END AS complaint_name FROM docs")
def q_enrich_codes(spark, d):
    docs = content_docs(spark, d).select("content_id", "sentiment_label", F.when(F.col("seq") % 3 == 0, "F").when(F.col("seq") % 3 == 1, "P$").otherwise("?").alias("praise_code"), F.when(F.col("seq") % 2 == 0, "-").otherwise("Q").alias("complaint_code"))
    return sentiment.with_names(docs).select("content_id", "sentiment_label_cn", "praise_name", "complaint_name")


def _results(spark, d):
    """Nested results: praise where quality is 1, complaints where toxic is 1, quotes from the text, some of them wrong."""
    docs = content_docs(spark, d).where("quality is not null")
    quote = F.when(F.col("seq") % 6 == 0, "no such words 0").otherwise(F.substring("content_text_clean", 1, 10))
    target = F.when(F.col("seq") % 4 == 0, "service").when(F.col("seq") % 4 == 1, "product").when(F.col("seq") % 4 == 2, "brand").otherwise("unclear")
    strength = F.get(F.array(*map(F.lit, audit.STRENGTHS)), (F.col("seq") % 5).cast("int"))
    common = lambda kind: (target.alias("target"), F.lit("a").alias("aspect"), F.lit("function" if kind == "praise" else "value").alias(f"{kind}_family"))
    tail = (F.lit("s").alias("scene"), quote.alias("evidence_quote"), strength.alias("evidence_strength"))
    praise = F.struct(*common("praise"), F.lit("scene_success").alias("praise_method"), *tail, F.lit("high").alias("business_value"), F.lit("").alias("notes"))
    complaint = F.struct(*common("complaint"), F.lit("hard_defect").alias("complaint_method"), *tail, F.lit("low").alias("severity"), F.when(F.col("seq") % 8 == 1, "never").otherwise("product_issue").alias("fixability"), F.lit("").alias("notes"))
    none = lambda x: F.filter(F.array(x), lambda _: F.lit(False))
    result = F.struct(
        F.col("content_id").alias("review_id"), F.lit(True).alias("valid_review"), F.lit("neutral").alias("overall_sentiment"), F.lit("unclear").alias("main_target"), F.struct(F.lit(False).alias("is_purchase_decision_evidence"), F.lit("D").alias("evidence_level"), F.lit("").alias("reason")).alias("purchase_decision_evidence"),
        F.when(F.col("quality") == 1, F.array(praise)).otherwise(none(praise)).alias("praise_items"), F.when(F.col("toxic") == 1, F.array(complaint, complaint)).otherwise(none(complaint)).alias("complaint_items"),
        F.struct(*((F.col("seq") % 9 == i).alias(f) for i, f in enumerate(audit.FLAGS))).alias("noise_flags"), F.lit("x").alias("one_sentence_summary"),
    )
    return audit.parse_results(docs.select("seq", "content_id", F.col("content_text_clean").alias("text"), F.to_json(result).alias("response")))


RESULTS = """r AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'product' WHEN 2 THEN 'brand' ELSE 'unclear' END AS target, CASE seq % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'D' END AS strength,
  CASE WHEN seq % 6 = 0 THEN 'no such words 0' ELSE substr(content_text_clean, 1, 10) END AS quote FROM docs WHERE quality IS NOT NULL)"""


@query(f"""{WITH}, {RESULTS} SELECT content_id, CASE WHEN quality = 1 AND trim(quote) = '' THEN 'praise_items.evidence_quote is empty' WHEN quality = 1 AND NOT contains(content_text_clean, trim(quote)) THEN 'praise_items.evidence_quote is not in the text' WHEN toxic = 1 AND seq % 8 = 1 THEN 'complaint_items.fixability'
  WHEN toxic = 1 AND trim(quote) = '' THEN 'complaint_items.evidence_quote is empty' WHEN toxic = 1 AND NOT contains(content_text_clean, trim(quote)) THEN 'complaint_items.evidence_quote is not in the text' ELSE '' END AS error FROM r""")
def q_structured_validation(spark, d):
    return _results(spark, d).select("content_id", audit.first_error().alias("error"))


@query(f"""{WITH}, {RESULTS} SELECT content_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'mixed' WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' WHEN seq % 9 < 6 THEN 'noise' ELSE 'neutral' END AS derived_sentiment,
  CASE WHEN (quality = 0 AND toxic = 0) OR target = 'unclear' THEN CASE seq % 9 WHEN 0 THEN 'service' WHEN 1 THEN 'logistics' ELSE 'unclear' END ELSE target END AS derived_target FROM r""")
def q_derive_sentiment(spark, d):
    return audit.derive(_results(spark, d)).select("content_id", "derived_sentiment", "derived_target")


@query(f"""{WITH}, {RESULTS}, l AS (SELECT content_id, CASE WHEN target NOT IN ('product', 'brand') OR (quality = 0 AND toxic = 0) THEN 'D' WHEN toxic = 0 AND strength IN ('S', 'A', 'B') THEN 'C' ELSE strength END AS derived_level FROM r) SELECT *, derived_level IN ('S', 'A', 'B') AS is_purchase_evidence FROM l""")
def q_purchase_evidence(spark, d):
    return audit.derive(_results(spark, d)).select("content_id", "derived_level", "is_purchase_evidence")


@query(f"{WITH}, {RESULTS} SELECT content_id, n AS item_index, target, strength AS evidence_strength FROM r, (VALUES (1), (2)) t(n) WHERE toxic = 1")
def q_item_explode(spark, d):
    return audit.exploded(_results(spark, d), ["content_id"], "complaint").select("content_id", "item_index", "target", "evidence_strength")


@query(f"{WITH} SELECT sha256(product_title || '|' || content_text_clean) AS input_hash, min(seq) AS seq FROM docs GROUP BY 1")
def q_distinct_inputs(spark, d):
    return audit.distinct_inputs(content_docs(spark, d), ["product_title", "content_text_clean"])[0].select("input_hash", "seq")


# Pages


@query("""WITH x AS (SELECT page_id, lower(html) || lower(url) AS t FROM pages), s AS (SELECT page_id, contains(t, 'tmall.com')::INT + contains(t, '天猫')::INT + contains(t, '天猫超市')::INT + contains(t, '天猫国际')::INT AS a, contains(t, 'taobao.com')::INT + contains(t, '淘宝')::INT + contains(t, '已买到的宝贝')::INT + contains(t, '收藏夹')::INT AS b, contains(t, 'jd.com')::INT + contains(t, '京东')::INT + contains(t, '京东商城')::INT AS c FROM x)
SELECT page_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a = greatest(a, b, c) THEN 'tmall' WHEN b = greatest(a, b, c) THEN 'taobao' ELSE 'jd' END AS platform FROM s""")
def q_platform_detect(spark, d):
    return table(spark, d, "pages").select("page_id", pages_source.platform_of(F.col("html"), F.col("url")).alias("platform"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url || '&id=' || CAST(page_id % 7 AS VARCHAR), '[?&]id=([0-9A-Za-z_-]+)', 1), ''), '') AS product_id FROM pages")
def q_product_id(spark, d):
    return table(spark, d, "pages").select("page_id", pages_source.product_id(F.concat("url", F.lit("&id="), (F.col("page_id") % 7).cast("string"))).alias("product_id"))


_LI = r"<li><a href=\"([^\"]*)\">([^<]*)</a></li>"
LIS = """p AS (SELECT page_id, html, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS lis FROM pages), x AS (SELECT page_id, unnest(lis) AS li, unnest(range(len(lis))) AS i FROM p),
c AS (SELECT CAST(page_id AS VARCHAR) AS page, i, trim(regexp_extract(li, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS t, trim(regexp_extract(li, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS h FROM x)"""


# Character references as these pages write them: a named one may lack its semicolon, as at the end of a text that was cut.
_REFERENCES = (("&(?:lt|LT);?", "<"), ("&(?:gt|GT);?", ">"), ("&(?:quot|QUOT);?", '"'), ("&#(?:39|[xX]27);", "''"), ("&(?:amp|AMP);?", "&"))


def _named(tag: str) -> str:
    """The text of a page's first element of a kind, in SQL."""
    text = f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)"
    for reference, character in _REFERENCES:
        text = f"regexp_replace({text}, '{reference}', '{character}', 'g')"
    return f"trim({text}, ' |')"


def _pages(spark, d):
    return table(spark, d, "pages").withColumn("path", F.concat(F.lit("saved/page "), F.col("page_id").cast("string"), F.lit(".html")))


@query(f"SELECT CAST(page_id AS VARCHAR) AS page, sha256(html) AS file_hash, {_named('title')} AS product_title, '' AS shop_name, '' AS product_id, 'unknown' AS platform FROM pages")
def q_page_identity(spark, d):
    return pages_source.page_identity(_pages(spark, d)).select("page", "file_hash", "product_title", "shop_name", "product_id", "platform")


@query(f"SELECT CAST(page_id AS VARCHAR) AS page, CASE WHEN page_id % 3 = 0 THEN 'page ' || CAST(page_id AS VARCHAR) ELSE {_named('title')} END AS product_title, {_named('h1')} AS shop_name FROM pages")
def q_page_title(spark, d):
    """A third of the pages have a title that says nothing: then the file's name counts; headings are marked as shops."""
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?s)<title>.*?</title>", "<title>问大家</title>")).otherwise(F.col("html"))
    return pages_source.page_products(_pages(spark, d).withColumn("html", F.regexp_replace(html, "<h1>", '<h1 class="shop-name">')))


@query(f"""WITH {LIS} SELECT page, any_value(t) AS text, CAST(0.6 AS DOUBLE) AS confidence, 0 AS image_count, CAST(NULL AS BIGINT) AS like_count FROM c WHERE length(t) BETWEEN 4 AND 5000 AND NOT regexp_matches(t, '^[0-9]+$') GROUP BY page, md5(t)""")
def q_page_rows(spark, d):
    """Entries of each page's menu as its cards: their text is the one line of their block."""
    nodes = pages_source.card_nodes(table(spark, d, "pages").withColumn("html", F.regexp_replace("html", "<li>", '<li class="review-item">')))
    return pages_source.reviews_of_pages(nodes).select("page", "text", "confidence", "image_count", F.col("like_count").cast("long").alias("like_count"))


@query(f"""WITH {LIS}, q AS (SELECT page, i, trim(regexp_replace(t, '^\\s*(?:问题|问|Q)\\s*[:：]?\\s*', '')) AS question, h AS answer FROM c) SELECT page, question, answer, CAST(0.9 AS DOUBLE) AS confidence, false AS is_buyer_answer FROM q WHERE question <> '' GROUP BY page, question, answer""")
def q_page_qa(spark, d):
    """Entries of each page's menu as its questions, their links as the answers."""
    asked, meta = question_pages(table(spark, d, "pages"))
    return pages_source.questions_of_pages(pages_source.card_nodes(asked, kind="question"), meta).select("page", "question", "answer", "confidence", "is_buyer_answer")


def question_pages(rows):
    """Pages whose menus are questions and answers, and what is known of them."""
    asked = rows.withColumn("html", F.regexp_replace("html", _LI, '<li class="qa-item"><b class="question-text">$2</b><i class="answer-text">$1</i></li>'))
    return asked, rows.select(F.col("page_id").cast("string").alias("page"), F.lit("tmall").alias("platform"), F.lit("").alias("product_id"), F.lit(False).alias("marked"))


@query("""WITH f AS (SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN '.exe' ELSE '.HTML' END AS path, length(text) AS n FROM documents) SELECT path, 'suffix' AS reason FROM f WHERE doc_id % 5 = 0 UNION ALL SELECT path, 'file too large' FROM f WHERE n > 5000 UNION ALL SELECT '*', 'too many files' WHERE (SELECT count(*) FROM f) > 10 UNION ALL SELECT '*', 'batch too large' WHERE (SELECT sum(n) FROM f) > 100000""")
def q_input_problems(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".exe").otherwise(".HTML")).alias("path"), F.length("text").cast("long").alias("length"))
    return reviews_source.input_problems(files, most_bytes=5000, most_total=100_000)


# Assets


def _images(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("local_review_id"), F.when(F.col("l_returnflag") == "A", "append").otherwise("review").alias("image_stage"), F.md5(F.concat_ws("|", "l_partkey", "l_shipdate")).alias("content_sha256"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_linenumber")


IMAGES = """i AS (SELECT CAST(l_orderkey AS VARCHAR) AS local_review_id, CASE WHEN l_returnflag = 'A' THEN 'append' ELSE 'review' END AS image_stage, md5(CAST(l_partkey AS VARCHAR) || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS content_sha256, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, l_linenumber FROM lineitem),
old AS (SELECT local_review_id, image_stage, content_sha256, row_number() OVER (PARTITION BY local_review_id, image_stage ORDER BY seq, content_sha256) AS image_index FROM (SELECT local_review_id, image_stage, content_sha256, min(seq) AS seq FROM i WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, 3)),
fresh AS (SELECT local_review_id, image_stage, content_sha256, min(seq) AS seq FROM i WHERE l_linenumber % 3 = 0 GROUP BY 1, 2, 3)"""


def _upsert(spark, d):
    images = _images(spark, d)
    empty = images.limit(0).select(F.lit("").alias("image_id"), "local_review_id", "image_stage", F.lit(0).alias("image_index"), "content_sha256")
    store = assets.upsert_images(empty, images.where("l_linenumber % 2 = 0"), "b0")[0]
    return assets.upsert_images(store, images.where("l_linenumber % 3 = 0"), "b1")


@query(f"""WITH {IMAGES}, top AS (SELECT local_review_id, image_stage, max(image_index) AS t FROM old GROUP BY 1, 2), add AS (SELECT f.*, row_number() OVER (PARTITION BY f.local_review_id, f.image_stage ORDER BY f.seq, f.content_sha256) AS n FROM fresh f LEFT JOIN old o ON o.local_review_id = f.local_review_id AND o.image_stage = f.image_stage AND o.content_sha256 = f.content_sha256 WHERE o.content_sha256 IS NULL)
SELECT local_review_id, image_stage, content_sha256, image_index FROM old UNION ALL SELECT a.local_review_id, a.image_stage, a.content_sha256, coalesce(t, 0) + n FROM add a LEFT JOIN top USING (local_review_id, image_stage)""")
def q_image_upsert(spark, d):
    return _upsert(spark, d)[0].select("local_review_id", "image_stage", "content_sha256", F.col("image_index").cast("long").alias("image_index"))


@query(f"""WITH {IMAGES}, w AS (SELECT f.local_review_id, f.image_stage, o.content_sha256 IS NULL AS fresh FROM fresh f LEFT JOIN old o ON o.local_review_id = f.local_review_id AND o.image_stage = f.image_stage AND o.content_sha256 = f.content_sha256)
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS product_key, local_review_id, count(*) AS exported_count, count(*) FILTER (WHERE fresh) AS new_count, count(*) FILTER (WHERE image_stage = 'review') AS review_exported, count(*) FILTER (WHERE image_stage = 'review' AND fresh) AS review_new, count(*) FILTER (WHERE image_stage = 'append') AS append_exported, count(*) FILTER (WHERE image_stage = 'append' AND fresh) AS append_new
FROM w JOIN orders ON CAST(o_orderkey AS VARCHAR) = local_review_id GROUP BY 1, 2""")
def q_export_counts(spark, d):
    after, watched = _upsert(spark, d)
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("local_review_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("product_key"))
    return assets.export_manifest(watched, after, reviews)


@query("""WITH c AS (SELECT l_orderkey, count(*) AS image_count, count(*) FILTER (WHERE l_returnflag <> 'A') AS review_image_count, count(*) FILTER (WHERE l_returnflag = 'A') AS append_image_count, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS missing_image_count FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS local_review_id, coalesce(image_count, 0) AS image_count, coalesce(review_image_count, 0) AS review_image_count, coalesce(append_image_count, 0) AS append_image_count, coalesce(missing_image_count, 0) AS missing_image_count FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def q_product_export(spark, d):
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("local_review_id"))
    images = _images(spark, d).withColumn("extract_status", F.when(F.col("l_linenumber") % 4 == 0, "missing").otherwise("embedded"))
    return assets.product_export(reviews, images).select("local_review_id", "image_count", "review_image_count", "append_image_count", "missing_image_count")


def _changes(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("change_id"), F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("batch_id"), F.lit("review").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.when(F.col("event_id") % 11 == 0, "create").otherwise("update").alias("operation"), F.concat(F.lit("before "), F.col("event_id").cast("string")).alias("previous_state"), F.concat(F.lit("after "), F.col("event_id").cast("string")).alias("new_state"))


@query("SELECT 'review' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, 'after ' || CAST(max(event_id) AS VARCHAR) AS state, bool_or(event_id % 11 = 0) AS created_in_batch FROM events WHERE event_id % 4 = 2 GROUP BY user_id")
def q_batch_snapshot(spark, d):
    return assets.batch_snapshot(_changes(spark, d), "b2")


@query("""WITH o AS (SELECT user_id, min(event_id) AS f, bool_or(event_id % 11 = 0) AS created FROM events WHERE event_id % 4 = 2 GROUP BY 1), e AS (SELECT DISTINCT user_id FROM events) SELECT CAST(e.user_id AS VARCHAR) AS entity_id, CASE WHEN o.f IS NULL THEN 'now' ELSE 'before ' || CAST(o.f AS VARCHAR) END AS state FROM e LEFT JOIN o USING (user_id) WHERE NOT coalesce(created, false)""")
def q_undo_batch(spark, d):
    entities = table(spark, d, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.lit("now").alias("state")).distinct()
    return assets.undo(entities, _changes(spark, d), "b2", "review")


@query("""WITH s AS (SELECT CAST(l_partkey AS VARCHAR) AS k, count(*) AS n, min(l_orderkey) AS id FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT o_orderkey AS seq, CASE WHEN s.n = 1 THEN 'native_id' WHEN s.n > 1 THEN 'collision' ELSE 'new' END AS match, CASE WHEN s.n = 1 THEN CAST(s.id AS VARCHAR) END AS matched_id FROM orders LEFT JOIN s ON s.k = CAST(o_custkey * 3 AS VARCHAR)""")
def q_review_match(spark, d):
    store = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.lit("p").alias("product_key"), F.col("l_partkey").cast("string").alias("platform_review_id"), F.lit("").alias("review_fingerprint"), F.col("l_orderkey").cast("string").alias("local_review_id"))
    incoming = table(spark, d, "orders").select(F.lit("p").alias("product_key"), (F.col("o_custkey") * 3).cast("string").alias("platform_review_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("review_fingerprint"), F.col("o_orderkey").alias("seq"))
    return assets.match_reviews(store, incoming).select("seq", "match", "matched_id")
