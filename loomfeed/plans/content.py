"""Queries over contents: metrics, filters, joins, texts and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon, SentimentWords
from ..operators import classify as C
from ..operators import filters, identity, joins, metrics, tables
from .adapters import DOCS, TERMS, content_docs, query, table

WITH = f"WITH {DOCS}"
WITH_TERMS = f"{WITH}, {TERMS}"
_LEVELS = ", ".join(f"count(*) FILTER (WHERE evidence_level = '{x}') AS {x.lower()}_level_count" for x in "ABCD")
_REVIEW = "content_role IN ('review', 'followup')"


@query(f"""{WITH}, a AS (SELECT count(*) AS total_content_count, count(*) FILTER (WHERE {_REVIEW}) AS review_count, count(*) FILTER (WHERE content_role = 'question') AS question_count, count(*) FILTER (WHERE content_role = 'answer') AS answer_count,
  CAST(0 AS BIGINT) AS taobao_tmall_review_count, CAST(0 AS BIGINT) AS taobao_tmall_question_count, CAST(0 AS BIGINT) AS taobao_tmall_answer_count,
  {", ".join(f"count(*) FILTER (WHERE {_REVIEW} AND sentiment_label = '{x}') AS sentiment_{x.lower()}" for x in "PNMZ")}, {", ".join(f"count(*) FILTER (WHERE {_REVIEW} AND evidence_level = '{x}') AS evidence_{x.lower()}" for x in "ABCD")},
  count(*) FILTER (WHERE {_REVIEW} AND ai_candidate) AS ai_candidate_count, count(*) FILTER (WHERE {_REVIEW} AND pre_purchase_decision) AS pre_purchase_count FROM docs)
SELECT *, sentiment_p + sentiment_n + sentiment_m + sentiment_z AS sentiment_judged_count, review_count - (sentiment_p + sentiment_n + sentiment_m + sentiment_z) AS sentiment_unjudged_count, (sentiment_p + sentiment_n + sentiment_m + sentiment_z) / CAST(review_count AS DOUBLE) AS sentiment_coverage,
  evidence_a + evidence_b + evidence_c + evidence_d AS evidence_graded_count, review_count - (evidence_a + evidence_b + evidence_c + evidence_d) AS evidence_ungraded_count FROM a""")
def q_brand_overview(spark, d):
    return metrics.brand_overview(content_docs(spark, d))


@query(f"{WITH} SELECT platform, count(*) AS content_count FROM docs GROUP BY 1")
def q_platform_counts(spark, d):
    return metrics.platform_counts(content_docs(spark, d))


@query(f"""{WITH} SELECT item_key, product_title, count(*) FILTER (WHERE {_REVIEW}) AS review_count, count(*) FILTER (WHERE content_role = 'question') AS question_count,
  {", ".join(f"count(*) FILTER (WHERE {_REVIEW} AND sentiment_label = '{x}') AS {n}_count" for x, n in zip("PNMZ", ("positive", "negative", "mixed", "neutral"), strict=True))}, count(*) FILTER (WHERE {_REVIEW} AND ai_candidate) AS ai_candidate_count,
  {", ".join(f"count(*) FILTER (WHERE {_REVIEW} AND evidence_level = '{x}') AS {x.lower()}_level_count" for x in "ABCD")},
  coalesce(count(*) FILTER (WHERE {_REVIEW} AND sentiment_label <> '') / CAST(nullif(count(*) FILTER (WHERE {_REVIEW}), 0) AS DOUBLE), 0) AS sentiment_coverage,
  coalesce(count(*) FILTER (WHERE {_REVIEW} AND ai_candidate) / CAST(nullif(count(*) FILTER (WHERE {_REVIEW}), 0) AS DOUBLE), 0) AS ai_candidate_rate FROM docs GROUP BY 1, 2""")
def q_product_comparison(spark, d):
    return metrics.product_comparison(content_docs(spark, d))


_TOP = """top_{n} AS (SELECT {keys}, string_agg(term || ':' || CAST(c AS VARCHAR), ';' ORDER BY r) AS top_{n} FROM (
  SELECT {keys}, term, c, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, f, pos) AS r FROM (SELECT {keys}, term, any_value(pos) AS pos, count(*) AS c, min(seq) AS f FROM {rows} WHERE ai_candidate AND kind = '{kind}' GROUP BY {keys}, term)) WHERE r <= 5 GROUP BY {keys})"""
_PRODUCT = "platform, product_title, shop_name, product_id"


@query(f"""{WITH_TERMS}, hashed AS (SELECT *, md5(platform || chr(31) || product_id || chr(31) || content_role || chr(31) || content_text_clean || chr(31) || parent_text_clean) AS content_hash FROM docs),
base AS (SELECT {_PRODUCT}, count(DISTINCT source_file) AS source_file_count, count(*) FILTER (WHERE content_role = 'review') AS review_count, count(*) FILTER (WHERE content_role = 'question') AS qa_question_count, count(*) FILTER (WHERE content_role = 'answer') AS qa_answer_count,
  count(DISTINCT content_hash) AS content_count, count(*) FILTER (WHERE ai_candidate) AS ai_candidate_count, {_LEVELS}, count(*) FILTER (WHERE pre_purchase_decision) AS pre_purchase_decision_count FROM hashed GROUP BY {_PRODUCT}),
{_TOP.format(n="ai_source_terms", keys=_PRODUCT, rows="terms", kind="ai_source")}, {_TOP.format(n="ai_action_terms", keys=_PRODUCT, rows="terms", kind="ai_action")},
ex AS (SELECT {_PRODUCT}, string_agg(t, ' || ' ORDER BY r) AS top_examples FROM (SELECT {_PRODUCT}, substr(content_text_clean, 1, 100) AS t, row_number() OVER (PARTITION BY {_PRODUCT} ORDER BY match_score DESC, seq) AS r FROM docs WHERE ai_candidate) WHERE r <= 3 GROUP BY {_PRODUCT})
SELECT base.*, a_level_count + b_level_count AS a_b_count, a_level_count + b_level_count + c_level_count AS a_b_c_count, {", ".join(f"coalesce({c} / CAST(nullif(pre_purchase_decision_count, 0) AS DOUBLE), 0) AS {n}" for c, n in (("a_level_count", "explicit_ai_rate"), ("b_level_count", "generic_ai_rate"), ("c_level_count", "inferred_ai_rate"), ("ai_candidate_count", "ai_candidate_rate")))},
  coalesce(top_ai_source_terms, '') AS top_ai_source_terms, coalesce(top_ai_action_terms, '') AS top_ai_action_terms, coalesce(top_examples, '') AS top_examples
FROM base LEFT JOIN top_ai_source_terms USING ({_PRODUCT}) LEFT JOIN top_ai_action_terms USING ({_PRODUCT}) LEFT JOIN ex USING ({_PRODUCT})""")
def q_summary_by_product_batch(spark, d):
    return metrics.summary_by_product(content_docs(spark, d).withColumn("content_hash", identity.content_hash()))


@query(f"""{WITH}, b AS (SELECT {_PRODUCT}, count(*) FILTER (WHERE content_role = 'review') AS review_count, count(*) FILTER (WHERE content_role = 'question') AS qa_question_count, count(*) FILTER (WHERE content_role = 'answer') AS qa_answer_count, count(*) AS content_count,
  count(*) FILTER (WHERE ai_candidate) AS ai_candidate_count, count(*) FILTER (WHERE pre_purchase_decision) AS pre_purchase_decision_count, {_LEVELS} FROM docs GROUP BY {_PRODUCT}) SELECT *, ai_candidate_count / CAST(content_count AS DOUBLE) AS ai_candidate_rate, pre_purchase_decision_count / CAST(content_count AS DOUBLE) AS pre_purchase_rate FROM b""")
def q_summary_by_product_console(spark, d):
    return metrics.summary_by_product_console(content_docs(spark, d))


@query(f"""{WITH_TERMS}, hits AS (SELECT kind AS keyword_type, term AS keyword, count(*) AS hit_count FROM terms WHERE ai_candidate GROUP BY 1, 2),
t AS (SELECT kind, term, content_text_clean, min(seq) AS first_at FROM terms WHERE ai_candidate AND content_text_clean <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY kind, term ORDER BY first_at) AS n FROM t)
SELECT h.*, {", ".join(f"coalesce((SELECT content_text_clean FROM r WHERE r.kind = h.keyword_type AND r.term = h.keyword AND n = {i}), '') AS example_{i}" for i in (1, 2, 3))} FROM hits h""")
def q_keyword_summary_batch(spark, d):
    return metrics.summary_by_keyword(content_docs(spark, d))


@query(f"""{WITH_TERMS} SELECT term AS keyword, count(*) AS hit_count, count(*) FILTER (WHERE pre_purchase_decision) AS pre_purchase_decision_count, count(*) FILTER (WHERE ai_candidate) AS ai_candidate_count,
  'A:' || CAST(count(*) FILTER (WHERE evidence_level = 'A') AS VARCHAR) || ' / B:' || CAST(count(*) FILTER (WHERE evidence_level = 'B') AS VARCHAR) || ' / C:' || CAST(count(*) FILTER (WHERE evidence_level = 'C') AS VARCHAR) || ' / D:' || CAST(count(*) FILTER (WHERE evidence_level = 'D') AS VARCHAR) AS level_counts,
  arg_min(content_text_clean, seq) AS example FROM terms GROUP BY 1""")
def q_keyword_summary_console(spark, d):
    docs = content_docs(spark, d)
    return metrics.summary_by_keyword_console(docs.withColumn("matched_keywords", F.concat("ai_source_terms", "ai_action_terms")))


@query(f"""{WITH_TERMS}, {_TOP.format(n="ai_source_terms", keys="product_id", rows="terms", kind="ai_source")} SELECT * FROM top_ai_source_terms""")
def q_topk_terms(spark, d):
    return metrics.top_terms(content_docs(spark, d).where("ai_candidate"), ["product_id"], "ai_source_terms", "top_ai_source_terms")


_MONTH = f"""m AS (SELECT *, substr(review_date, 1, 7) AS review_month FROM docs WHERE content_role = 'review' AND length(trim(review_date)) >= 7), mt AS (SELECT *, substr(review_date, 1, 7) AS review_month FROM terms WHERE content_role = 'review' AND length(trim(review_date)) >= 7),
g AS (SELECT review_month, count(*) AS review_count, count(*) FILTER (WHERE pre_purchase_decision) AS pre_purchase_decision_count, count(*) FILTER (WHERE ai_candidate) AS ai_candidate_count, {", ".join(f"count(*) FILTER (WHERE ai_candidate AND evidence_level = '{x}') AS {x.lower()}_level_count" for x in "ABC")}, count(*) FILTER (WHERE ai_candidate) / CAST(count(*) AS DOUBLE) AS ai_candidate_rate FROM m GROUP BY 1)"""


@query(f"{WITH_TERMS}, {_MONTH}, {_TOP.format(n='ai_source_terms', keys='review_month', rows='mt', kind='ai_source')} SELECT g.*, coalesce(top_ai_source_terms, '') AS top_ai_source_terms FROM g LEFT JOIN top_ai_source_terms USING (review_month)")
def q_month_summary_batch(spark, d):
    return metrics.summary_by_month(content_docs(spark, d), "batch")


@query(f"{WITH_TERMS}, {_MONTH} SELECT * FROM g")
def q_month_summary_console(spark, d):
    return metrics.summary_by_month(content_docs(spark, d), "console")


@query(f"""{WITH}, m AS (SELECT *, substr(CASE WHEN review_date <> '' THEN review_date ELSE substr(content_time, 1, 10) END, 1, 7) AS review_month FROM docs WHERE {_REVIEW})
SELECT review_month, count(*) AS review_count, count(*) FILTER (WHERE pre_purchase_decision) AS pre_purchase_decision_count, count(*) FILTER (WHERE ai_candidate) AS ai_candidate_count, {_LEVELS}, count(*) FILTER (WHERE ai_candidate) / CAST(count(*) AS DOUBLE) AS ai_candidate_rate FROM m WHERE review_month <> '' GROUP BY 1""")
def q_month_summary_tracker(spark, d):
    return metrics.summary_by_month(content_docs(spark, d).withColumn("content_date", F.lit("")), "tracker")


@query(f"{WITH} SELECT evidence_level, count(*) AS count FROM docs WHERE ai_candidate GROUP BY 1")
def q_evidence_levels(spark, d):
    return metrics.evidence_levels(content_docs(spark, d))


@query(f"""{WITH} SELECT count(*) AS content_count, count(*) FILTER (WHERE content_role = 'review') AS review_count, count(*) FILTER (WHERE content_role = 'question') AS question_count, count(*) FILTER (WHERE content_role = 'answer') AS answer_count, count(DISTINCT product_title) AS product_count, count(DISTINCT platform) AS platform_count,
  count(*) FILTER (WHERE content_role = 'review' AND pre_purchase_decision) AS pre_purchase_count, count(*) FILTER (WHERE content_role = 'review' AND ai_candidate) AS ai_candidate_count, count(*) FILTER (WHERE content_role = 'review' AND evidence_level = 'A') AS a_level_count,
  count(*) FILTER (WHERE content_role = 'review' AND pre_purchase_decision) / CAST(count(*) FILTER (WHERE content_role = 'review') AS DOUBLE) AS pre_purchase_rate, count(*) FILTER (WHERE content_role = 'review' AND ai_candidate) / CAST(count(*) FILTER (WHERE content_role = 'review') AS DOUBLE) AS ai_candidate_rate,
  count(*) FILTER (WHERE content_role = 'review' AND evidence_level = 'A') / CAST(count(*) FILTER (WHERE content_role = 'review' AND pre_purchase_decision) AS DOUBLE) AS a_level_rate FROM docs""")
def q_summarize_content(spark, d):
    return metrics.summarize_content(content_docs(spark, d))


@query(f"""{WITH}, a AS (SELECT count(*) FILTER (WHERE {_REVIEW}) AS a, count(*) FILTER (WHERE {_REVIEW} AND pre_purchase_decision) AS b, count(*) FILTER (WHERE {_REVIEW} AND ai_candidate) AS c, count(*) FILTER (WHERE {_REVIEW} AND evidence_level = 'A') AS d FROM docs)
SELECT 1 AS step, 'reviews' AS stage, a AS count FROM a UNION ALL SELECT 2, 'pre_purchase', b FROM a UNION ALL SELECT 3, 'candidates', c FROM a UNION ALL SELECT 4, 'level_a', d FROM a""")
def q_funnel(spark, d):
    return metrics.funnel(content_docs(spark, d))


@query(f"{WITH} SELECT label, count(seq) AS count FROM (VALUES ('P'), ('N'), ('M'), ('Z'), ('X')) t(label) LEFT JOIN docs ON sentiment_label = label GROUP BY 1")
def q_label_distribution(spark, d):
    return metrics.distribution(content_docs(spark, d), "sentiment_label", ("P", "N", "M", "Z", "X"))


@query(f"{WITH} SELECT shop_name AS value, count(*) AS count FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q_category_top15(spark, d):
    return metrics.top_categories(content_docs(spark, d), "shop_name")


@query(f"""{WITH}, c AS (SELECT source_file, count(*) FILTER (WHERE {_REVIEW}) AS review_count, count(*) FILTER (WHERE NOT {_REVIEW}) AS qa_count, arg_min(product_title, seq) AS product_title, arg_min(platform, seq) AS platform FROM docs GROUP BY 1) SELECT * FROM c WHERE review_count <= 2 AND qa_count >= 10""")
def q_capture_quality(spark, d):
    return metrics.capture_quality(content_docs(spark, d))


@query(f"""{WITH}, f AS (SELECT *, n_chars % 11 AS s FROM docs WHERE sentiment_label <> '') SELECT count(*) AS total_count, avg(CASE WHEN s > 0 THEN CAST(s AS DOUBLE) END) AS average_score, count(*) FILTER (WHERE seq % 4 = 0) AS rule_count, count(*) FILTER (WHERE seq % 4 <> 0) AS llm_fast_count,
  {", ".join(f"count(*) FILTER (WHERE sentiment_label = '{x}') AS sentiment_{x.lower()}" for x in "PNMZ")}, (SELECT count(DISTINCT content_id) FROM docs WHERE toxic = 1) AS detail_count, (SELECT count(*) FROM docs WHERE sentiment_label = '') AS failed_count FROM f""")
def q_sentiment_metrics(spark, d):
    docs = content_docs(spark, d)
    fast = docs.where("sentiment_label <> ''").select("content_id", "sentiment_label", F.when(F.col("n_chars") % 11 > 0, (F.col("n_chars") % 11).cast("string")).otherwise("n/a").alias("sentiment_score"), F.when(F.col("seq") % 4 == 0, "rule").otherwise("llm_fast").alias("sentiment_source"))
    return metrics.sentiment_metrics(fast, docs.where("toxic = 1").select("content_id"), docs.where("sentiment_label = ''").select("content_id"))


@query(f"""{WITH}, f AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'rule' ELSE 'llm_fast' END AS src FROM docs WHERE sentiment_label <> '') SELECT 'total_count' AS metric, '' AS label, count(*) AS value FROM f UNION ALL SELECT 'rule_count', '', count(*) FILTER (WHERE src = 'rule') FROM f UNION ALL SELECT 'llm_fast_count', '', count(*) FILTER (WHERE src = 'llm_fast') FROM f
{" ".join(f"UNION ALL SELECT 'label_count', '{x}', count(*) FILTER (WHERE sentiment_label = '{x}') FROM f" for x in "PNMZ")}""")
def q_sentiment_summary_rows(spark, d):
    return metrics.run_summary_rows(content_docs(spark, d).where("sentiment_label <> ''").withColumn("sentiment_source", F.when(F.col("seq") % 4 == 0, "rule").otherwise("llm_fast")))


@query("""WITH f AS (SELECT user_id AS batch_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'warning' ELSE 'success' END AS status FROM events), c AS (SELECT batch_id, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'warning') AS warning_count, count(*) FILTER (WHERE status = 'failed') AS failed_count FROM f GROUP BY 1)
SELECT *, CASE WHEN failed_count = 0 THEN CASE WHEN warning_count > 0 THEN 'warning' ELSE 'success' END WHEN success_count + warning_count > 0 THEN 'partial' ELSE 'failed' END AS state FROM c""")
def q_run_status(spark, d):
    e = table(spark, d, "events")
    return metrics.run_status(e.select(F.col("user_id").alias("batch_id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "warning").otherwise("success").alias("status")))


@query("SELECT round(sum(value), 3) AS total_value, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total_k FROM events")
def q_timing_totals(spark, d):
    return metrics.timing_totals(table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")), ["value", "k"]).withColumn("total_value", F.round("total_value", 3))  # sums of doubles hang on their order


@query(f"""{WITH} SELECT count(*) AS row_count, count(*) FILTER (WHERE sentiment_label = 'P') AS positive_count, count(*) FILTER (WHERE sentiment_label = 'N') AS negative_count, count(*) FILTER (WHERE sentiment_label = 'M') AS mixed_count, count(*) FILTER (WHERE ai_candidate) AS ai_count, CAST(0 AS BIGINT) AS low_confidence_count,
  count(*) FILTER (WHERE {_REVIEW}) AS review_count, count(*) FILTER (WHERE NOT {_REVIEW}) AS qa_count FROM docs WHERE platform IN ('en', 'de') AND contains(lower(content_text_clean), 'license')""")
def q_filtered_headline(spark, d):
    return metrics.headline(filters.contains(filters.facets(content_docs(spark, d), platform=["en", "de"]), "License", ["content_text_clean"]))


@query(f"{WITH} SELECT content_id, evidence_level, match_score, source_file FROM docs WHERE ai_candidate ORDER BY CASE evidence_level WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END, match_score DESC, source_file, seq LIMIT 80")
def q_candidate_order(spark, d):
    return tables.top(content_docs(spark, d).where("ai_candidate"), 80, *metrics.candidate_order(), "seq").select("content_id", "evidence_level", "match_score", "source_file")


@query(f"{WITH} SELECT content_id, pre_purchase_decision FROM docs WHERE pre_purchase_decision")
def q_pre_purchase_details(spark, d):
    return metrics.pre_purchase_details(content_docs(spark, d)).select("content_id", "pre_purchase_decision")


# Filters


@query(f"{WITH} SELECT content_id, platform, content_role FROM docs WHERE platform IN ('en', 'fr') AND content_role IN ('review')")
def q_filter_facets(spark, d):
    return filters.facets(content_docs(spark, d), platform=["en", "fr"], content_role=["review"], shop_name=[]).select("content_id", "platform", "content_role")


@query(f"{WITH} SELECT content_id FROM docs WHERE contains(lower(content_text_clean), 'licensed') OR contains(lower(product_title), 'licensed')")
def q_filter_text(spark, d):
    return filters.contains(content_docs(spark, d), "Licensed", ["content_text_clean", "product_title"]).select("content_id")


@query(f"{WITH} SELECT content_id, match_score FROM docs WHERE match_score BETWEEN 3 AND 7 AND NOT pre_purchase_decision")
def q_filter_range(spark, d):
    return filters.tri_state(filters.number_between(content_docs(spark, d), "match_score", 3, 7), "pre_purchase_decision", "no").select("content_id", "match_score")


@query(f"{WITH_TERMS} SELECT DISTINCT content_id FROM terms WHERE kind = 'ai_source' AND term IN ('license', 'token')")
def q_filter_terms(spark, d):
    return filters.with_term(content_docs(spark, d).withColumn("joined", F.array_join("ai_source_terms", "; ")), "joined", ["license", "token"]).select("content_id")


@query(f"{WITH} SELECT DISTINCT shop_name AS value FROM docs")
def q_filter_options(spark, d):
    return filters.options(content_docs(spark, d), "shop_name")


@query(f"{WITH} SELECT content_id, item_key FROM docs WHERE {_REVIEW} AND sentiment_label = '' AND evidence_level = 'A'")
def q_filter_reviews(spark, d):
    return filters.reviews_of(content_docs(spark, d), sentiment="unjudged", level="A").select("content_id", "item_key")


@query(f"{WITH} SELECT content_id, content_role FROM docs WHERE {_REVIEW} AND pre_purchase_decision AND ai_candidate")
def q_filter_pre_purchase(spark, d):
    return filters.pre_purchase(content_docs(spark, d), ai_only=True).select("content_id", "content_role")


@query(f"{WITH} SELECT content_id, sentiment_label FROM docs WHERE sentiment_label IN ('N', 'M') AND ai_candidate")
def q_filter_sentiment(spark, d):
    return filters.by_sentiment(content_docs(spark, d), ["N", "M"], ai_only=True).select("content_id", "sentiment_label")


@query(f"{WITH} SELECT content_id FROM docs WHERE content_role = 'answer' AND contains(lower(parent_text_clean), 'parent 4')")
def q_filter_browse(spark, d):
    return filters.browse(content_docs(spark, d), role="answer", query="parent 4").select("content_id")


@query(f"{WITH} SELECT content_id FROM docs WHERE {_REVIEW} AND trim(content_text_clean) <> ''")
def q_analysis_targets(spark, d):
    return filters.analysis_targets(content_docs(spark, d)).select("content_id")


@query(f"{WITH} SELECT content_id AS id, content_role AS role FROM docs")
def q_project_columns(spark, d):
    return filters.project_columns(content_docs(spark, d), {"content_id": "id", "content_role": "role", "not_there": "x"})


# Joins


@query(f"{WITH} SELECT d.content_id, d.platform, a.n_chars % 3 AS score, a.platform AS platform_analysis FROM docs d LEFT JOIN (SELECT * FROM docs WHERE seq % 4 <> 0) a USING (content_id)")
def q_join_content_analysis(spark, d):
    docs = content_docs(spark, d)
    analysis = docs.where("seq % 4 <> 0").select("content_id", "platform", (F.col("n_chars") % 3).alias("score"))
    return joins.content_analysis(docs.select("content_id", "platform"), analysis)


_TWICE = "fast AS (SELECT content_id, seq, CASE seq % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'N' ELSE '' END AS label FROM docs WHERE seq % 2 = 0 UNION ALL SELECT content_id, seq + 1000000, 'M' FROM docs WHERE seq % 6 = 0)"


def _twice(docs):
    label = F.when(F.col("seq") % 3 == 0, "P").when(F.col("seq") % 3 == 1, "N").otherwise("")
    return docs.where("seq % 2 = 0").select("content_id", "seq", label.alias("sentiment_label")).union(docs.where("seq % 6 = 0").select("content_id", F.col("seq") + 1_000_000, F.lit("M")))


@query(f"{WITH}, {_TWICE}, l AS (SELECT content_id, arg_max(label, seq) AS label FROM fast GROUP BY 1) SELECT d.content_id, coalesce(nullif(trim(d.sentiment_label), ''), l.label, '') AS sentiment_label FROM docs d LEFT JOIN l USING (content_id)")
def q_fill_blank_sentiment(spark, d):
    docs = content_docs(spark, d)
    return joins.fill_blank_scores(docs.select("content_id", "sentiment_label"), _twice(docs), ["sentiment_label"])


@query(f"{WITH}, {_TWICE}, l AS (SELECT content_id, arg_max(label, seq) AS detail, max(seq) AS at FROM fast GROUP BY 1) SELECT d.content_id, l.detail FROM docs d JOIN l USING (content_id)")
def q_high_value(spark, d):
    docs = content_docs(spark, d)
    return joins.high_value(docs.select("content_id"), _twice(docs).withColumnRenamed("sentiment_label", "detail")).select("content_id", "detail")


@query(f"{WITH}, {_TWICE}, l AS (SELECT content_id, arg_min(label, seq) AS label FROM fast GROUP BY 1) SELECT d.content_id, l.label AS sentiment_label FROM docs d LEFT JOIN l USING (content_id)")
def q_enriched_by_sentiment(spark, d):
    docs = content_docs(spark, d)
    return joins.enriched_by_sentiment(docs.select("content_id"), _twice(docs)).select("content_id", "sentiment_label")


@query(f"{WITH}, {_TWICE}, l AS (SELECT content_id, arg_max(label, seq) AS label FROM fast GROUP BY 1) SELECT d.content_id, CASE WHEN l.content_id IS NOT NULL THEN l.label ELSE d.sentiment_label END AS sentiment_label FROM docs d LEFT JOIN l USING (content_id)")
def q_update_analysis(spark, d):
    docs = content_docs(spark, d)
    return joins.update_analysis(docs.select("content_id", "sentiment_label"), _twice(docs), ["sentiment_label"])


@query(f"{WITH}, {_TWICE} SELECT content_id FROM docs WHERE content_id NOT IN (SELECT content_id FROM fast WHERE label IN ('P', 'N', 'M', 'Z'))")
def q_unscored_anti(spark, d):
    docs = content_docs(spark, d)
    return joins.unscored(docs.select("content_id"), _twice(docs))


@query(f"{WITH}, x AS (SELECT md5(content_text_clean) AS k, seq FROM docs), s AS (SELECT k, min(seq) AS seq FROM x WHERE seq % 3 = 0 GROUP BY 1) SELECT * FROM s UNION ALL SELECT k, min(seq) FROM x WHERE seq % 3 <> 0 AND k NOT IN (SELECT k FROM s) GROUP BY 1")
def q_add_unseen(spark, d):
    x = content_docs(spark, d).select(F.md5("content_text_clean").alias("k"), "seq")
    return joins.add_unseen(identity.keep_first(x.where("seq % 3 = 0"), ["k"], "seq"), x.where("seq % 3 <> 0"), "k")


# Tables


@query(f"{WITH} SELECT content_id, 'en' AS workbook_source FROM docs WHERE platform = 'en' UNION ALL SELECT content_id, 'rest' FROM docs WHERE platform <> 'en'")
def q_union_workbooks(spark, d):
    docs = content_docs(spark, d)
    return tables.union_labelled({"en": docs.where("platform = 'en'").select("content_id"), "rest": docs.where("platform <> 'en'").select("content_id")})


@query(f"{WITH} SELECT count(DISTINCT shop_name) AS shop_count, count(DISTINCT product_id) AS product_count, count(*) FILTER (WHERE {_REVIEW}) AS review_count, count(*) FILTER (WHERE NOT {_REVIEW}) AS qa_count FROM docs")
def q_project_summary(spark, d):
    return tables.project_summary(content_docs(spark, d))


@query(f"{WITH} SELECT platform, content_id, 'old' AS version FROM docs WHERE platform <> 'de' UNION ALL SELECT platform, content_id, 'new' FROM docs WHERE platform = 'de' AND seq % 2 = 0")
def q_replace_partition(spark, d):
    docs = content_docs(spark, d).select("platform", "content_id", "seq")
    fresh = docs.where("platform = 'de' and seq % 2 = 0").select("platform", "content_id", F.lit("new").alias("version"))
    return tables.replace_partition(docs.select("platform", "content_id", F.lit("old").alias("version")), fresh, ["platform"])


@query(f"{WITH} SELECT content_id, row_number() OVER (PARTITION BY item_key ORDER BY seq) AS n FROM docs")
def q_dense_ids(spark, d):
    return tables.numbered(content_docs(spark, d).select("content_id", "item_key", "seq"), ["item_key"], "seq").select("content_id", F.col("n").cast("long").alias("n"))


@query("""WITH u AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' AND next_text <> text THEN next_text ELSE '' END AS answer FROM u WHERE role = 'user'""")
def q_qa_pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").withColumns({"nt": F.lead("text").over(w), "nr": F.lead("role").over(w)})
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when((F.col("nr") == "assistant") & (F.col("nt") != F.col("text")), F.col("nt")).otherwise("").alias("answer"))


# Identity


@query(f"""{WITH}, h AS (SELECT seq, md5(platform || chr(31) || product_id || chr(31) || content_role || chr(31) || content_text_clean || chr(31) || parent_text_clean) AS content_hash FROM docs) SELECT min(seq) AS seq, content_hash FROM h GROUP BY content_hash""")
def q_content_hash_dedupe(spark, d):
    return identity.dedupe_records(content_docs(spark, d)).select("seq", "content_hash")


_N = lambda c: f"lower(trim(regexp_replace(replace(replace({c}, chr(160), ' '), chr(12288), ' '), '\\s+', ' ', 'g')))"
_PARTS = lambda *cs: " || chr(31) || ".join(_N(c) for c in cs)
KEYS = f"""keys AS (SELECT *, CASE WHEN platform_content_id <> '' THEN 'native:' || item_key || ':' || content_role || ':' || lower(platform_content_id) ELSE '' END AS strict_key,
  'composite:' || sha256({_PARTS("item_key", "content_role", "content_text_clean", "parent_text_clean", "user_name_masked", "content_time", "sku")}) AS composite_key, 'text:' || sha256({_PARTS("item_key", "content_role", "content_text_clean", "parent_text_clean")}) AS text_key,
  CAST(user_name_masked <> '' AS INTEGER) + CAST(content_time <> '' AS INTEGER) + CAST(sku <> '' AS INTEGER) AS own FROM docs)"""


@query(f"""{WITH}, {KEYS} SELECT content_id, strict_key, composite_key, text_key, CASE WHEN strict_key <> '' THEN strict_key WHEN own > 0 OR parent_text_clean <> '' THEN composite_key ELSE text_key END AS identity_key,
  CASE WHEN strict_key <> '' THEN 'native_id' WHEN own > 0 OR parent_text_clean <> '' THEN 'composite' ELSE 'low_confidence' END AS identity_method, CASE WHEN strict_key <> '' THEN 'high' WHEN own >= 2 THEN 'high' WHEN own > 0 OR parent_text_clean <> '' THEN 'medium' ELSE 'low' END AS identity_confidence FROM keys""")
def q_identity_keys(spark, d):
    return identity.identity_keys(content_docs(spark, d)).select("content_id", "strict_key", "composite_key", "text_key", "identity_key", "identity_method", "identity_confidence")


# Texts


@query(f"""{WITH} SELECT content_id, array_to_string(list_filter(list_transform(string_split_regex(shop_name || ', x|' || sku || ';;y', '[,，|、;]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS terms FROM docs""")
def q_split_terms(spark, d):
    return content_docs(spark, d).select("content_id", F.array_join(X.split_terms(F.concat("shop_name", F.lit(", x|"), "sku", F.lit(";;y"))), "/").alias("terms"))


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name FROM pages")
def q_file_name(spark, d):
    return table(spark, d, "pages").select("page_id", X.source_file_name(F.col("url")).alias("name"))


@query(f"""{WITH}, x AS (SELECT content_id, 'seen 2024/' || CAST(seq % 14 AS VARCHAR) || '/' || CAST(seq % 33 AS VARCHAR) AS t FROM docs), y AS (SELECT *, regexp_extract(t, '(20\\d{{2}})[-/.年](\\d{{1,2}})[-/.月](\\d{{1,2}})日?', 0) AS raw FROM x)
SELECT content_id, raw, coalesce(strftime(try_strptime(raw, '%Y/%m/%d'), '%Y-%m-%d'), '') AS day FROM y""")
def q_review_date(spark, d):
    t = F.concat(F.lit("seen 2024/"), (F.col("seq") % 14).cast("string"), F.lit("/"), (F.col("seq") % 33).cast("string"))
    raw, day = X.review_date(t)
    return content_docs(spark, d).select("content_id", raw.alias("raw"), day.alias("day"))


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_text_clean, '(?m)^\\s*(?:\\.{3,}|…+)\\s*$', ' ', 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '\\n{2,}', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10) || '|')"


@query(f"{WITH} SELECT content_id, md5({_CLEAN}) AS cleaned, length({_CLEAN}) AS n FROM docs")
def q_clean_text(spark, d):
    return content_docs(spark, d).select("content_id", X.clean_text(F.col("content_text_clean")).alias("t")).select("content_id", F.md5("t").alias("cleaned"), F.length("t").cast("long").alias("n"))


@query(f"""{WITH}, s AS (SELECT content_id, content_text_clean AS t, list_filter(list_transform(string_split_regex(content_text_clean, '[。！？!?；;\\r\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM docs),
m AS (SELECT content_id, t, list_distinct(list_filter(parts, lambda p: contains(lower(replace(p, ' ', '')), 'license'))) AS hit, instr(lower(regexp_replace(t, '\\s+', '', 'g')), 'license') AS place, list_filter(parts, lambda p: contains(lower(replace(p, ' ', '')), 'license')) AS ordered FROM s)
SELECT content_id, md5(CASE WHEN t = '' THEN '' WHEN length(t) <= 80 THEN t WHEN len(hit) = 1 THEN ordered[1] WHEN len(hit) > 1 THEN array_to_string(list_filter(ordered, lambda x, i: list_position(ordered, x) = i), ' || ') WHEN place > 0 THEN substr(t, greatest(place - 1 - 40, 0) + 1, 80) ELSE substr(t, 1, 80) END) AS sentence FROM m""")
def q_matched_sentence(spark, d):
    return content_docs(spark, d).select("content_id", F.md5(X.matched_sentence(F.col("content_text_clean"), F.array(F.lit("license")))).alias("sentence"))


# Classification with an ASCII lexicon

LEXICON = Lexicon(
    specific=("license", "licensed"), generic=("token",), weak=("token",), research=("thing", "under"), actions=("released", "version"), purchase=("with",), decision=("for", "that"), ambiguous=(), token="QX",
    merchant_terms=("idiot", "moron", "stupid", "clown"),
    patterns={"human_service": r"(?i)(?:^|[^A-Za-z0-9_])(?:with|avec) .{0,4}the(?:$|[^A-Za-z0-9_])", "anchor": r"(?i)public", "true_compare": r"(?i)(?:^|[^A-Za-z0-9_])than(?:$|[^A-Za-z0-9_])", "info_search": r"(?i)apache|mit(?:$|[^A-Za-z0-9_])", "risk_value": r"(?i)worthless", "fit_question": r"(?i)\?", "light_pre_purchase": r"(?i)(?:^|[^A-Za-z0-9_])are(?:$|[^A-Za-z0-9_])", "merchant_reply": r"(?s)!!.*!!.*!!", "post_purchase": r"\|", "post_comparison": r"&&&.*%%%", "price_dispute": r"\$\$\$", "inferred_research": r"(?i)licensed.*general", "choosing": r"(?i)license", "social": r"(?i)gnu", "search": r"(?i)apache", "friends": r"(?i)(?:^|[^A-Za-z0-9_])und(?:$|[^A-Za-z0-9_])"},
)
_HAS = lambda p, c="content_text_clean": f"regexp_matches({c}, '{p}')"
_T = {w: f"regexp_matches(content_text_clean, '{X.term_pattern(w).replace(chr(39), chr(39) * 2).replace('(?iu)', '(?i)').replace('u00a0', 'x{00a0}').replace('u200b', 'x{200b}').replace('u200d', 'x{200d}').replace('ufeff', 'x{feff}')}')" for w in ("license", "licensed", "token", "thing", "under", "released", "version", "with", "for", "that")}
CLASSIFIED = f"""c0 AS (SELECT *, {_T["licensed"]} AS s2, {_T["license"]} AS s1, {_T["token"]} AS g, {_T["thing"]} AS r1, {_T["under"]} AS r2, {_T["released"]} OR {_T["version"]} AS act, {_T["with"]} AS buy, {_T["for"]} OR {_T["that"]} AS dec,
  (CAST(contains(content_text_clean, 'idiot') AS INTEGER) + CAST(contains(content_text_clean, 'moron') AS INTEGER) + CAST(contains(content_text_clean, 'stupid') AS INTEGER) + CAST(contains(content_text_clean, 'clown') AS INTEGER)) >= 2 OR {_HAS("(?s)!!.*!!.*!!")} AS merch, {_HAS("(?i)public")} AS anchor, {_HAS("(?i)(?:^|[^A-Za-z0-9_])(?:with|avec) .{0,4}the(?:$|[^A-Za-z0-9_])")} AS human FROM docs),
c1 AS (SELECT *, CASE WHEN merch THEN 'merchant_reply_like_text' WHEN {_HAS("\\$\\$\\$")} AND NOT anchor THEN 'after_purchase_price_dispute' WHEN {_HAS("&&&.*%%%")} AND NOT anchor THEN 'post_purchase_comparison' WHEN {_HAS("\\|")} AND NOT anchor THEN 'post_purchase_experience' ELSE '' END AS block_reason FROM c0)"""


def _classified(spark, d):
    return C.classify(content_docs(spark, d), LEXICON)


@query(f"{WITH}, {CLASSIFIED} SELECT content_id, block_reason FROM c1")
def q_classify_block_reason(spark, d):
    return content_docs(spark, d).select("content_id", C.block_reason(F.col("content_text_clean"), LEXICON).alias("block_reason"))


_RES = f"(CASE WHEN block_reason <> '' THEN 0 ELSE CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST({_HAS('(?i)licensed.*general')} AS INTEGER) + CAST({_HAS('(?i)apache|mit(?:$|[^A-Za-z0-9_])')} AND {_HAS('(?i)license')} AS INTEGER) END)"
_PRE = f"(block_reason = '' AND (anchor OR {_HAS('(?i)(?:^|[^A-Za-z0-9_])than(?:$|[^A-Za-z0-9_])')} OR {_HAS('(?i)apache|mit(?:$|[^A-Za-z0-9_])')} OR {_HAS('(?i)worthless')} OR {_HAS('(?i)[?]')} OR {_HAS('(?i)(?:^|[^A-Za-z0-9_])are(?:$|[^A-Za-z0-9_])')} OR human OR dec))"


@query(f"{WITH}, {CLASSIFIED} SELECT content_id, {_RES} AS n_research, {_PRE} AS pre_purchase_decision FROM c1")
def q_classify_research(spark, d):
    return _classified(spark, d).select("content_id", F.size("research_terms").alias("n_research"), "pre_purchase_decision")


@query(f"""{WITH}, {CLASSIFIED}, c2 AS (SELECT *, {_RES} AS nr, {_PRE} AS pre, CASE WHEN s2 OR s1 THEN 1 ELSE 0 END AS ns FROM c1),
c3 AS (SELECT *, CASE WHEN block_reason <> '' THEN '' WHEN ns > 0 THEN 'A' WHEN g THEN 'B' WHEN nr > 0 AND pre THEN 'C' WHEN pre THEN 'D' ELSE '' END AS level FROM c2),
c4 AS (SELECT *, human AND ns = 0 AND NOT g AS human_only, ns > 0 OR g OR (nr > 0 AND pre AND block_reason = '') AS gate, CASE WHEN human AND ns = 0 AND NOT g THEN 'human_service_only' WHEN block_reason <> '' THEN block_reason WHEN ns = 0 AND NOT g AND nr = 0 THEN 'no_source_or_research' WHEN nr > 0 AND NOT pre THEN 'research_without_purchase_context' ELSE '' END AS excl FROM c3)
SELECT content_id, CASE WHEN gate AND NOT human_only AND block_reason = '' THEN CASE WHEN ns > 0 THEN 'specific_source' WHEN g THEN 'generic_source' ELSE 'intensive_research' END ELSE excl END AS ai_candidate_gate_reason, CASE WHEN level IN ('A', 'B', 'C') THEN '' WHEN block_reason <> '' THEN block_reason ELSE excl END AS exclude_reason,
  CASE level WHEN 'A' THEN 'explicit' WHEN 'B' THEN 'generic' WHEN 'C' THEN 'inferred' ELSE 'none' END AS ai_evidence_type, block_reason, pre AS pre_purchase_decision, level AS evidence_level, level IN ('A', 'B', 'C') AS ai_candidate, 6 * ns + 6 * CAST(g AS INTEGER) + 2 * nr + 3 * CAST(act AS INTEGER) + 2 * CAST(buy AS INTEGER) + 2 * CAST(dec OR pre AS INTEGER) + CASE WHEN content_role IN ('question', 'answer') AND (ns > 0 OR g) THEN 1 ELSE 0 END AS match_score,
  CASE WHEN ns > 0 THEN 'specific_ai' WHEN g THEN 'algorithm_or_system' WHEN nr > 0 THEN CASE WHEN human THEN 'mixed_research_and_customer_service' WHEN {_HAS("(?i)gnu")} THEN 'social_media_research' WHEN {_HAS("(?i)apache")} THEN 'search_research' ELSE 'content_research' END WHEN human THEN 'customer_service' WHEN {_HAS("(?i)(?:^|[^A-Za-z0-9_])und(?:$|[^A-Za-z0-9_])")} THEN 'friends_or_family' ELSE 'unknown' END AS source_type FROM c4""")
def q_classify_levels(spark, d):
    return _classified(spark, d).select("content_id", "evidence_level", "ai_candidate", "match_score", "source_type", "ai_candidate_gate_reason", "exclude_reason", "ai_evidence_type", "block_reason", "pre_purchase_decision")


WORDS = SentimentWords(positive=("the", "que"), service=("with", "avec"), service_positive=("that", "pas"), mixed=("under", "idiot"), negative=("worthless",))


@query(f"""{WITH}, x AS (SELECT content_id, regexp_replace(content_text_clean, '\\s+', '', 'g') AS t FROM docs), y AS (SELECT *, t <> '' AND NOT regexp_matches(t, 'under|idiot|worthless') AS clear FROM x)
SELECT content_id, CASE WHEN clear AND regexp_matches(t, 'with|avec') AND regexp_matches(t, 'that|pas') THEN 8 WHEN clear AND length(t) <= 12 AND regexp_matches(t, 'the|que') THEN 7 ELSE 0 END AS score FROM y""")
def q_rule_sentiment(spark, d):
    return content_docs(spark, d).select("content_id", C.rule_sentiment(F.col("content_text_clean"), WORDS).alias("r")).select("content_id", F.coalesce("r.score", F.lit(0)).alias("score"))


@query(f"{WITH} SELECT content_id FROM docs WHERE sentiment_label IN ('N', 'M') OR n_chars % 3 = 1 OR evidence_level IN ('A', 'B', 'C') OR n_chars % 7 >= 5 OR length(content_text_clean) >= 80")
def q_detail_selection(spark, d):
    wanted = C.detail_wanted(F.col("sentiment_label"), F.col("n_chars") % 3, F.col("evidence_level"), F.col("n_chars") % 7, F.col("content_text_clean"), F.lit(False))
    return content_docs(spark, d).where(wanted).select("content_id")
