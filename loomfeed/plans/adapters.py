"""The test tables seen as feedback tables: each adapter as a DataFrame and as the same text in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (spark, sf_dir) under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCE_WORDS, ACTION_WORDS = ("the", "license", "token", "der"), ("and", "que")


def content_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd")
    words = lambda ws: F.filter(F.array(*map(F.lit, ws)), lambda w: F.col("text").contains(w))
    text = lambda c: c.cast("string")
    return d.select(
        i.alias("seq"), text(i).alias("content_id"), F.concat_ws(":", "lang", "source").alias("item_key"), F.col("lang").alias("platform"), F.col("source").alias("product_id"), F.concat(F.lit("Item "), "source").alias("product_title"),
        F.concat(F.lit("Shop "), text(i % 7)).alias("shop_name"), F.concat(F.lit("f"), text(i % 20), F.lit(".html")).alias("source_file"),
        F.when(i % 10 < 6, "review").when(i % 10 == 6, "followup").when(i % 10 < 9, "question").otherwise("answer").alias("content_role"), F.col("text").alias("content_text_clean"),
        F.when(i % 10 == 9, F.concat(F.lit("Parent "), text(i % 5))).otherwise("").alias("parent_text_clean"), F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("U"), text(i % 50))).alias("user_name_masked"),
        F.when(i % 11 == 0, "").otherwise(day).alias("review_date"), F.when(i % 17 == 0, "").otherwise(F.concat(day, F.lit(" 10:00:00"))).alias("content_time"), F.concat(F.lit("S"), text(i % 4)).alias("sku"), F.when(i % 9 == 0, F.concat(F.lit("N"), text(i))).otherwise("").alias("platform_content_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "P").when((F.col("quality") == 0) & (F.col("toxic") == 1), "N").when((F.col("quality") == 1) & (F.col("toxic") == 1), "M").when((F.col("quality") == 0) & (F.col("toxic") == 0), "Z").otherwise("").alias("sentiment_label"),
        F.when(i % 5 == 0, "A").when(i % 5 == 1, "B").when(i % 5 == 2, "C").when(i % 5 == 3, "D").otherwise("").alias("evidence_level"), (i % 5 < 3).alias("ai_candidate"), (i % 3 != 0).alias("pre_purchase_decision"), (F.col("n_chars") % 17).alias("match_score"),
        words(SOURCE_WORDS).alias("ai_source_terms"), words(ACTION_WORDS).alias("ai_action_terms"), F.col("n_chars"), F.col("quality"), F.col("toxic"),
    )


DOCS = """docs AS (
  SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS content_id, d.lang || ':' || d.source AS item_key, d.lang AS platform, d.source AS product_id, 'Item ' || d.source AS product_title,
    'Shop ' || CAST(d.doc_id % 7 AS VARCHAR) AS shop_name, 'f' || CAST(d.doc_id % 20 AS VARCHAR) || '.html' AS source_file,
    CASE WHEN d.doc_id % 10 < 6 THEN 'review' WHEN d.doc_id % 10 = 6 THEN 'followup' WHEN d.doc_id % 10 < 9 THEN 'question' ELSE 'answer' END AS content_role, d.text AS content_text_clean,
    CASE WHEN d.doc_id % 10 = 9 THEN 'Parent ' || CAST(d.doc_id % 5 AS VARCHAR) ELSE '' END AS parent_text_clean, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'U' || CAST(d.doc_id % 50 AS VARCHAR) END AS user_name_masked,
    CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS review_date,
    CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') || ' 10:00:00' END AS content_time,
    'S' || CAST(d.doc_id % 4 AS VARCHAR) AS sku, CASE WHEN d.doc_id % 9 = 0 THEN 'N' || CAST(d.doc_id AS VARCHAR) ELSE '' END AS platform_content_id,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'P' WHEN l.quality = 0 AND l.toxic = 1 THEN 'N' WHEN l.quality = 1 AND l.toxic = 1 THEN 'M' WHEN l.quality = 0 AND l.toxic = 0 THEN 'Z' ELSE '' END AS sentiment_label,
    CASE d.doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE '' END AS evidence_level, d.doc_id % 5 < 3 AS ai_candidate, d.doc_id % 3 <> 0 AS pre_purchase_decision, d.n_chars % 17 AS match_score, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TERMS = """terms AS (
  SELECT d.*, t.kind, t.pos, t.term FROM docs d JOIN (VALUES ('ai_source', 0, 'the'), ('ai_source', 1, 'license'), ('ai_source', 2, 'token'), ('ai_source', 3, 'der'), ('ai_action', 0, 'and'), ('ai_action', 1, 'que')) t(kind, pos, term)
    ON contains(d.content_text_clean, t.term))"""


def content_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("item_key"), F.when(F.col("o_orderstatus") == "F", "review").when(F.col("o_orderstatus") == "O", "followup").otherwise("question").alias("content_role"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("content_date"), F.lit("").alias("content_time"), F.lit("tmall").alias("platform"))


ORDERS = """o AS (SELECT o_orderkey AS seq, 'c:' || CAST(o_custkey AS VARCHAR) AS item_key, CASE o_orderstatus WHEN 'F' THEN 'review' WHEN 'O' THEN 'followup' ELSE 'question' END AS content_role, o_orderdate FROM orders),
h0 AS (SELECT item_key, strftime(o_orderdate, '%Y-%m') AS sales_month, count(*) AS review_count, count(*) / CAST(0.05 AS DOUBLE) AS estimated_sales FROM o WHERE content_role = 'review' GROUP BY 1, 2),
h1 AS (SELECT *, lag(estimated_sales) OVER (PARTITION BY item_key ORDER BY sales_month) AS previous_estimated_sales FROM h0),
h AS (SELECT *, (estimated_sales - previous_estimated_sales) / previous_estimated_sales AS sales_change,
  CASE WHEN previous_estimated_sales IS NULL THEN '首个有数据月份' WHEN estimated_sales > previous_estimated_sales THEN '销量上升' WHEN estimated_sales < previous_estimated_sales THEN '销量下降' ELSE '销量持平' END AS trend FROM h1)"""


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    platform = F.when(F.col("c_nationkey") % 3 == 0, "tmall").when(F.col("c_nationkey") % 3 == 1, "taobao").otherwise("jd")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.lit("p").alias("project_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("item_key"), platform.alias("platform"), (F.col("c_custkey") % 1000).cast("string").alias("platform_product_id"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_name")).otherwise("").alias("product_title_current"), F.col("n_name").alias("shop_name_current"), F.lit("").alias("last_updated_at"), F.col("c_custkey").alias("source_mtime"))


PRODUCTS = """p AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS item_key, CASE c_nationkey % 3 WHEN 0 THEN 'tmall' WHEN 1 THEN 'taobao' ELSE 'jd' END AS platform, CAST(c_custkey % 1000 AS VARCHAR) AS platform_product_id,
  CASE WHEN c_custkey % 8 <> 0 THEN c_name ELSE '' END AS product_title_current, n_name AS shop_name_current, c_custkey AS source_mtime FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captured contents: an item for each user, a snapshot for each day, contents by value."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    item = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    text = F.concat_ws(" ", "event_type", F.floor("value").cast("string"))
    return e.select(F.col("event_id").alias("seq"), item.alias("item_key"), F.concat_ws("|", item, day).alias("snapshot_id"), F.concat(day, F.lit(" 12:00:00")).alias("capture_time"), F.concat(day, F.lit(".html")).alias("source_file"), text.alias("content_text_clean"), F.concat(F.lit("text:"), F.md5(F.concat_ws("|", item, text))).alias("text_key"), F.concat(F.lit("composite:"), F.md5(F.concat_ws("|", item, text, F.col("event_type")))).alias("composite_key"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("native:"), item, F.lit(":"), F.col("event_type"))).otherwise("").alias("strict_key"))


SNAPS = """s AS (SELECT event_id AS seq, 'u:' || CAST(user_id AS VARCHAR) AS item_key, 'u:' || CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS snapshot_id, strftime(ts, '%Y-%m-%d') || ' 12:00:00' AS capture_time, strftime(ts, '%Y-%m-%d') || '.html' AS source_file,
  event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS content_text_clean, 'text:' || md5('u:' || CAST(user_id AS VARCHAR) || '|' || event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS text_key,
  'composite:' || md5('u:' || CAST(user_id AS VARCHAR) || '|' || event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '|' || event_type) AS composite_key, CASE WHEN event_id % 4 = 0 THEN 'native:u:' || CAST(user_id AS VARCHAR) || ':' || event_type ELSE '' END AS strict_key FROM events)"""
