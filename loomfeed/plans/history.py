"""Queries over time: sales estimates, captures and the master table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import kept_columns
from ..operators import identity, sales, snapshots
from .adapters import DOCS, ORDERS, PRODUCTS, SNAPS, content_docs, content_orders, product_rows, query, snapshot_rows, table
from .content import KEYS

WITH = f"WITH {ORDERS}"


@query(f"{WITH} SELECT * FROM h")
def q_sales_history(spark, d):
    return sales.sales_history(content_orders(spark, d))


@query(f"{WITH}, {PRODUCTS}, n AS (SELECT item_key, product_title_current AS product_title, platform FROM p) SELECT h.*, n.product_title, n.platform, '[' || CASE n.platform WHEN 'tmall' THEN '天猫' WHEN 'taobao' THEN '淘宝' ELSE '京东' END || '] ' || CASE WHEN trim(n.product_title) <> '' THEN n.product_title ELSE h.item_key END AS product_display_name FROM h JOIN n USING (item_key)")
def q_sales_history_named(spark, d):
    content = content_orders(spark, d)
    return sales.with_names(sales.sales_history(content), sales.product_metadata(product_rows(spark, d), content))


@query(f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY sales_month DESC) AS n FROM h) SELECT item_key, sales_month, review_count, estimated_sales, previous_estimated_sales, sales_change, trend FROM r WHERE n = 1")
def q_sales_latest(spark, d):
    return sales.latest_progress(sales.sales_history(content_orders(spark, d)))


@query(f"{WITH} SELECT sales_month, CAST(sum(review_count) AS BIGINT) AS review_count, round(sum(estimated_sales), 3) AS estimated_sales, count(*) AS item_count FROM h WHERE sales_month = (SELECT max(sales_month) FROM h) GROUP BY 1")
def q_sales_period_total(spark, d):
    return sales.period_total(sales.sales_history(content_orders(spark, d))).withColumn("estimated_sales", F.round("estimated_sales", 3))


@query(f"{WITH} SELECT count(*) FILTER (WHERE content_role = 'review') AS total_reviews, count(*) FILTER (WHERE content_role = 'review' AND seq % 7 <> 0) AS dated_reviews, count(*) FILTER (WHERE content_role = 'review' AND seq % 7 = 0) AS undated_reviews, count(*) FILTER (WHERE content_role = 'review' AND seq % 7 <> 0) / CAST(count(*) FILTER (WHERE content_role = 'review') AS DOUBLE) AS coverage FROM o")
def q_sales_coverage(spark, d):
    return sales.date_coverage(content_orders(spark, d).withColumn("content_date", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("content_date"))))


def _catalog(spark, d):
    content = content_orders(spark, d)
    history = None
    for name, part in (("even", content.where("seq % 2 = 0")), ("odd", content.where("seq % 2 = 1"))):
        h = sales.sales_history(part).withColumn("project_id", F.lit(name))
        history = h if history is None else history.unionByName(h)
    c = content.withColumn("project_id", F.when(F.col("seq") % 2 == 0, "even").otherwise("odd"))
    cover = c.where("content_role = 'review'").groupBy("project_id", "item_key").agg((F.count_if(F.col("seq") % 3 != 0) / F.count("*")).alias("coverage"))
    dates = c.groupBy("project_id", "item_key").agg(F.max("content_date").alias("data_date"))
    products = product_rows(spark, d).drop("project_id")
    both = products.withColumn("project_id", F.explode(F.array(F.lit("even"), F.lit("odd"))))
    return sales.build_catalog(both, history, cover, dates)


CATALOG = f"""{WITH}, {PRODUCTS}, q AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS project_id FROM o),
m AS (SELECT project_id, item_key, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS review_count FROM q WHERE content_role = 'review' GROUP BY 1, 2, 3), l AS (SELECT *, row_number() OVER (PARTITION BY project_id, item_key ORDER BY period DESC) AS n FROM m),
cov AS (SELECT project_id, item_key, round(100 * (count(*) FILTER (WHERE seq % 3 <> 0) / CAST(count(*) AS DOUBLE)), 1) AS coverage_percent FROM q WHERE content_role = 'review' GROUP BY 1, 2), dt AS (SELECT project_id, item_key, strftime(max(o_orderdate), '%Y-%m-%d') AS data_date FROM q GROUP BY 1, 2),
c0 AS (SELECT p.platform, p.platform_product_id, l.project_id, l.item_key, l.period, CAST(l.review_count * 20 AS BIGINT) AS estimated_sales, l.review_count, CAST(0.05 AS DOUBLE) AS review_rate, cov.coverage_percent, dt.data_date, row_number() OVER (PARTITION BY p.platform, p.platform_product_id ORDER BY dt.data_date DESC, p.source_mtime DESC, l.project_id DESC) AS n
  FROM l JOIN p ON p.item_key = l.item_key JOIN cov ON cov.project_id = l.project_id AND cov.item_key = l.item_key JOIN dt ON dt.project_id = l.project_id AND dt.item_key = l.item_key WHERE l.n = 1 AND p.platform IN ('tmall', 'taobao')),
cat AS (SELECT platform, platform_product_id, project_id, item_key, period, estimated_sales, review_count, review_rate, coverage_percent, data_date FROM c0 WHERE n = 1)"""


@query(f"{CATALOG} SELECT * FROM cat")
def q_catalog(spark, d):
    return _catalog(spark, d)


@query(f"""{CATALOG}, ask AS (SELECT c_custkey AS id, 'tmall' AS platform, CAST(c_custkey % 1500 AS VARCHAR) AS platform_product_id FROM customer), one AS (SELECT platform_product_id, any_value(platform) AS platform, any_value(estimated_sales) AS estimated_sales FROM cat GROUP BY 1 HAVING count(*) = 1)
SELECT a.id, CASE WHEN c.platform IS NOT NULL THEN 'exact' WHEN o.platform IS NOT NULL THEN 'by_id' ELSE 'not_found' END AS status, coalesce(c.platform, o.platform) AS found_platform, coalesce(c.estimated_sales, o.estimated_sales) AS estimated_sales FROM ask a LEFT JOIN cat c ON c.platform = a.platform AND c.platform_product_id = a.platform_product_id LEFT JOIN one o ON o.platform_product_id = a.platform_product_id""")
def q_catalog_lookup_fallback(spark, d):
    ask = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("tmall").alias("platform"), (F.col("c_custkey") % 1500).cast("string").alias("platform_product_id"))
    return sales.catalog_lookup(ask, _catalog(spark, d)).select("id", "status", "found_platform", "estimated_sales")


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS item_key, strftime(latest, '%Y-%m-%d') AS latest, CAST(datediff('day', latest, TIMESTAMP '2001-06-01 00:00:00') AS BIGINT) AS days_since_update FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE latest IS NULL OR latest < TIMESTAMP '2001-05-18 00:00:00'""")
def q_stale_items(spark, d):
    products = product_rows(spark, d).select("item_key")
    snaps = table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("item_key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("capture_time"))
    return snapshots.stale_items(products, snaps, "2001-06-01 00:00:00").select("item_key", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "days_since_update")


@query("SELECT 'c:' || CAST(o_custkey AS VARCHAR) AS item_key, arg_max(CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS snapshot_id FROM orders GROUP BY 1")
def q_latest_snapshot(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("item_key"), F.col("o_orderkey").cast("string").alias("snapshot_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("capture_time"), F.date_format(F.timestamp_seconds("o_orderkey"), "yyyy-MM-dd HH:mm:ss").alias("imported_at"))
    return snapshots.latest_snapshot(o).select("item_key", "snapshot_id")


def _compared(spark, d):
    keys = identity.identity_keys(content_docs(spark, d))
    bare = content_docs(spark, d).where("seq % 2 = 0").withColumns({c: F.when(F.col("seq") % 8 == 0, "").otherwise(F.col(c)) for c in ("user_name_masked", "content_time", "sku", "platform_content_id")})
    return keys.where("seq % 3 <> 0"), identity.identity_keys(bare)


COMPARED = f"""WITH {DOCS}, {KEYS}, bare AS (SELECT * REPLACE (CASE WHEN seq % 8 = 0 THEN '' ELSE user_name_masked END AS user_name_masked, CASE WHEN seq % 8 = 0 THEN '' ELSE content_time END AS content_time, CASE WHEN seq % 8 = 0 THEN '' ELSE sku END AS sku, CASE WHEN seq % 8 = 0 THEN '' ELSE platform_content_id END AS platform_content_id) FROM docs WHERE seq % 2 = 0),
{KEYS.replace("keys AS", "cand AS").replace("FROM docs", "FROM bare")}, master AS (SELECT * FROM keys WHERE seq % 3 <> 0),
ms AS (SELECT item_key, strict_key, arg_max(content_id, seq) AS id FROM master WHERE strict_key <> '' GROUP BY 1, 2), mc AS (SELECT item_key, composite_key, arg_max(content_id, seq) AS id FROM master GROUP BY 1, 2), mt AS (SELECT item_key, text_key, arg_min(content_id, seq) AS id FROM master GROUP BY 1, 2),
x AS (SELECT c.*, coalesce(ms.id, mc.id) AS hit, mt.id AS text_hit FROM cand c LEFT JOIN ms ON ms.item_key = c.item_key AND ms.strict_key = c.strict_key LEFT JOIN mc ON mc.item_key = c.item_key AND mc.composite_key = c.composite_key LEFT JOIN mt ON mt.item_key = c.item_key AND mt.text_key = c.text_key),
compared AS (SELECT *, CASE WHEN hit IS NOT NULL THEN 'existing' WHEN text_hit IS NOT NULL AND user_name_masked = '' AND content_time = '' AND sku = '' AND parent_text_clean = '' THEN 'uncertain' ELSE 'new' END AS status FROM x)"""


@query(f"{COMPARED} SELECT content_id, status, CASE WHEN status = 'existing' THEN hit WHEN status = 'uncertain' THEN text_hit END AS master_content_id FROM compared")
def q_compare_with_master(spark, d):
    return identity.compare_with_master(*_compared(spark, d)).select("content_id", "status", "master_content_id")


@query(f"{COMPARED} SELECT item_key, count(*) AS extracted_count, count(*) FILTER (WHERE status = 'new') AS new_count, count(*) FILTER (WHERE status = 'existing') AS existing_count, count(*) FILTER (WHERE status = 'uncertain') AS uncertain_count, CASE WHEN count(*) FILTER (WHERE status = 'uncertain') > 0 THEN 'warning' ELSE 'success' END AS result FROM compared GROUP BY 1")
def q_update_log(spark, d):
    return snapshots.update_log(identity.compare_with_master(*_compared(spark, d)))


@query(f"{COMPARED} SELECT item_key, text_hit AS candidate_content_id, CAST(1 AS DOUBLE) AS similarity, 'inspect' AS suggested_action FROM compared WHERE status = 'uncertain'")
def q_review_queue(spark, d):
    return snapshots.review_queue(identity.compare_with_master(*_compared(spark, d))).select("item_key", "candidate_content_id", "similarity", "suggested_action")


def _as_master(master):
    return master.select("content_id", "item_key", "identity_key", "strict_key", "composite_key", "text_key", F.lit("s0").alias("first_seen_snapshot_id"), F.lit("2024-01-01").alias("first_seen_at"), F.lit("s0").alias("last_seen_snapshot_id"), F.lit("2024-01-01").alias("last_seen_at"), F.lit("f0").alias("source_file_first"), F.lit("f0").alias("source_file_last"), F.lit(True).alias("is_active"))


@query(f"""{COMPARED}, hits AS (SELECT DISTINCT hit FROM compared WHERE status = 'existing'), items AS (SELECT DISTINCT item_key FROM compared), u AS (
SELECT m.item_key, m.text_key, 's0' AS first_seen_snapshot_id, CASE WHEN h.hit IS NOT NULL THEN 's1' ELSE 's0' END AS last_seen_snapshot_id, CASE WHEN h.hit IS NOT NULL THEN true WHEN i.item_key IS NOT NULL THEN false ELSE true END AS is_active FROM master m LEFT JOIN hits h ON h.hit = m.content_id LEFT JOIN items i ON i.item_key = m.item_key
UNION ALL SELECT item_key, text_key, 's1', 's1', true FROM compared WHERE status = 'new') SELECT * FROM u""")
def q_apply_master_update(spark, d):
    master, candidates = _compared(spark, d)
    out = snapshots.apply_master_update(_as_master(master), identity.compare_with_master(master, candidates), {"snapshot_id": "s1", "capture_time": "2024-02-01", "source_file": "f1"})
    return out.select("item_key", "text_key", "first_seen_snapshot_id", "last_seen_snapshot_id", "is_active")


@query("""WITH f AS (SELECT event_id, 'p' AS project_id, CAST(user_id AS VARCHAR) AS item_key, md5(event_type || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS file_hash FROM events), s AS (SELECT DISTINCT item_key, file_hash FROM f WHERE event_id % 2 = 0) SELECT f.event_id, s.file_hash IS NOT NULL AS is_duplicate FROM f LEFT JOIN s ON s.item_key = f.item_key AND s.file_hash = f.file_hash WHERE f.event_id % 2 = 1""")
def q_duplicate_file(spark, d):
    f = table(spark, d, "events").select("event_id", F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("item_key"), F.md5(F.concat("event_type", F.floor("value").cast("string"))).alias("file_hash"))
    return snapshots.split_duplicates(f.where("event_id % 2 = 1"), f.where("event_id % 2 = 0")).select("event_id", "is_duplicate")


@query("""WITH f AS (SELECT event_id, user_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts FROM events), s AS (SELECT user_id, max(ts) AS latest FROM f WHERE event_id % 3 = 0 GROUP BY 1) SELECT f.event_id, coalesce(f.ts < s.latest, false) AS is_backfill, CASE WHEN coalesce(f.ts < s.latest, false) THEN 'rejected' ELSE 'accepted' END AS status FROM f LEFT JOIN s USING (user_id) WHERE f.event_id % 3 <> 0""")
def q_backfill_gate(spark, d):
    f = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("item_key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("capture_time"))
    return snapshots.backfill_gate(f.where("event_id % 3 <> 0"), f.where("event_id % 3 = 0")).select("event_id", "is_backfill", "status")


_RUNS = """WITH e AS (SELECT 'u:' || CAST(user_id AS VARCHAR) AS item_key, event_type || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
o AS (SELECT item_key, t, r AS i FROM e WHERE r <= 50), b AS (SELECT item_key, t, r + 3 AS q, n + 3 AS n FROM e WHERE r <= n - 2 UNION ALL SELECT item_key, 'fresh' || CAST(r AS VARCHAR), r, n + 3 FROM e WHERE r <= 3), nn AS (SELECT *, count(*) OVER (PARTITION BY item_key) AS size FROM b),
w AS (SELECT item_key, t, q - greatest(size - 50, 0) AS j, greatest(size - 50, 0) AS new_start FROM nn WHERE q > size - 50),
m AS (SELECT o.item_key, o.i, w.j, w.new_start FROM o JOIN w ON o.item_key = w.item_key AND o.t = w.t), g AS (SELECT *, i - row_number() OVER (PARTITION BY item_key, i - j ORDER BY i) AS island FROM m), l AS (SELECT *, row_number() OVER (PARTITION BY item_key, i - j, island ORDER BY i) AS length FROM g),
best AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY length DESC, i, j) AS k FROM l WHERE length >= 3)"""


@query(f"""{_RUNS} SELECT i.item_key, CASE WHEN best.k IS NULL THEN 'fallback' ELSE 'overlap_found' END AS status, coalesce(length, 0) AS overlap_length, CASE WHEN best.k IS NULL THEN 0 ELSE new_start + j - length END AS new_prefix_end, CASE WHEN best.k IS NULL THEN '' ELSE 'high' END AS confidence
FROM (SELECT DISTINCT item_key FROM e) i LEFT JOIN (SELECT * FROM best WHERE k = 1) best USING (item_key)""")
def q_overlap_boundary(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w, whole = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    t = F.concat("event_type", F.floor(F.col("value") / 10).cast("string"))
    e = e.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("item_key"), t.alias("t"), F.row_number().over(w).alias("r"), F.count("*").over(whole).alias("n"))
    keyed = lambda df, seq: df.select("item_key", seq.cast("long").alias("seq"), F.lit("").alias("strict_key"), F.col("t").alias("composite_key"), F.col("t").alias("text_key"), *(F.lit("").alias(c) for c in identity.AUXILIARY))
    fresh = e.where("r <= 3").withColumn("t", F.concat(F.lit("fresh"), F.col("r").cast("string")))
    new = keyed(e.where("r <= n - 2"), F.col("r") + 3).union(keyed(fresh, F.col("r")))
    return identity.overlap_boundary(keyed(e, F.col("r")), new)


_GONE = f"""WITH {SNAPS}, snaps AS (SELECT DISTINCT item_key, snapshot_id, capture_time, source_file FROM s), gone AS (SELECT snapshot_id FROM snaps WHERE capture_time < '2024-01-04' OR (item_key < 'u:3' AND capture_time < '2024-01-20')), touched AS (SELECT DISTINCT item_key FROM snaps JOIN gone USING (snapshot_id)),
lft AS (SELECT * FROM snaps WHERE snapshot_id NOT IN (SELECT snapshot_id FROM gone) AND item_key IN (SELECT item_key FROM touched)),
master AS (SELECT item_key, text_key AS content_id, text_key, min(composite_key) AS composite_key, max(strict_key) AS strict_key, min(capture_time) AS first_seen_at, max(capture_time) AS last_seen_at FROM s GROUP BY 1, 2),
tok AS (SELECT item_key, snapshot_id, 'strict' AS k, strict_key AS v FROM s WHERE strict_key <> '' UNION SELECT item_key, snapshot_id, 'composite', composite_key FROM s UNION SELECT item_key, snapshot_id, 'text', text_key FROM s), held AS (SELECT tok.* FROM tok JOIN lft USING (item_key, snapshot_id)),
mt AS (SELECT item_key, content_id, 1 AS r, 'strict' AS k, strict_key AS v FROM master WHERE strict_key <> '' UNION ALL SELECT item_key, content_id, 2, 'composite', composite_key FROM master UNION ALL SELECT item_key, content_id, 3, 'text', text_key FROM master),
hit AS (SELECT mt.item_key, mt.content_id, mt.r, held.snapshot_id FROM mt JOIN held ON mt.item_key = held.item_key AND mt.k = held.k AND mt.v = held.v), fr AS (SELECT content_id, min(r) AS r FROM hit GROUP BY 1),
seen AS (SELECT hit.item_key, hit.content_id, min(l.capture_time) AS first_at, max(l.capture_time) AS last_at FROM hit JOIN fr USING (content_id, r) JOIN lft l ON l.snapshot_id = hit.snapshot_id AND l.item_key = hit.item_key GROUP BY 1, 2), latest AS (SELECT item_key, max(capture_time) AS t FROM lft GROUP BY 1)"""


def _deletion(spark, d):
    s = snapshot_rows(spark, d)
    snaps = kept_columns(s.select("item_key", "snapshot_id", "capture_time", "source_file").distinct()).withColumns({"imported_at": F.col("capture_time"), "extracted_count": F.lit("1")})
    gone = snaps.where("capture_time < '2024-01-04' or (item_key < 'u:3' and capture_time < '2024-01-20')").select("snapshot_id")
    contents = s.select("item_key", "snapshot_id", F.lit("").alias("identity_key"), "strict_key", "composite_key", "text_key")
    master = s.groupBy("item_key", F.col("text_key").alias("content_id")).agg(F.lit("").alias("identity_key"), F.max("strict_key").alias("strict_key"), F.min("composite_key").alias("composite_key"), F.first("text_key").alias("text_key"), F.min("capture_time").alias("first_seen_at"), F.max("capture_time").alias("last_seen_at"), F.lit("").alias("first_seen_snapshot_id"), F.lit("").alias("last_seen_snapshot_id"), F.lit("").alias("source_file_first"), F.lit("").alias("source_file_last"), F.lit(True).alias("is_active"))
    return kept_columns(master), contents, snaps, gone


@query(f"{_GONE} SELECT m.content_id, coalesce(s.first_at, m.first_seen_at) AS first_seen_at, coalesce(s.last_at, m.last_seen_at) AS last_seen_at, coalesce(s.last_at = l.t, true) AS is_active FROM master m LEFT JOIN seen s USING (content_id) LEFT JOIN latest l ON l.item_key = m.item_key WHERE m.item_key NOT IN (SELECT item_key FROM touched) OR s.content_id IS NOT NULL")
def q_snapshot_delete_master(spark, d):
    return snapshots.delete_from_master(*_deletion(spark, d)).select("content_id", "first_seen_at", "last_seen_at", "is_active")


@query(f"""{_GONE}, lost AS (SELECT item_key, count(*) AS n FROM master WHERE item_key IN (SELECT item_key FROM touched) AND content_id NOT IN (SELECT content_id FROM seen) GROUP BY 1), rest AS (SELECT item_key, count(*) AS n FROM lft GROUP BY 1)
SELECT snaps.snapshot_id, snaps.item_key, coalesce(lost.n, 0) AS removed_content_count, coalesce(rest.n, 0) AS remaining_snapshot_count, coalesce(rest.n, 0) = 0 AS removes_product FROM snaps JOIN gone USING (snapshot_id) LEFT JOIN lost ON lost.item_key = snaps.item_key LEFT JOIN rest ON rest.item_key = snaps.item_key""")
def q_snapshot_delete_impact(spark, d):
    return snapshots.deletion_impact(*_deletion(spark, d))


@query("""SELECT (SELECT count(*) FROM events) AS snapshot_count, (SELECT count(*) FROM events WHERE event_type = 'click') AS fallback_count, (SELECT count(*) FROM events WHERE event_id % 5 = 1) AS warning_count, (SELECT count(*) FROM events WHERE event_id % 5 = 2) AS failed_count, (SELECT count(*) FROM events WHERE event_id % 4 <> 0) AS unresolved_count""")
def q_maintenance_quality(spark, d):
    from ..operators import metrics

    e = table(spark, d, "events")
    log = e.select(F.when(F.col("event_id") % 5 == 1, "warning").when(F.col("event_id") % 5 == 2, "failed").otherwise("success").alias("result"))
    return metrics.maintenance_quality(e.select(F.when(F.col("event_type") == "click", "fallback").alias("boundary_status")), log, e.select(F.when(F.col("event_id") % 4 == 0, "Yes").otherwise("no").alias("resolved")))


@query("""WITH p AS (SELECT c_custkey, 'c:' || CAST(c_custkey AS VARCHAR) AS item_key FROM customer), s AS (SELECT o_custkey, max(o_orderdate) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey, max(o_orderdate) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT item_key, strftime(coalesce(s.a, c.b, TIMESTAMP '2002-01-01'), '%Y-%m-%d') AS data_date FROM p LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""")
def q_latest_data_date(spark, d):
    o = table(spark, d, "orders").withColumns({"item_key": F.concat(F.lit("c:"), F.col("o_custkey").cast("string")), "t": F.date_format("o_orderdate", "yyyy-MM-dd")})
    content = o.where("o_orderstatus = 'O'").select("item_key", F.col("t").alias("content_date"), F.lit("").alias("content_time"))
    return snapshots.latest_data_date(content, o.where("o_orderstatus = 'F'").select("item_key", F.col("t").alias("capture_time")), product_rows(spark, d), "2002-01-01").select("item_key", F.date_format("data_date", "yyyy-MM-dd").alias("data_date"))
