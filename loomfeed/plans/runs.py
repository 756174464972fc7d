"""Queries over whole runs: imports of batches, scoring of what is unscored, grading anew."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon
from ..lineage import kept_columns, scratch_dir
from ..operators import answers, assets, filters, imports, metrics, sentiment, snapshots
from ..sources import pages
from ..streaming import landing
from .adapters import ACTION_WORDS, DOCS, SOURCE_WORDS, TERMS, content_docs, query, table
from .models import IMAGES, LIS, _upsert, question_pages

WITH = f"WITH {DOCS}"
_CAPTURES = """WITH e AS (SELECT 'u:' || CAST(user_id AS VARCHAR) AS item_key, event_id % 3 AS k, event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS t FROM events),
c AS (SELECT DISTINCT item_key, k, t FROM e), items AS (SELECT item_key, max(k) AS last FROM c WHERE k > 0 GROUP BY 1)"""


@query(f"""{_CAPTURES} SELECT c.item_key, t AS content_text_clean, '2024-01-0' || CAST(min(k) + 1 AS VARCHAR) AS first_seen_at, '2024-01-0' || CAST(max(k) + 1 AS VARCHAR) AS last_seen_at,
  CASE WHEN i.last IS NULL THEN true ELSE max(k) = i.last END AS is_active FROM c LEFT JOIN items i ON i.item_key = c.item_key GROUP BY c.item_key, t, i.last""")
def q_import_batch(spark, d):
    """Events of a user as contents by value, in three captures: the first is the store, two later ones are one batch."""
    e = table(spark, d, "events")
    text, k = F.concat_ws(" ", "event_type", F.floor("value").cast("string")), F.col("event_id") % 3
    rows = kept_columns(e.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("item_key"), k.alias("k"), text.alias("content_text_clean")).distinct())
    day, native = F.concat(F.lit("2024-01-0"), (F.col("k") + 1).cast("string")), F.concat_ws(":", F.lit("native"), "item_key", "content_text_clean")
    rows = rows.withColumns({"project_id": F.lit("p"), "seq": F.lit(0).cast("long"), "strict_key": native, "composite_key": native, "text_key": native, "identity_key": native, "capture_time": day, "snapshot_id": F.concat_ws("|", "item_key", "k"), "source_file": day, "file_hash": F.concat_ws("|", "item_key", "k")})
    rows = rows.withColumns({c: F.lit("") for c in ("user_name_masked", "content_time", "sku", "parent_text_clean")})
    first = rows.where("k = 0").withColumns({"content_id": F.col("strict_key"), "is_active": F.lit(True), **{c: F.col(v) for c, v in (("first_seen_snapshot_id", "snapshot_id"), ("last_seen_snapshot_id", "snapshot_id"), ("first_seen_at", "capture_time"), ("last_seen_at", "capture_time"), ("source_file_first", "source_file"), ("source_file_last", "source_file"))}})
    master = first.drop("k", "capture_time", "snapshot_id", "source_file", "file_hash")
    known = rows.where("k = 0").select("project_id", "item_key", "snapshot_id", "file_hash", "capture_time", F.col("capture_time").alias("imported_at"), "source_file", F.lit("1").alias("extracted_count")).distinct()
    out = imports.import_batch({"content_master": master, "snapshots": known}, rows.where("k > 0").drop("k"))
    return out["content_master"].select("item_key", "content_text_clean", "first_seen_at", "last_seen_at", "is_active")


def _scorer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for a model: labels by id; some ids are never answered, and batches with others fail as a whole."""
    import json

    def line(i: int) -> str:
        if i % 97 == 0:
            raise TimeoutError
        return "" if i % 11 == 0 else json.dumps({"i": str(i), "s": "PNMZ"[i % 4], "sc": i % 10 + 1, "p": "F", "n": "-", "c": i % 3 + 1})

    for x in frames:
        yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(line(int(json.loads(p)["i"])) for p in prompt.split("\n")) for prompt in x["prompt"]]})


def _detail_scorer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    for x in frames:
        yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(json.dumps({"i": json.loads(p)["i"], "e": "e", "r": "r", "g": "g"}) for p in prompt.split("\n")) for prompt in x["prompt"]]})


def _backfill(spark, d):
    docs = content_docs(spark, d).withColumns({"project_id": F.lit("p")})
    fast = docs.select("project_id", "content_id", "sentiment_label")
    tables = {"content_master": docs.drop("sentiment_label"), "sentiment_fast": fast, "analysis": docs.select("project_id", "content_id", "evidence_level"), "products": docs.select("project_id", "item_key", F.col("product_title").alias("product_title_current")).distinct()}
    return sentiment.backfill(tables, "p", _scorer, budget=25, detail_scorer=_detail_scorer)


_TARGETS = f"{WITH}, t AS (SELECT * FROM docs WHERE content_role IN ('review', 'followup') AND trim(content_text_clean) <> '' AND sentiment_label = '')"


@query(f"""{_TARGETS} SELECT content_id, CASE WHEN seq % 97 = 0 THEN 'TimeoutError' WHEN seq % 11 = 0 THEN 'MissingResult' ELSE 'scored' END AS outcome, CASE WHEN seq % 97 = 0 OR seq % 11 = 0 THEN NULL ELSE substr('PNMZ', CAST(seq % 4 + 1 AS INTEGER), 1) END AS sentiment_label FROM t""")
def q_sentiment_backfill(spark, d):
    """Each unscored review: its label, or why it has none; a batch that fails does not take its neighbours along."""
    out = _backfill(spark, d)
    scored = out["fast"].select("content_id", F.lit("scored").alias("outcome"), "sentiment_label")
    return scored.unionByName(out["failures"].select("content_id", F.col("error_type").alias("outcome"), F.lit(None).cast("string").alias("sentiment_label")))


@query(f"""{_TARGETS}, s AS (SELECT *, row_number() OVER (ORDER BY item_key, seq) AS place FROM t WHERE seq % 97 <> 0 AND seq % 11 <> 0 AND (seq % 4 IN (1, 2) OR seq % 3 = 0 OR evidence_level IN ('A', 'B', 'C') OR length(content_text_clean) >= 80 OR pre_purchase_decision))
SELECT t.item_key, count(*) AS target_count, count(*) FILTER (WHERE t.seq % 97 <> 0 AND t.seq % 11 <> 0) AS llm_fast_count, count(*) FILTER (WHERE s.place <= 25) AS detail_count, count(*) FILTER (WHERE t.seq % 97 = 0 OR t.seq % 11 = 0) AS failed_count FROM t LEFT JOIN s ON s.seq = t.seq GROUP BY 1""")
def q_backfill_items(spark, d):
    """Counts of each item: one budget of detailed scorings is shared by all, in their order."""
    return _backfill(spark, d)["item_summary"].select("item_key", "target_count", "llm_fast_count", "detail_count", "failed_count")


def _length_scorer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for a model: labels by the length of the text; some lengths are never answered, batches with others fail."""
    import json

    def line(p: dict) -> str:
        n = len(p["t"])
        if n % 97 == 0:
            raise TimeoutError
        return "" if n % 11 == 0 else json.dumps({"i": p["i"], "s": "PNMZ"[n % 4], "sc": n % 10 + 1, "p": "F", "n": "-", "c": n % 3 + 1})

    for x in frames:
        yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(line(json.loads(p)) for p in prompt.split("\n")) for prompt in x["prompt"]]})


def _two_runs(spark, d) -> dict:
    """A third of the contents is scored by a first run; the second has them all, and is repeated."""
    docs = content_docs(spark, d).drop("sentiment_label")
    log = f"{scratch_dir(spark)}/answers-{uuid.uuid4().hex}"
    run = lambda rows, update: answers.incremental(rows, docs.select("content_id", "evidence_level"), lambda: _length_scorer, log, "p", update, "v1", size=10, detail_scorer=_detail_scorer)
    run(docs.where("seq % 3 = 0"), "u1")
    run(docs, "u2")
    return run(docs, "u2")


_RUNS = f"""WITH {DOCS}, t AS (SELECT *, length(content_text_clean) AS n, bool_or(seq % 3 = 0) OVER (PARTITION BY product_title, content_text_clean) AS early FROM docs WHERE content_role IN ('review', 'followup') AND trim(content_text_clean) <> ''),
r AS (SELECT *, n % 97 = 0 OR n % 11 = 0 AS lost FROM t)"""


@query(f"""{_RUNS} SELECT content_id, CASE WHEN n % 97 = 0 THEN 'TimeoutError' WHEN n % 11 = 0 THEN 'MissingResult' ELSE 'scored' END AS outcome,
  CASE WHEN NOT lost THEN substr('PNMZ', CAST(n % 4 + 1 AS INTEGER), 1) END AS sentiment_label, CASE WHEN NOT lost THEN CASE WHEN early THEN 'u1' ELSE 'u2' END END AS answered_in FROM r""")
def q_sentiment_incremental(spark, d):
    """Each content of the second run: its answer and the run that gave it, or why it has none."""
    out = _two_runs(spark, d)
    scored = out["sentiment_fast"].select("content_id", F.lit("scored").alias("outcome"), "sentiment_label", "answered_in")
    return scored.unionByName(out["sentiment_failures"].select("content_id", F.col("error_type").alias("outcome")), allowMissingColumns=True)


@query(f"""{_RUNS} SELECT 'p' AS project_id, 'u2' AS update_id, count(*) AS target_count, count(*) FILTER (WHERE NOT lost AND early) AS reused_count, count(*) FILTER (WHERE NOT lost AND NOT early) AS llm_fast_count, count(*) FILTER (WHERE lost) AS failed_count, 'partial' AS status FROM r""")
def q_sentiment_run_summary(spark, d):
    return _two_runs(spark, d)["sentiment_run_summary"].select("project_id", "update_id", "target_count", "reused_count", "llm_fast_count", "failed_count", "status")


_DERIVED = f"""WITH {DOCS}, {TERMS}, c AS (SELECT *, CASE WHEN content_role IN ('review', 'followup') THEN 'review' ELSE 'qa' END AS record_type, seq % 4 <> 0 AND ai_candidate AS found FROM docs)"""


@query(f"""{_DERIVED} SELECT 'content_all' AS name, content_id AS key, product_title || '/' || record_type || '/' || CASE WHEN seq % 4 <> 0 THEN evidence_level ELSE '' END AS value, 1 AS n FROM c
UNION ALL SELECT 'reviews_raw', content_id, '', 1 FROM c WHERE record_type = 'review' UNION ALL SELECT 'qa_pairs_raw', content_id, '', 1 FROM c WHERE record_type = 'qa' UNION ALL SELECT 'ai_candidates', content_id, '', 1 FROM c WHERE found
UNION ALL SELECT 'summary_by_evidence_level', evidence_level, '', count(*) FROM c WHERE found GROUP BY 2
UNION ALL SELECT 'summary_by_product', product_id, platform, count(*) FILTER (WHERE found) FROM c GROUP BY 2, 3
UNION ALL SELECT 'summary_by_keyword', term, kind, count(*) FROM terms WHERE seq % 4 <> 0 AND ai_candidate GROUP BY 2, 3""")
def q_derived_tables(spark, d):
    """All derived tables of a project; a quarter of its contents has no analysis, contents of another project stay out."""
    docs = content_docs(spark, d).withColumn("project_id", F.lit("p"))
    graded = ["evidence_level", "ai_candidate", "pre_purchase_decision", "match_score", "ai_source_terms", "ai_action_terms"]
    master = docs.drop(*graded, "product_title", "shop_name").withColumns({"platform_product_id": F.col("product_id"), "identity_key": F.col("content_id"), "source_file_last": F.col("source_file"), "content_date": F.col("review_date")})
    products = docs.select("project_id", "item_key", F.col("product_title").alias("product_title_current"), F.lit("s").alias("shop_name_current"), F.lit("b").alias("brand")).distinct()
    tables = {"content_master": master.union(master.withColumn("project_id", F.lit("q"))), "analysis": docs.where("seq % 4 <> 0").select("project_id", "item_key", "content_id", *graded), "products": products}
    out = snapshots.derived_tables(tables, "p")
    row = lambda name, key, value, n=F.lit(1): out[name].select(F.lit(name).alias("name"), F.col(key).alias("key"), value.alias("value"), n.cast("long").alias("n"))
    rows = row("content_all", "content_id", F.concat_ws("/", "product_title", "record_type", "evidence_level"))
    for name in ("reviews_raw", "qa_pairs_raw", "ai_candidates"):
        rows = rows.union(row(name, "content_id", F.lit("")))
    levels = row("summary_by_evidence_level", "evidence_level", F.lit(""), F.col("content_count"))
    return rows.union(levels).union(row("summary_by_product", "product_id", F.col("platform"), F.col("ai_candidate_count"))).union(row("summary_by_keyword", "keyword", F.col("keyword_type"), F.col("hit_count")))


_CHOSEN = {"platform": ["en", "de"], "content_role": ["review", "question"], "evidence_level": ["A", "B", "C"], "shop_name": [], "sentiment_label": ["P", "Z"]}
_PASS = {c: f"{c} IN ({', '.join(repr(v) for v in values)})" if values else "true" for c, values in _CHOSEN.items()}


@query(f"WITH {DOCS} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM docs WHERE {c} <> '' AND {' AND '.join(p for x, p in _PASS.items() if x != c)} GROUP BY 2" for c in _CHOSEN))
def q_facet_counts(spark, d):
    """Five facets, each counted under the choices of the other four."""
    return filters.facet_counts(content_docs(spark, d), _CHOSEN)


@query(f"{_TARGETS} SELECT content_id, evidence_level FROM t")
def q_evidence_lookup(spark, d):
    docs = content_docs(spark, d)
    return sentiment.scoring_targets(docs.drop("evidence_level"), docs.select("content_id", "sentiment_label"), docs.select("content_id", "evidence_level")).select("content_id", "evidence_level")


@query("""SELECT CAST(doc_id AS VARCHAR) AS content_id, lang || ':' || source AS item_key, CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE 'old' END AS analysis_version, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'P' ELSE '' END AS sentiment_label FROM documents""")
def q_reanalyze(spark, d):
    """Half of the contents belong to the project that is graded anew, a third have scores that stay."""
    docs = content_docs(spark, d).withColumn("project_id", F.when(F.col("seq") % 2 == 0, "p").otherwise("q"))
    old = docs.select("project_id", "content_id", "item_key", F.lit("old").alias("analysis_version"), F.lit("").alias("evidence_level"), F.lit("").alias("sentiment_label"))
    fast = docs.where("seq % 3 = 0").select("project_id", "content_id", "seq", F.lit("P").alias("sentiment_label"))
    master = docs.select("project_id", "content_id", "item_key", "content_role", "content_text_clean", "parent_text_clean", F.lit("").alias("sentiment_label"))
    lexicon = Lexicon(specific=SOURCE_WORDS, generic=(), weak=(), research=(), actions=ACTION_WORDS, purchase=(), decision=(), patterns={})
    return snapshots.reanalyze({"content_master": master, "analysis": old, "sentiment_fast": fast}, "p", lexicon, "v2").select("content_id", "item_key", "analysis_version", "sentiment_label")


@query("""WITH f AS (SELECT 'E' || CAST(l_linenumber % 7 AS VARCHAR) AS t, 'part ' || CAST(l_partkey % 50 AS VARCHAR) AS m FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM (SELECT 'error_type' AS field, t AS value, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL SELECT * FROM (SELECT 'error_message', m AS value, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, value LIMIT 5)""")
def q_common_failures(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return metrics.common_failures(li.select(F.concat(F.lit("E"), (F.col("l_linenumber") % 7).cast("string")).alias("error_type"), F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("error_message")))


def _export(spark, d):
    after, watched = _upsert(spark, d)
    orders = table(spark, d, "orders")
    reviews = orders.select(F.col("o_orderkey").cast("string").alias("local_review_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("product_key"))
    created = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("local_review_id"))
    images = after.withColumn("extract_status", F.when(F.col("image_index") == 1, "embedded").otherwise("missing"))
    exported = assets.exported_images(watched, watched.select("image_id").limit(0), images, reviews, [], 0)
    return assets.export_tables(exported, reviews, reviews.select("product_key"), created, found=3, warnings=2)


_EXPORT = f"""WITH {IMAGES}, w AS (SELECT f.local_review_id, f.image_stage, o.content_sha256 IS NULL AS fresh FROM fresh f LEFT JOIN old o ON o.local_review_id = f.local_review_id AND o.image_stage = f.image_stage AND o.content_sha256 = f.content_sha256),
pw AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS product_key, w.* FROM w JOIN orders ON CAST(o_orderkey AS VARCHAR) = local_review_id),
pr AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS product_key, count(*) FILTER (WHERE o_orderstatus = 'O') AS new_review_count FROM orders GROUP BY 1)"""


@query(f"""{_EXPORT}, g AS (SELECT product_key, count(*) FILTER (WHERE fresh) AS new_image_count, count(*) AS export_image_count FROM pw GROUP BY 1) SELECT pr.product_key, new_review_count, coalesce(new_image_count, 0) AS new_image_count, coalesce(export_image_count, 0) AS export_image_count FROM pr LEFT JOIN g ON g.product_key = pr.product_key""")
def q_export_products(spark, d):
    return _export(spark, d)["products"].select("product_key", "new_review_count", "new_image_count", "export_image_count")


@query(f"""{_EXPORT} SELECT 'product_count' AS metric, count(*) AS value FROM pr UNION ALL SELECT 'new_review_count', CAST(sum(new_review_count) AS BIGINT) FROM pr UNION ALL SELECT 'identified_review_count', 3 UNION ALL SELECT 'review_with_image_count', count(DISTINCT local_review_id) FROM pw UNION ALL SELECT 'identified_image_count', count(*) FROM pw
UNION ALL SELECT 'historical_image_count', count(*) FROM pw WHERE NOT fresh UNION ALL SELECT 'new_review_image_count', count(*) FROM pw WHERE fresh AND image_stage = 'review' UNION ALL SELECT 'new_append_image_count', count(*) FROM pw WHERE fresh AND image_stage = 'append'""")
def q_export_summary(spark, d):
    return _export(spark, d)["summary"].where(~F.col("metric").isin("exported_image_count", "failed_image_count", "warning_count")).select("metric", "value")


@query("SELECT user_id, count(DISTINCT event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS files FROM events GROUP BY 1")
def q_stream_first_sights(spark, d):
    """Events as a stream of files of users: of each user the files that were new when they came."""
    place = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    files = stream.select("user_id", F.concat_ws(" ", "event_type", F.floor("value").cast("string")).alias("file_hash"))
    landing.land(landing.first_sights(files, "user_id", "file_hash"), f"{place}/rows", f"{place}/state").awaitTermination()
    return spark.read.schema("user_id long, file_hash string").parquet(f"{place}/rows").groupBy("user_id").agg(F.count("*").alias("files"))


# Functions of texts and times, and lists of contents


@query(f"""{WITH} SELECT content_id, array_to_string(list_filter(list_transform(string_split_regex(content_text_clean, '[\\r\\n]+'), lambda x: trim(regexp_replace(x, '[ \\t\\f\\x0B]+', ' ', 'g'), ' |')), lambda x: x <> ''), '/') AS lines FROM docs""")
def q_visible_lines(spark, d):
    return content_docs(spark, d).select("content_id", F.array_join(X.split_visible_lines(F.col("content_text_clean")), "/").alias("lines"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def q_strict_seconds(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    return e.select("event_id", F.date_format(X.strict_seconds(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_id % 3 <> 0) = 0 THEN '' ELSE strftime(max(ts) FILTER (WHERE event_id % 3 <> 0), '%Y-%m-%d %H:%M') END AS latest FROM events GROUP BY 1")
def q_latest_minute(spark, d):
    """Times in two formats, a third of them unreadable."""
    t = F.when(F.col("event_id") % 3 == 0, "yesterday").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("user_id", t.alias("t")).groupBy("user_id").agg(X.latest_minute(F.col("t")).alias("latest"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'tmall' WHEN 1 THEN 'taobao' WHEN 2 THEN 'taobao' ELSE '' END AS platform, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS item FROM customer""")
def q_product_reference(spark, d):
    k = F.col("c_custkey").cast("string")
    links = [F.concat(F.lit("look https://detail.tmall.com/item.htm?x=1&id="), k, F.lit(". please")), F.concat(F.lit("http://item.taobao.com/i"), k, F.lit(".htm")), F.concat(F.lit("(https://m.taobao.com/a?itemId="), k, F.lit(")")), F.concat(F.lit("https://nottmall.com/?id="), k)]
    text = links[3]
    for i in range(3):
        text = F.when(F.col("c_custkey") % 4 == i, links[i]).otherwise(text)
    platform, item = X.product_reference(text)
    return table(spark, d, "customer").select("c_custkey", platform.alias("platform"), item.alias("item"))


@query(f"{WITH} SELECT content_id AS i, 'e' || CAST(seq % 7 AS VARCHAR) AS e FROM docs WHERE seq % 5 <> 0")
def q_valid_detail(spark, d):
    """Detailed results as JSON lines, ten of a batch; of a fifth a field is missing."""
    docs = content_docs(spark, d)
    line = F.to_json(F.struct(F.col("content_id").alias("i"), F.concat(F.lit("e"), (F.col("seq") % 7).cast("string")).alias("e"), F.lit("r").alias("r"), F.when(F.col("seq") % 5 != 0, "g").alias("g")))
    responses = docs.groupBy((F.col("seq") % 100).cast("string").alias("batch_id")).agg(F.array_join(F.collect_list(line), "\n").alias("response"))
    return sentiment.valid_detail(sentiment.parsed_lines(responses)).select("i", "e")


@query(f"{WITH} SELECT content_id, sha256(lower(trim(regexp_replace(content_text_clean, '\\s+', ' ', 'g'))) || chr(31) || lower(user_name_masked)) AS fingerprint FROM docs")
def q_fingerprint(spark, d):
    return content_docs(spark, d).select("content_id", assets.fingerprint(F.col("content_text_clean"), F.col("user_name_masked")).alias("fingerprint"))


@query(f"""WITH {LIS}, q AS (SELECT page, trim(regexp_replace(t, '^\\s*(?:问题|问|Q)\\s*[:：]?\\s*', '')) AS question, h AS answer FROM c), r AS (SELECT DISTINCT page, t FROM c WHERE length(t) BETWEEN 4 AND 5000 AND NOT regexp_matches(t, '^[0-9]+$'))
SELECT page, 'review' AS content_role, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT page, 'question', count(DISTINCT question) FROM q WHERE question <> '' GROUP BY 1 UNION ALL SELECT page, 'answer', count(DISTINCT question || chr(31) || answer) FROM q WHERE question <> '' GROUP BY 1""")
def q_page_contents(spark, d):
    """Entries of each page's menu as reviews, and again as questions with their links as answers: one list of contents."""
    rows = table(spark, d, "pages")
    cards = pages.reviews_of_pages(pages.card_nodes(rows.withColumn("html", F.regexp_replace("html", "<li>", '<li class="review-item">'))))
    asked, meta = question_pages(rows)
    contents = pages.content_all_of(pages.contents_of(cards, pages.questions_of_pages(pages.card_nodes(asked, kind="question"), meta)))
    return contents.groupBy("page", "content_role").agg(F.count("*").alias("n"))
