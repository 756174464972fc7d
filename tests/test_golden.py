"""Worked examples with expected values."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import text as X
from loomfeed.functions.lexicon import Lexicon, load_lexicon
from loomfeed.operators import assets, audit, classify, filters, identity, imports, joins, metrics, sales, sentiment, snapshots, tables
from loomfeed.sources import pages, reviews
from loomfeed.streaming import landing


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int").select(column.alias("r")).first().r


# Texts, dates, numbers


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, X.clean_text(c), t="很好​ 展开\n\n....\n  不错 |") == "很好\n不错"
    assert one(spark, X.remove_invalid_xml_chars(c), t="a\x01b\tc") == "ab\tc"
    assert one(spark, X.normalize(c), t="  A　\u00a0b\n C ") == "a b c"
    assert one(spark, X.split_terms(c), t="a, b，c|d、 ;e") == ["a", "b", "c", "d", "e"]
    assert one(spark, X.source_file_name(c), t="C:\\x\\y/z.html") == "z.html"
    assert one(spark, X.split_visible_lines(c), t="a\n展开\n\nb") == ["a", "b"]
    assert one(spark, X.find_quote(c, F.lit("softlight for")), t="a Soft l\night".replace("S", "s") + " for x") == "soft l\night for"
    assert one(spark, X.find_quote(c, F.lit("none")), t="abc") is None
    assert one(spark, X.safe_rate(F.lit(1), F.lit(0))) == 0
    assert one(spark, X.input_hash(c, F.lit(None)), t="x") == one(spark, F.sha2(F.lit("x|"), 256))
    assert one(spark, X.json_lines(c), t='x\n {"a":1} \nb}') == ['{"a":1}']


@pytest.mark.parametrize(("text", "found"), [("豆 包", True), ("【豆 包】", True), ("豆·包", True), ("豆x包", False)])
def test_flexible_terms(spark, text, found):
    assert one(spark, X.term_matches(F.col("t"), "豆包"), t=text) is found


def test_latin_terms(spark):
    for text in ("Deep-Seek", "Deep Seek", "deepseek"):
        assert one(spark, X.term_matches(F.col("t"), "DeepSeek"), t=text)
    for text, found in (("chair pair rain", False), ("用AI查", True), ("AI好", True), ("A.I. x", True), ("xAIy", False), ("xAI推荐", True)):
        assert one(spark, X.latin_token(F.col("t"), "AI", ("用",), ("推荐",)), t=text) is found


@pytest.mark.parametrize(("text", "raw", "day"), [("于2026年7月3日", "2026年7月3日", "2026-07-03"), ("2026-2-30", "2026-2-30", ""), ("none", "", ""), ("2026/12/1x", "2026/12/1", "2026-12-01")])
def test_review_date(spark, text, raw, day):
    a, b = X.review_date(F.col("t"))
    assert (one(spark, a, t=text), one(spark, b, t=text)) == (raw, day)


def test_product_reference(spark):
    for text, want in (("复制 https://detail.tmall.com/item.htm?id=123456789 查看", ("tmall", "123456789")), ("https://item.taobao.com/item.htm?x=1&id=7。", ("taobao", "7")), ("nothing", ("", "")), ("https://evil.com/tmall.com?id=1", ("", ""))):
        a, b = X.product_reference(F.col("t"))
        assert (one(spark, a, t=text), one(spark, b, t=text)) == want


# Classification

SENTENCES = [
    ("question", "air和pro和max推荐哪个呢？", "D", False), ("review", "豆包和DeepSeek都给我推荐了这一款，没做攻略就直接下单了。", "A", True), ("review", "之前在ChatGPT里看到过这个牌子。", "A", True), ("review", "智能助手推荐的，买回来还可以。", "B", True),
    ("review", "AI搜索里看到这款评价不错。", "B", True), ("review", "选了很久，网上搜索对比了很多品牌型号，最终还是选择了这款。", "C", True), ("review", "趁着双十一活动，对比好多家最终买的这个，感谢客服推荐。", "C", True), ("review", "朋友推荐买的，用下来不错。", "D", False), ("review", "灯收到了，亮度可以调节，比较适合孩子们。", "", False),
]


def test_classifier(spark):
    df = spark.createDataFrame([(r, t, "") for r, t, *_ in SENTENCES], "content_role string, content_text_clean string, parent_text_clean string")
    got = {r.content_text_clean: r for r in classify.classify(df).collect()}
    for _, text, level, candidate in SENTENCES:
        assert (got[text].evidence_level, got[text].ai_candidate) == (level, candidate), text
    assert got[SENTENCES[6][1]].source_type == "mixed_research_and_customer_service"
    assert got[SENTENCES[8][1]].block_reason == "post_purchase_experience"
    assert got[SENTENCES[1][1]].ai_source_terms == ["DeepSeek", "豆包"] or set(got[SENTENCES[1][1]].ai_source_terms) == {"DeepSeek", "豆包"}


def test_block_reasons(spark):
    for text, want in (("包邮全额退，免费试用101天", "merchant_reply_like_text"), ("买完第二天降价，不给赔价保", "after_purchase_price_dispute"), ("比原来那个好用", "post_purchase_comparison"), ("买之前问了，收到了", "")):
        assert one(spark, classify.block_reason(F.col("t"), Lexicon()), t=text) == want


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("ai_sources: {strong: [a], generic: [b]}\nai_sources_specific: [c]\nai_actions: [d]\npurchase_context: [e]\ndecision_context: [f]\n", encoding="utf-8")
    x = load_lexicon(str(tmp_path / "l.yaml"))
    assert (x.specific, x.generic, x.actions) == (("c",), ("b",), ("d",))
    (tmp_path / "bad.yaml").write_text("ai_actions: [d]\n", encoding="utf-8")
    with pytest.raises(ValueError, match="decision_context"):
        load_lexicon(str(tmp_path / "bad.yaml"))


# Sentiment


def scorer(batches):
    import json

    import pandas as pd

    known = {"2": '{"i":2,"s":"M","sc":7,"p":"E","n":"S","c":3}', "3": '{"i":3,"s":"N","sc":2,"p":"-","n":"E","c":3}'}
    for x in batches:
        yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(known.get(json.loads(line)["i"], "") for line in p.split("\n")) for p in x["prompt"]]})


def test_sentiment_run(spark):
    df = spark.createDataFrame([(1, 1, "很好", ""), (2, 2, "亮度足，但是有点反光", ""), (3, 3, "太刺眼了，准备退货", ""), (4, 4, "no answer for this one, 不过", "")], "content_id int, seq int, content_text_clean string, product_title string")
    out = sentiment.process(df, scorer)
    assert rows(out["fast"], "content_id", "sentiment_label", "sentiment_score", "praise_code", "complaint_code", "confidence", "sentiment_source") == [(1, "P", 7, "-", "-", 2, "rule"), (2, "M", 7, "E", "S", 3, "llm_fast"), (3, "N", 2, "-", "E", 3, "llm_fast")]
    assert rows(out["failures"], "content_id", "error_type") == [(4, "MissingResult")]
    assert sentiment.process(df, None)["fast"].count() == 1


def test_scorer_failures_stay_with_their_batch(spark):
    """A scorer that raises for one row: all other rows are scored, down to its neighbours in the batch."""
    import pandas as pd

    def fails(batches):
        import json

        for x in batches:
            ids = [[json.loads(line)["i"] for line in p.split("\n")] for p in x["prompt"]]
            if any("7" in one for one in ids):
                raise ConnectionError
            yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(f'{{"i":"{i}","s":"P","sc":5,"p":"F","n":"-","c":2}}' for i in one if i != "9") for one in ids]})

    df = spark.range(40).select(F.col("id").alias("content_id"), F.col("id").alias("seq"), F.lit("t").alias("content_text_clean"), F.lit("p").alias("product_title"))
    found, failures, timings = sentiment.score(df, fails, 8)
    assert found.count() == 38 and rows(failures, "content_id", "error_type") == [(7, "ConnectionError"), (9, "MissingResult")]
    assert timings.where("error_type is null").count() > 0 and timings.where("turn = 3 and error_type = 'ConnectionError'").count() == 1
    assert sentiment.halves(50) == [50, 25, 12, 6, 3, 1] and sentiment.halves(1) == [1]


def test_detail_pass_and_summary(spark):
    df = spark.createDataFrame([(1, 1, "很好", ""), (2, 2, "亮度足，但是有点反光", ""), (3, 3, "太刺眼了，准备退货", "")], "content_id int, seq int, content_text_clean string, product_title string")

    def detail(batches):
        import json

        import pandas as pd

        for x in batches:
            yield pd.DataFrame({"batch_id": x["batch_id"], "response": ["\n".join(json.dumps({"i": json.loads(line)["i"], "e": "a", "r": "b", "g": "c"}) for line in p.split("\n")) for p in x["prompt"]]})

    out = sentiment.process(df, scorer, detail_scorer=detail, detail_limit=1)
    assert rows(out["detail"], "content_id", "e") == [(2, "a")]
    s = out["summary"].first()
    assert (s.total_count, s.rule_count, s.llm_fast_count, s.detail_count, s.failed_count, s.status) == (3, 1, 2, 1, 0, "success")
    assert {r.stage for r in out["timings"].collect()} == {"fast", "detail"}


def test_sentiment_batches_keep_everything(spark):
    df = spark.range(300).select(F.col("id").alias("content_id"), F.col("id").alias("seq"), F.lit("t").alias("content_text_clean"), F.lit("p").alias("product_title"))
    b = sentiment.prompts(sentiment.batched(df, 7))
    assert b.select(F.explode(F.split("prompt", "\n")).alias("l")).select(F.get_json_object("l", "$.i")).distinct().count() == 300
    assert b.select(F.max(F.size(F.split("prompt", "\n")))).first()[0] <= 7


def test_fast_rows_are_validated(spark):
    good = '{"i":"1","s":"P","sc":5,"p":"F","n":"-","c":2}'
    lines = [good, good.replace('"sc":5', '"sc":true'), good.replace('"sc":5', '"sc":11'), good.replace('"P"', '"Q"'), good.replace('"c":2', '"c":"2"'), "{bad json}"]
    responses = spark.createDataFrame([(str(i), x) for i, x in enumerate(lines)], "batch_id string, response string")
    assert sentiment.valid_fast(sentiment.parsed_lines(responses)).count() == 1


# Structured results

TEXT = "Soft light for homework, not harsh, but the base takes desk space."


def result_json(**changes):
    import json

    item = {"target": "product", "aspect": "a", "scene": "", "evidence_strength": "A", "notes": ""}
    r = {
        "review_id": "1", "valid_review": True, "overall_sentiment": "mixed", "main_target": "product", "purchase_decision_evidence": {"is_purchase_decision_evidence": True, "evidence_level": "A", "reason": ""},
        "praise_items": [{**item, "praise_family": "function", "praise_method": "scene_success", "evidence_quote": "Soft light for homework, not harsh", "business_value": "high"}],
        "complaint_items": [{**item, "complaint_family": "scene_fit", "complaint_method": "scene_mismatch", "evidence_quote": "the base takes desk space", "severity": "low", "fixability": "product_issue"}],
        "noise_flags": dict.fromkeys(audit.FLAGS, False), "one_sentence_summary": "x",
    }
    return json.dumps({**r, **changes})


def audited(spark, response):
    return audit.parse_results(spark.createDataFrame([(TEXT, response)], "text string, response string"))


def test_structured_result(spark):
    good = audit.derive(audited(spark, result_json())).withColumn("error", audit.first_error())
    r = good.first()
    assert (r.error, r.derived_sentiment, r.derived_target, r.derived_level, r.is_purchase_evidence) == ("", "mixed", "product", "A", True)
    assert audit.exploded(good, [], "praise").first().item_index == 1
    bad = audited(spark, result_json().replace("the base takes", "the lamp takes")).select(audit.first_error().alias("e")).first().e
    assert bad == "complaint_items.evidence_quote is not in the text"
    assert audited(spark, result_json(complaint_items=[])).transform(audit.derive).first().derived_level == "C"  # praise alone is capped
    assert audited(spark, "no json").select(audit.first_error().alias("e")).first().e != ""


# Metrics


def metric_rows(spark):
    data = [("p1", "商品一", "tmall", "review", "P", "", "A", "True", True), ("p1", "商品一", "taobao", "followup", "N", "", "D", "False", True), ("p2", "商品二", "jd", "review", "", "褒贬混合", "B", "true", True), ("p2", "商品二", "jd", "review", "Z", "", "C", "yes", True), ("p2", "商品二", "jd", "review", "", "", "", "False", False), ("p1", "商品一", "taobao", "question", "", "", "", None, None), ("p1", "商品一", "tmall", "answer", "", "", "", None, None)]
    return spark.createDataFrame(data, "item_key string, product_title string, platform string, content_role string, sentiment_label string, sentiment_label_cn string, evidence_level string, ai_candidate string, pre_purchase_decision boolean")


def test_brand_overview(spark):
    r = metrics.brand_overview(metric_rows(spark)).first()
    assert (r.total_content_count, r.review_count, r.question_count, r.answer_count, r.taobao_tmall_review_count, r.sentiment_unjudged_count, r.evidence_ungraded_count, r.ai_candidate_count) == (7, 5, 1, 1, 2, 1, 1, 3)


def test_product_comparison(spark):
    r = {x.item_key: x for x in metrics.product_comparison(metric_rows(spark)).collect()}
    assert (r["p1"].review_count, r["p1"].positive_count, r["p1"].negative_count, r["p1"].a_level_count, r["p1"].d_level_count) == (2, 1, 1, 1, 1)
    assert (r["p2"].review_count, r["p2"].mixed_count, r["p2"].neutral_count, r["p2"].ai_candidate_count, round(r["p2"].sentiment_coverage, 4)) == (3, 1, 1, 2, 0.6667)


def test_months(spark):
    df = spark.createDataFrame([("review", "2026-01-03", "", "", True, True, "A"), ("followup", "", "2026-01-18 10:00:00", "", False, False, ""), ("review", "", "", "2026-02-01", True, True, "C"), ("question", "2026-02-01", "", "", True, True, "")], "content_role string, content_date string, content_time string, review_date string, pre_purchase_decision boolean, ai_candidate boolean, evidence_level string")
    assert rows(metrics.summary_by_month(df, "tracker"), "review_month", "review_count", "ai_candidate_count", "a_level_count", "c_level_count") == [("2026-01", 2, 1, 1, 0), ("2026-02", 1, 1, 0, 1)]


def test_capture_quality(spark):
    def files(reviews_n, questions, answers):
        data = [("f", "t", "tmall", r) for r, n in (("review", reviews_n), ("question", questions), ("answer", answers)) for _ in range(n)]
        return spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "seq int, source_file string, product_title string, platform string, content_role string")

    assert [metrics.capture_quality(files(*n)).count() for n in ((2, 10, 10), (3, 20, 0), (2, 4, 4))] == [1, 0, 0]


def test_summary_overrides(spark):
    computed = spark.createDataFrame([(3, 2.0)], "total long, mean double")
    named = spark.createDataFrame([("total", "7"), ("mean", "n/a")], "metric string, value string")
    assert rows(metrics.summarize_sentiment(named, computed), "metric", "value") == [("mean", 2.0), ("total", 7.0)]


# Sales


def dated(spark):
    data = [("p1", "review", "2026-06-03", ""), ("p1", "review", "", "2026-06-20 12:00"), ("p1", "followup", "2026-06-25", ""), ("p1", "review", "2026-07-01", ""), ("p1", "review", "2026-07-08", ""), ("p1", "review", "2026-07-12", ""), ("p2", "review", "2026-07-15", ""), ("p2", "review", "", ""), ("p2", "question", "2026-07-16", "")]
    return spark.createDataFrame([(i, *x, "tmall") for i, x in enumerate(data)], "seq int, item_key string, content_role string, content_date string, content_time string, platform string")


def test_sales(spark):
    history = sales.sales_history(dated(spark))
    products = spark.createDataFrame([("p1", "tmall", "测试商品")], "item_key string, platform string, product_title_current string")
    named = sales.with_names(history, sales.product_metadata(products, dated(spark)))
    got = {(r.item_key, r.sales_month): r for r in named.collect()}
    assert (got["p1", "2026-06"].estimated_sales, got["p1", "2026-07"].estimated_sales, got["p1", "2026-07"].sales_change, got["p1", "2026-07"].trend) == (40, pytest.approx(60), pytest.approx(0.5), "销量上升")
    assert got["p1", "2026-07"].product_display_name == "[天猫] 测试商品"
    assert sum(r.review_count for r in got.values()) == 6
    c = sales.date_coverage(dated(spark)).first()
    assert (c.total_reviews, c.dated_reviews, c.undated_reviews, c.coverage) == (7, 6, 1, pytest.approx(6 / 7))
    assert sales.latest_progress(history).count() == 2
    for rate in (0, 1.5):
        with pytest.raises(ValueError, match="rate"):
            sales.sales_history(dated(spark), rate)


def test_catalog(spark):
    content = spark.createDataFrame([(1, "tmall:123456789", "review", "2026-07-03", "p"), (2, "tmall:123456789", "review", "2026-08-12", "p"), (3, "tmall:123456789", "review", "", "p"), (4, "tmall:123456789", "qa_question", "2026-08-20", "p")], "seq int, item_key string, content_role string, content_date string, project_id string")
    history = sales.sales_history(content).withColumn("project_id", F.lit("p"))
    products = spark.createDataFrame([("p", "tmall:123456789", "tmall", "123456789", 1)], "project_id string, item_key string, platform string, platform_product_id string, source_mtime int")
    cover = spark.createDataFrame([("p", "tmall:123456789", 2 / 3)], "project_id string, item_key string, coverage double")
    dates = spark.createDataFrame([("p", "tmall:123456789", "2026-08-31")], "project_id string, item_key string, data_date string")
    catalog = sales.build_catalog(products, history, cover, dates)
    r = catalog.first()
    assert (r.period, r.estimated_sales, r.review_count, r.data_date, r.review_rate, r.coverage_percent) == ("2026-08", 20, 1, "2026-08-31", 0.05, 66.7)
    asked = spark.createDataFrame([("tmall", "123456789"), ("taobao", "123456789"), ("tmall", "5")], "platform string, platform_product_id string")
    assert rows(sales.catalog_lookup(asked, catalog), "platform", "status") == [("taobao", "by_id"), ("tmall", "exact"), ("tmall", "not_found")]


# Identity and captures


def keyed(spark, texts, item="i"):
    df = spark.createDataFrame([(i, item, "", "review", t, "", "u", "2026-07-01", "s") for i, t in enumerate(texts)], "seq int, item_key string, platform_content_id string, content_role string, content_text_clean string, parent_text_clean string, user_name_masked string, content_time string, sku string")
    return identity.identity_keys(df)


def test_overlap(spark):
    r = identity.overlap_boundary(keyed(spark, "ABCDE"), keyed(spark, "XYZABC")).first()
    assert (r.status, r.overlap_length, r.new_prefix_end, r.confidence) == ("overlap_found", 3, 3, "high")
    assert identity.overlap_boundary(keyed(spark, "ABCDE"), keyed(spark, "XYAB")).first().status == "fallback"
    assert keyed(spark, "A").first().text_key != keyed(spark, "A", "j").first().text_key


def test_identity_methods(spark):
    df = spark.createDataFrame([("i", "N1", "review", "t", "", "", "", ""), ("i", "", "review", "t", "", "u", "2026", ""), ("i", "", "review", "t", "", "u", "", ""), ("i", "", "review", "t", "", None, None, None)], "item_key string, platform_content_id string, content_role string, content_text_clean string, parent_text_clean string, user_name_masked string, content_time string, sku string")
    assert [(r.identity_method, r.identity_confidence) for r in identity.identity_keys(df).collect()] == [("native_id", "high"), ("composite", "high"), ("composite", "medium"), ("low_confidence", "low")]


MASTER = "content_id string, project_id string, item_key string, identity_key string, strict_key string, composite_key string, text_key string, first_seen_snapshot_id string, first_seen_at string, last_seen_snapshot_id string, last_seen_at string, source_file_first string, source_file_last string, is_active boolean, seq int"
SNAPSHOTS = "project_id string, item_key string, snapshot_id string, file_hash string, capture_time string, imported_at string, source_file string, extracted_count string"


def capture(spark, texts, snapshot, day, file_hash):
    return keyed(spark, texts).withColumns({"project_id": F.lit("p"), "snapshot_id": F.lit(snapshot), "capture_time": F.lit(f"{day} 10:00:00"), "source_file": F.lit(f"{snapshot}.html"), "file_hash": F.lit(file_hash)})


def imported(spark, *captures, **kw):
    state = {"content_master": spark.createDataFrame([], MASTER), "snapshots": spark.createDataFrame([], SNAPSHOTS)}
    contents = None
    for c in captures:
        out = imports.import_batch(state, c, **kw)
        state = {k: spark.createDataFrame(out[k].collect(), out[k].schema) for k in ("content_master", "snapshots")}
        kept = c.join(state["snapshots"].select("snapshot_id"), "snapshot_id", "left_semi")
        contents = kept if contents is None else contents.unionByName(kept)
    return state, out, contents


def test_imports(spark):
    first, second = capture(spark, "ABCDE", "s1", "2026-07-01", "h1"), capture(spark, "XYZABC", "s2", "2026-07-02", "h2")
    state, out, _ = imported(spark, first)
    assert state["content_master"].count() == 5 and out["update_log"].first().new_count == 5
    state, out, _ = imported(spark, first, second)
    assert state["content_master"].count() == 8 and out["update_log"].first().new_count == 3
    assert state["content_master"].where("is_active").count() == 6
    again, out, _ = imported(spark, first, second, capture(spark, "XYZABC", "s3", "2026-07-03", "h2"))
    assert rows(out["rejects"], "status") == [("duplicate_file",)] and again["content_master"].count() == 8
    _, out, _ = imported(spark, second, first)
    assert rows(out["rejects"], "status") == [("rejected",)]
    late, _, _ = imported(spark, second, first, allow_backfill=True)
    assert late["content_master"].count() == 8 and late["content_master"].where("is_active").count() == 6


def test_import_of_two_captures_of_one_item(spark):
    """One batch with two captures leaves what two imports in turn do."""
    one, two, other = capture(spark, "ABC", "s1", "2026-07-01", "h1"), capture(spark, "ABCD", "s2", "2026-07-02", "h2"), capture(spark, "XY", "s9", "2026-07-01", "h9").withColumn("item_key", F.lit("other"))
    apart, _, _ = imported(spark, one, two)
    together, out, _ = imported(spark, two.unionByName(one))
    columns = ("content_id", "first_seen_snapshot_id", "last_seen_snapshot_id", "is_active")
    assert together["content_master"].count() == 4 and rows(together["content_master"], *columns) == rows(apart["content_master"], *columns)
    assert out["rejects"].count() == 0 and sorted(r.new_count for r in out["update_log"].collect()) == [1, 3]
    again, out, _ = imported(spark, one.unionByName(two).unionByName(two.withColumns({"snapshot_id": F.lit("s3"), "capture_time": F.lit("2026-07-03 10:00:00")})).unionByName(other))
    assert rows(out["rejects"], "snapshot_id", "status") == [("s3", "duplicate_file")] and again["content_master"].count() == 6


def test_deletion(spark):
    first, second = capture(spark, "ABCDE", "s1", "2026-07-01", "h1"), capture(spark, "XABCDE", "s2", "2026-07-02", "h2")
    state, _, contents = imported(spark, first, second)
    gone = lambda s: spark.createDataFrame([(s,)], "snapshot_id string")
    args = (state["content_master"], contents, state["snapshots"])
    after = snapshots.delete_from_master(*args, gone("s2"))
    assert after.count() == 5 and after.where("is_active").count() == 5
    assert snapshots.deletion_impact(*args, gone("s2")).first().removed_content_count == 1
    after = snapshots.delete_from_master(*args, gone("s1"))
    assert after.count() == 6 and rows(after.where("last_seen_snapshot_id = 's2'"), "first_seen_snapshot_id") == [("s2",)] * 6
    only, _, held = imported(spark, first)
    assert snapshots.delete_from_master(only["content_master"], held, only["snapshots"], gone("s1")).count() == 0
    with pytest.raises(ValueError, match="s2"):
        snapshots.check_deletion(state["snapshots"], contents.where("snapshot_id = 's1'"), gone("s1"))


def test_stale_items(spark):
    products = spark.createDataFrame([("old",), ("fresh",), ("missing",), ("edge",)], "item_key string")
    snaps = spark.createDataFrame([("old", "2026-07-01 10:00"), ("old", "2026-07-10 09:00"), ("fresh", "2026-08-01"), ("edge", "2026-07-28 10:00")], "item_key string, capture_time string")
    got = snapshots.stale_items(products, snaps, "2026-08-11 10:00:00").collect()
    assert [(r.item_key, r.days_since_update) for r in got] == [("missing", None), ("old", 32)]


# Joins, filters, tables


def test_joins_and_tables(spark):
    store = spark.createDataFrame([("a", 1)], "k string, seq int")
    assert rows(joins.add_unseen(store, spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), ("", 5)], "k string, seq int"), "k"), "k", "seq") == [("a", 1), ("b", 3)]
    assert rows(tables.next_index(store, spark.createDataFrame([("a", 9), ("c", 8)], "k string, o int"), ["k"], "seq", "o"), "k", "seq") == [("a", 2), ("c", 1)]
    assert filters.contains(store, "", ["k"]).count() == 1 and filters.contains(store, "A", ["k", "none"]).count() == 1


# Files


def test_review_files(spark, tmp_path):
    head = "platform,product_id ,product_title,user_name_masked,rating,review_time,sku,review_text_raw\n"
    body = "JD,13745188,百科全书,a***1,5,2026-07-20,65册,孩子很喜欢。\njd,100244103673,另一套图书,b***2,5,2026/07/21 x,套装,\"内容\n清晰\"\njd,,x,c,5,,,dropped\n"
    (tmp_path / "a.csv").write_bytes(("﻿" + head + body).encode("utf-8"))
    assert rows(reviews.read_reviews_csv(spark, str(tmp_path / "a.csv")), "platform", "product_id") == [("jd", "100244103673"), ("jd", "13745188")]
    (tmp_path / "b.csv").write_bytes((head + body).encode("gb18030"))
    got = reviews.read_reviews_any(spark, str(tmp_path))
    assert got.count() == 4 and reviews.review_inputs(got).count() == 2
    assert {r.product_count for r in reviews.file_identity(got, ("百科全书",)).collect()} == {2}
    assert rows(reviews.review_contents(got).distinct(), "content_date") == [("2026-07-20",), ("2026-07-21",)]
    (tmp_path / "c.csv").write_text("platform\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="product_id"):
        reviews.read_reviews_csv(spark, str(tmp_path / "c.csv"))


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a\x01", 1)], "t string, n int")
    assert reviews.sanitized(df).first().t == "a"
    path = reviews.save_version({"x": df}, str(tmp_path), 1, {"x": ["t"]})
    assert reviews.load_tables(spark, path, {"x": df.schema, "y": df.schema})["y"].count() == 0
    reviews.append(df, str(tmp_path / "log"))
    reviews.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        reviews.save_version({"x": df.union(df)}, str(tmp_path), 2, {"x": ["t"]})
    assert reviews.current_version(spark, str(tmp_path)) == 1 and reviews.current_version(spark, str(tmp_path / "none")) is None
    reviews.save_version({"x": df.union(df)}, str(tmp_path), 3)
    assert reviews.current_version(spark, str(tmp_path)) == 3
    console = reviews.console_frame(spark.createDataFrame([("x", "yes", "b")], "n string, f string, ai_influence_level string"), ("n", "m"), ("f",), ("t",)).first()
    assert (console.n, console.m, console.f, console.evidence_level) == (0, 0, True, "B")


def test_inputs_are_checked(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "big.html", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("index.html", "x" * 100_000)
    (tmp_path / "bad.html").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "ok.html").write_text("fine", encoding="utf-8")
    found = reviews.input_problems(reviews.archive_sizes(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1)), most_expanded=50_000)
    assert rows(found, "path", "reason") == [("bad.html", "broken archive"), ("big.html", "archive too large")]
    df = spark.createDataFrame([("f", 1, "jd", "1", "t", "", ""), ("f", 2, "jd", "2", "t", "", "")], "source_file string, seq int, platform string, product_id string, product_title string, shop_name string, product_url string")
    with pytest.raises(ValueError, match="more than one product"):
        reviews.one_product(df)
    assert reviews.one_product(df.limit(1)).first().product_count == 1 and reviews.require_rows(df).count() == 2
    with pytest.raises(ValueError, match="no reviews are left"):
        reviews.require_rows(df.limit(0))


def test_numbers_within_a_hot_key(spark):
    """Most rows have one key, some none: numbers are dense, and no range holds all of the key."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("k"))
    got = {}
    for r in tables.numbered(df, ["k"], "id").collect():
        got.setdefault(r.k, []).append((r.id, r.n))
    assert all([n for _, n in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values()) and len(got["hot"]) == 2400 and len(got[None]) == 300


def test_exports_of_older_batches(spark):
    images = spark.createDataFrame([("i1", "r1", "review", 1, "embedded"), ("i2", "r1", "append", 1, "missing"), ("i3", "r2", "review", 1, "embedded")], "image_id string, local_review_id string, image_stage string, image_index int, extract_status string")
    of = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "local_review_id string, product_key string")
    none, one = spark.createDataFrame([], "image_id string, was_new int"), spark.createDataFrame([("i1",)], "image_id string")
    pick = lambda df: rows(df, "image_id", "was_new")
    assert pick(assets.exported_images(spark.createDataFrame([("i3", 1)], none.schema), one, images, of, ["p1"], 5)) == [("i3", 1)]
    assert pick(assets.exported_images(none, one, images, of, ["p1"], 5)) == [("i1", 1), ("i2", 0)]  # more identified than changed: all of the products
    assert pick(assets.exported_images(none, one, images, of, ["p1"], 1)) == [("i1", 1)]
    out = assets.export_tables(assets.exported_images(none, one, images, of, ["p1"], 5), of, of.select("product_key"), one.select(F.lit("r1").alias("local_review_id")), found=7)
    assert {r.metric: r.value for r in out["summary"].collect()} == {"product_count": 2, "identified_review_count": 7, "new_review_count": 1, "review_with_image_count": 1, "identified_image_count": 2, "historical_image_count": 1, "new_review_image_count": 1, "new_append_image_count": 0, "exported_image_count": 1, "failed_image_count": 1, "warning_count": 1}
    assert rows(out["images"], "relative_path", "export_status") == [("images/p1/r1/i1", "success"), ("images/p1/r1/i2", "failed")]
    assert rows(assets.product_images(of, images), "image_id", "review_folder", "image_order") == [("i1", "products/p1/reviews/r1", 2), ("i2", "products/p1/reviews/r1", 1), ("i3", "products/p2/reviews/r2", 1)]


def test_pages(spark, tmp_path):
    html = '<link rel="canonical" href="https://detail.tmall.com/item.htm?id=42"><div class="review-item" data-comment-id="r1"><div class="review-content">很好的灯</div><span class="user-name">u1</span><span>2026-07-01</span><img src="data:image/png;base64,aGk="></div><div class="review-item"><p class="review-content">x</p></div>'
    (tmp_path / "p.html").write_text(html, encoding="utf-8")
    page = pages.read_pages(spark, str(tmp_path))
    r = page.select(pages.platform_of(F.col("html"), F.col("path")).alias("p"), pages.product_id(pages.product_url(F.col("html"))).alias("i"), "file_hash").first()
    assert (r.p, r.i) == ("tmall", "42") and len(r.file_hash) == 64
    nodes = pages.card_nodes(page, "path")
    got = pages.reviews_of_pages(nodes).collect()
    assert [(x.text, x.user, x.review_date, x.platform_review_id, x.image_count) for x in got] == [("很好的灯", "u1", "2026-07-01", "r1", 1)]
    assert rows(pages.images_of(nodes), "image_stage", "image_index", "extract_status") == [("review", 1, "embedded")]
    q, a = pages.question_pairs(F.col("t"))
    assert (one(spark, q, t="问：好用吗\n答：好用"), one(spark, a, t="问：好用吗\n答：好用")) == ("好用吗", "好用")
    (tmp_path / "q.html").write_bytes(b"PK\x03\x04 broken")
    read = {r.path[-6:]: r.html for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert read["q.html"] == "" and read["p.html"] == html


@pytest.mark.parametrize(("said", "platform"), [("Page saved with SingleFile\n url: https://item.jd.com/1.html", "jd"), ("京东商城", "jd"), ("问大家", "taobao"), ("问大家 天猫超市", "tmall"), ("", "unknown")])
def test_platform_is_told_by_the_whole_page(spark, said, platform):
    """What a page says far behind its beginning counts as well."""
    page = page_of(spark, "<p>" + "x" * 1_100_000 + f"</p>{said}", "saved/page.html")
    assert page.select(pages.platform_of(F.col("html"), F.col("path")).alias("p")).first().p == platform
    assert pages.page_identity(page).first().platform == platform


def page_of(spark, html, path="saved/灯具 - 天猫.html"):
    return spark.createDataFrame([(1, html, path)], "page_id int, html string, path string")


@pytest.mark.parametrize(("html", "want"), [
    ("<title>护眼灯 学习台灯 - 淘宝网 - 天猫</title>", ("护眼灯 学习台灯", "")), ("<title>商品评价</title>", ("灯具", "")), ('<title>x y</title><meta property="og:title" content="护眼台灯 京东">', ("护眼台灯", "")),
    ('<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "吸顶灯", "seller": {"name": "旗舰店"}, "brand": "B"}]}</script><title>页</title>', ("吸顶灯", "旗舰店")),
    ('<script type="application/ld+json">{"@type": "product", "name": "落地灯", "brand": {"name": "牌子"}}</script>', ("落地灯", "牌子")), ('<div class="x-ItemTitle-1"><b>床头</b> 灯</div><span class="a shopName">小店</span><title>别的</title>', ("床头 灯", "小店")),
    ('<div id="tbpcDetail_SkuPanelBody"><div><div><div><div><span title="天猫面板灯"></span></div></div></div></div></div><title>tmall.com 页面</title>', ("天猫面板灯", "")), ("<h1>用户评价 · 200+</h1><h1>筒灯 5W</h1>", ("灯具", "")),
])
def test_page_products(spark, html, want):
    r = pages.page_products(page_of(spark, html)).first()
    assert (r.product_title, r.shop_name) == want


def test_review_cards(spark):
    html = """<section class="comments"><div class="Comment--a1"><div class="userInfo--x"><span>u***1</span></div><div class="meta--z">2026年7月5日 已购：白色</div><div class="content--q">灯很亮，孩子喜欢</div><div class="append-text">用了一周还行</div><div class="shop-reply">谢谢</div><p>有用 12</p><p>4.5分</p><img src="x"><video></video></div>
        <div class="Comment--a1"><div>全部评价</div><div>123</div><div>没有标记的一条评价文字</div></div><div class="Comment--a1"><div class="userInfo--x"><span>u***1</span></div><div class="meta--z">2026年7月5日 已购：白色</div><div class="content--q">灯很亮，孩子喜欢</div></div><div class="Comment--a1">好评</div></section>"""
    got = pages.reviews_of_pages(pages.card_nodes(page_of(spark, html))).collect()
    assert [(r.text, r.user, r.sku, r.append_text, r.reply_text, r.review_date, r.rating, r.like_count, r.image_count, r.video_count) for r in sorted(got, key=lambda r: r.card)] == [
        ("灯很亮，孩子喜欢", "u***1", "白色", "用了一周还行", "谢谢", "2026-07-05", 4, 12, 1, 1), ("没有标记的一条评价文字", "", "", "", "", "", None, None, 0, 0)]


def test_questions_of_pages(spark):
    html = """<div class="conditionItem--1">亮度<span class="conditionItemCount--2">35</span></div><div class="conditionItem--1">价格</div>
        <div class="qaItem--1"><i class="questionIcon--2">问</i><span>这个亮吗</span><b class="initTag--3">已购</b><span>很亮</span><p>共 5 个回答</p></div><div class="qaItem--1"><i class="questionIcon--2">问</i><span>没人答的问题</span></div>
        <div class="qaItem--1">问：线有多长<br>答：一米五</div><div class="qaItem--1"><i class="questionIcon--2">问</i><span>这个亮吗</span><b class="initTag--3">已购</b><span>很亮</span></div>"""
    meta = lambda platform, marked: spark.createDataFrame([("1", platform, "9", marked)], "page string, platform string, product_id string, marked boolean")
    nodes = pages.card_nodes(page_of(spark, html), kind="question")
    got = sorted(pages.questions_of_pages(nodes, meta("tmall", False)).collect(), key=lambda r: r.card)
    assert [(r.question, r.answer, r.answer_count, r.is_buyer_answer, r.answer_user_status, r.confidence) for r in got] == [("这个亮吗", "很亮", 5, True, "已购", 0.9), ("没人答的问题", "", None, False, "", 0.55), ("线有多长", "一米五", None, False, "", 0.9)]
    assert got[0].question_tags == "亮度:35;价格"
    assert pages.questions_of_pages(nodes, meta("jd", False)).count() == 0 and pages.questions_of_pages(nodes, meta("jd", True)).count() == 3
    contents = pages.content_all_of(pages.contents_of(pages.reviews_of_pages(pages.card_nodes(page_of(spark, html))), pages.questions_of_pages(nodes, meta("tmall", False)))).orderBy("content_id").collect()
    assert [r.content_id for r in contents] == list(range(1, len(contents) + 1)) and len({r.content_hash for r in contents}) == len(contents)


def test_assets(spark):
    entities = spark.createDataFrame([("1", "now"), ("2", "now"), ("3", "now")], "entity_id string, state string")
    changes = spark.createDataFrame([(1, "b", "review", "1", "update", "old", "mid"), (2, "b", "review", "1", "update", "mid", "now"), (3, "b", "review", "2", "create", None, "now"), (4, "c", "review", "3", "update", "x", "now")], "change_id int, batch_id string, entity_type string, entity_id string, operation string, previous_state string, new_state string")
    assert rows(assets.undo(entities, changes, "b", "review"), "entity_id", "state") == [("1", "old"), ("3", "now")]
    batches = spark.createDataFrame([("b", 1, ["p"], "completed"), ("c", 2, ["p", "q"], "completed"), ("d", 3, ["z"], "completed")], "batch_id string, ordinal int, products array<string>, status string")
    assert rows(assets.undo_refused(batches, "b"), "reason") == [("later batch",)] and assets.undo_refused(batches, "d").count() == 0
    listed, files = spark.createDataFrame([("a",), ("../b",)], "path string"), spark.createDataFrame([("a",), ("c",)], "path string")
    assert rows(assets.manifest_problems(listed, files), "path", "problem") == [("../b", "unsafe path"), ("c", "unlisted file")]


# Streaming


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("platform,product_id,product_url,product_title,user_name_masked,rating,review_time,sku,review_text_raw\njd,1,,t,u,5,2026-07-20,s,good\n", encoding="utf-8")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        landing.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append((n, df.count()))).awaitTermination(60)
    assert seen == [(0, 1)]


def test_times(spark):
    df = spark.createDataFrame([("2026/06/03",), ("2026-06-04 10:00",), ("x",)], "t string")
    assert df.agg(X.latest_minute(F.col("t"))).first()[0] == "2026-06-04 10:00"
    assert df.select(X.parse_time(F.col("t")).alias("t")).collect()[0].t == datetime.datetime(2026, 6, 3)


def test_contents_parse_each_page_once_for_each_kind(spark):
    """Cards, their later additions and answers come from one pass over the pages for reviews and one for questions."""
    from loomfeed.plans.catalog import QUERIES

    plan = QUERIES["q_page_contents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2


def test_cases_of_a_level_stay_apart(spark):
    """The texts of a level are not brought into one task; levels without cases have their line, once."""
    df = spark.range(400).repartition(8).select(F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("evidence_level"), F.col("id").alias("match_score"), F.col("id").alias("seq"), *(F.lit("x").alias(c) for c in ("product_title", "platform", "content_role", "matched_keywords", "content_text_clean")))
    got = reviews.markdown_cases(df).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in got if r.level == "A"}) > 1 and len(got) == 401
    assert [(r.match_score, r.seq, r.text) for r in got if r.level == "C"] == [(None, None, "(none)")]


def test_observed_images_are_told_in_one_join(spark):
    """Whether an observed image is new comes with it: the observations are joined with the images alone."""
    store = spark.createDataFrame([("i1", "r1", "review", 1, "a"), ("i2", "r1", "review", 2, "b")], "image_id string, local_review_id string, image_stage string, image_index int, content_sha256 string")
    incoming = spark.createDataFrame([("r1", "review", "b", 1), ("r1", "review", "c", 2), ("r1", "review", "c", 3), ("r2", "append", "a", 4)], "local_review_id string, image_stage string, content_sha256 string, seq long")
    after, watched = assets.upsert_images(store, incoming, "b1")
    assert rows(after.withColumn("k", F.concat_ws(" ", "local_review_id", "image_stage", "content_sha256")), "k", "image_index") == [("r1 review a", 1), ("r1 review b", 2), ("r1 review c", 3), ("r2 append a", 1)]
    assert sorted((r.local_review_id, r.was_new) for r in watched.collect()) == [("r1", 0), ("r1", 1), ("r2", 1)]
    plan = watched._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan
