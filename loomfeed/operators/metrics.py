"""Aggregates and metrics (AGG1 to AGG25, NUM1): one pass each, conditional counts in place of sub-selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DISPLAY_NAMES
from ..functions.text import parse_time, safe_rate, text_or_empty, truthy

LEVELS = ("A", "B", "C", "D")
LABELS = ("P", "N", "M", "Z")
KEYWORD_FIELDS = {"ai_source": "ai_source_terms", "ai_action": "ai_action_terms", "purchase_context": "purchase_context_terms", "decision_context": "decision_context_terms", "research": "research_terms", "algorithm": "algorithm_terms"}


def _n(c: Column, name: str) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False))).alias(name)


def _levels(column: str = "evidence_level", when: Column | None = None) -> list[Column]:
    up = F.upper(text_or_empty(F.col(column)))
    return [_n((up == x) if when is None else (up == x) & when, f"{x.lower()}_level_count") for x in LEVELS]


def sentiment_code(df: DataFrame) -> Column:
    """AGG12: the first of sentiment and sentiment_label that is not empty, else the code of the display name."""
    given = [F.nullif(F.upper(text_or_empty(F.col(c))), F.lit("")) for c in ("sentiment", "sentiment_label") if c in df.columns]
    names = [F.when(F.col("sentiment_label_cn") == name, code) for code, name in DISPLAY_NAMES.items()] if "sentiment_label_cn" in df.columns else []
    return F.coalesce(*given, *names, F.lit(""))


def top_terms(df: DataFrame, keys: list[str], terms: str, name: str, seq: str = "seq", k: int = 5) -> DataFrame:
    """AGG6: for each key the k most frequent terms as term:count, ties by first sight.

    Terms are counted before they are ranked, and a task passes on its k best of each key only, so that a key with very many
    terms is held by none.
    """
    counted = df.select(*keys, seq, F.posexplode(terms).alias("_p", "_t")).where("_t <> ''").groupBy(*keys, "_t").agg(F.count("*").alias("_c"), F.min(F.struct(seq, "_p")).alias("_first"))
    best = counted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_c"), "_first"))).where(F.col("_rank") <= k)
    listed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "_t", "_c"))).alias("l"))
    return listed.select(*keys, F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["_t"], x["_c"].cast("string"))), ";").alias(name))


def top_rows(df: DataFrame, keys: list[str], score: str, seq: str, k: int) -> DataFrame:
    """AGG7: for each key the k rows with the highest score, ties by seq."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), seq)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def summary_by_product(df: DataFrame, seq: str = "seq") -> DataFrame:
    """AGG1: counts, rates over rows before a purchase, top terms and top examples of each product."""
    keys = ["platform", "product_title", "shop_name", "product_id"]
    base = df.groupBy(*keys).agg(
        F.count_distinct("source_file").alias("source_file_count"), *(_n(F.col("content_role") == r, n) for r, n in (("review", "review_count"), ("question", "qa_question_count"), ("answer", "qa_answer_count"))),
        F.count_distinct("content_hash").alias("content_count"), _n(F.col("ai_candidate"), "ai_candidate_count"), *_levels(), _n(F.col("pre_purchase_decision"), "pre_purchase_decision_count"),
    )
    pre = F.col("pre_purchase_decision_count")
    base = base.withColumns({"a_b_count": F.col("a_level_count") + F.col("b_level_count"), "a_b_c_count": F.col("a_level_count") + F.col("b_level_count") + F.col("c_level_count"), "explicit_ai_rate": safe_rate(F.col("a_level_count"), pre), "generic_ai_rate": safe_rate(F.col("b_level_count"), pre), "inferred_ai_rate": safe_rate(F.col("c_level_count"), pre), "ai_candidate_rate": safe_rate(F.col("ai_candidate_count"), pre)})
    found = df.where("ai_candidate")
    examples = top_rows(found, keys, "match_score", seq, 3).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.substring("content_text_clean", 1, 100).alias("x")))), lambda e: e["x"]), " || ").alias("top_examples"))
    for side in (top_terms(found, keys, "ai_source_terms", "top_ai_source_terms", seq), top_terms(found, keys, "ai_action_terms", "top_ai_action_terms", seq), examples):
        base = base.join(side, keys, "left")
    return base.fillna("", ["top_ai_source_terms", "top_ai_action_terms", "top_examples"])


def summary_by_product_console(df: DataFrame) -> DataFrame:
    """AGG2: as AGG1, but rows count as contents and rates are over them."""
    base = df.groupBy("platform", "product_title", "shop_name", "product_id").agg(*(_n(F.col("content_role") == r, n) for r, n in (("review", "review_count"), ("question", "qa_question_count"), ("answer", "qa_answer_count"))), F.count("*").alias("content_count"), _n(F.col("ai_candidate"), "ai_candidate_count"), _n(F.col("pre_purchase_decision"), "pre_purchase_decision_count"), *_levels())
    return base.withColumns({"ai_candidate_rate": safe_rate(F.col("ai_candidate_count"), F.col("content_count")), "pre_purchase_rate": safe_rate(F.col("pre_purchase_decision_count"), F.col("content_count"))})


def summary_by_keyword(df: DataFrame, fields: dict[str, str] | None = None, seq: str = "seq") -> DataFrame:
    """AGG3: hits of each term of each type among candidates, and its first three distinct texts."""
    fields = fields or KEYWORD_FIELDS
    typed = F.explode(F.array(*(F.struct(F.lit(t).alias("keyword_type"), F.col(c).alias("terms")) for t, c in fields.items() if c in df.columns)))
    rows = df.where("ai_candidate").select(seq, "content_text_clean", typed.alias("k")).select(seq, "content_text_clean", "k.keyword_type", F.posexplode("k.terms").alias("_p", "keyword")).where("keyword <> ''")
    hits = rows.groupBy("keyword_type", "keyword").agg(F.count("*").alias("hit_count"), F.min(F.struct(seq, "_p")).alias("_first"))
    texts = rows.where("content_text_clean <> ''").groupBy("keyword_type", "keyword", "content_text_clean").agg(F.min(seq).alias("at"))
    w = Window.partitionBy("keyword_type", "keyword").orderBy("at")
    three = texts.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy("keyword_type", "keyword").agg(*(F.max(F.when(F.col("_r") == i, F.col("content_text_clean"))).alias(f"example_{i}") for i in (1, 2, 3)))
    return hits.join(three, ["keyword_type", "keyword"], "left").select("keyword_type", "keyword", "hit_count", *(text_or_empty(F.col(f"example_{i}")).alias(f"example_{i}") for i in (1, 2, 3)))


def summary_by_keyword_console(df: DataFrame, seq: str = "seq") -> DataFrame:
    """AGG4: of each matched keyword: hits, rows before a purchase, candidates, levels and the first text."""
    rows = df.select("*", F.explode("matched_keywords").alias("keyword"))
    out = rows.groupBy("keyword").agg(F.count("*").alias("hit_count"), _n(F.col("pre_purchase_decision"), "pre_purchase_decision_count"), _n(F.col("ai_candidate"), "ai_candidate_count"), *_levels(), F.min_by("content_text_clean", seq).alias("example"))
    return out.select("keyword", "hit_count", "pre_purchase_decision_count", "ai_candidate_count", F.format_string("A:%d / B:%d / C:%d / D:%d", *(f"{x.lower()}_level_count" for x in LEVELS)).alias("level_counts"), "example")


def summary_by_month(df: DataFrame, kind: str = "batch", seq: str = "seq") -> DataFrame:
    """AGG5: batch: reviews by the first seven characters of their date, levels among candidates, top terms; console: the
    same without terms; tracker: reviews and followups by the first date that reads as one, levels over all rows."""
    if kind == "tracker":
        rows = df.where(F.col("content_role").isin("review", "followup"))
        first = F.coalesce(*(F.nullif(F.trim(F.substring(text_or_empty(F.col(c)), 1, 10)), F.lit("")) for c in ("content_date", "review_date", "content_time")))
        rows = rows.withColumn("review_month", F.date_format(parse_time(first), "yyyy-MM")).where("review_month is not null")
        levels = _levels()
    else:
        rows = df.where("content_role = 'review'").withColumn("_d", F.trim(text_or_empty(F.col("review_date")))).where(F.length("_d") >= 7).withColumn("review_month", F.substring("_d", 1, 7))
        levels = _levels(when=F.coalesce(F.col("ai_candidate"), F.lit(False)))[:3]
    out = rows.groupBy("review_month").agg(F.count("*").alias("review_count"), _n(F.col("pre_purchase_decision"), "pre_purchase_decision_count"), _n(F.col("ai_candidate"), "ai_candidate_count"), *levels)
    out = out.withColumn("ai_candidate_rate", safe_rate(F.col("ai_candidate_count"), F.col("review_count")))
    if kind == "batch":
        out = out.join(top_terms(rows.where("ai_candidate"), ["review_month"], "ai_source_terms", "top_ai_source_terms", seq), "review_month", "left").fillna("", ["top_ai_source_terms"])
    return out


def evidence_levels(df: DataFrame) -> DataFrame:
    """AGG8: candidates by level."""
    return df.where("ai_candidate").groupBy("evidence_level").agg(F.count("*").alias("count"))


def brand_overview(df: DataFrame) -> DataFrame:
    """AGG9: one row of totals."""
    role, platform = text_or_empty(F.col("content_role")), F.lower(F.trim(text_or_empty(F.col("platform"))))
    review, two = role.isin("review", "followup"), platform.isin("taobao", "tmall")
    code, level = sentiment_code(df), F.upper(text_or_empty(F.col("evidence_level")))
    out = df.agg(
        F.count("*").alias("total_content_count"), _n(review, "review_count"), _n(role == "question", "question_count"), _n(role == "answer", "answer_count"),
        _n(review & two, "taobao_tmall_review_count"), _n((role == "question") & two, "taobao_tmall_question_count"), _n((role == "answer") & two, "taobao_tmall_answer_count"),
        *(_n(review & (code == x), f"sentiment_{x.lower()}") for x in LABELS), *(_n(review & (level == x), f"evidence_{x.lower()}") for x in LEVELS),
        _n(review & truthy(F.col("ai_candidate")), "ai_candidate_count"), _n(review & truthy(F.col("pre_purchase_decision")), "pre_purchase_count"),
    )
    judged, graded = (reduce(lambda a, b: a + b, [F.col(f"{p}_{x.lower()}") for x in xs]) for p, xs in (("sentiment", LABELS), ("evidence", LEVELS)))
    return out.withColumns({"sentiment_judged_count": judged, "sentiment_unjudged_count": F.greatest(F.col("review_count") - judged, F.lit(0)), "sentiment_coverage": safe_rate(judged, F.col("review_count")), "evidence_graded_count": graded, "evidence_ungraded_count": F.greatest(F.col("review_count") - graded, F.lit(0))})


def platform_counts(df: DataFrame, unmarked: str = "未标明来源") -> DataFrame:
    """AGG9: contents of each platform."""
    platform = F.lower(F.trim(text_or_empty(F.col("platform"))))
    return df.groupBy(F.when(platform == "", unmarked).otherwise(platform).alias("platform")).agg(F.count("*").alias("content_count"))


def product_comparison(df: DataFrame) -> DataFrame:
    """AGG10: of each item and title: reviews, questions, sentiments, levels and rates; most reviews first."""
    review, code, level = F.col("content_role").isin("review", "followup"), sentiment_code(df), F.upper(text_or_empty(F.col("evidence_level")))
    out = df.groupBy(text_or_empty(F.col("item_key")).alias("item_key"), text_or_empty(F.col("product_title")).alias("product_title")).agg(
        _n(review, "review_count"), _n(F.col("content_role") == "question", "question_count"), *(_n(review & (code == x), n) for x, n in zip(LABELS, ("positive_count", "negative_count", "mixed_count", "neutral_count"), strict=True)),
        _n(review & truthy(F.col("ai_candidate")), "ai_candidate_count"), *(_n(review & (level == x), f"{x.lower()}_level_count") for x in LEVELS),
    )
    judged = F.col("positive_count") + F.col("negative_count") + F.col("mixed_count") + F.col("neutral_count")
    return out.withColumns({"sentiment_coverage": safe_rate(judged, F.col("review_count")), "ai_candidate_rate": safe_rate(F.col("ai_candidate_count"), F.col("review_count"))}).orderBy(F.desc("review_count"), "product_title", "item_key")


def sentiment_metrics(fast: DataFrame, detail: DataFrame, failures: DataFrame) -> DataFrame:
    """AGG11: one row: counts, mean score (0 without any), sources, labels, distinct details and failures."""
    code, source = sentiment_code(fast), text_or_empty(F.col("sentiment_source"))
    a = fast.agg(F.count("*").alias("total_count"), F.coalesce(F.avg(F.col("sentiment_score").try_cast("double")), F.lit(0.0)).alias("average_score"), _n(source == "rule", "rule_count"), _n(source == "llm_fast", "llm_fast_count"), *(_n(code == x, f"sentiment_{x.lower()}") for x in LABELS))
    return a.select("*", detail.agg(F.count_distinct(text_or_empty(F.col("content_id")))).scalar().alias("detail_count"), failures.agg(F.count("*")).scalar().alias("failed_count"))


def summarize_content(df: DataFrame) -> DataFrame:
    """AGG13: totals over reviews alone (role review), products and platforms, and three rates."""
    review = F.col("content_role") == "review"
    some = lambda c: F.count_distinct(F.nullif(F.trim(text_or_empty(F.col(c))), F.lit("")))
    out = df.agg(F.count("*").alias("content_count"), _n(review, "review_count"), _n(F.col("content_role").isin("question", "qa_question"), "question_count"), _n(F.col("content_role").isin("answer", "qa_answer"), "answer_count"), some("product_title").alias("product_count"), some("platform").alias("platform_count"), _n(review & F.col("pre_purchase_decision"), "pre_purchase_count"), _n(review & F.col("ai_candidate"), "ai_candidate_count"), _n(review & (F.col("evidence_level") == "A"), "a_level_count"))
    return out.withColumns({"pre_purchase_rate": safe_rate(F.col("pre_purchase_count"), F.col("review_count")), "ai_candidate_rate": safe_rate(F.col("ai_candidate_count"), F.col("review_count")), "a_level_rate": safe_rate(F.col("a_level_count"), F.col("pre_purchase_count"))})


def summarize_sentiment(metrics: DataFrame, computed: DataFrame) -> DataFrame:
    """AGG14: a table of (metric, value) overrides computed counts (one row); what it does not name stays."""
    named = metrics.select("metric", F.col("value").try_cast("double").alias("value")).where("value is not null").groupBy("metric").agg(F.max("value").alias("override"))
    long = computed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in computed.columns))).alias("x")).select("x.*")
    return long.join(named, "metric", "left").select("metric", F.coalesce("override", "value").alias("value"))


def funnel(df: DataFrame) -> DataFrame:
    """AGG15: reviews, those before a purchase, candidates and level A, as four rows."""
    review = F.col("content_role").isin("review", "followup")
    t = df.agg(_n(review, "a"), _n(review & F.col("pre_purchase_decision"), "b"), _n(review & F.col("ai_candidate"), "c"), _n(review & (F.col("evidence_level") == "A"), "d"))
    return t.select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(c).alias("count")) for i, (n, c) in enumerate((("reviews", "a"), ("pre_purchase", "b"), ("candidates", "c"), ("level_a", "d")), 1)))).alias("x")).select("x.*")


def distribution(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """AGG16: counts of a fixed set of labels, those without rows included."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count"))
    return fixed.join(counts, "label", "left").fillna(0, ["count"])


def top_categories(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """AGG17: the k most frequent values that are not blank."""
    return df.where(F.trim(text_or_empty(F.col(column))) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def capture_quality(df: DataFrame, seq: str = "seq", most_reviews: int = 2, least_qa: int = 10) -> DataFrame:
    """AGG18: source files with few reviews and many questions and answers."""
    out = df.groupBy("source_file").agg(_n(F.col("content_role").isin("review", "followup"), "review_count"), _n(F.col("content_role").isin("question", "answer", "qa_question", "qa_answer"), "qa_count"), F.min_by("product_title", seq).alias("product_title"), F.min_by("platform", seq).alias("platform"))
    return out.where((F.col("review_count") <= most_reviews) & (F.col("qa_count") >= least_qa))


def maintenance_quality(snapshots: DataFrame, log: DataFrame, queue: DataFrame) -> DataFrame:
    """AGG19: snapshots, fallbacks, updates with warnings or failures, open questions."""
    a = snapshots.agg(F.count("*").alias("snapshot_count"), _n(F.col("boundary_status") == "fallback", "fallback_count"))
    results = [log.agg(_n(F.col("result") == x, "n")).scalar().alias(f"{x}_count") for x in ("warning", "failed")]
    return a.select("*", *results, queue.agg(_n(~truthy(F.col("resolved")), "n")).scalar().alias("unresolved_count"))


def run_summary_rows(df: DataFrame) -> DataFrame:
    """AGG20: (metric, label, value) rows of a sentiment run."""
    code = sentiment_code(df)
    t = df.agg(F.count("*").alias("total"), _n(F.col("sentiment_source") == "rule", "rule"), _n(F.col("sentiment_source") == "llm_fast", "llm_fast"), *(_n(code == x, x) for x in LABELS))
    rows = [("total_count", "", "total"), ("rule_count", "", "rule"), ("llm_fast_count", "", "llm_fast"), *(("label_count", x, x) for x in LABELS)]
    return t.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(x).alias("label"), F.col(c).alias("value")) for m, x, c in rows))).alias("r")).select("r.*")


def run_status(df: DataFrame, key: str = "batch_id") -> DataFrame:
    """AGG21: of each batch: files by result, and the whole state."""
    out = df.groupBy(key).agg(*(_n(F.col("status") == s, f"{s}_count") for s in ("success", "warning", "failed")))
    good = F.col("success_count") + F.col("warning_count")
    return out.withColumn("state", F.when(F.col("failed_count") == 0, F.when(F.col("warning_count") > 0, "warning").otherwise("success")).when(good > 0, "partial").otherwise("failed"))


def timing_totals(df: DataFrame, fields: list[str]) -> DataFrame:
    """AGG22: sums of timing fields; what is no number counts as 0."""
    return df.agg(*(F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0)).alias(f"total_{c}") for c in fields))


def common_failures(failures: DataFrame, k: int = 5) -> DataFrame:
    """AGG22: the k most frequent values of error_type and of error_message, most frequent first, then by value."""
    parts = []
    for field in ("error_type", "error_message"):
        counts = failures.groupBy(text_or_empty(F.col(field)).alias("value")).agg(F.count("*").alias("n"))
        parts.append(counts.orderBy(F.desc("n"), "value").limit(k).select(F.lit(field).alias("field"), "value", "n"))
    return parts[0].union(parts[1])


def pre_purchase_details(df: DataFrame) -> DataFrame:
    """AGG23."""
    return df.where(truthy(F.col("pre_purchase_decision")))


def candidate_order() -> list[Column]:
    """AGG24: levels A to D, then the rest; higher scores first; then the source file."""
    level = F.when(F.col("evidence_level") == "A", 0).when(F.col("evidence_level") == "B", 1).when(F.col("evidence_level") == "C", 2).when(F.col("evidence_level") == "D", 3).otherwise(4)
    return [level.asc(), F.desc("match_score"), F.asc("source_file")]


def headline(df: DataFrame) -> DataFrame:
    """AGG25: counts of the rows that a filter has left."""
    code = sentiment_code(df)
    low = (F.col("confidence") == 1) if "confidence" in df.columns else F.lit(False)
    return df.agg(F.count("*").alias("row_count"), *(_n(code == x, n) for x, n in (("P", "positive_count"), ("N", "negative_count"), ("M", "mixed_count"))), _n(truthy(F.col("ai_candidate")), "ai_count"), _n(low, "low_confidence_count"), _n(F.col("content_role").isin("review", "followup"), "review_count"), _n(F.col("content_role").isin("question", "answer"), "qa_count"))
