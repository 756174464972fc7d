"""Sales estimates from dated reviews (SAL1 to SAL5) and the catalog of them (CAT1, CAT2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time, safe_rate, text_or_empty

# Names of platforms, and words for trends.
PLATFORM_NAMES = {"tmall": "天猫", "taobao": "淘宝", "jd": "京东"}
TRENDS = ("首个有数据月份", "销量上升", "销量下降", "销量持平")


def _is_review() -> Column:
    return F.lower(text_or_empty(F.col("content_role"))) == "review"


def dated_reviews(content: DataFrame) -> DataFrame:
    """SAL1: primary reviews with an item and a date, and their month."""
    dates = [F.col(c) for c in ("content_date", "content_time", "review_date") if c in content.columns]
    rows = content.where(_is_review() & (text_or_empty(F.col("item_key")) != ""))
    return rows.withColumn("sales_month", F.date_format(parse_time(*dates), "yyyy-MM")).where("sales_month is not null")


def product_metadata(products: DataFrame, content: DataFrame, seq: str = "seq") -> DataFrame:
    """JN15: title and platform of each item: from products (the last row of each), else the last platform of its contents."""
    c = content.where(text_or_empty(F.col("item_key")) != "").groupBy("item_key").agg(F.max_by(F.nullif(text_or_empty(F.col("platform")), F.lit("")), F.when(text_or_empty(F.col("platform")) != "", F.col(seq))).alias("content_platform"))
    p = products.where(text_or_empty(F.col("item_key")) != "").groupBy("item_key").agg(F.max_by(F.struct("platform", "product_title_current"), F.col(seq) if seq in products.columns else F.struct("product_title_current", "platform")).alias("p"))
    both = c.join(p, "item_key", "full_outer")
    platform = F.coalesce(F.nullif(text_or_empty(F.col("p.platform")), F.lit("")), F.col("content_platform"), F.when(F.col("item_key").contains(":"), F.split_part("item_key", F.lit(":"), F.lit(1))), F.lit(""))
    return both.select("item_key", text_or_empty(F.col("p.product_title_current")).alias("product_title"), platform.alias("platform"))


def display_name() -> Column:
    """SAL3: the platform's name in brackets before the title, or before the key."""
    name = F.col("platform")
    for code, text in PLATFORM_NAMES.items():
        name = F.when(F.col("platform") == code, text).otherwise(name)
    title = F.when(F.trim("product_title") != "", F.col("product_title")).otherwise(F.col("item_key"))
    return F.when(F.col("platform") == "", title).otherwise(F.concat(F.lit("["), name, F.lit("] "), title))


def sales_history(content: DataFrame, rate: float = 0.05) -> DataFrame:
    """SAL2 (WIN1, WIN2): reviews of each item and month, the estimate, the month with data before it, change and trend."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be over 0 and at most 1")
    months = dated_reviews(content).groupBy("item_key", "sales_month").agg(F.count("*").alias("review_count"))
    months = months.withColumn("estimated_sales", F.col("review_count").cast("double") / F.lit(rate))
    w = Window.partitionBy("item_key").orderBy("sales_month")
    months = months.withColumn("previous_estimated_sales", F.lag("estimated_sales").over(w))
    change = (F.col("estimated_sales") - F.col("previous_estimated_sales")) / F.col("previous_estimated_sales")
    first, up, down, same = TRENDS
    return months.withColumn("sales_change", change).withColumn("trend", F.when(F.col("previous_estimated_sales").isNull(), first).when(F.col("sales_change") > 0, up).when(F.col("sales_change") < 0, down).otherwise(same))


def with_names(history: DataFrame, metadata: DataFrame) -> DataFrame:
    out = history.join(metadata, "item_key", "left").fillna("", ["product_title", "platform"])
    return out.withColumn("product_display_name", display_name())


def latest_progress(history: DataFrame) -> DataFrame:
    """SAL4 (WIN3): the last month of each item, the largest estimates first."""
    row = F.struct(*(c for c in history.columns if c != "item_key"))
    return history.groupBy("item_key").agg(F.max_by(row, "sales_month").alias("r")).select("item_key", "r.*").orderBy(F.desc("estimated_sales"), "item_key")


def period_total(history: DataFrame) -> DataFrame:
    """SAL4: totals over all items of the latest month there is."""
    return history.groupBy("sales_month").agg(F.sum("review_count").alias("review_count"), F.sum("estimated_sales").alias("estimated_sales"), F.count("*").alias("item_count")).orderBy(F.desc("sales_month")).limit(1)


def date_coverage(content: DataFrame) -> DataFrame:
    """SAL5."""
    total = content.agg(F.count_if(_is_review()).alias("total_reviews"))
    both = total.select("*", dated_reviews(content).agg(F.count("*")).scalar().alias("dated_reviews"))
    return both.withColumns({"undated_reviews": F.greatest(F.col("total_reviews") - F.col("dated_reviews"), F.lit(0)), "coverage": safe_rate(F.col("dated_reviews"), F.col("total_reviews"))})


def build_catalog(products: DataFrame, history: DataFrame, coverage: DataFrame, dates: DataFrame, rate: float = 0.05) -> DataFrame:
    """CAT1: of each platform and item the record of the project with the latest data (then the latest source).

    products: project_id, item_key, platform, platform_product_id, source_mtime; history, coverage and dates carry project_id.
    """
    latest = history.groupBy("project_id", "item_key").agg(F.max_by(F.struct("sales_month", "estimated_sales", "review_count"), "sales_month").alias("h"))
    rows = products.where(F.col("platform").isin("taobao", "tmall") & F.col("platform_product_id").rlike(r"^\d+$"))
    rows = rows.join(latest, ["project_id", "item_key"]).join(coverage, ["project_id", "item_key"], "left").join(dates, ["project_id", "item_key"], "left")
    record = F.struct("project_id", "item_key", F.col("h.sales_month").alias("period"), F.bround("h.estimated_sales").cast("long").alias("estimated_sales"), F.col("h.review_count").alias("review_count"), F.lit(rate).alias("review_rate"), F.round(100 * F.coalesce("coverage", F.lit(0.0)), 1).alias("coverage_percent"), "data_date")
    best = rows.groupBy("platform", "platform_product_id").agg(F.max_by(record, F.struct("data_date", "source_mtime", "project_id")).alias("r"))
    return best.select("platform", "platform_product_id", "r.*")


def valid_record() -> Column:
    """CAT2: counts not negative, rate in (0, 1], coverage in 0 to 100."""
    return F.coalesce((F.col("estimated_sales") >= 0) & (F.col("review_count") >= 0) & (F.col("review_rate") > 0) & (F.col("review_rate") <= 1) & F.col("coverage_percent").between(0, 100), F.lit(False))


def catalog_lookup(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """JN16, CAT2: queries (platform, platform_product_id) with the record of both, else of the id alone if it is unique."""
    c = catalog.withColumn("valid", valid_record())
    fields = [x for x in c.columns if x not in ("platform", "platform_product_id")]
    record = F.struct("platform", *fields)
    exact = c.select("platform", "platform_product_id", record.alias("_exact"))
    alone = c.groupBy("platform_product_id").agg(F.count("*").alias("_n"), F.any_value(record).alias("_alone")).where("_n = 1").drop("_n")
    out = queries.join(exact, ["platform", "platform_product_id"], "left").join(alone, "platform_product_id", "left")
    out = out.withColumn("_r", F.coalesce("_exact", "_alone"))
    status = F.when(F.col("_r").isNull(), "not_found").when(~F.col("_r.valid"), "invalid").when(F.col("_exact").isNotNull(), "exact").otherwise("by_id")
    return out.select(*queries.columns, status.alias("status"), F.col("_r.platform").alias("found_platform"), *(F.col(f"_r.{x}").alias(x) for x in fields if x != "valid"))
