"""Joins of contents with what is known of them (JN1 to JN18).  Right sides are reduced to one row a key before they join, by
aggregates that combine before the shuffle; AQE broadcasts those that turn out small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, text_or_empty
from .identity import keep_first


def _one(df: DataFrame, key: str, seq: str, last: bool) -> DataFrame:
    return keep_first(df, [key], seq, last)


def content_analysis(content: DataFrame, analysis: DataFrame) -> DataFrame:
    """JN1: columns that both have come from the left, those of the analysis with the suffix _analysis."""
    right = analysis.select("content_id", *(F.col(c).alias(f"{c}_analysis" if c in content.columns else c) for c in analysis.columns if c != "content_id"))
    return content.join(right, "content_id", "left")


def content_products(content: DataFrame, products: DataFrame) -> DataFrame:
    """JN2."""
    return content.join(products.select("item_key", "product_title_current", "shop_name_current"), "item_key", "left")


def scores_content_detail(fast: DataFrame, content: DataFrame, detail: DataFrame, seq: str = "seq") -> DataFrame:
    """JN3: scores with their contents and details, of several the first by seq."""
    c, d = _one(content, "content_id", seq, False), _one(detail, "content_id", seq, False)
    extra = lambda df, have: df.select("content_id", *(x for x in df.columns if x not in have))
    out = fast.join(extra(c, fast.columns), "content_id", "left")
    return out.join(extra(d, out.columns), "content_id", "left")


def enriched_by_sentiment(content: DataFrame, fast: DataFrame, seq: str = "seq") -> DataFrame:
    """JN4: only columns that the content lacks."""
    f = _one(fast, "content_id", seq, False)
    return content.join(f.select("content_id", *(c for c in f.columns if c not in content.columns)), "content_id", "left")


def fill_blank_scores(content: DataFrame, fast: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """JN5: the last score fills what is null or blank, and nothing else."""
    f = _one(fast.select("content_id", seq, *columns), "content_id", seq, True).select("content_id", *(F.col(c).alias(f"_{c}") for c in columns))
    out = content.join(f, "content_id", "left")
    return out.withColumns({c: F.coalesce(blank_to_null(F.col(c)) if c in content.columns else F.lit(None), F.col(f"_{c}"), F.lit("")) for c in columns}).drop(*(f"_{c}" for c in columns))


def high_value(content: DataFrame, detail: DataFrame, seq: str = "seq") -> DataFrame:
    """JN6: contents with a detail, the last of each."""
    d = _one(detail, "content_id", seq, True)
    return content.join(d.select("content_id", *(c for c in d.columns if c not in content.columns)), "content_id")


def unscored(content: DataFrame, fast: DataFrame) -> DataFrame:
    """JN8: contents without a valid label."""
    return content.join(fast.where(F.upper(text_or_empty(F.col("sentiment_label"))).isin("P", "N", "M", "Z")).select("content_id"), "content_id", "left_anti")


def update_analysis(analysis: DataFrame, fast: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """JN10: the last score overwrites columns of the analysis, where there is one."""
    f = _one(fast.select("content_id", seq, *columns), "content_id", seq, True).select("content_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = analysis.join(f, "content_id", "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in analysis.columns else F.lit(None)) for c in columns}).drop("_hit", *(f"_{c}" for c in columns))


def add_unseen(store: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """JN17: the store and the first of each incoming row whose key it lacks; blank keys are skipped."""
    fresh = incoming.where(F.trim(text_or_empty(F.col(key))) != "").join(store.select(key), key, "left_anti")
    return store.unionByName(_one(fresh, key, seq, False).select(*store.columns))
