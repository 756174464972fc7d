"""Filters and projections (FLT1 to FLT17): all of them predicates that reach the scan where its format allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_terms, text_or_empty, truthy
from .metrics import sentiment_code


def facets(df: DataFrame, **wanted: list) -> DataFrame:
    """FLT1: columns within lists of values; an empty list does not filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(list(kv[1]))) if kv[1] else d, wanted.items(), df)


def contains(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """FLT2, FLT3: the query as a part of one of the columns, whatever the case; an empty query does not filter."""
    if not query.strip():
        return df
    q = query.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.lower(text_or_empty(F.col(c))).contains(q) for c in columns if c in df.columns], F.lit(False)))


def number_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """FLT4: what does not read as a number is 0."""
    return df.where(F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)).between(low, high))


def tri_state(df: DataFrame, column: str, choice: str) -> DataFrame:
    """FLT5: all, yes or no."""
    return df if choice == "all" else df.where(truthy(F.col(column)) if choice == "yes" else ~truthy(F.col(column)))


def with_term(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """FLT6: one of the terms is among a delimited column's; no terms do not filter."""
    return df.where(F.arrays_overlap(split_terms(F.col(column)), F.array(*map(F.lit, terms)))) if terms else df


def options(df: DataFrame, column: str) -> DataFrame:
    """FLT7: the distinct values that are not empty, in order."""
    value = F.trim(text_or_empty(F.col(column)))
    return df.select(value.alias("value")).where("value <> ''").distinct().orderBy("value")


def facet_counts(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """FLT1, FLT7, AGG25: (facet, value, n) of all facets at once, each under the filters of the others, as a screen of filters
    shows them.  wanted: the chosen values of each facet; none do not filter.  Blank values have no row.

    A row counts for every facet if it passes all filters, and for the one that it fails alone if it fails one; so one pass and
    one aggregate, combined before the shuffle, give what a query for each facet would.
    """
    passes = {c: F.coalesce(F.col(c).cast("string").isin([str(v) for v in values]), F.lit(False)) if values else F.lit(True) for c, values in wanted.items()}
    failed = reduce(lambda a, b: a + b, [(~p).cast("int") for p in passes.values()])
    counted = lambda p: (F.col("_failed") == 0) | ((F.col("_failed") == 1) & ~p)
    entries = F.array(*(F.when(counted(p), F.struct(F.lit(c).alias("facet"), F.trim(text_or_empty(F.col(c).cast("string"))).alias("value"))) for c, p in passes.items()))
    rows = df.withColumn("_failed", failed).where("_failed <= 1").select(F.inline(F.array_compact(entries)))
    return rows.where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def reviews_of(df: DataFrame, item: str = "", sentiment: str = "", level: str = "", query: str = "") -> DataFrame:
    """FLT8: reviews of an item by sentiment (code, or `unjudged`), level and text."""
    df = df.where(F.col("content_role").isin("review", "followup"))
    df = df.where(F.col("item_key") == item) if item else df
    code = sentiment_code(df)
    df = df.where(~code.isin("P", "N", "M", "Z") if sentiment == "unjudged" else code == sentiment) if sentiment else df
    df = df.where(F.upper(text_or_empty(F.col("evidence_level"))) == level) if level else df
    return contains(df, query, ["content_text_clean", "product_title", "user_name_masked"])


def pre_purchase(df: DataFrame, ai_only: bool = False) -> DataFrame:
    """FLT9: reviews and followups from before a purchase, or candidates alone."""
    df = df.where(F.col("content_role").isin("review", "followup") & truthy(F.col("pre_purchase_decision")))
    return df.where(truthy(F.col("ai_candidate"))) if ai_only else df


def by_sentiment(df: DataFrame, labels: list[str] = (), praise: list[str] = (), complaint: list[str] = (), low_confidence: bool = False, ai_only: bool = False) -> DataFrame:
    """FLT10."""
    df = facets(df, praise_code=praise, complaint_code=complaint)
    df = df.where(sentiment_code(df).isin(*labels)) if labels else df
    df = df.where(F.col("confidence") == 1) if low_confidence else df
    return df.where(truthy(F.col("ai_candidate"))) if ai_only else df


def browse(df: DataFrame, item: str = "", role: str = "", level: str = "", ai_only: bool = False, query: str = "") -> DataFrame:
    """FLT11."""
    df = facets(df, item_key=[item] if item else [], content_role=[role] if role else [], evidence_level=[level] if level else [])
    df = df.where(truthy(F.col("ai_candidate"))) if ai_only else df
    return contains(df, query, ["content_text_clean", "parent_text_clean", "product_title", "sku"])


def in_project(df: DataFrame, project: str) -> DataFrame:
    """FLT12: rows of a project (a partition where the table is laid out by it); the whole table if it has no projects."""
    return df.where(F.col("project_id") == project) if "project_id" in df.columns else df


def capture_risk(df: DataFrame) -> DataFrame:
    """FLT14: pages that claim more than twice the reviews that were saved."""
    n = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return df.where(n("declared_count") > 2 * n("saved_count"))


def detail_of(df: DataFrame, column: str, value: str, seq: str = "seq") -> DataFrame:
    """FLT15: the first row with an id."""
    return df.where(F.col(column) == value).orderBy(seq).limit(1)


def analysis_targets(df: DataFrame, roles: tuple[str, ...] = ("review", "followup"), seq: str = "seq", first: int | None = None) -> DataFrame:
    """FLT16: rows with text of the roles, the first ones by seq if a number is asked for."""
    df = df.where(F.trim(text_or_empty(F.col("content_text_clean"))) != "")
    df = df.where(F.col("content_role").isin(*roles)) if roles else df
    return df.orderBy(seq).limit(first) if first else df


def project_columns(df: DataFrame, wish: dict[str, str] | list[str]) -> DataFrame:
    """FLT17: those of the wished columns that there are, renamed if the wish says so."""
    names = wish if isinstance(wish, dict) else {c: c for c in wish}
    return df.select(*(F.col(c).alias(n) for c, n in names.items() if c in df.columns))


def predicate(*parts: Column) -> Column:
    """All of the parts; null counts as false."""
    return reduce(lambda a, b: a & b, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(True))
