"""Windows, sorts, limits and set operations on whole tables (WIN5 to WIN7, SRT1, LIM1, SET1 to SET4, SRC9, SRC12)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time, text_or_empty
from ..lineage import kept


def numbered(df: DataFrame, keys: list[str], *order: str | Column, name: str = "n", keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """WIN6: 1, 2, ... within each key (null is one too).  Rows are sorted in ranges of key and order and numbered within each; what
    the ranges before hold of a key is added, so that a key of very many rows is in no task as a whole.  keep makes the ranges
    once; order must leave no ties."""
    ranges = keep(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range", *keys).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range of a key
    starts = counts.select("_range", *(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = ranges.withColumn(name, F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))).withColumnRenamed("_range", "_own")
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_own") == F.col("_range"))
    return inside.join(starts, same).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).select(*(c for c in df.columns if c != name), name)


def next_index(existing: DataFrame, fresh: DataFrame, keys: list[str], index: str, *order: str) -> DataFrame:
    """WIN7: fresh rows numbered behind the greatest index of their key."""
    top = existing.groupBy(*keys).agg(F.max(index).alias("_top"))
    out = numbered(fresh, keys, *order, name="_n").join(top, keys, "left")
    return out.withColumn(index, F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_top", "_n")


def union_labelled(tables: dict[str, DataFrame], label: str = "workbook_source") -> DataFrame:
    """SRC9, SET1: all rows with the name of their table; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(label, F.lit(name)) for name, df in tables.items()))


def replace_partition(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """SET2: rows outside the keys of fresh, and fresh."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def difference(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SET3."""
    return table.join(gone.select(*keys), keys, "left_anti")


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """SET4."""
    return df.select(*columns).distinct()


def top(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """LIM1: Spark keeps k rows a task and merges them; nothing is sorted whole."""
    return df.orderBy(*order).limit(k)


def recent_first(df: DataFrame, *times: str) -> DataFrame:
    """SRT1: by times as they are read, the latest first; rows whose times do not read come last."""
    return df.orderBy(*(F.desc_nulls_last(parse_time(F.col(t))) for t in times))


def largest_first(df: DataFrame, count: str = "review_count", title: str = "product_title") -> DataFrame:
    """SRT1: by count, the largest first, equal ones by title."""
    return df.orderBy(F.desc_nulls_last(count), title)


def stalest_first(df: DataFrame, latest: str = "latest", key: str = "item_key") -> DataFrame:
    """SRT1: those never seen first, then by their latest time."""
    return df.orderBy(F.asc_nulls_first(latest), key)


def project_summary(content: DataFrame) -> DataFrame:
    """SRC12: distinct shops and products (titles where ids are missing), reviews, and questions with answers."""
    some = lambda c: F.nullif(F.trim(text_or_empty(F.col(c))), F.lit(""))
    return content.agg(F.count_distinct(some("shop_name")).alias("shop_count"), F.count_distinct(F.coalesce(some("product_id"), some("product_title"))).alias("product_count"), F.count_if(F.col("content_role").isin("review", "followup")).alias("review_count"), F.count_if(F.col("content_role").isin("question", "answer")).alias("qa_count"))
