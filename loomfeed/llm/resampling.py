"""Importance resampling towards a target distribution (operator 11).

Words (or runs of words) are features, hashed into buckets.  A bucket's gain is the logarithm of how much more frequent it is in
the target than in the documents; an array of all gains scores a document: its weight is the mean gain of its features.  Weight
and a Gumbel variate, which hangs on the document's key alone, make its score, and the documents with the highest scores are a
draw without replacement.  They are ranked by a distributed radix sort over score and key (see radix).

Counts cover all documents.  What reaches the driver is a count for each bucket and, in the sort, for each value of a digit.

Defined cases: null or empty text has no feature and weight 0 and is not drawn; documents with fewer than `least_words` words are
not drawn; an empty target or an empty table gives gains all the same (every count is one more than it is); a null key counts as
an empty one in the hash and comes after all others among equal scores; rows with one key and one score stand next to each other
in any order; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, stage_table
from .radix import radix_ranks, unsigned

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD))


def buckets_of(words: Column, run: int = RUN, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to `run` consecutive words, repeats counted."""
    hashed = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: hashed(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, hashed), *map(runs, range(2, run + 1)))


def bucket_counts(texts: DataFrame, text: str, run: int, buckets: int) -> list[int]:
    """How many features each bucket holds."""
    features = texts.select(words_of(F.col(text)).alias("words")).select(F.explode(buckets_of(F.col("words"), run, buckets)).alias("bucket"))
    counts = [0] * buckets
    for bucket, n in features.groupBy("bucket").count().collect():  # a row for each bucket
        counts[bucket] = n
    return counts


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the ratio of frequencies), each count with one added."""
    s_all, t_all, n = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)]


def weights(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one array before it runs
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), run, len(gains)).alias("found"))
    total = F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    rows = rows.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.select("doc_id", "n_words", "n_features", mean.alias("weight"), (mean + gumbel).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text",
             target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null: not drawn) of every document."""
    gains = gains_of(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets))
    scored = stage_table(weights(docs, gains, key, text, run, seed), "weights")
    long_enough = F.col("n_words") >= least_words
    highest, count = scored.where(long_enough).agg(F.coalesce(F.max("score"), F.lit(0)), F.count("*")).first()
    keys = [unsigned(F.coalesce("doc_id", F.lit(0))), F.col("doc_id").isNull().cast("long"), F.lit(highest) - F.col("score")]
    ranked = radix_ranks(scored.where(long_enough), keys)
    rank = F.when(F.col("_at") < count * percent // 100, F.col("_at") + 1)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("_at").unionByName(rest)


def drawn(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that were drawn, with all their columns; rows with one key go together."""
    chosen = ranks.where("rank is not null").select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, F.col(key).cast("long").eqNullSafe(F.col("_chosen")), "left_semi")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
