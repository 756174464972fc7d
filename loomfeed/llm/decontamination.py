"""Benchmark decontamination by spaced seeds (operator 9), in DataFrame functions alone.

A seed is a window of words of which a fixed mask keeps some, so a hit survives a substitution in the places that the mask
leaves out.  Seeds of the benchmark items join seeds of the documents; each hit fixes how item and document lie on each other.
Along that alignment words are compared: stretches without GAP mismatches in a row are the candidates, and a document leaks an
item where some part of one has at least LEAST equal words (or all words of a shorter item) and SHARE of its words are equal.
Every such part holds one of the masks (tests try all patterns), so no leak goes without a hit.

The seeds of the benchmark are broadcast up to SEEDS of them; beyond, both sides are shuffled by seed.  There a seed in more than
CROWD places of items, as of a phrase that many items share, is dealt out over salts: each salt has about CROWD of the places, and
a document's seed is sent to all of them, so that no task joins the whole crowd.

Defined cases: words are runs of ASCII letters and digits and of other characters beyond ASCII, in lower case; null and empty
texts leak nothing, and items without words are in no document; documents are judged by id, so that equal ids share a verdict
(null is an id too); items of equal words are one item, named by the least id; an empty benchmark keeps every document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage_table

#: Places that each mask keeps, from 0; five of at most ten words.  Each accepted pattern of equal words holds one of them.
MASKS = ((0, 1, 2, 4, 5), (0, 3, 5, 6, 7), (0, 1, 2, 6, 8), (0, 1, 2, 3, 4))
#: Items of fewer words are sought as they are.
SPAN = 10
LEAST, SHARE, GAP = 12, 0.75, 3
#: Seeds that may be broadcast (about 40 bytes each).
SEEDS = 1_000_000
#: Places of items with one seed that one task joins.
CROWD = 256


def words_of(text) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """A row for each position and mask: keep, pos, seed.  Windows that reach beyond the words have no seed."""
    n = F.size("words")
    shortest = min(max(m) for m in masks) + 1
    placed = rows.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.greatest(n - shortest, F.lit(0)))).alias("pos"))
    seeds = [F.when(F.col("pos") + max(m) < n, F.xxhash64(F.lit(len(m) * 64 + i), *(F.get("words", F.col("pos") + k) for k in m))) for i, m in enumerate(masks)]
    return placed.select(*keep, "words", "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _best_part(flags, equal, least) -> F.Column:
    """The most equal words of a part of a stretch (1: equal) in which SHARE of the words are equal; null if there is none.  With
    the n-th equal word, from 0, in place p, u = SHARE * p - n; a part from one equal word to another is good where u grows by
    1 - SHARE at most."""
    places = F.filter(F.transform(F.split(flags, ""), lambda c, i: F.when(c == "1", i)), lambda i: i.isNotNull())
    u = F.transform(places, lambda p, n: SHARE * p - n)
    parts = F.transform(u, lambda x, i: F.size(u) - i - F.array_position(F.transform(F.reverse(F.slice(u, i + 1, F.size(u) - i)), lambda y: y <= x + (1 - SHARE)), F.lit(True)).cast("int") + 1)
    return F.when(equal >= SHARE * F.length(flags), equal).when(equal >= least, F.array_max(parts))


def _verified(aligned: DataFrame) -> DataFrame:
    """Of rows with item_id, item_words, at (the item's place in the document), segment (the document's words there) and hits.
    n_words is null where no overlap is good enough."""
    own = F.slice("item_words", F.greatest(-F.col("at"), F.lit(0)) + 1, F.size("segment"))
    flags = F.array_join(F.zip_with("segment", own, lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0"))), "")
    overlaps = F.transform(F.split(flags, "0{%d,}" % GAP), lambda s: F.regexp_replace(s, "^0+|0+$", ""))
    equal = lambda s: F.length(F.replace(s, F.lit("0"), F.lit("")))
    least = F.least(F.lit(LEAST), F.size("item_words"))
    best = F.transform(F.filter(overlaps, lambda s: equal(s) >= least), lambda s: _best_part(s, equal(s), least))
    return aligned.select("doc_id", "item_id", "hits", F.array_max(F.filter(best, lambda n: n >= least)).alias("n_words"))


def _met(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """found (with seed) joined with seeds by seed, crowds dealt out over salts."""
    crowds = seeds.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("seed", F.ceil(F.col("n") / CROWD).cast("int").alias("salts"))
    crowds = stage_table(crowds, "crowds")
    known = F.broadcast(crowds) if crowds.count() <= SEEDS else crowds
    salts = F.coalesce("salts", F.lit(1))
    own = seeds.join(known, "seed", "left").select(*seeds.columns, F.pmod(F.xxhash64("item_id", "item_pos"), salts).cast("int").alias("salt"))
    asked = found.join(known, "seed", "left").select(*found.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return asked.join(own, ["seed", "salt"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, the most equal words of an overlap and the seeds that hit, for each document and item that it leaks."""
    items = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0)
    items = stage_table(items.groupBy("item_words").agg(F.min("item_id").alias("item_id")), "items")
    short = [n for (n,) in items.where(F.size("item_words") < SPAN).select(F.size("item_words")).distinct().collect()]  # SPAN at most
    masks = [*MASKS, *(tuple(range(n)) for n in sorted(short))]
    long_seeds = _seeds(items.where(F.size("item_words") >= SPAN).withColumn("words", F.col("item_words")), masks, ["item_id"])
    short_seeds = [_seeds(items.where(F.size("item_words") == n).withColumn("words", F.col("item_words")), masks, ["item_id"]) for n in short]
    seeds = stage_table(reduce(DataFrame.unionByName, [long_seeds, *short_seeds]).select("seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "seeds")
    rows = docs.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))
    at = (F.col("pos") - F.col("item_pos")).alias("at")
    n_item = F.size("item_words")
    segment = F.slice("words", F.greatest("at", F.lit(0)) + 1, F.greatest(F.least(F.size("words") - F.greatest("at", F.lit(0)), n_item + F.least("at", F.lit(0))), F.lit(0))).alias("segment")
    if seeds.count() <= SEEDS:
        found = _seeds(rows, masks, ["doc_id"]).join(F.broadcast(seeds), "seed").select("doc_id", "words", "item_id", at)
        aligned = found.join(F.broadcast(items), "item_id").select("doc_id", "item_id", "at", "item_words", segment).groupBy("doc_id", "item_id", "at", "item_words", "segment").agg(F.count("*").alias("hits"))
    else:
        found = _met(_seeds(rows, masks, ["doc_id"]).select("doc_id", "pos", "seed"), seeds).select("doc_id", "item_id", at).groupBy("doc_id", "item_id", "at").agg(F.count("*").alias("hits"))
        aligned = found.join(items, "item_id").join(rows.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id"))).select("doc_id", "item_id", "at", "item_words", segment, "hits")
    return _verified(aligned).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.sum("hits").alias("hits")).where("n_words is not null")


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept, the leaked items (ids of items of equal words: the least) and the most equal words, for each row."""
    found = leaks(docs, benchmark, key, text).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("n_words").alias("most_words"))
    ids = docs.select(F.col(key).alias("doc_id"))
    joined = ids.join(found.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    return joined.select("doc_id", F.col("items").isNull().alias("kept"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.array_join(F.coalesce("items", F.array()), ",").alias("items"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak an item."""
    gone = leaks(docs, benchmark, key, text).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["gone_id"]), "left_anti")


def op9_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
