"""Ranked lexical search over a length-stratified index (operator 13).

A document's normaliser m follows from its length alone, so documents of equal m form a stratum: within it a term's impact hangs on
tf alone.  The index has a row for each stratum of a shard (the documents that a task read in turn, up to a number of terms): the
documents' keys, and postings by term, the highest tf first.  Shards need no shuffle, and neither a frequent term nor a frequent
length gathers anywhere: what has it lies in as many shards as its documents.

A search takes its items in blocks of a bounded number of terms.  It counts in which documents their terms lie, over the whole
index; then each task bounds what a stratum can give each item (the highest tf of each term), visits the strata from the highest
bound on, with impacts computed once for each tf, and leaves out those whose bound is under an item's `top`-th score so far.
Equal bounds are visited, so ties are exact.  The best of all tasks are ranked at the end.

Terms are compared by 64-bit hashes: two different terms meet with a chance of about one in 10**19 for each pair.

Defined cases: null or empty texts, and those without a term, are in no stratum and are not found; all rows of one item_id (null
ones too) are one item, with the terms of all its texts, each once; an item without a term known to the index has no rows; rows
with a repeated key are documents of their own; null keys come after all others among equal scores; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, map_arrow, read_table, stage_table, word_hashes

TOP = 50
#: Terms (with repeats) in a shard, at least one document; bounds what a task holds.
SHARD_TERMS = 1_000_000
#: Bytes of a row group of the index, about; a larger stratum stands alone.
GROUP_BYTES = 8 << 20
#: Terms of items in a block of a search, and numbers that one numpy step holds.
PAIRS, CELLS = 1_000_000, 250_000
#: A term's weight and impact, and m: fixed by the contract.
WEIGHT, SCALE, TF, NORM, M_LOW, M_SLOPE = 1000, 1_000_000_000, 1000, 20, 50, 50
INDEX = "m long, keys array<long>, terms array<long>, ends array<int>, tfs array<int>, docs array<int>"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes between terms: all of ASCII but letters and digits.
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the place of each text's first (one more at the end)."""
    return word_hashes([x.lower() for x in texts], _BETWEEN)  # bytes.lower: A-Z alone


def collection_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, their terms with repeats."""
    n = docs.select(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    return n.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range in turn."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def shard_rows(keys: list, hashes: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A row for each stratum of a shard: sizes has the number of terms of each of its documents, hashes their terms in turn."""
    m = M_LOW + (M_SLOPE * sizes * n_docs) // n_terms
    order, firsts = np.argsort(m, kind="stable"), _offsets(sizes)
    cuts = np.append(_starts(m[order]), len(order))
    columns: list[list[np.ndarray]] = [[] for _ in range(4)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        terms, docs = hashes[spread(firsts[own], sizes[own])], np.repeat(np.arange(b - a), sizes[own])
        by_term = np.argsort(terms, kind="stable")  # documents of a term stay in order
        terms, docs = terms[by_term], docs[by_term]
        pair = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])]))
        tf, terms, docs = np.diff(np.append(pair, len(terms))), terms[pair], docs[pair]
        first = _starts(terms)
        ends = np.append(first[1:], len(terms))
        term, most = np.repeat(np.arange(len(first)), ends - first), int(tf.max()) + 1
        by_tf = np.argsort(term * most - tf, kind="stable")
        for column, x in zip(columns, (terms[first].view(np.int64), ends.astype(np.int32), tf[by_tf].astype(np.int32), docs[by_tf].astype(np.int32)), strict=True):
            column.append(x)
    lists = [pa.ListArray.from_arrays(_offsets(np.array([len(x) for x in c])).astype(np.int32), np.concatenate(c)) for c in columns]
    of_stratum = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array([keys[i] for i in order.tolist()], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(m[order[cuts[:-1]]]), of_stratum, *lists], [x.split()[0] for x in INDEX.split(", ")])


class SearchIndex(NamedTuple):
    """The index of a table: rows of INDEX, N and L."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_terms: int = SHARD_TERMS) -> SearchIndex:
    """The index of all documents, written to the shared folder.  No shuffle: each task indexes the documents that it reads."""
    n_docs, n_terms = collection_size(docs, text)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, sizes, total = [], [], [], 0
        for batch, texts in batches(it):
            found, firsts = term_hashes(texts)
            n = np.diff(firsts)
            some, own = np.flatnonzero(n), batch.column(0).to_pylist()
            keys += [own[i] for i in some.tolist()]
            hashes.append(found)
            sizes.append(n[some])
            total += len(found)
            if total >= shard_terms:
                yield shard_rows(keys, np.concatenate(hashes), np.concatenate(sizes), n_docs, n_terms)
                keys, hashes, sizes, total = [], [], [], 0
        if keys:
            yield shard_rows(keys, np.concatenate(hashes), np.concatenate(sizes), n_docs, n_terms)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return SearchIndex(stage_table(map_arrow(rows, index, INDEX), "index", GROUP_BYTES), n_docs, n_terms)


class Block:
    """Items with their terms, as arrays: terms in order, and for each the items that hold it."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, n_items: int):
        order = np.argsort(terms, kind="stable")
        terms, self.items, self.n_items = terms[order], items[order], n_items
        first = _starts(terms)
        self.terms, self.firsts, self.holders = terms[first], first, np.diff(np.append(first, len(terms)))

    def hits(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's terms are among these (in order), and where."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.terms)
        return own, at[own]


class Stratum(NamedTuple):
    """What a stratum holds of a block's terms."""

    m: int
    keys: pa.Array
    own: np.ndarray  # terms of the block
    starts: np.ndarray  # of their postings
    sizes: np.ndarray
    tfs: np.ndarray
    docs: np.ndarray


def strata_of(batch: pa.RecordBatch, block: Block) -> Iterator[Stratum]:
    def part(c: int, i: int) -> np.ndarray:
        return batch.column(c)[i].values.to_numpy()

    for i in range(batch.num_rows):
        own, at = block.hits(part(2, i).view(np.uint64))
        if len(own):
            ends = part(3, i).astype(np.int64)
            starts = np.where(at > 0, ends[at - 1], 0)
            yield Stratum(batch.column(0)[i].as_py(), batch.column(1)[i].values, own, starts, ends[at] - starts, part(4, i), part(5, i))


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Of each tf, computed once for each that occurs."""
    values, place = np.unique(tf.astype(np.int64), return_inverse=True)
    return ((SCALE * values) // (TF * values + NORM * m))[place]


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, dtype=np.int64)  # the least score that can still matter
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items

    def add(self, item: int, scores: np.ndarray, null: np.ndarray, keys: np.ndarray) -> None:
        scores, null, keys = (np.concatenate(x) for x in zip(self.found[item], (scores, null, keys), strict=True))
        order = np.lexsort((keys, null, -scores))[: self.top]
        self.found[item] = scores[order], null[order], keys[order]
        if len(order) == self.top:
            self.least[item] = max(1, int(scores[order[-1]]))


def bounds_of(s: Stratum, block: Block, weight: np.ndarray) -> np.ndarray:
    """What a document of the stratum can score at most, for each item."""
    n = block.holders[s.own]
    most = np.repeat(weight[s.own] * impacts(s.tfs[s.starts], s.m), n)  # the first posting of a term has its highest tf
    out = np.zeros(block.n_items, dtype=np.int64)
    np.add.at(out, block.items[spread(block.firsts[s.own], n)], most)
    return out


def visit(s: Stratum, live: np.ndarray, block: Block, weight: np.ndarray, best: Best) -> None:
    """Score the stratum's documents for the items that are live."""
    post = spread(s.starts, s.sizes)
    docs, score = s.docs[post].astype(np.int64), np.repeat(weight[s.own], s.sizes) * impacts(s.tfs[post], s.m)
    starts, n = np.cumsum(s.sizes) - s.sizes, block.holders[s.own]
    items, term = block.items[spread(block.firsts[s.own], n)], np.repeat(np.arange(len(s.own)), n)
    some = live[items]
    items, term = items[some], term[some]
    order = np.argsort(items, kind="stable")
    items, term = items[order], term[order]
    first = _starts(items)
    cells = np.add.reduceat(s.sizes[term], first) if len(first) else first
    n_docs, begin = len(s.keys), 0
    keys, null = s.keys.fill_null(0).to_numpy(), s.keys.is_null().to_numpy(zero_copy_only=False)
    ends = np.append(first[1:], len(items))
    while begin < len(first):  # as many items at once as CELLS allows, one at least
        most = np.maximum(np.cumsum(cells[begin:]), n_docs * np.arange(1, len(first) - begin + 1))
        stop = begin + max(1, int(np.searchsorted(most, CELLS, side="right")))
        a, b = first[begin], ends[stop - 1]
        row = np.repeat(np.arange(stop - begin), ends[begin:stop] - first[begin:stop])
        size = s.sizes[term[a:b]]
        at = spread(starts[term[a:b]], size)
        sums = np.zeros((stop - begin) * n_docs, dtype=np.int64)
        np.add.at(sums, np.repeat(row, size) * n_docs + docs[at], score[at])
        sums = sums.reshape(stop - begin, n_docs)
        enough = sums >= best.least[items[first[begin:stop]]][:, None]
        for r in np.flatnonzero(enough.any(axis=1)).tolist():
            d = np.flatnonzero(enough[r])
            best.add(int(items[first[begin + r]]), sums[r, d], null[d], keys[d])
        begin = stop


def search_strata(strata: list[Stratum], block: Block, weight: np.ndarray, best: Best) -> int:
    """Visit the strata from the highest bound on; the number of those that no item needed."""
    left, step = 0, max(1, CELLS // max(block.n_items, 1))
    for i in range(0, len(strata), step):
        part = strata[i : i + step]
        bounds = np.stack([bounds_of(s, block, weight) for s in part])
        for k in np.argsort(-bounds.max(axis=1), kind="stable").tolist():
            live = bounds[k] >= best.least
            if live.any():
                visit(part[k], live, block, weight, best)
            else:
                left += 1
    return left


def item_terms(queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and term of every item, each pair once."""

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            found, firsts = term_hashes(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(texts)), np.diff(firsts)))), pa.array(found.view(np.int64))], ["item_id", "term"])

    return map_arrow(queries.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")), hashed, "item_id long, term long").distinct()


def search_block(index: SearchIndex, names: pa.Array, block: Block, top: int) -> DataFrame:
    """The best `top` documents of each item of a block."""
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast(block)  # PAIRS terms, or those of one item

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = shared.value, np.zeros(len(shared.value.terms), dtype=np.int64)
        for batch in it:
            for i in range(batch.num_rows):
                own, at = block.hits(batch.column(0)[i].values.to_numpy().view(np.uint64))
                n[own] += np.diff(batch.column(1)[i].values.to_numpy(), prepend=0)[at]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["at", "n"])

    frequency = np.zeros(len(block.terms), dtype=np.int64)
    for at, n in map_arrow(index.rows.select("terms", "ends"), count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a row for each of the block's terms
        frequency[at] = n
    weight = np.array([math.floor(WEIGHT * math.log((2.0 * index.n_docs + 2) / (2.0 * n + 1))) for n in frequency.tolist()], dtype=np.int64)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(block.n_items, top)
        for batch in it:
            search_strata(list(strata_of(batch, block)), block, weight, best)
        for i, (scores, null, keys) in enumerate(best.found):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i)), pa.array(keys, mask=null), pa.array(scores)], ["at", "doc_id", "score"])

    found = map_arrow(index.rows, search, "at long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    items = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(names))), "item_id": names}))
    return ranked.join(items, "at").select("item_id", "rank", "doc_id", "score")


def search(index: SearchIndex, queries: DataFrame, top: int = TOP, item: str = "item_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `top` best documents of each item."""
    terms = stage_table(item_terms(queries, item, text), "asked")
    n = max(1, -(-2 * terms.count() // pairs)) if terms.count() > pairs else 1
    found = []
    for i in range(n):
        table = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).toArrow()
        names = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        if len(names):
            found.append(search_block(index, names.dictionary, Block(names.indices.to_numpy().astype(np.int64), table.column("term").to_numpy().view(np.uint64), len(names.dictionary)), top))
    if not found:
        return terms.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))
