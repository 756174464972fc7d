"""Lexical retrieval packing (operator 2).

Documents become ids; those that share words are dealt to the same part of a table (by the least hash of their word pairs; a lot
spreads a crowd of copies over as many parts as it needs).  The number of parts follows from the number of ids alone: all
documents are one part up to SHARD_IDS.  A part that turns out larger is cut into shards of a bounded number of ids.  A shard has
a BM25 inverted index over the pieces of words, with document frequencies and mean length counted over all documents.  Whole
windows of long documents stand alone.  For the rest, the longest unused unit is the seed of a window; the index ranks all unused
units that share a piece with it; they fill the window greedily, the best first, and one of them is cut where the window ends.
What is left of it stays in the pool.  Only where no ranked unit is left do the longest of the others fill a window.  The last,
short window of a shard is cut into powers of two, which need no padding.

Document frequencies are exact.  Terms that one document has match no other and are left out.  Up to TERMS others are broadcast
(a checked count); beyond, each part gets those of its own terms by a join, with the same result.

Defined cases: null text is empty (its ids: the end id alone); null and repeated keys are kept, a piece per row; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, distinct, hash_spans, map_arrow, mix64, read_table, slices, stage_table, window_hashes
from .tokens import WordTokenizer, crc32_of, default_tokenizer, from_payload, to_payload

WINDOW = 4096
#: Ids in a shard of the index.
SHARD_IDS = 2_000_000
#: How full parts are meant to be, as a share of a shard, so that few need a second one.
FULL = 0.9
#: Terms are hashes of so many bits; the others leave room for the number of a document among OWNERS, so that one sort finds both.
TERM_BITS = 48
_SPARE, OWNERS = np.uint64(64 - TERM_BITS), 1 << 64 - TERM_BITS
#: Terms whose document frequencies may be broadcast (12 bytes each), and distinct terms that a task counts before it hands them on.
TERMS, COUNTED = 4_000_000, 500_000
#: Ids whose terms are hashed in one numpy step.
TERMS_AT_ONCE = 1 << 18
#: A term in one of so many units of a shard has its weights in a row of a matrix, not in a list.
DENSE = 4
#: Bytes of ids by which documents are weighed when they are dealt to parts.
WEIGHED = 4096
#: Neighbours that are sorted first.
FIRST = 256
#: Bits of a spot, by which documents are dealt: of the least hash, and of the lot (52 together: exact as a double).
ROUTE_BITS, LOT_BITS = 36, 16
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def unit_terms(units: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of TERM_BITS) of the pieces of words of all units in turn, and their number in each.  A piece is a run of ids up to
    one that ends a word; what a unit begins with counts as a whole piece."""
    terms, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, b in slices([len(x) for x in units], TERMS_AT_ONCE):
        ids, begins = np.concatenate(units[a:b]), np.cumsum([0, *map(len, units[a:b])])
        stops = np.flatnonzero(ends[ids]) + 1
        owner = np.searchsorted(begins, stops - 1, side="right") - 1
        starts = np.maximum(np.concatenate([[0], stops[:-1]]).astype(np.int64), begins[owner]) if len(stops) else stops
        terms.append(hash_spans(ids, starts, stops) >> _SPARE)
        counts.append(np.bincount(owner, minlength=b - a))
    return np.concatenate(terms), np.concatenate(counts)


def routes_and_terms(ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least hash of a pair of neighbouring terms of each document, its number of terms; and the terms of all documents in
    turn, with their documents."""
    n, stop = len(offsets) - 1, ends[ids]
    stop[offsets[1:] - 1] = True
    stops = np.flatnonzero(stop) + 1
    starts = np.concatenate([[0], stops[:-1]])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    term = stops != offsets[owner + 1]  # what holds the end id is none
    hashes, owner = hash_spans(ids, starts[term], stops[term]) >> _SPARE, owner[term]
    routes, firsts = np.zeros(n, dtype=np.int64), np.searchsorted(owner, np.arange(n + 1))
    if len(hashes):
        pair = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
        pair[:-1] = np.where(owner[1:] == owner[:-1], window_hashes(hashes, 2), pair[:-1])
        alone = firsts[:-1][np.diff(firsts) == 1]
        pair[alone] = mix64(hashes[alone])
        some = np.diff(firsts) > 0
        routes[some] = (np.minimum.reduceat(pair, firsts[:-1][some]) >> np.uint64(1)).astype(np.int64)
    return routes, np.diff(firsts), hashes, owner


def count_documents(terms: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, and how many of the owners (0 and up, in ascending order) have it; by sorts of OWNERS owners at a time."""
    found = []
    for first in range(0, int(owner[-1]) + 1 if len(owner) else 0, OWNERS):
        a, b = np.searchsorted(owner, (first, first + OWNERS))
        both = distinct((terms[a:b] << _SPARE) | (owner[a:b] - first).astype(np.uint64)) >> _SPARE
        firsts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        found.append((both[firsts], np.diff(np.append(firsts, len(both)))))
    return found[0] if len(found) == 1 else count_terms(*(np.concatenate([x[i] for x in found]) if found else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64))))


def count_terms(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, with the sum of its counts."""
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, dtype=np.int64)
    return terms[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts


class _Counter:
    """Counts of terms, in bounded memory: it is emptied when it holds COUNTED terms."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, terms: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is full."""
        self.held.append((terms, counts))
        self.size += len(terms)
        if self.size >= COUNTED and len(self.held) > 1:
            self.held = [self.take()]
            self.size = len(self.held[0][0])
        return self.size >= COUNTED

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = (np.concatenate([x[i] for x in self.held]) if self.held else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
        self.held, self.size = [], 0
        return count_terms(terms, counts)


def lots_of(keys: pa.Array) -> np.ndarray:
    """A lot for each row, from its key and from how often the key stood before in this batch, so that a hot key has many."""
    x = pd.Series(keys.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
    before = x.groupby(x).cumcount().to_numpy().astype(np.uint64)
    return (mix64(mix64(x.to_numpy().view(np.uint64)) + before) & np.uint64((1 << LOT_BITS) - 1)).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document (doc_id, n_terms, spot, ids), and rows with the terms of documents and their counts (terms, counts)."""
    names = ["doc_id", "n_terms", "spot", "ids", "terms", "counts"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counter = WordTokenizer.of(tokenizer), _Counter()

        def counted() -> pa.RecordBatch:
            terms, counts = counter.take()
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in types[:4]), pa.array([terms.tobytes()]), pa.array([counts.astype("<u4").tobytes()])], names)

        for batch, texts in batches(it):
            all_ids, offsets = t.encode(texts)
            routes, n_terms, terms, owner = routes_and_terms(all_ids, offsets, t.ends)
            full = counter.add(*count_documents(terms, owner))
            payloads = [to_payload(all_ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            n = len(texts)
            spots = (routes >> (63 - ROUTE_BITS) << LOT_BITS) | lots_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_terms), pa.array(spots), pa.array(payloads, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            if full:
                yield counted()
        if counter.size:
            yield counted()

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), encode, "doc_id long, n_terms long, spot long, ids binary, terms binary, counts binary")


def document_frequencies(encoded: DataFrame) -> DataFrame:
    """term and n, the documents that have it, of all terms in two documents or more."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, counts = np.frombuffer(terms, dtype="<i8"), np.frombuffer(counts, dtype="<u4").astype(np.int64)
                for i in range(0, len(terms), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], ["term", "n"])

    rows = map_arrow(encoded.where("terms is not null").select("terms", "counts"), unpack, "term long, n long")
    return stage_table(rows.groupBy("term").agg(F.sum("n").alias("n")).where("n > 1"), "frequencies")


class Frequencies:
    """Document frequencies by term, from sorted arrays, and the weight that follows."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, documents: int):
        self.terms, self.counts, self.documents = terms, counts, documents

    def idf(self, terms: np.ndarray) -> np.ndarray:
        """0 for terms that are not known: one document at most has them."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), dtype=bool)
        n = np.where(known, self.counts[at] if len(self.terms) else 0, 0).astype(np.float64)
        return np.where(known, np.log1p((self.documents - n + 0.5) / (n + 0.5)), 0.0)


class Index:
    """BM25 over the units of a shard: postings by term, with the weight of each."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, frequencies: Frequencies, mean: float):
        """terms of all units in turn, sizes: their number in each."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        names, term = np.unique(terms, return_inverse=True)
        idf = frequencies.idf(names)
        keep = idf[term] > 0
        pair, tf = np.unique(term[keep].astype(np.int64) * max(n, 1) + owner[keep], return_counts=True)
        self.term, self.unit = pair // max(n, 1), pair % max(n, 1)
        self.firsts = np.searchsorted(self.term, np.arange(len(names) + 1))
        norm = K1 * (1 - B + B * sizes[self.unit] / max(mean, 1e-9))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        by_unit = np.argsort(self.unit, kind="stable")
        self.own, self.own_firsts, self.n = self.term[by_unit], np.searchsorted(self.unit[by_unit], np.arange(n + 1)), n
        # Terms in many units: their weights as rows of a matrix.
        self.row = np.full(len(names), -1, dtype=np.int64)
        many = np.flatnonzero(np.diff(self.firsts) * DENSE > n)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), n), dtype=np.float32)
        dense = self.row[self.term] >= 0
        self.rows[self.row[self.term[dense]], self.unit[dense]] = self.weight[dense]

    def scores(self, seed: int) -> np.ndarray:
        terms = self.own[self.own_firsts[seed] : self.own_firsts[seed + 1]]
        row = self.row[terms]
        asked = np.zeros(len(self.rows), dtype=np.float32)
        asked[row[row >= 0]] = 1
        terms = terms[row < 0]
        a, sizes = self.firsts[terms], self.firsts[terms + 1] - self.firsts[terms]
        at = np.arange(sizes.sum()) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.unit[at], weights=self.weight[at], minlength=self.n) + asked @ self.rows

    def neighbours(self, seed: int, waiting: np.ndarray) -> Iterator[int]:
        """All waiting units that share a term with the seed, the best first.  The first FIRST or so are sorted at once, the
        others when they are asked for."""
        scores = self.scores(seed)
        some = np.flatnonzero(waiting & (scores > 0))
        own = scores[some]
        limit = np.partition(own, len(own) - FIRST)[len(own) - FIRST] if len(own) > FIRST else -1.0
        for part in (own > limit, own <= limit):
            yield from some[part][np.argsort(-own[part], kind="stable")].tolist()


def pack_shard(documents: list[tuple[int | None, np.ndarray]], ends: np.ndarray, frequencies: Frequencies, mean: float, first: int, window: int = WINDOW) -> tuple[list[tuple], int]:
    """Pieces of a shard's documents (in the order of PIECES) and the number of the next sequence."""
    out: list[tuple] = []
    number = first

    def put(d: int, start: int, length: int, sequence: int, offset: int) -> None:
        key, ids = documents[d]
        out.append((key, start, length, crc32_of(ids[start : start + length]), len(ids), sequence, offset))

    begin, stop, units = [], [], []
    for d, (_, ids) in enumerate(documents):
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            put(d, start, window, number, 0)
            number += 1
        begin.append(whole)
        stop.append(len(ids))
        units.append(ids[whole:])
    index = Index(*unit_terms(units, ends), frequencies, mean)
    begin, stop = np.array(begin, dtype=np.int64), np.array(stop, dtype=np.int64)
    waiting = begin < stop
    by_size = np.lexsort((np.arange(len(begin)), begin - stop)).tolist()
    cut: list[int] = []  # units of which a part has gone: they are the next seeds
    at = 0
    window_now: list[tuple[int, int, int]] = []
    while True:
        while at < len(by_size) and not waiting[by_size[at]]:
            at += 1
        seed = cut.pop() if cut else by_size[at] if at < len(by_size) else None
        if seed is None:
            break
        window_now, room = [], window

        def take(u: int, room: int) -> int:
            n = min(room, int(stop[u] - begin[u]))
            window_now.append((u, int(begin[u]), n))
            begin[u] += n
            waiting[u] = begin[u] < stop[u]
            if waiting[u]:
                cut.append(u)
            return room - n

        room = take(seed, room)
        if room:
            for u in index.neighbours(seed, waiting):
                if not room:
                    break
                room = take(u, room)
        for u in by_size[at:] if room else []:  # no neighbour is left
            if not room:
                break
            if waiting[u]:
                room = take(u, room)
        if room:
            break
        offset = 0
        for u, start, n in window_now:
            put(u, start, n, number, offset)
            offset += n
        number, window_now = number + 1, []
    # The last window of the shard: sequences of 2**k ids, the largest first.
    left, offset = sum(n for *_, n in window_now), 0
    room = 1 << max(left.bit_length() - 1, 0)
    for u, start, n in window_now:
        while n:
            k = min(n, room - offset)
            put(u, start, k, number, offset)
            start, n, offset, left = start + k, n - k, offset + k, left - k
            if offset == room:
                number, offset, room = number + 1, 0, 1 << max(left.bit_length() - 1, 0)
    return out, number


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    encoded = stage_table(encode_documents(docs, tokenizer), "encoded")
    rows = encoded.where("ids is not null").select("doc_id", "n_terms", "spot", "ids")
    width = F.when(F.substring("ids", 1, 1) == F.lit(b"\x02"), 2).otherwise(4)  # bytes of an id in its payload
    n_ids = F.coalesce(F.sum(F.floor(F.octet_length("ids") / width)), F.lit(0))
    count, mean, n_ids = rows.agg(F.count("*"), F.coalesce(F.avg("n_terms"), F.lit(0.0)), n_ids).first()
    n = 1 if n_ids <= shard_ids else math.ceil(n_ids / (FULL * shard_ids))
    # Parts of about equal size: a document counts once for each WEIGHED bytes that it has begun.
    weighed = rows.select("spot", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("ids") / WEIGHED).cast("int"))))
    cuts = np.array(weighed.approxQuantile("spot", [i / n for i in range(1, n)], 1 / (20 * n)) if count and n > 1 else [], dtype=np.int64)
    frequencies = document_frequencies(encoded)
    broadcast = frequencies.count() <= TERMS
    known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if broadcast:
        table = frequencies.toArrow()
        known = (table.column("term").to_numpy().view(np.uint64), table.column("n").to_numpy())
        order = np.argsort(known[0])
        known = tuple(x[order] for x in known)
    shared, limits = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(cuts)  # TERMS and n at most

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their parts."""
        for batch in it:
            spot = batch.column(1)
            part = np.searchsorted(limits.value, spot.to_numpy(), side="right").astype(np.int64)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), spot, batch.column(2), none, none], names)

    def wanted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of each part's documents."""
        ends = WordTokenizer.of(tokenizer).ends
        for batch in it:
            part = np.searchsorted(limits.value, batch.column(1).to_numpy(), side="right")
            of_part: dict[int, list[np.ndarray]] = {}  # the units of each
            for p, payload in zip(part.tolist(), batch.column(2).to_pylist(), strict=True):
                ids = from_payload(payload)
                of_part.setdefault(p, []).append(ids[len(ids) // window * window :])
            for p, units in of_part.items():
                terms = distinct(unit_terms(units, ends)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), p, dtype=np.int64)), pa.array(terms)], ["part", "term"])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole parts, sorted: what is known of a part's terms, then its documents."""
        from pyspark import TaskContext

        number, ends = TaskContext.get().partitionId() << 32, WordTokenizer.of(tokenizer).ends
        held, size, now, terms, counts = [], 0, None, [], []
        of_part = Frequencies(*shared.value, count)

        def emit() -> pa.RecordBatch:
            nonlocal number
            pieces, number = pack_shard(held, ends, of_part, mean, number, window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for batch in it:
            part, keys, payloads, own, n = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for p, key, payload, term, k in zip(part, keys, payloads, own, n, strict=True):
                if p != now:
                    if held:
                        yield emit()
                    held, size, now, terms, counts = [], 0, p, [], []
                if term is not None:
                    terms.append(term)
                    counts.append(k)
                    continue
                if terms:
                    x, c = np.array(terms, dtype=np.int64).view(np.uint64), np.array(counts, dtype=np.int64)
                    of_part, terms, counts = Frequencies(x[np.argsort(x)], c[np.argsort(x)], count), [], []
                ids = from_payload(payload)
                if held and size + len(ids) > shard_ids:
                    yield emit()
                    held, size = [], 0
                held.append((key, ids))
                size += len(ids)
        if held:
            yield emit()

    names = ["part", "doc_id", "spot", "ids", "term", "n"]
    documents = rows.select("doc_id", "spot", "ids")
    dealt = map_arrow(documents, deal, "part long, doc_id long, spot long, ids binary, term long, n long")
    if not broadcast:
        asked = map_arrow(documents, wanted, "part long, term long").distinct().join(frequencies, "term")
        dealt = dealt.unionByName(asked.select("part", "term", "n"), allowMissingColumns=True)
    parts = dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", F.col("term").isNull(), "spot", "doc_id", "ids")
    return map_arrow(parts, pack, PIECES)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
