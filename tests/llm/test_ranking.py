"""Importance resampling, genetic packing and ranked search: against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomfeed.llm import best_fit, radix, resampling, search
from loomfeed.llm.tokens import WordTokenizer, crc32_of, default_tokenizer

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "Ünï cödé wörds " * 9), (None, "null key " * 12), (None, "null key " * 12), (7, "same words here " * 10), (8, "same words here " * 10), (8, "same words here " * 10), (-9, "x" * 40_000 + " " + "long text " * 30_000), (9, "\x00\x01 odd\x7f control 12 A-b " * 8), ((1 << 63) - 1, "greatest key " * 10), (-(1 << 63), "least key " * 15)]


def brute_resampling(rows, target, percent=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())  # noqa: E731  bytes: lower() is A-Z alone
    bucket = lambda w: zlib.crc32(w) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    out = []
    for key, text in rows:
        own = [gain[bucket(w)] for w in words(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, order[: len(order) * percent // 100]


@pytest.mark.parametrize("percent", [10, 100])
def test_resampling_of_odd_rows(spark, percent):
    rows = ODD + [(100 + i, " ".join(random.Random(i).choices("alpha beta gamma delta Ärger 42 x".split(), k=i % 60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_at": F.lit("clash"), "rank": F.lit(1), "words": F.lit("w"), "score": F.lit(0)})
    target = ["beta beta words", None, "", "12 greatest"]
    got = resampling.resample(docs, spark.createDataFrame([(x, 1) for x in target], "text string, score int"), percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want, order = brute_resampling(rows, target, percent)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(order) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(x[0], x[3]) for x in order]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = {r.doc_id: r for r in resampling.resample(some, none, percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[2].n_features == 1
    assert resampling.drawn(some, resampling.resample(some, none, percent=100)).collect() == some.where("doc_id = 1").collect()


def test_runs_of_words(spark):
    df = spark.createDataFrame([("a b c",), ("a",), (None,)], "text string").select(resampling.words_of(F.col("text")).alias("w"))
    got = [r[0] for r in df.select(resampling.buckets_of(F.col("w"), 3)).collect()]
    assert got[0] == [zlib.crc32(x) % 10000 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")] and len(got[1]) == 1 and got[2] == []


def test_radix_ranks_are_stable_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 5, 1 << 40, (1 << 62) + rng.randrange(9)]), rng.randrange(-5, 5) * 10 ** rng.randrange(1, 18), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(5)
    want = sorted(rows)
    for most in (1 << 18, 7):
        monkeypatch.setattr(radix, "BLOCK_ROWS", most)
        got = radix.radix_ranks(df, [F.col("i"), radix.unsigned(F.col("b")), F.col("a")]).orderBy("_at").collect()
        assert [r._at for r in got] == list(range(len(rows)))
        assert [(r.a, r.b, r.i) for r in got] == want
    equal = radix.radix_ranks(df, [F.lit(4).cast("long")]).collect()
    assert sorted(r._at for r in equal) == list(range(len(rows)))


def brute_search(rows, queries, top=50):
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    docs = [(key, Counter(terms(text))) for key, text in rows]
    docs = [x for x in docs if x[1]]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for key, c in docs:
            m = 50 + 50 * sum(c.values()) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@pytest.mark.parametrize("shard_terms, pairs, cells", [(2_000_000, 1_000_000, 2_000_000), (500, 40, 300)])
def test_search_of_odd_rows(spark, monkeypatch, shard_terms, pairs, cells):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = ODD + [(100 + i, " ".join(rng.choices(words, weights=range(1, 301), k=rng.choice([3, 20, 20, 20, 90])))) for i in range(600)]
    rows += [(2000 + i, rows[20][1]) for i in range(80)]  # ties beyond the limit
    queries = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)] + [(50, rows[20][1]), (51, None), (52, "unheard of"), (53, "key KEY"), (None, "w7"), (None, "w9 w7"), (54, "w1"), (54, "w2 w1"), (55, "ünï Cödé Ünï")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"m": F.lit("clash"), "keys": F.lit(1), "score": F.lit(0)}).repartition(3)
    items = spark.createDataFrame(queries, "item_id long, text string").withColumn("term", F.lit("clash"))
    monkeypatch.setattr(search, "CELLS", cells)
    got = search.search(search.build_index(docs, shard_terms=shard_terms), items, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == brute_search(rows, queries)


def test_search_reads_its_index_in_small_steps(spark, monkeypatch):
    """Row groups of the index are bounded, as a reader unpacks the long arrays of a group at once; the rows found are the same."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "benchmark"))
    docs, items = docs.coalesce(1), items.limit(3)
    want = search.search(search.build_index(docs), items).collect()
    monkeypatch.setattr(search, "GROUP_BYTES", 1 << 17, raising=False)
    index = search.build_index(docs, shard_terms=100_000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.rows.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 10 and all(g.num_rows == 1 or g.total_byte_size < 3 << 17 for g in groups)
    assert sorted(search.search(index, items).collect()) == sorted(want)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert search.search(search.build_index(none), some, item="doc_id").count() == 0
    assert search.search(search.build_index(some), none, item="doc_id").count() == 0
    index = search.build_index(some)
    assert (index.n_docs, index.n_terms) == (1, 2) and index.rows.count() == 1


def test_search_leaves_out_strata_that_cannot_matter():
    """Short documents that hold both terms come first; of the long ones that hold one, none can reach them."""
    texts = [b"rare word and a few"] * 60 + [b"word " + b"filler text " * (50 + i) for i in range(200)]
    hashes, firsts = search.term_hashes(texts)
    rows = search.shard_rows(list(range(260)), hashes, np.diff(firsts), 260, int(firsts[-1]))
    terms = search.term_hashes([b"rare word"])[0]
    block = search.Block(np.zeros(2, dtype=np.int64), terms, 1)
    best = search.Best(1, 50)
    strata = list(search.strata_of(rows, block))
    left = search.search_strata(strata, block, np.array([500, 500]), best)
    assert len(strata) > 20 and left == len(strata) - 1
    assert best.found[0][2].tolist() == list(range(50))


def check_pieces(rows, pieces, window):
    """Every id in one piece, cut at whole windows alone, sequences without gaps."""
    t, want = WordTokenizer.of(default_tokenizer()), Counter()
    for key, text in rows:
        ids = np.array([*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        for k, a in enumerate(range(0, len(ids), window)):
            want[key, k, a, min(window, len(ids) - a), crc32_of(ids[a : a + window])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    of = {}
    for r in pieces:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in of.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= window
    return len(of), -(-sum(r.length for r in pieces) // window)


@pytest.mark.parametrize("window, group", [(2048, 4096), (64, 150)])
def test_best_fit_of_odd_rows(spark, monkeypatch, window, group):
    monkeypatch.setattr(best_fit, "GROUP", group)
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choices(["word", "another", "long-winded", "x,"], k=rng.randrange(0, 90)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit("clash"), "piece": F.lit(1), "length": F.lit("c")})
    packed = best_fit.pack_best_fit(docs, window=window, with_ids=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    pieces = packed.collect()
    bins, least = check_pieces(rows, pieces, window)
    rests = [r.length for r in pieces if r.length < window]
    assert least <= bins <= len(pieces) - len(rests) + best_fit_decreasing(rests, window)[1] + len(rests) // group
    assert all(crc32_of(np.array(r.ids, np.uint32)) == r.ids_crc32 for r in pieces)
    whole = best_fit.sequences(packed).collect()
    assert len(whole) == bins and all(len(r.ids) <= window for r in whole) and sum(len(r.ids) for r in whole) == sum(r.length for r in pieces)
    assert best_fit.pack_best_fit(docs.limit(0)).count() == 0


def best_fit_decreasing(sizes, window):
    bins, rooms = np.zeros(len(sizes), dtype=np.int64), []
    best_fit.place(list(sizes), sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, rooms, window)
    return bins, len(rooms)


def test_best_fit_places():
    bins, n = best_fit_decreasing([5, 3, 4, 6, 2], 10)
    assert n == 2 and sorted(np.bincount(bins, weights=[5, 3, 4, 6, 2]).tolist()) == [10, 10]
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(80)]
        order, rooms, bins = rng.sample(range(80), 80), [], np.zeros(80, dtype=np.int64)
        best_fit.place(sizes, order, bins, rooms, 60)
        plain = []  # by hand: the least room that is enough
        for i in order:
            b = min((b for b in range(len(plain)) if plain[b] >= sizes[i]), key=lambda b: plain[b], default=None)
            if b is None:
                plain.append(60)
                b = len(plain) - 1
            plain[b] -= sizes[i]
        assert sorted(plain) == sorted(rooms) and (np.bincount(bins, weights=sizes) <= 60).all()


def test_islands_beat_best_fit_decreasing():
    """Triples that fill a bin exactly: best fit decreasing needs far more bins, children save some in every epoch."""
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, max(251, (1000 - a) // 2)))
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    first = best_fit.evolve(sizes, [], [0, 0, 0], 1000, children=0)
    members, found = first, []
    for e in range(5):
        members = best_fit.evolve(sizes, members, [e, 0, 0], 1000)
        found.append(best_fit.worth(members[0], sizes, 1000))
    assert found == sorted(found, reverse=True) and found[-1][0] < best_fit.worth(first[0], sizes, 1000)[0]
    assert found[-1][0] <= best_fit_decreasing(sizes.tolist(), 1000)[1] - 4
    assert best_fit.evolve(sizes, members, [9, 9, 9], 1000)[0].tolist() == best_fit.evolve(sizes, members, [9, 9, 9], 1000)[0].tolist()  # repeatable


def test_a_child_takes_whole_bins():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, 300)
    a, b = (best_fit.evolve(sizes, [], [0, 0, k], 50, children=0)[0] for k in (1, 2))
    child = best_fit.cross(a, b, sizes, 50, rng)
    bins = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in range(x.max() + 1)}
    assert (np.bincount(child, weights=sizes) <= 50).all() and (np.bincount(child) > 0).all()
    assert len(bins(child) & bins(b)) > len(bins(a) & bins(b)) and bins(child) & bins(a) - bins(b)


def test_rounds_join_what_groups_leave(spark, monkeypatch):
    """Groups of 128 items each leave a bin that is not full; most of that is saved when what they leave is dealt anew."""
    monkeypatch.setattr(best_fit, "GROUP", 128)
    rng = random.Random(6)
    sizes = [rng.randrange(1, 200) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "unit long, length long")
    alone = best_fit.pack_round(items, 2000, 0, 512).select("sequence").distinct().count()
    rows = best_fit.pack_items(items, 512).collect()
    bins, least = len({r.sequence for r in rows}), -(-sum(sizes) // 512)
    assert sorted(r.unit for r in rows) == list(range(2000))
    assert least <= bins <= least + (alone - least) // 2
