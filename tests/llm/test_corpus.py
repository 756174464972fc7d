"""Operators over the whole corpus against brute force on the small documents table, their defined cases, the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfeed.llm import decontamination, neardup, packing, queries, sharding
from loomfeed.llm.common import read_table
from loomfeed.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_DIR, "documents").withColumns({"node": F.lit("clash"), "component": F.lit(1), "bucket": F.lit(2), "shard": F.lit(3), "words": F.lit("w"), "gone_id": F.lit(4), "kept_id": F.lit(5)})


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    """The least key that each key reaches."""
    sets = defaultdict(list)
    for key, text in rows:
        if key is not None:
            sets[key].append(shingles(text))
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {k: root(k) for k in keys}


def test_near_duplicates(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(t)) and r.kept == (want[k] == k) for k, t in rows for r in [got[k]])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 7)
    rng, rows = random.Random(5), []
    for _ in range(4):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(9)):
                words[rng.randrange(120)] = f"x{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c"), (None, "a b"), (None, "c d"), (5, rows[9][1]), (1005, rows[0][1]), (1005, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    want = brute_components(rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None) and len(got) == len(rows)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, False)]
    left = neardup.drop_near_duplicates(df.withColumn("kept", F.lit("x")))
    assert left.columns == ["doc_id", "text", "kept"]
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(set(want.values()))


def test_near_duplicates_join_the_texts_of_a_repeated_key(spark):
    """Keys that are the least of none of their texts, and one that is of one: all that their texts reach is one component."""
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcd")
    rows = [(3, two), (9, two), (5, one), (9, one), (20, three), (21, three), (21, four), (30, four), (40, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert want[9] == want[5] == 3 and want[30] == 20
    got = neardup.near_duplicates(df).collect()
    assert all((r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id) for r in got) and len(got) == len(rows)
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(df).collect()) == [3, 20, 40]


def test_hubs_of_many_pairs_are_copied(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "SPREAD", 2)
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    values = neardup.window_hashes(rng.integers(0, 2**63, 3000).astype(np.uint64), 1)
    a, b = values[:2000], values[500:2500]  # 1500 of 2500
    s = neardup.signatures([np.sort(a), np.sort(b)], 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.06


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = root(a), root(b)
            parent[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def check_shards(rows, shards=16):
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(docs, spark):
    rows = sharding.assign(docs).collect()
    check_shards(rows)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    import zlib

    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    groups = defaultdict(set)
    for r in rows:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())  # no group that fits a shard is cut
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "b")] + [(i, "hot") for i in range(100, 300)], "doc_id long, text string")
    check_shards(sharding.assign(odd).collect())
    assert sharding.assign(odd.limit(0)).count() == 0


def test_shards_cut_large_groups_alone(spark):
    """A group of a third of all rows, groups of half a shard and many small ones: only the first is cut, into few pieces."""
    rows = [(i, "hot") for i in range(1000)] + [(10_000 + i, f"half {i % 14}") for i in range(14 * 90)] + [(20_000 + i, f"pair {i // 2}") for i in range(400)] + [(30_000 + i, f"own {i}") for i in range(540)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got)
    text, groups = dict(rows), defaultdict(set)
    for r in got:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for t, g in groups.items() if t != "hot") and 5 <= len(groups["hot"]) <= 7


def test_shards_of_nothing_but_groups(spark):
    """No room to spare: the law holds, and few groups are cut."""
    rows = [(i, f"g {i // 10}") for i in range(1600)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got)
    groups = defaultdict(set)
    for r in got:
        groups[r.doc_id // 10].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_masks_meet_every_accepted_pattern():
    """No pattern of equal words (ends equal, no gap, enough equal words) avoids all masks: patterns grow by a word while they
    avoid them; of those that end alike the one with the best balance stands for all."""
    span, state = max(map(max, decontamination.MASKS)) + 1, {"1": 1}
    seen: dict = {}
    for _ in range(1000):
        grown: dict = {}
        for (tail, n), balance in {(k, 1) if isinstance(k, str) else k: b for k, b in state.items()}.items():
            for bit in "10":
                new, count, value = (tail + bit)[-span:], min(n + int(bit), decontamination.LEAST), balance + (1 if bit == "1" else -3)
                if new.endswith("0" * decontamination.GAP) or value < -14 or any(len(new) > m[-1] and all(new[len(new) - m[-1] - 1 + k] == "1" for k in m) for m in decontamination.MASKS):
                    continue
                assert not (bit == "1" and count >= decontamination.LEAST and value >= 0), new
                if value > seen.get((new, count), -99):
                    seen[new, count] = grown[new, count] = value
        state = grown
        if not state:
            return
    raise AssertionError("endless patterns avoid the masks")


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_decontamination_judges_the_best_part(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontamination, "SEEDS", seeds)
    item = [f"i{k}" for k in range(60)]
    changed = lambda keep: " ".join(w if keep(k) else f"x{k}" for k, w in enumerate(item))
    rows = [(1, changed(lambda k: k < 30 or k % 3 == 2), 30), (2, changed(lambda k: k % 4 != 3), 45), (3, changed(lambda k: k % 3 != 0), 0), (4, changed(lambda k: k < 11 or k % 3 == 0), 0), (5, changed(lambda k: k % 3 == 2 or k >= 30), 30)]
    got = {r.doc_id: r.most_words for r in decontamination.judge(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}

    def best(text):
        flags = [a == b for a, b in zip(text.split(), item, strict=True)]
        parts = [(sum(flags[a:b]), b - a) for a in range(60) for b in range(a + 1, 61) if flags[a] and flags[b - 1]]
        return max([n for n, size in parts if n >= 12 and n >= 0.75 * size], default=0)

    assert got == {i: best(text) for i, text, _ in rows} and got[1] >= 30 and got[2] == 45 and got[5] >= 30
    assert got[3] == 0


def test_decontamination(docs, spark):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = read_table(spark, SF_DIR, "benchmark")
    items = [words.findall(r.text.lower()) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(f" {' '.join(i)} " in f" {' '.join(words.findall(r.text.lower()))} " for i in items)}
    got = decontamination.judge(docs, bench).collect()
    assert want and {r.doc_id for r in got if not r.kept} == want and len(got) == docs.count()
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len(want)


def test_spaced_seeds_bear_substitutions(spark, monkeypatch):
    rng = random.Random(4)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    changed = list(item)
    for i in range(4, 40, 9):
        changed[i] = "other"
    short = ["tiny", "item", "here"]
    docs = spark.createDataFrame([(1, "x y " + " ".join(changed) + " z"), (2, " ".join(rng.sample(item, 40))), (3, "a TINY, item - here."), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(item[5:22])), (7, " ".join(item[:6]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(short)), (4, ""), (5, None)], "item_id long, text string")
    for seeds in (decontamination.SEEDS, 0):  # broadcast, then shuffled
        monkeypatch.setattr(decontamination, "SEEDS", seeds)
        got = {r.doc_id: r for r in decontamination.judge(docs, bench).collect()}
        assert {k for k, r in got.items() if not r.kept} == {1, 3, None, 6}
        assert (got[1].items, got[1].most_words, got[3].items, got[3].most_words) == ("1", 36, "3", 3)
    assert decontamination.judge(docs, bench.limit(0)).where("not kept").count() == 0 and decontamination.judge(docs.limit(0), bench).count() == 0


def test_a_phrase_of_many_items_is_dealt_out(spark, monkeypatch):
    """10,000 items share eight words; beyond the broadcast no salt has much more than CROWD of them, and each leak is found alone."""
    monkeypatch.setattr(decontamination, "SEEDS", 0)
    phrase = " ".join(f"p{i}" for i in range(8))
    text = F.concat_ws(" ", F.lit(phrase), *(F.concat(F.lit(f"w{k}x"), "id") for k in range(8)))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), text.alias("text"))
    docs = items.where("item_id in (17, 4711)").selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text").unionByName(spark.createDataFrame([(1, phrase), (2, None)], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_words) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(17, 17, 16), (4711, 4711, 16)}
    seeds = items.selectExpr("7L as seed", "item_id", "0 as item_pos")
    met = decontamination._met(spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "doc_id long, seed long"), seeds)
    assert met.count() == 20_000 and met.groupBy("doc_id", "salt").count().agg(F.max("count")).first()[0] < 2 * decontamination.CROWD


def test_leaks_are_those_of_brute_force(spark):
    """Items with words changed at random, in pieces and in several places: the verdict on each pair of document and item and its
    most equal words are those found by comparing all alignments and all parts."""
    rng = random.Random(11)
    items = [[f"w{rng.randrange(30)}" if rng.random() < 0.3 else f"i{k}x{j}" for j in range(rng.choice((6, 12, 25, 40)))] for k in range(8)]
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        item = items[rng.randrange(8)]
        rate, a = rng.choice((0, 0.1, 0.2, 0.25, 0.3, 0.4)), rng.randrange(len(item) // 2)
        words += [f"z{rng.randrange(99)}" if rng.random() < rate else w for w in item[a : a + rng.randint(6, 40)]]
        docs.append((i, words + [f"w{rng.randrange(30)}" for _ in range(rng.randrange(20))]))

    def most(words, item):
        if len(item) < decontamination.SPAN:
            return len(item) if any(words[i : i + len(item)] == item for i in range(len(words))) else 0
        best, least = 0, min(decontamination.LEAST, len(item))
        for at in range(-len(item), len(words)):
            flags = [0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(item)]
            for a in range(len(flags)):
                n = run = 0
                for b in range(a, len(flags)):
                    n, run = n + flags[b], 0 if flags[b] else run + 1
                    if run >= decontamination.GAP or not flags[a]:
                        break
                    if flags[b] and n >= least and n >= decontamination.SHARE * (b - a + 1):
                        best = max(best, n)
        return best

    want = {(i, k): n for i, words in docs for k, item in enumerate(items) if (n := most(words, item))}
    found = decontamination.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_words for r in found.collect()}
    assert got == want and 10 < len(want) < 60


def test_native_operator_has_no_python(docs, spark):
    plan = decontamination.judge(docs, read_table(spark, SF_DIR, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_stages(spark):
    docs = read_table(spark, SF_DIR, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "pseudonyms", "packing"]
    from loomfeed.llm.common import stage_table

    before, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage_table(stage(spark, before, SF_DIR), name)
        assert after.columns == docs.columns
        counts.append(after.count())
        if name == "near_duplicates":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == set(want.values())
        before = after
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] and counts[1] > 0.98 * counts[0]
    packed = packing.pack_documents(before)
    ran = corpus_pipeline.run(spark, SF_DIR)
    total = lambda df: df.agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert total(ran) == total(packed) and ran.columns == packed.columns


def test_pipeline_bears_nulls_repeats_and_empty_tables(spark, tmp_path):
    base = read_table(spark, SF_DIR, "documents").limit(80)
    text = base.where("lang = 'en' and length(text) > 300").first().text
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "\u00b2 \u00bd 12 %", None, "s", 9), (None, text + " with a null key", None, None, None), (None, text + " with a null key", None, None, None), (9004, "x" * 200_000, "en", "s", 1), (9005, text, "en", "s", 1), (9005, text, "en", "s", 1), (9006, text, "en", "s", 1)]
    rows = base.unionByName(spark.createDataFrame(odd, base.schema))
    for name, docs in (("some", rows), ("none", rows.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        read_table(spark, SF_DIR, "benchmark").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert not kept & {9001, 9002, 9003, 9006} and len(kept) > 30  # no letters; copies of a document with a smaller key
    assert None in kept  # a row with a null key cannot be named by another
    assert all(r.n == r.total for r in got.where("doc_id is not null").groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("total")).collect())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from tests.parity import connect, difference

    assert difference(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.ORACLE_SQL[name]) == ""
