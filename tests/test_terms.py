"""Term indexes against a pattern a term, gates against the patterns alone, lexicons from files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import text as X
from loomfeed.functions.lexicon import PATTERNS, Lexicon, load_lexicon
from loomfeed.functions.terms import TermIndex, gated_rlike, index_of, literals_of, matched_terms
from loomfeed.operators import classify


def test_index_finds_what_patterns_find(spark):
    lexicon = Lexicon()
    kinds = {"specific": lexicon.specific, "generic": (*lexicon.generic, "C++", "Ärger", "ÄRGER", "ΑΒΓ", " 买 灯 ", "..."), "purchase": lexicon.purchase}
    rng, parts = random.Random(1), ["豆 包", "d-e·ep SEEK", "A.I.", "a i", "算法", "推荐", "智能", "买", " 灯", "c+ +", "ärger", "ÄR GER", "αβγ", "ΑΒ​Γ", "x", " ", " ", "\n", " ", "通义", "千问", "。", "入手"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(800)] + ["", "x" * 50_000 + "豆包"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    found = df.select("i", TermIndex(kinds).matches(spark, F.col("t")).alias("f"), *(X.match_terms(F.col("t"), terms).alias(k) for k, terms in kinds.items()))
    for r in found.collect():
        for k in kinds:
            # a term of nothing but what may stand between characters is in no index
            assert r.f[f"{k}_0"] == [t for t in r[k] if t != "..."], (r.i, k)


def test_ten_thousand_terms(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(13_000)})[:10_000]
    rng.shuffle(words)
    terms = spark.createDataFrame([("even" if i % 2 == 0 else "odd", w, i) for i, w in enumerate(words)], "kind string, term string, place int").repartition(4)
    texts = ["".join(rng.choices("abcdefghij .", k=rng.choice([0, 5, 300]))) for _ in range(200)]
    index = index_of(terms)
    assert sum(map(len, index.kinds.values())) == 10_000
    got = matched_terms(spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("kind_of", F.lit("clash")), "t", index).collect()
    want = [(i, kind, w) for i, t in enumerate(texts) for kind in index.kinds for w in index.kinds[kind] if w in re.sub("[ .]", "", t)]
    assert sorted((r.i, r.kind, r.term) for r in got) == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("pattern, needed", [("买之前|买前", {"买之前", "买前"}), (r"(?i)(?:^|[^a-z])Than", {"than"}), (r"a?b+c{2,}", {"b"}), (r"(?:ab|c)*x", {"x"}), (r"\d+", None), (r"(?U)\s", None), (r"[ab]zz", {"zz"}), (r"(?iu)straße", None), (r"a(?!b)", {"a"}), (r"(?:问|咨询).{0,4}客服", {"客服"}), (r"x|", None)])
def test_literals(pattern, needed):
    got = literals_of(pattern)
    assert (got and set(got)) == needed


def test_gates_change_nothing(spark):
    rng = random.Random(3)
    pieces = sorted({c for p in PATTERNS.values() for c in re.findall(r"[\w]{1,3}", p)})
    df = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randrange(1, 12))),) for _ in range(1500)], "t string")
    for name, pattern in PATTERNS.items():
        assert literals_of(pattern), name
        assert df.where(gated_rlike(F.col("t"), F.lower("t"), pattern) != F.col("t").rlike(pattern)).count() == 0, name


def test_a_lexicon_from_a_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text("ai_sources: {strong: [Oracle], generic: [engine]}\nai_actions: [asked]\npurchase_context: [bought]\ndecision_context: [worth it]\n", encoding="utf-8")
    lexicon = load_lexicon(str(tmp_path / "l.yaml"))
    df = spark.createDataFrame([("I asked oracle, then bought",), ("an en-gine. Worth  it?",), ("nothing",)], "content_text_clean string").withColumns({"content_role": F.lit("review"), "parent_text_clean": F.lit("")})
    got = [(r.evidence_level, r.ai_source_terms, r.ai_action_terms, r.decision_context_terms) for r in classify.classify(df, lexicon).collect()]
    assert got == [("A", ["Oracle"], ["asked"], []), ("B", ["engine"], [], ["worth it"]), ("", [], [], [])]


def test_texts_of_a_batch_are_not_held_at_once():
    """A worker's memory hangs on one text and on the places of terms, whatever the batch holds."""
    import tracemalloc

    import pyarrow as pa

    from loomfeed.functions.terms import TermIndex

    index = TermIndex({"a": ("two", "one"), "none": ()})
    column = pa.array([f"{'word ' * 1500}{'one two' if i % 3 else 'nothing'}" for i in range(1000)])
    index.find("one")
    tracemalloc.start()
    found = index.lists(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.to_pylist() for x in found] == [[["two", "one"] if i % 3 else [] for i in range(1000)], [[]] * 1000]
    assert peak < 1 << 20 < column.nbytes
