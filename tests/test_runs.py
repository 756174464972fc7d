"""Incremental scoring and its log, derived tables, facets, top terms and exports: small cases by hand."""

import json
import os
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomfeed.lineage import kept_columns
from loomfeed.operators import answers, assets, filters, metrics, sentiment, snapshots, tables
from loomfeed.sources import reviews
from loomfeed.streaming import landing

CONTENT = "content_id string, item_key string, content_role string, content_text_clean string, product_title string, seq int"


def scorer_for(folder):
    """Answers all but texts with "never"; leaves a file for each text that it was asked about."""

    def score(frames):
        for x in frames:
            out = []
            for prompt in x["prompt"]:
                rows = [json.loads(p) for p in prompt.split("\n")]
                for r in rows:
                    with open(f"{folder}/{r['i']}", "a") as f:
                        f.write("x")
                out.append("\n".join(json.dumps({"i": r["i"], "s": "P", "sc": 8, "p": "F", "n": "-", "c": 3}) for r in rows if "never" not in r["t"]))
            yield pd.DataFrame({"batch_id": x["batch_id"], "response": out})

    return score


def contents(spark, *rows):
    return spark.createDataFrame([(str(i), "i1", role, text, "T", i) for i, (role, text) in enumerate(rows)], CONTENT)


def test_incremental_run_asks_once_and_adds_nothing_when_repeated(spark, tmp_path):
    seen, log = tmp_path / "asked", str(tmp_path / "log")
    seen.mkdir()
    first = contents(spark, ("review", "good"), ("review", "good"), ("followup", "fine"), ("question", "why"), ("review", " "), ("review", None), ("review", "never ever"))
    run = lambda rows, update, **k: answers.incremental(rows, None, lambda: scorer_for(str(seen)), log, "p", update, "v1", **k)
    out = run(first, "u1")
    summary = out["sentiment_run_summary"].first().asDict()
    assert {k: summary[k] for k in ("status", "target_count", "llm_fast_count", "reused_count", "rule_count", "failed_count", "detail_count")} == {"status": "partial", "target_count": 4, "llm_fast_count": 3, "reused_count": 0, "rule_count": 0, "failed_count": 1, "detail_count": 0}
    assert {(r.content_id, r.sentiment_label, r.answered_in) for r in out["sentiment_fast"].collect()} == {("0", "P", "u1"), ("1", "P", "u1"), ("2", "P", "u1")}
    assert [(r.content_id, r.error_type) for r in out["sentiment_failures"].collect()] == [("6", "MissingResult")]
    assert out["sentiment_timings"].count() > 0
    asked = {n: (seen / n).read_text() for n in os.listdir(seen)}
    assert sorted(map(len, asked.values()))[:2] == [1, 1] and len(asked) == 3  # answered inputs were asked once
    stored = answers.stored(spark, log, "fast").count()
    again = run(first, "u1")
    assert again["sentiment_run_summary"].first().asDict() == summary and {n: (seen / n).read_text() for n in os.listdir(seen)} == asked
    assert answers.stored(spark, log, "fast").count() == stored == 2
    later = run(contents(spark, ("review", "good"), ("review", "new"), ("review", "never ever")), "u2")
    assert {(r.content_id, r.answered_in) for r in later["sentiment_fast"].collect()} == {("0", "u1"), ("1", "u2")}
    s = later["sentiment_run_summary"].first()
    assert (s.reused_count, s.llm_fast_count, s.failed_count, s.update_id) == (1, 1, 1, "u2")
    assert Counter(len((seen / n).read_text()) > len(asked.get(n, "")) for n in os.listdir(seen)) == {True: 2, False: 2}  # "new" and what failed
    other = answers.incremental(first, None, lambda: scorer_for(str(seen)), log, "p", "u3", "v2")
    assert other["sentiment_run_summary"].first().reused_count == 0


def test_incremental_run_without_a_scorer(spark, tmp_path):
    log, rows = str(tmp_path / "log"), contents(spark, ("review", "good"), ("review", "bad"))

    def broken():
        raise PermissionError

    off = answers.incremental(rows, None, None, log, "p", "u1")
    assert off["sentiment_run_summary"].first().status == "disabled" and off["sentiment_fast"].count() == off["sentiment_failures"].count() == 0
    lost = answers.incremental(rows, None, broken, log, "p", "u1")
    assert lost["sentiment_run_summary"].first().status == "failed_to_start"
    assert {r.error_type for r in lost["sentiment_failures"].collect()} == {"PermissionError"} and lost["sentiment_failures"].count() == 2
    assert answers.stored_runs(spark, log).count() == 0  # it may be tried again under its name
    none = answers.incremental(rows.limit(0), None, broken, log, "p", "u2")
    assert none["sentiment_run_summary"].first().status == "success"
    with pytest.raises(ValueError):
        answers.store_run(log, "../x", {})


def test_a_run_that_stopped_half_way_is_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    half = spark.createDataFrame([("h", "P", 8, "F", "-", 3, "llm_fast", "", "", "")], answers.FAST)
    half.write.parquet(f"{log}/fast/run_id=u1")
    assert answers.stored(spark, log, "fast").count() == 0
    empty = {n: spark.createDataFrame([], s) for n, s in answers.SCHEMAS.items()}
    answers.store_run(log, "u1", empty | {"fast": half.withColumn("sentiment_label", F.lit("N"))})
    answers.store_run(log, "u1", empty | {"fast": half.union(half)})  # stored already
    assert [r.sentiment_label for r in answers.answers(spark, log, "fast").collect()] == ["N"]


def test_top_terms_pass_on_few_rows_of_a_hot_key(spark):
    rows = spark.range(200_000).select((F.col("id") % 1).alias("key"), F.col("id").alias("seq"), F.array(F.concat(F.lit("t"), F.greatest(F.col("id") - 6, F.lit(0)).cast("string"))).alias("terms"))
    top = metrics.top_terms(rows, ["key"], "terms", "top", k=3)
    assert top.first().top == "t0:7;t1:1;t2:1"
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    nulls = spark.createDataFrame([(None, 1, ["b", "", "a"]), (None, 2, ["a"]), ("x", 3, None)], "key string, seq int, terms array<string>")
    assert [(r.key, r.top) for r in metrics.top_terms(nulls, ["key"], "terms", "top").collect()] == [(None, "a:2;b:1")]


def test_facets_count_under_the_other_filters(spark):
    rows = spark.createDataFrame([("a", 1, " x "), ("a", 2, "y"), ("b", 1, "x"), (None, 1, "x"), ("b", 2, ""), ("c", 3, "z")], "p string, q int, r string")
    got = {(x.facet, x.value): x.n for x in filters.facet_counts(rows, {"p": ["a"], "q": [1], "r": []}).collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 1, ("q", "1"): 1, ("q", "2"): 1, ("r", "x"): 1}
    assert filters.facet_counts(rows.limit(0), {"p": ["a"]}).count() == 0


def test_derived_tables_of_empty_and_lone_contents(spark):
    master = spark.createDataFrame([("p", "i", "c1", "answer", "x"), ("p", None, "c2", None, None), ("q", "i", "c3", "review", "y")], "project_id string, item_key string, content_id string, content_role string, content_text_clean string").withColumns({"platform": F.lit("t"), "product_title_current": F.lit("old")})
    analysis = spark.createDataFrame([("p", "i", "c1", True, "B", "a; b", "n")], "project_id string, item_key string, content_id string, ai_candidate boolean, evidence_level string, ai_source_terms string, platform string")
    products = spark.createDataFrame([("p", "i", "T", "S", "B1")], "project_id string, item_key string, product_title_current string, shop_name_current string, brand string")
    out = snapshots.derived_tables({"content_master": master, "analysis": analysis, "products": products}, "p")
    rows = {r.content_id: r for r in out["content_all"].collect()}
    assert set(rows) == {"c1", "c2"} and rows["c1"].brand == "B1" and rows["c1"].platform == "t" and rows["c1"].platform_analysis == "n" and rows["c1"].product_title == "T"
    assert (rows["c2"].ai_candidate, rows["c2"].evidence_level, rows["c2"].product_title, rows["c2"].record_type) == (False, "", "", None)
    assert [r.content_id for r in out["qa_pairs_raw"].collect()] == ["c1"] and out["reviews_raw"].count() == 0
    assert {(r.keyword, r.hit_count) for r in out["summary_by_keyword"].collect()} == {("a", 1), ("b", 1)}
    assert [tuple(r) for r in out["summary_by_evidence_level"].collect()] == [("B", 1)]
    none = snapshots.derived_tables({"content_master": master, "analysis": analysis, "products": products}, "nobody")
    assert all(df.count() == 0 for df in none.values())


def test_export_rows_carry_what_is_known(spark):
    images = spark.createDataFrame([("m1", "r1", "review", "embedded", 1), ("m2", "r1", "append", "missing", 0)], "image_id string, local_review_id string, image_stage string, extract_status string, was_new int")
    of = spark.createDataFrame([("r1", "p1", "N1", "2026-01-01", None, "good"), ("r2", "p2", None, None, None, None)], "local_review_id string, product_key string, platform_review_id string, review_time string, append_time string, review_text string")
    products = spark.createDataFrame([("p1", "tmall", "77", "Title"), ("p2", None, None, None)], "product_key string, platform string, product_id string, product_title string")
    out = assets.export_tables(images, of, products, of.select("local_review_id"), batch_id="b1", exported_at="2026-07-01")
    r = out["reviews"].first()
    assert out["reviews"].count() == 1
    assert (r.platform, r.product_id, r.product_title, r.platform_review_id, r.review_time, r.append_time, r.sku, r.review_text, r.export_total_image_count) == ("tmall", "77", "Title", "N1", "2026-01-01", "", "", "good", 2)
    assert {(p.product_key, p.platform, p.product_title, p.new_review_count, p.export_image_count) for p in out["products"].collect()} == {("p1", "tmall", "Title", 1, 2), ("p2", "", "", 1, 0)}
    assert {(x.batch_id, x.exported_at) for x in out["summary"].collect()} == {("b1", "2026-07-01")}


@pytest.mark.parametrize("bom", [True, False])
def test_csv_with_and_without_a_byte_order_mark(spark, tmp_path, bom):
    path = str(tmp_path / "out")
    rows = [("1", 'a "b", c'), ("2", "line\nbreak"), ("3", None)]
    reviews.write_csv(spark.createDataFrame(rows, "id string, t string").coalesce(1), path, bom)
    [name] = [n for n in os.listdir(path) if n.endswith(".csv")]
    data = open(f"{path}/{name}", "rb").read()
    assert data.startswith(b"\xef\xbb\xbfid,t" if bom else b"id,t")
    back = pd.read_csv(f"{path}/{name}", dtype=str, encoding="utf-8-sig", keep_default_na=False)
    assert [tuple(x) for x in back.to_numpy()] == [("1", 'a "b", c'), ("2", "line\nbreak"), ("3", "")]


def test_readers_refuse_what_holds_no_review(spark, tmp_path):
    (tmp_path / "a.csv").write_text("platform,product_id,review_text_raw\njd,1,\n")
    for read in (reviews.read_reviews_csv, reviews.read_reviews_any):
        with pytest.raises(ValueError, match="no reviews are left"):
            read(spark, str(tmp_path))
        assert read(spark, str(tmp_path), required=False).count() == 0
    (tmp_path / "b.csv").write_text("platform,product_id,review_text_raw\nJD,1,good\n")
    rows = reviews.read_reviews_any(spark, str(tmp_path), most_bytes=100)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in reviews.empty_files(files, rows).collect()] == ["a.csv"]
    with pytest.raises(ValueError, match="more than 40 bytes"):
        reviews.read_reviews_any(spark, str(tmp_path), most_bytes=40)


def test_sorts(spark):
    rows = spark.createDataFrame([("a", "2026-01-02", 3, "y"), ("b", None, None, "x"), ("c", "2026/03/01 10:00:00", 3, "x"), ("d", "nonsense", 9, None)], "item_key string, at string, review_count int, product_title string")
    names = lambda df: "".join(r.item_key for r in df.collect())
    assert names(tables.recent_first(rows, "at"))[:2] == "ca" and names(tables.largest_first(rows)) == "dcab"
    assert names(tables.stalest_first(rows.withColumn("latest", F.to_date(F.substring("at", 1, 10).try_cast("date"))).where("item_key < 'c'"))) == "ba"


@pytest.mark.parametrize("within", [None, "30 days"])
def test_stream_knows_files_of_earlier_batches_and_after_a_restart(spark, tmp_path, within):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "item string, file_hash string, at timestamp"
    put = lambda *rows: spark.createDataFrame([(i, h, datetime(2026, 7, 1)) for i, h in rows], schema).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        landing.land(landing.first_sights(stream, "item", "file_hash", time="at" if within else None, within=within), target, state).awaitTermination()
        return sorted((r.item or "", r.file_hash) for r in spark.read.schema(schema).parquet(target).collect())

    put(("i", "h"), ("i", "h"), ("j", "h"))
    assert run() == [("i", "h"), ("j", "h")]
    put(("i", "h"), ("i", "k"), (None, "k"))
    assert len(run()) == 4 and len(run()) == 4  # a run without new files adds nothing


def test_a_failing_frame_comes_out_in_one(spark):
    """Batches of a frame in which some fail are asked one by one, but what is said of them is one frame, with the lost ids."""

    def fails(frames):
        for x in frames:
            if any('"2"' in p for p in x["prompt"]):
                raise TimeoutError
            yield x.assign(response="{}")[["batch_id", "response"]]

    frame = pd.DataFrame({"batch_id": ["a", "b", "c"], "prompt": ['{"i":"1"}', '{"i":"2"}\n{"i":"3"}', '{"i":"4"}']})
    (out,) = sentiment.isolated(fails)(iter([frame]))
    assert out[["batch_id", "response", "error_type", "lost"]].values.tolist() == [["a", "{}", None, None], ["b", "", "TimeoutError", ["2", "3"]], ["c", "{}", None, None]]


def test_what_is_kept_is_read_by_column(spark):
    """A table that was kept is read for the columns that are asked for, not whole."""
    df = kept_columns(spark.range(10).withColumns({"text": F.repeat(F.lit("x"), 100), "n": F.col("id") * 2}))
    plan = df.select("n")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "text" not in plan and df.agg(F.sum("n")).first()[0] == 90
