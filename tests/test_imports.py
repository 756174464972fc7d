"""Batch imports against captures taken in turn, by hand."""

import random

import pytest
from pyspark.sql import functions as F

from loomfeed.operators import imports
from tests.test_golden import MASTER, SNAPSHOTS, capture

ROWS = "project_id string, item_key string, snapshot_id string, capture_time string, source_file string, file_hash string, seq int, identity_key string, strict_key string, composite_key string, text_key string, user_name_masked string, content_time string, sku string, parent_text_clean string"


def by_turns(master, stored, rows, allow):
    """Captures of each item one after the other, each compared with what the ones before left.  master: dicts; stored: (item, hash, time)."""
    master, stored, log = [dict(m) for m in master], list(stored), {}
    captures = {}
    for r in rows:
        captures.setdefault((r["capture_time"] or "", r["snapshot_id"], r["item_key"]), []).append(r)
    for (time, snapshot, item), own in sorted(captures.items()):
        latest = max((t for i, _, t in stored if i == item and t), default="")
        late = bool(time) and time < latest
        if own[0]["file_hash"] and any(i == item and h == own[0]["file_hash"] for i, h, _ in stored):
            log[snapshot] = "duplicate_file"
            continue
        if late and not allow:
            log[snapshot] = "rejected"
            continue
        stored.append((item, own[0]["file_hash"], time))
        before, hits, counts = [m for m in master if m["item_key"] == item], set(), {"new": 0, "existing": 0, "uncertain": 0}
        for r in own:
            bare = not (r["user_name_masked"] or r["content_time"] or r["sku"] or r["parent_text_clean"])
            found = None
            for key in ("strict_key", "composite_key"):
                held = [m for m in before if r[key] and m[key] == r[key]]
                found = found or (max(held, key=lambda m: m["seq"]) if held else None)
            if found:
                counts["existing"] += 1
                hits.add(found["content_id"])
            elif bare and any(r["text_key"] and m["text_key"] == r["text_key"] for m in before):
                counts["uncertain"] += 1
            else:
                counts["new"] += 1
                master.append({k: r[k] for k in ("item_key", "strict_key", "composite_key", "text_key", "seq")} | {"content_id": f"{snapshot}|{r['seq']}", "first": snapshot, "last": snapshot, "active": not late})
        for m in before if not late else []:
            m["active"] = m["content_id"] in hits
            m["last"] = snapshot if m["active"] else m["last"]
        log[snapshot] = counts
    return master, log


def random_batch(seed, n_captures, n_items=2):
    """Keys that meet in chains: strict and composite keys are drawn apart from each other; seqs are unique."""
    rng, rows, seq = random.Random(seed), [], 0
    for k in range(n_captures):
        item, time = f"i{rng.randrange(n_items)}", rng.choice(["", *[f"2026-07-{d:02d} 10:00:00" for d in range(1, 25)]])
        for _ in range(rng.randrange(1, 9)):
            seq += 1
            bare = rng.random() < 0.5
            rows.append({"project_id": "p", "item_key": item, "snapshot_id": f"s{k:03d}", "capture_time": time, "source_file": f"s{k}.html", "file_hash": rng.choice(["", f"h{rng.randrange(n_captures)}"]) if not rows or rows[-1]["snapshot_id"] != f"s{k:03d}" else rows[-1]["file_hash"], "seq": seq, "identity_key": f"id{seq}",
                "strict_key": rng.choice(["", "", f"n{rng.randrange(12)}"]), "composite_key": f"c{rng.randrange(14)}", "text_key": f"t{rng.randrange(10)}", "user_name_masked": "" if bare else "u", "content_time": "", "sku": "", "parent_text_clean": ""})
    return rows


def frame(spark, rows):
    names = [c.split()[0] for c in ROWS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ROWS)


def told(out):
    """Contents by the capture and place that brought them, and what became of each capture."""
    brought = {r.content_id: f"{r.snapshot_id}|{r.seq}" for r in out["compared"].where("status = 'new'").select(imports.new_content_id(F.col("snapshot_id"), F.col("identity_key"), F.col("seq")).alias("content_id"), "snapshot_id", "seq").collect()}
    master = sorted((brought.get(r.content_id, r.content_id), r.first_seen_snapshot_id, r.last_seen_snapshot_id, r.is_active) for r in out["content_master"].collect())
    log = {r.snapshot_id: r.result if r.result in ("duplicate_file", "rejected", "failed") else {"new": r.new_count, "existing": r.existing_count, "uncertain": r.uncertain_count} for r in out["results"].collect()}
    return master, log


@pytest.mark.parametrize("seed, allow", [(1, False), (2, True), (3, True)])
def test_a_batch_leaves_what_turns_leave(spark, seed, allow):
    old, new = random_batch(seed, 4), [{**r, "snapshot_id": "b" + r["snapshot_id"], "seq": r["seq"] + 1000} for r in random_batch(seed + 50, 24)]
    stored = [{**r, "content_id": f"m{r['seq']}", "first": "s", "last": "s", "active": True} for r in old]
    captured = sorted({(r["item_key"], r["file_hash"], "2026-07-09 10:00:00") for r in old})
    tables = {
        "content_master": spark.createDataFrame([(m["content_id"], "p", m["item_key"], m["identity_key"], m["strict_key"], m["composite_key"], m["text_key"], "s", "", "s", "", "", "", True, m["seq"]) for m in stored], MASTER),
        "snapshots": spark.createDataFrame([("p", i, f"old{k}", h, t, t, "f", "1") for k, (i, h, t) in enumerate(captured)], SNAPSHOTS),
    }
    out = imports.import_batch(tables, frame(spark, new).repartition(3), allow_backfill=allow)
    master, log = by_turns(stored, captured, new, allow)
    got, got_log = told(out)
    assert got_log == log
    assert got == sorted((m["content_id"], m["first"], m["last"], m["active"]) for m in master)
    # What an uncertain content may be: the first by seq of its text, in captures before it.
    assert all(r.master_content_id for r in out["compared"].where("status != 'new'").collect())
    assert out["review_queue"].count() == sum(x["uncertain"] for x in log.values() if isinstance(x, dict))


def test_a_thousand_captures_of_one_item(spark):
    rows = [{**r, "item_key": "i", "snapshot_id": f"s{k:04d}", "capture_time": f"2026-{1 + k // 84:02d}-{1 + k // 3 % 28:02d} {k % 3 + 1:02d}:00:00", "file_hash": f"h{k}", "seq": 10 * k + j} for k in range(1000) for j, r in enumerate(random_batch(k % 7, 1, 1))]
    kept_tables = []
    keep = lambda df: kept_tables.append(0) or imports.kept(df)
    out = imports.import_batch({"content_master": spark.createDataFrame([], MASTER), "snapshots": spark.createDataFrame([], SNAPSHOTS)}, frame(spark, rows), keep=keep)
    master, log = by_turns([], [], rows, False)
    assert len(kept_tables) < 30  # whatever the number of captures
    got, got_log = told(out)
    assert got_log == log and got == sorted((m["content_id"], m["first"], m["last"], m["active"]) for m in master)


def test_failed_captures_stand_alone(spark):
    good = capture(spark, "ABC", "s1", "2026-07-01", "h1")
    bad = [
        capture(spark, "AX", "s2", "2026-07-02", "h2").withColumn("capture_time", F.lit("yesterday")), capture(spark, "AY", "s3", "2026-07-02", "h3").withColumn("item_key", F.lit(" ")),
        capture(spark, "AZ", " ", "2026-07-02", "h4"), capture(spark, "AB", "s5", "2026-07-02", "h5").unionByName(capture(spark, "AB", "s5", "2026-07-02", "h6")),
    ]
    batch = good.withColumn("error", F.lit(None).cast("string"))
    for b in bad:
        batch = batch.unionByName(b, allowMissingColumns=True)
    batch = batch.unionByName(capture(spark, "Q", "s7", "2026-07-03", "h7").withColumn("error", F.lit("not a page")))
    tables = {"content_master": spark.createDataFrame([], MASTER), "snapshots": spark.createDataFrame([], SNAPSHOTS)}
    out = imports.import_batch(tables, batch)
    assert sorted((r.snapshot_id, r.error) for r in out["rejects"].where("status = 'failed'").collect()) == [(" ", "missing_snapshot"), ("s2", "unreadable_time"), ("s3", "missing_item"), ("s5", "ambiguous_snapshot"), ("s7", "not a page")]
    assert out["content_master"].count() == 3 and [r.snapshot_id for r in out["snapshots"].collect()] == ["s1"]
    results = {r.snapshot_id: r for r in out["results"].collect()}
    assert results["s1"].result == "success" and results["s1"].new_count == 3 and results["s7"].result == "failed" and len(results) == 6
    assert imports.import_batch(tables, batch.limit(0))["results"].count() == 0


def test_only_contents_that_something_else_holds_are_compared(spark):
    """Of 300 contents in three captures one is stored and two come again; the rest are new without a look at any other."""
    keys = lambda x: {"identity_key": x, "strict_key": "", "composite_key": f"c{x}", "text_key": f"t{x}"}
    blank = {"user_name_masked": "", "content_time": "", "sku": "", "parent_text_clean": ""}
    rows = [{"project_id": "p", "item_key": "i", "snapshot_id": f"s{k}", "capture_time": f"2026-07-0{k + 1} 10:00:00", "source_file": f"s{k}.html", "file_hash": f"h{k}", "seq": 100 * k + j, **keys(str(100 * k + j)), **blank} for k in range(3) for j in range(100)]
    rows[150] |= keys("7")  # of the first capture
    rows[250] |= {**keys("8"), "composite_key": "other"}  # its text alone
    stored = [{**rows[60], "content_id": "m1", "seq": -1, "first": "s", "last": "s", "active": True}, {**rows[60], **keys("x"), "content_id": "m2", "seq": -2, "first": "s", "last": "s", "active": True}]
    master = spark.createDataFrame([(m["content_id"], "p", "i", m["identity_key"], m["strict_key"], m["composite_key"], m["text_key"], "s", "", "s", "", "", "", True, m["seq"]) for m in stored], MASTER)
    asked = []
    keep = lambda df: (asked.append(df.count()) if "found" in df.columns else None, imports.kept(df))[1]
    out = imports.import_batch({"content_master": master, "snapshots": spark.createDataFrame([], SNAPSHOTS)}, frame(spark, rows), keep=keep)
    want, log = by_turns(stored, [], rows, False)
    got, got_log = told(out)
    assert got_log == log and got == sorted((m["content_id"], m["first"], m["last"], m["active"]) for m in want)
    assert asked and max(asked) <= 5
    assert {"_alone", "_latest", "_own_id"}.isdisjoint(out["compared"].columns) and out["compared"].count() == 300


def test_counts_and_problems_of_a_capture_whose_rows_differ(spark):
    """Rows of one capture from several files are counted as one capture; one with two times is ambiguous, an unreadable one tells first."""
    rows = [{**r, "snapshot_id": s, "file_hash": "h" + s, "capture_time": t, "source_file": f} for r, s, t, f in zip(random_batch(3, 40, 1), ["a", "a", "b", "b", "c", "c"], ["2026-07-01", "2026-07-01", "2026-07-02", "2026-07-03", "2026-07-04", "no time"], ["f1", "f2", "f", "f", "f", "f"], strict=False)]
    states = {r.snapshot_id: r for r in imports.capture_states(frame(spark, rows), spark.createDataFrame([], SNAPSHOTS)).collect()}
    assert [(states[s].extracted_count, states[s].source_file, states[s].error) for s in "abc"] == [(2, "f2", None), (2, "f", "ambiguous_snapshot"), (2, "f", "unreadable_time")]
