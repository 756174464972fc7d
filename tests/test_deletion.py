"""Deleted snapshots against the contents that others hold, one by one."""

import random

import pytest

from loomfeed.operators import snapshots

KINDS = ("identity_key", "strict_key", "composite_key", "text_key")
SNAPSHOTS = "item_key string, snapshot_id string, capture_time string, imported_at string, source_file string, extracted_count string"
CONTENTS = "item_key string, snapshot_id string, identity_key string, strict_key string, composite_key string, text_key string"
SIGHTS = ("first_seen_snapshot_id", "first_seen_at", "source_file_first", "last_seen_snapshot_id", "last_seen_at", "source_file_last")
MASTER = f"content_id string, item_key string, identity_key string, strict_key string, composite_key string, text_key string, {', '.join(f'{c} string' for c in SIGHTS)}, is_active boolean"


def frames(spark, snaps, contents, master, gone):
    rows = [(*m, *["old"] * len(SIGHTS), False) for m in master]
    return spark.createDataFrame(rows, MASTER), spark.createDataFrame(contents, CONTENTS), spark.createDataFrame([(*s, "f" + s[1], "1") for s in snaps], SNAPSHOTS), spark.createDataFrame([(g,) for g in gone], "snapshot_id string")


def one_by_one(snaps, contents, master, gone):
    """content_id: (first, last, is_active) of what stays; None for contents of other items, which stay as they are."""
    touched, out = {s[0] for s in snaps if s[1] in gone}, {}
    for content_id, item, *keys in master:
        if item not in touched:
            out[content_id] = None
            continue
        left = sorted((s for s in snaps if s[0] == item and s[1] not in gone), key=lambda s: (s[2] or "", s[3] or "", s[1]))
        for i in range(len(KINDS)):
            own = [s for s in left if keys[i].strip() and any(c[0] == item and c[1] == s[1] and c[2 + i].strip() == keys[i].strip() for c in contents)]
            if own:
                out[content_id] = (own[0][1], own[-1][1], own[-1] == left[-1])
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_what_stays_of_a_master(spark, seed):
    """Keys that several contents share, keys with white space, times that do not read, and items that keep all or nothing."""
    rng = random.Random(seed)
    snaps = [(f"i{k % 5}", f"s{k:02d}", rng.choice(["", "2026-07-01", *[f"2026-07-{d:02d} 10:00:00" for d in range(2, 6)]]), rng.choice(["", "2026-08-01 00:00:00", "2026-08-02 00:00:00"])) for k in range(30)]
    snaps = [(i, s, t and (t + " 00:00:00")[:19], m) for i, s, t, m in snaps]
    gone = {s[1] for s in snaps if (s[0] != "i4" and rng.random() < 0.4) or s[0] == "i3"}
    key = lambda kind, n: rng.choice(["", " ", f"{kind}{rng.randrange(n)}"])
    contents = [(s[0], s[1], key("i", 9), key("n", 4), f"c{rng.randrange(12)}", f" t{rng.randrange(8)}") for s in snaps for _ in range(4)]
    master = [(f"m{k}", f"i{k % 5}", key("i", 9), key("n", 4), f"c{rng.randrange(12)}", f"t{rng.randrange(8)} ") for k in range(80)] + [("bare", "i0", "", "", " ", "")]
    want, args = one_by_one(snaps, contents, master, gone), frames(spark, snaps, contents, master, gone)
    got = {r.content_id: r for r in snapshots.delete_from_master(*args).collect()}
    assert set(got) == set(want) and "bare" not in got
    for c, sight in want.items():
        told = (got[c].first_seen_snapshot_id, got[c].last_seen_snapshot_id, got[c].is_active)
        assert told == (sight or ("old", "old", False)) and (sight is None or got[c].source_file_last == "f" + sight[1])
    impact = {r.snapshot_id: r for r in snapshots.deletion_impact(*args).collect()}
    assert set(impact) == gone
    for r in impact.values():
        lost, rest = sum(m[1] == r.item_key and m[0] not in want for m in master), sum(s[0] == r.item_key and s[1] not in gone for s in snaps)
        assert (r.removed_content_count, r.remaining_snapshot_count, r.removes_product) == (lost, rest, rest == 0)


def test_a_key_counts_in_snapshots_of_its_own_item(spark):
    """A content stays by its text, though its better key is stored under a snapshot of another item."""
    snaps = [("a", "s1", "2026-07-01 00:00:00", ""), ("a", "s2", "2026-07-02 00:00:00", ""), ("b", "s3", "2026-07-03 00:00:00", ""), ("b", "s4", "2026-07-04 00:00:00", "")]
    contents = [("a", "s1", "", "n", "", "t"), ("a", "s2", "", "", "", "t"), ("a", "s3", "", "n", "", "")]
    args = frames(spark, snaps, contents, [("m", "a", "", "n", "", "t")], ["s1", "s4"])
    assert [(r.content_id, r.last_seen_snapshot_id, r.is_active) for r in snapshots.delete_from_master(*args).collect()] == [("m", "s2", True)]


def test_a_key_of_many_contents_and_snapshots_is_not_expanded(spark):
    """300 contents share one key that 300 snapshots hold: rows between stages are hundreds, not 300 times 300."""
    n, store = 300, spark.sparkContext._jsc.sc().statusStore()
    snaps = [("a", f"s{k:03d}", f"2026-{k // 28 + 1:02d}-{k % 28 + 1:02d} 00:00:00", "") for k in range(n + 1)]
    args = frames(spark, snaps, [("a", f"s{k:03d}", "", "n", f"c{k}", f"t{k}") for k in range(n)], [(f"m{k}", "a", "", "n", f"c{k}", f"t{k}") for k in range(n)], ["s300"])

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = written()
    try:
        for name in names:
            spark.conf.set(name, "-1")
        got = snapshots.delete_from_master(*args).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(got) == n and {(r.first_seen_snapshot_id, r.last_seen_snapshot_id, r.is_active) for r in got} == {("s000", "s299", True)}
    assert max(w for stage, w in written().items() if stage not in before) < 10 * n
