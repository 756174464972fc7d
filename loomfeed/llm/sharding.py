"""Sharding by balanced label propagation (operator 8).

Documents of equal text are linked; a group of them larger than a shard is cut into as many units as it needs, others are one
unit.  Every document starts in a shard by hash.  In each round a joined table of the units' shards tells where most of a
unit's documents are, and units whose documents lie apart move there as far as quotas allow: a shard takes in no more than its
free room and what leaves it.  A unit moves as a whole or stays.

Then a law is made exact.  By `rows`, counts are at most one apart.  Units are placed before all others: each in the shard of
most of its documents, the largest first, as long as it fits; those that do not fit go whole to shards with room.  Documents
without links fill what is left, in their own shard where it has room.  So a unit is cut only where no shard has room for it,
which takes a corpus of little else than large groups.

Defined cases: null text counts as empty; null and repeated keys are kept, a row each; other columns are not read; an empty
table gives no rows; with fewer rows than shards, the first shards have one each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, read_table, stage_table

SHARDS, ROUNDS, SLACK = 16, 6, 0.05
#: A piece of a group that is larger than a shard is to have this share of one, about.
PIECE_SHARE = 0.9
UNIT = ["g1", "g2", "piece"]


def _by(table: list[float], index) -> F.Column:
    return F.get(F.array(*map(F.lit, table)), index)


def _loads(rows: DataFrame, shards: int, size: str | None = None) -> list[int]:
    out = [0] * shards
    for label, n in rows.groupBy("label").agg(F.sum(size) if size else F.count("*")).collect():  # a row for each shard
        out[label] = n
    return out


def _majority(cells: DataFrame, round_: int) -> DataFrame:
    """UNIT and target, the shard of most of its documents."""
    tie = F.xxhash64(F.lit(round_), *UNIT, "label")
    return cells.groupBy(*UNIT).agg(F.max(F.struct("n", tie.alias("tie"), "label")).alias("best")).select(*UNIT, F.col("best.label").alias("target"))


def propagate(cells: DataFrame, fixed: list[int], shards: int, rounds: int) -> DataFrame:
    """cells (UNIT, label, n: documents of a unit in a shard) moved towards the neighbours' shards; fixed: documents without
    links in each shard."""
    for k in range(rounds):
        loads = [a + b for a, b in zip(fixed, _loads(cells, shards, "n"), strict=True)]
        wish = stage_table(cells.join(_majority(cells, k), UNIT), "wishes")
        flows = wish.where("label <> target").groupBy("label", "target").agg(F.sum("n").alias("n")).collect()  # shards**2 rows at most
        if not flows:
            break
        room = sum(loads) / shards * (1 + SLACK)
        into, outof = [0] * shards, [0] * shards
        for label, target, n in flows:
            into[target] += n
            outof[label] += n
        share = [min(1.0, max(0.0, room - loads[s] + outof[s]) / into[s]) if into[s] else 1.0 for s in range(shards)]
        lot = F.pmod(F.xxhash64(F.lit(-k - 1), *UNIT), F.lit(1_000_000)) / 1_000_000
        label = F.when(lot < _by(share, F.col("target")), F.col("target")).otherwise(F.col("label")).alias("label")
        cells = stage_table(wish.select(*UNIT, label, "n").groupBy(*UNIT, "label").agg(F.sum("n").alias("n")), "cells")
    return cells


def running(rows: DataFrame, parts: int, group: str, order: list, size: str) -> DataFrame:
    """rows with before: the sum of size over the rows of the same group that come first by order.  Rows are sorted in ranges;
    what lies in the ranges before is added, so that no task holds a group."""
    placed = stage_table(rows.repartitionByRange(parts, group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    starts, seen = [], {}
    for part, g, n in sorted(placed.groupBy("range", group).agg(F.sum(size)).collect()):  # ranges and groups together
        starts.append((part, g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + n
    starts = rows.sparkSession.createDataFrame(starts, f"range int, {group} int, start long")
    inside = F.sum(size).over(Window.partitionBy("range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["range", group]).withColumn("before", F.col("inside") + F.col("start")).drop("range", "inside", "start")


def place_units(cells: DataFrame, size: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """UNIT and label of the units that have a shard for all of their documents, and the documents of such units in each shard.
    A round of those that found no room lays them, largest first, along the rooms of the shards, largest first; one that lies
    across the end of a room goes on to the next round, until a round places none."""
    shards = len(size)
    sizes = cells.groupBy(*UNIT).agg(F.sum("n").alias("n"))
    units = sizes.join(_majority(cells, ROUNDS), UNIT).select(*UNIT, "n", F.col("target").alias("label"))
    order = [F.desc("n"), *UNIT]
    ranked = running(units, parts, "label", order, "n")
    fits = F.col("before") + F.col("n") <= _by(size, F.col("label"))
    ranked = stage_table(ranked.select(*UNIT, "n", "label", fits.alias("fits")), "units")
    done, left = [ranked.where("fits").select(*UNIT, "label", "n")], ranked.where("not fits")
    used = _loads(done[0], shards, "n")
    while left.limit(1).count():
        rooms = sorted(((size[s] - used[s], s) for s in range(shards)), reverse=True)
        ranked = running(left.select(*UNIT, "n", F.lit(0).alias("label")), parts, "label", order, "n")
        target, at = F.lit(None).cast("int"), 0
        for room, s in rooms:
            target = F.when((F.col("before") >= at) & (F.col("before") + F.col("n") <= at + room), F.lit(s)).otherwise(target)
            at += room
        ranked = stage_table(ranked.select(*UNIT, "n", target.alias("label")), "units")
        placed, left = ranked.where("label is not null").select(*UNIT, "label", "n"), ranked.where("label is null")
        more = _loads(placed, shards, "n")
        if not any(more):
            break
        used = [a + b for a, b in zip(used, more, strict=True)]
        done.append(placed)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return stage_table(out.select(*UNIT, F.col("label").alias("home")), "homes"), used


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null) of each document."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit("")).alias("content")
    rows = docs.select(F.col(key).alias("doc_id"), content, F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "row", (F.octet_length("content") + F.lit(1).cast("long")).alias("size"), F.crc32(F.col("content").cast("binary")).alias("text_crc32"), F.xxhash64("content").alias("g1"))
    rows = rows.withColumn("g2", F.col("size") * (1 << 32) + F.col("text_crc32")).withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    rows = stage_table(rows, "rows")
    total = rows.count()
    parts = parts_for(spark, 64 * total)
    size = [total // shards + (s < total % shards) for s in range(shards)]
    per_shard = max(1, total // shards)
    pieces = F.when(F.col("n") <= per_shard, 1).otherwise(F.ceil(F.col("n") / max(1.0, PIECE_SHARE * per_shard)))
    groups = stage_table(rows.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1").select("g1", "g2", pieces.alias("pieces")), "groups")
    linked = stage_table(rows.join(groups, ["g1", "g2"]).select("row", "g1", "g2", F.pmod(F.xxhash64(F.lit(7), "row"), "pieces").alias("piece"), "label"), "linked")
    fixed = [a - b for a, b in zip(_loads(rows, shards), _loads(linked, shards), strict=True)]
    cells = stage_table(linked.groupBy(*UNIT, "label").agg(F.count("*").alias("n")), "cells")
    homes, used = place_units(propagate(cells, fixed, shards, rounds), size, parts)
    at_home = linked.join(homes, UNIT).select("row", "piece", "home")
    # Number the documents of each shard: those of units (even groups), then, where room is left, those without (odd groups).
    merged = rows.join(at_home, "row", "left").withColumn("lane", F.when(F.col("home").isNotNull(), 2 * F.col("home")).otherwise(2 * F.col("label") + 1)).withColumn("one", F.lit(1))
    ranked = running(merged, parts, "lane", ["g1", "g2", "piece", "row"], "one")
    room = [a - b for a, b in zip(size, used, strict=True)]
    free = [0] * shards
    for label, n in merged.where("home is null").groupBy("label").count().collect():  # a row for each shard
        free[label] = n
    before, run = [], 0  # documents beyond their shard's room, numbered over all shards
    for s in range(shards):
        before.append(run)
        run += max(0, free[s] - room[s])
    over = (F.col("before") - _by(room, F.col("label")) + _by(before, F.col("label"))).cast("long")
    shard, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        gap = max(0, room[s] - free[s])
        inside = (F.col("over") >= at) & (F.col("over") < at + gap)
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, F.col("over") - at + used[s] + free[s]).otherwise(slot)
        at += gap
    home, stays = F.col("home").isNotNull(), F.col("before") < _by(room, F.col("label"))
    shard = F.when(home, F.col("home")).when(stays, F.col("label")).otherwise(shard)
    slot = F.when(home, F.col("before")).when(stays, F.col("before") + _by(used, F.col("label"))).otherwise(slot)
    return ranked.withColumn("over", over).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_label_propagation(spark, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
