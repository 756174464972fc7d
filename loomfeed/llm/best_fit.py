"""Best-fit packing by a grouping genetic algorithm (operator 12).

Documents become ids.  What is longer than a window is cut into whole windows, which stand alone; the rests are bins' items.  They
are dealt at random to groups of a bounded number.  Each group is packed by islands: each holds some packings, made by best fit in
random orders.  A child gets whole bins from one parent, the best filled ones, into a copy of the other; bins of the copy that
hold the same items again are dissolved, and so are a few of its emptiest; the displaced items go where they fit best, the
longest first.  It takes the place of the worst packing unless it is worse.  After each epoch the best packing of each island
moves on to the next one.  A group is done when an island needs no more bins than the items' sum asks for.

Full bins are final.  The items of all others are dealt anew, in fewer groups, for as long as that saves sequences; so what the
groups lose at their ends comes together, and no task ever has more than one group.

Islands, epochs and rounds are rows of staged tables: a packing is an array of an island's row, repeatable from its seed, and a
lost executor's islands evolve again with the same outcome.

Defined cases: null text is empty (its ids: the end id alone); null and repeated keys are kept, each row packed by itself; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, read_table, stage_table
from .tokens import WordTokenizer, default_tokenizer

WINDOW, END_ID = 2048, 0
#: Items in a group; islands of a group, packings of an island, children in an epoch, epochs of a round, rounds.
GROUP, ISLANDS, MEMBERS, CHILDREN, EPOCHS, ROUNDS = 4096, 3, 4, 32, 3, 8
#: Shares, at most: of a parent's bins that a child gets, of its own bins that are dissolved for being the emptiest, and at random.
INJECTED, EMPTIEST, ANY = 0.6, 0.1, 0.2
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def encode_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, with their ids if these are asked for."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = WordTokenizer.of(tokenizer)
        for batch, texts in batches(it):
            ids, offsets = t.encode(texts, end_id)
            sizes = np.diff(offsets)
            n = -(-sizes // window)
            owner = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * window
            length = np.minimum(sizes[owner] - start, window)
            data, at = memoryview(ids.astype("<u4").tobytes()), (offsets[owner] + start)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            own = [pa.ListArray.from_arrays(np.append(at, offsets[-1]).astype(np.int32), ids.astype(np.int32))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *own], COLUMNS + ["ids"] * with_ids)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def place(sizes: list[int], order: list[int], bins: np.ndarray, rooms: list[int], window: int) -> None:
    """Best fit of the items in this order: each goes where it leaves the least room, else into a new bin.  rooms: of the bins so
    far, extended here; bins gets the items' places.  Bins of a room are on a stack, and a bit for each room finds the least one."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, room in enumerate(rooms):
        if room:
            stacks.setdefault(room, []).append(b)
            mask |= 1 << room
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, b = window, len(rooms)
            rooms.append(window)
        bins[i] = b
        room -= size
        rooms[b] = room
        if room:
            stacks.setdefault(room, []).append(b)
            mask |= 1 << room


def worth(bins: np.ndarray, sizes: np.ndarray, window: int) -> tuple[int, float]:
    """The number of bins, and the mean square of their fill (negative): the less, the better."""
    fill = np.bincount(bins, weights=sizes) / window
    return len(fill), -float(np.mean(fill * fill))


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two packings: whole bins of b, the best filled, in a's place of them."""
    n = int(b.max()) + 1
    fill = np.bincount(b, weights=sizes)
    chosen = np.zeros(n, dtype=bool)
    chosen[np.lexsort((rng.random(n), -fill))[: max(1, round(rng.random() * INJECTED * n))]] = True
    injected = chosen[b]
    gone = np.zeros(int(a.max()) + 1, dtype=bool)
    gone[a[injected]] = True  # these hold an item again
    own = np.bincount(a, weights=sizes)
    own[gone] = window + 1
    gone[np.lexsort((rng.random(len(own)), own))[: 1 + round(rng.random() * EMPTIEST * len(own))]] = True
    gone |= rng.random(len(gone)) < rng.random() * ANY
    child = np.full(len(a), -1, dtype=np.int64)
    stays = ~injected & ~gone[a]
    label = np.concatenate([np.cumsum(~gone) - 1, np.count_nonzero(~gone) + np.cumsum(chosen) - 1])
    child[stays] = label[a[stays]]
    child[injected] = label[len(gone) + b[injected]]
    rooms = (window - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=int(np.count_nonzero(~gone) + np.count_nonzero(chosen)))).astype(np.int64).tolist()
    displaced = np.flatnonzero(child < 0)
    place(sizes.tolist(), displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))].tolist(), child, rooms, window)
    return np.unique(child, return_inverse=True)[1]  # no empty bins


def evolve(sizes: np.ndarray, members: list[np.ndarray], seed: list[int], window: int = WINDOW, n_members: int = MEMBERS, children: int = CHILDREN) -> list[np.ndarray]:
    """The packings of an island after an epoch, the best first.  Without any, it makes its first ones."""
    rng, least = np.random.default_rng(seed), -(-int(sizes.sum()) // window)
    members, plain = list(members), sizes.tolist()
    while len(members) < n_members:
        bins, rooms = np.zeros(len(sizes), dtype=np.int64), []
        place(plain, rng.permutation(len(sizes)).tolist(), bins, rooms, window)
        members.append(bins)
    ranked = sorted(((worth(x, sizes, window), i, x) for i, x in enumerate(members)), key=lambda x: x[:2])[:n_members]
    for i in range(children):
        if ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False).tolist()
        child = cross(ranked[a][2], ranked[b][2], sizes, window, rng)
        value = worth(child, sizes, window)
        if value <= ranked[-1][0] and all(value != x[0] for x in ranked):
            ranked = sorted([*ranked[:-1], (value, n_members + i, child)], key=lambda x: x[:2])
    return [x[2] for x in ranked]


STATE = "group long, island int, sizes array<int>, members array<array<int>>, bins int, fill double, least int"


def epoch(state: DataFrame, number: int, window: int) -> DataFrame:
    """Each island (a row: group, island, sizes, members) after an epoch of its own."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                group, island, sizes, members = (batch.column(c)[i] for c in range(4))
                own = sizes.values.to_numpy().astype(np.int64)
                found = evolve(own, [x.values.to_numpy().astype(np.int64) for x in members.values] if members.is_valid else [], [number, group.as_py(), island.as_py()], window)
                bins, fill = worth(found[0], own, window)
                packings = pa.array([[x.astype(np.int32) for x in found]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array([group.as_py()]), pa.array([island.as_py()], pa.int32()), pa.array([sizes.values], pa.list_(pa.int32())), packings, pa.array([bins], pa.int32()), pa.array([fill]), pa.array([-(-int(own.sum()) // window)], pa.int32())], names)

    return map_arrow(state.select(*names[:4]), run, STATE)


def pack_round(items: DataFrame, count: int, number: int, window: int) -> DataFrame:
    """unit, sequence, offset and fill of each item (unit, length): groups, islands, epochs with migration between them."""
    spark = items.sparkSession
    groups = -(-count // GROUP)
    of_group = F.pmod(F.xxhash64("unit", F.lit(number)), F.lit(groups)).alias("group")
    dealt = items.groupBy(of_group).agg(F.sort_array(F.collect_list(F.struct("unit", F.col("length").cast("int").alias("length")))).alias("items"))  # GROUP items, about
    dealt = stage_table(dealt.select("group", F.col("items.unit").alias("units"), F.col("items.length").alias("sizes")), "groups")
    islands = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups * ISLANDS // 64))
    state = dealt.select("group", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.lit(None).cast("array<array<int>>").alias("members"))
    finished: DataFrame | None = None
    for e in range(EPOCHS):
        # Few rows and long work: a fixed number of partitions, which are not merged by their bytes.
        state = stage_table(epoch(state.repartition(islands, "group", "island"), EPOCHS * number + e, window), "islands")
        opened = state.groupBy("group").agg(F.min(F.col("bins") - F.col("least")).alias("over")).where("over > 0").select("group")
        best = state if e == EPOCHS - 1 else state.join(opened, "group", "left_anti")
        finished = best if finished is None else finished.unionByName(best)
        if e == EPOCHS - 1 or opened.isEmpty():
            break
        elite = state.select("group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("members", F.lit(0)).alias("elite"))
        state = state.join(opened, "group", "left_semi").join(elite, ["group", "island"]).withColumn("members", F.concat(F.slice("members", 1, MEMBERS - 1), F.array("elite")))
    best = finished.groupBy("group").agg(F.min_by(F.get("members", F.lit(0)), F.struct("bins", "fill", "island")).alias("bins"))

    def lay(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                group = batch.column(0)[i].as_py()
                units, sizes, bins = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order], dtype=np.int64) - sizes[order]
                first = np.flatnonzero(np.diff(bins[order], prepend=-1))
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
                yield pa.RecordBatch.from_arrays([pa.array(units[order]), pa.array((number << 56) + (group << 16) + bins[order].astype(np.int64)), pa.array(offset), pa.array(fill[bins[order]])], ["unit", "sequence", "offset", "fill"])

    return stage_table(map_arrow(dealt.join(best, "group").select("group", "units", "sizes", "bins"), lay, "unit long, sequence long, offset long, fill long"), "laid")


def pack_items(items: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """unit, sequence and offset of all items (unit, length under window), None without any.  Rounds go on while they save sequences."""
    kept: DataFrame | None = None
    add = lambda more: more if kept is None else kept.unionByName(more)
    columns, count = ["unit", "sequence", "offset"], items.count()
    if not count:
        return None
    laid = pack_round(items, count, 0, window)
    for number in range(1, ROUNDS):
        full = F.col("fill") == window
        rest = laid.where(~full)
        n_items, n_bins, total = rest.agg(F.count("*"), F.count_distinct("sequence"), F.coalesce(F.sum(F.when(F.col("offset") == 0, F.col("fill"))), F.lit(0))).first()
        if n_bins <= -(-total // window) or n_items == count:  # as few as can be, or the same items again
            break
        again = pack_round(rest.join(items, "unit").select("unit", "length"), n_items, number, window)
        if again.select("sequence").distinct().count() >= n_bins:
            break
        kept, laid, count = add(laid.where(full).select(*columns)), again, n_items
    return add(laid.select(*columns))


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces (and ids, if asked for)."""
    pieces = encode_pieces(docs, tokenizer or default_tokenizer(), window, end_id, with_ids, key, text).withColumn("unit", F.monotonically_increasing_id())
    pieces = stage_table(pieces, "pieces")
    columns = COLUMNS + ["sequence_id", "offset"] + ["ids"] * with_ids
    whole = pieces.where(F.col("length") == window).withColumns({"sequence_id": -F.col("unit") - 1, "offset": F.lit(0).cast("long")}).select(*columns)
    rest = pieces.where(F.col("length") < window)
    laid = pack_items(rest.select("unit", "length"), window)
    return whole if laid is None else whole.unionByName(rest.join(laid.withColumnRenamed("sequence", "sequence_id"), "unit").select(*columns))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids of every sequence of a result with ids."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a window of ids at most
    return packed.groupBy("sequence_id").agg(pieces.alias("pieces")).select("sequence_id", F.col("pieces.doc_id").alias("doc_ids"), F.flatten("pieces.ids").alias("ids"))


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_best_fit(read_table(spark, sf_dir, "documents"))
