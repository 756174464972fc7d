"""Near duplicates by circulant MinHash (operator 1).

A document's set holds the hashes of its distinct windows of WORDS words.  Two permutations give the whole signature: the first
shuffles the universe of 2**32, the second, shifted by k, orders it for coordinate k, whose value is the least shifted number in
the set.  ROWS coordinates make a band; documents that agree in one of BANDS bands are candidates; a link is confirmed by
counting the intersection of the full sets.  A pair at the least similarity that counts (0.75) shares no band with probability
(1 - 0.75**5)**48, about two in a million.

Equal word sequences are one node.  In a bucket every node is compared with one other, the hub, chosen by a hash that differs
from bucket to bucket, so that a crowd of copies costs as many rows as it has members.  The links give components; what a hub
leaves open (nodes of one bucket in different components) is compared in full, in tiles of bounded size that give back links
alone, at most one for each node and component.

Defined cases: words are runs of bytes other than white space, A-Z in lower case; a text of one to WORDS - 1 words has its whole
sequence as its one window; null or empty text has an empty set and no links; repeated keys are one document (its texts, and
what they link to, are one component); rows with a null key get the component of equal texts, or null; extra columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, distinct, map_arrow, read_table, ship, stage_table, window_hashes, word_hashes
from .components import components

WORDS = 5
BANDS, ROWS = 48, 5
#: Least similarity, in percent: 100 * intersection >= PERCENT * union.
PERCENT = 75
_STEP = 1 << 16
#: Windows and documents of a tile (two of them are compared at a time), and columns of a matrix.
TILE_WINDOWS, TILE_ROWS = 1_000_000, 1_000
#: Pairs of one hub that one copy of its set serves.
SPREAD = 20_000
_COLUMNS = 4096


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """The distinct window hashes of each text, sorted."""
    words, firsts = word_hashes([x.lower() for x in texts])
    windows, out = window_hashes(words, width), []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        out.append(distinct(windows[a : b - width + 1]) if b - a >= width else window_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def _permute(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers: x may be out."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=out)
    np.multiply(out, np.uint32(0x7FEB352D), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x846CA68B), out=out)
    np.right_shift(out, np.uint32(16), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """A row of `size` coordinates for each set, none of them empty."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= _STEP):
            total += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        firsts = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        work, spare = np.empty_like(x), np.empty_like(x)
        first = _permute(x ^ np.uint32(0x5BD1E995), np.empty_like(x), spare)  # the first permutation
        for k in range(size):
            np.subtract(first, np.uint32(k * 0x01000193 & 0xFFFFFFFF), out=work)  # the second one, shifted
            out[start:stop, k] = np.minimum.reduceat(_permute(work, work, spare), firsts)
        start = stop
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) * np.ones((len(signature), 1), dtype=np.uint64)
    for r in range(rows):
        keys = (keys ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, same (equal for equal word sequences), n_shingles, bands."""
    import xxhash

    for batch, texts in batches(it):
        sets = shingle_sets(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        if some:
            for i, keys in zip(some, band_keys(signatures([sets[i] for i in some])), strict=True):
                bands[i] = keys
        same = [xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "same", "n_shingles", "bands"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))], ["node", "shingles"])


def _confirm(tried: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of tried (node, hub) whose sets are similar enough, as a < b.  The set of a hub of many pairs is copied, once
    for SPREAD of them, so that no task has all of them."""
    copies = F.ceil(F.count("*") / SPREAD).alias("copies")
    large = stage_table(tried.groupBy("hub").agg(copies).where("copies > 1"), "spread")
    with_copy = lambda rows, hub, lot: rows.join(large.withColumnRenamed("hub", "large"), F.col(hub) == F.col("large"), "left").withColumn("copy", lot).drop("large", "copies")
    left = sets.select("node", F.col("shingles").alias("own"))
    right = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("others"))
    right = with_copy(right, "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)).cast("long") - 1)))
    pairs = with_copy(tried, "hub", F.pmod(F.xxhash64("node"), F.coalesce("copies", F.lit(1))).cast("long"))
    both = pairs.join(left, "node").join(right, ["hub", "copy"])
    common = F.size(F.array_intersect("own", "others"))
    return both.where(100 * common >= PERCENT * (F.size("own") + F.size("others") - common)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _links_in_tile(table: pa.Table) -> pa.Table:
    """Rows (node, tile, component, shingles) of one bucket: a link from each node to each other component that it reaches,
    between two tiles or within one.  Intersections are counted exactly, by products of membership matrices."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    node, tile, component = (table.column(c).to_numpy() for c in ("node", "tile", "component"))
    sets = table.column("shingles").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    values, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(node)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[column] > 1  # what one set alone holds is in no intersection
    columns, place = np.unique(column[several], return_inverse=True)
    owner = owner[several]
    common = np.zeros((len(node), len(node)), dtype=np.float32)
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(0, len(columns) + _COLUMNS, _COLUMNS))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = by_place[i:j]
        member = np.zeros((len(node), min(_COLUMNS, len(columns) - k * _COLUMNS)), dtype=np.float32)
        member[owner[part], place[part] - k * _COLUMNS] = 1
        common += member @ member.T
    linked = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    linked &= component[:, None] != component[None, :]
    if tile.min() != tile.max():
        linked &= tile[:, None] != tile[None, :]
    a, b = np.nonzero(linked)
    _, first = np.unique(np.stack([a, component[b]]), axis=1, return_index=True)
    a, b = node[a[first]], node[b[first]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _compare_tiles(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components in the buckets of rest (bucket, node, component, tiles).

    A bucket is cut into tiles of bounded size by hash; each pair of its tiles is one group, so no task holds a large bucket,
    and what leaves a group is links alone.
    """
    rows = rest.select("bucket", "node", "component", F.pmod(F.xxhash64("node"), "tiles").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "node", "tile", "component")
    ship(rows.sparkSession)
    return rows.join(sets, "node").groupBy("bucket", "one", "two").applyInArrow(_links_in_tile, "a long, b long")


def _with_texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets of the documents named in nodes."""
    return stage_table(map_arrow(rows.join(nodes, rows["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text"), _sets, "node long, shingles array<long>"), "sets")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = stage_table(map_arrow(rows, _sketch, "doc_id long, same binary, n_shingles long, bands array<long>"), "sketches")
    # One node for each word sequence, named by its least document.
    nodes = sketches.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("node"))
    nodes = stage_table(nodes, "nodes")
    named = stage_table(sketches.where("doc_id is not null and n_shingles > 0").join(nodes.select(F.col("same").alias("own"), "node"), (F.col("same") == F.col("own")) & (F.col("doc_id") == F.col("node"))).select("node", "n_shingles", "bands").dropDuplicates(["node", "n_shingles", "bands"]), "named")
    members = named.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    lot = F.xxhash64("node", "bucket")
    hubs = members.groupBy("bucket").agg(F.min(F.struct(lot.alias("lot"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"), F.count("*").alias("members")).where("members > 1")
    hubs = stage_table(hubs.select("bucket", "h.hub", "h.hub_n", "members"), "hubs")
    fits = lambda a, b: 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)  # noqa: E731  sizes alone allow the similarity
    crowd = stage_table(members.join(hubs, "bucket").select("bucket", "node", "n", "hub", "hub_n", "members"), "crowd")
    tried = crowd.where("node <> hub").where(fits(F.col("n"), F.col("hub_n"))).select(F.least("node", "hub").alias("hub"), F.greatest("node", "hub").alias("node")).distinct()
    tried = stage_table(tried, "tried")
    wanted = tried.select("node").union(tried.select("hub")).distinct()
    sets = _with_texts(rows, stage_table(wanted, "wanted"))
    # A document with several texts is linked if one of them is, and it links them.
    several = sketches.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("same").alias("one"), F.max("same").alias("other")).where("one <> other").select("doc_id")
    several = sketches.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "same").distinct()
    several = stage_table(several.join(nodes, "same").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "several")
    links = stage_table(_confirm(tried, sets).union(several.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "links")
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Buckets of three or more whose nodes are still apart: compare the rest in tiles.
    big = crowd.where("members > 2").join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    big = stage_table(big, "big")
    tiles = F.ceil(F.greatest(F.sum("n") / TILE_WINDOWS, F.count("*") / TILE_ROWS)).alias("tiles")
    apart = stage_table(big.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), tiles).where("low < high").select("bucket", "tiles"), "apart")
    if apart.limit(1).count():
        rest = stage_table(big.join(apart, "bucket"), "rest")
        late = stage_table(_compare_tiles(rest, _with_texts(rows, stage_table(rest.select("node").distinct(), "wanted"))).distinct(), "late")
        if late.limit(1).count():
            found = components(links.union(late).select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_same = stage_table(nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component_id")), "of_same")
    out = sketches.select("doc_id", "same", "n_shingles").join(of_same, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group: of the least document, and of rows with its key the first by hash of the text.  Rows
    with a null key cannot be named by another and stay."""
    keep = near_duplicates(docs, key, text).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    first = Window.partitionBy(key).orderBy(F.xxhash64(text), F.length(text))
    named = docs.join(keep, docs[key] == keep["kept_id"], "left_semi")
    names = docs.columns
    rank = "rank_" + "_".join(names)  # free, whatever the columns are called
    return named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*names).unionByName(docs.where(F.col(key).isNull()))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
