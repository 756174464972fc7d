"""Token shards with a minimal perfect hash index (operator 7).

`write_token_store` encodes documents in ascending key order and writes shards: the raw ids of consecutive documents and an
index from key to place.  The index is a minimal perfect hash (levels of bit arrays of 64-bit words with the number of bits set
before each word, so that the slot of a key is the rank of its bit) with a 32-bit fingerprint, start and length per slot: a
lookup reads one word, one rank and one slot on each of a few levels, whatever the shard's size, and a key that is not stored
is noticed (but for one in 2**32).  Each shard row also has the least and the greatest key in it, so that `get` reads shards that
can hold a key alone, and of their payload the bytes of its documents.  Spark's writer commits the shard rows, so a lost
executor's shards are written again and any shared store will do.  `read_token_store` finds every stored document through the
index.

Defined cases: null text is empty (its ids: the end id alone); null keys come first; equal keys are ordered by a hash of the
text, then by text, and told apart within a shard by their ordinal (`get` returns them all); an empty table gives an empty store;
other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, mix64, parts_for, read_table, scratch_dir
from .tokens import WordTokenizer, crc32_of, default_tokenizer, from_payload, part_of_payload, to_payload

#: Ids in a shard, at least one document; bounds what a lookup loads.
SHARD_IDS = 1 << 18
#: Keys that one call of `get` takes, and ranges of them by which shards are sought.
KEYS, RANGES = 100_000, 16
#: shard: the number of the writing task, by 2**32, and of the shard in it; before: ids of the task's shards before it.
SHARD_SCHEMA = "shard long, before long, n_ids long, n_null long, low long, high long, keys binary, ordinals binary, payload binary, levels array<binary>, ranks array<binary>, fingerprints binary, starts binary, lengths binary"
_NULL = 1 << 40


def hashed_keys(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.uint64) ^ mix64(ordinals.astype(np.uint64) + np.uint64(0x1234567)))


def _probe(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bit arrays in 64-bit words, twice as long as the keys that reach them: a key that is alone at its bit ends there, others
    go on.  And for each word the bits set before it, over all levels."""
    levels, ranks, before = [], [], 0
    while len(h):
        bits = (2 * len(h) + 63) // 64 * 64
        at = _probe(h, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        words = np.packbits(alone, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        levels.append(words)
        ranks.append((before + np.cumsum(counts) - counts).astype("<u4"))
        before += int(counts.sum())
        h = h[~alone[at]]
    return levels, ranks


def slots_of(levels: list[np.ndarray], ranks: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """The slot of each hashed key, -1 where no level has one: a word and its rank are all that is read of a level."""
    out, left = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
    for level, (words, rank) in enumerate(zip(levels, ranks, strict=True)):
        if not len(left):
            break
        at = _probe(h[left], level, 64 * len(words))
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[hit]] = (rank[at >> 6] + below)[hit]
        left = left[~hit]
    return out


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xABCDEF0123456789)) >> np.uint64(32)).astype("<u4")


def _shard(number: int, before: int, keys: list, ids: list[np.ndarray]) -> dict:
    ordinals, last = [], ...
    for key in keys:  # equal keys follow each other
        ordinals.append(ordinals[-1] + 1 if key == last else 0)
        last = key
    nulls = sum(k is None for k in keys)
    k, o = np.array([0 if x is None else x for x in keys], dtype=np.int64), np.array(ordinals, dtype=np.int64)
    h = hashed_keys(k, o + (np.arange(len(k)) < nulls) * _NULL)
    levels, ranks = build_index(h)
    slots, lengths = slots_of(levels, ranks, h), np.array([len(x) for x in ids], dtype="<u8")
    starts, by_slot = np.cumsum(lengths) - lengths, np.argsort(slots)
    return {
        "shard": number, "before": before, "n_ids": int(lengths.sum()), "n_null": nulls, "low": keys[nulls] if nulls < len(keys) else None, "high": keys[-1],
        "keys": k.astype("<i8").tobytes(), "ordinals": o.astype("<i8").tobytes(), "payload": to_payload(np.concatenate(ids)),
        "levels": [x.tobytes() for x in levels], "ranks": [x.tobytes() for x in ranks], "fingerprints": _fingerprints(h)[by_slot].tobytes(),
        "starts": starts.astype("<u8")[by_slot].tobytes(), "lengths": lengths[by_slot].tobytes(),
    }


def write_token_store(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of docs to path.  One shuffle: texts are dealt out by ranges of the key, and of the text's hash where
    many rows have one key."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = parts_for(spark, rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0])

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, before, t = TaskContext.get().partitionId() << 32, 0, WordTokenizer.of(tokenizer)
        keys, ids, total = [], [], 0
        kinds = {"levels": pa.list_(pa.binary()), "ranks": pa.list_(pa.binary())} | dict.fromkeys(("keys", "ordinals", "payload", "fingerprints", "starts", "lengths"), pa.binary())
        schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in SHARD_SCHEMA.split(", ")])
        for batch, texts in batches(it):
            all_ids, offsets = t.encode(texts)
            for i, k in enumerate(batch.column(0).to_pylist()):
                own = all_ids[offsets[i] : offsets[i + 1]]
                if keys and total + len(own) > shard_ids:
                    yield pa.RecordBatch.from_pylist([_shard(number, before, keys, ids)], schema=schema)
                    number, before, keys, ids, total = number + 1, before + total, [], [], 0
                keys.append(k)
                ids.append(own)
                total += len(own)
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(number, before, keys, ids)], schema=schema)

    lot = F.xxhash64("text")
    map_arrow(rows.repartitionByRange(n, "key", lot).sortWithinPartitions("key", lot, "text"), encode, SHARD_SCHEMA).write.parquet(path)


def lookup(row: dict, keys: np.ndarray, ordinals: np.ndarray, nulls: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths within the shard of these keys (the first `nulls` of them null); -1 for keys that it has not."""
    h = hashed_keys(keys, ordinals + (np.arange(len(keys)) < nulls) * _NULL)
    slots = slots_of([np.frombuffer(x, dtype="<u8") for x in row["levels"]], [np.frombuffer(x, dtype="<u4") for x in row["ranks"]], h)
    prints, starts, lengths = (np.frombuffer(row[c], dtype=t) for c, t in (("fingerprints", "<u4"), ("starts", "<u8"), ("lengths", "<u8")))
    ok = slots >= 0
    ok[ok] = prints[slots[ok]] == _fingerprints(h[ok])
    at = np.where(ok, slots, 0)
    return np.where(ok, starts[at].astype(np.int64), -1), np.where(ok, lengths[at].astype(np.int64), -1)


INDEX = ["n_null", "low", "high", "levels", "ranks", "fingerprints", "starts", "lengths"]


def get(store: DataFrame, keys: list[int]) -> DataFrame:
    """key and ids of the stored documents of these keys (KEYS at most; a row for each document, none for a key that is not
    stored).  Of the store, shards whose range of keys meets theirs are read, and of those the index and the keys' ids."""
    spark, asked = store.sparkSession, np.unique(np.array(keys, dtype=np.int64))
    if len(asked) > KEYS:
        raise ValueError(f"{len(asked)} keys; {KEYS} are looked up at a time")
    ranges = [(int(x[0]), int(x[-1])) for x in np.array_split(asked, RANGES) if len(x)]
    meets = reduce(operator.or_, [(F.col("low") <= b) & (F.col("high") >= a) for a, b in ranges], F.lit(False))
    shared = spark.sparkContext.broadcast(asked)  # KEYS at most

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(INDEX)}
                payload = batch.column(len(INDEX))[i].as_buffer()  # not copied
                left = shared.value[np.searchsorted(shared.value, row["low"]) : np.searchsorted(shared.value, row["high"], side="right")]
                ordinal = 0
                while len(left):  # equal keys have one ordinal after the other
                    starts, lengths = lookup(row, left, np.full(len(left), ordinal))
                    left, starts, lengths = left[starts >= 0], starts[starts >= 0], lengths[starts >= 0]
                    if len(left):
                        ids = [part_of_payload(payload, a, n).astype(np.int32) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])
                    ordinal += 1

    return map_arrow(store.where(meets).select(*INDEX, "payload"), find, "key long, ids array<int>")


def read_token_store(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every stored document."""
    spark, part = store.sparkSession, F.shiftright("shard", 32).alias("part")
    totals = store.groupBy(part).agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).orderBy("part").collect()  # a row for each writing task
    bases, run = [], 0
    for row in totals:
        bases.append((row.part, run))
        run += row.n
    joined = store.withColumn("part", part).join(spark.createDataFrame(bases, "part long, base long"), "part").drop("part")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                keys, ordinals = np.frombuffer(row["keys"], dtype="<i8"), np.frombuffer(row["ordinals"], dtype="<i8")
                starts, lengths = lookup(row, keys, ordinals, row["n_null"])
                if (starts < 0).any():
                    raise ValueError(f"shard {row['shard']} does not find its own keys")
                ids = from_payload(row["payload"])
                crc = [crc32_of(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=np.arange(len(keys)) < row["n_null"]), pa.array(starts + row["base"] + row["before"]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(joined, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_store(read_table(spark, sf_dir, "documents"), path)
    return read_token_store(spark.read.parquet(path))
