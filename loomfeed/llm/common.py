"""What the text operators share: scratch tables, input checks, word splitting and hashing in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship  # noqa: F401  operators take map_arrow from here

#: Text that one numpy step holds at a time, in bytes; bounds a task's memory whatever the batch size.
SLICE_BYTES = 4 << 20
#: Bytes that a task of a shuffle of texts or ids reads, about.
PART_BYTES = 128 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a session on one machine may leave it unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Folders written by stage_table and not cleared yet, by application.
_STAGED: dict[str, list[str]] = {}


def stage_table(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: short lineage, sizes known to the optimizer.

    group_bytes: a new row group begins after about so many bytes, looked at after every row.  A reader unpacks up to thousands
    of rows of a row group at once, so where a row holds long arrays this bounds what it holds.
    """
    ship(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    options = {} if group_bytes is None else {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession) -> list[str]:
    """The folders of tables staged so far; results read them until they are written themselves."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def clear_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables, all of this application's or those in paths, once no result needs them."""
    mine = _STAGED.setdefault(spark.sparkContext.applicationId, [])
    for path in staged(spark) if paths is None else paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in mine:
            mine.remove(path)


def parts_for(spark: SparkSession, n_bytes: int | None) -> int:
    """Partitions for a shuffle of so many bytes: as many as the session has, and no more than PART_BYTES in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes or 0) // PART_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes together; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def batches(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches with their texts, which are copied out of a slice at a time."""
    for batch in it:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        for a, b in slices(sizes.to_pylist()):
            part = batch.slice(a, b - a)
            yield part, texts_of(part, column)


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; for numbers, sorting is faster than np.unique's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one prefix sum of a rolling polynomial."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values), _BASE), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(len(values) + 1, _INVERSE)[starts]
    return mix64(h ^ mix64((ends - starts).astype(np.uint64)))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `space`."""
    gap = np.ones(len(data) + 2, dtype=np.int8)
    gap[1:-1] = space[data]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the index of each text's first word (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_spans(data, space)
    firsts = np.zeros(len(texts) + 1, dtype=np.int64)
    firsts[1:] = np.cumsum([len(x) + 1 for x in texts])
    return hash_spans(data, starts, ends), np.searchsorted(starts, firsts)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h *= _BASE
        h += words[k : k + n]
    return mix64(h)


def within(n: int, firsts: np.ndarray, width: int) -> np.ndarray:
    """Which of the n windows of `width` words lie in one text."""
    ok = np.ones(max(n, 0), dtype=bool)
    for k in range(1, width):
        at = firsts[1:-1] - k
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def ascii_lower(column) -> F.Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
