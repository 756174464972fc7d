"""Compression bands (operator 3).

zstandard ratios (compressed bytes over raw bytes) of the whole text and of each fixed chunk of it.  A whole ratio under the
lower limit for its length means repetition, one over the upper limit means text that does not compress as language does
(keys, encoded data).  A text also fails if more than a set share of its chunks lie outside the limits for chunks, so that a
bad stretch shows in a long text.  Chunks follow each other from the start; the last one ends where the text ends, so that every
byte is in a chunk of full size (a text that is no longer than a chunk is its own only chunk, judged by its length).

Defined cases: null text is empty (no words, base_failed); null and repeated keys are kept, a row each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, read_table, window_hashes, within, word_hashes

LEVEL = 3
CHUNK = 2048
#: (bytes below which the limits hold, least ratio, greatest ratio) of a whole text.  Short texts compress less, and the frame
#: of 9 bytes weighs in.
BANDS = ((8, 1.90, 10.1), (16, 1.00, 2.30), (32, 0.80, 1.70), (64, 0.66, 1.35), (128, 0.60, 1.20), (256, 0.56, 1.05), (512, 0.52, 0.90), (1024, 0.48, 0.80), (2048, 0.44, 0.74), (4096, 0.425, 0.72), (16384, 0.39, 0.70), (65536, 0.35, 0.70), (1 << 62, 0.30, 0.70))
#: Of a full chunk, and the share of chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = (0.42, 0.74), 0.34
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
QUALITY = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks long, bad_chunks long, kept boolean"


def chunks_of(text: bytes) -> list[bytes]:
    """All bytes of a text longer than a chunk, in chunks of full size; the last may overlap the one before."""
    if len(text) <= CHUNK:
        return []
    starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK]
    return [text[i : i + CHUNK] for i in starts]


def verdict(text: bytes, compress) -> tuple[float | None, int, int, bool]:
    """Whole ratio (null for an empty text, which the method keeps), chunks, those outside the limits, and whether the method
    keeps the text."""
    if not text:
        return None, 0, 0, True
    ratio = len(compress(text)) / len(text)
    low, high = next((low, high) for most, low, high in BANDS if len(text) < most)
    chunks = chunks_of(text)
    bad = sum(not CHUNK_BAND[0] <= len(compress(x)) / CHUNK <= CHUNK_BAND[1] for x in chunks)
    return ratio, len(chunks), bad, low <= ratio <= high and bad <= CHUNK_SHARE * len(chunks)


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: words, and words inside windows of WINDOW words that it holds twice or more."""
    words, firsts = word_hashes(texts)
    n = len(words) - WINDOW + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(firsts))
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if n > 0:
        h = window_hashes(words, WINDOW)
        h += owner[:n] * np.uint64(0x9E3779B97F4A7C15)  # windows of other texts are other windows
        at = np.flatnonzero(within(n, firsts, WINDOW))
        order = at[np.argsort(h[at], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        np.add.at(covered, order[twice], 1)
        np.add.at(covered, order[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return np.diff(firsts), inside[firsts[1:]] - inside[firsts[:-1]]


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and QUALITY of each document.  One pass, no shuffle."""

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch, texts in batches(it):
            n_words, n_repeat = repeated_words(texts)
            rows = []
            for x, n, r in zip(texts, n_words.tolist(), n_repeat.tolist(), strict=True):
                solid = x.translate(None, _WHITE)
                lines = [line for line in x.split(b"\n") if line.strip(_WHITE)]
                failed = n < LEAST_WORDS or 100 * r > REPEAT_PERCENT * n
                ratio, chunks, bad, fine = verdict(x, compress)
                rows.append((n, len(solid.decode()), len(x) - len(x.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), r, failed, ratio, chunks, bad, fine and not failed))
            columns = zip(*rows, strict=True)
            types = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(x.split()[0] for x in QUALITY.split(", "))])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), measure, f"doc_id long, {QUALITY}")


def op3_compression_bands(spark, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents"))
