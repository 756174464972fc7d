"""Language identification by compression (operator 10).

Each language has a zstandard dictionary of raw text: whole texts of a bounded sample of its labelled rows, in the order of a
hash, until the dictionary is full.  A text's letters (lower case, all else one space) are compressed in chunks with each
dictionary; the language with the fewest bytes over all chunks wins.  Whole bytes are coarse where two languages are close
(CLOSE bytes or less apart): then the FINE characters behind every space of the text are compressed too, and those sums decide.
The score is how much smaller the winner is than the runner-up (0 to 1); a score under MARGIN means the choice is not to be
relied on (`accepted` is false).  Equal sizes go to the language with more labelled rows, then by name.

Defined cases: null text, or text without a letter, is `und` with score 0, not accepted; null labels are not learned from;
without any labelled row every text is `und`; null and repeated keys are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, read_table, stage_table

#: Rows of each language that are learned from, about, chosen by hash of key and text (equal rows once); whole texts.
SAMPLE_ROWS = 1000
#: Bytes of a dictionary, and of all dictionaries together: where there are more languages, each has less.
DICTIONARY_BYTES, ALL_BYTES = 512 << 10, 256 << 20
CHUNK = 16384
#: Bytes between the first two languages up to which the choice is made anew, finely, and the characters behind each space.
CLOSE, FINE = 8, 200
LEVEL = 6
#: Under this share the winner is not relied on.
MARGIN = 0.002
UNKNOWN = "und"
_SPACE = re.compile(" ")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Letters in lower case; each run of others is one space."""
    clean = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if clean and not clean.replace(" ", "").isalpha():  # superscripts, fractions and circled numbers are no letters
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


def held_out(key) -> F.Column:
    """True for keys whose crc32 (of the key as text) leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionary_bytes(languages: int) -> int:
    return min(DICTIONARY_BYTES, ALL_BYTES // max(languages, 1))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) of every label, the most frequent first.  Counts run over all rows; the texts come from a sample
    by hash.  What reaches the driver is a dictionary's worth of texts for each language and its last text's rest."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("p"), F.col(text).alias("t"))
    counts = stage_table(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    names = [r.l for r in counts.orderBy(F.desc("n"), "l").select("l").collect()]  # a row for each language
    if not names:
        return []
    size = dictionary_bytes(len(names))
    # A sampled language has about SAMPLE_ROWS rows, so a window over one is bounded.
    picked = rows.join(F.broadcast(counts), "l").where(F.pmod("p", F.lit(1 << 40)) < F.lit(SAMPLE_ROWS) / F.col("n") * (1 << 40)).select("l", "p", "t").distinct()
    before = F.sum(F.octet_length("t").cast("long") + 1).over(Window.partitionBy("l").orderBy("p", "t").rowsBetween(Window.unboundedPreceding, -1))
    # Letters are most of a text but not all: twice the size is at hand.
    used = picked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * size).select("l", "p", "t").collect()
    texts: dict[str, bytearray] = {name: bytearray() for name in names}
    for row in sorted(used, key=lambda r: (r.l, r.p, r.t)):
        if len(texts[row.l]) < size:
            texts[row.l] += normal(row.t).encode() + b" "
    return [(name, bytes(texts[name][:size])) for name in names if texts[name]]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard

        self.compressors = []
        for name, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress))

    def _sizes(self, parts: list[bytes]) -> list[int]:
        return [sum(len(compress(x)) for x in parts) for _, compress in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float]:
        clean = normal(text)
        if not clean or not self.compressors:
            return UNKNOWN, 0.0
        if len(self.compressors) == 1:
            return self.compressors[0][0], 1.0
        sizes = self._sizes([clean[i : i + CHUNK].encode() for i in range(0, len(clean), CHUNK)])
        first, second = sorted(sizes)[:2]
        if second - first <= CLOSE:  # spaces behind keep small blocks from being stored raw
            starts = [0, *(m.end() for m in _SPACE.finditer(clean))]
            sizes = self._sizes([clean[i : i + FINE].encode() + b" " * 64 for i in starts])
            first, second = sorted(sizes)[:2]
        return self.compressors[sizes.index(first)][0], 1 - first / second


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted behind its columns; columns of docs with those names give way.  One pass, no
    shuffle."""

    def classify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(shared.value)
        for batch in it:
            found = [of(x) for x in batch.column(at).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array([x != UNKNOWN and s >= MARGIN for x, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *more], schema.names)

    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    at, kept = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if c not in [f.name for f in more]]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *more])
    return map_arrow(docs, classify, schema)


def keep_identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """docs, whatever its columns are called, without the rows whose language is not accepted."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(shared.value)
        for batch in it:
            yield batch.filter(pa.array([name != UNKNOWN and score >= MARGIN for name, score in map(of, batch.column(at).to_pylist())], pa.bool_()))

    shared, at = docs.sparkSession.sparkContext.broadcast(dictionaries), docs.columns.index(text)
    return map_arrow(docs, keep, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
