"""Ranks by a distributed radix sort, from the last digit of a composite key to the first.

Each pass is a stable counting sort.  Rows stand in blocks of bounded size; the rows of each digit are counted in each block; a
row's new place is the number of rows with a smaller digit, and of those with its digit in earlier blocks or before it in its own
block.  The two prefix sums over blocks (within groups of blocks, and over the groups) keep every window short, and a digit that
a third of all rows have lies in as many blocks as any other.  Digits that all rows share are not sorted by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Bits of a digit; 2**DIGIT_BITS totals of a pass reach the driver.
DIGIT_BITS = 12
#: Rows in a block, at most.
BLOCK_ROWS = 1 << 18
_MASK = (1 << 64) - 1


def unsigned(column: Column) -> Column:
    """A signed 64-bit integer as bits that sort without a sign."""
    return column.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def digits_of(rows: DataFrame, keys: list[Column]) -> list[Column]:
    """Digits of the keys (bits without a sign, the least significant key first), over the bits in which rows differ."""
    seen = rows.agg(*[f(k).alias(f"{name}{i}") for i, k in enumerate(keys) for name, f in (("some", F.bit_or), ("all", F.bit_and))]).first()
    digits = []
    for i, key in enumerate(keys):
        differ = ((seen[f"some{i}"] or 0) ^ (seen[f"all{i}"] or 0)) & _MASK
        if not differ:
            continue
        low, high = (differ & -differ).bit_length() - 1, differ.bit_length()
        passes = -(-(high - low) // DIGIT_BITS)
        width = -(-(high - low) // passes)
        digits += [F.shiftrightunsigned(key, low + p * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for p in range(passes)]
    return digits


def counting_pass(rows: DataFrame, at: str, block: Column, digit: Column, side: int) -> DataFrame:
    """rows with the column `at` (their order so far) replaced by their places, from 0 and without gaps, after one stable pass."""
    placed = rows.withColumns({"_block": block, "_digit": digit})
    counts = placed.groupBy("_block", "_digit").agg(F.count("*").alias("_n")).withColumn("_group", F.expr(f"_block div {side}"))
    by_digit = {r[0]: r[1] for r in counts.groupBy("_digit").agg(F.sum("_n")).collect()}  # 2**DIGIT_BITS at most
    bases, total = [0] * (max(by_digit, default=0) + 1), 0
    for d in sorted(by_digit):
        bases[d], total = total, total + by_digit[d]
    base = F.element_at(F.split(F.lit(",".join(map(str, bases))), ",").cast("array<bigint>"), F.col("_digit") + 1)
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_digit", "_group").agg(F.sum("_n").alias("_m")).select("_digit", "_group", earlier("_m", Window.partitionBy("_digit").orderBy("_group")).alias("_groups_before"))
    within = counts.select("_block", "_digit", "_group", earlier("_n", Window.partitionBy("_digit", "_group").orderBy("_block")).alias("_blocks_before"))
    offsets = within.join(groups, ["_digit", "_group"]).select("_block", "_digit", (F.col("_groups_before") + F.col("_blocks_before")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy(at)) - 1
    moved = placed.withColumn("_own", own).join(offsets, ["_block", "_digit"])
    return moved.withColumn(at, base + F.col("_before") + F.col("_own")).select(*rows.columns)


def radix_ranks(rows: DataFrame, keys: list[Column], at: str = "_at") -> DataFrame:
    """rows with the column `at`: their rank by the keys, from 0.  keys: without a sign (`unsigned`) or not negative, the least
    significant first, not null.  rows must give the same rows whenever they are read (a staged table); where all keys are equal
    the order is that of the table."""
    spark = rows.sparkSession
    rows = stage_table(rows.withColumn(at, F.monotonically_increasing_id()), "unsorted")
    count, digits = rows.count(), digits_of(rows, keys)
    size = max(1, min(BLOCK_ROWS, -(-count // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    side = max(1, math.isqrt(-(-count // size)))
    block = F.shiftright(at, max(size.bit_length() - 1, 0))  # numbers before the first pass have gaps
    for digit in digits or [F.lit(0)]:
        rows = stage_table(counting_pass(rows, at, block, digit, side), "sorted")
        block = F.expr(f"{at} div {size}")
    return rows
