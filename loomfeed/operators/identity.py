"""Identity of contents, duplicates and the comparison of captures (DED1, IDN1, MAT1 to MAT3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_of, normalize, sha256_of, text_or_empty

AUXILIARY = ("user_name_masked", "content_time", "sku")


def content_hash() -> Column:
    """DED1: md5 of platform, product (or source file), role, text and parent."""
    owner = F.coalesce(F.nullif(text_or_empty(F.col("product_id")), F.lit("")), text_or_empty(F.col("source_file")))
    return md5_of(F.col("platform"), owner, F.col("content_role"), F.col("content_text_clean"), F.col("parent_text_clean"))


def keep_first(df: DataFrame, keys: list[str], seq: str, last: bool = False) -> DataFrame:
    """WIN5: the first (or last) row by seq of each key.  An aggregate with map-side combine, so hot keys do no harm."""
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.col(seq))
    return df.groupBy(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys))).agg(pick.alias("r")).select("r.*")


def dedupe_records(df: DataFrame, seq: str = "seq") -> DataFrame:
    """DED1: rows with content_hash, the first by seq of each."""
    return keep_first(df.withColumn("content_hash", content_hash()), ["content_hash"], seq)


def identity_keys(df: DataFrame, item: str = "item_key") -> DataFrame:
    """IDN1: strict, composite, text and identity keys, the method and its confidence."""
    n = {c: normalize(F.col(c)) for c in ("platform_content_id", "content_role", "content_text_clean", "parent_text_clean", "user_name_masked", "content_time", "sku")}
    strict = F.when(n["platform_content_id"] != "", F.concat_ws(":", F.lit("native"), F.col(item), n["content_role"], n["platform_content_id"])).otherwise("")
    composite = F.concat(F.lit("composite:"), sha256_of(*(F.col(c) for c in (item, "content_role", "content_text_clean", "parent_text_clean", "user_name_masked", "content_time", "sku"))))
    text = F.concat(F.lit("text:"), sha256_of(*(F.col(c) for c in (item, "content_role", "content_text_clean", "parent_text_clean"))))
    own = sum(((n[c] != "").cast("int") for c in AUXILIARY), F.lit(0))
    some = (own > 0) | (n["parent_text_clean"] != "")
    df = df.withColumns({"strict_key": strict, "composite_key": composite, "text_key": text, "_own": own, "_some": some})
    native = F.col("strict_key") != ""
    return df.withColumns({
        "identity_key": F.when(native, F.col("strict_key")).when(F.col("_some"), F.col("composite_key")).otherwise(F.col("text_key")),
        "identity_method": F.when(native, "native_id").when(F.col("_some"), "composite").otherwise("low_confidence"),
        "identity_confidence": F.when(native, "high").when(F.col("_some"), F.when(F.col("_own") >= 2, "high").otherwise("medium")).otherwise("low"),
    }).drop("_own", "_some")


def match_pair(left: str, right: str) -> tuple[Column, Column]:
    """MAT1: whether two joined rows match, and with high confidence; left and right are aliases."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    strict = (a("strict_key") != "") & (a("strict_key") == b("strict_key"))
    composite = (a("composite_key") != "") & (a("composite_key") == b("composite_key"))
    both = [(F.trim(text_or_empty(a(c))) != "") & (F.trim(text_or_empty(b(c))) != "") for c in AUXILIARY]
    same = [normalize(a(c)) == normalize(b(c)) for c in AUXILIARY]
    some = both[0] | both[1] | both[2]
    agree = (~both[0] | same[0]) & (~both[1] | same[1]) & (~both[2] | same[2])
    high = F.coalesce(strict | composite, F.lit(False))
    return high | F.coalesce((a("text_key") == b("text_key")) & some & agree, F.lit(False)), high


def compare_with_master(master: DataFrame, candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """MAT2: candidates with status (existing, uncertain, new) and the master's content_id.  Of several master rows with one
    strict or composite key the last by seq counts, with one text key the first."""

    def side(key: str, last: bool) -> DataFrame:
        pick = (F.max_by if last else F.min_by)("content_id", seq)
        return master.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy("item_key", key).agg(pick.alias(f"_{key}_id"))

    out = candidates
    for key, last in (("strict_key", True), ("composite_key", True), ("text_key", False)):
        out = out.join(side(key, last), ["item_key", key], "left")
    bare = F.lit(True)
    for c in (*AUXILIARY, "parent_text_clean"):
        bare = bare & (F.trim(text_or_empty(F.col(c))) == "")
    found = F.coalesce("_strict_key_id", "_composite_key_id")
    status = F.when(found.isNotNull(), "existing").when(F.col("_text_key_id").isNotNull() & bare, "uncertain").otherwise("new")
    out = out.withColumn("status", status).withColumn("master_content_id", F.when(F.col("status") == "existing", found).when(F.col("status") == "uncertain", F.col("_text_key_id")))
    return out.drop("_strict_key_id", "_composite_key_id", "_text_key_id")


def overlap_boundary(old: DataFrame, new: DataFrame, window: int = 50, seq: str = "seq") -> DataFrame:
    """MAT3: for each item, the longest run of matching rows between the head of the old capture and the tail of the new one.

    Both sides are cut to `window` rows an item before they are joined; runs are islands on diagonals, counted at each of
    their rows, so prefixes of a run count too.  Items without an eligible run have status fallback.
    """
    head = Window.partitionBy("item_key").orderBy(seq)
    tail = Window.partitionBy("item_key").orderBy(F.desc(seq))
    o = old.withColumn("i", F.row_number().over(head)).where(F.col("i") <= window)
    back = new.withColumn("back", F.row_number().over(tail)).where(F.col("back") <= window)
    sizes = new.groupBy("item_key").agg(F.count("*").alias("n_new"))
    n = back.join(sizes, "item_key").withColumn("new_start", F.greatest(F.col("n_new") - window, F.lit(0))).withColumn("j", F.col("n_new") - F.col("back") + 1 - F.col("new_start"))
    matched, high = match_pair("o", "n")
    o, n = o.alias("o"), n.alias("n")
    item = F.col("o.item_key") == F.col("n.item_key")
    pairs = [o.join(n, item & (F.col(f"o.{k}") == F.col(f"n.{k}")) & (F.col(f"o.{k}") != "")).where(matched).select("o.item_key", "o.i", "n.j", "n.new_start", high.cast("int").alias("high")) for k in ("strict_key", "text_key")]
    m = pairs[0].union(pairs[1]).distinct()
    diagonal = Window.partitionBy("item_key", F.col("i") - F.col("j")).orderBy("i")
    m = m.withColumn("island", F.col("i") - F.row_number().over(diagonal))
    run = Window.partitionBy("item_key", F.col("i") - F.col("j"), "island").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumns({"length": F.count("*").over(run), "highs": F.sum("high").over(run)})
    fit = m.where(((F.col("length") >= 3) & (F.col("highs") == F.col("length"))) | ((F.col("length") >= 5) & (F.col("highs") >= 3)))
    best = fit.groupBy("item_key").agg(F.min_by(F.struct("length", "highs", "j", "new_start"), F.struct(-F.col("length"), F.col("i"), F.col("j"))).alias("b"))
    items = old.select("item_key").union(new.select("item_key")).distinct().join(best, "item_key", "left")
    found = F.col("b").isNotNull()
    return items.select(
        "item_key", F.when(found, "overlap_found").otherwise("fallback").alias("status"), F.coalesce("b.length", F.lit(0)).cast("long").alias("overlap_length"),
        F.when(found, F.col("b.new_start") + F.col("b.j") - F.col("b.length")).otherwise(0).cast("long").alias("new_prefix_end"),
        F.when(found, F.when(F.col("b.highs") == F.col("b.length"), "high").otherwise("medium")).otherwise("").alias("confidence"),
    )
