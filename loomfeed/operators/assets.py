"""The store of reviews and their images (AST1 to AST12): identity, upserts, a change log, undo and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, sha256_of, text_or_empty
from .tables import numbered


def fingerprint(*parts: Column) -> Column:
    """AST2."""
    return sha256_of(*parts)


def match_reviews(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """AST1: incoming rows with matched_id and match (native_id, fingerprint, collision, new).  A key that several stored
    reviews have is a collision; of incoming rows with one key the first by seq stands for the others (in_batch_of)."""
    by = lambda key, name: store.where(text_or_empty(F.col(key)) != "").groupBy("product_key", key).agg(F.count("*").alias(f"_{name}_n"), F.min("local_review_id").alias(f"_{name}_id"))
    out = incoming.join(by("platform_review_id", "native"), ["product_key", "platform_review_id"], "left").join(by("review_fingerprint", "print"), ["product_key", "review_fingerprint"], "left")
    match = (F.when(F.col("_native_n") == 1, "native_id").when(F.col("_native_n") > 1, "collision").when(F.col("_print_n") == 1, "fingerprint").when(F.col("_print_n") > 1, "collision").otherwise("new"))
    key = F.coalesce(blank_to_null(F.col("platform_review_id")), blank_to_null(F.col("review_fingerprint")))
    # Rows without any key stand for themselves; the first of the others is an aggregate, so that no key is in one task.
    keyed = incoming.select("product_key", key.alias("_key"), "seq").where("_key is not null").groupBy("product_key", "_key").agg(F.min("seq").alias("_first"))
    out = out.withColumn("_key", key).join(keyed, ["product_key", "_key"], "left")
    out = out.withColumn("match", match).withColumn("matched_id", F.when(F.col("match") == "native_id", F.col("_native_id")).when(F.col("match") == "fingerprint", F.col("_print_id")))
    return out.withColumn("in_batch_of", F.coalesce("_first", "seq")).drop("_key", "_first", "_native_n", "_native_id", "_print_n", "_print_id")


def local_ids(df: DataFrame, prefix: str = "rv", seq: str = "seq") -> DataFrame:
    """AST3: prefix, product and the fingerprint's start; clashes are numbered from the second on."""
    base = F.concat_ws("_", F.lit(prefix), "platform_product_id", F.substring("review_fingerprint", 1, 12))
    placed = numbered(df.withColumn("_base", base), ["_base"], seq, name="_n")
    return placed.withColumn("local_review_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def upsert_reviews(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """AST4: matched rows fill what is blank (append text and time, name, sku) and count substantive updates; others are new."""
    filled = ("append_text", "append_time", "user_name_masked", "sku")
    both = store.alias("s").join(incoming.alias("n"), "local_review_id", "full_outer")
    new = F.col("s.review_text").isNull() & F.col("n.review_text").isNotNull()
    gain = F.lit(False)
    for c in filled[:2]:
        gain = gain | (blank_to_null(text_or_empty(F.col(f"s.{c}"))).isNull() & blank_to_null(text_or_empty(F.col(f"n.{c}"))).isNotNull())
    columns = [F.coalesce(blank_to_null(F.col(f"s.{c}")), F.col(f"n.{c}")).alias(c) if c in filled else F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in store.columns if c not in ("local_review_id", "update_count")]
    return both.select("local_review_id", *columns, (F.coalesce("s.update_count", F.lit(0)) + (~new & gain).cast("int")).alias("update_count"))


def upsert_images(store: DataFrame, incoming: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """AST5: the store with images that it lacks (by review, stage and content), numbered behind the last of their review and
    stage; and the batch's observations with was_new."""
    key = ["local_review_id", "image_stage", "content_sha256"]
    seen = incoming.groupBy(*key).agg(F.min("seq").alias("seq"))
    fresh = seen.join(store.select(*key), key, "left_anti")
    top = store.groupBy("local_review_id", "image_stage").agg(F.max("image_index").alias("_top"))
    n = F.row_number().over(Window.partitionBy("local_review_id", "image_stage").orderBy("seq", "content_sha256"))
    fresh = fresh.withColumn("_n", n).join(top, ["local_review_id", "image_stage"], "left").withColumn("image_index", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int"))
    fresh = fresh.withColumn("image_id", F.sha2(F.concat_ws("|", *key), 256)).select("image_id", "local_review_id", "image_stage", "image_index", "content_sha256")
    # Which images are new is known where they are put together; no join by their ids tells it again.
    told = store.select("image_id", "local_review_id", "image_stage", "image_index", "content_sha256", F.lit(0).alias("was_new")).unionByName(fresh.withColumn("was_new", F.lit(1)))
    after = told.drop("was_new")
    watched = seen.join(told, key).select(F.lit(batch).alias("batch_id"), "image_id", "local_review_id", "was_new")
    return after, watched


def change_rows(before: DataFrame, after: DataFrame, key: str, entity: str, batch: str) -> DataFrame:
    """AST6: create and update rows with both states as JSON."""
    state = lambda df: F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    b, a = before.select(F.col(key).alias("entity_id"), state(before).alias("previous_state")), after.select(F.col(key).alias("entity_id"), state(after).alias("new_state"))
    out = a.join(b, "entity_id", "left").where(F.col("previous_state").isNull() | (F.col("previous_state") != F.col("new_state")))
    return out.select(F.lit(batch).alias("batch_id"), F.lit(entity).alias("entity_type"), "entity_id", F.when(F.col("previous_state").isNull(), "create").otherwise("update").alias("operation"), "previous_state", "new_state")


def undo_refused(batches: DataFrame, batch: str) -> DataFrame:
    """AST7: why a batch cannot be undone: it is not completed, or a later completed one shares a product (no rows: it can)."""
    this = batches.where(F.col("batch_id") == batch).select(F.col("products").alias("_p"), F.col("ordinal").alias("_o"), F.col("status").alias("_s"))
    open_ = this.where("_s <> 'completed'").select(F.lit(batch).alias("batch_id"), F.lit("not completed").alias("reason"))
    later = batches.where("status = 'completed'").join(this, (F.col("ordinal") > F.col("_o")) & F.arrays_overlap("products", "_p")).select("batch_id", F.lit("later batch").alias("reason"))
    return open_.union(later)


def undo(entities: DataFrame, changes: DataFrame, batch: str, entity: str) -> DataFrame:
    """AST7: entities (entity_id, state as JSON) as they were before the batch: created ones go, the oldest previous state of
    others comes back."""
    own = changes.where((F.col("batch_id") == batch) & (F.col("entity_type") == entity))
    first = own.groupBy("entity_id").agg(F.bool_or(F.col("operation") == "create").alias("_created"), F.min_by("previous_state", "change_id").alias("_state"))
    out = entities.join(first, "entity_id", "left").where(~F.coalesce("_created", F.lit(False)))
    return out.select("entity_id", F.coalesce("_state", "state").alias("state"))


def batch_snapshot(changes: DataFrame, batch: str) -> DataFrame:
    """AST9: the last state of each entity of a batch, and whether the batch created it."""
    return changes.where(F.col("batch_id") == batch).groupBy("entity_type", "entity_id").agg(F.max_by("new_state", "change_id").alias("state"), F.bool_or(F.col("operation") == "create").alias("created_in_batch"))


def product_export(reviews: DataFrame, images: DataFrame) -> DataFrame:
    """JN13, AST8: reviews with counts of their images by stage and status."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    counts = images.groupBy("local_review_id").agg(F.count("*").alias("image_count"), n(F.col("image_stage") == "review", "review_image_count"), n(F.col("image_stage") == "append", "append_image_count"), n(F.col("extract_status") == "missing", "missing_image_count"))
    return reviews.join(counts, "local_review_id", "left").fillna(0, ["image_count", "review_image_count", "append_image_count", "missing_image_count"])


def export_manifest(watched: DataFrame, images: DataFrame, reviews: DataFrame) -> DataFrame:
    """JN14, AST10: of each product and review of a batch: images seen and new, by stage."""
    rows = watched.join(images.select("image_id", "image_stage"), "image_id").join(reviews.select("local_review_id", "product_key"), "local_review_id")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    stage, new = (lambda s: F.col("image_stage") == s), F.col("was_new") == 1
    return rows.groupBy("product_key", "local_review_id").agg(F.count("*").alias("exported_count"), n(new, "new_count"), n(stage("review"), "review_exported"), n(stage("review") & new, "review_new"), n(stage("append"), "append_exported"), n(stage("append") & new, "append_new"))


def product_images(reviews: DataFrame, images: DataFrame) -> DataFrame:
    """AST8: image rows of a product's reviews with their folder, in the order of review, stage and index (as columns; sorted
    when they are written)."""
    of = reviews.select("local_review_id", "product_key")
    folder = F.concat_ws("/", F.lit("products"), "product_key", F.lit("reviews"), "local_review_id")
    place = F.row_number().over(Window.partitionBy("local_review_id").orderBy("image_stage", "image_index", "image_id"))
    return images.join(of, "local_review_id").withColumns({"review_folder": folder, "image_order": place})


def exported_images(watched: DataFrame, changed: DataFrame, images: DataFrame, reviews: DataFrame, affected: list[str], identified: int) -> DataFrame:
    """JN14: images of a batch with was_new.  Batches of older stores have no observations (watched): if they identified more
    images than they changed (changed: image_id), all images of the affected products stand for them, else the changed ones."""
    if watched.limit(1).count():
        return images.join(watched.select("image_id", "was_new"), "image_id")
    new = changed.select("image_id", F.lit(1).alias("was_new")).distinct()
    if identified > new.count():
        mine = reviews.where(F.col("product_key").isin(*affected)).select("local_review_id")
        return images.join(mine, "local_review_id", "left_semi").join(new, "image_id", "left").fillna(0, ["was_new"])
    return images.join(new, "image_id")


REVIEW_COLUMNS = ("platform_review_id", "review_time", "append_time", "reviewer_display_name", "sku", "review_text", "append_text", "source_file_name")
PRODUCT_COLUMNS = ("platform", "product_id", "product_title")


def export_tables(exported: DataFrame, reviews: DataFrame, products: DataFrame, created: DataFrame, found: int = 0, warnings: int = 0, batch_id: str = "", exported_at: str = "") -> dict[str, DataFrame]:
    """AST10: image rows with path and status, counts of each review and product, and the metrics of a batch's export.

    exported: images with was_new and extract_status; created: local_review_id of reviews that the batch has made.  Rows of
    reviews and products carry what the tables tell of them (see REVIEW_COLUMNS and PRODUCT_COLUMNS; blank where they do not);
    each metric has the batch and the time of its export."""
    rows = exported.join(reviews.select("local_review_id", "product_key"), "local_review_id")
    ok = text_or_empty(F.col("extract_status")).isin("embedded", "extracted")
    path = F.concat_ws("/", F.lit("images"), "product_key", "local_review_id", F.col("image_id"))
    rows = rows.withColumns({"relative_path": path, "export_status": F.when(ok, "success").otherwise("failed"), "new": F.col("was_new") == 1})
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    stage = lambda s: F.col("image_stage") == s
    of_review = rows.groupBy("product_key", "local_review_id").agg(
        n(stage("review") & F.col("new"), "new_review_image_count"), n(stage("append") & F.col("new"), "new_append_image_count"), n(F.col("new"), "new_total_image_count"),
        n(stage("review"), "export_review_image_count"), n(stage("append"), "export_append_image_count"), F.count("*").alias("export_total_image_count"),
    ).withColumn("review_folder", F.concat_ws("/", F.lit("images"), "product_key", "local_review_id"))
    told = lambda df, columns: df.withColumns({c: text_or_empty(F.col(c)) if c in df.columns else F.lit("") for c in columns})
    one = told(products, PRODUCT_COLUMNS).groupBy("product_key").agg(*(F.max(c).alias(c) for c in PRODUCT_COLUMNS))
    said = reviews.select("local_review_id", *(c for c in REVIEW_COLUMNS if c in reviews.columns))
    of_review = told(of_review.join(said, "local_review_id", "left"), REVIEW_COLUMNS).join(one, "product_key", "left").fillna("", list(PRODUCT_COLUMNS))
    new_reviews = created.select("local_review_id").distinct().join(reviews.select("local_review_id", "product_key"), "local_review_id").groupBy("product_key").agg(F.count("*").alias("new_review_count"))
    images_of = rows.groupBy("product_key").agg(n(F.col("new"), "new_image_count"), F.count("*").alias("export_image_count"))
    of_product = one.join(new_reviews, "product_key", "left").join(images_of, "product_key", "left").fillna(0)
    t = rows.agg(
        F.count("*").alias("identified_image_count"), F.count_distinct("local_review_id").alias("review_with_image_count"), n(~F.col("new"), "historical_image_count"), n(stage("review") & F.col("new"), "new_review_image_count"),
        n(stage("append") & F.col("new"), "new_append_image_count"), n(F.col("export_status") == "success", "exported_image_count"), n(F.col("export_status") == "failed", "failed_image_count"),
    )
    t = t.join(of_product.agg(F.count("*").alias("product_count"), F.coalesce(F.sum("new_review_count"), F.lit(0)).alias("new_review_count")))  # a row each
    t = t.withColumns({"identified_review_count": F.lit(found).cast("long"), "warning_count": F.col("failed_image_count") + warnings})
    metrics = ["product_count", "identified_review_count", "new_review_count", "review_with_image_count", "identified_image_count", "historical_image_count", "new_review_image_count", "new_append_image_count", "exported_image_count", "failed_image_count", "warning_count"]
    summary = t.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics))).alias("r")).select("r.*", F.lit(batch_id).alias("batch_id"), F.lit(exported_at).alias("exported_at"))
    return {"images": rows.drop("new"), "reviews": of_review, "products": of_product, "summary": summary}


def manifest_problems(listed: DataFrame, files: DataFrame) -> DataFrame:
    """AST11: paths that are unsafe, listed without a file, or files that are not listed."""
    l, f = listed.select("path", F.lit(True).alias("_l")), files.select("path", F.lit(True).alias("_f"))
    unsafe = F.col("path").rlike(r"(^|[\\/])\.\.([\\/]|$)|^[\\/]|^[A-Za-z]:")
    both = l.join(f, "path", "full_outer").withColumn("problem", F.when(unsafe, "unsafe path").when(F.col("_f").isNull(), "missing file").when(F.col("_l").isNull(), "unlisted file"))
    return both.where("problem is not null").select("path", "problem")


def preview_status(df: DataFrame) -> DataFrame:
    """AST12."""
    return df.withColumn("status", F.when(text_or_empty(F.col("error")) != "", "failed").when((text_or_empty(F.col("platform_product_id")) == "") | (F.col("review_count") == 0), "needs_fix").otherwise("ready"))
