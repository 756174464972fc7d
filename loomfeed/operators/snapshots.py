"""The incremental store: captures, the master table and its upkeep (SNP1 to SNP13).  Tables in, tables out; no MERGE needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import parse_time, split_terms, text_or_empty, truthy
from ..lineage import kept
from .classify import classify
from .identity import overlap_boundary
from .joins import content_analysis, update_analysis
from .metrics import evidence_levels, summary_by_keyword, summary_by_product
from .tables import stalest_first

TOKENS = ("identity_key", "strict_key", "composite_key", "text_key")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """WIN4: the snapshot of each item with the latest capture, then the latest import, then the greatest id."""
    order = F.struct(parse_time(F.col("capture_time")), parse_time(F.col("imported_at")), F.col("snapshot_id"))
    return snapshots.groupBy("item_key").agg(F.max_by(F.struct(*(c for c in snapshots.columns if c != "item_key")), order).alias("r")).select("item_key", "r.*")


def split_duplicates(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """SNP1: files with is_duplicate: the item has a snapshot of the same bytes already."""
    seen = snapshots.where(text_or_empty(F.col("file_hash")) != "").select("project_id", "item_key", "file_hash").distinct().withColumn("_seen", F.lit(True))
    return files.join(seen, ["project_id", "item_key", "file_hash"], "left").withColumn("is_duplicate", F.coalesce("_seen", F.lit(False))).drop("_seen")


def backfill_gate(files: DataFrame, snapshots: DataFrame, allow: bool = False) -> DataFrame:
    """SNP2: files with is_backfill (captured before the item's latest snapshot) and status (accepted, fallback, rejected)."""
    latest = snapshots.groupBy("item_key").agg(F.max(parse_time(F.col("capture_time"))).alias("_latest"))
    late = F.coalesce(parse_time(F.col("capture_time")) < F.col("_latest"), F.lit(False))
    out = files.join(latest, "item_key", "left").withColumn("is_backfill", late).drop("_latest")
    return out.withColumn("status", F.when(~F.col("is_backfill"), "accepted").otherwise("fallback" if allow else "rejected"))


def new_content_id(snapshot: Column, identity: Column, seq: Column) -> Column:
    """Deterministic, so that a repeated run gives the same ids."""
    return F.concat(F.lit("cnt_"), F.substring(F.sha2(F.concat_ws("|", snapshot, identity, seq.cast("string")), 256), 1, 32))


def apply_master_update(master: DataFrame, compared: DataFrame, snapshot: dict[str, Column | str], backfill: bool = False, seq: str = "seq") -> DataFrame:
    """SNP3: the master after one capture.  compared: candidates of MAT2; snapshot: snapshot_id, capture_time, source_file as
    columns of compared or as values.  Rows of the captured items become inactive, found ones active with a new last sight,
    new ones are added; a backfill leaves what is there and adds inactive rows."""
    value = {k: F.lit(v) if isinstance(v, str) else v for k, v in snapshot.items()}
    c = compared.withColumns({f"_{k}": v for k, v in value.items()})
    hits = c.where("status = 'existing'").groupBy(F.col("master_content_id").alias("content_id")).agg(*(F.max(f"_{k}").alias(f"_{k}") for k in value))
    items = c.select("item_key").distinct().withColumn("_captured", F.lit(True))
    kept = master.join(hits, "content_id", "left").join(items, "item_key", "left")
    if not backfill:
        hit = F.col("_snapshot_id").isNotNull()
        kept = kept.withColumns({
            "last_seen_snapshot_id": F.when(hit, F.col("_snapshot_id")).otherwise(F.col("last_seen_snapshot_id")),
            "last_seen_at": F.when(hit, F.col("_capture_time")).otherwise(F.col("last_seen_at")),
            "source_file_last": F.when(hit, F.col("_source_file")).otherwise(F.col("source_file_last")),
            "is_active": F.when(hit, True).when(F.col("_captured"), False).otherwise(F.col("is_active")),
        })
    fresh = c.where("status = 'new'")
    fresh = fresh.withColumns({
        "content_id": new_content_id(F.col("_snapshot_id"), F.col("identity_key"), F.col(seq)), "is_active": F.lit(not backfill),
        **{f"{side}_seen_snapshot_id": F.col("_snapshot_id") for side in ("first", "last")}, **{f"{side}_seen_at": F.col("_capture_time") for side in ("first", "last")}, **{f"source_file_{side}": F.col("_source_file") for side in ("first", "last")},
    })
    pick = lambda df: df.select(*(F.col(x).cast(t).alias(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in master.dtypes))
    return pick(kept).unionByName(pick(fresh))


def upsert_products(products: DataFrame, seen: DataFrame) -> DataFrame:
    """SNP4: products with what a capture says of them; unknown platforms and empty ids are refused."""
    seen = seen.where(F.col("platform").isin("taobao", "tmall", "jd") & (F.trim(text_or_empty(F.col("platform_product_id"))) != ""))
    latest = seen.groupBy("project_id", "platform", "platform_product_id").agg(F.max_by(F.struct("product_title", "shop_name", "capture_time"), F.struct(parse_time(F.col("capture_time")), "product_title")).alias("s"))
    latest = latest.withColumn("item_key", F.concat_ws(":", "platform", "platform_product_id"))
    both = products.alias("p").join(latest.alias("n"), ["project_id", "item_key"], "full_outer")
    newer = lambda new, old: F.coalesce(F.col(f"n.s.{new}"), F.col(f"p.{old}")).alias(old)
    return both.select("project_id", "item_key", F.coalesce("n.platform", "p.platform").alias("platform"), F.coalesce("n.platform_product_id", "p.platform_product_id").alias("platform_product_id"), newer("product_title", "product_title_current"), newer("shop_name", "shop_name_current"), newer("capture_time", "last_updated_at"))


def _standing(snapshots: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshots of items that lose one: those that stay have their turn among them, from 1, and is_latest; others have none."""
    order = F.struct(parse_time(F.col("capture_time")), parse_time(F.col("imported_at")), F.col("snapshot_id"))
    own, stays = Window.partitionBy("item_key"), F.col("_gone").isNull()
    marked = snapshots.join(gone.select("snapshot_id").distinct().withColumn("_gone", F.lit(True)), "snapshot_id", "left")
    marked = marked.withColumns({"_turn": F.row_number().over(own.orderBy(F.asc_nulls_first("_gone"), order)), "_left": F.count_if(stays).over(own), "_all": F.count("*").over(own)})
    turn = F.when(stays, F.col("_turn"))
    return marked.where("_left < _all").select("item_key", "snapshot_id", turn.alias("turn"), (turn == F.col("_left")).alias("is_latest"), "capture_time", "source_file")


def _survivors(master: DataFrame, contents: DataFrame, standing: DataFrame) -> DataFrame:
    """The contents of these items with the turns of their first and last remaining snapshot, null where none holds them (the
    first kind of key that a snapshot has decides).  Turns are summed up for each key, so no key meets all its snapshots."""

    def tokens(df: DataFrame, *keep: str) -> DataFrame:
        value = lambda t: F.trim(text_or_empty(F.col(t)))
        named = F.array_compact(F.array(*(F.when(value(t) != "", F.struct(F.lit(i).alias("rank"), value(t).alias("token"))) for i, t in enumerate(TOKENS))))
        return df.select(*keep, F.explode_outer(named).alias("t")).select(*keep, "t.rank", "t.token")

    turns = standing.where("turn is not null").select("item_key", "snapshot_id", "turn")
    held = tokens(contents.join(turns, ["item_key", "snapshot_id"]), "item_key", "turn").groupBy("item_key", "rank", "token").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    mine = tokens(master.join(standing.select("item_key").distinct(), "item_key", "left_semi"), "item_key", "content_id")
    best = lambda f, c: F.coalesce(*(f(F.when(F.col("rank") == i, F.col(c))) for i in range(len(TOKENS)))).alias(c)
    return mine.join(held, ["item_key", "rank", "token"], "left").groupBy("item_key", "content_id").agg(best(F.min, "first"), best(F.max, "last"))


def check_deletion(snapshots: DataFrame, contents: DataFrame, gone: DataFrame) -> None:
    """SNP5: refuse where a snapshot that stays had contents that are not stored."""
    touched = snapshots.join(gone, "snapshot_id", "left_semi").select("item_key").distinct()
    left = snapshots.join(gone, "snapshot_id", "left_anti").join(touched, "item_key", "left_semi").where(F.coalesce(F.col("extracted_count").try_cast("long"), F.lit(0)) > 0)
    missing = left.join(contents.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select("snapshot_id").limit(5).collect()
    if missing:
        raise ValueError("snapshots without stored contents: " + ", ".join(r.snapshot_id for r in missing))


def deletion_impact(master: DataFrame, contents: DataFrame, snapshots: DataFrame, gone: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """SNP5: what each deleted snapshot's item would lose."""
    standing = keep(_standing(snapshots, gone))
    lost = _survivors(master, contents, standing).where("first is null").groupBy("item_key").agg(F.count("*").alias("removed_content_count"))
    rest = standing.groupBy("item_key").agg(F.count("turn").alias("remaining_snapshot_count"))
    out = standing.where("turn is null").join(lost, "item_key", "left").join(rest, "item_key", "left").fillna(0, ["removed_content_count", "remaining_snapshot_count"])
    return out.select("snapshot_id", "item_key", "removed_content_count", "remaining_snapshot_count", (F.col("remaining_snapshot_count") == 0).alias("removes_product"))


def delete_from_master(master: DataFrame, contents: DataFrame, snapshots: DataFrame, gone: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """SNP5: the master without the deleted snapshots (gone: snapshot_id): contents that no other snapshot of the item holds
    go, others get their first and last sights anew.  keep makes a table once (a checkpoint)."""
    standing = keep(_standing(snapshots, gone))
    sight = lambda side: standing.where("turn is not null").select("item_key", F.col("turn").alias(side), F.struct("snapshot_id", "capture_time", "source_file", "is_latest").alias(f"_{side}"))
    alive = _survivors(master, contents, standing).join(sight("first"), ["item_key", "first"], "left").join(sight("last"), ["item_key", "last"], "left")
    alive = alive.select("content_id", F.lit(True).alias("_touched"), F.col("_first").alias("first"), F.col("_last").alias("last"))
    both = master.join(alive, "content_id", "left").where(F.col("_touched").isNull() | F.col("first").isNotNull())
    new = lambda value, old: F.coalesce(value, F.col(old)).alias(old)
    fresh = {"first_seen_snapshot_id": F.col("first.snapshot_id"), "first_seen_at": F.col("first.capture_time"), "last_seen_snapshot_id": F.col("last.snapshot_id"), "last_seen_at": F.col("last.capture_time"), "source_file_first": F.col("first.source_file"), "source_file_last": F.col("last.source_file"), "is_active": F.col("last.is_latest")}
    return both.select(*(new(fresh[c], c) if c in fresh else F.col(c) for c in master.columns))


def repoint_scores(scores: DataFrame, master_after: DataFrame, gone: DataFrame) -> DataFrame:
    """SNP5: score rows of deleted snapshots move to the content's first snapshot, or go with the content."""
    first = master_after.select("content_id", F.col("first_seen_snapshot_id").alias("_first"))
    g = gone.select("snapshot_id").distinct().withColumn("_gone", F.lit(True))
    out = scores.join(first, "content_id", "left_semi").join(first, "content_id", "left").join(g, "snapshot_id", "left")
    return out.withColumn("snapshot_id", F.when(F.col("_gone"), F.col("_first")).otherwise(F.col("snapshot_id"))).select(*scores.columns)


def drop_snapshot_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """SNP5: logs of deleted snapshots go."""
    return df.join(gone, "snapshot_id", "left_anti")


def products_after(products: DataFrame, snapshots_left: DataFrame, touched: DataFrame) -> DataFrame:
    """SNP5: products of touched items take title, shop and time from their latest snapshot, or go if none is left."""
    latest = latest_snapshot(snapshots_left).select("item_key", "product_title", "shop_name", "capture_time")
    t = touched.select("item_key").distinct().withColumn("_touched", F.lit(True))
    both = products.join(t, "item_key", "left").join(latest, "item_key", "left").where(F.col("_touched").isNull() | F.col("capture_time").isNotNull())
    fresh = {"product_title_current": "product_title", "shop_name_current": "shop_name", "last_updated_at": "capture_time"}
    return both.select(*(F.when(F.col("_touched"), text_or_empty(F.col(fresh[c]))).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in products.columns))


def review_queue(compared: DataFrame) -> DataFrame:
    """SNP6: a row for each uncertain candidate."""
    return compared.where("status = 'uncertain'").select(F.sha2(F.concat_ws("|", "master_content_id", "identity_key", F.col("seq").cast("string")), 256).alias("queue_id"), "item_key", F.col("master_content_id").alias("candidate_content_id"), F.lit(1.0).alias("similarity"), F.lit("inspect").alias("suggested_action"), F.lit(False).alias("resolved"))


def update_log(compared: DataFrame, *capture: str) -> DataFrame:
    """SNP7: counts of each item's import (or of each capture's) and its status."""
    out = compared.groupBy("item_key", *capture).agg(F.count("*").alias("extracted_count"), *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("new", "existing", "uncertain")))
    return out.withColumn("result", F.when(F.col("uncertain_count") > 0, "warning").otherwise("success"))


def reanalyze(tables: dict[str, DataFrame], project_id: str, lexicon: Lexicon | None = None, version: str = "") -> DataFrame:
    """SNP10, JN11: the analysis table with a project's contents graded anew (content_master), each row with its content's
    item_key, and with the scores that the project has kept (sentiment_fast); rows of other projects stay as they are."""
    own = lambda name: tables[name].where(F.col("project_id") == project_id)
    graded = classify(own("content_master"), lexicon).withColumn("analysis_version", F.lit(version))
    scores = own("sentiment_fast")
    scores = scores if "seq" in scores.columns else scores.withColumn("seq", F.lit(0))
    columns = [c for c in ("sentiment_label", "sentiment_score", "praise_code", "complaint_code", "confidence", "sentiment_source") if c in scores.columns]
    graded = update_analysis(graded, scores, columns)
    analysis = tables["analysis"]
    rows = graded.select(*(F.col(c).cast(t).alias(c) if c in graded.columns else F.lit(None).cast(t).alias(c) for c, t in analysis.dtypes))
    return analysis.where(~F.col("project_id").eqNullSafe(project_id)).unionByName(rows)


def boundaries(old: DataFrame, new: DataFrame, window: int = 50) -> DataFrame:
    """MAT3 over the items of a batch; it reports and changes nothing."""
    return overlap_boundary(old, new, window)


def content_all(master: DataFrame, analysis: DataFrame, products: DataFrame) -> DataFrame:
    """SNP9: JN1 and JN2: contents with their analysis and their product's title and shop."""
    extra = [c for c in analysis.columns if c not in master.columns or c == "content_id"]
    p = products.select("item_key", F.col("product_title_current").alias("product_title"), F.col("shop_name_current").alias("shop_name"))
    return master.join(analysis.select(*extra), "content_id", "left").join(p, "item_key", "left")


_DEFAULTS = {"pre_purchase_decision": ("boolean", False), "ai_candidate": ("boolean", False), "ai_influence_level": ("string", ""), "evidence_level": ("string", ""), "match_score": ("int", 0)}
_TERMS = ("ai_source_terms", "ai_action_terms", "purchase_context_terms", "decision_context_terms", "research_terms", "algorithm_terms")


def derived_tables(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """SNP9: all tables that follow from a project's contents (content_master, analysis, products): content_all, reviews_raw,
    qa_pairs_raw, ai_candidates and the summaries by product, keyword and level.

    Contents without an analysis or a product stay, with defaults.  A column that both have comes from the contents, that of the
    analysis with the suffix _analysis; lists of terms are arrays, or text with separators; columns that are lacking count as
    empty.  The tables are views of one plan: whoever writes them all keeps content_all first.
    """
    own = lambda name: tables[name].where(F.col("project_id") == project_id)
    analysis, products, master = own("analysis").drop("project_id", "item_key"), own("products"), own("content_master")
    carried = ["item_key", *(c for c in ("brand_product_id", "brand", "model_name", "product_title_current", "shop_name_current") if c in products.columns)]
    kept_out = master.drop(*carried[1:])  # what a product says comes from the products
    c = content_analysis(kept_out, analysis).join(products.select(*carried), "item_key", "left")
    have = lambda column, kind="string": F.col(column).cast(kind) if column in c.columns else F.lit(None).cast(kind)
    role = F.col("content_role")
    named = {
        "source_file": have("source_file_last"), "product_title": text_or_empty(have("product_title_current")), "shop_name": text_or_empty(have("shop_name_current")), "product_id": have("platform_product_id"),
        "record_type": F.when(role.isin("review", "followup"), "review").when(role.isin("question", "answer"), "qa"), "review_time": have("content_time"), "review_date": have("content_date"), "content_hash": have("identity_key"),
    }
    named |= {x: F.coalesce(have(x, kind), F.lit(default)) for x, (kind, default) in _DEFAULTS.items()}
    kinds = dict(c.dtypes)
    listed = lambda x: F.coalesce(F.col(x) if kinds[x].startswith("array") else split_terms(F.col(x)), F.array().cast("array<string>"))
    named |= {x: listed(x) if x in kinds else F.array().cast("array<string>") for x in _TERMS}
    content = c.withColumns(named)
    content = content if "seq" in content.columns else content.withColumn("seq", F.xxhash64("content_id"))
    found = content.where("ai_candidate")
    return {
        "content_all": content, "reviews_raw": content.where("record_type = 'review'"), "qa_pairs_raw": content.where("record_type = 'qa'"), "ai_candidates": found,
        "summary_by_product": summary_by_product(content), "summary_by_keyword": summary_by_keyword(content), "summary_by_evidence_level": evidence_levels(content).withColumnRenamed("count", "content_count"),
    }


def latest_data_date(content: DataFrame, snapshots: DataFrame, products: DataFrame, today: str) -> DataFrame:
    """SNP12: of each item the latest capture, else the latest date of its contents, else the product's update, else today."""
    s = snapshots.groupBy("item_key").agg(F.max(parse_time(F.col("capture_time"))).alias("a"))
    c = content.groupBy("item_key").agg(F.max(parse_time(F.col("content_date"), F.col("content_time"))).alias("b"))
    p = products.select("item_key", parse_time(F.col("last_updated_at")).alias("c"))
    return p.join(s, "item_key", "left").join(c, "item_key", "left").select("item_key", F.to_date(F.coalesce("a", "b", "c", F.to_timestamp(F.lit(today)))).alias("data_date"))


def stale_items(products: DataFrame, snapshots: DataFrame, now: str, days: int = 14) -> DataFrame:
    """SNP13: items without a capture in the last `days` days, those never captured first."""
    latest = snapshots.groupBy("item_key").agg(F.max(parse_time(F.col("capture_time"))).alias("latest"))
    at = F.to_timestamp(F.lit(now))
    out = products.join(latest, "item_key", "left").where(F.col("latest").isNull() | (F.col("latest") < at - F.expr(f"INTERVAL {days} DAYS")))
    return out.withColumn("days_since_update", F.floor((F.unix_timestamp(at) - F.unix_timestamp("latest")) / 86400)).transform(stalest_first)


def unresolved(queue: DataFrame) -> DataFrame:
    """FLT13."""
    return queue.where(~truthy(F.col("resolved")))


def last_by_window(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row by order of each key, where ties are to be seen in order (a window)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
