"""Import of a batch of captures into the store (SNP8), in one pass over all captures of all items.

Captures of one item take effect in order (by capture time, those without one first, then by id), but no capture waits for
another: what each finds in the master follows from who brought each identity first.

- Gate: a capture is late if it is older than the item's latest stored one, and a duplicate if its bytes are stored or were
  accepted earlier in the batch; both are windows over captures, not over contents.
- Contested: a content is new if nothing else holds a key of it, in the store or in another capture.  One aggregate over hashes of
  keys tells who else there is; only contents and stored rows with such a key (equal hashes cost a look, no more) are compared.
- Identity: contents with equal keys are one signature.  A signature enters the master with its first capture, unless the store,
  or a signature that entered with an earlier capture, has its strict or composite key (or its text key, where it has nothing
  else to tell it by).  Who enters can hang on who else enters, so signatures are decided in rounds, all items at once; the
  number of rounds is the length of the longest chain of such doubts (mostly one), whatever the number of captures.
- Sights: a content's last sight is the latest capture that holds it, and it is active if that is the item's latest.

Defined cases: a capture fails by itself, and leaves the rest alone, if it names no item or no snapshot, if its time is written but
cannot be read, if one snapshot id stands for several captures' bytes or times, or if its reader says so (a column `error`);
captures without a hash are no duplicates; rows of one capture with one identity each become a content; an empty batch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time, text_or_empty
from ..lineage import kept
from .identity import AUXILIARY
from .snapshots import backfill_gate, new_content_id, review_queue, split_duplicates, update_log

CAPTURE = ["project_id", "item_key", "snapshot_id"]
KEYS = ["strict_key", "composite_key", "text_key"]
_SIGN = ["item_key", *KEYS, "_bare"]


def _blank(c: str) -> Column:
    return F.trim(text_or_empty(F.col(c))) == ""


def capture_problem(batch: DataFrame) -> Column:
    """An aggregate over a capture's rows: why it cannot be imported, null if it can."""
    own = F.max("error") if "error" in batch.columns else F.lit(None).cast("string")
    time = F.col("capture_time")
    return F.coalesce(
        own, F.when(F.max(_blank("item_key")), "missing_item"), F.when(F.max(_blank("snapshot_id")), "missing_snapshot"),
        F.when(F.max(~_blank("capture_time") & parse_time(time).isNull()), "unreadable_time"),
        F.when((F.min("file_hash") != F.max("file_hash")) | (F.min("capture_time") != F.max("capture_time")), "ambiguous_snapshot"),
    )


def capture_states(batch: DataFrame, snapshots: DataFrame, allow_backfill: bool = False) -> DataFrame:
    """A row for each capture of the batch: its turn among its item's, is_backfill, status (accepted, fallback, rejected,
    duplicate_file, failed) and error."""
    about = ["file_hash", "capture_time", "source_file"]
    said = batch.groupBy(*CAPTURE, *about, *(["error"] if "error" in batch.columns else [])).agg(F.count("*").alias("_rows"))  # mostly a row for each capture
    files = said.groupBy(*CAPTURE).agg(*(F.max(c).alias(c) for c in about), F.sum("_rows").alias("extracted_count"), capture_problem(said).alias("error"))
    in_order = Window.partitionBy("project_id", "item_key").orderBy(F.asc_nulls_first(parse_time(F.col("capture_time"))), "snapshot_id")
    judged = backfill_gate(split_duplicates(files, snapshots), snapshots, allow_backfill).withColumn("turn", F.row_number().over(in_order))
    fit = F.col("error").isNull() & ~F.col("is_duplicate") & (F.col("status") != "rejected")
    earlier = Window.partitionBy("project_id", "item_key", "file_hash").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    again = ~_blank("file_hash") & (F.coalesce(F.sum(fit.cast("int")).over(earlier), F.lit(0)) > 0)
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("is_duplicate") | again, "duplicate_file").otherwise(F.col("status"))
    return judged.withColumn("status", status).drop("is_duplicate")


def _tokens(*kinds: str, also: Column | None = None) -> Column:
    """The keys of these kinds that are not empty; the text key only where `also` says so."""
    named = [(c, F.concat(F.lit(f"{c}:"), F.when(also, F.col(c)) if also is not None and c == "text_key" else F.col(c))) for c in kinds]
    return F.array_compact(F.array(*(F.when(text_or_empty(F.col(c)) != "", token) for c, token in named)))


def contested(rows: DataFrame, master: DataFrame) -> DataFrame:
    """The prints (_print) of rows (with turn) and of stored rows that have a key which the store and a capture, or several
    captures, hold.  Keys are compared by hashes, so a print can be there without need, but none is missing."""
    hashes = F.array_compact(F.array(*(F.when(text_or_empty(F.col(c)) != "", F.xxhash64(F.lit(c), "item_key", c)) for c in KEYS)))
    held = rows.select("_print", F.col("turn").cast("int").alias("turn"), F.explode(hashes).alias("key")).unionByName(master.select("_print", F.lit(0).alias("turn"), F.explode(hashes).alias("key")))
    shared = held.groupBy("key").agg(F.min("turn").alias("least"), F.max("turn").alias("most")).where("least < most").select("key")
    return held.join(shared, "key", "left_semi").select("_print").distinct()


def entering(signatures: DataFrame, master: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """The signatures (item_key, the keys, _bare and first: the turn of their first capture) that enter the master with it."""
    items = signatures.select("item_key").distinct()
    stored = master.join(items, "item_key", "left_semi").select("item_key", F.explode(_tokens(*KEYS)).alias("token")).distinct()
    known = stored.withColumn("known", F.lit(0))
    left, entered = signatures, None
    while True:
        doubt = left.select("item_key", F.explode(_tokens(*KEYS)).alias("token"), "first").groupBy("item_key", "token").agg(F.min("first").alias("doubt"))
        asks = left.select(*_SIGN, "first", F.explode_outer(_tokens(*KEYS, also=F.col("_bare"))).alias("token"))
        told = asks.join(known, ["item_key", "token"], "left").join(doubt, ["item_key", "token"], "left")
        told = keep(told.groupBy(*_SIGN, "first").agg(F.coalesce(F.bool_or(F.col("known") < F.col("first")), F.lit(False)).alias("found"), F.coalesce(F.bool_or(F.col("doubt") < F.col("first")), F.lit(False)).alias("open")))
        new = told.where("not found and not open").select(*_SIGN, "first")
        entered = new if entered is None else entered.unionByName(new)
        left = told.where("not found and open").select(*_SIGN, "first")
        if left.isEmpty():
            return entered
        brought = new.select("item_key", F.explode(_tokens(*KEYS)).alias("token"), F.col("first").alias("known"))
        known = keep(known.unionByName(brought).groupBy("item_key", "token").agg(F.min("known").alias("known")))


def compare_captures(master: DataFrame, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept, seq: str = "seq") -> DataFrame:
    """MAT2 for many captures at once: rows (with turn) with status (existing, uncertain, new) and master_content_id, as if the
    captures of an item were compared one after the other, each with the master that the ones before leave.  Rows that nothing else
    has to do with are _alone; new ones have _own_id."""
    bare = F.lit(True)
    for c in (*AUXILIARY, "parent_text_clean"):
        bare = bare & _blank(c)
    own_print, own_id = F.xxhash64("item_key", *KEYS), new_content_id(F.col("snapshot_id"), F.col("identity_key"), F.col(seq))
    rows, master = rows.withColumns({"_bare": bare, "_print": own_print}), master.select("item_key", *KEYS, seq, "content_id", own_print.alias("_print"))
    prints = keep(contested(rows, master)).withColumn("_contested", F.lit(True))
    rows = keep(rows.join(prints, "_print", "left").withColumn("_own_id", F.when(F.col("_contested").isNull(), own_id)).drop("_print"))
    alone = rows.where("_contested is null").drop("_contested", "_bare").withColumns({"_alone": F.lit(True), "status": F.lit("new"), "master_content_id": F.lit(None).cast("string")})
    rows, master = rows.where("_contested").drop("_contested", "_own_id").withColumn("_alone", F.lit(False)), keep(master.join(prints, "_print", "left_semi").drop("_print"))
    safe = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in _SIGN]
    first = keep(rows.groupBy(*_SIGN).agg(F.min("turn").alias("first")))
    new = entering(first, master, keep).select(*(F.col(c).alias(f"_s_{c}") for c in _SIGN), F.col("first").alias("_first"))
    matched = safe[0]
    for s in safe[1:]:
        matched = matched & s
    rows = rows.join(new, matched & (F.col("turn") == F.col("_first")), "left").withColumn("_new", F.col("_first").isNotNull()).drop(*new.columns)
    rows = keep(rows.withColumn("_own_id", F.when(F.col("_new"), own_id)))
    columns = ["item_key", *KEYS, F.col(seq).cast("long").alias("_seq")]
    items = rows.select("item_key").distinct()
    held = master.join(items, "item_key", "left_semi").select(*columns, F.col("content_id").alias("_id"), F.lit(0).alias("_at")).unionByName(rows.where("_new").select(*columns, F.col("_own_id").alias("_id"), F.col("turn").alias("_at")))
    out = rows
    for key in KEYS[:2]:  # once a key is known no later capture adds it, so who has it is settled
        side = held.where(text_or_empty(F.col(key)) != "").groupBy("item_key", key).agg(F.max_by("_id", "_seq").alias(f"_{key}_id"), F.min("_at").alias(f"_{key}_at"))
        out = out.join(side, ["item_key", key], "left").withColumn(f"_{key}_id", F.when(F.col(f"_{key}_at") < F.col("turn"), F.col(f"_{key}_id")))
    out = out.withColumn("_found", F.coalesce("_strict_key_id", "_composite_key_id"))
    # Of a text key the first by seq counts, among those that earlier captures have left.
    adds = held.where(text_or_empty(F.col("text_key")) != "").groupBy("item_key", "text_key", F.col("_at").alias("turn")).agg(F.min(F.struct("_seq", "_id")).alias("_least"))
    asks = out.where(F.col("_found").isNull() & ~F.col("_new")).select("item_key", "text_key", "turn").distinct().withColumn("_least", F.lit(None).cast(adds.schema["_least"].dataType)).withColumn("_ask", F.lit(True))
    before = Window.partitionBy("item_key", "text_key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    least = adds.withColumn("_ask", F.lit(False)).unionByName(asks).withColumn("_text_id", F.min("_least").over(before)["_id"]).where("_ask").select("item_key", "text_key", "turn", "_text_id")
    out = out.join(least, ["item_key", "text_key", "turn"], "left")
    status = F.when(F.col("_new"), "new").when(F.col("_found").isNotNull(), "existing").otherwise("uncertain")
    out = out.withColumn("status", status).withColumn("master_content_id", F.when(F.col("status") == "existing", F.col("_found")).when(F.col("status") == "uncertain", F.col("_text_id")))
    return alone.unionByName(keep(out.drop("_bare", "_new", "_found", "_text_id", *(f"_{k}_{x}" for k in KEYS[:2] for x in ("id", "at")))))


def master_after(master: DataFrame, compared: DataFrame, captures: DataFrame) -> DataFrame:
    """SNP3 for many captures at once.  compared has turn, is_backfill, status, master_content_id, _alone, _own_id of new rows and
    _latest, the latest turn of its item that is on time; captures has a row with item_key and _latest for each capture."""
    sight = F.struct("snapshot_id", "capture_time", "source_file")
    hits = compared.where("not is_backfill and status = 'existing'").groupBy(F.col("master_content_id").alias("content_id")).agg(F.max("turn").alias("_hit"), F.max_by(sight, "turn").alias("_sight"))
    latest = captures.groupBy("item_key").agg(F.max("_latest").alias("_latest"))
    fresh = compared.where("status = 'new'").withColumns({
        "content_id": F.col("_own_id"), "is_active": ~F.col("is_backfill"), "_own": F.when(~F.col("is_backfill"), F.col("turn")),
        **{f"{side}_seen_snapshot_id": F.col("snapshot_id") for side in ("first", "last")}, **{f"{side}_seen_at": F.col("capture_time") for side in ("first", "last")}, **{f"source_file_{side}": F.col("source_file") for side in ("first", "last")},
    })
    pick = [F.col(x).cast(t).alias(x) if x in fresh.columns else F.lit(None).cast(t).alias(x) for x, t in master.dtypes]
    fresh = fresh.select(*pick, "_own", "_latest", "_alone")
    stored = master.withColumns({"_own": F.lit(None).cast("int"), "_alone": F.lit(False)}).join(latest, "item_key", "left")
    seen = stored.unionByName(fresh.where("not _alone")).join(hits, "content_id", "left")
    now = {"last_seen_snapshot_id": "snapshot_id", "last_seen_at": "capture_time", "source_file_last": "source_file"}
    seen = seen.withColumns({c: F.when(F.col("_hit").isNotNull(), F.col("_sight")[v]).otherwise(F.col(c)) for c, v in now.items()}).drop("_sight")
    both = seen.unionByName(fresh.where("_alone").withColumn("_hit", F.lit(None).cast("int")))  # nothing else can have seen these
    last = F.greatest(F.col("_own"), F.col("_hit")) == F.col("_latest")
    return both.withColumn("is_active", F.when(F.col("_latest").isNotNull(), F.coalesce(last, F.lit(False))).otherwise(F.col("is_active"))).select(*master.columns)


def import_batch(tables: dict[str, DataFrame], batch: DataFrame, allow_backfill: bool = False, keep: Callable[[DataFrame], DataFrame] = kept) -> dict[str, DataFrame]:
    """SNP8: captures of items (identity keys, snapshot_id, capture_time, source_file, file_hash, seq), any number of each.

    Tables: content_master and snapshots as they are afterwards, review_queue, update_log (a row for each capture), rejects
    (duplicates, late and failed captures with their error), results (a row for each capture: what became of it) and compared.
    The caller's tables are not written: a preview is the same call.  keep makes a table once (a checkpoint).
    """
    states = keep(capture_states(batch, tables["snapshots"], allow_backfill))
    good = states.where("status in ('accepted', 'fallback')").withColumn("_latest", F.max(F.when(~F.col("is_backfill"), F.col("turn"))).over(Window.partitionBy("item_key")))
    compared = compare_captures(tables["content_master"], batch.join(good.select(*CAPTURE, "turn", "is_backfill", "_latest"), CAPTURE), keep)
    added = good.select(*CAPTURE, "file_hash", "capture_time", F.col("capture_time").alias("imported_at"), "source_file", F.col("extracted_count").cast("string").alias("extracted_count"))
    log = update_log(compared, "snapshot_id")
    results = states.join(log.select("item_key", "snapshot_id", "result", "new_count", "existing_count", "uncertain_count"), ["item_key", "snapshot_id"], "left")
    results = results.select(*CAPTURE, "source_file", F.coalesce("result", "status").alias("result"), "error", "is_backfill", "extracted_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("new_count", "existing_count", "uncertain_count")))
    return {
        "content_master": master_after(tables["content_master"], compared, good), "snapshots": tables["snapshots"].unionByName(added, allowMissingColumns=True), "review_queue": review_queue(compared),
        "update_log": log, "rejects": states.where("status not in ('accepted', 'fallback')").select("snapshot_id", "item_key", "status", "error"), "results": results, "compared": compared.drop("_own_id", "_alone", "_latest"),
    }
