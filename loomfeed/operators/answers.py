"""Incremental scoring (LLM7, LLM12) over a log of answers.

The log keeps the answers of scorers by input_hash: a folder a table (fast, detail, failures, timings), a partition a run.  A run
writes its partitions whole and then its row in the table `runs`; only runs that stand there are read.  So a run that is repeated
after it was stored asks nothing and adds nothing, one that stopped half-way is written over, and later runs ask only for inputs
that no run has answered.  Equal inputs are asked once and answer for all contents that have them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import input_hash, text_or_empty
from ..lineage import kept_columns
from .identity import keep_first
from .sentiment import Scorer, process, scoring_targets

FAST = "input_hash string, sentiment_label string, sentiment_score int, praise_code string, complaint_code string, confidence int, sentiment_source string, sentiment_label_cn string, praise_name string, complaint_name string"
SCHEMAS = {
    "fast": FAST,
    "detail": "input_hash string, e string, r string, g string",
    "failures": "input_hash string, error_type string",
    "timings": "stage string, turn int, batch_id string, seconds double, error_type string",
}
_RUNS = "version string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, run_id string").parquet(path)
    except Exception as e:  # only a path that is not there means that nothing has been stored
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def stored_runs(spark: SparkSession, log: str) -> DataFrame:
    """run_id and version of the runs that are stored whole."""
    found = _read(spark, f"{log}/runs", _RUNS)
    return found if found is not None else spark.createDataFrame([], f"{_RUNS}, run_id string")


def stored(spark: SparkSession, log: str, name: str) -> DataFrame:
    """A table of the log with run_id, of runs that are stored whole."""
    found = _read(spark, f"{log}/{name}", SCHEMAS[name])
    if found is None:
        return spark.createDataFrame([], f"{SCHEMAS[name]}, run_id string")
    return found.join(stored_runs(spark, log).select("run_id"), "run_id", "left_semi")


def store_run(log: str, run: str, tables: dict[str, DataFrame], version: str = "") -> None:
    """Store a run's tables once: if it is stored already, nothing is written."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"not a name of a run: {run!r}")
    spark = next(iter(tables.values())).sparkSession
    if stored_runs(spark, log).where(F.col("run_id") == run).limit(1).count():
        return
    for name, schema in SCHEMAS.items():
        rows = tables[name].select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))))
        rows.write.mode("overwrite").parquet(f"{log}/{name}/run_id={run}")
    spark.createDataFrame([(version,)], _RUNS).coalesce(1).write.mode("overwrite").parquet(f"{log}/runs/run_id={run}")


def answers(spark: SparkSession, log: str, name: str) -> DataFrame:
    """One answer for each input: of several runs that asked at the same time the one with the least run_id."""
    return keep_first(stored(spark, log, name), ["input_hash"], "run_id")


def incremental(
    contents: DataFrame, evidence: DataFrame | None, make_scorer: Callable[[], Scorer] | None, log: str, project_id: str, update_id: str, version: str = "", size: int = 50,
    detail_scorer: Scorer | None = None, detail_limit: int | None = None, full: bool = True, keep: Callable[[DataFrame], DataFrame] = kept_columns,
) -> dict[str, DataFrame]:
    """LLM7: score the new contents of an import (content_id, item_key, content_role, content_text_clean, product_title, seq).

    version names scorer and prompt; answers of other versions are not taken.  make_scorer gives the scorer when there is
    something to ask; what it raises makes the run failed_to_start (rules still count, nothing is stored).  None: scoring is off.
    Tables with project_id and update_id: sentiment_fast, sentiment_detail (each content with its answer and answered_in, the run
    that gave it), sentiment_failures, sentiment_timings and sentiment_run_summary.  Contents without text and questions are no
    targets; a repeated content has a row each; of equal inputs the evidence of the first decides about its detail.
    """
    spark = contents.sparkSession
    title = F.col("product_title") if "product_title" in contents.columns else F.lit("")
    hashed = input_hash(F.lit(version), F.substring(text_or_empty(title), 1, 20), text_or_empty(F.col("content_text_clean")))
    used = ["content_id", "item_key", "input_hash", "seq", "content_text_clean", "product_title", "evidence_level", "likes", "pre_purchase_decision"]
    asking = scoring_targets(contents, None, evidence).withColumn("input_hash", hashed)
    asking = asking.select(*(c for c in used if c in asking.columns))
    targets = keep(asking.select("content_id", "item_key", "input_hash"))  # without their texts, which only those to be asked need
    error = None
    if make_scorer is not None and not stored_runs(spark, log).where(F.col("run_id") == update_id).limit(1).count():
        fresh = asking.join(answers(spark, log, "fast").select("input_hash"), "input_hash", "left_anti")
        fresh = keep(keep_first(fresh, ["input_hash"], "seq").withColumn("content_id", F.col("input_hash")))
        try:
            scorer = make_scorer() if fresh.limit(1).count() else None
        except Exception as e:  # the scorer cannot be had: the run ends with what rules say
            scorer, error = None, type(e).__name__
        out = process(fresh, scorer, size, use_rules=not full, keep=keep, detail_scorer=detail_scorer, detail_limit=detail_limit)
        own = {name: df.withColumnRenamed("content_id", "input_hash") for name, df in out.items() if name in SCHEMAS}
        if error is None:
            store_run(log, update_id, own, version)
        else:
            own["failures"] = own["failures"].withColumn("error_type", F.lit(error))
    said = {name: answers(spark, log, name).withColumnRenamed("run_id", "answered_in") for name in ("fast", "detail")}
    mine = {name: stored(spark, log, name).where(F.col("run_id") == update_id).drop("run_id") for name in ("failures", "timings")}
    if error is not None:
        said["fast"] = said["fast"].unionByName(own["fast"].withColumn("answered_in", F.lit(update_id)), allowMissingColumns=True)
        mine["failures"] = own["failures"]
    marked = lambda df: df.withColumns({"project_id": F.lit(project_id), "update_id": F.lit(update_id)})
    if make_scorer is None:
        said = {name: df.limit(0) for name, df in said.items()}
    fast, detail = (targets.join(said[name], "input_hash") for name in ("fast", "detail"))
    failures = targets.join(mine["failures"].distinct(), "input_hash")
    own_run = F.col("answered_in") == update_id
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(targets, "target_count"), count(detail, "detail_count"), failures.agg(F.count_distinct("content_id").alias("failed_count")),
        fast.agg(F.count_if(~own_run).alias("reused_count"), F.count_if(own_run & (F.col("sentiment_source") == "rule")).alias("rule_count"), F.count_if(own_run & (F.col("sentiment_source") != "rule")).alias("llm_fast_count")),
    ]
    summary = reduce(lambda a, b: a.join(b), parts)  # a row each
    status = F.lit("disabled") if make_scorer is None else F.lit("failed_to_start") if error else F.when(F.col("failed_count") == 0, "success").otherwise("partial")
    summary = summary.withColumns({"status": status, "strategy": F.lit("full_llm" if full else "rules_then_llm"), "sentiment_version": F.lit(version)})
    return {f"sentiment_{name}": marked(df) for name, df in (("fast", fast), ("detail", detail), ("failures", failures), ("timings", mine["timings"]), ("run_summary", summary))}
