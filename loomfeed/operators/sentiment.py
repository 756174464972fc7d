"""Model-scored sentiment as data (LLM1 to LLM7, LLM13): batches, a scorer that is passed in, validation in SQL, retries.

A scorer takes an iterator of frames (batch_id, prompt) and gives frames (batch_id, response) with JSON lines; it runs in
mapInPandas, and everything about it stays in columns.  What a scorer raises is the failure of its batch alone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import COMPLAINT_NAMES, PRAISE_NAMES, SENTIMENT_NAMES, SentimentWords
from ..functions.text import json_lines, text_or_empty
from ..lineage import kept_columns
from ..shipping import ship
from .classify import detail_wanted, rule_sentiment
from .joins import unscored, update_analysis

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
FAST = "i string, s string, sc string, p string, n string, c string"


RESPONSES = "batch_id string, response string, error_type string, seconds double, lost array<string>"


def batched(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """LLM1: batch_id over the rows in order, `size` rows a batch.  Rows are sorted in ranges and numbered within each, so that
    no task numbers them all; a range's last batch may be short."""
    place = F.monotonically_increasing_id()  # the range, by 2**33, and the place in it
    ranges = df.repartitionByRange(seq).sortWithinPartitions(seq).withColumn("batch_id", place)
    own = F.col("batch_id")
    return ranges.withColumn("batch_id", F.concat_ws("-", F.shiftright(own, 33).cast("string"), F.floor(own.bitwiseAND(F.lit((1 << 33) - 1)) / size).cast("string")))


def isolated(scorer: Scorer) -> Scorer:
    """LLM2: the scorer with error_type and seconds of each batch, and the ids of a batch that failed.  A frame of batches for
    which it raises is asked again batch by batch, so that the failure stays with the batch that caused it; what is said comes
    out in one frame all the same."""

    def ask(frame: pd.DataFrame) -> list[tuple]:
        began = time.perf_counter()
        said = [row for x in scorer(iter([frame])) for row in zip(x["batch_id"].tolist(), x["response"].tolist(), strict=True)]
        seconds = (time.perf_counter() - began) / max(len(frame), 1)
        return [(*row, None, seconds, None) for row in said]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                rows = ask(frame)
            except Exception:  # noqa: BLE001  whatever a scorer raises
                rows = []
                for i in range(len(frame)):
                    one, began = frame.iloc[i : i + 1], time.perf_counter()
                    try:
                        rows += ask(one)
                    except Exception as e:  # noqa: BLE001
                        lost = [json.loads(line)["i"] for line in one["prompt"].iloc[0].split("\n")]
                        rows.append((one["batch_id"].iloc[0], "", type(e).__name__, time.perf_counter() - began, lost))
            yield pd.DataFrame(rows, columns=["batch_id", "response", "error_type", "seconds", "lost"])

    return run


def asked(batches: DataFrame, scorer: Scorer, keep: Callable[[DataFrame], DataFrame] = kept_columns) -> DataFrame:
    """RESPONSES of a scorer to batches (batch_id, prompt); asked once, since they are kept.  Prompts are not: they hold all
    texts, and of those that failed the ids are in `lost`."""
    ship(batches.sparkSession)
    return keep(batches.select("batch_id", "prompt").mapInPandas(isolated(scorer), RESPONSES))


def prompts(df: DataFrame, text: str = "content_text_clean", title: str = "product_title", seq: str = "seq") -> DataFrame:
    """JS2, LLM2: of each batch one compact JSON line a row, in order."""
    line = F.to_json(F.struct(F.col("content_id").cast("string").alias("i"), F.substring(text_or_empty(F.col(title)), 1, 20).alias("pt"), text_or_empty(F.col(text)).alias("t")))
    return df.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def parsed_lines(responses: DataFrame) -> DataFrame:
    """JS1: the object lines of each response; a batch with a line that does not parse yields none."""
    lines = responses.select("batch_id", F.explode(json_lines(F.col("response"))).alias("line")).withColumn("v", F.expr("try_parse_json(line)"))
    bad = lines.groupBy("batch_id").agg(F.bool_or(F.col("v").isNull()).alias("bad"))
    return lines.join(bad.where("not bad").select("batch_id"), "batch_id")


def valid_fast(lines: DataFrame, seq: str = "line") -> DataFrame:
    """LLM3: rows with six fields, known labels and codes, a score of 1 to 10 and a confidence of 1 to 3, both whole numbers
    (booleans are refused); of several of one id the last."""
    get = lambda k, t="string": F.expr(f"try_variant_get(v, '$.{k}', '{t}')")
    kind = lambda k: F.expr(f"schema_of_variant(variant_get(v, '$.{k}', 'variant'))")
    rows = lines.select("batch_id", seq, *(get(k).alias(k) for k in ("i", "s", "p", "n")), get("sc", "int").alias("sc"), get("c", "int").alias("c"), kind("sc").alias("_sc"), kind("c").alias("_c"))
    whole = F.col("_sc").rlike("INT") & F.col("_c").rlike("INT")
    ok = F.col("i").isNotNull() & F.upper("s").isin(*SENTIMENT_NAMES) & F.col("p").isin(*PRAISE_NAMES) & F.col("n").isin(*COMPLAINT_NAMES) & whole & F.col("sc").between(1, 10) & F.col("c").between(1, 3)
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    return rows.groupBy("i").agg(F.max_by(F.struct("s", "sc", "p", "n", "c"), seq).alias("r")).select("i", "r.*")


def valid_detail(lines: DataFrame) -> DataFrame:
    """LLM4: rows whose four fields are there, one of each id."""
    rows = lines.select("batch_id", "line", *(F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k) for k in ("i", "e", "r", "g")))
    return rows.dropna(subset=["i", "e", "r", "g"]).groupBy("i").agg(F.max_by(F.struct("e", "r", "g"), "line").alias("d")).select("i", "d.*")


def _name(column: str, names: dict[str, str]) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), lambda k, _: k == F.col(column))), F.lit(0))


def with_names(df: DataFrame) -> DataFrame:
    """LLM5: the names of label, praise and complaint codes; unknown codes have none."""
    return df.withColumns({"sentiment_label_cn": _name("sentiment_label", SENTIMENT_NAMES), "praise_name": _name("praise_code", PRAISE_NAMES), "complaint_name": _name("complaint_code", COMPLAINT_NAMES)})


def missing(targets: DataFrame, valid: DataFrame) -> DataFrame:
    """LLM2: targets without a valid row."""
    return targets.join(valid.select(F.col("i").alias("_i")), F.col("content_id").cast("string") == F.col("_i"), "left_anti")


def halves(size: int) -> list[int]:
    """LLM13: batch sizes from size down to one row."""
    return [size] if size <= 1 else [size, *halves(size // 2)]


def score(targets: DataFrame, scorer: Scorer, size: int = 50, retries: int | None = None, keep: Callable[[DataFrame], DataFrame] = kept_columns, read: Callable[[DataFrame], DataFrame] = valid_fast) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LLM2, LLM13: valid rows, failures and timings (turn, batch_id, seconds, error_type).

    What is missing is asked again in batches of half the size each time, down to single rows (or for `retries` turns); a
    failure has the error of its last batch, or MissingResult.  keep makes responses once (a checkpoint or a written table).
    """
    found = timings = None
    left = targets
    for turn, n in enumerate(halves(size)[: None if retries is None else retries + 1]):
        responses = asked(prompts(batched(left, n)), scorer, keep)
        valid = keep(read(parsed_lines(responses)))
        failed = responses.where("error_type is not null").select(F.explode("lost").alias("_i"), F.col("error_type").alias("_error"))
        took = responses.select(F.lit(turn).alias("turn"), "batch_id", "seconds", "error_type")
        found, timings = (b if a is None else a.unionByName(b) for a, b in ((found, valid), (timings, took)))
        left = keep(missing(left, valid))
        if not left.limit(1).count():
            break
    failures = left.join(failed.distinct(), F.col("content_id").cast("string") == F.col("_i"), "left").select("content_id", F.coalesce("_error", F.lit("MissingResult")).alias("error_type"))
    return found, failures, timings


_RULED = "struct<label:string,score:int,praise:string,complaint:string,confidence:int>"


def process(
    comments: DataFrame, scorer: Scorer | None, size: int = 50, words: SentimentWords | None = None, use_rules: bool = True, keep: Callable[[DataFrame], DataFrame] = kept_columns,
    detail_scorer: Scorer | None = None, detail_size: int = 10, detail_limit: int | None = None,
) -> dict[str, DataFrame]:
    """LLM6: rules first, then the scorer for the rest, then the detailed scoring of those that deserve it (CLS11), up to a
    budget over all rows.  A dry run (no scorer) stops after the rules.  Tables: fast, detail, failures, timings, summary."""
    spark = comments.sparkSession
    ruled = comments.withColumn("r", rule_sentiment(F.col("content_text_clean"), words) if use_rules else F.lit(None).cast(_RULED))
    columns = lambda prefix, source: ["content_id", *(F.col(f"{prefix}.{c}").alias(n) for c, n in (("label", "sentiment_label"), ("score", "sentiment_score"), ("praise", "praise_code"), ("complaint", "complaint_code"), ("confidence", "confidence"))), F.lit(source).alias("sentiment_source")]
    by_rule = ruled.where("r is not null").select(*columns("r", "rule"))
    rest = ruled.where("r is null").drop("r")
    no_detail = spark.createDataFrame([], f"content_id {comments.schema['content_id'].dataType.simpleString()}, e string, r string, g string")
    no_timings = spark.createDataFrame([], "stage string, turn int, batch_id string, seconds double, error_type string")
    if scorer is None:
        failures = rest.select("content_id", F.lit("NotScored").alias("error_type"))
        return {"fast": with_names(by_rule), "detail": no_detail, "failures": failures, "timings": no_timings, "summary": run_summary(comments, by_rule, no_detail, failures)}
    found, failures, timings = score(rest, scorer, size, keep=keep)
    ids = rest.select("content_id")
    scored = ids.join(found, F.col("content_id").cast("string") == F.col("i")).select("content_id", F.upper("s").alias("sentiment_label"), F.col("sc").alias("sentiment_score"), F.col("p").alias("praise_code"), F.col("n").alias("complaint_code"), F.col("c").alias("confidence"), F.lit("llm_fast").alias("sentiment_source"))
    fast, timings, detail = by_rule.unionByName(scored), timings.withColumn("stage", F.lit("fast")), no_detail
    if detail_scorer is not None:
        wanted = detail_targets(comments, fast, detail_limit)
        more, lost, took = score(keep(wanted), detail_scorer, detail_size, retries=1, keep=keep, read=valid_detail)
        detail = ids_of(comments).join(more, F.col("content_id").cast("string") == F.col("i")).select("content_id", "e", "r", "g")
        failures, timings = failures.unionByName(lost), timings.unionByName(took.withColumn("stage", F.lit("detail")))
    return {"fast": with_names(fast), "detail": detail, "failures": failures, "timings": timings.select(*no_timings.columns), "summary": run_summary(comments, fast, detail, failures)}


def ids_of(df: DataFrame) -> DataFrame:
    return df.select("content_id").distinct()


def detail_targets(comments: DataFrame, fast: DataFrame, budget: int | None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """CLS11: comments that deserve a detailed scoring, the first `budget` in order."""
    have = lambda c, default: F.col(c) if c in comments.columns else default
    both = comments.join(fast.select("content_id", F.col("sentiment_label").alias("_label"), F.col("confidence").alias("_confidence")), "content_id")
    wanted = detail_wanted(F.col("_label"), F.col("_confidence"), have("evidence_level", F.lit("")), have("likes", F.lit(0)).try_cast("int"), F.col("content_text_clean"), have("pre_purchase_decision", F.lit(False)))
    rows = both.where(wanted) if budget is None else within_budget(both, wanted, budget, list(order))
    return rows.select(*comments.columns)


def run_summary(targets: DataFrame, fast: DataFrame, detail: DataFrame, failures: DataFrame) -> DataFrame:
    """LLM6: one row of counts of a run."""
    t = targets.agg(F.count("*").alias("total_count"))
    f = fast.agg(F.count_if(F.col("sentiment_source") == "rule").alias("rule_count"), F.count_if(F.col("sentiment_source") == "llm_fast").alias("llm_fast_count"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = t.join(f).join(one(detail, "detail_count")).join(one(failures, "failed_count"))  # a row each
    done = F.col("rule_count") + F.col("llm_fast_count")
    return counts.withColumn("status", F.when(F.col("total_count") == 0, "nothing_to_do").when(F.col("failed_count") == 0, "success").when(done > 0, "partial").otherwise("failed"))


def scoring_targets(contents: DataFrame, fast: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """LLM7, JN8, JN9: reviews and follow-ups with text, of a backfill those without a valid label, with their evidence level."""
    rows = contents.where(F.col("content_role").isin("review", "followup") & (F.trim(text_or_empty(F.col("content_text_clean"))) != ""))
    rows = rows if fast is None else unscored(rows, fast)
    if evidence is None:
        return rows
    level = evidence.groupBy("content_id").agg(F.max("evidence_level").alias("evidence_level"))
    return rows.drop("evidence_level").join(level, "content_id", "left").withColumn("evidence_level", text_or_empty(F.col("evidence_level")))


def backfill(tables: dict[str, DataFrame], project_id: str, scorer: Scorer | None, limit: int | None = None, budget: int | None = 50, size: int = 50, full: bool = True, detail_scorer: Scorer | None = None, keep: Callable[[DataFrame], DataFrame] = kept_columns) -> dict[str, DataFrame]:
    """LLM7: score a project's reviews that have no valid label, all items in one run that shares one budget of detailed
    scorings, items in order and rows in theirs (tables: content_master, sentiment_fast, analysis, products).

    Tables of the run, the analysis with its scores, and item_summary: counts of each item.  Without a scorer it is a preview.
    """
    own = lambda name: tables[name].where(F.col("project_id") == project_id)
    rows = scoring_targets(own("content_master"), own("sentiment_fast"), own("analysis"))
    titles = own("products").groupBy("item_key").agg(F.max("product_title_current").alias("product_title"))
    rows = rows.drop("product_title").join(titles, "item_key", "left")
    rows = keep(rows if limit is None else rows.orderBy("seq").limit(max(limit, 0)))
    out = process(rows, scorer, size, use_rules=not full, keep=keep)
    if scorer is not None and detail_scorer is not None:
        wanted = keep(detail_targets(rows, out["fast"], budget, ("item_key", "seq")))
        more, lost, took = score(wanted, detail_scorer, 10, retries=1, keep=keep, read=valid_detail)
        detail = wanted.select("content_id").join(more, F.col("content_id").cast("string") == F.col("i")).select("content_id", "e", "r", "g")
        failures = out["failures"].unionByName(lost)
        out |= {"detail": detail, "failures": failures, "timings": out["timings"].unionByName(took.withColumn("stage", F.lit("detail"))), "summary": run_summary(rows, out["fast"], detail, failures)}
    of_item = lambda df, name: rows.select("item_key", "content_id").join(df.select("content_id"), "content_id").groupBy("item_key").agg(F.count("*").alias(name))
    counts = rows.groupBy("item_key").agg(F.count("*").alias("target_count"))
    for name, df in (("rule_count", out["fast"].where("sentiment_source = 'rule'")), ("llm_fast_count", out["fast"].where("sentiment_source = 'llm_fast'")), ("detail_count", out["detail"]), ("failed_count", out["failures"].dropDuplicates(["content_id"]))):
        counts = counts.join(of_item(df, name), "item_key", "left")
    scores = out["fast"].withColumn("seq", F.lit(0))
    columns = [c for c in ("sentiment_label", "sentiment_score", "praise_code", "complaint_code", "confidence", "sentiment_source") if c in scores.columns]
    return out | {"item_summary": counts.fillna(0), "analysis": update_analysis(own("analysis"), scores, columns)}


def within_budget(df: DataFrame, wanted: Column, budget: int, order: list[str]) -> DataFrame:
    """CLS11, LLM7: the first `budget` wanted rows in order, over all items: a top-k, not a numbering of all."""
    return df.where(wanted).orderBy(*order).limit(budget)
