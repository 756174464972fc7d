"""Audit of structured model results (LLM8 to LLM12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import input_hash, text_or_empty
from .identity import keep_first

# What results may hold.
SENTIMENTS = ("positive", "negative", "mixed", "neutral", "noise")
TARGETS = ("product", "service", "logistics", "installation", "brand", "mixed", "unclear")
STRENGTHS = ("S", "A", "B", "C", "D")
PRAISE_FAMILIES = ("conclusion", "function", "reference", "trust")
PRAISE_METHODS = ("direct_satisfaction", "function_confirmation", "parameter_perception", "scene_success", "comparison_win", "expectation_exceeded", "value_recognition", "risk_relief", "family_feedback", "repurchase_recommendation", "service_facilitation")
COMPLAINT_FAMILIES = ("product_fact", "scene_fit", "value", "expectation_trust", "fulfillment")
COMPLAINT_METHODS = ("hard_defect", "function_underperformance", "scene_mismatch", "usage_friction", "experience_conflict", "value_doubt", "expectation_gap", "trust_damage", "service_failure", "logistics_packaging")
DEGREES = ("high", "medium", "low")
FIXABILITIES = ("content_explainable", "product_issue", "service_issue", "logistics_issue", "unclear")
EVIDENCE_TARGETS = ("product", "installation", "brand", "mixed")
FLAGS = ("pure_service", "pure_logistics", "template_like", "customer_service_names", "too_short", "irrelevant")

PRAISE = "target string, aspect string, praise_family string, praise_method string, scene string, evidence_quote string, evidence_strength string, business_value string, notes string"
COMPLAINT = "target string, aspect string, complaint_family string, complaint_method string, scene string, evidence_quote string, evidence_strength string, severity string, fixability string, notes string"
RESULT = f"review_id string, valid_review boolean, overall_sentiment string, main_target string, purchase_decision_evidence struct<is_purchase_decision_evidence boolean, evidence_level string, reason string>, praise_items array<struct<{PRAISE}>>, complaint_items array<struct<{COMPLAINT}>>, noise_flags struct<{', '.join(f'{f} boolean' for f in FLAGS)}>, one_sentence_summary string".replace(" string", ": string").replace(" boolean", ": boolean").replace(" array<", ": array<").replace(" struct<", ": struct<")

_ITEM_ENUMS = {
    "praise_items": (("target", TARGETS), ("praise_family", PRAISE_FAMILIES), ("praise_method", PRAISE_METHODS), ("evidence_strength", STRENGTHS), ("business_value", DEGREES)),
    "complaint_items": (("target", TARGETS), ("complaint_family", COMPLAINT_FAMILIES), ("complaint_method", COMPLAINT_METHODS), ("evidence_strength", STRENGTHS), ("severity", DEGREES), ("fixability", FIXABILITIES)),
}


def parse_results(df: DataFrame, column: str = "response") -> DataFrame:
    """LLM8: the JSON of a column as a struct `result`; null where it does not parse."""
    return df.withColumn("result", F.from_json(F.col(column), f"struct<{RESULT}>", {"mode": "PERMISSIVE"}))


def _items(column: str) -> Column:
    return F.coalesce(F.col(column), F.array())


def _not_in(c: Column, values: tuple[str, ...], path: str) -> Column:
    return F.when(~F.coalesce(c.isin(*values), F.lit(False)), path)


def _item_error(name: str, enums: tuple, text: Column):
    """A function of an item: what is wrong with it first."""

    def wrong(x: Column) -> Column:
        quote = F.trim(text_or_empty(x["evidence_quote"]))
        return F.coalesce(*(_not_in(x[c], values, f"{name}.{c}") for c, values in enums), F.when(quote == "", f"{name}.evidence_quote is empty"), F.when(~text.contains(quote), f"{name}.evidence_quote is not in the text"))

    return wrong


def first_error(result: str = "result", text: str = "text") -> Column:
    """LLM8: what is wrong with a result first, in a fixed order; empty if nothing is."""
    r = lambda c: F.col(f"{result}.{c}")
    checks = [F.when(F.col(result).isNull(), "result is not an object")]
    required = ("review_id", "valid_review", "overall_sentiment", "main_target", "purchase_decision_evidence", "praise_items", "complaint_items", "noise_flags", "one_sentence_summary")
    checks += [F.when(r(c).isNull(), f"missing {c}") for c in required]
    enum = _not_in
    checks += [enum(r("overall_sentiment"), SENTIMENTS, "overall_sentiment"), enum(r("main_target"), TARGETS, "main_target"), enum(r("purchase_decision_evidence.evidence_level"), STRENGTHS, "purchase_decision_evidence.evidence_level")]
    checks += [F.when(r(f"noise_flags.{f}").isNull(), f"noise_flags.{f} must be bool") for f in FLAGS]
    for name, enums in _ITEM_ENUMS.items():
        checks.append(F.get(F.array_compact(F.transform(r(name), _item_error(name, enums, text_or_empty(F.col(text))))), F.lit(0)))
    return F.coalesce(*checks, F.lit(""))


def _targets(result: str) -> Column:
    both = F.concat(F.transform(_items(f"{result}.praise_items"), lambda x: x["target"]), F.transform(_items(f"{result}.complaint_items"), lambda x: x["target"]))
    return F.array_distinct(F.filter(both, lambda t: t.isin(*TARGETS) & (t != "unclear")))


def derive(df: DataFrame, result: str = "result") -> DataFrame:
    """LLM9, LLM10: sentiment, main target and purchase evidence from the items themselves."""
    r = lambda c: F.col(f"{result}.{c}")
    praise, complaint = F.size(_items(f"{result}.praise_items")), F.size(_items(f"{result}.complaint_items"))
    noise = F.lit(False)
    for f in FLAGS:
        noise = noise | F.coalesce(r(f"noise_flags.{f}"), F.lit(False))
    sentiment = F.when((praise > 0) & (complaint > 0), "mixed").when(praise > 0, "positive").when(complaint > 0, "negative").when(noise | (r("valid_review") == F.lit(False)), "noise").otherwise("neutral")
    targets = _targets(result)
    target = F.when(F.size(targets) == 0, F.when(r("noise_flags.pure_service"), "service").when(r("noise_flags.pure_logistics"), "logistics").otherwise("unclear")).when(F.size(targets) == 1, targets[0]).otherwise("mixed")
    item = lambda x, method: F.struct(x["target"].alias("target"), x["evidence_strength"].alias("strength"), method.alias("method"))
    both = F.concat(F.transform(_items(f"{result}.praise_items"), lambda x: item(x, F.lit(""))), F.transform(_items(f"{result}.complaint_items"), lambda x: item(x, F.coalesce(x["complaint_method"], F.lit("")))))
    evidence = F.filter(both, lambda x: x["target"].isin(*EVIDENCE_TARGETS))
    rank = F.array_max(F.transform(evidence, lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, reversed(STRENGTHS))), x["strength"]), F.lit(0)), F.lit(1))))
    capped = F.when(F.forall(evidence, lambda x: x["method"] == ""), F.least(rank, F.lit(2))).otherwise(rank)
    level = F.when(F.size(evidence) == 0, "D").otherwise(F.get(F.array(*map(F.lit, reversed(STRENGTHS))), (capped - 1).cast("int")))
    df = df.withColumns({"derived_sentiment": sentiment, "derived_target": target, "derived_level": level})
    return df.withColumn("is_purchase_evidence", F.col("derived_level").isin("S", "A", "B"))


def exploded(df: DataFrame, keys: list[str], kind: str = "praise", result: str = "result") -> DataFrame:
    """LLM11: a row for each item of a kind, numbered from 1."""
    return df.select(*keys, F.posexplode(_items(f"{result}.{kind}_items")).alias("p", "x")).select(*keys, (F.col("p") + 1).alias("item_index"), "x.*")


def distinct_inputs(df: DataFrame, parts: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """LLM12, JS3: rows with input_hash, the first of each, and one row with the number skipped."""
    hashed = df.withColumn("input_hash", input_hash(*map(F.col, parts)))
    return keep_first(hashed, ["input_hash"], seq), hashed.agg((F.count("*") - F.count_distinct("input_hash")).alias("skipped"))
