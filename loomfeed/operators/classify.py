"""Lexicon classification of review texts (CLS1 to CLS11): Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import PRE_PURCHASE_LABELS, RESEARCH_LABELS, Lexicon, SentimentWords
from ..functions.terms import TermIndex, gated_rlike
from ..functions.text import drop_contained, latin_token, matched_sentence, text_or_empty

_EMPTY = "array<string>"


def _labels(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in pairs)))


def _hit(text: Column, lexicon: Lexicon, name: str, lower: Column | None = None) -> Column:
    pattern = lexicon.patterns.get(name)
    return gated_rlike(text, F.lower(text) if lower is None else lower, pattern) if pattern else F.lit(False)


def _without_false_comparisons(text: Column, lexicon: Lexicon, lower: Column | None = None) -> Column:
    pattern = lexicon.patterns.get("false_compare")
    return F.when(_hit(text, lexicon, "false_compare", lower), F.regexp_replace(text, pattern, "")).otherwise(text) if pattern else text


def block_reason(text: Column, lexicon: Lexicon, lower: Column | None = None) -> Column:
    """CLS1: why a text is no text from before a purchase; empty if nothing speaks against it.  lower: the text in lower case,
    where it is a column already."""
    hit = lambda name: _hit(text, lexicon, name, lower)
    phrases = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in lexicon.merchant_terms], F.lit(0))
    free = ~hit("anchor")
    return (F.when((phrases >= 2) | hit("merchant_reply"), "merchant_reply_like_text").when(hit("price_dispute") & free, "after_purchase_price_dispute")
        .when(hit("post_comparison") & free, "post_purchase_comparison").when(hit("post_purchase") & free, "post_purchase_experience").otherwise(""))


def research_terms(text: Column, plain: Column, found: Column, lexicon: Lexicon, lower: Column | None = None, plain_lower: Column | None = None) -> Column:
    """CLS2: terms of intensive research (found: those of the text without false comparisons) and two derived labels."""
    derived = _labels((_hit(plain, lexicon, "inferred_research", plain_lower), RESEARCH_LABELS[0]), (_hit(text, lexicon, "info_search", lower) & _hit(text, lexicon, "choosing", lower), RESEARCH_LABELS[1]))
    return F.array_union(found, derived)


def pre_purchase_terms(text: Column, plain: Column, found: Column, lexicon: Lexicon, lower: Column | None = None, plain_lower: Column | None = None) -> Column:
    """CLS3: labels of a purchase decision, then the lexicon's decision terms (found: as above)."""
    labels = _labels(*((_hit(plain, lexicon, name, plain_lower) if name == "true_compare" else _hit(text, lexicon, name, lower), label) for name, label in PRE_PURCHASE_LABELS.items()))
    terms = found
    if lexicon.ambiguous and "false_compare" in lexicon.patterns:
        terms = F.when(_hit(text, lexicon, "false_compare", lower), F.filter(terms, lambda t: ~t.isin(*lexicon.ambiguous))).otherwise(terms)
    return F.array_union(labels, terms)


def source_terms(text: Column, lexicon: Lexicon, specific: Column, generic: Column, lower: Column | None = None) -> tuple[Column, Column]:
    """TXT7, TXT8: specific sources (the longest of those that hold one another) and generic ones; specific and generic: the terms
    found.  The forms of the Latin token are found by its neighbours instead, each in its place among the generic terms."""
    forms = [t for t in dict.fromkeys(lexicon.generic) if t in (lexicon.token, ".".join(lexicon.token) + ".")]
    if not forms:
        return drop_contained(specific), generic
    place = {t: i for i, t in reversed(list(enumerate(lexicon.generic)))}
    first = min(place[t] for t in forms)
    token = F.when(latin_token(text, lexicon.token, lexicon.token_before, lexicon.token_after, lower), F.array(F.lit(lexicon.token))).otherwise(F.array().cast(_EMPTY))
    before, after = [t for t in lexicon.generic if t not in forms and place[t] < first], [t for t in lexicon.generic if t not in forms and place[t] > first]
    side = lambda terms: F.filter(generic, lambda t: t.isin(*terms)) if terms else F.array().cast(_EMPTY)
    return drop_contained(specific), F.concat(side(before), token, side(after))


def term_index(lexicon: Lexicon) -> TermIndex:
    """CLS9 as data: all terms of the lexicon by kind; specific sources are met longest first."""
    return TermIndex({
        "specific": sorted(lexicon.specific, key=len, reverse=True), "generic": lexicon.generic, "weak": lexicon.weak, "research": lexicon.research,
        "actions": lexicon.actions, "purchase": lexicon.purchase, "decision": lexicon.decision,
    })


def classify(df: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """CLS8: df (content_role, content_text_clean, parent_text_clean) with the classifier's columns; terms stay arrays.

    All terms of all kinds are found in one pass over the text, the text without false comparisons and the parent's; patterns are
    tried where a text holds what they need.
    """
    lexicon = lexicon or Lexicon()
    # What all rules look at is made once a row, before them.
    df = df.withColumns({"_text": text_or_empty(F.col("content_text_clean")), "_parent_text": text_or_empty(F.col("parent_text_clean"))})
    text, parent, plain, lower, parent_lower = (F.col(c) for c in ("_text", "_parent_text", "_plain", "_lower", "_parent_lower"))
    df = df.withColumns({"_lower": F.lower(text), "_parent_lower": F.lower(parent)})
    df = df.withColumn("_plain", _without_false_comparisons(text, lexicon, lower))
    # The plain text is read again only where it differs.
    df = df.withColumn("_plain_lower", F.when(plain != text, F.lower(plain)).otherwise(lower))
    df = df.withColumn("_terms", term_index(lexicon).matches(df.sparkSession, text, parent, F.when(plain != text, plain)))
    own, of_parent = (lambda kind: F.col(f"_terms.{kind}_0")), (lambda kind: F.col(f"_terms.{kind}_1"))
    of_plain = lambda kind: F.when(plain != text, F.col(f"_terms.{kind}_2")).otherwise(own(kind))
    hit = lambda name: _hit(text, lexicon, name, lower)
    strong, generic = source_terms(text, lexicon, own("specific"), own("generic"), lower)
    parent_strong, parent_generic = source_terms(parent, lexicon, of_parent("specific"), of_parent("generic"), parent_lower)
    lit = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast(_EMPTY)
    algorithm = [t for t in lexicon.generic if t in lexicon.weak]
    df = df.withColumns({
        "_strong": strong, "_generic": generic, "_weak": own("weak"), "_parent": F.when(parent != "", F.size(parent_strong) + F.size(parent_generic)).otherwise(0),
        "_block": block_reason(text, lexicon, lower), "_human": hit("human_service"), "_actions": own("actions"), "_purchase": own("purchase"), "_decision": of_plain("decision"),
        "_pre": pre_purchase_terms(text, plain, of_plain("decision"), lexicon, lower, F.col("_plain_lower")), "_research": research_terms(text, plain, of_plain("research"), lexicon, lower, F.col("_plain_lower")),
    })
    blocked = F.col("_block") != ""
    nothing = F.array().cast(_EMPTY)
    df = df.withColumns({"_pre": F.when(blocked, nothing).otherwise(F.col("_pre")), "_research": F.when(blocked, nothing).otherwise(F.col("_research")), "_sources": F.array_union(F.concat("_strong", "_generic"), "_weak")})
    df = df.withColumns({"_general": F.array_intersect("_sources", lit(lexicon.generic)), "_algorithm": F.array_intersect("_sources", lit(algorithm))})
    any_of = lambda name: F.size(name) > 0
    no_source = ~any_of("_sources")
    human_only = F.col("_human") & no_source
    inferred = any_of("_research") & any_of("_pre") & no_source & ~blocked
    # CLS5: what speaks for a candidate, and what is said of the others.
    gate = any_of("_strong") | (any_of("_general") & ~human_only) | inferred
    exclude = (F.when(human_only, "human_service_only").when(blocked, F.col("_block")).when(no_source & ~any_of("_research"), "no_source_or_research")
        .when(any_of("_research") & ~any_of("_pre"), "research_without_purchase_context").otherwise(""))
    reason = F.when(gate & ~human_only & ~blocked, F.when(any_of("_strong"), "specific_source").when(any_of("_general"), "generic_source").otherwise("intensive_research")).otherwise(exclude)
    # CLS6: the score; CLS7: the level, which decides whether a row is a candidate.
    score = (6 * F.size("_strong") + 4 * F.size("_general") + 2 * F.size("_weak") + 2 * F.size("_research") + 3 * any_of("_actions").cast("int") + 2 * any_of("_purchase").cast("int")
        + 2 * (any_of("_decision") | any_of("_pre")).cast("int") + (F.col("content_role").isin("question", "answer") & ((F.size("_strong") + F.size("_generic") > 0) | (F.col("_parent") > 0))).cast("int"))
    level = F.when(blocked, "").when(any_of("_strong"), "A").when(any_of("_general"), "B").when(inferred, "C").when(any_of("_pre"), "D").otherwise("")
    kind = (F.when(any_of("_strong"), "specific_ai").when(any_of("_algorithm"), "algorithm_or_system").when(any_of("_general"), "generic_ai")
        .when(any_of("_research"), F.when(F.col("_human"), "mixed_research_and_customer_service").when(hit("social"), "social_media_research").when(hit("search"), "search_research").otherwise("content_research"))
        .when(F.col("_human"), "customer_service").when(hit("friends"), "friends_or_family").otherwise("unknown"))
    terms = F.array_distinct(F.concat("_sources", "_research", "_actions", "_purchase", "_decision", "_pre"))
    df = df.withColumns({"evidence_level": level, "match_score": score, "source_type": kind, "ai_candidate_gate_reason": reason, "matched_keywords": terms, "_exclude": exclude})
    candidate = F.col("evidence_level").isin("A", "B", "C")
    df = df.withColumns({
        "ai_candidate": candidate, "excluded_by_rule": ~candidate, "exclude_reason": F.when(candidate, "").when(blocked, F.col("_block")).otherwise(F.col("_exclude")),
        "ai_evidence_type": F.when(F.col("evidence_level") == "A", "explicit").when(F.col("evidence_level") == "B", "generic").when(F.col("evidence_level") == "C", "inferred").otherwise("none"),
        "pre_purchase_decision": any_of("_pre"), "pre_purchase_terms": F.col("_pre"), "research_terms": F.col("_research"), "algorithm_terms": F.col("_algorithm"),
        "ai_source_terms": F.col("_sources"), "ai_action_terms": F.col("_actions"), "purchase_context_terms": F.col("_purchase"), "decision_context_terms": F.col("_decision"),
        "block_reason": F.col("_block"), "matched_sentence": matched_sentence(text, F.col("matched_keywords")),
    })
    return df.drop("_text", "_parent_text", "_plain", "_lower", "_parent_lower", "_plain_lower", "_terms", "_strong", "_generic", "_weak", "_parent", "_block", "_human", "_actions", "_purchase", "_decision", "_pre", "_research", "_sources", "_general", "_algorithm", "_exclude")


def rule_sentiment(text: Column, words: SentimentWords | None = None) -> Column:
    """CLS10: struct(label, score, praise, complaint, confidence) of what rules can tell; null otherwise."""
    words = words or SentimentWords()
    compact = F.regexp_replace(text_or_empty(text), r"(?U)\s+", "")
    has = lambda terms: reduce(lambda a, b: a | b, [compact.contains(t) for t in terms], F.lit(False))
    result = lambda score, praise, confidence: F.struct(F.lit("P").alias("label"), F.lit(score).alias("score"), F.lit(praise).alias("praise"), F.lit("-").alias("complaint"), F.lit(confidence).alias("confidence"))
    clear = (compact != "") & ~has(words.mixed) & ~has(words.negative)
    return F.when(clear & has(words.service) & has(words.service_positive), result(8, "V", 3)).when(clear & (F.length(compact) <= 12) & has(words.positive), result(7, "-", 2))


def detail_wanted(label: Column, confidence: Column, level: Column, likes: Column, text: Column, decision: Column) -> Column:
    """CLS11: rows that deserve a second, detailed scoring."""
    parts = [label.isin("N", "M"), confidence == 1, level.isin("A", "B", "C"), likes >= 5, F.length(text) >= 80, decision]
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])
