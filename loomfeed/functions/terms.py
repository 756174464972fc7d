"""Lexicons of any size as data: an index of all terms that finds them in one pass over a text, and gates for patterns.

Terms are rows (kind, term, place).  An automaton over their squeezed lower-case forms reads each squeezed text once, whatever the
number of terms, and what it meets is verified: the case of terms without Latin letters, and by a pattern the terms that
themselves have what squeezing drops.  A pattern is tried only where a text holds a string that every match of it must hold.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .text import _JOINER_CHARS, term_pattern, text_or_empty

#: Terms that an index takes; they are broadcast.
TERMS = 1_000_000
_DROPPED = re.compile(f"[{re.escape(_JOINER_CHARS)}]+")


def squeezed(text: str) -> str:
    """text.squeeze in a worker; most of what goes are spaces, and those go fastest alone."""
    return _DROPPED.sub("", text.replace(" ", ""))


class TermIndex:
    """The terms of each kind, in their order, each once."""

    def __init__(self, kinds: dict[str, Iterable[str]]):
        self.kinds = {k: tuple(dict.fromkeys(terms)) for k, terms in kinds.items()}
        if sum(map(len, self.kinds.values())) > TERMS:
            raise ValueError(f"an index takes {TERMS} terms at most")

    def __getstate__(self) -> dict:
        return {"kinds": self.kinds}

    def __setstate__(self, state: dict) -> None:
        self.kinds = state["kinds"]

    @property
    def automaton(self):
        """Made where it is needed first: string -> [(kind, place, what else must hold)]."""
        if not hasattr(self, "_automaton"):
            import ahocorasick

            found: dict[str, list] = {}
            for k, terms in enumerate(self.kinds.values()):
                for place, term in enumerate(terms):
                    own = re.sub(r"\s+", "", term)
                    bare = squeezed(own)
                    if not bare:
                        continue  # nothing that squeezing leaves
                    latin = bool(re.search("[A-Za-z]", own))
                    # term_pattern writes \s as white space of ASCII, as the JVM reads it
                    check = re.compile(term_pattern(term).replace(r"\s", r" \t\n\x0b\f\r")) if bare != own else None if latin or own == own.lower() else own
                    found.setdefault(bare.lower(), []).append((k, place, check))
            self._automaton = ahocorasick.Automaton()
            for word, entries in found.items():
                self._automaton.add_word(word, (word, entries))
            if found:
                self._automaton.make_automaton()
        return self._automaton

    def find(self, text: str) -> list[list[int]]:
        """Of each kind the places of the terms that the text holds, in order."""
        out: list[list[int]] = [[] for _ in self.kinds]
        if not text or not len(self.automaton):
            return out
        bare, seen = squeezed(text), set()
        for _, (word, entries) in self.automaton.iter(bare.lower()):
            if word in seen:
                continue
            seen.add(word)
            for kind, place, check in entries:
                if check is None or (check in bare if isinstance(check, str) else check.search(text)):
                    out[kind].append(place)
        return [sorted(x) for x in out]

    def lists(self, column: pa.Array) -> list[pa.Array]:
        """Of each kind the terms that each text holds.  A text is copied out at a time, and of what it holds only places stay."""
        found, ends = [array("i") for _ in self.kinds], [array("i", [0]) for _ in self.kinds]
        for x in column:
            for own, end, places in zip(found, ends, self.find(x.as_py()), strict=True):
                own.extend(places)
                end.append(len(own))
        return [pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(terms, pa.string()).take(pa.array(own, pa.int32()))) for own, end, terms in zip(found, ends, self.kinds.values(), strict=True)]

    def matches(self, spark: SparkSession, *texts: Column) -> Column:
        """A struct with an array of the terms found for each kind and text: <kind>_0 for the first text, <kind>_1 for the next..."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self)  # TERMS at most
        names = [f"{kind}_{i}" for i in range(len(texts)) for kind in self.kinds]

        @F.arrow_udf(f"struct<{','.join(f'`{n}`:array<string>' for n in names)}>")
        def hits(*columns: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays([x for column in columns for x in shared.value.lists(column)], names)

        return hits(*map(text_or_empty, texts))


def index_of(terms: DataFrame) -> TermIndex:
    """The index of a table of terms: kind, term and place (their order within a kind)."""
    kinds: dict[str, list[str]] = {}
    rows = terms.select("kind", "term", "place").limit(TERMS + 1).collect()  # a lexicon; more are refused
    for row in sorted(rows, key=lambda r: (r.kind, r.place, r.term)):
        kinds.setdefault(row.kind, []).append(row.term)
    return TermIndex(kinds)


def matched_terms(df: DataFrame, text: str, index: TermIndex) -> DataFrame:
    """df with a row for each term that its text holds: kind and term, in order."""
    found = df.withColumn("_found", index.matches(df.sparkSession, F.col(text)))
    pairs = F.concat(*map(_pairs, index.kinds))
    return found.withColumn("_pair", F.explode(pairs)).select(*df.columns, "_pair.kind", "_pair.term")


def _pairs(kind: str) -> Column:
    return F.transform(F.col(f"_found.{kind}_0"), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))


def literals_of(pattern: str) -> frozenset[str] | None:
    """Strings in lower case of which every match of the pattern holds one (in lower case); None if none can be told."""
    try:
        import re._parser as parser

        tree = parser.parse(pattern)
    except Exception:  # noqa: BLE001  syntax of the JVM alone: no gate
        return None
    found = _needed(list(tree), parser)
    unicode_case = re.match(r"\(\?[a-z]*u", pattern)
    if found is None or min(map(len, found), default=0) == 0 or (unicode_case and any(x.lower() != x.upper() for x in found)):
        return None
    return frozenset(x.lower() for x in found)


def _needed(tree: list, parser) -> set[str] | None:
    """The best of what a sequence of nodes must hold: the set whose shortest string is the longest."""
    options: list[set[str]] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if run:
            options.append({run})
        before, run, own = run, "", None
        if name == "SUBPATTERN":
            own = _needed(list(value[-1]), parser)
        elif name == "ATOMIC_GROUP":
            own = _needed(list(value), parser)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            own = _needed(list(value[2]), parser)
        elif name == "BRANCH":
            parts = [_needed(list(x), parser) for x in value[1]]
            own = set().union(*parts) if all(parts) else None
            heads = [before + "".join(_head(x)) for x in value[1]]  # what stands right before goes on in each
            options += [set(heads)] if all(heads) else []
        elif name == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
            own = {chr(c) for _, c in value}
        if own:
            options.append(own)
    return max(options, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _head(tree) -> list[str]:
    """The characters that a sequence begins with."""
    out = []
    for op, value in tree:
        if str(op) != "LITERAL":
            break
        out.append(chr(value))
    return out


def gated_rlike(text: Column, lower: Column, pattern: str) -> Column:
    """text.rlike(pattern), tried where the text in lower case holds what a match needs."""
    needed = literals_of(pattern)
    if needed is None:
        return text.rlike(pattern)
    gate = F.lit(False)
    for x in sorted(needed):
        gate = gate | lower.contains(x)
    return F.when(gate, text.rlike(pattern)).otherwise(F.lit(False))
