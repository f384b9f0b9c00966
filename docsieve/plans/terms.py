"""Clauses that name terms by a test (fuzzy, wildcard, regex, range): the test, and the terms of a vocabulary that pass it."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.errors import SearchError
from docsieve.functions import analysis
from docsieve.parser import Bool, Leaf

#: Kinds of clause that name terms by a test.
TESTED = ("fuzzy", "wildcard", "regex", "range")


def osa(term: Column, word: str) -> Column:
    """Restricted edit distance: insert, delete, change, or swap neighbours, with no place edited twice.

    One row of the table for each character of the term; the row before the last is kept for swaps."""
    m = len(word)
    if not m:
        return F.length(term)
    letters = F.array(*(F.struct(F.lit(j + 1).alias("j"), F.lit(c).alias("c"), F.lit(word[j - 1] if j else "").alias("before")) for j, c in enumerate(word)))
    start = F.struct(F.array(*map(F.lit, range(m + 1))).alias("older"), F.array(*map(F.lit, range(m + 1))).alias("old"), F.lit("").alias("last"))

    def step(held: Column, c: Column) -> Column:
        def cell(row: Column, x: Column) -> Column:
            j = x["j"]
            swap = F.when((j > 1) & (held["last"] != "") & (c == x["before"]) & (held["last"] == x["c"]), F.get(held["older"], j - 2) + 1)
            return F.concat(row, F.array(F.least(F.get(held["old"], j) + 1, F.get(row, j - 1) + 1, F.get(held["old"], j - 1) + (c != x["c"]).cast("int"), swap)))

        row = F.aggregate(letters, F.array(F.get(held["old"], F.lit(0)) + 1), cell)
        return F.struct(held["old"].alias("older"), row.alias("old"), c.alias("last"))

    chars = F.when(F.length(term) > 0, F.transform(F.sequence(F.lit(1), F.length(term)), lambda k: F.substring(term, k, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(chars, start, step, lambda held: F.get(held["old"], F.lit(m)))


def near(term: Column, word: str, edits: int) -> Column:
    """Within so many edits. A swap is two edits of the plain distance, whose cheap test goes first."""
    return F.when(F.levenshtein(term, F.lit(word), 2 * edits) >= 0, osa(term, word) <= edits).otherwise(F.lit(False))


def worth(word: str, distance: Column, length: Column) -> Column:
    """What a term so far from the word counts: less by its share of edits, never nothing."""
    long = F.greatest(length, F.lit(len(word)), F.lit(1))
    return F.greatest(1.0 - distance / long, 1.0 / (long + 1))


def expression(leaf: Leaf) -> str:
    text = analysis.wildcard(leaf.text.lower()) if leaf.kind == "wildcard" else leaf.text
    try:
        re.compile(text)
    except re.error as error:
        raise SearchError(f"cannot parse the expression /{leaf.text}/: {error}") from None
    return f"^(?:{text})$"


def passes(leaf: Leaf, term: Column) -> Column:
    """Whether a term is one of those that the clause names."""
    if leaf.kind == "range":
        low = F.lit(True) if leaf.low is None else term >= F.lit(leaf.low) if leaf.closed[0] else term > F.lit(leaf.low)
        high = F.lit(True) if leaf.high is None else term <= F.lit(leaf.high) if leaf.closed[1] else term < F.lit(leaf.high)
        return low & high
    if leaf.kind == "fuzzy":
        return near(term, leaf.text.lower(), leaf.slop)
    return term.rlike(expression(leaf))


def weight(leaf: Leaf, term: Column) -> Column:
    """How much an occurrence of a term that passes counts."""
    word = leaf.text.lower()
    return worth(word, osa(term, word), F.length(term)) if leaf.kind == "fuzzy" else F.lit(1.0)


class Terms(NamedTuple):
    """The terms that a clause was found to name, by what an occurrence counts."""

    by_weight: dict[float, tuple[str, ...]]

    @property
    def all(self) -> list[str]:
        return [t for some in self.by_weight.values() for t in some]


def tested(node: Leaf | Bool, fields: list[str]) -> list[tuple[Leaf, str]]:
    """The clauses of a query that name terms by a test, with each analysed field they ask."""
    if isinstance(node, Bool):
        return [x for _, part in node.parts for x in tested(part, fields)]
    names = [node.field] if node.field else fields
    return [(node, n) for n in names if schema.field(n).text] if node.kind in TESTED else []


def resolve(vocabulary: DataFrame, leaves: list[Leaf]) -> list[Terms | None]:
    """For each clause, the terms of ``vocabulary`` (distinct ``term``) that it names; None for all clauses where they are more
    than a query may have clauses. One pass; the driver receives no more than that."""
    tests = [passes(leaf, F.col("term")).alias(f"p{k}") for k, leaf in enumerate(leaves)]
    found = vocabulary.select("term", *tests).filter(reduce(lambda a, b: a | b, (F.col(f"p{k}") for k in range(len(leaves)))))
    weights = [F.when(F.col(f"p{k}"), weight(leaf, F.col("term"))).alias(f"w{k}") for k, leaf in enumerate(leaves)]
    rows = found.select("term", *weights).limit(schema.MAX_CLAUSES + 1).collect()
    if len(rows) > schema.MAX_CLAUSES:
        return [None] * len(leaves)
    out: list[Terms | None] = []
    for k in range(len(leaves)):
        by: dict[float, list[str]] = {}
        for r in sorted(rows):
            if r[k + 1] is not None:
                by.setdefault(r[k + 1], []).append(r.term)
        out.append(Terms({w: tuple(t) for w, t in by.items()}))
    return out
