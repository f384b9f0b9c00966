"""Quality rules: a decision list learned by sequential covering, emitted as one Spark conditional expression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import SPACES, per_slice, sums, word_codes

SAMPLE_ROWS, MAX_RULES, MAX_TESTS, MIN_PRECISION = 10_000, 12, 4, 0.75
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_marks", "n_lines"]
#: What conditions test: counts as they are, and these shares.
SHARES = {
    "symbols_a_word": ("n_symbols", "n_words"), "chars_a_word": ("word_chars", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "marks_a_word": ("n_marks", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
}
TESTED = ["n_words", *SHARES]


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the words inside 5-word windows that the text holds twice or more."""
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < 5:
        return np.zeros(len(offsets) - 1, np.int64)
    base = int(codes.max()) + 1
    pair = pd.factorize(codes[:-1].astype(np.int64) * base + codes[1:])[0].astype(np.int64)
    four = pd.factorize(pair[:-2] * (pair.max() + 1) + pair[2:])[0].astype(np.int64)
    five = pd.factorize(four[:-1] * base + codes[4:])[0].astype(np.int64)
    whole = text[: n - 4] == text[4:]
    key = pd.factorize(five * len(offsets) + text[: n - 4])[0]
    again = whole & (np.bincount(key, weights=whole)[key] > 1)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + 5, -1)
    return sums((np.cumsum(change)[:n] > 0).astype(np.int64), offsets)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns COUNTS of each text."""
    texts = pc.fill_null(texts, "")
    words, codes, offsets = word_codes(texts)
    codes = codes.astype(np.int64)
    chars = np.array([len(w) for w in words], dtype=np.int64)
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(text * max(1, len(words)) + codes) // max(1, len(words)), minlength=len(n)) if len(codes) else np.zeros(len(n))
    each = lambda pattern: np.array([sum(map(pattern.__contains__, w)) for w in words], dtype=np.int64)
    by_word = lambda values: sums(values[codes], offsets) if len(codes) else np.zeros(len(n), np.int64)
    symbols, marks, digits = (by_word(each(x)) for x in ("#*$%&|<>", "!?|;:=_", "0123456789"))
    upper = by_word(np.array([0 if w.islower() else sum(map(str.isupper, w)) for w in words], dtype=np.int64))
    listed = texts.to_pylist()
    dup, lines = np.array([duplicate_lines(x) for x in listed], np.int64), np.array([x.count("\n") + 1 for x in listed], np.int64)
    return [np.asarray(x).astype(np.int64) for x in (n, by_word(chars), symbols, dup, repeated_words(codes, offsets), distinct, upper, digits, marks, lines)]


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and COUNTS of each row; a null text has no words. One pass, no shuffle."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([*part.columns[1:], *map(pa.array, measure(part.column(0)))], [*keep, *COUNTS])

        return step

    kept = docs.select(F.col("text").cast("string").alias("text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]), *(f"{c} long" for c in COUNTS)])
    return per_slice(kept, make, schema)


class Test(NamedTuple):
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.name) if self.name in COUNTS else F.coalesce(F.try_divide(*SHARES[self.name]), F.lit(0.0))
        return value >= self.threshold if self.above else value < self.threshold

    def array(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] < self.threshold


def covers(rule: list[Test], table: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([t.array(table) for t in rule], axis=0) if rule else np.ones(len(table["n_words"]), bool)


def grow(table: dict[str, np.ndarray], junk: np.ndarray) -> list[Test]:
    """Add the threshold of the largest information gain until the rule covers junk alone."""
    rule, inside = [], np.ones(len(junk), bool)
    while len(rule) < MAX_TESTS and not junk[inside].all():
        p0, n0 = junk[inside].sum(), inside.sum()
        best = (1e-9, None)
        for name in TESTED:
            for cut in np.unique(np.quantile(table[name][inside], np.linspace(0.01, 0.99, 99))):
                for test in (Test(name, True, float(cut)), Test(name, False, float(cut))):
                    hit = test.array(table) & inside
                    p, n = junk[hit].sum(), hit.sum()
                    if p >= 5 and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > best[0]:
                        best = (gain, test)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].array(table)
    return rule


def prune(rule: list[Test], table: dict[str, np.ndarray], junk: np.ndarray) -> list[Test]:
    """Drop last tests while (p - n) / (p + n) over the pruning rows does not fall."""

    def worth(r: list[Test]) -> float:
        hit = covers(r, table)
        return (2 * junk[hit].sum() - hit.sum()) / max(1, hit.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def cover(table: dict[str, np.ndarray], junk: np.ndarray) -> list[list[Test]]:
    """Ordered rules for junk; two thirds of the rows grow a rule, the others prune it."""
    rules, left = [], np.ones(len(junk), bool)
    growing = np.arange(len(junk)) % 3 != 0
    part = lambda keep: ({k: v[keep] for k, v in table.items()}, junk[keep])
    while len(rules) < MAX_RULES and junk[left & growing].sum() >= 5:
        rule = grow(*part(left & growing))
        if not rule:
            break
        rule = prune(rule, *part(left & ~growing))
        hit = covers(rule, table) & left
        if not hit.sum() or junk[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Test]]:
    """Rules for ``labels.quality`` = 0, from at most ``rows`` labelled documents; no labels, no rules."""
    from docsieve.llm.toxicity import labelled

    sample = features(labelled(docs, labels, "quality", rows), "label").orderBy(F.xxhash64(*COUNTS), *COUNTS, "label").toPandas()
    if not len(sample):
        return []
    table = {"n_words": sample["n_words"].to_numpy(float)}
    for name, (a, b) in SHARES.items():
        table[name] = np.divide(sample[a].to_numpy(float), sample[b].to_numpy(float), out=np.zeros(len(sample)), where=sample[b].to_numpy() > 0)
    return cover(table, (sample["label"] == 0).to_numpy())


def verdict(rules: list[list[Test]]) -> tuple[Column, Column]:
    """The ordered conditional expression: kept, and the number of the rule that spoke (null: none did)."""
    kept, spoke = F.lit(True), F.lit(None).cast("int")
    for k, rule in reversed([*enumerate(rules)]):
        hit = rule[0].column()
        for test in rule[1:]:
            hit = hit & test.column()
        kept, spoke = F.when(hit, F.lit(False)).otherwise(kept), F.when(hit, F.lit(k)).otherwise(spoke)
    return kept, spoke


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule of each row.

    Null and empty texts have no words, fail the base rule and are not kept; null ids and repeated rows are judged like
    others; an empty table gives an empty result; other columns are ignored."""
    kept, spoke = verdict(learn(docs, labels))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = features(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return counted.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & kept).alias("kept"), spoke.alias("rule"))
