"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docsieve.llm.common import held_out, per_slice, settle

#: Letters that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏвкмнтαεορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtaeopviktuabezhikmnoptyx", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid mistake of mine", "pond scum")
#: Labelled documents that the lexicon is learned from, at most.
SAMPLE_ROWS = 20_000
#: An entry is in so many toxic documents and has so high a log odds at least; lexicon entries at most, the most frequent.
MIN_BAD, MIN_ODDS, MAX_WORDS = 3, 3.0, 20_000
#: Distinct entries that a task counts before it hands them on.
HELD_WORDS = 100_000
#: Lengths of the stems that the lexicon may hold besides whole words; a stem is marked by a final "~".
STEMS = range(4, 9)
EDGE = ".,;:!?\"'()[]{}|*#%&<>-_/\\"


def folding() -> dict[int, str]:
    wide = {chr(0xFF01 + k): chr(0x21 + k).lower() for k in range(94)}
    return str.maketrans(HOMOGLYPHS | wide | DIGITS | {c.upper(): v for c, v in HOMOGLYPHS.items() if len(c.upper()) == 1})


FOLD = folding()


def fold(text: str) -> str:
    """Lower case with look-alikes replaced, one character for one."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower()[0] for c in text)).translate(FOLD)


def entries(words: set[str]) -> set[str]:
    """The words and their stems."""
    return words | {w[:n] + "~" for w in words for n in STEMS if n < len(w)}


def choose(found: list) -> dict[str, float]:
    """Whole words, and stems that occur in clearly more toxic documents than any of their words; shortest stems first."""
    words = {r.word: r for r in found if not r.word.endswith("~")}
    best: dict[str, int] = {}
    for w, r in words.items():
        for n in STEMS:
            best[w[:n]] = max(best.get(w[:n], 0), r.bad)
    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r.word.endswith("~")), key=lambda r: (len(r.word), r.word)):
        stem = r.word[:-1]
        if r.bad > 1.2 * best.get(stem, 0) and not any(stem[:n] + "~" in stems for n in STEMS):
            stems[r.word] = float(r.odds)
    return stems | {w: float(r.odds) for w, r in words.items() if not any(w[:n] + "~" in stems for n in STEMS)}


class Model(NamedTuple):
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope: float


def matcher(model: Model):
    """A function from texts to (weighted matches normalised by length, number of matches)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, weight in model.weights.items():
        stem = word.removesuffix("~")
        found.add_word(stem, (len(stem), weight, stem == word))
    for phrase in model.exceptions:
        found.add_word(fold(phrase), (len(phrase), None, True))
    if len(found):
        found.make_automaton()

    def measure(text: str) -> tuple[float, int]:
        hits, spared = [], []
        for end, (n, weight, whole) in found.iter(fold(text)) if len(found) else ():
            start = end - n + 1
            if (start == 0 or not text[start - 1].isalnum()) and (not whole or end + 1 == len(text) or not text[end + 1].isalnum()):
                (hits if weight is not None else spared).append((start, end, weight))
        if spared:  # in the order of their ends: of those that end at b or later, the earliest start decides
            ends, starts = [y for _, y, _ in spared], [*accumulate((x for x, _, _ in reversed(spared)), min)][::-1]
            hits = [(a, b, w) for a, b, w in hits if (k := bisect_left(ends, b)) == len(ends) or starts[k] > a]
        return sum(w for _, _, w in hits) / np.log2(8 + text.count(" ") + text.count("\n")), len(hits)

    return measure


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents (text, label), chosen by a hash of the id and written once: the ids are
    small enough to be broadcast whatever the size of ``docs``, and later passes read the sample alone."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    return settle(docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").select("text", "label"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Words whose log odds of a toxic label are high, and a logistic curve from the length-normalised sum to the label.

    With no labels, or of one class only, nothing is a match and every score is the share of toxic labels (or 0)."""
    sample = labelled(docs, labels, "toxic", rows)

    def tally(batches):
        counts = {0: Counter(), 1: Counter()}

        def flush():
            words = [*counts[0].keys() | counts[1].keys()]
            return pa.record_batch([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "bad", "good"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts[int(label > 0)]
                own[""] += 1
                own.update(entries({fold(x.strip(EDGE)) for x in set(text.split())} - {""}))
                if len(own) > HELD_WORDS:
                    yield flush()
                    counts = {0: Counter(), 1: Counter()}
        yield flush()

    counts = settle(sample.mapInArrow(tally, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    total = counts.filter("word = ''").first()
    if total is None or not total.bad or not total.good:
        share = 0.0 if total is None else total.bad / max(1, total.bad + total.good)
        return Model({}, exceptions, float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0)
    odds = F.log((F.col("bad") + 0.5) / (total.bad + 1)) - F.log((F.col("good") + 0.5) / (total.good + 1))
    # Likelihood ratio against the share of toxic documents; twice the log of the number of entries tested as the bound.
    share, n = total.bad / (total.bad + total.good), F.col("bad") + F.col("good")
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0))
    likely = counts.filter((F.col("word") != "") & (F.col("bad") >= MIN_BAD)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    top = likely.filter(gain >= 2 * float(np.log(max(2, counts.count())))).orderBy(F.desc("bad"), "word").limit(MAX_WORDS)
    model = Model(choose(top.collect()), exceptions, 0.0, 1.0)

    def points(batches):
        measure = matcher(model)
        for batch in batches:
            yield pa.record_batch([pa.array([measure(x)[0] for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1).cast(pa.int32())], ["x", "y"])

    seen = np.array([(r.x, r.y) for r in sample.mapInArrow(points, "x double, y int").collect()])
    return model._replace(**logistic(seen[:, 0], (seen[:, 1] > 0).astype(float)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> dict[str, float]:
    """Bias and slope by Newton steps; sums alone, since BLAS threads have been seen to hang beside a running JVM."""
    bias = slope = 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        w = p * (1 - p)
        g, h = (y - p).sum() - ridge * bias, ((y - p) * x).sum() - ridge * slope
        a, b, c = w.sum() + ridge, (w * x).sum(), (w * x * x).sum() + ridge
        steps = np.array([c * g - b * h, a * h - b * g]) / (a * c - b * b)
        bias, slope = (np.array([bias, slope]) + np.clip(steps, -5, 5)).tolist()
        if np.abs(steps).max() < 1e-8:
            break
    return {"bias": bias, "slope": slope}


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry`` as they are, score (0 to 1) and n_matches of each row; a null text scores as an empty
    one. One pass, no shuffle."""

    def make():
        measure = matcher(model)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(x or "") for x in part.column(1).to_pylist()]
            z = np.clip(model.bias + model.slope * np.array([x for x, _ in found]), -30, 30)
            return pa.record_batch([part.column(0), *(part.column(k) for k in columns), pa.array(1 / (1 + np.exp(-z))), pa.array([n for _, n in found], pa.int64())], out.fieldNames())

        return step

    others = [x for x in carry if x not in ("doc_id", "text")]
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{x}`") for x in others))
    columns = [1 if x == "text" else 2 + others.index(x) for x in carry]
    out = StructType([kept.schema["doc_id"], *(kept.schema[k] for k in columns), StructField("score", DoubleType()), StructField("n_matches", LongType())])
    return per_slice(kept, make, out)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a lexicon learned from the training fold of ``labels``.

    Null and empty texts get the score of no match; null ids are scored and not held out; repeated rows are each scored;
    an empty table gives an empty result; other columns are ignored."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
