"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import held_out, per_slice, settle, word_codes
from docsieve.llm.toxicity import labelled

#: Labelled documents that vectors and network are fitted on, at most; sizes of the vectors and of the hidden layer.
SAMPLE_ROWS, DIM, HIDDEN, EPOCHS = 10_000, 48, 24, 400
#: Entries each index vector has, half of them +1 and half -1; words, and forms, that get a learned vector, at most.
NONZERO, VOCABULARY, MIN_TEXTS = 6, 20_000, 5
#: Distinct words whose vectors a task keeps; beyond them it forgets all and starts anew.
KEPT_WORDS = 100_000
#: Runs of a word's form in one unit; longer forms give several units.
UNIT_RUNS = 12
#: What marks a form among the learned vectors; no word holds a space.
FORM = " "
SEED = 7


class Signs(dict):
    """What stands for a character in a form, found once for each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = sign = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return sign


SIGNS, RUN = Signs(), re.compile(r"(.)\1+", re.DOTALL)


def forms(word: str) -> list[str]:
    """A word's form: runs of capitals, small letters and digits become one sign; other characters stay. It comes in units
    of at most UNIT_RUNS runs that together cover the whole word, so a text without white space is one word of many units.
    Forms are units beside the words, with vectors of their own: a word that the vocabulary lacks still has a form."""
    runs = RUN.sub(r"\1", word.translate(SIGNS))
    return [runs] if len(runs) <= UNIT_RUNS else [runs[k : k + UNIT_RUNS] for k in range(0, len(runs), UNIT_RUNS)]


def index_vector(unit: str) -> np.ndarray:
    """The sparse ternary vector that stands for ``unit`` on every machine."""
    from xxhash import xxh64_intdigest

    raw, at, seed = unit.encode("utf-8", "surrogatepass"), [], SEED
    h = xxh64_intdigest(raw, seed)
    while len(at) < NONZERO:
        if h < DIM:
            seed += 1
            h = xxh64_intdigest(raw, seed)
        h, k = divmod(h, DIM)
        if k not in at:
            at.append(k)
    vector = np.zeros(DIM, np.float32)
    vector[at[: NONZERO // 2]], vector[at[NONZERO // 2 :]] = 1, -1
    return vector


class Model(NamedTuple):
    vectors: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float


class Pooler:
    """Pools vectors of a text: the mean over its words, the means over the forms of its words and of its distinct words,
    and how long and repetitive it is."""

    #: Columns of a word's row: its own vector, the sum of its forms' vectors, number of forms, code points.
    WIDTH = 2 * DIM + 2

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.vectors, self.units, self.words, self.rows, self.table = vectors, {}, {}, {}, np.zeros((1024, self.WIDTH), np.float32)

    def form(self, unit: str) -> np.ndarray:
        if (v := self.units.get(unit)) is None:
            if len(self.units) > KEPT_WORDS:
                self.units.clear()
            learned = self.vectors.get(FORM + unit)
            v = self.units[unit] = index_vector(FORM + unit) if learned is None else index_vector(FORM + unit) + learned
        return v

    def number(self, word: str) -> int:
        """Where the row of this word is in the table; words outside the vocabulary share one by form and length."""
        units = forms(word)
        own = self.vectors.get(word)
        key = word if own is not None else (len(word), *units)
        if (k := self.rows.get(key)) is None:
            if len(self.rows) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            k = self.rows[key] = len(self.rows)
            self.table[k, :DIM] = 0 if own is None else own
            self.table[k, DIM : 2 * DIM] = sum(map(self.form, units))
            self.table[k, 2 * DIM :] = len(units), len(word)
        return k

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
            self.rows.clear()
        for w in words:
            if w not in self.words:
                self.words[w] = self.number(w)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def pool(self, texts: pa.Array) -> np.ndarray:
        words, codes, offsets = word_codes(texts)
        n = np.diff(offsets)
        sums, once = np.zeros((len(n), self.WIDTH)), np.zeros((len(n), self.WIDTH))
        if not len(codes):
            return np.zeros((len(n), 3 * DIM + 3))
        at = self.numbers(words)
        pairs, counts = np.unique(np.repeat(np.arange(len(n)), n) * len(words) + codes.astype(np.int64), return_counts=True)
        text, row = pairs // len(words), at[pairs % len(words)]
        for base in range(0, len(pairs), 1 << 15):  # a text cut by a block is summed over both parts
            some = slice(base, base + (1 << 15))
            held, heads = self.table[row[some]], np.flatnonzero(np.r_[True, np.diff(text[some]) > 0])
            mine = text[some][heads]
            once[mine] += np.add.reduceat(held, heads, axis=0)
            sums[mine] += np.add.reduceat(held * counts[some, None], heads, axis=0)
        distinct = np.bincount(text, minlength=len(n))
        total, units, each = np.maximum(1, n)[:, None], np.maximum(1, sums[:, 2 * DIM : 2 * DIM + 1]), np.maximum(1, once[:, 2 * DIM : 2 * DIM + 1])
        shape = np.c_[np.log1p(n), distinct / total[:, 0], sums[:, -1] / total[:, 0]]
        # Rounded, so that how texts are cut into slices does not show in a score.
        return np.round(np.c_[sums[:, :DIM] / total, sums[:, DIM : 2 * DIM] / units, once[:, DIM : 2 * DIM] / each, shape], 6)


def vocabulary(sample: DataFrame) -> list[str]:
    """The VOCABULARY words that are in most texts of the sample, of those in MIN_TEXTS or more."""

    def tally(batches):
        held = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(set(text.split()))
        yield pa.record_batch([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["word", "n"])

    counts = sample.select("text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.filter(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]


def contexts(sample: DataFrame) -> dict[str, np.ndarray]:
    """Random indexing: the vector of a word of the vocabulary, and of a form (marked by FORM), is the mean index vector of
    its neighbours in the sample; a neighbour outside the vocabulary counts as its form. Sums are of whole numbers, so
    their order does not matter."""
    words = sample.sparkSession.sparkContext.broadcast(frozenset(vocabulary(sample)))

    def gather(batches):
        known, held = words.value, {}
        cached = lru_cache(maxsize=KEPT_WORDS)(index_vector)

        def flush():
            return pa.record_batch([pa.array([*held], pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["unit", "v"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                plain = [[FORM + u for u in forms(w)] for w in text.split()]
                for units in ([u for w, own in zip(text.split(), plain, strict=True) for u in ([w] if w in known else own)], [u for own in plain for u in own]):
                    if len(units) < 2:
                        continue
                    names = sorted(set(units))
                    code = {u: k for k, u in enumerate(names)}
                    vectors = np.stack([cached(u) for u in names])
                    at = np.array([code[u] for u in units], dtype=np.int64)
                    near = np.zeros((len(names), DIM + 1))
                    for a, b in ((at[:-1], at[1:]), (at[1:], at[:-1])):
                        order = np.argsort(a, kind="stable")
                        heads = np.flatnonzero(np.r_[True, np.diff(a[order]) > 0])
                        near[a[order][heads], :DIM] += np.add.reduceat(vectors[b[order]], heads, axis=0)
                        near[:, DIM] += np.bincount(a, minlength=len(names))
                    for u, v in zip(names, near, strict=True):
                        held[u] = held[u] + v if u in held else v
            if len(held) > KEPT_WORDS:
                yield flush()
                held.clear()
        yield flush()

    found = sample.select("text").mapInArrow(gather, "unit string, v array<double>")
    total = settle(found.groupBy("unit").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(DIM + 1))).alias("v")))
    rows = [r for form in (False, True) for r in total.filter(F.startswith("unit", F.lit(FORM)) == form).orderBy(F.desc(F.col("v")[DIM]), "unit").limit(VOCABULARY).collect()]
    return {r.unit: (np.array(r.v[:DIM]) / max(1.0, r.v[DIM])).astype(np.float32) for r in rows}


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, (hidden @ layers[2] + layers[3])[:, 0]


def train(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Weights by Adam on four fifths of the rows; the temperature minimises log loss on the others."""
    rng = np.random.default_rng(SEED)
    fit = rng.permutation(len(x)) % 5 > 0 if len(x) >= 50 else np.ones(len(x), bool)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    a, b = x[fit], y[fit]
    for t in range(1, EPOCHS + 1):
        hidden, z = forward(layers, a)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - b) / len(b))[:, None]
        back = d @ layers[2].T * (1 - hidden**2)
        for k, g in enumerate((a.T @ back, back.sum(0), hidden.T @ d, d.sum(0))):
            g = g + 1e-4 * layers[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            layers[k] -= 0.02 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    check = ~fit if (~fit).any() else fit
    z, truth = forward(layers, x[check])[1], y[check]
    loss = lambda t: np.logaddexp(0, np.where(truth > 0, -z, z) / t).mean()
    return layers, float(min(np.geomspace(0.5, 20, 60), key=loss))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """None where there are no training labels.

    The network is fitted in one task, on at most ``rows`` pooled rows: workers run numpy with one thread, whose library
    threads have been seen to hang in the driver."""
    sample = labelled(docs, labels, "quality", rows)
    vectors = contexts(sample)
    held = docs.sparkSession.sparkContext.broadcast(vectors)  # 2 * VOCABULARY vectors at most

    def points(batches):
        pooler = Pooler(held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.record_batch([pa.array(pooler.pool(part.column(0)).tolist(), pa.list_(pa.float64())), part.column(1).cast(pa.int32())], ["x", "y"])

    def fit(batches):
        x, y = [], []
        for batch in batches:
            x += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if not x:
            return
        x, y = np.array(x), (np.array(y) > 0).astype(float)
        order = np.lexsort([*x.T[:3], y])  # the rows' order must not depend on the cluster
        x, y = x[order], y[order]
        mean, scale = x.mean(0), x.std(0) + 1e-3
        yield pa.record_batch([pa.array([pickle.dumps((mean, scale, *train((x - mean) / scale, y)))], pa.binary())], ["fitted"])

    # Pooled in many tasks and written; only these few numbers a row go to the task that fits.
    fitted = settle(sample.mapInArrow(points, "x array<double>, y int")).coalesce(1).mapInArrow(fit, "fitted binary").first()
    return None if fitted is None else Model(vectors, *pickle.loads(bytes(fitted.fitted)))  # made by ``fit`` above


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (probability of quality 1; 0.5 without a model). One pass, no shuffle."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * VOCABULARY vectors at most

    def make():
        model = held.value
        pooler = Pooler(model.vectors)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            x = (pooler.pool(part.column(1)) - model.mean) / model.scale
            z = np.clip(forward(model.layers, x)[1] / model.temperature, -30, 30)
            return pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

        return step

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(kept, make, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a network fitted on the training fold of ``labels.quality``.

    Null and empty texts are scored as texts without words; null ids and repeated rows are scored each; an empty table
    gives an empty result; other columns are ignored."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
