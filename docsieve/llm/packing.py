"""Packing token sequences: cutting-stock column generation over the length histogram."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docsieve.llm.common import per_slice, settle, word_codes

CAPACITY, END_ID = 4096, 2
#: Pieces are packed as if they were as long as their class. Lengths up to twice this are classes of their own; longer ones are
#: rounded up by less than one part in this many, in steps of powers of two, so that classes are few.
FINE = 128
#: The search for columns ends when the program is within this factor of a lower bound of its optimum, or within one sequence,
#: and not before.
GAP = 1.0001
#: A column worth at most this does not enter; the basis is inverted anew after so many pivots.
WORTH, REFRESH = 1 + 1e-7, 2_000
#: Words whose ids a worker process keeps; beyond them it forgets all and starts anew.
CACHE_WORDS = 500_000


@lru_cache(maxsize=2)
def loaded(vocabulary: str):
    """The tokenizer and the ids (as bytes) of words seen so far, kept by a worker process from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary), {}


def encoder(vocabulary: str, end_id: int = END_ID):
    """A function from an Arrow array of texts to (ids of all texts in a row, offsets by text), ``end_id`` after each text.

    The vocabulary drops white space, so words are encoded by themselves, each distinct word once a batch."""
    tokenizer, known = loaded(vocabulary)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > CACHE_WORDS:
            known.clear()
        # The vocabulary lower-cases and parts letters from signs; doing both first leaves fewer distinct words. Texts with
        # special-token marks stay as they are, since those are matched before lower-casing; İ leaves a mark, not a letter.
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(texts, r"([^\PLİ])([.,])([ \n])", r"\1 \2\3")
        words, codes, offsets = word_codes(texts, " \n")
        fresh = [w for w in words if w not in known]
        for k in range(0, len(fresh), 20_000):
            found = [e.ids for e in tokenizer.encode_batch_fast(fresh[k : k + 20_000], add_special_tokens=False)]
            raw, last = np.fromiter(chain.from_iterable(found), np.uint32).tobytes(), 0
            for w, ids in zip(fresh[k : k + 20_000], found, strict=True):
                known[w], last = raw[last : last + 4 * len(ids)], last + 4 * len(ids)
        parts = [*map(known.__getitem__, words), np.uint32(end_id).tobytes()]
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        # One more code, for the end id, after the words of each text.
        codes = np.insert(codes.astype(np.int64), offsets[1:], len(words))
        offsets = offsets + np.arange(len(offsets))
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)]
        return ids, np.r_[0, ends][offsets]

    return encode


def length_class(size: int) -> int:
    """The length that a piece of ``size`` tokens is packed as."""
    step = 1 << max(0, (size // FINE).bit_length() - 1)
    return -(-size // step) * step


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, keep_ids: bool) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, with their class and their rank in it within the task."""

    def make():
        encode, part_id, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = encode(part.column(1))
            rows = []
            for doc, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for s in range(a, b, capacity):
                    data = ids[s : min(b, s + capacity)].tobytes()
                    size = len(data) // 4
                    c = min(capacity, length_class(size))
                    rows.append((doc, s - a, size, zlib.crc32(data), b - a, c, part_id, int(seen[c]), *([data] if keep_ids else [])))
                    seen[c] += 1
            columns = [*zip(*rows, strict=True)] if rows else [[] for _ in range(8 + keep_ids)]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
            names = [*(x.split()[0] for x in PIECES.split(", ")), *(["ids"] * keep_ids)]
            return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        return step

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(kept, make, PIECES + ", ids binary" * keep_ids)


class Pattern(NamedTuple):
    """How many pieces of each class (index into the sizes) a sequence holds, and how many sequences do."""

    counts: np.ndarray
    times: int


def knapsack(sizes: np.ndarray, worth: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``units``: the worth of the most valuable multiset of the ascending ``sizes`` within it, and
    the index of a size in that multiset (-1: the room below does as well)."""
    best, last = np.zeros(units + 1), np.full(units + 1, -1)
    fits = np.searchsorted(sizes, np.arange(units + 1), side="right")
    for c in range(1, units + 1):
        best[c] = best[c - 1]
        if fits[c]:
            values = best[c - sizes[: fits[c]]] + worth[: fits[c]]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], last[c] = values[k], k
    return best, last


def multiset(sizes: np.ndarray, last: np.ndarray, c: int) -> np.ndarray:
    """Counts of the multiset that ``knapsack`` found for room ``c``."""
    counts = np.zeros(len(sizes), np.int64)
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return counts


def first_columns(sizes: np.ndarray, demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing in fractions: a column (a row here) and its multiplier for each class, the one it uses up.

    No later column holds a class that is used up, so the columns are a basis."""
    m, left = len(sizes), demand.astype(float)
    columns, x, still = np.zeros((m, m)), np.zeros(m), np.ones(m, bool)
    for _ in range(m):
        room, counts = units, np.zeros(m)
        for k in np.flatnonzero(still)[::-1].tolist():
            counts[k], room = divmod(room, int(sizes[k]))
        ratio = np.where(counts > 0, left / np.maximum(counts, 1), np.inf)
        k = int(ratio.argmin())
        columns[k], x[k], still[k] = counts, ratio[k], False
        left = np.maximum(left - ratio[k] * counts, 0)
    return columns, x


def product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The product without BLAS, whose threads have been seen to wait for ever in a process that has started Spark."""
    return np.einsum("ij,j->i", matrix, vector)


def bring_in(inverse: np.ndarray, direction: np.ndarray, leaves: int) -> None:
    """The basis takes a column whose coordinates in it are ``direction`` in place of its column ``leaves``."""
    inverse[leaves] /= direction[leaves]
    others = np.flatnonzero((direction != 0) & (np.arange(len(direction)) != leaves))
    inverse[others] -= np.outer(direction[others], inverse[leaves])


def inverted(columns: np.ndarray) -> np.ndarray:
    """The inverse of the basis, column by column in place of unit vectors, each at the largest coordinate still free.
    Its rows are in the order of the columns."""
    m = len(columns)
    inverse, at, free = np.eye(m), np.zeros(m, np.int64), np.ones(m, bool)
    for k in range(m):
        direction = product(inverse, columns[k])
        at[k] = int(np.where(free, np.abs(direction), -1).argmax())
        free[at[k]] = False
        bring_in(inverse, direction, int(at[k]))
    return inverse[at]


def program(sizes: np.ndarray, demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns (rows here) and multipliers that meet ``demand`` within GAP, or one sequence, of the fewest sequences in fractions,
    and the lower bound that shows it: the area, or what a turn's dual values prove.

    Revised simplex from first-fit decreasing. One knapsack a turn prices a best column with each class in it; they enter,
    best first, as long as they are worth it under the dual values of the moment. Slightly uneven demands avoid ties."""
    demand = demand * (1 + 1e-7 * np.random.default_rng(0).random(len(sizes)))
    columns, x = first_columns(sizes, demand, units)
    inverse, pivots, bound = None, 0, float(sizes @ demand) / units
    while x.sum() > max(GAP * bound, bound + 1):
        inverse = inverted(columns) if inverse is None else inverse
        dual = inverse.sum(axis=0)
        best, last = knapsack(sizes, dual, units)
        bound = max(bound, dual @ demand / best[units])
        if best[units] <= WORTH:
            break
        value = dual + best[units - sizes]
        found = np.unique([multiset(sizes, last, units - int(sizes[k])) + (np.arange(len(sizes)) == k) for k in np.flatnonzero(value > WORTH)], axis=0).astype(float)
        for _ in range(len(found)):
            value = product(found, inverse.sum(axis=0))
            enters = int(value.argmax())
            if value[enters] <= WORTH:
                break
            direction = product(inverse, found[enters])
            ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
            leaves = int(ratio.argmin())
            if not np.isfinite(ratio[leaves]):
                raise ArithmeticError("the basis has become singular")
            x = np.maximum(x - ratio[leaves] * direction, 0)
            x[leaves] = ratio[leaves]
            bring_in(inverse, direction, leaves)
            columns[leaves] = found[enters]
            pivots += 1
            if pivots % REFRESH == 0:
                inverse = inverted(columns)
                x = np.maximum(product(inverse, demand), 0)
    return columns.astype(np.int64), x, bound


def patterns(sizes: np.ndarray, demand: np.ndarray, units: int) -> list[Pattern]:
    """Few sequences for ``demand`` pieces of each of the ascending ``sizes``.

    The multipliers of the linear program are rounded down, and what is left, under one sequence a column, is packed
    first-fit decreasing."""
    m = len(sizes)
    if not m:
        return []
    columns, x, _ = program(sizes, demand, units)
    left, made = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        used = columns[k] > 0
        times = int(min(np.floor(x[k] + 1e-6), (left[used] // columns[k][used]).min()))
        if times > 0:
            made.append(Pattern(columns[k], times))
            left -= times * columns[k]
    while left.any():
        counts, room = np.zeros(m, np.int64), units
        for k in range(m - 1, -1, -1):
            counts[k] = min(left[k], room // sizes[k])
            room -= counts[k] * sizes[k]
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        made.append(Pattern(counts, times))
        left -= times * counts
    return made


def place(cut: DataFrame, plan: list[Pattern], classes: np.ndarray) -> DataFrame:
    """Give the piece of global rank r in its class its sequence: each class's ranks are dealt to the patterns in order."""
    first = np.cumsum([0, *(p.times for p in plan)])
    by_class: dict[int, list[tuple[int, int, int, int]]] = {}
    for p, (counts, times) in enumerate(plan):
        slot = 0
        for k in np.flatnonzero(counts):
            by_class.setdefault(int(classes[k]), []).append((int(counts[k]), times, int(first[p]), slot))
            slot += int(counts[k])
    tables = {}
    for c, rows in by_class.items():
        a = np.array(rows, dtype=np.int64)
        tables[c] = (np.r_[0, np.cumsum(a[:, 0] * a[:, 1])], a)

    def assign(batches):
        for batch in batches:
            c, r = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("class", "rank"))
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                at = c == k
                starts, rows = tables[int(k)]
                i = np.searchsorted(starts, r[at], side="right") - 1
                rest = r[at] - starts[i]
                sequence[at], slot[at] = rows[i, 2] + rest // rows[i, 0], rows[i, 3] + rest % rows[i, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "slot"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields), "sequence_id long", "slot long"])
    return cut.mapInArrow(assign, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) and where they lie: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset (gapless from 0), with the ids as little-endian unsigned 32-bit where ``keep_ids``.

    Documents longer than a sequence give whole sequences and one rest. A null or empty text is its end id alone; null ids
    and repeated rows are packed like others; an empty table gives an empty result; other columns are ignored.

    The driver holds the histogram (a row for each length class) and the patterns, whose number is bounded by that of the
    classes and not by the documents. Ranks come from counts by task and class; no class is brought together.
    """
    cut = settle(pieces(docs, vocabulary, capacity, keep_ids))
    counts = cut.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = sorted((r["class"], r.n) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())
    classes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    plan = patterns(classes, demand, capacity)
    ranked = cut.join(starts, ["part", "class"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    within = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    placed = place(ranked, plan, classes).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return placed.drop("part", "class", "rank", "slot")
