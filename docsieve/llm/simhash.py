"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a linear code: the direct sum of one even code on each 32-bit half of a fingerprint. The codes
lie between the Reed-Muller codes of order 1 and order 2, one more quadratic form each, so that the anchors grow with the
number of fingerprints. Let r(x) be
x's distance to its nearest anchor, home(x). For x and y that differ in at most d bits with r(x) <= r(y), home(x) lies
within r(x) + d <= r(y) + d of y. So each fingerprint goes to every anchor within its own covering radius plus d, and a pair
meets at one of its homes. All anchors have even weight, so the distances of y to anchors have one parity, and for d = 3
only those at r(y) and r(y) + 2 remain.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import per_slice, settle, word_codes
from docsieve.llm.components import components

SCHEMA = "doc_id long, fp long"
#: Fingerprints of an anchor's home that one block compares with what the anchor receives.
BLOCK_HOMES = 20_000
#: Anchors that a random fingerprint goes to, by quadratic forms in the code of each half (measured), and how many
#: comparisons moving one copy costs.
COPIES, COPY_COST = (28, 53, 99, 217, 593, 672, 824, 952, 2183, 1801, 2722), 1_000


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as a long) of each row; a text without words has fingerprint 0."""

    def make():
        from xxhash import xxh64_intdigest

        bits = np.arange(64, dtype=np.uint64)

        def one(words: list[str]) -> int:
            if not words:
                return 0
            ups, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
            for base in range(0, n, 1 << 16):
                some = words[base : min(n, base + (1 << 16)) + shingle - 1]
                texts = map(" ".join, zip(*(some[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
                h = np.fromiter((xxh64_intdigest(x, seed) for x in texts), np.uint64)
                ups += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.bitwise_or.reduce(np.where(2 * ups > n, np.uint64(1) << bits, np.uint64(0))))

        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            distinct, codes, offsets = word_codes(part.column(1))
            distinct = np.array([w.lower() if w.isascii() else w.translate(lower) for w in distinct], dtype=object)
            words = distinct[codes] if len(codes) else codes
            fp = np.array([one(words[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            return pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return step

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(kept, make, SCHEMA)


@lru_cache(maxsize=4)
def code_words(forms: int) -> np.ndarray:
    """The even code of length 32 spanned by the Reed-Muller code of order 1 and the first ``forms`` of the ten quadratic
    forms: 64 words times two for each form."""
    points = np.arange(32, dtype=np.uint64)
    bits = [points >> np.uint64(v) & np.uint64(1) == 1 for v in range(5)]
    rows = [np.ones(32, bool), *bits, *[bits[i] & bits[j] for i, j in combinations(range(5), 2)][:forms]]
    words = np.zeros(1, np.uint32)
    for row in rows:
        words = np.r_[words, words ^ np.uint32(sum(1 << int(p) for p in np.flatnonzero(row)))]
    return words


def forms_for(fingerprints: int) -> int:
    """Quadratic forms in the code of each half for which copies and comparisons together cost least."""
    return min(range(len(COPIES)), key=lambda forms: COPIES[forms] * (COPY_COST + fingerprints / 4**forms / 4096))


def anchors(fp: np.ndarray, distance: int, forms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (uint64): index of the fingerprint, anchor, and whether that is its home (the first nearest)."""
    code = code_words(forms)
    at, to, home = [], [], []
    for base in range(0, len(fp), max(1, (1 << 20) // len(code))):
        some = fp[base : base + max(1, (1 << 20) // len(code))]
        d = [np.bitwise_count(((some >> np.uint64(s)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ code).astype(np.int16) for s in (0, 32)]
        extra = [x - x.min(axis=1, keepdims=True) for x in d]
        close = [[np.argwhere(x == e) for e in range(distance + 1)] for x in extra]
        for e in range(distance + 1):
            for f in range(distance + 1 - e):
                a, b = close[0][e], close[1][f]
                if not len(a) or not len(b):
                    continue
                # Pair every low word with every high word of the same fingerprint.
                n_b = np.bincount(b[:, 0], minlength=len(some))
                start = np.r_[0, np.cumsum(n_b)][:-1]
                reps = n_b[a[:, 0]]
                left = np.repeat(np.arange(len(a)), reps)
                right = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start[a[:, 0]], reps)
                who = a[left, 0]
                at.append(base + who)
                to.append(a[left, 1].astype(np.int64) << 32 | b[right, 1])
                home.append(np.r_[True, who[1:] != who[:-1]] if e + f == 0 and len(who) else np.zeros(len(who), bool))
    empty = np.zeros(0, np.int64)
    return np.concatenate(at or [empty]), np.concatenate(to or [empty]), np.concatenate(home or [empty.astype(bool)])


def star(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare homes with all fingerprints of an anchor; (fingerprint, smallest of its group there), linked ones only."""
    label = np.arange(len(fp))
    linked = np.zeros(len(fp), bool)
    homes = np.flatnonzero(home)
    for base in range(0, len(homes), max(1, (1 << 21) // max(1, len(fp)))):
        some = homes[base : base + max(1, (1 << 21) // len(fp))]
        near = np.bitwise_count(fp[some][:, None] ^ fp) <= distance
        for k in np.flatnonzero(near.sum(axis=1) > 1):
            group = np.flatnonzero(near[k])
            linked[group] = True
            found = label[group]
            if (found != found[0]).any():
                label[np.isin(label, found)] = found.min()
    signed = fp.view(np.int64)
    order = np.lexsort([signed, label])
    order = order[linked[order]]
    heads = np.r_[True, np.diff(label[order]) != 0] if len(order) else np.zeros(0, bool)
    least = signed[order][np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))] if len(order) else signed[:0]
    return signed[order], least


def links(distinct: DataFrame, distance: int, forms: int, block: int = BLOCK_HOMES) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp) that leave their components as all links within ``distance`` do."""

    def deal(batches):
        for batch in batches:
            for base in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(base, 4096).to_numpy().astype(np.int64).view(np.uint64)
                at, to, home = anchors(fp, distance, forms)
                yield pa.record_batch([pa.array(to), pa.array(fp[at].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    dealt = distinct.select("fp").mapInArrow(deal, "anchor long, fp long, home boolean")
    # Anchors with many homes are cut into blocks of homes; what they receive is copied to each block.
    crowded = dealt.filter("home").groupBy("anchor").count().filter(F.col("count") > block).select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # One row for every ``block`` fingerprints at most.
    dealt = dealt.join(F.broadcast(crowded), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")) == F.col("block")
    dealt = dealt.select("anchor", "block", "fp", (F.col("home") & own).alias("home"))

    def compare(batches):
        held: list[tuple] = []

        def flush():
            fp, home = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            return star(fp, home, distance)

        def out(found):
            return pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        key = None
        for batch in batches:
            name = batch.column(0).to_numpy() * 1_000_003 + batch.column(1).to_numpy()
            fp, home = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.r_[0, np.flatnonzero(np.diff(name)) + 1, len(name)] if len(name) else np.zeros(1, int)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and key != name[i]:
                    found = flush()
                    if len(found[0]):
                        yield out(found)
                    held = []
                key = name[i]
                held.append((key, fp[i:j], home[i:j]))
        if held:
            yield out(flush())

    met = dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return met.mapInArrow(compare, "a long, b long").filter("a != b")


def near_groups(docs: DataFrame, distance: int = 3, shingle: int = 3, forms: int | None = None) -> DataFrame:
    """doc_id, fp and component_id of each row: rows are linked where fingerprints differ in ``distance`` bits at most.

    component_id is the smallest doc_id reachable. Null, empty and blank texts have fingerprint 0 and are linked like
    others; a null doc_id is linked but is never the smallest (null where a component has no other); repeated rows stay;
    an empty table gives an empty result; other columns are ignored.

    Equal fingerprints are one row before anything is compared. The result is the same with every code; ``forms`` is chosen
    by the number of distinct fingerprints (see ``forms_for``): more anchors mean more copies of each but fewer comparisons.
    """
    prints = settle(fingerprints(docs, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct, distance, forms_for(distinct.count()) if forms is None else forms))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    owner = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")
