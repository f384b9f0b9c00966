"""Repeated-substring removal by bucket-pointer refinement over the corpus's suspected repeats.

A suffix array of all bytes is never built. Each window of ``length`` bytes is represented by the smallest hash among its
q-grams (its anchor), so equal windows have equal anchors: about one position in thirty-five. A twice-seen filter over
anchor hashes leaves the suspected ones; each goes with the bytes that its windows cover to its bucket. A context whose
bytes were seen earlier by the same task, or by the same bucket, is a repeat as a whole and goes no further, so copies
are combined before the shuffle. Anchors that are frequent (an ordinary line, a repeated phrase) have their windows cut
into blocks of offsets, each dealt by the longer gram that all windows of the block share.

The contexts of a batch of buckets are then put in suffix order up to ``length`` bytes by bucket-pointer refinement:
suffixes are bucketed by their first GRAM bytes, a suffix's pointer is where its bucket starts, buckets are sorted on the
pointers of the suffixes GRAM bytes later, the parts get pointers of their own at once, and are refined in turn at later
offsets. Buckets that hold no two windows are left alone. Equal windows are neighbours in that order; all but the earliest
are repeats.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import per_slice, settle
from docsieve.llm.filters import FILTER_BITS, MAX_FILL, crowded, frequent_bits, twice_filter
from docsieve.llm.lines import has_bits, positions

GRAM = 32
#: Contexts refined at once; a bucket with more distinct ones is refined window offset by window offset.
BATCH_ROWS = 4_000
#: Suffixes of whole buckets that are refined to the end before the next ones, which then meet finer pointers.
BLOCK = 1 << 16
#: An anchor hash found so often in the corpus is frequent; its windows are dealt in blocks of so many offsets.
FREQUENT, OFFSETS = 250, 8
#: Contexts whose earliest place a task remembers; beyond them it forgets all and starts anew.
SEEN = 40_000
#: Bytes of text whose anchors are found at once: some ten arrays of eight bytes a position.
ANCHOR_BYTES = 1 << 20


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def spread(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """``pick`` (minimum or maximum) over [i, i + width) for each i; what lies beyond the end is ``fill``."""
    have, out = 1, x.copy()
    while have < width:
        step = min(have, width - have)
        later = np.full_like(out, fill)
        later[: len(out) - step] = out[step:]
        out = pick(out, later)
        have += step
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    by, factor = 1, 0xBF58476D1CE4E5B9
    while by < GRAM:
        h = h * np.uint64(factor) + shifted(h, by)
        h ^= h >> np.uint64(29)
        by, factor = 2 * by, factor * 0x94D049BB133111EB % 2**64 | 1
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are the anchor of a window inside one text, their hashes, and the anchor hash of the window that
    starts at each byte (0 where none does). ``ends``: where each text stops."""
    width, top = length - GRAM + 1, np.uint64(2**64 - 1)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(data), np.uint64)
    limit = np.repeat(ends, np.diff(np.r_[0, ends]))
    place = np.arange(len(data))
    h = np.clip(gram_hashes(data), np.uint64(1), top - np.uint64(1))
    least = spread(h, width, np.minimum, top)
    least[place + length > limit] = 0  # no window starts here
    most = spread(least[::-1], width, np.maximum, np.uint64(0))[::-1]  # over the windows that hold this q-gram
    at = np.flatnonzero((most == h) & (place + GRAM <= limit))
    return at, h[at], least


def windows(at: np.ndarray, h: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows whose anchor is at ``at``: a lesser hash on a side cuts off the starts beyond,
    so they are without gaps."""
    start = at[:, None] - np.arange(width - 1, -1, -1)
    mine = (least[np.maximum(start, 0)] == h[:, None]) & (start >= 0)
    return at - (width - 1) + mine.argmax(axis=1), at - mine[:, ::-1].argmax(axis=1)


def contents(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [(x or "").encode("utf-8") for x in part.column(column).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts], dtype=np.int64)


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with those that touch or overlap in one document made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    base = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) if len(doc) else doc
    reach = np.maximum.accumulate(last + base * (1 << 40)) - base * (1 << 40) if len(doc) else last
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    return doc[heads], first[heads], reach[np.r_[heads[1:] - 1, len(doc) - 1]] if len(doc) else last


CONTEXTS = "h long, doc_id long, pos long, lead int, bytes binary, last long"


def batch_of(rows: list[tuple], runs: list[tuple]) -> pa.RecordBatch:
    """Contexts (h, doc_id, pos, lead, bytes), and the runs that are known to be repeats, as (doc_id, first, last)."""
    doc, first, last = merged(*(np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ((), (), ()))))
    h, docs, pos, lead, data = zip(*rows, strict=True) if rows else ((),) * 5
    spread = (doc * 0x9E3779B1 + first).astype(np.int64)  # runs need no bucket; they are dealt evenly
    return pa.record_batch(
        [
            pa.array(np.r_[np.array(h, np.int64), spread]), pa.array(np.r_[np.array(docs, np.int64), doc]), pa.array(np.r_[np.array(pos, np.int64), first]),
            pa.array(np.r_[np.array(lead, np.int32), np.zeros(len(doc), np.int32)]), pa.array([*data, *[None] * len(doc)], pa.binary()), pa.array([*[None] * len(rows), *last.tolist()], pa.int64()),
        ],
        [x.split()[0] for x in CONTEXTS.split(", ")],
    )


def blocks(h: int, at: int, lo: int, hi: int, raw: bytes, length: int) -> list[tuple[int, int, int]]:
    """(bucket, first start, last start) of each block of offsets in which the anchor at ``at`` has windows."""
    out = []
    for b in range((at - hi) // OFFSETS, (at - lo) // OFFSETS + 1):
        top, low = min(hi, at - OFFSETS * b), max(lo, at - OFFSETS * (b + 1) + 1)
        shared = raw[at - OFFSETS * b : at - OFFSETS * (b + 1) + 1 + length]  # what every window of the block holds
        out.append((int.from_bytes(blake2b(shared, digest_size=8, key=b.to_bytes(2, "little")).digest(), "little", signed=True), low, top))
    return out


def counted(named: DataFrame, length: int, frequent: int) -> DataFrame:
    """Texts with an anchor hash that is in the corpus twice or more, beside all such hashes of theirs (``again``) and those
    that are frequent (``many``): nine bytes an anchor, which is one position in thirty-five."""

    def make():
        def step(part):
            data, ends = contents(part, 1)
            at, h, _ = anchors(data, ends, length)
            if not len(at):
                return None
            ids = part.column(0).to_numpy()[np.searchsorted(ends, at, side="right")]
            code, n = np.unique(h, return_inverse=True, return_counts=True)[1:]
            order = np.lexsort((code, ids))
            some = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(code[order]) != 0)]]
            return pa.record_batch([pa.array(ids[some]), pa.array(h[some].view(np.int64)), pa.array(n[code[some]])], ["doc_id", "h", "n"])

        return step

    held = settle(per_slice(named, make, "doc_id long, h long, n long", size=ANCHOR_BYTES))
    again = settle(held.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h", (F.col("n") >= frequent).alias("often")))
    lists = held.select("doc_id", "h").join(again, "h").groupBy("doc_id").agg(F.collect_list("h").alias("again"), F.collect_list(F.when(F.col("often"), F.col("h"))).alias("many"))
    return named.join(lists, "doc_id").select("doc_id", "text", "again", "many")


def contexts(named: DataFrame, length: int, bits: int, frequent: int, max_fill: float) -> DataFrame:
    """CONTEXTS: each suspected anchor with the bytes of its windows, ``lead`` of them before it; and known repeats.

    A corpus that crowds the filter has its anchors counted exactly: then hashes are shuffled and, once, the texts, where a
    full filter would send the bytes of every window."""
    width = length - GRAM + 1

    def hashes():
        def step(part):
            data, ends = contents(part, 1)
            h, n = np.unique(anchors(data, ends, length)[1].view(np.int64), return_counts=True)
            return pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])

        return step

    filters = twice_filter(per_slice(named, hashes, "h long, n long", size=ANCHOR_BYTES), bits, frequent)
    exact = crowded(filters[0], max_fill)
    held = None if exact else named.sparkSession.sparkContext.broadcast(filters)

    def cut():
        twice, many = (None, None) if exact else held.value
        seen: dict[bytes, tuple[int, int]] = {}

        def step(part):
            data, ends = contents(part, 1)
            at, h, least = anchors(data, ends, length)
            if exact:  # whether a hash is suspected does not depend on the text
                keep, crowd = (np.isin(h.view(np.int64), part.column(k).flatten().to_numpy()) for k in (2, 3))
            else:
                a, b = positions(h.view(np.int64), bits)
                keep, crowd = has_bits(twice, a) & has_bits(twice, b), frequent_bits(many, a, b)
            crowd = crowd[keep]
            at, h = at[keep], h[keep]
            doc = np.searchsorted(ends, at, side="right")
            first = np.r_[0, ends][doc]
            lo, hi = windows(at, h, least, width)
            raw, ids = data.tobytes(), part.column(0).to_numpy()
            if len(seen) > SEEN:
                seen.clear()
            rows, runs = [], []
            for x, y, i, j, n, start, often in zip(h.view(np.int64).tolist(), at.tolist(), lo.tolist(), hi.tolist(), ids[doc].tolist(), first.tolist(), crowd.tolist(), strict=True):
                piece = raw[i : j + length]
                name, place = x.to_bytes(8, "little", signed=True) + bytes([y - i]) + piece, (n, y - start)
                if (old := seen.get(name)) is not None and old < place:
                    runs.append((n, i - start, j - start))
                    continue
                seen[name] = place
                if often:
                    rows += [(z, n, y - start, y - low, raw[low : top + length]) for z, low, top in blocks(x, y, i, j, raw, length)]
                else:
                    rows.append((x, n, y - start, y - i, piece))
            return batch_of(rows, runs)

        return step

    return per_slice(counted(named, length, frequent) if exact else named, cut, CONTEXTS, size=ANCHOR_BYTES)


def initial_pointers(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first GRAM bytes (a power of two, eight at least), and where in it the bucket of
    each suffix starts; ``text`` ends in GRAM bytes or more of padding, whose suffixes come first."""
    n = len(text)
    gram = np.zeros(n, np.uint64)
    gram[: n - 7] = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel()
    depth, key = 8, gram
    while True:
        order = np.argsort(key, kind="stable")
        heads = np.r_[True, key[order[1:]] != key[order[:-1]]]
        pointer = np.zeros(n, np.int64)
        pointer[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        if depth >= GRAM:
            return order, pointer
        key = pointer * n + np.r_[pointer[depth:], np.zeros(depth, np.int64)]
        depth *= 2


def refine(order: np.ndarray, pointer: np.ndarray, wanted: np.ndarray, at: np.ndarray, length: int) -> None:
    """Refine whole buckets, at indices ``at`` of ``order``, until suffixes of one bucket agree in ``length`` bytes."""
    offset = GRAM
    while offset < length and len(at):
        some = order[at]
        own, later = pointer[some], pointer[some + offset]
        by = np.lexsort((later, own))
        some, own, later = some[by], own[by], later[by]
        order[at] = some
        heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (later[1:] != later[:-1])])
        size = np.diff(np.r_[heads, len(at)])
        pointer[some] = np.repeat(at[heads], size)
        at = at[np.repeat(np.add.reduceat(wanted[some], heads) > 1, size)]
        offset += GRAM


def window_ids(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the ``length``-byte windows of ``text`` (padded by ``length`` bytes) at ``starts``, equal for equal ones."""
    order, pointer = initial_pointers(text)
    wanted = np.zeros(len(text), np.int64)
    wanted[starts] = 1
    heads = np.flatnonzero(np.r_[True, np.diff(pointer[order]) != 0])
    size = np.diff(np.r_[heads, len(order)])
    full = np.add.reduceat(wanted[order], heads) > 1
    ends = np.cumsum(np.where(full, size, 0))
    for low in range(0, int(ends[-1]), BLOCK):  # the buckets that end in this stretch
        mine = full & (ends > low) & (ends <= low + BLOCK)
        m = size[mine]
        refine(order, pointer, wanted, np.repeat(heads[mine], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m), length)
    ordered = order[wanted[order] > 0]
    # Pointers may be finer than ``length`` bytes; neighbours in one bucket are equal, others are compared byte by byte.
    new = np.r_[True, pointer[ordered[1:]] != pointer[ordered[:-1]]]
    check = np.flatnonzero(new[1:]) + 1
    for base in range(0, len(check), 1 << 15):
        some = check[base : base + (1 << 15)]
        view = np.lib.stride_tricks.sliding_window_view(text, length)
        new[some] = (view[ordered[some]] != view[ordered[some - 1]]).any(axis=1)
    ids = np.zeros(len(text), np.int64)
    ids[ordered] = np.cumsum(new) - 1
    return ids[starts]


def repeats(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, lead: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, first, last) of window starts that are repeats, among whole buckets ordered by (h, doc, pos)."""
    same = pd.factorize(pd.Series([x.to_bytes(8, "little", signed=True) + bytes([n]) + d for x, n, d in zip(h.tolist(), lead.tolist(), data, strict=True)], dtype=object))[0]
    first = np.r_[True, same[1:] > np.maximum.accumulate(same)[:-1]] if len(same) else np.zeros(0, bool)
    size = np.array([len(x) for x in data], dtype=np.int64)
    start = pos - lead
    # The bytes of an earlier context again: each of its windows is a repeat. Of one document's rows, only later places are.
    copies = np.flatnonzero(~first & (size >= length))
    if len(copies):
        source = np.flatnonzero(first)[same[copies]]
        copies = copies[(doc[copies] != doc[source]) | (pos[copies] != pos[source])]
    out = [(doc[copies], start[copies], start[copies] + size[copies] - length)]
    own = np.flatnonzero(first)
    group, n = np.unique(h[own], return_inverse=True, return_counts=True)[1:]
    own = own[n[group] > 1]
    if len(own) <= 2 * BATCH_ROWS:
        parts = [(own, np.zeros(len(own), np.int64), size[own])] if len(own) else []
    else:  # one offset of windows at a time: equal windows have their anchor at one offset
        parts = []
        for k in range(length - GRAM + 1):
            skip = lead[own].astype(np.int64) - k
            some = (skip >= 0) & (skip + length <= size[own])
            parts.append((own[some], skip[some], np.full(some.sum(), length)))
    for rows, skip, held in parts:
        if not len(rows):
            continue
        text = np.frombuffer(b"".join(data[k][a : a + m] for k, a, m in zip(rows.tolist(), skip.tolist(), held.tolist(), strict=True)) + bytes(length + GRAM), np.uint8)
        n = held - length + 1  # windows of each row
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids = window_ids(text, np.repeat(np.cumsum(held) - held, n) + step, length)
        place = (start[rows] + skip)[row] + step
        number = pd.factorize(doc[rows], sort=True)[0].astype(np.int64)[row] * (int(place.max()) + 1) + place
        least = np.full(int(ids.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, ids, number)
        bad = np.flatnonzero(number > least[ids])
        out.append((doc[rows][row[bad]], place[bad], place[bad]))
    return merged(*(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)))


def repeated_runs(suspects: DataFrame, length: int) -> DataFrame:
    def work(batches):
        held: list[list] = []

        def runs(doc, first, last):
            return pa.record_batch([pa.array(doc), pa.array(first), pa.array(last)], ["doc", "first", "last"])

        def flush(upto=None):
            cols = [np.concatenate([x[k] for x in held]) for k in range(4)]
            data = [d for x in held for d in x[4]]
            n = len(data) if upto is None else upto
            rest = [[c[n:] for c in cols] + [data[n:]]] if n < len(data) else []
            return rest, runs(*repeats(*(c[:n] for c in cols), data[:n], length))

        for batch in batches:
            known = np.asarray(batch.column(5).is_valid())
            if known.any():
                done = batch.filter(pa.array(known))
                yield runs(done.column(1), done.column(2), done.column(5))
                batch = batch.filter(pa.array(~known))
            held.append([batch.column(k).to_numpy() for k in range(4)] + [batch.column(4).to_pylist()])
            if sum(len(x[4]) for x in held) >= BATCH_ROWS:
                h = np.concatenate([x[0] for x in held])
                whole = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if whole:
                    held, out = flush(whole)
                    yield out
        if held:
            yield flush()[1]

    dealt = suspects.repartition("h").sortWithinPartitions("h", "doc_id", "pos")
    return dealt.mapInArrow(work, "doc long, first long, last long")


def remove_repeats(docs: DataFrame, length: int = 100, bits: int = FILTER_BITS, frequent: int = FREQUENT, max_fill: float = MAX_FILL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes left) of each row of ``docs`` (doc_id, text).

    A byte goes where a ``length``-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. A null or empty text has no bytes; a null doc_id neither causes nor suffers removal; rows of one doc_id
    are the same document and not repeats of each other (they should hold one text); an empty table gives an empty
    result; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeated_runs(contexts(named.filter("doc_id is not null and text is not null"), length, bits, frequent, max_fill), length)
    # Sixteen bytes a run and one run an anchor (a position in thirty-five) at most: the hashed side is under half the texts.
    spans = settle(runs.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    joined = named.join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))

    def make():
        def step(part):
            rows = []
            for doc, text, firsts, lasts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = (text or "").encode("utf-8")
                if not firsts:
                    rows.append((doc, len(raw), 0, 0, raw))
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, np.array(firsts), 1)
                np.add.at(change, np.minimum(np.array(lasts) + length, len(raw)), -1)
                gone = np.cumsum(change[:-1]) > 0
                n = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                rows.append((doc, len(raw), int(gone.sum()), n, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        return step

    return per_slice(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", size=ANCHOR_BYTES)
