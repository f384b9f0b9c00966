"""Token counts by rank-synchronous array merging of byte-level BPE.

Pre-tokens are held as ragged numpy arrays of symbol ids. A round finds every sequence's lowest-rank pair, merges all its
occurrences (left to right where they overlap) in every sequence at once, and compacts the arrays; sequences without a
mergeable pair leave with their number of symbols. Only pre-tokens that a task has not met before are merged. In a long
sequence a round touches few places, so its pairs are kept by rank and a round looks at these and their neighbours alone.
"""

from __future__ import annotations

import json
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import per_slice, sums, word_codes

#: Fixed value: the public pre-token pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000
CHUNK = 1 << 18
#: Bytes from which a sequence is merged by itself, with its pairs kept by rank.
LONG = 2_048
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts the symbols that BPE leaves of byte strings, many strings at once."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.bytes = np.array([ids[x] for x in byte_letters()], dtype=np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; the number of merges where there is none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], len(self.made))

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Number of symbols left of each text."""
        out = np.array([len(x) for x in texts], dtype=np.int64)
        for k in np.flatnonzero(out >= LONG):
            out[k] = self.count_long(texts[k])
        long = {*np.flatnonzero(np.array([len(x) for x in texts], dtype=np.int64) >= LONG).tolist()}
        if long:
            rest = np.array([k for k in range(len(texts)) if k not in long], dtype=np.int64)
            out[rest] = self.count([texts[k] for k in rest])
            return out
        if not len(out) or not out.sum():
            return out
        symbols = self.bytes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(texts)), out)
        none = len(self.made)
        while len(symbols) > 1:
            rank = np.full(len(symbols), none, dtype=np.int64)  # of the pair that starts here
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), none)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(owner)])
            out[owner[heads]] = sizes
            alive = np.repeat(least < none, sizes)
            chosen = (rank == np.repeat(least, sizes)) & alive
            # Where one pair overlaps the next (a run of one symbol), every second one counts from the run's left end.
            at = np.flatnonzero(chosen)
            starts = np.r_[True, np.diff(at) != 1]
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            symbols[at] = self.made[rank[at]]
            alive[at + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        if len(symbols):
            out[owner[0]] = len(symbols)
        return out

    def count_long(self, text: bytes) -> int:
        """The same of one sequence; each round merges its lowest-rank pair everywhere, at a cost of the places it touches."""
        symbols = self.bytes[np.frombuffer(text, dtype=np.uint8)]
        n, none = len(symbols), len(self.made)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.rank(symbols[:-1], symbols[1:]), none)  # of the pair that starts here
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for some in np.split(at, cuts) if len(at) else ():
                r = int(rank[some[0]])
                if r in waiting:
                    waiting[r].append(some)
                else:
                    waiting[r] = [some]
                    heappush(ranks, r)

        keep(np.arange(n))
        left = n
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # some were taken by a neighbour since
            if not len(at):
                continue
            # In a run of overlapping pairs every second one counts, from the left end.
            starts = np.r_[True, after[at[:-1]] != at[1:]]
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone] = self.made[r], none
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            touched = np.unique(np.r_[at, before[at][before[at] >= 0]])
            end = after[touched] >= n
            rank[touched[end]] = none
            touched = touched[~end]
            rank[touched] = self.rank(symbols[touched], symbols[after[touched]])
            keep(touched)
        return left


def token_counter(vocabulary: str):
    """A function from an Arrow array of texts to the number of tokens of each.

    Where a text has no two white-space characters side by side, the pre-token pattern always breaks before a space, so
    " word" can be counted by itself and once for a batch; the other texts go through the pattern whole.
    """
    import regex

    merger, find, seen = RankMerger(vocabulary), regex.compile(PATTERN), {}
    special = "|".join(map(regex.escape, sorted(merger.specials, key=len, reverse=True)))
    split = regex.compile(special).split if special else lambda x: [x]
    uneven = (special and special + "|") + r"^\s|\s$|\s\s"

    def learn(tokens: set[str]) -> None:
        fresh = sorted(x for x in tokens if x not in seen)
        seen.update(zip(fresh, merger.count([x.encode("utf-8") for x in fresh]).tolist(), strict=True))

    def whole(text: str) -> int:
        parts = split(text)
        total = len(parts) - 1
        for part in parts:
            found = (m[0] for m in find.finditer(part)) if len(part) > CHUNK else iter(find.findall(part))
            while some := list(islice(found, CHUNK)):
                learn({*some})
                total += sum(map(seen.__getitem__, some))
        return total

    def spaced(words: list[str]) -> np.ndarray:
        tokens = [find.findall(" " + w) for w in words]
        learn(set().union(*tokens))
        return np.array([sum(map(seen.__getitem__, x)) for x in tokens], dtype=np.int64)

    odd, known = regex.compile(uneven).search, {}

    def count(texts: pa.Array) -> np.ndarray:
        for held in (seen, known):
            if len(held) > CACHE_ENTRIES:
                held.clear()
        values = pc.fill_null(texts, "").to_pylist()
        apart = np.array([bool(odd(x)) for x in values], dtype=bool)
        even = pa.array(["" if a else x for a, x in zip(apart, values, strict=True)], pa.string())
        words, codes, offsets = word_codes(even, " ")
        fresh = [w for w in words if w not in known]
        known.update(zip(fresh, spaced(fresh).tolist(), strict=True))
        of_word = np.array([known[w] for w in words], dtype=np.int64)
        totals = sums(of_word[codes], offsets)
        learn({t for k, x in enumerate(values) if not apart[k] for t in find.findall(x.split(" ", 1)[0])})
        for k, x in enumerate(values):
            if apart[k] or not x:
                totals[k] = whole(x)
            else:
                first = x.split(" ", 1)[0]  # has no space before it
                totals[k] += whole(first) - known[first]
        return totals

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text).

    A null text counts as empty (0 tokens); a null doc_id is kept; repeated rows are counted each; other columns are
    ignored; an empty table gives an empty result. A special token's string inside a text is one token, as the tokenizer
    library has it by default. One pass, no shuffle.
    """

    def make():
        count = token_counter(vocabulary)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes = pc.fill_null(pc.binary_length(part.column(1)), 0)
            return pa.record_batch([part.column(0), sizes.cast(pa.int64()), pa.array(count(part.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

        return step

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(kept, make, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
