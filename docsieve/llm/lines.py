"""Line deduplication with a once-seen and a twice-seen Bloom filter in front of the exact confirmation.

Hashes of lines, combined in each batch, are dealt by their value: each task has the filters of its own range of hashes, so the
filters together grow with the corpus and none is larger than its task's share. What the twice-seen filter lets pass comes
back as a table of suspected hashes; only lines of those are shuffled, counted exactly and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import SPACES, ascii_lower, bounded, settle

#: Bits of each filter of one task; two bits a key.
FILTER_BITS = 1 << 27


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask).astype(np.int64)


def set_bits(filled: np.ndarray, at: np.ndarray) -> None:
    """Set sorted bit positions in a packed array."""
    if len(at):
        byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
        heads = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        filled[byte[heads]] |= np.bitwise_or.reduceat(bit, heads)


def has_bits(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def twice_seen(hashes: DataFrame, bits: int) -> DataFrame:
    """The distinct values of the one column ``h`` of ``hashes`` that the table may hold twice or more; all that it does."""

    def combine(batches):
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(np.minimum(n, 2), pa.int8())], ["h", "n"])

    def screen(batches):
        once, twice, held = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), []
        for batch in batches:
            h, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append(h)
            for at in positions(h, bits):
                at, times = np.unique(np.repeat(at, n), return_counts=True)
                set_bits(twice, at[has_bits(once, at) | (times > 1)])
                set_bits(once, at)
        if held:
            h = np.unique(np.concatenate(held))
            a, b = positions(h, bits)
            yield pa.record_batch([pa.array(h[has_bits(twice, a) & has_bits(twice, b)])], ["h"])

    return hashes.mapInArrow(combine, "h long, n byte").repartition("h").mapInArrow(screen, "h long")


def repeated_keys(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Suspected (key, doc_id, text_hash, line) rows, and the confirmed keys with their number of documents and last one."""
    named = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = F.transform(F.split("text", "\n", -1), line_key)
    long = lambda k: F.char_length(k) >= min_chars
    # explode would be given a filter on its array's size, which splits each text once more; the outer form is not.
    once = named.select(F.explode_outer(F.array_distinct(F.transform(F.filter(keys, long), lambda k: F.xxhash64(k)))).alias("h")).filter("h is not null")
    again = bounded(settle(twice_seen(once, bits)))
    # The hash is taken below the generator: a text must not travel with each of its lines.
    hashed = named.select("doc_id", F.xxhash64("text").alias("text_hash"), keys.alias("keys"))
    lines = hashed.select("doc_id", "text_hash", F.posexplode_outer("keys").alias("line", "key")).filter(long(F.col("key")))
    # Few suspected hashes go to the lines; of many, lines of other hashes are dropped by a join of two plain exchanges, in
    # which a line of very many documents is split as skewed.
    suspects = settle(lines.withColumn("h", F.xxhash64("key")).join(again, "h", "left_semi").drop("h"))
    # One row for each key, document and task; a line held by a third of the documents is counted in each task first.
    confirmed = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    # Written, so that the join with it is one of two plain exchanges: a key of very many lines is then split as skewed.
    return suspects, settle(confirmed.filter(F.col("n_docs") >= min_docs))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits: int = FILTER_BITS) -> DataFrame:
    """Every column of ``docs`` (doc_id, text, ...) plus kept_text, n_lines and n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys of ``min_chars`` code points or more in
    ``min_docs`` documents or more stay only in the largest doc_id that holds them. A null or empty text is one empty
    line; a null doc_id neither counts nor loses lines; rows of one doc_id are one document. An empty table gives an
    empty result. The three new columns replace those of ``docs`` that have their names.

    Texts are dealt out once, by doc_id; beside them stand the numbers of a document's lost lines, four bytes for each line
    of ``min_chars`` or more, so the hashed side is at most a fifth of the texts.
    """
    suspects, confirmed = repeated_keys(docs, min_docs, min_chars, bits)
    lost = suspects.join(confirmed, "key").filter(F.col("doc_id") < F.col("last_doc")).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))
    # All columns travel in one struct, so no name of theirs can clash.
    row = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    same = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash"))
    found = row.join(lost.hint("shuffle_hash"), same, "left").select("row", "gone", F.split(text, "\n", -1).alias("lines"))
    # array_except is one hash lookup a line; numbers of lines do not repeat.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")), kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
