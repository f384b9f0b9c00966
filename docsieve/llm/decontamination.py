"""Benchmark decontamination: size-partitioned MinHash containment search in DataFrame operations alone.

Items are partitioned by their number of distinct shingles, in powers of two. An item's MinHash sketch is its smallest
shingle hashes, as many as its partition's largest item may miss plus one; so a document that holds the wanted share of the
item holds at least one of the sketch, however long the document is. A Bloom filter of all sketches screens the documents'
shingles as they are read. Documents too small to hold the wanted share of an item are not joined with it. Candidates are
then verified by comparing shingle texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import LOWER, SPACES, UPPER, bounded, settle

#: Bits of the filter that screens shingles, at most.
FILTER_BITS = 1 << 28


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES, LOWER + " " * len(SPACES)), " ", -1), lambda w: w != "")


def windows(values: Column, n: int, combine) -> Column:
    """``combine`` of every n neighbours; of the whole array where it is shorter; nothing of an empty one."""
    full = F.transform(F.slice(values, F.lit(1), F.greatest(F.size(values) - (n - 1), F.lit(0))), lambda x, i: combine(x, *(F.get(values, i + k) for k in range(1, n))))
    return F.when(F.size(values) == 0, F.array().cast(full_type(combine))).when(F.size(values) >= n, full).otherwise(F.array(combine(F.array_join(values.cast("array<string>"), " "))))


def full_type(combine) -> str:
    return "array<bigint>" if combine is hashed else "array<string>"


def hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside a lambda, a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def shingle_hashes(tokens: Column, n: int) -> Column:
    return once(F.transform(tokens, lambda w: F.xxhash64(w)), lambda v: windows(v, n, hashed))


def shingle_texts(tokens: Column, n: int) -> Column:
    return F.array_distinct(once(tokens, lambda v: windows(v, n, joined)))


def among(hashes: DataFrame, most_bits: int = FILTER_BITS) -> Column:
    """A test of a column ``h``: true for all of the ``hashes`` (h) and for few other values.

    A Bloom filter of one bit a key, 16 bits for each key and ``most_bits`` at most, in 64-bit words. It is a scalar that the
    filter reads, so no row carries it; with more keys it screens less and loses nothing."""
    words = 1 << max(0, min(most_bits, 16 * hashes.count()).bit_length() - 6)
    at, bit = F.pmod(F.shiftrightunsigned("h", 6), F.lit(words)).cast("int"), F.expr("cast(h & 63 as int)")
    filled = hashes.select(at.alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word"))
    every = hashes.sparkSession.range(words).select(F.col("id").alias("at")).join(filled, "at", "left").select(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("w"))
    table = every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["word"]).alias("words"))
    return F.getbit(F.get(table.scalar(), at), bit) == 1


def leaks(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items (item_id, text) of whose distinct ``n``-word shingles a share
    of ``threshold`` or more is in the document (doc_id, text).

    A text of fewer words is one shingle; null, empty and blank texts have none and match nothing; rows of null id match
    nothing; rows of one doc_id are one document and rows of one item_id one item; empty tables give an empty result;
    other columns are ignored.
    """
    share = math.ceil(threshold * 1e6)
    shingled = items.filter("item_id is not null").select("item_id", words(F.col("text").cast("string")).alias("w"))
    # A row for each item and distinct shingle; rows of one item_id are one item.
    own = settle(shingled.select("item_id", F.explode(shingle_texts(F.col("w"), n)).alias("shingle")).distinct())
    sets = shingled.select("item_id", F.explode(shingle_hashes(F.col("w"), n)).alias("h")).groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    sized = sets.withColumn("n_item", F.size("hs").cast("long")).withColumn("need", F.expr(f"(n_item * {share} + 999999) div 1000000"))
    # The largest item of the partition that holds n_item.
    top = F.pow(F.lit(2), F.floor(F.log2(F.col("n_item"))) + 1) - 1
    may_miss = F.floor(top - F.ceil(top * (share / 1e6) - 1e-9))
    sketch = settle(sized.select("item_id", "need", F.explode(F.slice("hs", F.lit(1), (may_miss + 1).cast("int"))).alias("h")))
    named = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = named.select("doc_id", F.coalesce(shingle_hashes(words(F.col("text")), n), F.array().cast("array<bigint>")).alias("hs"))
    # explode would be given a filter on its array's size, which hashes each text once more; the outer form is not.
    probes = hashes.select("doc_id", F.size("hs").alias("n_doc"), "hs").select("doc_id", "n_doc", F.explode_outer("hs").alias("h")).filter("h is not null")
    # Screened where the texts are read, so that few shingles are joined, however many items there are.
    near = probes.filter(among(sketch.select("h"))).join(bounded(sketch), "h").filter(F.col("n_doc") >= F.col("need"))
    candidates = settle(near.select("doc_id", "item_id").distinct())
    # Only candidates' texts are read again. Shingles are matched by document, so none is common to many rows of one key.
    texts = named.join(bounded(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    held = texts.select("doc_id", F.explode_outer(shingle_texts(words(F.col("text")), n)).alias("shingle"))
    held = held.withColumn("h", F.xxhash64("shingle")).filter(among(own.select(F.xxhash64("shingle").alias("h")))).drop("h")
    both = candidates.join(own, "item_id").join(held, ["doc_id", "shingle"], "left_semi")
    found = both.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    enough = F.col("n_shared") * 1_000_000 >= F.col("n_item") * share
    return found.join(sizes, "item_id").filter(enough).select("doc_id", "item_id", "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))
