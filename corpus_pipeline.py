"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null and empty texts, repeated rows and empty tables pass through every stage; extra columns of the input are dropped.
Toxicity decides on each row by itself. SimHash and decontamination name rows by doc_id: rows without one are kept there,
and rows of one doc_id share one fate (of equal doc_ids in one near-copy group all rows of the smallest id stay).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import decontamination, lines, packing, simhash, toxicity
from docsieve.llm.common import bounded, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``dropped``. The ids are counted: few are broadcast, so that texts stay
    where they are; many are hashed to texts that are dealt out."""
    ids = bounded(settle(dropped.select("doc_id").distinct()))
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores 0.5 or more go; a null text is scored as an empty one. Rows are judged as they pass."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, tuple(COLUMNS[1:])).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more found in three documents stay in the last of them; documents stay, even empty, and
    null texts stay null."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays; texts without words are one group."""
    groups = simhash.near_groups(docs)
    return without(docs, groups.filter("doc_id != component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return without(docs, decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and the sequences they lie in; a null text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The learned lexicon and the fingerprints are not expressible in SQL. tests/llm/test_pipeline.py holds each stage's kept
#: rows, and ``run`` as a whole, against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; each reads what the one before left in the shared folder, since operators pass over their
    input more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, settle(docs) if k else docs, sf_dir)
    return docs
