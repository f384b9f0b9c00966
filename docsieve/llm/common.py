"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space of every word and line contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows handled at once inside a Python worker; long texts make a slice smaller, see ``slices``.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one is made only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docsieve-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder: later reads see the same partitions and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(side: DataFrame) -> DataFrame:
    """``side``, rows of a few numbers, marked for broadcast where they are counted to be few; else the join shuffles."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no classifier learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and few bytes (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for k, n in enumerate(sizes):
            if k > start and (held + n > size or k - start >= SLICE_ROWS):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def per_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices; ``make`` runs once a task and returns the function for one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches, text, size):
            out = step(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def word_codes(texts: pa.Array, blanks: str = SPACES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of each text, split at the characters ``blanks``: distinct words, each word's number there, and offsets by
    text (one more than texts). Empty words are kept only where ``blanks`` is one character; a null text has no words."""
    texts = pc.fill_null(texts, "")
    for x in blanks[1:]:
        texts = pc.replace_substring(texts, x, blanks[0])
    lists = pc.split_pattern(texts, blanks[0])
    offsets = np.asarray(lists.offsets).astype(np.int64)
    words = lists.flatten()
    offsets -= offsets[0]
    if len(blanks) > 1:
        full = np.asarray(pc.not_equal(words, ""))
        if not full.all():
            words = words.filter(pa.array(full))
            offsets = np.r_[0, np.cumsum(full)][offsets]
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [offsets[k], offsets[k + 1])."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])
