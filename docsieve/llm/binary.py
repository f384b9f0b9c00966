"""Token ids as flat binary files that are mapped into memory.

A folder holds, for each partition of the documents in ascending doc_id order,

- ``<part>.ids``: the ids of its documents in a row, little-endian unsigned integers of 16 bits where the vocabulary fits, else 32;
- ``<part>.offsets``: where each document ends in that file, in ids, as little-endian unsigned 64-bit numbers;
- ``<part>.docs``: the doc_ids, as little-endian signed 64-bit numbers (0 for the null ones, which come first);

and ``manifest``, a JSON table with a row for each partition: file name, ids and documents in it and before it, null doc_ids.
Partition bases are prefix sums of the partitions' totals, so a document's place in the whole is its partition's base plus
its offset, and no file has to wait for the one before it. A task that runs again writes files of its own; only those of
the attempts that the driver has heard of are in the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.common import SLICE_BYTES, SLICE_ROWS, shared_dir, slices
from docsieve.llm.packing import encoder, loaded

END_ID = 1
MANIFEST = "part int, name string, width int, n_docs long, n_null long, n_tokens long, docs_before long, tokens_before long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(f"file://{path[5:] if path.startswith('file:') else path}" if path.startswith(("/", "file:/")) and "://" not in path else path)


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to the folder ``path`` and return its manifest.

    A null or empty text is its end id alone; null doc_ids come first; rows of one doc_id stand in the order of their texts'
    length and checksum; an empty table gives a manifest without rows; other columns are ignored. Texts are shuffled once, by
    ranges that cut through rows of one doc_id, and each range is encoded as its files are written, so ids are kept nowhere
    else. Where 16 bits hold the vocabulary and the end id they are used.
    """
    spark = docs.sparkSession
    width = 2 if max(loaded(vocabulary)[0].get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = named.select("*", F.octet_length("text").alias("size"), F.crc32("text").alias("checksum"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), "size", "checksum", "tie"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, streams, docs_done, nulls, tokens = TaskContext.get(), None, 0, 0, 0
        name, encode = f"{task.partitionId():06d}-{task.taskAttemptId()}", encoder(vocabulary, end_id)
        for part in slices(batches):
            if streams is None:
                fs, folder = file_system(path)
                fs.create_dir(folder, recursive=True)
                streams = [fs.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
            ids, ends = encode(part.column(1))
            for stream, numbers in zip(streams, (ids.astype(f"<u{width}"), (tokens + ends[1:]).astype("<u8"), part.column(0).fill_null(0).to_numpy().astype("<i8")), strict=True):
                stream.write(numbers.tobytes())
            docs_done, nulls, tokens = docs_done + part.num_rows, nulls + part.column(0).null_count, tokens + len(ids)
        if streams is not None:
            for stream in streams:
                stream.close()
            yield pa.record_batch([pa.array([x]) for x in (task.partitionId(), name, docs_done, nulls, tokens)], ["part", "name", "n_docs", "n_null", "n_tokens"])

    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # One row a partition, whatever the number of documents.
    parts = sorted(ranged.mapInArrow(write, "part long, name string, n_docs long, n_null long, n_tokens long").collect())
    docs_before, tokens_before = (accumulate((r[k] for r in parts[:-1]), initial=0) for k in ("n_docs", "n_tokens"))
    rows = [(r.part, r["name"], width, r.n_docs, r.n_null, r.n_tokens, d, t) for r, d, t in zip(parts, docs_before, tokens_before, strict=False)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the folder is mounted, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False, span: int = 1 << 16) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in a folder that ``write_ids``
    has written, with its ids as little-endian unsigned 32-bit numbers where ``keep_ids``. Tasks take ``span`` documents each."""
    spans = read_manifest(spark, path).select("*", F.explode(F.expr(f"sequence(0L, n_docs - 1, {span}L)")).alias("first"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] * keep_ids)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for row in (r for batch in batches for r in batch.to_pylist()):
            base = f"{folder}/{row['name']}"
            ids, ends, docs = mapped(fs, f"{base}.ids", f"<u{row['width']}"), mapped(fs, f"{base}.offsets", "<u8"), mapped(fs, f"{base}.docs", "<i8")
            first, last = row["first"], min(row["first"] + span, row["n_docs"])
            while first < last:
                start = int(ends[first - 1]) if first else 0
                # As many documents as fit a slice, one at least.
                stop = max(first + 1, min(last, first + SLICE_ROWS, first + int(np.searchsorted(ends[first:last], start + SLICE_BYTES // 4, side="right"))))
                cuts = np.r_[start, ends[first:stop].astype(np.int64)]
                data = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                named = pa.array(np.asarray(docs[first:stop]), mask=np.arange(first, stop) < row["n_null"])
                columns = [named, pa.array(cuts[:-1] + row["tokens_before"]), pa.array(np.diff(cuts)), pa.array(list(map(zlib.crc32, data)), pa.int64()), *([pa.array(data, pa.binary())] * keep_ids)]
                yield pa.record_batch(columns, names)
                first = stop

    return spans.repartition("part", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """What is read back from a new folder of ``docs``' ids under the cluster's checkpoint folder, see ``write_ids`` and ``read_ids``."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, vocabulary, path, end_id)
    return read_ids(docs.sparkSession, path)
