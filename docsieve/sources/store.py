"""Ingest and storage: JSON in and out, an append-only Parquet log, latest version wins on reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.errors import SearchError
from docsieve.sources.manifest import publish, published


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder the cluster names; under a temporary one only where all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='docsieve-')}/{uuid.uuid4().hex}"


def read_json(spark: SparkSession, path: str, *dynamic: str, lines: bool = False) -> DataFrame:
    """Documents from files that each hold a JSON array; with ``lines``, from files of one document a line."""
    return spark.read.schema(schema.struct(*dynamic)).option("multiLine", not lines).json(path)


def upsert_latest(log: DataFrame, key: str = "id", version: str = "_version_") -> DataFrame:
    """The newest row of each key; partial aggregation keeps one row a key and task before the shuffle.

    Of rows of one key and version the last one of its batch counts (``_row_``), and where a log has no rows' numbers the one
    whose values sort last."""
    rest = [c for c in log.columns if c != key]
    ties = ["_row_"] if "_row_" in rest else [f.name for f in log.schema.fields if f.name not in (key, version) and f.dataType.typeName() != "map"]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, *ties)).alias("__row"))
    return newest.select(key, "__row.*").select(*log.columns)


def append(docs: DataFrame, path: str, source: str = "batch", number: int | None = None) -> int:
    """Add a batch to the log at ``path``; its sequence number, which is its place among all batches of all sources.

    ``number``: the source's own count of its batches, ascending. A batch that its source has sent before is not added again.
    Rows are numbered in their batch. The batch counts from the moment that the manifest names it, and not before."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    written = False
    while True:
        old = published(spark, path)
        sent = [r.seq for r in old if r.source == source and number is not None and r.number >= number]
        if sent:
            return sent[0]
        if not written:
            docs.drop("_version_", "_row_").withColumn("_row_", F.monotonically_increasing_id()).write.parquet(f"{path}/batches/batch={name}")
            written = True
        entries = [(r.name, r.source, r.number) for r in old]
        try:
            publish(spark, path, [*entries, (name, source, len(old) if number is None else number)], old)
        except AnalysisException as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            continue  # another writer was first; its list is read and added to
        return len(old)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the published batches, with the batch's sequence number as ``_version_`` and the row's number in it as ``_row_``."""
    batches = [(r.name, r.seq) for r in published(spark, path) if r.name]
    if not batches:
        raise SearchError(f"nothing has been published in the log {path}")
    seq = spark.createDataFrame(batches, "batch string, _version_ long")
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/batches").filter(F.col("batch").isin(*(b for b, _ in batches)))
    return rows.join(F.broadcast(seq), "batch").drop("batch")  # a row a batch


def current(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a log as they are now."""
    return upsert_latest(read_log(spark, path)).drop("_row_")


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Write the current documents of a log to another log, as one batch; what its sources have sent stays known."""
    name, old = uuid.uuid4().hex, published(spark, source)
    current(spark, source).drop("_version_").withColumn("_row_", F.monotonically_increasing_id()).write.parquet(f"{target}/batches/batch={name}")
    last: dict[str, int] = {}
    for r in old:
        last[r.source] = max(r.number, last.get(r.source, -1))
    publish(spark, target, [*(("", s, n) for s, n in sorted(last.items())), (name, "compact", len(old))], [])


def write_json(docs: DataFrame, path: str) -> None:
    """One document a line."""
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.mode("overwrite").text(path)


def write_json_arrays(docs: DataFrame, path: str, rows: int = 1000) -> None:
    """Files that each hold an array of at most ``rows`` documents."""
    numbered = docs.select(F.to_json(F.struct(*docs.columns)).alias("doc"), F.floor(F.monotonically_increasing_id() / rows).alias("part"))
    arrays = numbered.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


POSTINGS = "field string, term string, id string, tf int, positions array<int>"


def index_postings(docs: DataFrame, name: str) -> DataFrame:
    """(field, term, id, tf, positions) of an analysed field, for many queries over one corpus.

    A document's postings are all in its row, so they are grouped where it is read and nothing is shuffled."""
    from docsieve.plans.compile import tokens

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            coded = flat.field(0).dictionary_encode()
            code, pos = np.asarray(coded.indices), np.asarray(flat.field(1))
            order = np.lexsort((pos, code, row))
            row, code, pos = row[order], code[order], pos[order]
            heads = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(code) != 0)])
            ends = np.r_[heads, len(row)].astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array([name] * len(heads)), coded.dictionary.take(pa.array(code[heads])), batch.column(0).take(pa.array(row[heads])), pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32))),
                ],
                ["field", "term", "id", "tf", "positions"],
            )

    return docs.select("id", F.coalesce(tokens(name), F.array().cast("array<struct<term:string,pos:int>>")).alias("t")).mapInArrow(group, POSTINGS)
