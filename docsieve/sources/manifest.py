"""A list of batches that is replaced as a whole.

Each version of the list is a folder with one file, which Spark moves into place when it is complete; readers take the
highest version that holds a file. Two writers that publish the same version collide on its folder, and the later one is
told to read again. Sequence numbers are places in the list, so they outlive whatever made a batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ENTRIES = "name string, source string, number long, seq long"


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRIES}, version long").json(f"{path}/manifest")


def published(spark: SparkSession, path: str) -> list[Row]:
    """The batches of the list in order, each with its name, source, the source's own number for it, and its sequence number;
    none where nothing has been published."""
    try:
        every = versions(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    newest = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == newest).orderBy("seq").collect() if newest is not None else []


def publish(spark: SparkSession, path: str, entries: list[tuple[str, str, int]], old: list[Row] | None = None) -> None:
    """Make ``entries`` (name, source, number) the list. ``old``: the list that it was made from, the newest where it is not
    given. Fails (PATH_ALREADY_EXISTS) if another list has been published since."""
    old = published(spark, path) if old is None else old
    version = old[0].version + 1 if old else 0
    rows = [(name, source, number, seq) for seq, (name, source, number) in enumerate(entries)]
    spark.createDataFrame(rows, ENTRIES).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/version={version}")
