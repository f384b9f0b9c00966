"""A Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources, with a proof for each row.

Every node covers up to FAN nodes of the level below. Rows are numbered in their source by range partitions and prefix sums.
A superblock is FAN ** DEPTH consecutive nodes; each is reduced by itself to the node DEPTH levels up, and those nodes are
reduced in superblocks of their own, until a source has one node, its subroot. Subroots, in the order of their sources, are
the leaves of one more such tree. On the way back each superblock is cogrouped with the one row that holds its outer nodes,
the siblings from its top to the root; the group finishes the local reduction, joins the local siblings with the outer ones
and folds each row's leaf to a root. No task sees more than one superblock, whatever a source's share of the rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docsieve.llm.common import bounded, settle

FAN, DEPTH, HEX = 3, 7, 64
NODES = "branch string, name string, rank long, n long, digest string"
OUTER = "branch string, name string, rank long, path string, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value as leaves hold it: its UTF-8 length, a colon and itself; a hyphen for null."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)).cast("binary"), 256)


def levels(digests: list[str], n: int, most: int) -> list[list[str]]:
    """The nodes of up to ``most`` levels over consecutive ``digests`` of a level of ``n`` nodes; at least themselves."""
    out = [digests]
    while n > 1 and len(out) <= most:
        below, n = out[-1], -(-n // FAN)
        out.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def steps(tree: list[list[str]]) -> list[list[str]]:
    """For each level but the top, what a proof holds for each node: its place in its run, then its siblings in order."""
    out = []
    for nodes in tree[:-1]:
        row = []
        for k in range(len(nodes)):
            run = k - k % FAN
            row.append(f"{k % FAN}{''.join(nodes[run:k])}{''.join(nodes[k + 1 : run + FAN])}")
        out.append(row)
    return out


def paths(digests: list[str], n: int, outer: str, depth: int) -> list[str]:
    """The whole proof of each node: local steps, then the outer ones; steps are parted by slashes."""
    local = steps(levels(digests, n, depth))
    return ["/".join([*(row[k // FAN**level] for level, row in enumerate(local)), *([outer] if outer else [])]) for k in range(len(digests))]


def fold(node: str, path: str) -> str:
    """The root that a node and its proof give."""
    for step in path.split("/") if path else ():
        at, siblings = 1 + HEX * int(step[0]), step[1:]
        node = digest(siblings[: at - 1] + node + siblings[at - 1 :])
    return node


def siblings(path: str) -> str:
    return "".join(step[1:] for step in path.split("/"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (branch, ...) with their rank from 0 in their branch by ``order`` and the branch's number of rows, ``n``.

    Written sorted by ranges, which cut through a branch and through rows of equal keys; a row for each range and branch then
    gives the ranks before it."""
    keys = ["branch", *order, "tie"]
    sorted_ = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = settle(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).drop("tie"))
    counts = ranged.groupBy("part", "branch").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    own = W.partitionBy("branch")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = bounded(settle(counts.select("part", "branch", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))))
    return ranged.join(starts, ["part", "branch"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocked(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {FAN**depth}"))


def climb(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that superblocks are cut from, from the lowest, and the one node of each branch at the top."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        n = int(group["n"].iloc[0])
        tree = levels(group["digest"].tolist(), n, depth)
        for _ in tree[1:]:
            n = -(-n // FAN)
        return pd.DataFrame({"branch": group["branch"].iloc[:1], "name": "", "rank": group["block"].iloc[:1], "n": n, "digest": tree[-1][0]})

    stages = [nodes]
    while True:
        top = settle(blocked(stages[-1], depth).groupBy("branch", "block").applyInPandas(reduce, NODES))
        if top.filter("n > 1").isEmpty():
            return stages, top
        stages.append(top)


def descend(stages: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """From the proof of each branch's top (OUTER, rank 0) to those of the superblocks of the lowest stage."""

    def extend(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        top = above.iloc[0]
        found = paths(group["digest"].tolist(), int(group["n"].iloc[0]), top["path"], depth)
        return pd.DataFrame({"branch": group["branch"], "name": group["name"], "rank": group["rank"], "path": found, "subroot": top["subroot"], "root": top["root"]})

    for nodes in reversed(stages):
        outer = blocked(nodes, depth).groupBy("branch", "block").cogroup(outer.withColumnRenamed("rank", "block").groupBy("branch", "block")).applyInPandas(extend, OUTER)
    return outer


def manifest(docs: DataFrame, presented: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs`` (doc_id, source, lang, n_chars,
    text): the tree is built over the rows as they are, and folded from the leaf of the row with the text ``presented``.
    A superblock is of FAN ** ``depth`` nodes.

    Rows stand in their source by doc_id, null first, and rows of one doc_id by their leaves; rows that agree in those, too,
    are equal and get proofs of neighbouring places. A null source is a source of its own, apart from the empty one, and comes
    first. Null and empty values are leaves like others. An empty table gives an empty result; other columns are ignored.

    Texts are hashed where they are read; digests alone are shuffled.
    """
    whole = leaf(F.col("text"))
    own = whole if presented is None else F.when(presented.eqNullSafe(F.col("text")), whole).otherwise(leaf(presented))
    # A prefix keeps the order of sources and lets null be a key apart from the empty one.
    branch = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), branch.alias("branch"), whole.alias("digest"), own.alias("shown"))
    leaves = numbered(settle(named), "doc_id", "digest")
    stages, subroots = climb(leaves.select("branch", F.lit("").alias("name"), "rank", "n", "digest"), depth)
    sources = numbered(subroots.select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest"), "name").select(*(x.split()[0] for x in NODES.split(", ")))
    above, root = climb(settle(sources), depth)
    start = root.select("branch", "name", F.lit(0).cast("long").alias("rank"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = descend(above, start, depth).select(F.col("name").alias("branch"), "path", "root").join(subroots.select("branch", F.col("digest").alias("subroot")), "branch")
    outer = descend(stages[1:], tops.select("branch", F.lit("").alias("name"), F.lit(0).cast("long").alias("rank"), "path", "subroot", "root"), depth)

    def finish(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        top = above.iloc[0]
        found = paths(group["digest"].tolist(), int(group["n"].iloc[0]), top["path"], depth)
        folded = [fold(x, p) for x, p in zip(group["shown"], found, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"], "leaf": group["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": [digest(siblings(p)) for p in found],
                "folded_root": folded, "verified": [x == top["root"] for x in folded],
            }
        )

    # As text: pandas would make a group's doc_ids inexact numbers where one of them is null.
    below = blocked(leaves, depth).withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("branch", "block")
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return below.cogroup(outer.withColumnRenamed("rank", "block").groupBy("branch", "block")).applyInPandas(finish, out).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_newlines() -> Column:
    """The tampering that the query presents: rows whose doc_id has an even checksum come without their line ends."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
