"""Pieces the operators share: written intermediate tables, hot buckets, pairs inside buckets, components.

Buckets are the unit of candidate search: rows with equal ``bucket`` may form a pair. ``split_hot`` deals
a bucket of more than ``cap`` rows out as pairs of blocks, so that no task ever holds more than two blocks;
``bucket_chunks`` and ``pairs_inside`` walk through sorted buckets in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.session import scratch_path

BUCKET_CAP = 4096


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages never recompute it after a lost executor."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``keep``, in buckets of ``column``: what groups or joins by it later need not shuffle these rows.

    The table is only registered while it is written; the files lie in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    table = f"llm_{path.rpartition('-')[2]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    rows = spark.read.table(table)
    rows.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return rows


def split_hot(df: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Adds ``part`` and ``side`` to rows with a ``bucket``.

    A bucket of at most ``cap`` rows is one part. A larger one is cut into blocks of about ``cap / 2`` rows
    by a hash of the whole row, and each pair of blocks is a part; every pair of rows meets in at least one part:
    rows of different sides in the part of their two blocks, rows of one side in the part of that block alone
    (where all have side 0).
    """
    payload = [c for c in df.columns if c != "bucket"]
    # written, so that its size is known and rows need no shuffle where hardly a bucket is hot
    hot = keep(
        df.groupBy("bucket").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > cap)
        .select("bucket", F.ceil(F.col("_rows") * 2 / cap).cast("int").alias("_blocks")), "hot"
    )
    rows = df.join(hot, "bucket", "left").withColumn(
        "_own", F.when(F.col("_blocks").isNotNull(), F.pmod(F.xxhash64(*payload), F.col("_blocks").cast("long")).cast("int"))
    )
    cold = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side")))
    dealt = F.transform(
        F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1),
        lambda other: F.struct(
            (F.least(other, F.col("_own")) * F.col("_blocks") + F.greatest(other, F.col("_own"))).alias("part"),
            F.when(other < F.col("_own"), 1).otherwise(0).alias("side"),
        ),
    )
    return (
        rows.withColumn("_in", F.explode(F.when(F.col("_blocks").isNull(), cold).otherwise(dealt)))
        .select("bucket", F.col("_in.part").alias("part"), F.col("_in.side").alias("side"), *payload)
    )


def dealt(df: DataFrame) -> DataFrame:
    """Rows of one (bucket, part) next to each other, sides in order."""
    return df.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")


def bucket_chunks(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a (bucket, part) ends; holds one chunk and one bucket at most."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, part = (table.column(c).to_numpy() for c in ("bucket", "part"))
        inner = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        if len(inner):
            cut = int(inner[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_inside(bucket: np.ndarray, part: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that share bucket and part, one distance in the sort order after the other.

    In a part of two blocks (side 1 occurs) only pairs across the sides count.
    """
    n = len(bucket)
    if n < 2:
        return
    start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    length = np.diff(np.r_[start, n])
    run = np.repeat(np.arange(len(start)), length)
    mixed = (np.add.reduceat(side, start) > 0)[run]
    last = (start + length)[run]
    at, gap = np.arange(n), 1
    while True:
        at = at[at + gap < last[at]]
        if not len(at):
            return
        left, right = at, at + gap
        two = mixed[left]
        if two.any():
            fits = ~two | (side[left] != side[right])
            left, right = left[fits], right[fits]
        if len(left):
            yield left, right
        gap += 1


class Forest:
    """Collects links and gives back a few of them that connect the same nodes."""

    def __init__(self, most: int = 500_000):
        self.left, self.right, self.count, self.most = [], [], 0, most

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.count += len(left)
        if self.count > self.most:
            a, b = self.links()
            self.left, self.right, self.count = [a], [b], len(a)
            self.most = max(self.most, 2 * len(a))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(smaller, larger) per node that is not the smallest of its component."""
        if not self.left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nodes, at = np.unique(np.concatenate([*self.left, *self.right]), return_inverse=True)
        a, b = np.split(at.reshape(-1), 2)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[label[other]], nodes[other]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows the pointers to their ends, and contracts the graph
    to these ends. No two ends are neighbours, so a round at least halves the nodes that still have links, and following
    doubles the distance each time: the number of jobs is logarithmic. Rounds are written to the shared folder.
    Rows with a null end and loops are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        rounds.append(_followed(nearest))
        ends = rounds[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        edges = edges.join(ends, "a").join(ends.toDF("b", "rb"), "b").filter("ra <> rb")
        edges = keep(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop()
    while rounds:
        upper = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = rounds.pop().join(upper, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return found


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers (node, root) replaced by the ends they lead to."""
    while True:
        pointers = keep(pointers, "pointers")
        upper = pointers.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above"))
        if pointers.join(upper, "root", "left_semi").isEmpty():
            return pointers
        pointers = pointers.join(upper, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def each_slice(slices: list) -> Iterator:
    """The values of broadcasts, one in memory at a time if there are several."""
    if len(slices) == 1:
        yield slices[0].value
        return
    for one in slices:
        yield one.load_from_path(one._path)


def held_out_key(column: str):
    """crc32 of the id as text: splits rows into folds that no content decides."""
    return F.crc32(F.col(column).cast("string"))
