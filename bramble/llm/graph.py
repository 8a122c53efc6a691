"""Connected components of an edge table that no single machine holds.

Edges are brought down to a spanning forest before each shuffle, a task's part at a time: copies of an edge, chains and the
edges of a node with many smaller neighbours go there. What is left is rewritten in rounds: each node tells its larger
neighbours the smallest node it knows (large-star of Kiveris et al., 2014), and the edges of a node with smaller neighbours,
together again after a shuffle, are brought down to a forest once more, which joins at least what small-star would join. It
ends when each node has either larger neighbours only or one smaller one. Once at most `one_task` edges are left, one task
ends it: their number is counted first, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, fresh_path, write

#: Edges that a task brings down to a forest at once, and edges that one task may end with: 16 bytes each.
HELD_EDGES, ONE_TASK = 1_000_000, 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node that isn't the smallest of its component, and that smallest."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        x, y = label[left], label[right]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label = further
    below = label != np.arange(len(names))
    return names[below], names[label[below]]


def contract(batches: Iterator[pa.RecordBatch], most: int = HELD_EDGES) -> Iterator[pa.RecordBatch]:
    """Bring down each `most` edges (the first two columns) of a task to a forest (u, v)."""

    def out(held: list) -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > most:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _contract(most: int):
    return lambda batches: contract(batches, most)


def _kept(df: DataFrame, path: str) -> DataFrame:
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for each node that has an edge to another one."""
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    return settled(plain.mapInArrow(_contract(HELD_EDGES), "u long, v long"), one_task, most_rounds)


def settled(edges: DataFrame, one_task: int = ONE_TASK, most_rounds: int = 60) -> DataFrame:
    """As components(), of edges (u, v) that contract() has given."""
    spark, base = edges.sparkSession, fresh_path(edges.sparkSession, "components")
    now = _kept(edges, f"{base}/0")
    for k in range(1, most_rounds + 1):
        if now.count() <= one_task:
            now = _kept(now.coalesce(1).mapInArrow(_contract(one_task), "u long, v long"), f"{base}/last")
            delete(spark, f"{base}/{k - 1}")
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join of a hub's edges with its minimum has plain exchanges on both sides, whose skew Spark splits.
        known = _kept(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumnRenamed("u", "w"), f"{base}/{k}-known")
        if known.where("low < w AND low <> high").isEmpty():
            delete(spark, f"{base}/{k - 1}")
            return known.select(F.col("w").alias("node"), F.least("w", "low").alias("root"))
        large = both.join(known, both["u"] == known["w"]).where("v > u").select(F.col("v").alias("u"), F.least("w", "low").alias("v"))
        # Sorted, so that a task that runs again brings down the same edges together.
        less = large.sortWithinPartitions("u", "v").mapInArrow(_contract(HELD_EDGES), "u long, v long")
        now = _kept(less.repartition("u").mapInArrow(_contract(HELD_EDGES), "u long, v long"), f"{base}/{k}")
        for old in (k - 1, f"{k}-known"):
            delete(spark, f"{base}/{old}")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
