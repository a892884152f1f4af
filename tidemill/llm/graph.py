"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import durable

#: Edges that one task joins by itself before a round; there are as many tasks as that needs.
TASK_EDGES = 1 << 16


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.filter("b > a").join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for every node of a task's edges that is not the smallest of its component in the task, b being the smallest."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    moved = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64()), pa.array(list(map(find, moved)), pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(a, b) for every node ``a`` that is not the smallest of its component, ``b`` being the smallest.

    ``edges``: two longs a, b; loops and repeats are allowed. Each round first joins ``task_edges`` edges or so in each task, which
    ends it when that is all of them. Otherwise it goes on with two aggregations with partial sums and two equi-joins
    (splittable when a hub is skewed), then a reliable checkpoint; the number of rounds grows with the logarithm of the
    longest path. Only a count and a checksum reach the driver.
    """
    edges = durable(edges.filter("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        tasks = -(-before[0] // task_edges)
        stars = edges.coalesce(tasks).mapInArrow(_forest, "a long, b long")
        if tasks == 1:
            return durable(stars)
        edges = durable(_small_star(_large_star(stars)))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges
