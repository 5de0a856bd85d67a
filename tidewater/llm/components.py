"""Connected components of a graph given as a table of links, by alternating large and small stars.

What a task holds of the links is contracted to stars first. Each round links every node's larger neighbours to its smallest one, then its smaller ones; a component ends as one star around
its smallest node. Every step is a grouping and a join of written tables; no component is gathered in one place, and a round's tables
are deleted when the next one stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import releasing, remove, written

#: Links that a task contracts at once.
CHUNK = 500_000


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of those links that join two trees."""
    parent = list(range(n))
    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[b] = a
            keep.append(k)
    return np.array(keep, int)


@releasing
def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task, CHUNK at a time, as stars around the smallest node of what they join."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        parent = list(range(len(nodes)))
        half = len(at) // 2
        for x, y in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        top = np.array(parent, np.int64)
        while (top != top[top]).any():
            top = top[top]
        leaf = np.flatnonzero(top != np.arange(len(top)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[top[leaf]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that links lead to) for every node (a long) of a link; loops and repeated links do not matter."""
    spark = edges.sparkSession

    def least(links: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Of each node that has smaller neighbours the smallest. Written, so that the joins below meet two plain tables and a hot node can be split."""
        return written(links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), name)

    now, path = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct().mapInArrow(contracted, "a long, b long"), "links")
    while True:
        low, at = least(now, "least")
        links = now.count()
        # a forest of stars: every node has one smaller neighbour, and none of these has one itself
        if low.count() == links and not now.join(low, now["b"] == low["u"], "left_semi").head(1):
            remove(spark, at)
            break
        old = [path, at]
        # large star: what is linked to a node from above moves to that node's smallest neighbour, if it has a smaller one
        now, path = written(now.join(low, now["b"] == low["u"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "links")
        old.append(path)
        # small star: a node and its smaller neighbours move to the smallest of them
        low, at = least(now, "least")
        old.append(at)
        met = now.join(low, now["a"] == low["u"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now, path = written(met.where("a <> b").distinct(), "links")
        for x in old:
            remove(spark, x)
    # a component is a star around its smallest node now
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
