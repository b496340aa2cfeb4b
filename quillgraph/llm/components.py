"""Connected components of a large edge table by alternating stars; edges and labels never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and all its v as m."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) for the nodes of the pairs that aren't the least themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x, y in parent.items() if x != y]
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _within_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees of the edges of each batch: fewer edges, same components."""
    for pdf in batches:
        u, v = forest(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (u, v), the smallest node that it reaches.

    Batches of edges become trees first. Large star: neighbours above a node are tied to its least neighbour; small star:
    neighbours below it are. Both keep the components, and end with each tied to its least node after few rounds. Each round
    is written to the shared folder, so a lost executor costs one round at most. Null ends and loops are ignored; an empty
    table gives an empty one.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = staged(pairs.mapInPandas(_within_task, "u long, v long"), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
