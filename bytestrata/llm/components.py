"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch

TASK_EDGES = 1 << 17


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Stars with the same components as the edges given: each node and the smallest that it reaches by them."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*ends.reshape(2, -1).tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    low = np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))
    moved = low != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[low[moved]])], ["u", "v"])


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of about TASK_EDGES edges of one partition as stars."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TASK_EDGES:
            yield _forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            held, n = [], 0
    if n:
        yield _forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the smallest node around it."""
    both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, linked to the smallest of them. Edges go from the larger end u to v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u")
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _shape(e: DataFrame) -> tuple[int, bool]:
    """The number of edges(u > v), and whether they are stars: every u has one v, and no v is a u. Then each v is its
    component's smallest."""
    ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    n, broken = degrees.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0)))).first()
    return n or 0, not broken


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u long, v long) -> a saved table (node, component): every node but the smallest of its component, and that.

    Each partition's edges are first contracted to stars in runs of bounded size, like a map-side combine, in the job that
    makes them. Large-star and small-star then alternate until the edges are stars, once at least, in as many partitions
    as the edges need. Hubs cost no single task: neighbours are never gathered in one row, each step is a grouped minimum
    and a join, whose hot keys adaptive execution splits. Self-loops and repeated edges are harmless.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(local_stars, "u long, v long"))
    n, done = now.count(), False
    while n and not done:
        sized = now.coalesce(max(1, math.ceil(n / TASK_EDGES)))
        after = scratch.save(_small_star(_large_star(sized)))
        n, done = _shape(after.coalesce(max(1, math.ceil(n / TASK_EDGES))))
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u long, v long) -> (node, component): every node of an edge, and the smallest node it is connected to."""
    found = stars(edges, scratch)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
