"""Exact inner-product top-k by KD-trees, one per shard.

A shard's tree splits at the median of its widest dimension and keeps a tight box for every node. A query visits nodes
best first by the largest inner product that their box allows and stops where that falls below its k-th score so far.
Each query is first searched in one home shard; its k-th score there goes with it to all others, which therefore prune
from the start, in whole numbers throughout. Vectors and queries are dealt by hashes. Each tree goes to one task once, as
the first row of its shard's run of rows, and the queries stream past it in batches; tasks exchange at most k rows per
query and shard. The bounds of all nodes are one matrix product a batch: there are two nodes for ``leaf`` points, so that
they cost a fiftieth of the scores they save.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch

SAFE = 1 << 53


@dataclass(frozen=True)
class Params:
    k: int = 5
    shard_rows: int = 16_384
    leaf: int = 96
    scale: float = 256.0


class Tree:
    """Points as whole numbers in tree order, boxes per node; node i's children follow from ``kids``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        lo, hi, kids, spans = [], [], [], []

        def grow(a: int, b: int) -> int:
            me = len(lo)
            part = points[order[a:b]]
            lo.append(part.min(0))
            hi.append(part.max(0))
            kids.append((-1, -1))
            spans.append((a, b))
            if b - a > leaf:
                d = int(np.argmax(hi[me] - lo[me]))
                if hi[me][d] > lo[me][d]:
                    m = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(part[:, d], m)]
                    kids[me] = (grow(a, a + m), grow(a + m, b))
            return me

        grow(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.lo, self.hi, self.kids, self.spans = np.array(lo), np.array(hi), kids, spans

    def search(self, qids: np.ndarray, queries: np.ndarray, floors: list[int | None], k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the k best (score, id) of other ids with a score of at least its floor (None: any)."""
        big = int(np.abs(self.points).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, self.points.shape[1])
        exact = big < SAFE
        kind = np.float64 if exact else object
        points, lo, hi, queries = (x.astype(kind) for x in (self.points, self.lo, self.hi, queries))
        bounds = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
        if not exact:
            bounds = np.clip(bounds, -(2**63), 2**63 - 1)
        for qid, q, bound, floor in zip(qids.tolist(), queries, bounds, floors, strict=True):
            best: list[tuple[int, int]] = []
            kth = -math.inf if floor is None else floor
            heap = [(-bound[0], 0)]
            while heap:
                up, node = heapq.heappop(heap)
                if -up < kth:
                    break
                left, right = self.kids[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.spans[node]
                scores = points[a:b] @ q
                if not exact:
                    scores = np.clip(scores, -(2**63), 2**63 - 1)
                for i in np.flatnonzero(scores >= kth):
                    if self.ids[a + i] != qid:
                        best.append((-int(scores[i]), int(self.ids[a + i])))
                if len(best) > k:
                    best.sort()
                    del best[k:]
                if len(best) == k:
                    kth = max(kth, -max(best)[0])
            yield [(-s, i) for s, i in sorted(best)]


def _whole(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out = [], [], []
            for i, (vid, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if vid is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                y = np.floor(p.scale * x)
                if np.abs(y).max() >= 2**62:
                    y = np.clip(y, -(2**62), 2**62)
                keep.append(i)
                dims.append(len(x))
                out.append(y.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<i8") for x in column.to_pylist()])


def _plant(p: Params):
    def run(key, table):
        tree = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("v")), p.leaf)
        where = (key[0].as_py(), key[1].as_py())
        return pa.table({"dim": pa.array([where[0]], pa.int32()), "shard": pa.array([where[1]], pa.int64()), "tree": pa.array([pickle.dumps((where, tree), 5)], pa.binary())})

    return run


def runs_of(batch: pa.RecordBatch, blob: str) -> Iterator[tuple[bytes | None, pa.RecordBatch]]:
    """The rows of a batch between those that hold a blob, each run with the blob before it (None: one of an earlier batch)."""
    held = batch.column(blob)
    marks = [] if held.null_count == len(held) else np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)).tolist()
    for mark, to in zip([-1, *marks], [*marks, batch.num_rows], strict=True):
        yield (held[mark].as_py() if mark >= 0 else None), batch.slice(mark + 1, to - mark - 1)


def _search(p: Params):
    """Over rows ordered by shard, its tree first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, where = None, None
        for batch in batches:
            for blob, rows in runs_of(batch, "tree"):
                if blob is not None:
                    where, tree = pickle.loads(blob)
                if not rows.num_rows or tree is None:
                    continue
                mine = (rows.column("dim").to_numpy() == where[0]) & (rows.column("shard").to_numpy() == where[1])
                rows = rows.filter(pa.array(mine))
                if not rows.num_rows:
                    continue
                ids = rows.column("query_id").to_numpy()
                found = tree.search(ids, _matrix(rows.column("v")), rows.column("floor").to_pylist(), p.k)
                flat = [(qid, vid, score) for qid, best in zip(ids.tolist(), found, strict=True) for score, vid in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries, p: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the Column ``queries`` is true, the k best other rows.

    Vectors that are null, empty or hold null or non-finite components, and those without an id, take no part. Vectors of
    different lengths don't meet. All rows with the query's id are its own. Of rows that repeat a query's id the least
    vector asks. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kdtree")
    schema = "vec_id long, dim int, v binary"
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.coalesce(queries, F.lit(False)).alias("asks"))
    points = scratch.save(slim.select("vec_id", "e").mapInArrow(_whole(p), schema))
    n = points.count()
    shards = max(1, -(-n // p.shard_rows))
    shard = F.pmod(F.xxhash64(F.lit(1), "vec_id", F.monotonically_increasing_id()), F.lit(shards))
    trees = scratch.save(points.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(_plant(p), "dim int, shard long, tree binary"))
    asking = slim.where("asks").select("vec_id", "e").mapInArrow(_whole(p), schema).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asking = scratch.save(asking.withColumn("home", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(shards))))
    q = asking.select(F.col("vec_id").alias("query_id"), "dim", "v", "home")
    columns = "dim int, shard long, tree binary, query_id long, v binary, floor long"
    names = [c.split()[0] for c in columns.split(", ")]

    def search(rows: DataFrame) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        both = trees.select("dim", "shard", "tree", none("long").alias("query_id"), none("binary").alias("v"), none("long").alias("floor"))
        both = both.unionByName(rows.withColumn("tree", none("binary")).select(*names)).repartition("dim", "shard")
        return both.sortWithinPartitions("dim", "shard", F.col("tree").isNull()).mapInArrow(_search(p), "query_id long, vec_id long, score long")

    first = scratch.save(search(q.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))))
    if shards == 1:
        found = first
    else:
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == p.k)
        others = q.join(floors.select("query_id", "floor"), "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        found = first.unionByName(search(others.where("shard <> home")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
