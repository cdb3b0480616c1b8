"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt by label and hash to shards; each shard builds a graph over pivots. A vector within ``ball`` of a pivot
it finds on its way in joins that pivot's ball instead of becoming a node, so that thousands of copies cost one node. Every
vector of the label queries every shard of it: the graph goes to one task once, as the first row of its shard's run of
rows, and the vectors stream past it in batches. The search returns all pivots whose balls could hold a link, widening its
beam until the farthest pivot it returns lies beyond reach, and links are verified as cosines in double precision by
blocked matrix products. Recall audits compare stored vectors, whose links are known to exist, and sampled queries of
each batch with brute force in the shard, and double the least beam until nothing is missed; where a beam of all nodes
still misses a link, the shard is scanned whole for that batch. Tasks return link counts and a spanning forest of their
links, never pairs; forests are united by large-star and small-star.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.components import connected_components
from bytestrata.llm.kdtree import runs_of
from bytestrata.llm.scratch import Scratch, bounded_broadcast_rows

BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Params:
    threshold: float = 0.93
    shard_rows: int = 4096
    links: int = 12
    build_beam: int = 40
    beam: int = 32
    audit: int = 64
    recall: float = 1.0
    seed: int = 3

    @property
    def reach(self) -> float:
        return math.acos(self.threshold)

    @property
    def ball(self) -> float:
        return self.reach / 2


class Graph:
    """Nodes are pivots (rows of ``x``); members[i] are the vectors of node i's ball, itself first."""

    def __init__(self, x: np.ndarray, p: Params):
        self.p, n = p, len(x)
        self.unit = x.astype(np.float32)
        gen = np.random.Generator(np.random.PCG64(p.seed))
        level = np.minimum((-np.log(1 - gen.random(n)) / math.log(p.links)).astype(int), 12)
        self.near = [np.full((n, 2 * p.links), -1, np.int32)]
        self.count = [np.zeros(n, np.int32)]
        self.stamp, self.mark = np.zeros(n, np.int64), 0
        self.entry, self.top = -1, -1
        self.members: dict[int, list[int]] = {}
        close = math.cos(p.ball)
        for i in range(n):
            self._insert(i, int(level[i]), close)

    def _layer(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.near) <= level:
            self.near.append(np.full((len(self.unit), self.p.links), -1, np.int32))
            self.count.append(np.zeros(len(self.unit), np.int32))
        return self.near[level], self.count[level]

    def _climb(self, q: np.ndarray, down_to: int) -> int:
        at = self.entry
        best = float(self.unit[at] @ q)
        for level in range(self.top, down_to, -1):
            near, count = self.near[level], self.count[level]
            while True:
                nb = near[at, : count[at]]
                if not len(nb):
                    break
                s = self.unit[nb] @ q
                j = int(s.argmax())
                if s[j] <= best:
                    break
                at, best = int(nb[j]), float(s[j])
        return at

    def beam(self, q: np.ndarray, start: int, width: int, level: int) -> list[tuple[float, int]]:
        """The best ``width`` nodes found, best first."""
        self.mark += 1
        stamp, mark, unit = self.stamp, self.mark, self.unit
        near, count = self.near[level], self.count[level]
        stamp[start] = mark
        s0 = float(unit[start] @ q)
        todo, kept = [(-s0, start)], [(s0, start)]
        while todo:
            s, c = heapq.heappop(todo)
            if len(kept) >= width and -s < kept[0][0]:
                break
            nb = near[c, : count[c]]
            nb = nb[stamp[nb] != mark]
            if not len(nb):
                continue
            stamp[nb] = mark
            scores = unit[nb] @ q
            if len(kept) >= width:
                good = scores > kept[0][0]
                nb, scores = nb[good], scores[good]
            for t, v in zip(scores.tolist(), nb.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (t, v))
                    heapq.heappush(todo, (-t, v))
                elif t > kept[0][0]:
                    heapq.heapreplace(kept, (t, v))
                    heapq.heappush(todo, (-t, v))
        return sorted(kept, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the new node than to each other; then the nearest of the rest."""
        ids = [v for _, v in found]
        if len(ids) <= most:
            return ids
        between = self.unit[ids] @ self.unit[ids].T
        chosen: list[int] = []
        for j, (s, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or s >= between[j, chosen].max():
                chosen.append(j)
        taken = set(chosen)
        chosen += [j for j in range(len(ids)) if j not in taken][: most - len(chosen)]
        return [ids[j] for j in chosen]

    def _link(self, a: int, b: int, level: int) -> None:
        near, count = self._layer(level)
        most = near.shape[1]
        if count[a] < most:
            near[a, count[a]] = b
            count[a] += 1
            return
        ids = [*near[a].tolist(), b]
        s = self.unit[ids] @ self.unit[a]
        keep = self._choose(sorted(zip(s.tolist(), ids, strict=True), reverse=True), most)
        near[a, : len(keep)] = keep
        count[a] = len(keep)

    def _insert(self, i: int, level: int, close: float) -> None:
        q = self.unit[i]
        if self.entry < 0:
            self._layer(level)
            self.entry, self.top = i, level
            self.members[i] = [i]
            return
        at = self._climb(q, min(level, self.top))
        plans = []
        for lv in range(min(level, self.top), -1, -1):
            found = self.beam(q, at, self.p.build_beam, lv)
            at = found[0][1]
            plans.append((lv, found))
        if plans[-1][1][0][0] >= close:
            self.members[at].append(i)
            return
        self.members[i] = [i]
        for lv, found in plans:
            near, _ = self._layer(lv)
            for v in self._choose(found, self.p.links):
                self._link(i, v, lv)
                self._link(v, i, lv)
        if level > self.top:
            self._layer(level)
            self.entry, self.top = i, level

    def reachable(self, q: np.ndarray, width: int, least: float) -> list[int]:
        """Pivots with a cosine of at least ``least`` to q, by beams widened until the worst one lies below."""
        q = q.astype(np.float32)
        start = self._climb(q, 0)
        while True:
            found = self.beam(q, start, width, 0)
            if len(found) < width or found[-1][0] < least or width >= len(self.members):
                return [v for s, v in found if s >= least]
            width *= 4


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        up.setdefault(a, a)
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Shard:
    """A graph and what it is searched with: its vectors, their ids and rows, and the least beam that its audits ask for."""

    def __init__(self, graph: Graph, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, p: Params):
        self.graph, self.x, self.ids, self.p = graph, x, ids, p
        self.order = np.argsort(rows, kind="stable")
        self.rows = rows[self.order]
        self.member = {v: np.array(m) for v, m in graph.members.items()}
        self.least = math.cos(min(math.pi, p.reach + p.ball + 1e-3))
        self.width, self.whole = p.beam, False
        self.gen = np.random.Generator(np.random.PCG64(p.seed))
        self.hits = self.total = 0
        self.audit(x)

    def pivots(self, q: np.ndarray) -> list[int]:
        return list(self.member) if self.whole else self.graph.reachable(q, self.width, self.least)

    def audit(self, q: np.ndarray) -> None:
        """Widens the beam until sampled queries find all the links that brute force finds."""
        probe = np.sort(self.gen.choice(len(q), min(self.p.audit, len(q)), replace=False))
        truth = q[probe] @ self.x.T >= self.p.threshold
        probe, truth = probe[truth.any(1)], truth[truth.any(1)]
        while True:
            hits = 0
            for row, i in zip(truth, probe.tolist(), strict=True):
                inside = np.zeros(len(self.x), bool)
                for v in self.pivots(q[i]):
                    inside[self.member[v]] = True
                hits += int((row & inside).sum())
            total = int(truth.sum())
            if hits >= self.p.recall * total:
                self.hits, self.total = self.hits + hits, self.total + total
                return
            if self.width < len(self.member):
                self.width *= 2
            else:
                self.whole = True

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The places in x of these rows of the table, -1 for those of other shards."""
        at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        return np.where(self.rows[at] == rows, self.order[at], -1)

    def links(self, q: np.ndarray, qids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, Forest]:
        """How many of the shard's vectors, itself aside, each query links with, and a forest of the links."""
        counts, forest, own = np.zeros(len(q), np.int64), Forest(), self.places(rows)
        self.audit(q)
        # Queries whose search ends at the same pivots share a matrix product.
        groups: dict[tuple[int, ...], list[int]] = {}
        for i in range(len(q)):
            groups.setdefault(tuple(sorted(self.pivots(q[i]))), []).append(i)
        for pivots, asking in groups.items():
            if pivots:
                self._verify(np.array(asking), np.concatenate([self.member[v] for v in pivots]), q, qids, own, counts, forest)
        return counts, forest

    def _verify(self, asking, candidates, q, qids, own, counts, forest) -> None:
        for a in range(0, len(asking), 512):
            part = asking[a : a + 512]
            for b in range(0, len(candidates), 8192):
                other = candidates[b : b + 8192]
                linked = q[part] @ self.x[other].T >= self.p.threshold
                linked &= own[part][:, None] != other[None, :]
                counts[part] += linked.sum(1)
                if not linked.any():
                    continue
                r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                for i, j in zip(part[r].tolist(), other[linked[r].argmax(1)].tolist(), strict=True):
                    forest.unite(int(qids[i]), int(self.ids[j]))
                for j, i in zip(other[c].tolist(), part[linked[:, c].argmax(0)].tolist(), strict=True):
                    forest.unite(int(qids[i]), int(self.ids[j]))
                # a query that links with columns of several trees joins them
                roots = np.array([forest.find(int(self.ids[j])) for j in other[c].tolist()])
                sub = linked[np.ix_(r, c)]
                for k, i in enumerate(part[r].tolist()):
                    for root in np.unique(roots[sub[k]]).tolist():
                        forest.unite(int(qids[i]), int(root))


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, out = [], []
        for i, (vid, v, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)):
            if vid is None or label is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append(i)
                out.append(unit_rows(x[None])[0].astype("<f8").tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([len(x) // 8 for x in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "v"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _grow(p: Params):
    def run(key, table):
        order = np.lexsort((table.column("row").to_numpy(), table.column("vec_id").to_numpy()))
        x, ids, rows = _matrix(table.column("v"))[order], table.column("vec_id").to_numpy()[order], table.column("row").to_numpy()[order]
        where = tuple(k.as_py() for k in key)
        blob = pickle.dumps((where, Graph(x, p), x, ids, rows), 5)
        return pa.table({"label": pa.array([where[0]], pa.string()), "dim": pa.array([where[1]], pa.int32()), "shard": pa.array([where[2]], pa.int64()), "graph": pa.array([blob], pa.binary())})

    return run


ASKED = "vec_id long, n_links long, root long, hits long, total long"


def _ask(p: Params):
    """Over rows ordered by shard, its graph first. A row without vec_id has what the audits of a shard found."""

    def told(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in ASKED.split(", ")])

    def audits(shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is not None:
            yield told([[None], [None], [None], [shard.hits], [shard.total]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, where = None, None
        for batch in batches:
            for blob, rows in runs_of(batch, "graph"):
                if blob is not None:
                    yield from audits(shard)
                    where, *parts = pickle.loads(blob)
                    shard = Shard(*parts, p)
                    del parts
                if not rows.num_rows or shard is None:
                    continue
                mine = (rows.column("dim").to_numpy() == where[1]) & (rows.column("shard").to_numpy() == where[2])
                rows = rows.filter(pc.and_(pa.array(mine), pc.equal(rows.column("label"), where[0])))
                if not rows.num_rows:  # of a shard that holds no vector
                    continue
                qids = rows.column("vec_id").to_numpy()
                counts, forest = shard.links(_matrix(rows.column("v")), qids, rows.column("row").to_numpy())
                ids = qids.tolist()
                more = list(set(forest.up) - set(ids))
                none = [None] * (len(ids) + len(more))
                yield told([ids + more, counts.tolist() + [0] * len(more), [forest.find(v) for v in ids + more], none, none])
        yield from audits(shard)

    return run


def near_duplicates(vectors: DataFrame, p: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors; then audit_hits and audit_links, alike in all rows:
    how many links the recall audits found in all, and how many there were.

    Only vectors of equal, non-null labels are compared, and of equal length. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing. Rows that repeat an id link with each other if their vectors do
    and share one component; n_links is then their sum. A null id links with nothing, its component is null, it is kept.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hnsw")
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.col(label).cast("string").alias("label"))
    points = slim.mapInArrow(_able, "vec_id long, label string, dim int, v binary")
    points = scratch.save(points.withColumn("row", F.monotonically_increasing_id()))
    sizes = scratch.save(points.groupBy("label", "dim").agg(F.ceil(F.count("*") / p.shard_rows).cast("long").alias("shards")))
    dealt = points.join(F.broadcast(sizes) if bounded_broadcast_rows(sizes, BROADCAST_LABELS) else sizes, ["label", "dim"])
    home = F.pmod(F.xxhash64("vec_id", "row"), "shards")
    graphs = scratch.save(dealt.withColumn("shard", home).groupBy("label", "dim", "shard").applyInArrow(_grow(p), "label string, dim int, shard long, graph binary"))
    none = lambda kind: F.lit(None).cast(kind)
    asking = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select("label", "dim", "shard", none("binary").alias("graph"), "vec_id", "row", "v")
    both = graphs.select("label", "dim", "shard", "graph", none("long").alias("vec_id"), none("long").alias("row"), none("binary").alias("v")).unionByName(asking)
    both = both.repartition("label", "dim", "shard").sortWithinPartitions("label", "dim", "shard", F.col("graph").isNull())
    found = scratch.save(both.mapInArrow(_ask(p), ASKED))
    hits, total = found.where("vec_id is null").agg(F.sum("hits"), F.sum("total")).first()
    if (hits or 0) < p.recall * (total or 0):
        raise RuntimeError(f"recall audits found {hits} of {total} links")
    found = found.where("vec_id is not null")
    links = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    own = links.join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = slim.select("vec_id").join(own, "vec_id", "left")
    low = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    audit = [F.lit(hits or 0).cast("long").alias("audit_hits"), F.lit(total or 0).cast("long").alias("audit_links")]
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), low.alias("component_id"), F.col("vec_id").eqNullSafe(low).alias("kept"), *audit)
