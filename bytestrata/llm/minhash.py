"""MinHash near-duplicates: universal hash minima, banding, verification on full shingle sets, star components.

1. One pass over the texts gives each document's shingle count, a 128-bit fingerprint of its shingle set and the keys
   of its bands (runs of minima). Documents with equal sets become one class before any pair is looked at.
2. Band buckets with the same members count once. In each the smallest class is the centre; every other class is verified
   against it on full sets. A bucket of m classes gives m - 1 pairs, so large groups of copies stay linear.
3. One aggregate tells which buckets still hold classes of different components. Those of up to BLOCK classes are compared
   whole in one task; larger ones get CENTRES more centres, each verified against what is not in its component yet, and
   what is open after that is compared by blocks against blocks. Such tasks return a spanning forest of their links.
4. Components by alternating large-star and small-star.

The band count is chosen so that a pair at the threshold misses every band with probability under 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.components import stars
from bytestrata.llm.scratch import Scratch, bounded, fresh
from bytestrata.llm.textkit import U64, mix, runs_reduce, shingle_sets, slices, words

BLOCK = 128
CENTRES = 3
BROADCAST_ROWS = 500_000
CACHE_RUN = 1 << 15


@dataclass(frozen=True)
class Params:
    """Link when den * |intersection| >= num * |union| over shingles of ``shingle`` words."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    miss: float = 1e-6
    seed: int = 7

    def banding(self) -> tuple[int, int]:
        """(bands, rows per band) with the fewest minima whose miss probability at the threshold is below ``miss``."""
        s = self.num / self.den
        rows = 5 if s >= 0.83 else 4 if s >= 0.7 else 3
        if s >= 1:
            return 1, 5
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-(s**rows)))), rows


def minima(sets: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n universal-hash minima of each run, as uint32[runs, n]: min over x of (a * x + b) mod 2**64 >> 32."""
    gen = np.random.Generator(np.random.PCG64(seed))
    a = gen.integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)
    b = gen.integers(0, 2**63, n, dtype=np.uint64)
    out = np.full((len(bounds) - 1, n), 2**32 - 1, np.uint32)
    at, last = 0, len(bounds) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CACHE_RUN, "right")) - 1)
        x, local = sets[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        buf = np.empty_like(x)
        full = local[1:] > local[:-1]
        if full.any():
            heads = local[:-1][full]
            block = np.full((to - at, n), 2**32 - 1, np.uint32)
            for i in range(n):
                np.multiply(x, a[i], out=buf)
                np.add(buf, b[i], out=buf)
                block[full, i] = np.minimum.reduceat(buf, heads) >> U64(32)
            out[at:to] = block
        at = to
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), np.uint64)
    for j in range(bands):
        k = np.full(len(sig), U64(j + 1), np.uint64)
        for r in range(rows):
            k = mix(k * U64(0x9E3779B97F4A7C15) + sig[:, j * rows + r])
        keys[:, j] = k
    return keys.view(np.int64)


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def fingerprint(sets: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    return runs_reduce(np.add, mix(sets ^ U64(k)), bounds, 0).view(np.int64)


def signer(p: Params):
    bands, rows = p.banding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(words(batch.column(1)), p.shingle)
            keys = band_keys(minima(sets, bounds, bands * rows, p.seed), bands, rows)
            n = np.diff(bounds)
            one, two = (fingerprint(sets, bounds, k) for k in (0xA5A5, 0x5A5A5A))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(one), pa.array(two), _list(keys.reshape(-1), np.arange(len(n) + 1) * bands)],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )

    return run


def set_maker(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(words(batch.column(1)), p.shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint(sets, bounds, 0xA5A5)), _list(sets.view(np.int64), bounds)], ["id", "fp", "shingles"])

    return run


def block_linker(p: Params):
    """Links between the rows of two blocks of one bucket that lie in different components, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        comp = table.column("comp").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
        sizes = np.diff(bounds)
        uniq, col = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        shared = np.bincount(col) > 1
        rank = np.cumsum(shared) - 1
        keep = shared[col]
        col, row = rank[col[keep]], row[keep]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        width = int(shared.sum())
        for lo in range(0, width, 8192):
            a, b = np.searchsorted(col, [lo, lo + 8192])
            m = np.zeros((len(ids), min(8192, width - lo)), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            common += m @ m.T
        common = np.rint(common).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        linked = (p.den * common >= p.num * union) & (union > 0) & (comp[:, None] != comp[None, :])
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        us, vs = [], []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                us.append(ids[i])
                vs.append(ids[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(u, v) of the pairs(u, fu, v, fv) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("fp").alias("fu"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("fp").alias("fv"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(b, ["v", "fv"]).join(a, ["u", "fu"]).where(p.den * both >= p.num * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _near_size(p: Params, a: str, b: str):
    """A pair beyond this ratio of set sizes can't be linked."""
    return p.den * F.least(a, b) >= p.num * F.greatest(a, b)


def _edges(comps: DataFrame) -> DataFrame:
    """The edges of stars; a node that has none is its own component."""
    return comps.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _open(members: DataFrame, comps: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The members, with their component, of buckets whose members lie in more than one; how many of up to BLOCK and more."""
    inside = members.join(bounded(comps, BROADCAST_ROWS).withColumnRenamed("node", "id"), "id", "left")
    inside = scratch.save(inside.select("key", "id", "fp", "n", F.coalesce("component", "id").alias("comp")))
    lots = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
    lots = scratch.save(lots.where("lo <> hi").select("key", "m"))
    small, large = lots.agg(F.count_if(F.col("m") <= BLOCK), F.count_if(F.col("m") > BLOCK)).first()
    return inside.join(bounded(lots, BROADCAST_ROWS), "key"), small, large


def _further_centres(inside: DataFrame, sets: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Links of large open buckets with CENTRES more of their members."""
    large = inside.where(F.col("m") > BLOCK)
    picks = [F.min_by(F.struct("id", "fp", "n", "comp"), F.xxhash64(F.lit(k), "id", "fp")).alias(f"c{k}") for k in range(CENTRES)]
    lots = scratch.save(large.groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*(f"c{k}" for k in range(CENTRES))))).alias("c")))
    pairs = large.join(bounded(lots, BROADCAST_ROWS), "key").where("comp <> c.comp").where(_near_size(p, "n", "c.n"))
    pairs = pairs.select(F.col("c.id").alias("u"), F.col("c.fp").alias("fu"), F.col("id").alias("v"), F.col("fp").alias("fv"))
    return _verified(pairs.distinct(), sets, p)


def _compared(inside: DataFrame, sets: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """A saved table of links between the members of open buckets that lie in different components, as forests: exact. A
    large bucket's largest component is not compared with itself: its blocks meet the blocks of the others only."""
    tops = inside.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    tops = tops.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("nb"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("nx"))
    tops = scratch.save(tops)
    rows = inside.join(bounded(tops, BROADCAST_ROWS), "key").withColumn("x", F.col("comp") != F.col("top"))
    rows = rows.withColumn("b", F.when(F.col("x"), F.pmod(F.xxhash64("id", "fp"), "nx")).otherwise(-1 - F.pmod(F.xxhash64("id", "fp"), "nb")))
    meets = F.when(F.col("m") <= BLOCK, F.array(F.lit(0).cast("long"))).when(F.col("x"), F.sequence(-F.col("nb"), F.col("nx") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))
    rows = rows.withColumn("b", F.when(F.col("m") <= BLOCK, 0).otherwise(F.col("b"))).withColumn("o", F.explode(meets))
    rows = rows.select("key", "id", "fp", "comp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return scratch.save(rows.join(sets, ["id", "fp"]).groupBy("key", "i", "j").applyInArrow(block_linker(p), "u long, v long"))


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs.

    Null, empty and white-space texts have no shingles and link with nothing. Rows that repeat a doc_id are one node
    whose links are those of all its rows. A null doc_id links with nothing; its component_id is null and it is kept.
    Other columns of docs, whatever their names, are not read. Links are confirmed on the full sets of 64-bit shingle
    hashes: two different sets of a billion shingles in all differ in them but for a chance of one in 30.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = scratch.save(slim.mapInArrow(signer(p), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    able = signed.where("doc_id is not null and n_shingles > 0")
    fp = ["fp1", "fp2", "n_shingles"]
    classes = scratch.save(able.groupBy(*fp).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    differ = F.expr(" or ".join(f"min({c}) <> max({c})" for c in fp))
    again = able.groupBy("doc_id").agg(F.count("*").alias("n"), differ.alias("differ"))
    repeated, differing = again.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("differ"))).first()

    # Classes that share their smallest doc_id are one node; fp tells them apart where they are compared.
    rows = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), F.col("fp1").alias("fp"), F.col("n_shingles").alias("n"))
    who = F.sum(F.xxhash64("id", "fp").cast("decimal(38,0)")).alias("who")
    heads = rows.groupBy("key").agg(F.min(F.struct("id", "n", "fp")).alias("s"), F.count("*").alias("m"), who).where("m > 1")
    heads = heads.groupBy("m", "who", "s").agg(F.min("key").alias("key"))
    heads = scratch.save(heads.select("key", F.col("s.id").alias("u"), F.col("s.fp").alias("fu"), F.col("s.n").alias("nu")))
    members = scratch.save(rows.join(bounded(heads, BROADCAST_ROWS), "key").where("id <> u or fp <> fu"))
    tested = members.where("id <> u").where(_near_size(p, "n", "nu")).select("u", "fu", F.col("id").alias("v"), F.col("fp").alias("fv")).distinct()
    needed = scratch.save(heads.select(F.col("u").alias("doc_id")).unionByName(members.select(F.col("id").alias("doc_id"))).distinct())
    sets = slim.join(bounded(needed, BROADCAST_ROWS), "doc_id", "left_semi").mapInArrow(set_maker(p), "id long, fp long, shingles array<long>")
    sets = scratch.save(sets.dropDuplicates(["id", "fp"]) if repeated else sets)
    links = _verified(tested, sets, p)
    if differing:  # each doc_id that repeats with different sets, and the classes of its rows
        own = able.join(bounded(scratch.save(again.where("differ").select("doc_id")), BROADCAST_ROWS), "doc_id", "left_semi")
        own = own.join(classes, fp).where("doc_id <> rep")
        links = links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    comps = stars(links, scratch)

    # What lies in one bucket and still in different components, the pairs with its centre aside.
    members = members.select("key", "id", "fp", "n")
    inside, small, large = _open(members, comps, scratch)
    if large:
        comps = stars(_edges(comps).unionByName(_further_centres(inside, sets, p, scratch)), scratch)
        inside, small, large = _open(members, comps, scratch)
    if small or large:
        comps = stars(_edges(comps).unionByName(_compared(inside, sets, p, scratch)), scratch)

    group = scratch.save(classes.where("copies > 1").select(*fp, "rep"))
    scratch.drop(sets, inside, members)
    out = signed.select("doc_id", *fp).join(bounded(group, BROADCAST_ROWS), fp, "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = out.join(bounded(comps, BROADCAST_ROWS), "node", "left")
    low = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", low.alias("component_id"), F.col("doc_id").eqNullSafe(low).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; of rows that repeat a doc_id, all or none stay."""
    name = fresh(docs, "gone")
    gone = Scratch(docs.sparkSession, "kept").save(near_duplicates(docs, p).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bounded(gone, BROADCAST_ROWS), docs["doc_id"] == F.col(name), "left_anti")
