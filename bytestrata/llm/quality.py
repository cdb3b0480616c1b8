"""Quality by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs; runs of letters and digits, and runs of other
signs, are tokens; letter case counts): one of the target texts, one of all texts. A document's log weight is the log
ratio of its probability under the two. Documents are drawn without replacement in proportion to their weights: the k
largest sums of log weight and Gumbel noise, which a hash of the document's id and the seed gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch
from bytestrata.llm.select import first_k
from bytestrata.llm.textkit import U64, mix, slices, words

KINDS = np.full(256, 2, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1


@dataclass(frozen=True)
class Params:
    """keep: share of rows to draw; None: the share of target rows among the labelled ones. smoothing: pseudo-counts."""

    buckets_log2: int = 18
    smoothing: float = 2.0
    keep: float | None = None
    seed: int = 11


def grams(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each text's tokens, then pairs, in the order of the texts; the tokens' bounds.

    A pair belongs to the text of its first token; a text's last token has none and gets the bucket of the token alone.
    """
    w = words(column, fold=False, kinds=KINDS)
    h = w.hashes
    two = h.copy()
    two[:-1] = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])
    last = w.first[1:][w.first[1:] > w.first[:-1]] - 1
    two[last] = h[last]
    shift = U64(64 - p.buckets_log2)
    return np.stack((h >> shift, two >> shift)).astype(np.int32), w.first


def _counter(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << p.buckets_log2), np.int64)
        for batch in slices(batches, "text"):
            g, first = grams(batch.column(0), p)
            good = np.repeat(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), np.diff(first))
            for row in g:
                total[0] += np.bincount(row, minlength=total.shape[1])
                total[1] += np.bincount(row[good], minlength=total.shape[1])
        step = 1 << 12
        for at in range(0, total.shape[1], step):
            part = total[:, at : at + step].astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([at // step], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    return run


def _adder(key, table):
    total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _scorer(ratios, p: Params, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratios.value
        for batch in slices(batches, "text"):
            g, first = grams(batch.column("text"), p)
            sums = np.concatenate(([0.0], np.cumsum(ratio[g[0]] + ratio[g[1]], dtype=np.float64)))
            weight = sums[first[1:]] - sums[first[:-1]]
            u = (batch.column("noise").to_numpy().view(np.uint64) >> U64(11)).astype(np.float64)
            drawn = weight - np.log(-np.log((u + 0.5) / 2.0**53))
            bits = (-drawn + 0.0).view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(weight), pa.array(order)], [*keys, "log_weight", "draw_order"])

    return run


def resample(docs: DataFrame, target: Column, labelled: Column, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """docs' columns other than text (with carry, text too, null as empty), with log_weight and selected.

    target: true for rows of the target model (null: no). labelled: true for rows that say whether they are of it; they
    give the share to keep where p.keep is None. All rows give the raw model. Null, empty and token-less texts have
    weight 0. Equal draws are settled by the smaller id, null ids last; rows equal in both stay or go together.
    Without target rows every weight is 0 and the draw is uniform.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    own = [c for c in docs.columns if c not in (text, "log_weight", "selected")]
    slim = docs.select(
        *(F.col(c).alias(f"_{i}") for i, c in enumerate(own)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(target, F.lit(False)).alias("target"), F.coalesce(labelled, F.lit(False)).alias("labelled"), F.xxhash64(F.lit(p.seed), F.col(doc_id)).alias("noise"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("tie"),
    )
    counted = slim.select("text", "target").mapInArrow(_counter(p), "part int, counts binary").groupBy("part").applyInArrow(_adder, "part int, counts binary")
    parts = sorted((r.part, bytes(r.counts)) for r in counted.collect())
    size = 1 << p.buckets_log2
    total = np.concatenate([np.frombuffer(c, "<i8").reshape(2, -1) for _, c in parts], axis=1) if parts else np.zeros((2, size), np.int64)
    raw, good = total.astype(float)
    expected = raw / max(1.0, raw.sum()) * good.sum()
    ratio = np.log((good + p.smoothing) / (expected + p.smoothing)).astype(np.float32)
    ratios = spark.sparkContext.broadcast(ratio)
    keys = [f"_{i}" for i in range(len(own))] + ["tie"] + ["text"] * carry
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keys) + ", log_weight double, draw_order long"
    scored = scratch.save(slim.select(*(k for k in keys if k != "text"), "noise", "text").mapInArrow(_scorer(ratios, p, keys), schema))
    n = scored.count()
    keep = p.keep
    if keep is None:
        marks = slim.agg(F.count_if("labelled").alias("n"), F.count_if(F.col("labelled") & F.col("target")).alias("good")).first()
        keep = marks.good / marks.n if marks.n else 1.0
    chosen = first_k(scored, "draw_order", "tie", int(np.ceil(keep * n)))
    return scored.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(own)), *([F.col("text").alias(text)] * carry), "log_weight", chosen.alias("selected"))
