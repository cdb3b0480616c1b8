"""Language of code-switched text by a linear-chain conditional random field over words.

A word's features, all hashed into one weight table: its whole form (for words of the lexicon, those seen often in
training), prefixes and suffixes of 1 to 4 bytes, byte pairs and triples within its edges. Transitions between languages
are learned too. Training texts carry one language each, so sequences that switch are spliced from pieces of texts of
different languages. Forward-backward gives each word's posterior; a text's language is the one with the largest mean
posterior over its words, which is also the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch
from bytestrata.llm.textkit import U64, mix, slices, span_hashes, words

BUCKETS = 18
AFFIX = 4
MOST_LANGUAGES = 1 << 15


@dataclass(frozen=True)
class Params:
    """The fit takes of each language the ``per_language`` distinct texts with the smallest hashes, fewer if all languages
    together had more than ``fit_rows``, one at least: those of at most ``row_bytes`` bytes first and, if they are too few,
    the first ``row_bytes`` characters of longer ones. Every language is learned. The weight table has at most ``cells``
    entries: with more than 64 languages, fewer buckets. Everything else sees all rows whole."""

    per_language: int = 120
    fit_rows: int = 4_000
    row_bytes: int = 8_000
    cells: int = 1 << 24
    chunk: int = 1 << 23
    lexicon_min: int = 3
    length: int = 64
    epochs: int = 25
    rate: float = 0.25
    seed: int = 5


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bits: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of words, one after another, and each word's bounds. A word's first feature is its form."""
    n, length = len(starts), ends - starts
    held, owner = [(hashes >> U64(64 - bits)).astype(np.int64)], [np.arange(n)]
    for k in range(1, AFFIX + 1):
        long = np.flatnonzero(length >= k)
        for side, at in ((0, starts[long]), (1, ends[long] - k)):
            code = np.full(len(long), U64(2 * k + side + 100), np.uint64)
            for j in range(k):
                code = code * U64(257) + data[at + j]
            held.append((mix(code) >> U64(64 - bits)).astype(np.int64))
            owner.append(long)
    for k in (2, 3):
        count = np.maximum(length - k + 1, 0)
        who = np.repeat(np.arange(n), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[who]
        code = np.full(len(who), U64(k), np.uint64)
        for j in range(k):
            code = code * U64(257) + data[at + j]
        held.append((mix(code) >> U64(64 - bits)).astype(np.int64))
        owner.append(who)
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return np.concatenate(held)[order], np.searchsorted(who[order], np.arange(n + 1))


class Model:
    """Weights [buckets, K], lexicon membership by form bucket, log transitions [K, K], languages."""

    def __init__(self, languages: list[str], cells: int = 1 << 24):
        self.languages = languages
        k = len(languages)
        self.bits = BUCKETS
        while self.bits > 8 and k << self.bits > cells:
            self.bits -= 1
        self.weights = np.zeros((1 << self.bits, k), np.float32)
        self.lexicon = np.zeros(1 << self.bits, bool)
        self.transitions = np.zeros((k, k))

    def emissions(self, w, unique_first: np.ndarray) -> np.ndarray:
        f, bounds = word_features(w.data, w.starts[unique_first], w.ends[unique_first], w.hashes[unique_first], self.bits)
        scores = self.weights[f]
        form = bounds[:-1]
        scores[form] *= self.lexicon[f[form]][:, None]
        return np.add.reduceat(scores, form, axis=0) / np.sqrt(np.diff(bounds))[:, None]


def time_major(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of texts, longest text first, when all first words come first, then all second words, ...

    Returns the place of each word, the number of texts active at each step, and the texts' order.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    ranked = length[order]
    steps = int(ranked[0]) if len(ranked) else 0
    active = len(ranked) - np.searchsorted(ranked[::-1], np.arange(steps), "right")
    begin = np.concatenate(([0], np.cumsum(active)))
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length))
    who = np.repeat(np.arange(len(length)), length)
    t = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], length)
    return begin[t] + rank[who], active, order


def forward_backward(e: np.ndarray, active: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of time-major emission potentials, the scaled forward vectors and the backward ones."""
    begin = np.concatenate(([0], np.cumsum(active)))
    a, b = np.empty_like(e), np.ones_like(e)
    move = move.astype(e.dtype)
    last = None
    for t in range(len(active)):
        cur = e[begin[t] : begin[t + 1]]
        x = cur if last is None else (last[: active[t]] @ move) * cur
        last = x / x.sum(1, keepdims=True)
        a[begin[t] : begin[t + 1]] = last
    back = move.T.copy()
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        s = slice(begin[t + 1], begin[t + 2])
        x = (e[s] * b[s]) @ back
        b[begin[t] : begin[t] + n] = x / x.sum(1, keepdims=True)
    post = a * b
    post /= post.sum(1, keepdims=True)
    return post, a, b


def posteriors(e: np.ndarray, active: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The posteriors of forward_backward() alone: beside e it holds one array of e's size and the last backward step."""
    begin = np.concatenate(([0], np.cumsum(active)))
    out, last = np.empty_like(e), None
    for t in range(len(active)):
        cur = e[begin[t] : begin[t + 1]]
        x = cur if last is None else (last[: active[t]] @ move) * cur
        last = x / x.sum(1, keepdims=True)
        out[begin[t] : begin[t + 1]] = last
    back = move.T.copy()
    b = np.ones((active[-1], e.shape[1])) if len(active) else e
    for t in range(len(active) - 2, -1, -1):
        x = (e[begin[t + 1] : begin[t + 2]] * b) @ back
        b = np.ones((active[t], e.shape[1]))
        b[: active[t + 1]] = x / x.sum(1, keepdims=True)
        out[begin[t] : begin[t + 1]] *= b
    out /= out.sum(1, keepdims=True)
    return out


def potentials(e: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0)).astype(np.float64)


def train(texts: list[str], labels: list[str], p: Params = Params()) -> Model:
    """Maximum conditional likelihood by AdaGrad over spliced sequences of p.length words."""
    languages = sorted(set(labels))
    model = Model(languages, p.cells)
    k = len(languages)
    if k < 2:
        return model
    w = words(pa.array(texts, pa.string()))
    _, unique_first, inverse, count = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    code = {x: i for i, x in enumerate(languages)}
    label = np.array([code[x] for x in labels])[doc]
    gen = np.random.Generator(np.random.PCG64(p.seed))
    pieces, at = [], 0
    while at < len(label):
        to = min(at + int(gen.integers(4, p.length)), int(w.first[doc[at] + 1]))
        pieces.append((at, to))
        at = to
    order = np.concatenate([np.arange(*pieces[i]) for i in gen.permutation(len(pieces))])
    rows = len(order) // p.length
    if not rows:
        rows, order = 1, np.resize(order, p.length)
    grid = order[: rows * p.length].reshape(rows, p.length).T  # time-major
    n = rows * p.length
    f, bounds = word_features(w.data, w.starts[unique_first], w.ends[unique_first], w.hashes[unique_first], model.bits)
    form = bounds[:-1]
    model.lexicon[f[form][count >= p.lexicon_min]] = True
    live = np.ones(len(f), np.float32)
    live[form] = model.lexicon[f[form]]
    owner = np.repeat(np.arange(len(form)), np.diff(bounds))
    scale = 1 / np.sqrt(np.diff(bounds))
    wide = max(1, p.chunk // (p.length * k))
    sum_w, sum_t = np.full(model.weights.shape, 1e-8, np.float32 if k > 64 else np.float64), np.full((k, k), 1e-8)
    for _ in range(p.epochs):
        e = np.stack([np.add.reduceat(model.weights[f, j] * live, form) * scale for j in range(k)], axis=1)
        move = np.exp(model.transitions)
        grad_w, grad_t = np.zeros((len(form), k)), np.zeros((k, k))
        for at in range(0, rows, wide):  # sequences of at most ``chunk`` entries of each table at once
            seq = grid[:, at : at + wide].reshape(-1)
            many = len(seq) // p.length
            token, gold = inverse[seq], label[seq]
            pot = potentials(e[token])
            post, a, b = forward_backward(pot, np.full(p.length, many), move)
            if p.length > 1:
                ahead = pot[many:] * b[many:]
                mass = ((a[:-many] @ move) * ahead).sum(1)
                grad_t += np.bincount(gold[:-many] * k + gold[many:], minlength=k * k).reshape(k, k) - move * (a[:-many].T @ (ahead / mass[:, None]))
            post[np.arange(len(seq)), gold] -= 1
            for j in range(k):
                grad_w[:, j] -= np.bincount(token, post[:, j], len(form))
        for j in range(k):
            g = grad_w[:, j] * scale
            g = np.bincount(f, g[owner] * live, 1 << model.bits) / n - 1e-7 * model.weights[:, j]
            sum_w[:, j] += g * g
            model.weights[:, j] += (p.rate * 4 * g / np.sqrt(sum_w[:, j])).astype(np.float32)
        grad_t /= n
        sum_t += grad_t**2
        model.transitions += p.rate * grad_t / np.sqrt(sum_t)
    return model


def text_means(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the mean posterior of each language over the words of each text that has some.
    What it holds on the way is free again when it returns."""
    w = words(texts)
    n = np.diff(w.first)
    if not len(w.hashes) or not m.languages:
        return n, np.zeros((0, len(m.languages)))
    _, unique_first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    pot = potentials(m.emissions(w, unique_first))
    begins = w.first[:-1][n > 0]
    place, active, _ = time_major(w.first)
    del w, unique_first
    e = np.empty((len(inverse), len(m.languages)))
    e[place] = pot[inverse]
    del pot, inverse
    post = posteriors(e, active, np.exp(m.transitions))
    del e
    return n, np.add.reduceat(post[place], begins, axis=0) / n[n > 0][:, None]


RUN_BYTES = 2 << 20


def predictor(model, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, "und"], object)
        k = len(m.languages)
        for batch in slices(batches, "text", RUN_BYTES * 4 // max(4, k)):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            n, means = text_means(m, batch.column("text"))
            best, score = np.full(len(n), k), np.zeros(len(n))
            if len(means):
                best[n > 0] = means.argmax(1)
                score[n > 0] = np.clip(means.max(1), 0, 1)
            best[~lettered], score[~lettered] = k, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(names[best], pa.string()), pa.array(score)], [*keys, "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame, learn: Column, p: Params = Params(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, lang) of the rows that fit() learns from, as Params says. Copies of a text within a language count once."""
    whole, span = F.col(text).cast("string"), 1 << 62
    long = F.octet_length(whole) > p.row_bytes
    able = docs.where(learn & F.col(lang).isNotNull() & (F.octet_length(whole) > 0))
    able = able.select(F.when(long, F.substring(whole, 1, p.row_bytes)).otherwise(whole).alias("text"), F.col(lang).cast("string").alias("lang"), long.alias("long"))
    able = able.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(span)))
    counts = (F.approx_count_distinct(F.when(F.col("long") == x, F.col("h"))).alias(c) for c, x in (("n_short", False), ("n_long", True)))
    sizes = Scratch(docs.sparkSession, "languages").save(able.groupBy("lang").agg(*counts))
    languages = sizes.count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} values of {lang}: no such column holds languages")
    most = max(1, min(p.per_language, p.fit_rows // max(1, languages)))

    # The counts are estimates, so twice the texts are let through; the smallest hashes of those are exact.
    def below(n: str) -> Column:
        return F.col("h") < F.ceil(F.least(F.lit(1.0), F.lit(2.0 * most) / F.greatest(F.lit(1), n)) * F.lit(float(span)))

    chosen = F.when(F.col("long"), (F.col("n_short") < 2 * most) & below("n_long")).otherwise(below("n_short"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text"))
    few = able.join(F.broadcast(sizes), "lang").where(chosen).select("text", "lang", "long", "h").distinct()
    return few.withColumn("rank", rank).where(F.col("rank") <= most).select("text", "lang")


def fit(docs: DataFrame, learn: Column, p: Params = Params(), text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows for which ``learn`` is true and lang is not null. Languages without a text are not learned."""
    rows = sorted((r.text, r.lang) for r in training_rows(docs, learn, p, text, lang).collect())
    return train([r[0] for r in rows], [r[1] for r in rows], p)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: bool = False) -> DataFrame:
    """docs' columns other than text (with carry, text too), and lang_pred and score.

    Null text, and text without a letter, is ``und`` with score 0, as is all text for a model without languages. Rows
    are independent: repeats and other columns, whatever their names, change nothing; columns named lang_pred and score are
    replaced. Of languages with equal scores the first by name is predicted.
    """
    own = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    keys = [f"_{i}" for i in range(len(own))] + ["text"] * carry
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keys)
    out = slim.mapInArrow(predictor(shared, keys), f"{schema}, lang_pred string, score double")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(own)), *([F.col("text").alias(text)] * carry), "lang_pred", "score")
