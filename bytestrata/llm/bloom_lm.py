"""Bigram language model in a log-frequency Bloom filter, dealt over segments that answer for themselves.

Runs: each task cuts its texts into runs of about ``task_tokens`` tokens and writes each, as words and the tokens' places
among them, to a file of the shared folder. Texts and tokens never move; what moves is sent once for each run.

Counting: a run sends its distinct bigrams, as packed hashes with the counts of its training texts, to segments dealt by
the top bits of their hashes, so that no frequent word or pair makes a hot key. A segment sums the counts and enters
(bigram, level) for every level up to 1 + floor(log2(count)) into its own part of the filter, at ``probes`` places; the
part's size follows its number of entries. It reads its part for every run that sent a bigram, and tells one of the runs
that know a trained bigram, the first by name, that the bigram is its own to account for.

Figures: a run so knows for each of its words u how many successors T(u) it accounts for and the sum S(u) of their
quantised counts. These and the counts of words go to segments dealt by the words' hashes, which return the sums.

Scoring: a bigram's count is read back by probing levels 1, 2, ... until one is missing; level l stands for 2**(l - 1),
which no true count is below. With add-one unigrams p1, in which all unknown words are one more word, the probability of
w after u is (count(u w) + (C(u) - S(u) + T(u)) * p1(w)) / (C(u) + T(u)): what quantising takes from the counts goes to the
backoff, so that the probabilities after each u add up to 1, but for the false positives of the filter. After an unknown
word it is p1(w). Nothing is tuned.

Bounds: a task holds one run or one segment; nothing is broadcast, and the driver gets two numbers. Executors open the
shared folder by URI. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch
from bytestrata.llm.textkit import U64, give_back, mix, slices, words

END = U64(0x1F0E3DAD99908345)
PAIR = U64(0xD6E8FEB86659FD93)
LEVELS = 40
FIGURES = ["n_tokens", "n_known", "base_score", "score"]
COUNT = np.concatenate(([0.0], 2.0 ** np.arange(LEVELS + 1)))


@dataclass(frozen=True)
class Params:
    """filter_mb, vocabulary_mb: bounds of broadcasts that are no longer made, whatever the values."""

    probes: int = 6
    segment_tokens: int = 1 << 20
    filter_mb: int = 160
    vocabulary_mb: int = 128
    task_tokens: int = 2_500_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text followed by one END; the bounds of each text's run."""
    w = words(column)
    n = len(w.first) - 1
    bounds = w.first + np.arange(n + 1)
    out = np.full(bounds[-1], END, np.uint64)
    spot = np.ones(len(out), bool)
    spot[bounds[1:] - 1] = False
    out[spot] = w.hashes
    return out, bounds


def histories(t: np.ndarray, bounds: np.ndarray, end) -> np.ndarray:
    before = np.empty_like(t)
    before[1:] = t[:-1]
    if len(t):
        before[bounds[:-1]] = end
    return before


def _pack(h: np.ndarray, c: np.ndarray, width: int, u: np.ndarray | None = None) -> tuple[bytes, bytes, bytes, bytes]:
    """Hashes seen once, other hashes, their counts, the histories of both. width: bytes kept of a hash, the lowest ones.
    Counts are those of one run, which holds fewer than 2**32 tokens."""
    cut = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    one = c == 1
    before = b"" if u is None else u[one].astype("<u8").tobytes() + u[~one].astype("<u8").tobytes()
    return cut(h[one]), cut(h[~one]), c[~one].astype("<u4").tobytes(), before


def _unpack(singles: list[bytes], manys: list[bytes], counts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their counts, where each is first met in singles, then manys, and each of these' place among them."""

    def grow(parts: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :width] = raw
        return out.view("<u8").reshape(-1).astype(np.uint64)

    a, b = grow(singles), grow(manys)
    c = np.concatenate((np.ones(len(a), np.int64), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)))
    h, order, heads, back = _grouped(np.concatenate((a, b)))
    return h, np.add.reduceat(c[order], heads) if len(h) else c, order[heads], back


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, x's stable order, each value's first place in it, and each element's place among the values."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return ordered[heads], order, heads, back


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the largest takes, which the first byte tells."""
    most = int(x.max()) if len(x) else 0
    k = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
    return bytes([k]) + x.astype(f"<u{k}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _cuts(seg: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, from, to) of the runs of equal values."""
    heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.zeros(0, np.int64)
    return list(zip(seg[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(seg)], strict=True))


def _write(root: str, name: str, parts: list[pa.RecordBatch]) -> None:
    """A file of the shared folder, there at once as a whole. A task that is repeated writes the same again."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    new = f"{base}/new-{uuid.uuid4().hex}"
    with store.open_output_stream(new) as f:
        for part in parts:
            with pa.ipc.new_stream(f, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
    store.move(new, f"{base}/{name}")


def _read(root: str, name: str) -> list[pa.Table]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    out = []
    with store.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        while f.tell() < size:
            out.append(pa.ipc.open_stream(f).read_all())
    return out


class Run:
    """words: distinct hashes, frequent ones first; ranks: each token's place among them; bounds of the texts' tokens; learn:
    which texts to learn from; keys: the texts' other columns."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray, bounds: np.ndarray, learn: np.ndarray, keys: pa.RecordBatch | pa.Table):
        self.words, self.ranks, self.bounds, self.learn, self.keys = words, ranks, bounds, learn, keys
        self.before = histories(ranks, bounds, np.flatnonzero(words == END)[0])

    @classmethod
    def of(cls, t: np.ndarray, bounds: np.ndarray, learn: np.ndarray, keys: pa.RecordBatch) -> Run:
        h, order, heads, back = _grouped(t)
        by = np.argsort(-np.diff(np.append(heads, len(t))), kind="stable")
        rank = np.empty(len(h), np.uint32)
        rank[by] = np.arange(len(h), dtype=np.uint32)
        return cls(h[by], rank[back], bounds, learn, keys)

    def save(self, root: str, name: str) -> None:
        planes = self.ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
        parts = [{"words": self.words}, {str(i): np.ascontiguousarray(planes[:, i]) for i in range(4)}, {"n": np.diff(self.bounds), "learn": self.learn}]
        _write(root, name, [*(pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in x.items()}) for x in parts), self.keys])

    @classmethod
    def load(cls, root: str, name: str) -> Run:
        words, planes, texts, keys = _read(root, name)
        ranks = np.stack([planes.column(i).to_numpy() for i in range(4)], 1).view("<u4").reshape(-1)
        bounds = np.concatenate(([0], np.cumsum(texts.column("n").to_numpy())))
        return cls(words.column("words").to_numpy(), ranks, bounds, texts.column("learn").to_numpy(), keys)

    def learned(self) -> np.ndarray:
        """Of each token, whether it is learned from."""
        return np.repeat(self.learn, np.diff(self.bounds))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams, their counts in the texts to learn from, one token of each, and each token's place among them."""
        h, order, heads, back = _grouped(mix((mix(self.words) * PAIR)[self.before] + self.words[self.ranks]))
        return h, np.add.reduceat(self.learned()[order].astype(np.int64), heads), order[heads], back


CELLS = "run string, segment int, singles binary, manys binary, counts binary"


def runs(bits: int, task_tokens: int, root: str, keys: list[str]):
    """Writes runs and sends their bigrams, a row per run and segment. A run's name is that of the same run of a repeated task."""

    def ended(k: int, t: list[np.ndarray], n: list[np.ndarray], rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId()}-{k}"
        whole = pa.Table.from_batches(rows).combine_chunks()
        learn = whole.column("train").to_numpy(zero_copy_only=False)
        own = whole.select(keys).to_batches()[0] if keys else pa.RecordBatch.from_pydict({"none": pa.nulls(len(learn), pa.int8())})
        run = Run.of(np.concatenate(t), np.concatenate(([0], np.cumsum(np.concatenate(n)))), learn, own)
        t.clear()
        run.save(root, name)
        h, c, _, _ = run.grams()
        del run
        cells = [(name, s, *_pack(h[a:b], c[a:b], 6)[:3]) for s, a, b in _cuts((h >> U64(64 - bits)).astype(np.int64))]
        for at in range(0, len(cells), 64):
            part = list(zip(*cells[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.int32()), *(pa.array(x, pa.binary()) for x in part[2:])], ["run", "segment", "singles", "manys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, t, n, rows = 0, 0, [], [], []
        for batch in slices(batches, "text"):
            found, bounds = tokens(batch.column("text"))
            t.append(found)
            n.append(np.diff(bounds))
            rows.append(batch.select([*keys, "train"]))
            held += len(found)
            if held >= task_tokens:
                yield from ended(k, t, n, rows)
                k, held, t, n, rows = k + 1, 0, [], [], []
        if held:
            yield from ended(k, t, n, rows)
        give_back()

    return run


def places(h: np.ndarray, level: int, size: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The bit places of (bigram, level) in a part of ``size`` bits. h: the lowest 48 bits of the hash."""
    x = mix(h * U64(2 * LEVELS + 1) + U64(level))
    step = (x >> U64(32)) | U64(1)
    for j in range(probes):
        yield ((x & U64(0xFFFFFFFF)) + U64(j) * step) % size


def filter_part(c: np.ndarray, h: np.ndarray, probes: int) -> tuple[np.ndarray, bytes]:
    """The levels of counts (0: none), and a segment's part of the filter."""
    level = np.frexp(c.astype(float))[1]
    size = max(64, math.ceil(int(level.sum()) * probes / math.log(2) / 64) * 64)
    part = np.zeros(size, bool)
    for i in range(1, int(level.max()) + 1):
        for at in places(h[level >= i], i, U64(size), probes):
            part[at] = True
    return level, np.packbits(part, bitorder="little").tobytes()


def builder(probes: int):
    """A segment's model as a row. Words (kind 0): hashes (a) and counts (b). Bigrams (kind 1): its part of the filter (a)."""

    def run(key, batches):
        kind = key[0].as_py()
        h, c, _, _ = _unpack(*(batches.column(n).to_pylist() for n in ("singles", "manys", "counts")), 6 if kind else 8)
        a, b = (filter_part(c, h, probes)[1], b"") if kind else (h.astype("<u8").tobytes(), c.astype("<u8").tobytes())
        return pa.table({"kind": pa.array([kind], pa.int32()), "segment": pa.array([key[1].as_py()], pa.int32()), "n": [len(h)], "total": [int(c.sum())], "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary())})

    return run


ANSWERS = "run string, segment int, levels binary, own binary"


def answering(probes: int):
    """A segment's counts become its part of the filter, and each run's bigrams, in the order they came in, get the levels that
    it gives back: a byte each, the highest bit of those the run accounts for, whose true levels follow."""

    def run(key, cells):
        cells = cells.sort_by("run")
        singles, manys, counts = (cells.column(n).to_pylist() for n in ("singles", "manys", "counts"))
        h, c, first, back = _unpack(singles, manys, counts, 6)
        true, part = filter_part(c, h, probes)
        f = Filter((np.array([8 * len(part)], np.uint64), np.zeros(1, np.uint64), np.frombuffer(part, np.uint8)), probes)
        levels, true = f.levels(h).astype(np.uint8)[back], true.astype(np.uint8)[back]
        levels[first[c > 0]] |= 128
        a, b = 0, sum(map(len, singles)) // 6
        out = []
        for x, y in zip(singles, manys, strict=True):
            i, j = a + len(x) // 6, b + len(y) // 6
            found, own = np.concatenate((levels[a:i], levels[b:j])), np.concatenate((true[a:i], true[b:j]))
            out.append((found.tobytes(), own[found > 127].tobytes()))
            a, b = i, j
        return pa.table({"run": cells.column("run"), "segment": cells.column("segment"), "levels": pa.array([x for x, _ in out], pa.binary()), "own": pa.array([x for _, x in out], pa.binary())})

    return run


def _whole(name: str, got: int, want: int) -> None:
    if got != want:
        raise ValueError(f"{got} answers for {want} questions of run {name}: its texts changed between two attempts of a task")


WORDS = "run string, segment int, h binary, c binary, s binary, t binary"


def accounting(bits: int, root: str):
    """A run's words with their counts and what the run accounts for; writes the levels of its tokens."""

    def run(key, answers):
        name, answers = key[0].as_py(), answers.sort_by("segment")
        r = Run.load(root, name)
        h, c, token, back = r.grams()
        got = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        _whole(name, len(got), len(h))
        came = np.argsort(((h >> U64(64 - bits)) << U64(1)) | (c != 1).astype(np.uint64), kind="stable")
        level = np.empty(len(h), np.uint8)
        level[came] = got & 127
        _write(root, f"levels-{name}", [pa.RecordBatch.from_pydict({"level": pa.array(level[back])})])
        own = came[got > 127]
        true = np.frombuffer(b"".join(answers.column("own").to_pylist()), np.uint8)
        _whole(name, len(true), len(own))
        u, n = r.before[token[own]], len(r.words)
        count = np.bincount(r.ranks, r.learned(), n).astype(np.int64)
        s, t = np.bincount(u, 2.0 ** (true.astype(float) - 1), n).astype(np.int64), np.bincount(u, minlength=n)
        by = np.argsort(r.words)
        w, count, s, t = r.words[by], count[by], s[by], t[by]
        rows = [(seg, w[a:b].astype("<u8").tobytes(), _narrow(count[a:b]), _narrow(s[a:b]), _narrow(t[a:b])) for seg, a, b in _cuts((w >> U64(64 - bits)).astype(np.int64))]
        seg, *columns = zip(*rows, strict=True)
        out = pa.table({"run": [name] * len(seg), "segment": pa.array(seg, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in zip("hcst", columns, strict=True)})
        del r, h, c, token, back, came, level, own
        give_back()
        return out

    return run


VOCABULARY = "run string, segment int, n long, total long, c binary, back binary, types binary"


def _vocabulary(key, asked):
    """A segment's words for each run that has them, in the order they came in: counts C, backoff masses C - S + T and numbers
    of successors T. The first row has the segment's number of trained words and of their tokens."""
    hashes = [np.frombuffer(x, "<u8") for x in asked.column("h").to_pylist()]
    h, order, heads, back = _grouped(np.concatenate(hashes))
    c, s, t = (np.add.reduceat(np.concatenate([_wide(x) for x in asked.column(k).to_pylist()])[order], heads) for k in "cst")
    first = np.zeros((2, len(hashes)), np.int64)
    first[:, 0] = np.count_nonzero(c), c.sum()
    ends = np.cumsum([0, *map(len, hashes)])
    columns = {k: pa.array([_narrow(x[back[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for k, x in (("c", c), ("back", c - s + t), ("types", t))}
    return pa.table({"run": asked.column("run"), "segment": asked.column("segment"), "n": first[0], "total": first[1]} | columns)


def scoring(total: int, distinct: int, root: str, keys: list[str]):
    """The named columns with each text's figures."""

    def run(key, vocabulary):
        name, vocabulary = key[0].as_py(), vocabulary.sort_by("segment")
        r = Run.load(root, name)
        by = np.argsort(r.words)
        known = []
        for k in ("c", "back", "types"):
            got = np.concatenate([_wide(x) for x in vocabulary.column(k).to_pylist()])
            _whole(name, len(got), len(by))
            x = np.empty(len(by))
            x[by] = got
            known.append(x)
        c, mass, types = known
        p1 = ((c + 1.0) / (total + distinct + 1.0))[r.ranks]
        seen = COUNT[_read(root, f"levels-{name}")[0].column("level").to_numpy()]
        seen = np.minimum(seen, np.minimum(c[r.ranks], c[r.before]))
        whole = (c + types)[r.before]
        p = np.where(whole > 0, (seen + mass[r.before] * p1) / np.maximum(whole, 1), p1)
        run_sum = lambda v: pa.array(np.add.reduceat(v, r.bounds[:-1]))  # noqa: E731  no run is empty: END
        figures = [pa.array(np.diff(r.bounds)), run_sum((c > 0).astype(np.int64)[r.ranks]), run_sum(np.log10(p1)), run_sum(np.log10(p))]
        out = pa.Table.from_arrays([*(r.keys.column(k) for k in keys), *figures], [*keys, *FIGURES])
        del r, p1, seen, whole, p
        give_back()
        return out

    return run


class Filter:
    """Parts lo..hi of the filter: probed counts of bigrams whose segment is among them, -1 for others."""

    def __init__(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray], probes: int):
        """parts: each segment's bits (0 where it has none), its first bit in the data, the data."""
        self.size, self.start, self.data = parts
        self.bits, self.probes = len(self.size).bit_length() - 1, probes

    def levels(self, h: np.ndarray) -> np.ndarray:
        step = 1 << 17
        return np.concatenate([self._levels(h[a : a + step]) for a in range(0, len(h), step)]) if len(h) > step else self._levels(h)

    def _levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int8)
        seg = h >> U64(64 - self.bits)
        low = h & U64((1 << 48) - 1)
        alive = np.flatnonzero(self.size[seg])
        for level in range(1, LEVELS):
            if not len(alive):
                break
            size, start = self.size[seg[alive]], self.start[seg[alive]]
            x = mix(low[alive] * U64(2 * LEVELS + 1) + U64(level))
            step = (x >> U64(32)) | U64(1)
            x &= U64(0xFFFFFFFF)
            for j in range(self.probes):
                at = start + (x + U64(j) * step) % size
                hit = ((self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1).astype(bool)
                if not hit.all():
                    alive, size, start, x, step = alive[hit], size[hit], start[hit], x[hit], step[hit]
            out[alive] = level
        return out


def score_documents(docs: DataFrame, train, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs' columns other than text, with n_tokens, n_known, train_tokens, base_score and score.

    train: a Column that is true for the rows to learn from (null: not learned from). Null text is empty: its one token is
    the end. Equal texts get equal scores; no columns but text and those of ``train`` are read by the model. Without
    training rows every count is 0 and scores are those of the add-one base. Columns of docs named like those added here
    are replaced; other names are free.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    body, learn = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(train, F.lit(False))
    size = docs.select(body.alias("text")).agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = max(1, min(20, math.ceil(math.log2(((size[0] or 0) / 5 + size[1]) / p.segment_tokens + 1))))
    own = [c for c in docs.columns if c not in (text, "train_tokens", *FIGURES)]
    keys, root = [f"_{i}" for i in range(len(own))], f"{scratch.root}/runs"
    texts = docs.select(*(F.col(c).alias(k) for k, c in zip(keys, own, strict=True)), body.alias("text"), learn.alias("train"))
    answers = texts.mapInArrow(runs(bits, p.task_tokens, root, keys), CELLS).groupBy("segment").applyInArrow(answering(p.probes), ANSWERS)
    asked = answers.groupBy("run").applyInArrow(accounting(bits, root), WORDS)
    vocabulary = scratch.save(asked.groupBy("segment").applyInArrow(_vocabulary, VOCABULARY))
    distinct, total = (x or 0 for x in vocabulary.agg(F.sum("n"), F.sum("total")).first())
    schema = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys] + ["n_tokens long", "n_known long", "base_score double", "score double"]
    scores = vocabulary.groupBy("run").applyInArrow(scoring(total, distinct, root, keys), ", ".join(schema))
    named = [F.col(k).alias(c) for k, c in zip(keys, own, strict=True)]
    return scores.select(*named, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
