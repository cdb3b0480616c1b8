"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Each document is tokenized whole; only those longer than a sequence are cut, into full pieces after a first one that may
be shorter. Full pieces fill a sequence alone. The other pieces, as lengths without their ids, are dealt evenly to shards
of bounded size; a shard packs by best fit, longest first, then exchanges pieces between underfull sequences: one for
one, two for one, or a move. Every change increases the sum of squared fills, and the emptiest sequences run out. The
search looks at all pieces of both sequences (one of each length stands for its like) and at all underfull sequences, the
emptiest against the fullest first; it ends when no pair of them can change, when as few are left as the lengths allow, or
after ``search_pairs`` pairs, a bound on effort that leaves every piece placed. Each shard can end with one sequence more
than the whole table would need, 1 in thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.bpe import encoder
from bytestrata.llm.scratch import Scratch
from bytestrata.llm.textkit import slices


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Params:
    """vocabulary: a path that every executor can read; None: the installed public one."""

    capacity: int = 2048
    shard_pieces: int = 40_000
    end_id: int = 0
    search_pairs: int = 20_000
    vocabulary: str | None = None


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def _tokenizer(p: Params, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.vocabulary or default_vocabulary())
        for batch in slices(batches, "text"):
            ids, bounds = enc.encode(batch.column("text"), p.end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            rows = [(i, j, s, n, zlib.crc32(raw[4 * (a + s) : 4 * (a + s + n)])) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) for j, (s, n) in enumerate(cut(b - a, p.capacity))]
            who, *rest = (pa.array(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(who) for k in keys), rest[0].cast(pa.int32()), *rest[1:]], [*keys, "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, lengths: np.ndarray) -> None:
        """Longest first, each into the fullest bin that takes it."""
        with_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = with_room[room].pop()
                if not with_room[room]:
                    mask &= ~(1 << room)
            else:
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += n
            room -= n
            with_room[room].append(b)
            mask |= 1 << room

    def improve(self, lengths: np.ndarray, most: int) -> None:
        """Empties the emptiest bin into the other underfull ones, fullest first, again and again while anything moves; then
        the next one that can give something. most: pairs of bins looked at."""
        need, sizes = least_bins(lengths, self.capacity), lengths.tolist()
        live, stuck, known = sum(1 for f in self.fill if f), set(), {}
        while live > need and most > 0:
            under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: self.fill[b])
            a = next((b for b in under if b not in stuck), None)
            if a is None:
                break
            moved = False
            for b in reversed(under):
                if most <= 0 or not self.fill[a]:
                    break
                while b != a and 0 < self.fill[a] <= self.fill[b] < self.capacity and most > 0:
                    most -= 1
                    for x in (a, b):
                        if x not in known:
                            known[x] = Choices([sizes[i] for i in self.items[x]])
                    found = best_change(known[a], known[b], self.capacity - self.fill[b])
                    if not found:
                        break
                    self._exchange(a, b, *found, sizes)
                    del known[a], known[b]
                    moved = True
            live -= not self.fill[a]
            if moved:
                stuck.clear()
            else:
                stuck.add(a)
        live = [b for b, f in enumerate(self.fill) if f]
        self.items, self.fill = [self.items[b] for b in live], [self.fill[b] for b in live]

    def _exchange(self, a: int, b: int, out: list[int], back: list[int], sizes: list[int]) -> None:
        def taken(bin_: int, wanted: list[int]) -> list[int]:
            found = []
            for x in wanted:
                i = next(i for i in self.items[bin_] if sizes[i] == x)
                self.items[bin_].remove(i)
                found.append(i)
            return found

        there, here = taken(a, out), taken(b, back)
        self.items[a] += here
        self.items[b] += there
        self.fill[a] -= sum(out) - sum(back)
        self.fill[b] += sum(out) - sum(back)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for each limit, pieces over half a bin stand alone, and pieces from the
    limit up to half fill at best what the others leave."""
    count = np.bincount(lengths, minlength=capacity + 1)
    tokens = count * np.arange(capacity + 1)
    many, much = np.cumsum(count), np.cumsum(tokens)
    half = capacity // 2
    best = -(-int(tokens.sum()) // capacity)
    for limit in range(1, half + 1):
        large = int(many[capacity] - many[capacity - limit])
        middle = int(many[capacity - limit] - many[half])
        room = middle * capacity - int(much[capacity - limit] - much[half])
        small = int(much[half] - much[limit - 1])
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


class Choices:
    """What an exchange can take of a bin: single lengths and sums of two, ascending, and the lengths of each."""

    def __init__(self, own: list[int]):
        # of one length, two pieces are as many as an exchange can take
        one = np.array([x for x in sorted(set(own)) for _ in range(min(2, own.count(x)))], np.int64)
        i, j = np.triu_indices(len(one), 1)
        two = one[i] + one[j]
        order = np.argsort(two, kind="stable")
        self.sums = (np.zeros(1, np.int64), one, two[order])
        self.parts = (np.zeros((1, 0), np.int64), one[:, None], np.stack((one[i], one[j]), 1)[order])


def best_change(x: Choices, y: Choices, room: int) -> tuple[list[int], list[int]] | None:
    """One or two lengths of x for none, one or two of y (three pieces at most) that move the most tokens, ``room`` at most."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    for out, back in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2)):
        outs, backs = x.sums[out], y.sums[back]
        if best[0] == room or not len(outs) or not len(backs):
            continue
        at = np.searchsorted(backs, outs - room)
        gain = np.where(at < len(backs), outs - backs[np.minimum(at, len(backs) - 1)], 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (int(gain[k]), x.parts[out][k].tolist(), y.parts[back][at[k]].tolist())
    return best[1:] if best[0] else None


def pack(lengths: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its place there."""
    bins = Bins(p.capacity)
    bins.best_fit(lengths)
    bins.improve(lengths, p.search_pairs)
    number, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            number[i], place[i] = b, at
            at += int(lengths[i])
    return number, place


def _packer(p: Params):
    def run(key, table):
        number, place = pack(table.column("length").to_numpy(), p)
        shard = key[0].as_py()
        return table.append_column("sequence_id", pa.array((np.int64(shard) << 32) + number)).append_column("offset", pa.array(place))

    return run


PLACED = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """A row per piece: docs' columns other than text, then piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat are packed each for itself. Other columns are carried
    along, whatever their names; those named like the columns added here are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    own = [c for c in docs.columns if c not in (text, *PLACED)]
    keys = [f"_{i}" for i in range(len(own))]
    slim = docs.select(*(F.col(c).alias(k) for c, k in zip(own, keys, strict=True)), F.col(text).cast("string").alias("text"))
    schema = "".join(f"{k} {slim.schema[k].dataType.simpleString()}, " for k in keys) + "piece int, start long, length long, ids_crc32 long"
    pieces = scratch.save(slim.mapInArrow(_tokenizer(p, keys), schema))
    part = F.col("length") < p.capacity
    shards = max(1, -(-pieces.where(part).count() // p.shard_pieces))
    row = F.monotonically_increasing_id()
    full = pieces.withColumn("row", row).where(~part).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    dealt = pieces.where(part).withColumn("shard", F.pmod(F.xxhash64(row), F.lit(shards)))
    names = [*keys, "piece", "start", "length", "ids_crc32"]
    packed = dealt.groupBy("shard").applyInArrow(_packer(p), f"{schema}, shard long, sequence_id long, offset long")
    out = packed.select(*names, "sequence_id", "offset").unionByName(full)
    return out.select(*(F.col(k).alias(c) for c, k in zip(own, keys, strict=True)), *names[len(keys) :], "sequence_id", "offset")
