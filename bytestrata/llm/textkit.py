"""Words, 64-bit word hashes and shingles of Arrow string columns, by whole-buffer numpy operations.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. UTF-8 continuation bytes are never
white space, so the words are those of ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
SEED = U64(0x5851F42D4C957F2D)
#: Of a value of 8 bytes, the first 0 to 8.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
LONG = 64
RUN = 1 << 14
_STATE: dict[str, object] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of a run of texts. first[i]:first[i+1] are text i's; data is lower-cased bytes."""

    __slots__ = ("data", "starts", "ends", "first", "hashes")

    def __init__(self, data, starts, ends, first, hashes):
        self.data, self.starts, self.ends, self.first, self.hashes = data, starts, ends, first, hashes


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, one after another, and each text's bounds. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, bounds, data = texts.buffers()
    if len(texts) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, hashed: bool = True, fold: bool = True, kinds: np.ndarray | None = None) -> Words:
    """Words of texts; with ``kinds``, maximal runs of bytes of one non-zero kind instead. fold: A-Z count as a-z."""
    raw, off = raw_bytes(texts)
    data = LOWER[raw] if fold else raw
    kind = ~SPACE[data] if kinds is None else kinds[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[off] = True
    full = kind != 0
    starts = np.flatnonzero(full & edge[:-1])
    ends = np.flatnonzero(full & edge[1:]) + 1
    first = np.searchsorted(starts, off)
    return Words(data, starts, ends, first, span_hashes(data, starts, ends) if hashed else None)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end; a view of a padded copy."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes. Eight bytes a step, each mixed into the state by a bijection
    that is not linear in it; spans over LONG bytes by BLAKE2b."""
    hashes = np.empty(len(starts), np.uint64)
    view = eights(data)
    for a in range(0, len(starts), RUN):
        s, left = starts[a : a + RUN], ends[a : a + RUN] - starts[a : a + RUN]
        state = hashes[a : a + RUN]
        x = view[s] & FIRST_BYTES[np.minimum(left, 8)]
        state[:] = mix((x ^ (left.astype(np.uint64) * STEP)) * STEP + SEED)
        who = np.flatnonzero(left > 8)
        for i in who[left[who] > LONG].tolist():
            state[i] = int.from_bytes(hashlib.blake2b(data[s[i] : s[i] + left[i]].tobytes(), digest_size=8).digest(), "little")
        who = who[left[who] <= LONG]
        done = 8
        while len(who):
            x = view[s[who] + done] & FIRST_BYTES[np.minimum(left[who] - done, 8)]
            state[who] = mix((state[who] ^ x) * STEP + SEED)
            done += 8
            who = who[left[who] > done]
    return hashes


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of the span of ``other`` beside it."""
    same = (ends - starts) == (to - at)
    left_view, right_view = eights(data), eights(other)
    who = np.flatnonzero(same & (ends > starts))
    a, b, left = starts[who], at[who], (ends - starts)[who]
    while len(who):
        differ = ((left_view[a] ^ right_view[b]) & FIRST_BYTES[np.minimum(left, 8)]) != 0
        same[who[differ]] = False
        more = (left > 8) & ~differ
        who, a, b, left = who[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def give_back() -> None:
    """Hands memory that is free inside this process back to the system; a Python worker lives on, idle or with other work."""
    pa.default_memory_pool().release_unused()
    if "trim" not in _STATE:
        with contextlib.suppress(OSError):
            _STATE["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if _STATE.get("trim"):
        _STATE["trim"](0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, column, lengths, total
    give_back()


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct n-word shingles as hashes, and the bounds of its run.

    A text of 1 to n - 1 words has one shingle, the whole sequence; a text without words has none.
    """
    h, first = w.hashes, w.first
    if len(h) >= n:
        rolled = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            rolled *= U64(0xD6E8FEB86659FD93)
            rolled += h[k : len(h) - n + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out, bounds = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            x = U64(b - a)
            for v in h[a:b].tolist():
                x = U64((int(x) * 0xD6E8FEB86659FD93 + v) % 2**64)
            s = mix(np.array([x], np.uint64))
        else:
            s = rolled[:0]
        out.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    return (np.concatenate(out) if out else rolled[:0]), bounds


def runs_reduce(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduceat over runs that may be empty."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out
