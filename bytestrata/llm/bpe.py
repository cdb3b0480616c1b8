"""Ids of a public byte-level BPE vocabulary for whole Arrow columns.

Texts are cut into the vocabulary's pre-tokens by numpy rules over bytes (the same cuts as its pattern: contractions, then
runs of letters, of numbers and of other signs with one space before, then white space), distinct pre-tokens are encoded
once and kept, and the ids of a column are gathered from there. Strings of the vocabulary's added tokens are one id each,
as by the public tokenizer's defaults.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa

from bytestrata.llm.textkit import raw_bytes, same_spans, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
KEEP = 300_000


def _kinds() -> np.ndarray:
    """The kind of each code point. White space is what has the Unicode property."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            out[c] = LETTER
        elif g == "N":
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


_STATE: dict[str, object] = {}


def kinds() -> np.ndarray:
    if "kinds" not in _STATE:
        _STATE["kinds"] = _kinds()
    return _STATE["kinds"]


def pretokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start. off: bounds of the texts within data."""
    table = kinds()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    inner = (data & 0xC0) == 0x80
    if len(lead):
        b = data[lead].astype(np.int64)
        size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        code = np.where(size == 4, b & 7, np.where(size == 3, b & 15, b & 31))
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        for j in range(1, 4):
            more = size > j
            code = np.where(more, (code << 6) | (padded[lead + j] & 63), code)
        k = table[code]
        for j in range(4):
            has = size > j
            kind[lead[has] + j] = k[has]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    run = start.copy()
    start |= edge[:-1]
    run = np.flatnonzero(run & (kind != SPACE) & ~edge[:-1])
    run = run[kind[run - 1] == SPACE] if len(run) else run
    q = run - 1
    for _ in range(3):
        q = np.where(inner[q], q - 1, q)
    start[q] = True
    start[run[data[q] == 32]] = False
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~edge[np.minimum(quote + 1, n)]
        short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & ~edge[np.minimum(quote + 2, n)] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for at, width in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            after = at + width
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """One per worker process: the vocabulary, and the ids of pre-tokens met so far (emptied at KEEP of them)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.added = {x["content"].encode(): x["id"] for x in whole.get("added_tokens", [])}
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.core = tiktoken.Encoding("public", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.from_ = np.zeros(0, np.int64)
        self.to = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def _ids(self, token: bytes) -> list[int]:
        # No rule makes an added token's string one pre-token, so that only those cut out by _spans() are met here.
        return [self.added[token]] if token in self.added else self.core.encode_single_piece(token)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        tokens = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [self._ids(t) for t in tokens]
        count = np.array([len(x) for x in ids], np.int64)
        size = ends - starts
        to = len(self.bytes) + np.cumsum(size)
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(count) - count))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.from_ = np.concatenate((self.from_, to - size))[order]
        self.to = np.concatenate((self.to, to))[order]
        self.pool = np.concatenate((self.pool, np.array([i for x in ids for i in x], np.uint32)))
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(tokens), np.uint8)))

    def _found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pre-token: how many ids it has, where they begin in a pool, and that pool. Pre-tokens are looked up by
        hash and compared byte by byte; if a hash ever stands for two strings, all are looked up by their bytes."""
        h = span_hashes(data, starts, ends)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(uniq) > KEEP:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, uniq), max(0, len(self.hashes) - 1))
        new = np.ones(len(uniq), bool) if not len(self.hashes) else self.hashes[at] != uniq
        if new.any():
            self._learn(uniq[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.hashes, uniq)
        if same_spans(data, starts, ends, self.bytes, self.from_[at][back], self.to[at][back]).all():
            return self.count[at][back], self.at[at][back], self.pool
        raw = data.tobytes()
        known: dict[bytes, list[int]] = {}
        ids = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            token = raw[a:b]
            if token not in known:
                known[token] = self._ids(token)
            ids.append(known[token])
        count = np.array([len(x) for x in ids], np.int64)
        return count, np.cumsum(count) - count, np.array([i for x in ids for i in x], np.uint32)

    def _spans(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(start, end) of the added tokens' strings within texts, from left to right in each text."""
        raw = data.tobytes()
        if self.find is None or not self.find.search(raw):
            return np.zeros((0, 2), np.int64)
        found = [m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for m in self.find.finditer(raw, a, b)]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each followed by ``end`` unless that is None; bounds of the texts' ids."""
        data, off = raw_bytes(texts)
        spans = self._spans(data, off)
        if len(spans):
            starts = pretokens(data, np.sort(np.concatenate((off, spans.reshape(-1)))))
            last = np.searchsorted(spans[:, 0], starts, "left") - 1
            starts = starts[(last < 0) | (starts >= spans[last, 1])]
        else:
            starts = pretokens(data, off)
        ends = np.append(starts[1:], len(data))
        count, source, pool = self._found(data, starts, ends)
        first_span = np.searchsorted(starts, off)
        before = np.concatenate(([0], np.cumsum(count)))
        extra = 0 if end is None else 1
        bounds = before[first_span] + extra * np.arange(len(off))
        place = np.repeat(before[:-1], count)
        gather = np.arange(before[-1]) - place + np.repeat(source, count)
        ids = pool[gather]
        if end is None:
            return ids, bounds
        out = np.full(bounds[-1], end, np.uint32)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = ids
        return out, bounds


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in such vocabularies: itself where printable, else the next free sign from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    key = f"encoder:{path}"
    if key not in _STATE:
        _STATE[key] = Encoder(path)
    return _STATE[key]
