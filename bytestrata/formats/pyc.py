"""Walker of compiled Python: a header by version, then one marshalled code object with references to earlier objects."""

from __future__ import annotations

import datetime
import struct
import unicodedata

from bytestrata.formats.tree import Node, View, decimal

# Fixed values of the format.
#: (first magic, last magic, version), a magic being the two bytes before CR LF.
VERSIONS = [
    (62011, 62021, (2, 3)), (62041, 62061, (2, 4)), (62071, 62131, (2, 5)), (62151, 62161, (2, 6)), (62171, 62211, (2, 7)), (3000, 3131, (3, 0)), (3141, 3151, (3, 1)),
    (3160, 3180, (3, 2)), (3190, 3230, (3, 3)), (3250, 3310, (3, 4)), (3320, 3351, (3, 5)), (3360, 3379, (3, 6)), (3390, 3394, (3, 7)), (3400, 3413, (3, 8)),
    (3420, 3425, (3, 9)), (3430, 3439, (3, 10)), (3450, 3495, (3, 11)), (3500, 3531, (3, 12)), (3550, 3571, (3, 13)), (3600, 3627, (3, 14)),
]
DEEPEST, CHARS, REFERENCE = 64, 80, 0x80
SINGLE = {"0": "NULL", "N": "None", "F": "False", "T": "True", "S": "StopIteration", ".": "Ellipsis"}
STRINGS = {
    "s": "Bytes", "t": "Str (interned)", "u": "Unicode", "a": "Str (ASCII)", "A": "Str (ASCII, interned)", "z": "Str (short ASCII)",
    "Z": "Str (short ASCII, interned)",
}
SEQUENCES = {"(": "Tuple", ")": "Tuple", "[": "List", "<": "Set", ">": "Frozenset"}
CODE_FLAGS = {
    0x1: "OPTIMIZED", 0x2: "NEWLOCALS", 0x4: "VARARGS", 0x8: "VARKEYWORDS", 0x10: "NESTED", 0x20: "GENERATOR", 0x40: "NOFREE", 0x80: "COROUTINE",
    0x100: "ITERABLE_COROUTINE", 0x200: "ASYNC_GENERATOR", 0x04000000: "HAS_DOCSTRING", 0x08000000: "METHOD",
}
#: Fields of a code object from this version on: numbers are marked by #, the others are objects.
CODE = [
    ((3, 11), "#argcount #posonlyargcount #kwonlyargcount #stacksize #flags code consts names localsplusnames localspluskinds filename name qualname #firstlineno linetable exceptiontable"),
    ((3, 10), "#argcount #posonlyargcount #kwonlyargcount #nlocals #stacksize #flags code consts names varnames freevars cellvars filename name #firstlineno linetable"),
    ((3, 8), "#argcount #posonlyargcount #kwonlyargcount #nlocals #stacksize #flags code consts names varnames freevars cellvars filename name #firstlineno lnotab"),
    ((3, 0), "#argcount #kwonlyargcount #nlocals #stacksize #flags code consts names varnames freevars cellvars filename name #firstlineno lnotab"),
    ((2, 0), "#argcount #nlocals #stacksize #flags code consts names varnames freevars cellvars filename name #firstlineno lnotab"),
]
EPOCH = datetime.datetime(1970, 1, 1)
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}


def version(data: bytes) -> tuple[int, tuple[int, int]] | None:
    magic = int.from_bytes(data[:2], "little")
    found = next((v for lo, hi, v in VERSIONS if lo <= magic <= hi), None)
    return (magic, found) if found and data[2:4] == b"\r\n" else None


def _quoted(text: str) -> str:
    shown = lambda c: ESCAPES.get(c) or (f"\\x{ord(c):02x}" if unicodedata.category(c) == "Cc" else c)
    return '"' + "".join(map(shown, text[:CHARS])) + "…" * (len(text) > CHARS) + '"'


class Cut(Exception):
    """An object goes on beyond the end."""


class _Marshal:
    """Objects one after another. Once one can't be read, ``stopped`` is set and no more are."""

    def __init__(self, data: bytes, version: tuple[int, int]):
        self.data, self.version, self.seen, self.stopped = data, version, [], False

    def number(self, layout: str, at: int):
        if at + struct.calcsize(layout) > len(self.data):
            raise Cut
        return struct.unpack_from("<" + layout, self.data, at)[0]

    def stop(self, label: str, at: int, end: int | None = None) -> Node:
        self.stopped = True
        return Node(label, at, len(self.data) if end is None else end)

    def object(self, at: int, depth: int) -> Node:
        if at >= len(self.data):
            return self.stop("Truncated (missing object)", at, at)
        if depth > DEEPEST:
            return self.stop("Nesting too deep (parsing stopped)", at)
        code, kept = chr(self.data[at] & ~REFERENCE), self.data[at] & REFERENCE
        if code in SINGLE:
            return Node(SINGLE[code], at, at + 1)
        if code == "r":
            try:
                i = self.number("I", at + 1)
            except Cut:
                return self.stop("Truncated ref", at)
            return Node(f"Ref #{i}" + (f" → {self.seen[i]}" if i < len(self.seen) else ""), at, at + 5)
        slot = len(self.seen)
        if kept:
            self.seen.append("")
        try:
            out = self.compound(code, at, depth) if code in "c{:" or code in SEQUENCES else self.plain(code, at)
        except Cut:
            out = self.stop("Truncated object", at)
        if kept:
            self.seen[slot] = out.label
            out.label += f" [ref #{slot}]"
        return out

    def plain(self, code: str, at: int) -> Node:
        body = at + 1
        if code in "iI":
            width = 4 if code == "i" else 8
            return Node(f"Int{'' if code == 'i' else 64}: {self.number('i' if code == 'i' else 'q', body)}", at, body + width)
        if code == "g":
            return Node(f"Float: {decimal(self.number('d', body))}", at, body + 8)
        if code == "y":
            a, b = self.number("d", body), self.number("d", body + 8)
            return Node(f"Complex: ({decimal(a)}+{decimal(b)}j)", at, body + 16)
        if code in "fx":
            text, end = self.short(body)
            if code == "f":
                return Node(f"Float: {text}", at, end)
            other, end = self.short(end)
            return Node(f"Complex: ({text}+{other}j)", at, end)
        if code == "l":
            return self.long(at)
        if code in STRINGS:
            return self.string(code, at)
        if code == "R":
            return Node(f"Interned string ref #{self.number('I', body)}", at, body + 4)
        shown = f" '{code}'" if " " <= code < "\x7f" else ""
        return self.stop(f"Unknown marshal type 0x{ord(code):02X}{shown} (parsing stopped)", at, body)

    def short(self, at: int) -> tuple[str, int]:
        end = at + 1 + self.number("B", at)
        if end > len(self.data):
            raise Cut
        return self.data[at + 1 : end].decode("utf-8", "replace"), end

    def long(self, at: int) -> Node:
        """Digits of 15 bits, the lowest first; the sign is that of their number."""
        count = self.number("i", at + 1)
        n, end = abs(count), at + 5 + 2 * abs(count)
        if end > len(self.data):
            raise Cut
        if n > 8:
            return Node(f"Long: ({n} digits)", at, end)
        digits = struct.unpack_from(f"<{n}H", self.data, at + 5)
        value = sum((d & 0x7FFF) << 15 * i for i, d in enumerate(digits))
        return Node(f"Long: {-value if count < 0 else value}", at, end)

    def string(self, code: str, at: int) -> Node:
        n, start = (self.number("B", at + 1), at + 2) if code in "zZ" else (self.number("I", at + 1), at + 5)
        if start + n > len(self.data):
            raise Cut
        raw, old = self.data[start : start + n], self.version < (3, 0)
        kind = "Str" if code == "s" and old else STRINGS[code]
        if code == "s" and not (old and all(0x20 <= x < 0x7F for x in raw)):
            return Node(f"{kind}: {n} bytes", at, start + n)
        return Node(f"{kind}: {_quoted(raw.decode('utf-8', 'replace'))}" + f" ({n} bytes)" * (n > CHARS), at, start + n)

    def items(self, at: int, names, depth: int, kids: list[Node]) -> int:
        """Reads an object a name, until one can't be read; the end of the last."""
        for name in names:
            node = self.object(at, depth + 1)
            node.label = name + node.label
            kids.append(node)
            at = node.end
            if self.stopped:
                break
        return at

    def compound(self, code: str, at: int, depth: int) -> Node:
        kids: list[Node] = []
        if code == "c":
            return self.code(at, depth)
        if code == ":":
            end = self.items(at + 1, ("start: ", "stop: ", "step: "), depth, kids)
            return Node("Slice", at, end, kids)
        if code == "{":
            end, pairs = at + 1, 0
            while self.data[end : end + 1] != b"0":
                end = self.items(end, ("Key: ", "Value: "), depth, kids)
                if self.stopped:
                    return Node(f"Dict ({pairs} items)", at, end, kids)
                pairs += 1
            return Node(f"Dict ({pairs} items)", at, end + 1, [*kids, Node("NULL (end of dict)", end, end + 1)])
        try:
            count, start = (self.number("B", at + 1), at + 2) if code == ")" else (self.number("I", at + 1), at + 5)
        except Cut:
            return self.stop(f"Truncated {'tuple' if code == ')' else 'container'}", at)
        end = self.items(start, (f"[{i}] " for i in range(count)), depth, kids)
        return Node(f"{SEQUENCES[code]} ({count} items)", at, end, kids)

    def code(self, at: int, depth: int) -> Node:
        first = self.data[at]
        kids, pos, name = [Node(f"Type: 0x{first:02X} ('c' code object{' | FLAG_REF' * (first >= REFERENCE)})", at, at + 1)], at + 1, ""
        for field in next(layout for since, layout in CODE if self.version >= since).split():
            what = f"co_{field.lstrip('#')}"
            if field[0] != "#":
                pos = self.items(pos, (f"{what}: ",), depth, kids)
                name = kids[-1].label.split(" [ref #")[0] if what == "co_name" else name
                if self.stopped:
                    break
                continue
            try:
                n = self.number("i", pos)
            except Cut:
                kids.append(self.stop(f"{what}: truncated", pos))
                pos = len(self.data)
                break
            kids.append(Node(_flags(n & 0xFFFFFFFF) if what == "co_flags" else f"{what}: {n}", pos, pos + 4))
            pos += 4
        parts = name.split(": ", 2)
        return Node(f"Code object {parts[2]}" if len(parts) > 2 else "Code object", at, pos, kids)


def _flags(n: int) -> str:
    rest = n & ~sum(CODE_FLAGS)
    names = [name for bit, name in CODE_FLAGS.items() if n & bit] + [f"0x{rest:X}"] * (rest > 0)
    return f"co_flags: 0x{n:08X}" + (f" ({' | '.join(names)})" if names else "")


def _time(v: View, at: int) -> Node:
    n = v.number(at, 4, "little")
    return Node(f"Source mtime: {n} ({EPOCH + datetime.timedelta(seconds=n)} UTC)", at, at + 4)


def _size(v: View, at: int) -> Node:
    return Node(f"Source size: {v.number(at, 4, 'little')} bytes", at, at + 4)


def pyc(v: View) -> list[Node]:
    known = version(v.data)
    if known is None:
        return []
    magic, since = known
    size = 16 if since >= (3, 7) else 12 if since >= (3, 3) else 8
    if v.size < size:
        return []
    kids = [Node(f"Magic: {magic} (Python {since[0]}.{since[1]})", 0, 4)]
    if size < 16:
        kids += [_time(v, 4)] + ([_size(v, 8)] if size == 12 else [])
    else:
        flags = v.number(4, 4, "little")
        kind = "timestamp-based" if not flags & 1 else f"hash-based, {'checked' if flags & 2 else 'unchecked'}"
        kids.append(Node(f"Flags: 0x{flags:X} ({kind})", 4, 8))
        kids += [Node(f"Source hash: {v.data[8:16].hex()}", 8, 16)] if flags & 1 else [_time(v, 8), _size(v, 12)]
    walk = _Marshal(v.data, since)
    code = walk.object(size, 0)
    code.label, code.open = f"Marshalled {code.label}", True
    rest = f"{'Unparsed' if walk.stopped else 'Trailing'} data ({v.size - code.end} bytes)"
    return [Node("Header", 0, size, kids, True), code] + [Node(rest, code.end, v.size)] * (code.end < v.size)


WALKERS = {"Python bytecode": pyc}
