"""Walker of XZ: streams are found from the end, by footer, index and the sizes that the index lists."""

from __future__ import annotations

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
MAGIC, LAST, EDGE = b"\xfd7zXZ\0", b"YZ", 12
CHECKS = {0: "None", 1: "CRC32", 4: "CRC64", 10: "SHA-256"}
FILTERS = {
    3: "Delta", 4: "x86 BCJ", 5: "PowerPC BCJ", 6: "IA-64 BCJ", 7: "ARM BCJ", 8: "ARM-Thumb BCJ", 9: "SPARC BCJ", 10: "ARM64 BCJ", 11: "RISC-V BCJ", 0x21: "LZMA2",
}
SIZES = {0x40: "Compressed size", 0x80: "Uncompressed size"}
LARGEST_DICTIONARY = 40


class Unfit(Exception):
    """The bytes here are not what the format has in this place."""


def four(n: int) -> int:
    return -(-n // 4) * 4


def plain_size(n: int) -> str:
    """A size in the largest unit that it is a whole number of."""
    for shift, unit in ((20, "MiB"), (10, "KiB")):
        if n >= 1 << shift and not n % (1 << shift):
            return f"{n >> shift} {unit}"
    return f"{n} bytes"


def dictionary(n: int) -> str:
    """Bytes of an LZMA2 dictionary: 2 or 3 times a power of two."""
    bits = n & 63
    if bits > LARGEST_DICTIONARY:
        return f"invalid ({n:#04x})"
    return "4 GiB - 1" if bits == LARGEST_DICTIONARY else plain_size((2 | bits & 1) << bits // 2 + 11)


def _count(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(number, its end), seven bits a byte, lowest first, in nine bytes at most."""
    n = 0
    for i in range(9):
        if at + i >= min(end, len(data)):
            break
        n |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return n, at + i + 1
    raise Unfit


def _check(kind: int) -> str:
    return CHECKS.get(kind, f"reserved ({kind:#04x})")


def _crc(v: View, at: int) -> Node:
    return Node(f"CRC32: {v.number(at, 4, 'little'):#010x}", at, at + 4)


def _flags(v: View, at: int) -> Node:
    return Node(f"Stream flags: check type {_check(v.data[at + 1] & 15)}", at, at + 2)


def _header(v: View, at: int) -> Node:
    return Node("Stream header", at, at + EDGE, [Node("Magic: FD 37 7A 58 5A 00", at, at + 6), _flags(v, at + 6), _crc(v, at + 8)], True)


def _footer(v: View, at: int) -> Node:
    back = Node(f"Backward size: {4 * v.number(at + 4, 4, 'little') + 4} bytes", at + 4, at + 8)
    return Node("Stream footer", at, at + EDGE, [_crc(v, at), back, _flags(v, at + 8), Node("Magic: YZ", at + 10, at + 12)], True)


def _index(v: View, at: int, end: int) -> tuple[Node, list[int]]:
    """(node, unpadded sizes of the blocks) of an index that fills its place exactly."""
    if end < at + 8 or v.data[at]:
        raise Unfit
    crc = end - 4
    count, pos = _count(v.data, at + 1, crc)
    if count > (crc - pos) // 2:
        raise Unfit
    kids, records, sizes = [Node("Index indicator: 0x00", at, at + 1), Node(f"Number of records: {count}", at + 1, pos)], [], []
    for i in range(count):
        unpadded, middle = _count(v.data, pos, crc)
        held, stop = _count(v.data, middle, crc)
        records.append(Node(f"Record {i}", pos, stop, [Node(f"Unpadded size: {unpadded}", pos, middle), Node(f"Uncompressed size: {held}", middle, stop)]))
        sizes.append(unpadded)
        pos = stop
    if at + four(pos - at) != crc:
        raise Unfit
    kids += [Node("Records", records[0].start, pos, records)] if records else []
    kids += [Node("Index padding", pos, crc)] * (pos < crc)
    return Node("Index", at, end, [*kids, _crc(v, crc)]), sizes


def _streams(v: View) -> list[tuple[int, int, Node | None, list[int]]]:
    """(start, end, index, sizes of blocks) from first to last; padding between streams has no index."""
    out, end = [], v.size
    while True:
        at = end
        while at >= 4 and v.data[at - 4 : at] == bytes(4):
            at -= 4
        if at < end:
            out.append((at, end, None, []))
        end, foot = at, at - EDGE
        if foot < EDGE or v.data[end - 2 : end] != LAST:
            raise Unfit
        first = foot - 4 * (v.number(foot + 4, 4, "little") + 1)
        if first < 0:
            raise Unfit
        index, sizes = _index(v, first, foot)
        start = first - sum(map(four, sizes)) - EDGE
        if start < 0 or v.data[start : start + 6] != MAGIC:
            raise Unfit
        out.append((start, end, index, sizes))
        if not start:
            return out[::-1]
        end = start


def _properties(kind: int, raw: bytes) -> str:
    if kind == 0x21 and len(raw) == 1:
        return f"Dictionary size: {dictionary(raw[0])}"
    if kind == 3 and len(raw) == 1:
        return f"Delta distance: {raw[0] + 1}"
    if 4 <= kind <= 11 and len(raw) == 4:
        return f"Start offset: {int.from_bytes(raw, 'little')}"
    return f"Properties: {raw.hex()}"


def _filter(v: View, i: int, at: int, end: int) -> Node:
    kind, middle = _count(v.data, at, end)
    size, body = _count(v.data, middle, end)
    if body + size > end:
        raise Unfit
    name = FILTERS.get(kind, f"unknown ({kind:#x})")
    kids = [Node(f"Filter ID: {kind:#04x} ({name})", at, middle), Node(f"Properties size: {size}", middle, body)]
    kids += [Node(_properties(kind, v.data[body : body + size]), body, body + size)] * (size > 0)
    return Node(f"Filter {i}: {name}", at, body + size, kids, True)


def _block_header(v: View, at: int) -> Node:
    size = 4 * v.data[at] + 4 if at < v.size else 4
    if size == 4 or at + size > v.size:
        raise Unfit
    flags, crc = v.data[at + 1], at + size - 4
    n = (flags & 3) + 1
    told = [f"{n} filter{'s' * (n > 1)}", *(name.lower() for bit, name in SIZES.items() if flags & bit)]
    kids = [Node(f"Block header size: {size} bytes", at, at + 1), Node(f"Block flags: {flags:#04x} ({', '.join(told)})", at + 1, at + 2)]
    pos, rest = at + 2, "Header padding"
    try:
        for bit, name in SIZES.items():
            if flags & bit:
                held, stop = _count(v.data, pos, crc)
                kids.append(Node(f"{name}: {held}", pos, stop))
                pos = stop
        for i in range(n):
            kids.append(_filter(v, i, pos, crc))
            pos = kids[-1].end
    except Unfit:
        rest = "Unparsed header data"
    return Node("Block header", at, at + size, kids + [Node(rest, pos, crc)] * (pos < crc) + [_crc(v, crc)])


def _sum(v: View, kind: int, at: int, end: int) -> Node:
    number = lambda n: f"{v.number(at, n, 'little'):#0{2 * n + 2}x}"
    told = {1: lambda: f"CRC32: {number(4)}", 4: lambda: f"CRC64: {number(8)}", 10: lambda: f"SHA-256: {v.data[at:end].hex()}"}
    return Node(told.get(kind, lambda: f"Check ({_check(kind)}): {v.data[at:end].hex()}")(), at, end)


def _block(v: View, i: int, at: int, unpadded: int, kind: int) -> Node:
    end, check = at + four(unpadded), 4 << (kind - 1) // 3 if kind else 0
    try:
        header = _block_header(v, at)
    except Unfit:
        return Node(f"Block {i}", at, end, [Node("Unparsed block data", at, end)])
    stop, kids = at + unpadded - check, [header]
    if stop >= header.end:
        kids += [Node(f"Compressed data ({stop - header.end} bytes)", header.end, stop)] + [Node("Block padding", stop, end - check)] * (stop < end - check)
        kids += [_sum(v, kind, end - check, end)] if check else []
    return Node(f"Block {i}", at, end, kids)


def _stream(v: View, at: int, end: int, index: Node, sizes: list[int]) -> list[Node]:
    out, kind = [_header(v, at)], v.data[at + 7] & 15
    for i, n in enumerate(sizes):
        out.append(_block(v, i, out[-1].end, n, kind))
    return [*out, index, _footer(v, end - EDGE)]


def _from_the_start(v: View) -> list[Node]:
    """The first headers, of content whose end does not lead to them."""
    out = [_header(v, 0)]
    try:
        first = _block_header(v, EDGE)
    except Unfit:
        return out + [Node("Unparsed data", EDGE, v.size)] * (EDGE < v.size)
    return [*out, Node("Block 0", EDGE, v.size, [first] + [Node("Unparsed data", first.end, v.size)] * (first.end < v.size))]


def xz(v: View) -> list[Node]:
    if v.size < EDGE:
        return []
    try:
        found = _streams(v)
    except Unfit:
        return _from_the_start(v)
    out, n = [], 0
    for at, end, index, sizes in found:
        if index is None:
            out.append(Node(f"Stream padding ({end - at} bytes)", at, end))
        elif len(found) == 1:
            out += _stream(v, at, end, index, sizes)
        else:
            out.append(Node(f"Stream {n}", at, end, _stream(v, at, end, index, sizes), True))
            n += 1
    return out


WALKERS = {"XZ": xz}
