"""Walker of bzip2, whose blocks begin at any bit."""

from __future__ import annotations

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
BLOCK = 0x314159265359
END = 0x177245385090
BLOCKS_SHOWN = 1000

#: The bytes that a marker which begins k bits into a byte is sure to hold whole: (bytes, bits of it before them).
SIGNS = {(m, k): ((m << (8 - k)) >> 8 & (1 << 40) - 1).to_bytes(5, "big") if k else m.to_bytes(6, "big") for m in (BLOCK, END) for k in range(8)}


def bits(data: bytes, at: int, n: int) -> int | None:
    if at + n > 8 * len(data):
        return None
    last = -(-(at + n) // 8)
    return int.from_bytes(data[at // 8 : last], "big") >> (8 * last - at - n) & (1 << n) - 1


def markers(data: bytes) -> list[tuple[int, int]]:
    """(bit, marker) of every marker, at whatever bit it begins, in order."""
    found = []
    for (mark, k), sign in SIGNS.items():
        at = data.find(sign)
        while at >= 0:
            bit = 8 * (at - 1) + k if k else 8 * at
            if bit >= 0 and bits(data, bit, 48) == mark:
                found.append((bit, mark))
            at = data.find(sign, at + 1)
    return sorted(found)


def _streams(data: bytes) -> list[tuple[int, int, list[int], int | None]]:
    """(start, end, blocks' bits, end marker's bit) of each stream; the last may have no end marker."""
    marks, out, at, i = markers(data), [], 0, 0
    while data[at : at + 3] == b"BZh" and data[at + 3 : at + 4] in [b"%d" % k for k in range(1, 10)]:
        least, blocks, last = 8 * (at + 4), [], None
        while i < len(marks) and last is None:
            bit, mark = marks[i]
            i += 1
            if bit >= least:
                least = bit + 48
                if mark == END:
                    last = bit
                else:
                    blocks.append(bit)
        end = len(data) if last is None else min(-(-(last + 80) // 8), len(data))
        out.append((at, end, blocks, last))
        if last is None:
            break
        at = end
    return out


def _place(bit: int) -> str:
    return f" [byte {bit // 8} + {bit % 8} bits]" if bit % 8 else ""


def _leaf(label: str, bit: int, end: int) -> Node:
    return Node(label + _place(bit), bit // 8, -(-end // 8))


def _block(data: bytes, number: int, bit: int, end: int) -> Node:
    kids, at = [_leaf(f"Block magic: 0x{BLOCK:012X} (pi)", bit, bit + 48)], bit + 48
    for width, show in ((32, lambda n: f"Block CRC: 0x{n:08X}"), (1, lambda n: f"Randomised: {'yes (deprecated)' if n else 'no'}"), (24, lambda n: f"origPtr: {n}")):
        n = bits(data, at, width)
        if n is not None and at + width <= end:
            kids.append(_leaf(show(n), at, at + width))
        at += width
    if end > at:
        kids.append(_leaf(f"Compressed data: {end - at} bits", at, end))
    return Node(f"Block {number}{_place(bit)}", bit // 8, -(-end // 8), kids)


def _last(data: bytes, bit: int) -> Node:
    kids, end = [_leaf(f"End-of-stream magic: 0x{END:012X} (sqrt pi)", bit, bit + 48)], bit + 80
    crc, rest = bits(data, bit + 48, 32), -end % 8
    if crc is not None:
        kids.append(_leaf(f"Combined stream CRC: 0x{crc:08X}", bit + 48, end))
        if rest:
            kids.append(_leaf(f"Padding: {rest} bit{'s' * (rest > 1)} (0b{bits(data, end, rest) or 0:0{rest}b})", end, end + rest))
    return Node(f"End of stream{_place(bit)}", bit // 8, min(-(-end // 8), len(data)), kids, True)


def bzip2(v: View) -> list[Node]:
    found, out, left = _streams(v.data), [], BLOCKS_SHOWN
    for k, (start, end, blocks, last) in enumerate(found):
        if not left and k:
            out.append(Node(f"Streams {k + 1}-{len(found)} (not shown)", start, found[-1][1]))
            break
        level = v.data[start + 3] - 48
        parts = [Node("Signature: BZ", start, start + 2), Node("Version: h (Huffman)", start + 2, start + 3), Node(f"Block size: {level} ({level}00 kB)", start + 3, start + 4)]
        kids = [Node("Stream header", start, start + 4, parts, True)]
        ends = [*blocks[1:], 8 * v.size if last is None else last]
        kids += [_block(v.data, i, bit, to) for i, (bit, to) in enumerate(zip(blocks[:left], ends, strict=False), 1)]
        if len(blocks) > left:
            kids.append(Node(f"Blocks {left + 1}-{len(blocks)} (not shown)", blocks[left] // 8, -(-ends[-1] // 8)))
        left -= min(left, len(blocks))
        kids += [] if last is None else [_last(v.data, last)]
        if len(found) == 1:
            out += kids
        else:
            out.append(Node(f"Stream {k + 1} ({len(blocks)} block{'s' * (len(blocks) != 1)})", start, end, kids, k == 0))
    if found and found[-1][1] < v.size:
        out.append(Node("Trailing data", found[-1][1], v.size))
    return out


WALKERS = {"bzip2": bzip2}
