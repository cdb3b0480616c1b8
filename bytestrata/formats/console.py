"""Walker of NRO, executables of a game console with an optional section of assets."""

from __future__ import annotations

import struct

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
HEADER, MODULE, ASSETS = 0x80, 0x1C, 0x38
SEGMENTS = {".text": 0x20, ".ro": 0x28, ".data": 0x30}
PARTS = {".apiInfo": 0x68, ".dynstr": 0x70, ".dynsym": 0x78}
MODULE_FIELDS = ["Dynamic offset", "BSS start offset", "BSS end offset", "eh_frame_hdr start offset", "eh_frame_hdr end offset", "Module object offset"]
CONTROL, NAME, PUBLISHER, VERSION, VERSION_SIZE = 0x4000, 0x200, 0x100, 0x3060, 0x10


def _words(v: View, at: int, n: int) -> tuple[int, ...]:
    return struct.unpack_from(f"<{n}I", v.data, at)


def _pair(v: View, name: str, at: int, first: str) -> Node:
    a, b = _words(v, at, 2)
    return Node(f"{name} segment header", at, at + 8, [Node(f"{first}: {a:#x}", at, at + 4), Node(f"Size: {b:#x}", at + 4, at + 8)])


def _header(v: View) -> Node:
    version, total, flags = _words(v, 0x14, 3)
    bss, handle = _words(v, 0x38, 1)[0], _words(v, 0x60, 1)[0]
    kids = [Node("Magic: NRO0", 16, 20), Node(f"Version: {version}", 20, 24), Node(f"Total size: {total:#x}", 24, 28), Node(f"Flags: {flags:#x}", 28, 32)]
    kids += [_pair(v, name, at, "Memory offset") for name, at in SEGMENTS.items()]
    kids += [Node(f"BSS size: {bss:#x}", 0x38, 0x3C), Node("Reserved", 0x3C, 0x40), Node(f"Module ID: {v.data[0x40:0x60].hex()}", 0x40, 0x60)]
    kids += [Node(f"DSO handle offset: {handle:#x}", 0x60, 0x64), Node("Reserved", 0x64, 0x68), *(_pair(v, name, at, "Offset (from .ro)") for name, at in PARTS.items())]
    return Node("NRO header", 16, HEADER, kids, True)


def _module(v: View, at: int) -> list[Node]:
    if v.data[at : at + 4] != b"MOD0":
        return []
    kids = [Node("Magic: MOD0", at, at + 4)]
    for place, name in enumerate(MODULE_FIELDS, 1):
        n = v.number(at + 4 * place, 4, "little", True)
        if n is None:
            break
        kids.append(Node(f"{name}: {n:+#x} (-> {at + n & (1 << 64) - 1:#x})", at + 4 * place, at + 4 * place + 4))
    return [Node("MOD0 header", at, min(at + MODULE, v.size), kids, True)]


def _segment(v: View, name: str, head: int) -> list[Node]:
    at, size = _words(v, head, 2)
    if not size or at >= v.size:
        return []
    end, kids = min(at + size, v.size), []
    if name == ".ro":
        for part, where in PARTS.items():
            start, n = _words(v, where, 2)
            if n and at + start < end:
                kids.append(Node(f"{part} ({n} bytes)", at + start, min(at + start + n, end)))
    return [Node(f"{name} segment ({size} bytes)", at, end, kids or None)]


def _text(v: View, at: int, n: int) -> str:
    return v.data[at : at + n].split(b"\0", 1)[0].decode("utf-8", "replace")


def _control(v: View, at: int, end: int, size: int) -> Node:
    """Title, publisher and version that a menu shows."""
    label = f"NACP ({size} bytes)"
    if end - at < CONTROL:
        return Node(label, at, end)
    split, last = at + NAME, at + NAME + PUBLISHER
    title = [Node(f"Name: {_text(v, at, NAME)}", at, split), Node(f"Publisher: {_text(v, split, PUBLISHER)}", split, last)]
    version = Node(f"Display version: {_text(v, at + VERSION, VERSION_SIZE)}", at + VERSION, at + VERSION + VERSION_SIZE)
    return Node(label, at, end, [Node("Title entry 0", at, last, title, True), version], True)


def _assets(v: View, at: int) -> list[Node]:
    if v.data[at : at + 4] != b"ASET":
        return []
    head, content = [Node("Magic: ASET", at, at + 4)], []
    if at + 8 <= v.size:
        head.append(Node(f"Version: {_words(v, at + 4, 1)[0]}", at + 4, at + 8))
    for entry, name in zip(range(at + 8, at + ASSETS, 16), ("Icon", "NACP", "RomFS"), strict=True):
        if entry + 16 > v.size:
            break
        offset, size = struct.unpack_from("<QQ", v.data, entry)
        head.append(Node(f"{name} entry", entry, entry + 16, [Node(f"Offset: {offset:#x}", entry, entry + 8), Node(f"Size: {size:#x}", entry + 8, entry + 16)]))
        start, end = at + offset, min(at + offset + size, v.size)
        if size and start < v.size:
            content.append(_control(v, start, end, size) if name == "NACP" else Node(f"{name} ({'JPEG, ' * (name == 'Icon')}{size} bytes)", start, end))
    kids = [Node("ASET header", at, min(at + ASSETS, v.size), head, True), *content]
    return [Node("Asset section (ASET)", at, max(k.end for k in kids), kids, True)]


def nro(v: View) -> list[Node]:
    if v.size < 16:
        return []
    (module,) = _words(v, 4, 1)
    out = [Node("Start header", 0, 16, [Node("Unused", 0, 4), Node(f"MOD0 offset: {module:#x}", 4, 8), Node("Padding", 8, 16)], True)]
    if v.size < HEADER:
        return out
    out.append(_header(v))
    out += _module(v, module) if module else []
    for name, head in SEGMENTS.items():
        out += _segment(v, name, head)
    (total,) = _words(v, 0x18, 1)
    return out + (_assets(v, total) or [Node("Trailing data", total, v.size)] * (total < v.size))


WALKERS = {"NRO": nro}
