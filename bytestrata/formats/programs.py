"""Walkers of Atari ST programs and DOS COM images."""

from __future__ import annotations

import re
import struct

from bytestrata.formats.tree import Node, View

# Fixed values of the formats.
ATARI_PROTECTION = ["private", "global", "super", "readable"]
ATARI_SYMBOL_BITS = {
    0x8000: "defined", 0x4000: "equated", 0x2000: "global", 0x1000: "equated register", 0x0800: "external ref", 0x0400: "data based",
    0x0200: "text based", 0x0100: "BSS based",
}
MINT_STUB = bytes([0x28, 0x3A, 0x00, 0x1A, 0x4E, 0xFB, 0x48, 0xFA])
LONG_NAME = 0x48
SYMBOLS_SHOWN = FIXUPS_SHOWN = 256
WORD_REGISTERS = ["AX", "CX", "DX", "BX", "SP", "BP", "SI", "DI"]
BYTE_REGISTERS = ["AL", "CL", "DL", "BL", "AH", "CH", "DH", "BH"]
SEGMENT_REGISTERS = ["ES", "CS", "SS", "DS"]
SHORT_ENTRIES = {0x0E: "PUSH CS", 0x1E: "PUSH DS", 0xFA: "CLI", 0xFC: "CLD"}
DOS_FUNCTIONS = {
    0x00: "terminate program", 0x01: "read char with echo", 0x02: "write char", 0x06: "direct console I/O", 0x07: "direct char input",
    0x08: "char input without echo", 0x09: "print string", 0x0A: "buffered input", 0x0B: "check input status", 0x0C: "flush buffer and read",
    0x0E: "select disk", 0x19: "get current drive", 0x1A: "set DTA", 0x25: "set interrupt vector", 0x2A: "get date", 0x2C: "get time",
    0x30: "get DOS version", 0x31: "terminate and stay resident", 0x35: "get interrupt vector", 0x36: "get free disk space", 0x39: "create directory",
    0x3A: "remove directory", 0x3B: "change directory", 0x3C: "create file", 0x3D: "open file", 0x3E: "close file", 0x3F: "read file",
    0x40: "write file", 0x41: "delete file", 0x42: "seek", 0x43: "get/set attributes", 0x44: "IOCTL", 0x47: "get current directory",
    0x48: "allocate memory", 0x49: "free memory", 0x4A: "resize memory", 0x4B: "exec", 0x4C: "exit", 0x4D: "get return code", 0x4E: "find first",
    0x4F: "find next", 0x56: "rename file", 0x57: "get/set file date",
}
CALLS_SHOWN = 64


def atari(v: View) -> list[Node]:
    if v.size < 28:
        return []
    magic, text, data, bss, symbols, reserved, flags, absolute = struct.unpack_from(">HIIIIIIH", v.data)
    yes = lambda bit: "yes" if flags & bit else "no"
    bits = [
        f"Fastload (bit 0): {yes(1)}", f"Load into TT-RAM (bit 1): {yes(2)}", f"Malloc from TT-RAM (bit 2): {yes(4)}",
        f"Memory protection (bits 4-5): {ATARI_PROTECTION[flags >> 4 & 3]}", f"Shared text (bit 11): {yes(0x800)}",
        f"TPA size (bits 28-31): {flags >> 28} ({((flags >> 28) + 1) * 128} KB minimum TT-RAM)",
    ]
    sizes = [("Text size", text, 2), ("Data size", data, 6), ("BSS size", bss, 10), ("Symbol table size", symbols, 14)]
    held = "0 (relocation info present)" if not absolute else f"{absolute} (no relocation info)"
    kids = [Node(f"Magic: 0x{magic:04X} (BRA.S +26)", 0, 2), *(Node(f"{n}: {x}", at, at + 4) for n, x, at in sizes), Node(f"Reserved: 0x{reserved:08X}", 18, 22)]
    kids += [Node(f"Program flags: 0x{flags:08X}", 22, 26, [Node(x, 22, 26) for x in bits]), Node(f"Absolute flag: {held}", 26, 28)]
    out = [Node("GEMDOS program header", 0, 28, kids, True)]
    mint = v.data[28:36] == MINT_STUB
    ends = [28, 28 + text, 28 + text + data, 28 + text + data + symbols]
    a, b, c, d = (min(x, v.size) for x in ends)
    if text and a < v.size:
        out.append(Node(f"Text segment ({text} bytes)", a, b, [Node("MiNT a.out startup stub", 28, 36)] if mint else None))
    if data and ends[1] < v.size:
        out.append(Node(f"Data segment ({data} bytes)", b, c))
    if symbols and ends[2] < v.size:
        out.append(_symbols(v, c, d, symbols, mint))
    end = d
    if not absolute and ends[3] < v.size:
        out.append(_fixups(v, d))
        end = out[-1].end
    return out + [Node(f"Trailing data ({v.size - end} bytes)", end, v.size)] * (end < v.size)


def _plain(raw: bytes) -> str:
    return "".join(chr(x) if 0x20 <= x < 0x7F else "." for x in raw.split(b"\0", 1)[0])


def _symbols(v: View, at: int, end: int, size: int, mint: bool) -> Node:
    if mint or size % 14:
        return Node(f"Symbol table ({'MiNT a.out' if mint else 'unknown'} format, {size} bytes)", at, end)
    start, kids, n, shown = at, [], 0, at
    while at + 14 <= end:
        kind, value = struct.unpack_from(">HI", v.data, at + 8)
        long = kind & LONG_NAME == LONG_NAME
        to = at + 28 if long and at + 28 <= end else at + 14
        n += 1
        if len(kids) < SYMBOLS_SHOWN:
            name = _plain(v.data[at : at + 8]) + _plain(v.data[at + 14 : to])
            names = [x for bit, x in ATARI_SYMBOL_BITS.items() if kind & bit] + ["GST extended name"] * long
            parts = [Node(f"Name: {name}", at, at + 8), Node(f"Type: 0x{kind:04X} ({', '.join(names) or 'none'})", at + 8, at + 10), Node(f"Value: 0x{value:08X}", at + 10, at + 14)]
            parts += [Node("GST extended name continuation", at + 14, to)] * (to > at + 14)
            kids.append(Node(f"{name} = 0x{value:08X}", at, to, parts))
            shown = to
        at = to
    if n > len(kids):
        kids.append(Node(f"... {n - len(kids)} more symbols", shown, end))
    return Node(f"Symbol table (DRI/GST, {n} symbols)", start, end, kids)


def _fixups(v: View, at: int) -> Node:
    """Delta-coded relocations: 1 adds 254 without a fixup, 0 ends them, other odd steps are invalid."""
    first = v.number(at, 4, "big")
    if first is None:
        return Node("Relocation table (truncated)", at, v.size)
    if not first:
        return Node("Relocation table (no fixups)", at, at + 4, [Node("First fixup offset: 0 (none)", at, at + 4)])
    listed, n, target, pos, state = [Node(f"Fixup: text+0x{first:08X}", at, at + 4)], 1, first, at + 4, " [truncated]"
    while pos < v.size:
        step = v.data[pos]
        pos += 1
        if not step or (step % 2 and step != 1):
            state = " [invalid odd delta]" if step else ""
            break
        target += 254 if step == 1 else step
        if step != 1:
            n += 1
            if len(listed) < FIXUPS_SHOWN:
                listed.append(Node(f"Fixup: text+0x{target:08X}", pos - 1, pos))
    label = f"Fixup targets (first {len(listed)} of {n})" if n > len(listed) else f"Fixup targets ({n})"
    kids = [Node(f"First fixup offset: text+0x{first:08X}", at, at + 4)] + [Node(f"Offset byte stream ({pos - at - 4} bytes)", at + 4, pos)] * (pos > at + 4)
    return Node(f"Relocation table ({n} fixups){state}", at, pos, [*kids, Node(label, at, pos, listed)], True)


def entry_point(data: bytes) -> tuple[int, str, int | None] | None:
    """(length, text, place that it jumps to) of the first instruction, where it is of a known form."""
    op, more = data[0], data[1:3]
    word = int.from_bytes(more, "little") if len(more) == 2 else None
    if op in SHORT_ENTRIES:
        return 1, SHORT_ENTRIES[op], None
    if not more:
        return None
    mode = more[0]
    if op == 0xEB:
        to = 2 + mode - 256 * (mode > 127) & 0xFFFF
        return 2, f"JMP SHORT {to + 256 & 0xFFFF:04X}h", to
    if 0xB0 <= op <= 0xB7:
        return 2, f"MOV {BYTE_REGISTERS[op - 0xB0]}, {mode:02X}h", None
    if op in (0x29, 0x2B, 0x31, 0x33) and mode >> 6 == 3 and mode & 7 == mode >> 3 & 7:
        name = WORD_REGISTERS[mode & 7]
        return 2, f"{'XOR' if op & 0xF0 == 0x30 else 'SUB'} {name}, {name}", None
    if op == 0x8C and mode >> 6 == 3 and mode >> 3 & 7 < 4:
        return 2, f"MOV {WORD_REGISTERS[mode & 7]}, {SEGMENT_REGISTERS[mode >> 3 & 7]}", None
    if word is None:
        return None
    if op == 0xE9:
        to = 3 + word & 0xFFFF
        return 3, f"JMP {to + 256 & 0xFFFF:04X}h", to
    if 0xB8 <= op <= 0xBF:
        return 3, f"MOV {WORD_REGISTERS[op - 0xB8]}, {word:04X}h", None
    return None


def dos_com(v: View) -> list[Node]:
    if not v.size:
        return []
    found = entry_point(v.data)
    if found is None:
        kids = [Node(f"Entry (CS:0100): unrecognised or truncated ({v.data[0]:02X}h …)", 0, 1)]
    else:
        n, text, to = found
        kids = [Node(f"Entry (CS:0100): {text}", 0, min(n, v.size))]
        if to is not None and n <= to < v.size:
            kids += [Node(f"Bytes skipped by entry jump ({n + 256:04X}h–{to + 255:04X}h, likely data)", n, to)] * (to > n)
            kids.append(Node(f"Jump target (CS:{to + 256:04X}h) onward, likely code", to, v.size))
        elif to is not None:
            kids.append(Node(f"Jump target CS:{to + 256 & 0xFFFF:04X}h is outside the image", 0, min(n, v.size)))
    sites = [m.start() for m in re.finditer(rb"\xcd(?=\x21)", v.data)]
    calls = [_call(v.data, i) for i in sites[:CALLS_SHOWN]]
    if calls:
        count = f"{len(sites)}, first {CALLS_SHOWN} shown" if len(sites) > CALLS_SHOWN else len(sites)
        kids.append(Node(f"Possible INT 21h calls ({count})", calls[0].start, calls[-1].end, calls))
    return [Node(f"Code/data image ({v.size} bytes, loaded at 0100h–{v.size + 255:04X}h)", 0, v.size, kids, True)]


def _call(data: bytes, at: int) -> Node:
    """A call of DOS, named where the instruction before sets its function."""
    start = at - 2 if at >= 2 and data[at - 2] == 0xB4 else at - 3 if at >= 3 and data[at - 3] == 0xB8 else at
    label = f"{at + 256:04X}h: possible INT 21h"
    if start < at:
        name = DOS_FUNCTIONS.get(data[at - 1])
        label += f", AH={data[at - 1]:02X}h" + (f" ({name})" if name else "")
    return Node(label, start, at + 2)


WALKERS = {"Atari ST program": atari, "DOS COM": dos_com}
