"""Walker of TE images: what lies inside a section's data is shown under it."""

from __future__ import annotations

import struct

from bytestrata.formats.tree import WHITE, Node, View

# Fixed values of the format.
HEADER, SECTION, ENTRY = 40, 40, 28
BLOCKS_SHOWN, RELOCATIONS_SHOWN, ENTRIES_SHOWN, CODEVIEW = 512, 64, 16, 2
MACHINES = {
    0x014C: "I386 (IA32)", 0x8664: "AMD64 (x64)", 0x0200: "IA64", 0x01C2: "ARM Thumb (mixed)", 0x01C4: "ARMNT", 0xAA64: "ARM64 (AArch64)", 0x0EBC: "EBC",
    0x5032: "RISCV32", 0x5064: "RISCV64", 0x5128: "RISCV128", 0x6232: "LOONGARCH32", 0x6264: "LOONGARCH64",
}
SUBSYSTEMS = {
    0: "UNKNOWN", 1: "NATIVE", 2: "WINDOWS_GUI", 3: "WINDOWS_CUI", 5: "OS2_CUI", 7: "POSIX_CUI", 9: "WINDOWS_CE_GUI", 10: "EFI application",
    11: "EFI boot service driver", 12: "EFI runtime driver", 13: "EFI SAL runtime driver", 14: "XBOX", 16: "WINDOWS_BOOT_APPLICATION",
}
FLAGS = {
    0x00000008: "TYPE_NO_PAD", 0x00000020: "CNT_CODE", 0x00000040: "CNT_INITIALIZED_DATA", 0x00000080: "CNT_UNINITIALIZED_DATA", 0x00000200: "LNK_INFO",
    0x00000800: "LNK_REMOVE", 0x00001000: "LNK_COMDAT", 0x00008000: "GPREL", 0x01000000: "LNK_NRELOC_OVFL", 0x02000000: "MEM_DISCARDABLE",
    0x04000000: "MEM_NOT_CACHED", 0x08000000: "MEM_NOT_PAGED", 0x10000000: "MEM_SHARED", 0x20000000: "MEM_EXECUTE", 0x40000000: "MEM_READ", 0x80000000: "MEM_WRITE",
}
ARM, RISCV = (0x01C2, 0x01C4), (0x5032, 0x5064, 0x5128)
RELOCATIONS = {0: "ABSOLUTE", 1: "HIGH", 2: "LOW", 3: "HIGHLOW", 4: "HIGHADJ", 5: "MIPS_JMPADDR", 9: "MIPS_JMPADDR16", 10: "DIR64"}
#: Kinds of relocation that a machine has names of its own for.
OWN_RELOCATIONS = (
    {(m, 5): "ARM_MOV32" for m in ARM} | {(m, 7): "THUMB_MOV32" for m in ARM} | {(m, 5): "RISCV_HIGH20" for m in RISCV} | {(m, 7): "RISCV_LOW12I" for m in RISCV}
    | {(m, 8): "RISCV_LOW12S" for m in RISCV} | {(0x6232, 8): "LOONGARCH32_MARK_LA", (0x6264, 8): "LOONGARCH64_MARK_LA", (0x0200, 9): "IA64_IMM64"}
)
DEBUG = {
    0: "UNKNOWN", 1: "COFF", 2: "CODEVIEW", 3: "FPO", 4: "MISC", 5: "EXCEPTION", 6: "FIXUP", 7: "OMAP_TO_SRC", 8: "OMAP_FROM_SRC", 9: "BORLAND", 11: "CLSID",
    12: "VC_FEATURE", 13: "POGO", 14: "ILTCG", 15: "MPX", 16: "REPRO", 20: "EX_DLLCHARACTERISTICS",
}
#: Fields of a section's header behind its name: label, bytes, format.
FIELDS = [
    ("Virtual size", 4, "#x"), ("Virtual address", 4, "#x"), ("Size of raw data", 4, "#x"), ("Pointer to raw data", 4, "#x"), ("Pointer to relocations", 4, "#x"),
    ("Pointer to line numbers", 4, "#x"), ("Number of relocations", 2, "d"), ("Number of line numbers", 2, "d"),
]
ENTRY_FIELDS = [("Characteristics", 4, "#x"), ("Time/date stamp", 4, "d"), ("Major version", 2, "d"), ("Minor version", 2, "d"), ("Type", 4, None), ("Size of data", 4, "d"), ("RVA", 4, "#x"), ("Pointer to raw data", 4, "#x")]


def _leaves(values, layout: list, at: int) -> list[Node]:
    out = []
    for (name, width, how), x in zip(layout, values, strict=True):
        out.append(Node(f"{name}: {x if how is None else format(x, how)}", at, at + width))
        at += width
    return out


class _Section:
    def __init__(self, v: View, at: int, moved: int):
        self.at = at
        self.name = v.data[at : at + 8].split(b"\0", 1)[0].decode("utf-8", "replace").rstrip(WHITE)
        self.values = struct.unpack_from("<6IHHI", v.data, at + 8)
        size, self.address, raw, place, *_ = self.values
        self.span, start = max(size, raw), place + moved
        self.data = Node(f"Section data: {self.name}", start, min(start + raw, v.size), []) if raw and 0 <= start < v.size else None

    def node(self) -> Node:
        flags = self.values[8]
        names = [name for bit, name in FLAGS.items() if flags & bit] + [f"ALIGN_{1 << n - 1}BYTES" for n in [flags >> 20 & 15] if 1 <= n <= 14]
        told = f"Characteristics: {flags:#010x}" + (f" ({' | '.join(names)})" if names else "")
        kids = [Node(f"Name: {self.name}", self.at, self.at + 8), *_leaves(self.values[:8], FIELDS, self.at + 8), Node(told, self.at + 36, self.at + 40)]
        return Node(f"Section: {self.name}", self.at, self.at + SECTION, kids)


class _Terse:
    def __init__(self, v: View):
        self.v = v
        self.machine, self.count, self.subsystem, self.stripped, self.entry, self.code, self.base, *places = struct.unpack_from("<HBBHIIQ4I", v.data, 2)
        self.relocations, self.debug = places[:2], places[2:]
        whole = min(self.count, (v.size - HEADER) // SECTION)
        self.sections = [_Section(v, HEADER + i * SECTION, HEADER - self.stripped) for i in range(whole)]

    def place(self, address: int) -> int | None:
        """Where an address of the whole image lies here."""
        at = address + HEADER - self.stripped
        return at if at >= 0 else None

    def owner(self, address: int) -> str:
        return next((f" in {s.name}" for s in self.sections if s.address <= address < s.address + s.span), "")

    def directory(self, name: str, at: int, address: int, size: int) -> Node:
        place = self.place(address)
        told = " (before start of file)" if place is None else f" at file offset {place:#x}"
        told = told if address or size else " (none)"
        return Node(name + told, at, at + 8, [Node(f"Virtual address: {address:#x}", at, at + 4), Node(f"Size: {size}", at + 4, at + 8)])

    def header(self) -> Node:
        place = self.place(self.entry)
        entry = f"{self.entry:#x}{self.owner(self.entry)}" + ("" if place is None else f", file offset {place:#x}")
        parts = [
            ("Signature: VZ", 0, 2), (f"Machine: {MACHINES.get(self.machine, f'unknown ({self.machine:#06x})')}", 2, 4), (f"Number of sections: {self.count}", 4, 5),
            (f"Subsystem: {SUBSYSTEMS.get(self.subsystem, f'unknown ({self.subsystem})')}", 5, 6), (f"Stripped size: {self.stripped:#x}", 6, 8),
            (f"Address of entry point: {entry}", 8, 12), (f"Base of code: {self.code:#x}", 12, 16), (f"Image base: {self.base:#x}", 16, 24),
        ]
        tables = [self.directory("Base relocation directory", 24, *self.relocations), self.directory("Debug directory", 32, *self.debug)]
        return Node("TE header", 0, HEADER, [*(Node(*x) for x in parts), *tables], True)

    def entry_point(self) -> list[Node]:
        place = self.place(self.entry)
        return [] if place is None or place >= self.v.size else [Node(f"Entry point: {self.entry:#x}{self.owner(self.entry)}", place, place + 1)]

    def table(self, address: int, size: int) -> tuple[int, int] | None:
        """Place of a table; None where it has none in the content."""
        start = self.place(address)
        return None if not size or start is None or start >= self.v.size else (start, min(start + size, self.v.size))

    def relocation_blocks(self) -> list[Node]:
        found = self.table(*self.relocations)
        if not found:
            return []
        at, end = found
        kids: list[Node] = []
        while at + 8 <= end and len(kids) < BLOCKS_SHOWN:
            page, size = struct.unpack_from("<II", self.v.data, at)
            if size < 8:
                break
            kids.append(self.relocation_block(at, min(at + size, end), page, size))
            at = kids[-1].end
        kids += [Node("More relocation blocks", at, end)] * (at < end and len(kids) >= BLOCKS_SHOWN)
        return [Node(f"Base relocations ({len(kids)} blocks)", *found, kids)]

    def relocation_block(self, at: int, end: int, page: int, size: int) -> Node:
        n = (end - at - 8) // 2
        kids, first = [Node(f"Page RVA: {page:#x}", at, at + 4), Node(f"Block size: {size}", at + 4, at + 8)], at + 8
        shown = min(n, RELOCATIONS_SHOWN)
        for p, x in zip(range(first, first + 2 * shown, 2), struct.unpack_from(f"<{shown}H", self.v.data, first), strict=True):
            kind = x >> 12
            name = OWN_RELOCATIONS.get((self.machine, kind)) or RELOCATIONS.get(kind, f"type {kind}")
            kids.append(Node(f"{name} at {page + (x & 0xFFF) & 0xFFFFFFFF:#x}", p, p + 2))
        kids += [Node(f"... {n - shown} more entries", first + 2 * shown, end)] * (n > shown)
        return Node(f"Relocation block: page {page:#x} ({(size - 8) // 2} entries)", at, end, kids)

    def debug_blocks(self) -> list[Node]:
        found = self.table(*self.debug)
        if not found:
            return []
        entries, records = [], []
        for at in range(found[0], found[1] - ENTRY + 1, ENTRY)[:ENTRIES_SHOWN]:
            *head, kind, size, address, pointer = struct.unpack_from("<IIHHIIII", self.v.data, at)
            name = DEBUG.get(kind, f"unknown ({kind})")
            start = self.place(pointer or address) if kind == CODEVIEW and size else None
            record, path = (None, None) if start is None else self.codeview(start, min(start + size, self.v.size))
            label = f"Debug entry: {name}" + ("" if path is None else f" ({path})")
            entries.append(Node(label, at, at + ENTRY, _leaves([*head, name, size, address, pointer], ENTRY_FIELDS, at)))
            records += [record] if record else []
        return [Node("Debug directory", *found, entries, True), *records]

    def codeview(self, at: int, end: int) -> tuple[Node | None, str | None]:
        """(record, path that it names)."""
        if at + 4 > end:
            return None, None
        raw, sign = self.v.data[at:end], self.v.text(at, at + 4)
        parts = [(f"Signature: {sign}", 0, 4)]
        word = lambda p: int.from_bytes(raw[p : p + 4], "little")
        size = {b"RSDS": 24, b"NB10": 16, b"MTOC": 20}.get(raw[:4])
        if size is None:
            return Node(f"CodeView record ({sign})", at, end, [Node(x, at + a, at + b) for x, a, b in parts]), None
        if len(raw) < size:
            return None, None
        if size == 24:
            parts += [(f"GUID: {_dashed(raw[7:3:-1] + raw[9:7:-1] + raw[11:9:-1] + raw[12:20])}", 4, 20), (f"Age: {word(20)}", 20, 24)]
        elif size == 16:
            parts += [(f"Offset: {word(4)}", 4, 8), (f"Time/date stamp: {word(8)}", 8, 12), (f"Age: {word(12)}", 12, 16)]
        else:
            parts.append((f"UUID: {_dashed(raw[4:20])}", 4, 20))
        path = None
        if len(raw) > size:
            text = raw[size:].split(b"\0", 1)[0]
            path = text.decode("utf-8", "replace")
            parts.append((f"PDB path: {path}", size, min(size + len(text) + 1, len(raw))))
        return Node(f"CodeView record ({sign})", at, end, [Node(x, at + a, at + b) for x, a, b in parts], True), path


def _dashed(raw: bytes) -> str:
    digits = raw.hex().upper()
    return "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))


def terse(v: View) -> list[Node]:
    if v.size < HEADER or v.data[:2] != b"VZ":
        return []
    t = _Terse(v)
    out, held, loose = [t.header()], [s.data for s in t.sections if s.data], []
    if t.sections:
        out.append(Node(f"Section headers ({len(t.sections)})", HEADER, HEADER + SECTION * len(t.sections), [s.node() for s in t.sections], True))
    for node in t.entry_point() + t.relocation_blocks() + t.debug_blocks():
        home = next((s for s in held if s.start <= node.start and node.end <= s.end), None)
        (home.kids if home else loose).append(node)
    for s in held:
        s.kids = sorted(s.kids, key=lambda n: n.start) or None
    return out + sorted(held + loose, key=lambda n: n.start)


WALKERS = {"TE": terse}
