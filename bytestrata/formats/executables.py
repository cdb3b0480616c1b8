"""Walkers of executables: ELF, PE, Mach-O."""

from __future__ import annotations

from bytestrata.formats.tree import WHITE, Field, Node, View, hexed, record

# Fixed values of the formats.
ELF_CLASS = {1: "32-bit", 2: "64-bit", None: "unknown"}
ELF_DATA = {1: "little", 2: "big", None: "unknown"}
ELF_ABI = {0: "Unix - System V", 3: "Linux", 6: "Solaris", None: "unknown"}
ELF_TYPE = {1: "relocatable", 2: "executable", 3: "shared object", 4: "core", None: "unknown"}
ELF_MACHINE = {0x03: "x86", 0x28: "ARM", 0x3E: "x86_64", 0xB7: "AArch64", None: "unknown"}
ELF_SEGMENT = {0: "NULL", 1: "LOAD", 2: "DYNAMIC", 3: "INTERP", 4: "NOTE", 5: "SHLIB", 6: "PHDR", 7: "TLS", None: "unknown"}
ELF_SECTION = {
    0: "NULL", 1: "PROGBITS", 2: "SYMTAB", 3: "STRTAB", 4: "RELA", 5: "HASH", 6: "DYNAMIC", 7: "NOTE", 8: "NOBITS", 9: "REL", 10: "SHLIB", 11: "DYNSYM",
    None: "unknown",
}
PE_MACHINE = {0x014C: "I386", 0x0200: "IA64", 0x8664: "AMD64", 0x01C4: "ARMNT", 0xAA64: "ARM64", None: "unknown ({:#06x})"}
PE_MAGIC = {0x10B: "PE32", 0x20B: "PE32+ (64-bit)", None: "unknown ({:#06x})"}
MACHO_CPU = {7: "x86", 0x01000007: "x86_64", 12: "ARM", 0x0100000C: "ARM64", None: "unknown ({})"}
MACHO_FILE = {1: "MH_OBJECT", 2: "MH_EXECUTE", 6: "MH_DYLIB", 9: "MH_DYSYM", None: "unknown ({})"}
MACHO_COMMAND = {
    0x1: "LC_SEGMENT", 0x19: "LC_SEGMENT_64", 0x2: "LC_SYMTAB", 0xC: "LC_LOAD_DYLIB", 0xD: "LC_ID_DYLIB", 0xE: "LC_LOAD_DYLINKER", 0x80000028: "LC_MAIN",
    None: "LC_UNKNOWN ({:#010x})",
}
LARGEST = 2**63 - 1


def _rwx(n: int) -> str:
    return "".join(letter if n & bit else " " for letter, bit in (("R", 4), ("W", 2), ("X", 1)))


def _elf_header(word: int) -> list[Field]:
    return [
        ("Type", 2, ELF_TYPE), ("Machine", 2, ELF_MACHINE), ("Version", 4, {1: "current", None: "{}"}), ("Entry", word, hexed()), ("Program header offset", word, hexed()),
        ("Section header offset", word, hexed()), ("Flags", 4, hexed()), ("Header size", 2, None), ("Program header size", 2, None), ("Program header count", 2, None),
        ("Section header size", 2, None), ("Section header count", 2, None), ("Section header string index", 2, None),
    ]


def _elf_segment(word: int) -> list[Field]:
    kind, flags, align = ("Type", 4, ELF_SEGMENT), ("Flags", 4, _rwx), ("Alignment", word, hexed())
    places = [(name, word, hexed()) for name in ("Offset", "Virtual address", "Physical address", "File size", "Memory size")]
    return [kind, flags, *places, align] if word == 8 else [kind, *places, flags, align]


def _elf_section(word: int) -> list[Field]:
    return [
        ("Name", 4, hexed()), ("Type", 4, ELF_SECTION), ("Flags", word, hexed()), ("Address", word, hexed()), ("Offset", word, hexed()), ("Size", word, hexed()),
        ("Link", 4, None), ("Info", 4, None), ("Address alignment", word, hexed()), ("Entry size", word, hexed()),
    ]


def elf(v: View) -> list[Node]:
    """Tables are as large as the header says, so that they may end beyond the data."""
    if v.size < 16:
        return []
    first, _ = record(v, 4, [("Class", 1, ELF_CLASS), ("Endianness", 1, ELF_DATA), ("Version", 1, None), ("OS/ABI", 1, ELF_ABI)], "little")
    out = [Node("Identification", 0, 16, [Node("Magic number: ELF", 0, 4), *first, Node("Padding", 8, 16)], True)]
    word, order = 8 if v.data[4] == 2 else 4, "big" if v.data[5] == 2 else "little"
    head = record(v, 16, _elf_header(word), order)
    if head is None:
        return out
    kids, values = head
    segments, sections = values[4], values[5]
    seg_size, seg_n, sec_size, sec_n, names = values[8:13]
    out.append(Node(f"Header: {ELF_CLASS.get(v.data[4], ELF_CLASS[None])}", 16, kids[-1].end, kids, True))

    table = []
    for i in range(seg_n):
        one = record(v, segments + i * seg_size, _elf_segment(word), order)
        if one:
            table.append(Node(f"Program header {i}: {ELF_SEGMENT.get(one[1][0], ELF_SEGMENT[None])}", one[0][0].start, one[0][-1].end, one[0]))
    out.append(_table("Program headers", segments, seg_size * seg_n, table))

    strings = v.number(sections + names * sec_size + 8 + 2 * word, word, order) if names < sec_n else None
    table = []
    for i in range(sec_n):
        one = record(v, sections + i * sec_size, _elf_section(word), order)
        if one:
            fields, (at, kind, *_) = one
            name = _c_string(v, strings + at) if strings is not None and at else ""
            fields[0].label = f"Name: {name or '(none)'} (0x{at:x})"
            table.append(Node(f"Section header {i}: {name or ELF_SECTION.get(kind, ELF_SECTION[None])}", fields[0].start, fields[-1].end, fields))
    out.append(_table("Section headers", sections, sec_size * sec_n, table))
    return out


def _table(label: str, at: int, length: int, entries: list[Node]) -> Node:
    return Node(label, min(at, LARGEST), min(at + length, LARGEST), entries)


def _c_string(v: View, at: int) -> str:
    end = v.data.find(b"\0", at)
    return v.text(at, v.size if end < 0 else end)


COFF: list[Field] = [
    ("Machine", 2, PE_MACHINE), ("Number of sections", 2, None), ("Time/date stamp", 4, None), ("Pointer to symbol table", 4, hexed()), ("Number of symbols", 4, None),
    ("Size of optional header", 2, None), ("Characteristics", 2, hexed(4)),
]
PE_SECTION: list[Field] = [
    ("Virtual size", 4, hexed()), ("Virtual address", 4, hexed()), ("Size of raw data", 4, hexed()), ("Pointer to raw data", 4, hexed()), ("Pointer to relocations", 4, hexed()),
    ("Pointer to line numbers", 4, hexed()), ("Number of relocations", 2, None), ("Number of line numbers", 2, None), ("Characteristics", 4, hexed(8)),
]


def pe(v: View) -> list[Node]:
    if v.size < 64:
        return []
    at = v.number(60, 4, "little")
    out = [Node("DOS header", 0, 64, [Node("Signature: MZ", 0, 2), Node("DOS stub", 2, 60), Node(f"PE header offset: {at}", 60, 64)], True)]
    if v.data[at : at + 4] != b"PE\0\0":
        return out
    out.append(Node("PE signature: PE\\0\\0", at, at + 4))
    coff = record(v, at + 4, COFF, "little")
    if coff is None:
        return out
    out.append(Node("COFF file header", at + 4, at + 24, coff[0], True))
    n, size, at = coff[1][1], coff[1][5], at + 24
    end = min(at + size, v.size)
    if end > at:
        magic = record(v, at, [("Magic", 2, PE_MAGIC)], "little") if end - at >= 2 else None
        kids = magic[0] if magic else []
        rest = at + 2 * len(kids)
        out.append(Node("Optional header", at, end, kids + [Node("Optional header data", rest, end)] * (end > rest)))
    for i in range(n):
        start = at + size + 40 * i
        one = record(v, start + 8, PE_SECTION, "little")
        if one is None:
            break
        name = v.data[start : start + 8].split(b"\0", 1)[0].decode("utf-8", "replace").rstrip(WHITE)
        out.append(Node(f"Section: {name}", start, start + 40, [Node(f"Name: {name}", start, start + 8), *one[0]]))
    return out


MACHO: list[Field] = [
    ("CPU type", -4, MACHO_CPU), ("CPU subtype", -4, None), ("File type", 4, MACHO_FILE), ("Number of load commands", 4, None), ("Size of load commands", 4, None),
    ("Flags", 4, hexed(8)), ("Reserved", 4, hexed(8)),
]


def macho(v: View) -> list[Node]:
    magic = v.number(0, 4, "little")
    wide = magic == 0xFEEDFACF
    head = record(v, 4, MACHO if wide else MACHO[:-1], "little")
    if head is None:
        return []
    kids, values = head
    at = kids[-1].end
    stop = min(v.size, at + values[4])
    out = [Node("Mach header", 0, at, [Node(f"Magic: 0x{magic:08x}", 0, 4), Node(f"64-bit: {str(wide).lower()}", 0, 4), *kids], True)]
    for _ in range(values[3]):
        one = record(v, at, [("Command", 4, MACHO_COMMAND), ("Command size", 4, None)], "little") if at + 8 <= stop else None
        if one is None or one[1][1] < 8 or at + one[1][1] > v.size:
            break
        kids, (command, size) = one
        label = kids[0].label.replace("Command", "Load command", 1)
        if command == 0x19 and at + 24 <= v.size:
            name = v.data[at + 8 : at + 24].split(b"\0", 1)[0].decode("utf-8", "replace")
            kids.append(Node(f"Segment name: {name}", at + 8, at + 24))
            label += f" ({name})"
        out.append(Node(label, at, at + size, kids))
        at += size
    return out


WALKERS = {"ELF": elf, "PE": pe, "Mach-O": macho}
