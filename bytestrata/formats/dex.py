"""Walker of DEX: tables of fixed entries that name each other by number, and the strings that they end in."""

from __future__ import annotations

import re
from collections.abc import Callable

from bytestrata.formats.tree import Node, View, escaped

# Fixed values of the format.
HEADER, NONE, SHOWN, PARAMETERS, CHARS = 0x70, 0xFFFFFFFF, 200_000, 255, 80
ENDIAN = {0x12345678: "little-endian", 0x78563412: "big-endian (reverse)"}
REVERSED = 0x78563412
TABLES = {"string_ids": (56, 4), "type_ids": (64, 4), "proto_ids": (72, 12), "field_ids": (80, 8), "method_ids": (88, 8), "class_defs": (96, 32)}
ACCESS = {
    0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x200: "interface", 0x400: "abstract", 0x1000: "synthetic", 0x2000: "annotation",
    0x4000: "enum",
}
MAPPED = {
    0x0000: "header_item", 0x0001: "string_id_item", 0x0002: "type_id_item", 0x0003: "proto_id_item", 0x0004: "field_id_item", 0x0005: "method_id_item",
    0x0006: "class_def_item", 0x0007: "call_site_id_item", 0x0008: "method_handle_item", 0x1000: "map_list", 0x1001: "type_list", 0x1002: "annotation_set_ref_list",
    0x1003: "annotation_set_item", 0x2000: "class_data_item", 0x2001: "code_item", 0x2002: "string_data_item", 0x2003: "debug_info_item", 0x2004: "annotation_item",
    0x2005: "encoded_array_item", 0x2006: "annotations_directory_item", 0xF000: "hiddenapi_class_data_item",
}
#: One character of modified UTF-8: one, two or three bytes; any other byte by itself.
UNIT = re.compile(rb"[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\x80-\xff]")


def modified_utf8(raw: bytes) -> str:
    """Text whose characters beyond 16 bits are surrogate pairs, and whose NUL has two bytes."""
    if raw.isascii():
        return raw.decode("ascii")
    units = bytearray()
    for unit in UNIT.findall(raw):
        n = 0xFFFD
        if len(unit) > 1 or unit < b"\x80":
            n = unit[0] & (0x7F, 0x1F, 0x0F)[len(unit) - 1]
            for x in unit[1:]:
                n = n << 6 | x & 0x3F
        units += n.to_bytes(2, "little")
    return units.decode("utf-16-le", "replace")


def _short(text: str) -> str:
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _quoted(text: str) -> str:
    return '"' + _short(escaped(text, False).replace("'", "\\'")) + '"'


class _Dex:
    def __init__(self, v: View):
        self.v, self.order = v, "big" if v.number(40, 4, "little") == REVERSED else "little"
        self.places = {name: (self.word(at) or 0, self.word(at + 4) or 0) for name, (at, _) in TABLES.items()}
        count, at = self.fits("string_ids"), self.places["string_ids"][1]
        self.strings = [self.string(self.word(at + 4 * i)) for i in range(count)]

    def word(self, at: int, width: int = 4) -> int | None:
        return self.v.number(at, width, self.order)

    def known(self, at: int, width: int = 4, other: int = 0) -> int:
        n = self.word(at, width)
        return other if n is None else n

    def room(self, size: int, at: int, width: int) -> int:
        return 0 if at >= self.v.size else min((self.v.size - at) // width, size, SHOWN)

    def fits(self, table: str) -> int:
        """Entries of a table that are shown: those that lie whole in the content."""
        size, at = self.places[table]
        return self.room(size, at, TABLES[table][1])

    def string(self, at: int | None) -> tuple[int, int, str] | None:
        """(start, end, text) behind a length in up to five bytes."""
        if at is None:
            return None
        head = next((i + 1 for i in range(5) if at + i < self.v.size and self.v.data[at + i] < 128 and all(x > 127 for x in self.v.data[at : at + i])), None)
        end = self.v.data.find(b"\0", at + head) if head else -1
        return None if end < 0 else (at, end + 1, modified_utf8(self.v.data[at + head : end]))

    def text(self, i: int) -> str | None:
        found = self.strings[i] if i < len(self.strings) else None
        return found and found[2]

    def quoted(self, i: int) -> str:
        text = self.text(i)
        return "(invalid)" if text is None else _quoted(text)

    def type(self, i: int) -> str:
        size, at = self.places["type_ids"]
        name = self.word(at + 4 * i) if i < size else None
        text = None if name is None else self.text(name)
        return f"<type {i}>" if text is None else text

    def parameters(self, at: int) -> str | None:
        if not at:
            return ""
        n = self.word(at)
        if n is None:
            return None
        types = [self.word(at + 4 + 2 * i, 2) for i in range(min(n, PARAMETERS))]
        return None if None in types else "".join(map(self.type, types)) + "..." * (n > PARAMETERS)

    def signature(self, i: int) -> str:
        size, at = self.places["proto_ids"]
        result, listed = (self.word(at + 12 * i + 4), self.word(at + 12 * i + 8)) if i < size else (None, None)
        if result is None or listed is None:
            return f"<proto {i}>"
        given = self.parameters(listed)
        return f"({'?' if given is None else given}){self.type(result)}"

    def table(self, name: str, entry: Callable[[int, int], Node]) -> list[Node]:
        (size, at), width = self.places[name], TABLES[name][1]
        if not size or not at or at >= self.v.size:
            return []
        end, count = min(at + size * width, self.v.size), self.fits(name)
        kids, shown = [entry(i, at + i * width) for i in range(count)], at + count * width
        kids += [Node(f"({size - count} more entries not shown)", shown, end)] * (count < size and shown < end)
        return [Node(f"{name} ({size} entries)", at, end, kids)]

    def string_id(self, i: int, at: int) -> Node:
        return Node(f"string_ids[{i}]: 0x{self.known(at):X} {self.quoted(i)}", at, at + 4)

    def type_id(self, i: int, at: int) -> Node:
        n = self.known(at, other=NONE)
        return Node(f"type_ids[{i}]: string {n} {self.quoted(n)}", at, at + 4)

    def proto_id(self, i: int, at: int) -> Node:
        short, result, listed = self.known(at, other=NONE), self.known(at + 4, other=NONE), self.known(at + 8)
        kids = [Node(f"Shorty: string {short} {self.quoted(short)}", at, at + 4), Node(f"Return type: type {result} ({self.type(result)})", at + 4, at + 8)]
        return Node(f"proto_ids[{i}]: {_short(self.signature(i))}", at, at + 12, [*kids, Node(f"Parameters offset: 0x{listed:X}", at + 8, at + 12)])

    def member(self, table: str, i: int, at: int) -> Node:
        owner, kind, name = self.known(at, 2), self.known(at + 2, 2), self.known(at + 4, other=NONE)
        text, field = self.text(name), table == "field_ids"
        what = self.type(kind) if field else self.signature(kind)
        label = f"{self.type(owner)}->{'?' if text is None else text}{':' * field}{what}"
        second = f"Type: type {kind} ({what})" if field else f"Proto: proto {kind} {_short(what)}"
        kids = [Node(f"Class: type {owner} ({self.type(owner)})", at, at + 2), Node(second, at + 2, at + 4), Node(f"Name: string {name} {self.quoted(name)}", at + 4, at + 8)]
        return Node(f"{table}[{i}]: {_short(label)}", at, at + 8, kids)

    def class_def(self, i: int, at: int) -> Node:
        own, flags, base, interfaces, source, notes, data, values = (self.known(at + 4 * k) for k in range(8))
        access = " ".join(name for bit, name in ACCESS.items() if flags & bit) or "none"
        lines = [
            f"Class: type {own} ({self.type(own)})", f"Access flags: 0x{flags:X} ({access})",
            "Superclass: NO_INDEX" if base == NONE else f"Superclass: type {base} ({self.type(base)})", f"Interfaces offset: 0x{interfaces:X}",
            "Source file: NO_INDEX" if source == NONE else f"Source file: string {source} {self.quoted(source)}", f"Annotations offset: 0x{notes:X}",
            f"Class data offset: 0x{data:X}", f"Static values offset: 0x{values:X}",
        ]
        return Node(f"class_defs[{i}]: {_short(self.type(own))}", at, at + 32, [Node(x, at + 4 * k, at + 4 * k + 4) for k, x in enumerate(lines)])

    def string_data(self) -> list[Node]:
        """Each place once, by its first string."""
        first: dict[int, tuple[int, int, str]] = {}
        for i, found in enumerate(self.strings):
            if found:
                first.setdefault(found[0], (i, found[1], found[2]))
        kids = [Node(f"string_data[{i}]: {_quoted(text)}", at, end) for at, (i, end, text) in sorted(first.items())]
        return [Node(f"String data ({len(self.strings)} strings)", kids[0].start, max(k.end for k in kids), kids)] if kids else []

    def map(self) -> list[Node]:
        at = self.known(52)
        size = self.word(at) if at else None
        if size is None:
            return []
        kids, count = [Node(f"Size: {size}", at, at + 4)], self.room(size, at + 4, 12)
        for p in range(at + 4, at + 4 + 12 * count, 12):
            kind, n, place = self.known(p, 2), self.known(p + 4), self.known(p + 8)
            name = MAPPED.get(kind, "unknown")
            parts = [(f"Type: 0x{kind:04X} ({name})", 0, 2), ("Unused", 2, 4), (f"Size: {n}", 4, 8), (f"Offset: 0x{place:X}", 8, 12)]
            kids.append(Node(f"{name}: {n} at 0x{place:X}", p, p + 12, [Node(x, p + a, p + b) for x, a, b in parts]))
        return [Node("Map list", at, at + 4 + 12 * count, kids, True)]

    def header(self) -> Node:
        v, version = self.v, self.v.text(4, 7)
        lines: list[tuple[str, Callable[[int], str], int]] = [("Checksum (Adler-32)", lambda n: f"0x{n:08X}", 8), ("", str, 12)]
        lines += [("File size", lambda n: str(n) + f" (actual {v.size})" * (n != v.size), 32), ("Header size", str, 36), ("", str, 40)]
        pairs = [("Link", 44), ("", 52), *((name, at) for name, (at, _) in TABLES.items()), ("Data", 104)]
        for name, at in pairs:
            if name:
                lines += [(f"{name} size", str, at), (f"{name} offset", lambda n: f"0x{n:X}", at + 4)]
            else:
                lines.append(("Map offset", lambda n: f"0x{n:X}", at))
        size = self.word(36)
        if size is not None and size >= 0x78:
            lines += [("Container size", str, 0x70), ("Header offset", lambda n: f"0x{n:X}", 0x74)]
        kids = [Node(f"Magic: dex\\n{version}\\0 (version {version})", 0, 8)]
        for name, how, at in lines:
            n = self.word(at)
            if at == 12:
                kids += [Node(f"Signature (SHA-1): {v.data[12:32].hex()}", 12, 32)] * (v.size >= 32)
            elif at == 40 and n is not None:
                tag = v.number(40, 4, "little")
                kids.append(Node(f"Endian tag: 0x{tag:08X} ({ENDIAN.get(tag, 'unknown')})", 40, 44))
            elif n is not None:
                kids.append(Node(f"{name}: {how(n)}", at, at + 4))
        return Node("DEX header", 0, min(max(size or HEADER, HEADER), v.size), kids, True)


def dex(v: View) -> list[Node]:
    if not re.match(rb"dex\n[0-9]{3}\0", v.data[:8]):
        return []
    d = _Dex(v)
    out = [d.header()]
    if v.size < HEADER:
        return out
    entries = {
        "string_ids": d.string_id, "type_ids": d.type_id, "proto_ids": d.proto_id, "field_ids": lambda i, at: d.member("field_ids", i, at),
        "method_ids": lambda i, at: d.member("method_ids", i, at), "class_defs": d.class_def,
    }
    for name, entry in entries.items():
        out += d.table(name, entry)
    found, size, at = d.string_data() + d.map(), d.known(104), d.known(108)
    end = min(at + size, v.size)
    if size and at < v.size:
        held = sorted((x for x in found if at <= x.start and x.end <= end), key=lambda x: x.start)
        out.append(Node(f"Data ({end - at} bytes)", at, end, held or None))
        found = [x for x in found if x not in held]
    out += found
    size, at = d.known(44), d.known(48)
    return out + [Node(f"Link data ({min(at + size, v.size) - at} bytes)", at, min(at + size, v.size))] * (size > 0 and at < v.size)


WALKERS = {"DEX": dex}
