"""Walker of OS/360 object modules: decks of 80-byte cards in EBCDIC, whose section names are carried forward."""

from __future__ import annotations

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
CARD, DATA, DATA_END, ITEM, IDR = 80, 16, 72, 16, 19
CARDS_SHOWN, RELOCATIONS_SHOWN = 4096, 16
KINDS = {b"\xc5\xe2\xc4": "ESD", b"\xe3\xe7\xe3": "TXT", b"\xd9\xd3\xc4": "RLD", b"\xc5\xd5\xc4": "END", b"\xe2\xe8\xd4": "SYM", b"\xe7\xe2\xc4": "XSD"}
SECTION = {
    0x00: "SD", 0x01: "LD", 0x02: "ER", 0x04: "PC", 0x05: "CM", 0x06: "XD/PR", 0x0A: "WX", 0x0D: "SD (quad-aligned)", 0x0E: "PC (quad-aligned)",
    0x0F: "CM (quad-aligned)",
}
ALIGNMENT = {0: "byte", 1: "halfword", 3: "fullword", 7: "doubleword", 15: "quadword"}
ADDRESSING = {2: "31", 3: "ANY"}
RELOCATION = {0: "A", 1: "V", 2: "Q", 3: "CXD"}
WITH_MODES = {0x00, 0x04, 0x05, 0x0D, 0x0E, 0x0F}
UNPLACED = {0x02, 0x0A}
#: Characters of code page 037 that ASCII has, first code and what follows from there.
RUNS = [
    (0x40, " "), (0x4B, ".<(+|&"), (0x5A, "!$*);"), (0x60, "-/"), (0x6B, ",%_>?"), (0x79, "`:#@'=\""), (0x81, "abcdefghi"), (0x91, "jklmnopqr"), (0xA1, "~stuvwxyz"),
    (0xB0, "^"), (0xBA, "[]"), (0xC0, "{ABCDEFGHI"), (0xD0, "}JKLMNOPQR"), (0xE0, "\\"), (0xE2, "STUVWXYZ"), (0xF0, "0123456789"),
]
PAGE = {code + i: c for code, run in RUNS for i, c in enumerate(run)}
BLANKS = b"\x40" * 16


def ebcdic(raw: bytes) -> str:
    return "".join(PAGE.get(x, ".") for x in raw)


def _blank(raw: bytes) -> bool:
    return raw == BLANKS[: len(raw)]


class _Card:
    """One card: its bytes, which may end early, and the leaves made of them."""

    def __init__(self, raw: bytes, at: int, names: dict[int, str]):
        self.raw, self.at, self.names, self.kids = raw, at, names, []

    def part(self, column: int, n: int) -> bytes | None:
        return self.raw[column : column + n] if column + n <= len(self.raw) else None

    def number(self, column: int, n: int) -> int:
        return int.from_bytes(self.raw[column : column + n], "big")

    def node(self, label: str, column: int, n: int, kids: list[Node] | None = None) -> Node:
        return Node(label, self.at + column, self.at + column + n, kids)

    def leaf(self, label: str, column: int, n: int) -> None:
        if column + n <= len(self.raw):
            self.kids.append(self.node(label, column, n))

    def called(self, section: int) -> str:
        name = self.names.get(section)
        return f"{section} ({name})" if name else str(section)

    def count(self) -> int | None:
        """Bytes of variable data, at most those between the columns for it."""
        if self.part(10, 2) is None:
            return None
        self.leaf(f"Byte count: {self.number(10, 2)}", 10, 2)
        return min(self.number(10, 2), DATA_END - DATA)

    def section(self, what: str) -> int | None:
        raw = self.part(14, 2)
        if raw is None:
            return None
        empty = _blank(raw) or raw == b"\0\0"
        self.leaf(f"{what}: {'(blank)' if empty else self.called(self.number(14, 2))}", 14, 2)
        return None if empty else self.number(14, 2)

    def body(self, what: str, n: int) -> None:
        n = min(max(len(self.raw) - DATA, 0), n)
        if n:
            self.leaf(f"{what} ({n} bytes)", DATA, n)


def _esd(c: _Card) -> str:
    n, section, found = c.count(), c.section("ESDID of first item"), []
    if n is None:
        return "ESD"
    for at in range(DATA, DATA + n - ITEM + 1, ITEM):
        if c.part(at, ITEM) is None:
            break
        name, kind, flag, address = ebcdic(c.raw[at : at + 8]).rstrip(" "), c.raw[at + 8], c.raw[at + 12], c.number(at + 9, 3)
        long, short = SECTION.get(kind, "unknown"), SECTION.get(kind, "unknown").split(" (")[0]
        label, tail = f"{short} {name}", c.number(at + 13, 3)
        if kind != 1 and section is not None:
            c.names[section] = name
            label += f" (ESDID {section})"
            section = section + 1 & 0xFFFF
        if kind in UNPLACED:
            placed = "Address: (unused)"
        else:
            placed = f"Address: 0x{address:06X}"
            label += f" addr 0x{address:06X}"
        told = f"Flags: 0x{flag:02X}"
        if kind in WITH_MODES:
            told += f" (AMODE {ADDRESSING.get(flag & 3, '24')}, RMODE {'ANY' if flag & 4 else '24'})"
        elif kind == 6:
            told = f"Alignment: {ALIGNMENT.get(flag, f'0x{flag:02X}')}"
        if kind == 1:
            owner = c.number(at + 14, 2)
            label += f" in ESDID {owner}"
            last = f"Owning ESDID: {c.called(owner)}"
        elif kind in UNPLACED or _blank(c.raw[at + 13 : at + 16]):
            last = "Length: (unused)"
        else:
            label += f" len 0x{tail:06X}"
            last = f"Length: 0x{tail:06X} ({tail})"
        parts = [(f'Name: "{name}"', 0, 8), (f"Type: 0x{kind:02X} ({long})", 8, 1), (placed, 9, 3), (told, 12, 1), (last, 13, 3)]
        c.kids.append(c.node(label, at, ITEM, [c.node(x, at + i, w) for x, i, w in parts]))
        found.append(f"{short} {name}")
    return f"ESD, {len(found)} item{'s' * (len(found) != 1)} ({', '.join(found)})" if found else "ESD, no items"


def _txt(c: _Card) -> str:
    said = "TXT"
    if c.part(5, 3) is not None:
        c.leaf(f"Address: 0x{c.number(5, 3):06X}", 5, 3)
        said += f" addr 0x{c.number(5, 3):06X}"
    n, section = c.count(), c.section("ESDID")
    if n is not None:
        c.body("Text", n)
        said += f", {n} bytes"
    return said if section is None else f"{said}, ESDID {c.called(section)}"


def _rld(c: _Card) -> str:
    n = c.count()
    if n is None:
        return "RLD"
    end, at, same, made, pair = min(DATA + n, len(c.raw)), DATA, False, 0, (0, 0)
    while at < end:
        if made == RELOCATIONS_SHOWN:
            c.kids.append(c.node("… more entries", at, end - at))
            break
        began, kids = at, []
        if not same:
            if at + 4 > end:
                break
            pair = c.number(at, 2), c.number(at + 2, 2)
            kids = [c.node(f"{x} pointer (ESDID): {c.called(section)}", at + 2 * i, 2) for i, (x, section) in enumerate(zip("RP", pair, strict=True))]
            at += 4
        if at + 4 > end:
            break
        flag, address, repeated = c.raw[at], c.number(at + 1, 3), same
        kind, length, sign, same = RELOCATION.get(flag >> 4, "?"), (flag >> 2 & 3) + 1, "-" if flag & 2 else "+", bool(flag & 1)
        kids.append(c.node(f"Flags: 0x{flag:02X} (type {kind}, length {length}, {sign}{', next entry same R/P' * same})", at, 1))
        kids.append(c.node(f"Address: 0x{address:06X}", at + 1, 3))
        at, made = at + 4, made + 1
        label = f"Entry {made}: {kind}({length}) {sign}, R {pair[0]} P {pair[1]}, addr 0x{address:06X}{' (same R/P)' * repeated}"
        c.kids.append(c.node(label, began, at - began, kids))
    return f"RLD, {made} {'entry' if made == 1 else 'entries'}"


def _end(c: _Card) -> str:
    said = "END"
    given = lambda column, n: (raw := c.part(column, n)) is not None and not _blank(raw)
    if given(5, 3):
        c.leaf(f"Entry address: 0x{c.number(5, 3):06X}", 5, 3)
        said += f" entry 0x{c.number(5, 3):06X}"
    section = c.section("Entry ESDID")
    if section is not None:
        said += f" ESDID {c.called(section)}"
    elif given(16, 8):
        name = ebcdic(c.raw[16:24]).rstrip(" ")
        c.leaf(f'Entry name: "{name}"', 16, 8)
        said += f" entry {name}"
    if given(28, 4) and c.number(28, 4):
        n = c.number(28, 4)
        c.leaf(f"Control section length: 0x{n:X} ({n})", 28, 4)
        said += f", length 0x{n:X}"
    n = {b"\xf1": 1, b"\xf2": 2}.get(c.part(32, 1), 0)
    if not n:
        return said
    c.leaf(f"IDR item count: {n}", 32, 1)
    for i, at in enumerate(range(33, 33 + n * IDR, IDR)):
        if c.part(at, IDR) is None:
            break
        text = ebcdic(c.raw[at : at + IDR])
        who, version, level, date = text[:10].rstrip(" "), text[10:12], text[12:14], text[14:]
        parts = [(f'Translator ID: "{who}"', 0, 10), (f"Version: {version}", 10, 2), (f"Modification level: {level}", 12, 2), (f"Date (yyddd): {date}", 14, 5)]
        c.kids.append(c.node(f"IDR {i + 1}: {who} V{version} M{level}, {date}", at, IDR, [c.node(x, at + a, w) for x, a, w in parts]))
    return f"{said}, {n} IDR item{'s' * (n != 1)}"


def _counted(c: _Card, name: str) -> str:
    n = c.count()
    if name == "XSD":
        c.names = {}
        c.section("ESDID")
    if n is None:
        return name
    c.body("Data", n)
    return f"{name}, {n} bytes"


def _card(raw: bytes, at: int, number: int, names: dict[int, str]) -> Node:
    c, cut = _Card(raw, at, names), f" (truncated, {len(raw)} bytes)" * (len(raw) < CARD)
    if raw[0] != 2:
        text = ebcdic(raw[:DATA_END]).strip(" ")
        c.leaf(f'Statement: "{text}"', 0, min(len(raw), DATA_END))
        said = f'control statement "{text}"'
    else:
        c.leaf("Flag: 0x02 (12-2-9 punch)", 0, 1)
        kind = ebcdic(raw[1:4]) if len(raw) >= 4 else ""
        c.leaf(f"Record type: {kind}", 1, 3)
        known = KINDS.get(raw[1:4])
        if known in READERS:
            said = READERS[known](c)
        elif known:
            said = _counted(c, known)
        else:
            c.leaf("Data (unknown record type)", 4, max(min(len(raw), DATA_END) - 4, 0))
            said = f'unknown record type "{kind}"'
    if len(raw) == CARD:
        c.leaf(f'Deck ID / sequence: "{ebcdic(raw[DATA_END:])}"', DATA_END, CARD - DATA_END)
    return Node(f"Card {number}: {said}{cut}", at, at + len(raw), c.kids)


READERS = {"ESD": _esd, "TXT": _txt, "RLD": _rld, "END": _end}


def object_module(v: View) -> list[Node]:
    names: dict[int, str] = {}
    out = [_card(v.data[at : at + CARD], at, i + 1, names) for i, at in enumerate(range(0, min(v.size, CARD * CARDS_SHOWN), CARD))]
    shown = CARD * CARDS_SHOWN
    return out + [Node(f"… {-(-(v.size - shown) // CARD)} more cards", shown, v.size)] * (v.size > shown)


WALKERS = {"OS/360 Object Module": object_module}
