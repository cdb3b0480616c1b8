"""Walker of Amiga hunks: load files, object units and libraries; a hunk is shown with its name before and what follows up to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
NAMES = {
    0x3E7: "HUNK_UNIT", 0x3E8: "HUNK_NAME", 0x3E9: "HUNK_CODE", 0x3EA: "HUNK_DATA", 0x3EB: "HUNK_BSS", 0x3EC: "HUNK_RELOC32", 0x3ED: "HUNK_RELOC16",
    0x3EE: "HUNK_RELOC8", 0x3EF: "HUNK_EXT", 0x3F0: "HUNK_SYMBOL", 0x3F1: "HUNK_DEBUG", 0x3F2: "HUNK_END", 0x3F3: "HUNK_HEADER", 0x3F5: "HUNK_OVERLAY",
    0x3F6: "HUNK_BREAK", 0x3F7: "HUNK_DREL32", 0x3F8: "HUNK_DREL16", 0x3F9: "HUNK_DREL8", 0x3FA: "HUNK_LIB", 0x3FB: "HUNK_INDEX", 0x3FC: "HUNK_RELOC32SHORT",
    0x3FD: "HUNK_RELRELOC32", 0x3FE: "HUNK_ABSRELOC16",
}
SYMBOLS = {
    0: "EXT_SYMB", 1: "EXT_DEF", 2: "EXT_ABS", 3: "EXT_RES", 129: "EXT_REF32", 130: "EXT_COMMON", 131: "EXT_REF16", 132: "EXT_REF8", 133: "EXT_DEXT32",
    134: "EXT_DEXT16", 135: "EXT_DEXT8", 136: "EXT_RELREF32", 137: "EXT_RELCOMMON", 138: "EXT_ABSREF16", 139: "EXT_ABSREF8",
}
COMMON = {130, 137}
LONG_RELOCATIONS = {0x3EC, 0x3ED, 0x3EE, 0x3F7, 0x3F8, 0x3F9, 0x3FD, 0x3FE}
HEADER, SHORT_IN_LOAD_FILES = 0x3F3, 0x3F7
MEMORY = ["ANY", "CHIP", "FAST", "EXT"]
FLAGS = {1 << 30: "CHIP", 1 << 31: "FAST", 1 << 29: "ADVISORY"}
ADVISORY, KIND, SIZE = 1 << 29, 0x1FFFFFFF, 0x3FFFFFFF
NAME_LONGS, LIBRARIES, HUNKS, SHOWN, CHARS = 64, 16, 0x10000, 64, 80


class Short(Exception):
    """The hunk does not end in the content, or is none."""


class Unknown(Exception):
    """A number that no hunk has."""


def _clean(raw: bytes) -> str:
    text = "".join(chr(x) if 0x20 <= x < 0x7F else "." for x in raw.split(b"\0", 1)[0])
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _listed(entries: Iterator[tuple[int, int, Callable[[], Node]]], rest: Callable[[int], str]) -> list[Node]:
    """The first SHOWN of (start, end, how it is shown), then one leaf for the others."""
    out, n, at, end = [], 0, 0, 0
    for a, b, node in entries:
        n += 1
        if n <= SHOWN:
            out.append(node())
        at, end = (a if n == SHOWN + 1 else at), b
    return out + ([Node(rest(n - SHOWN), at, end)] if n > SHOWN else [])


class _Hunks:
    """Hunks up to an end."""

    def __init__(self, v: View, end: int, loads: bool, first: int = 0, memory: list[int] | None = None):
        self.v, self.end, self.loads, self.first, self.number, self.memory = v, end, loads, first, first, memory or []

    def word(self, at: int, width: int = 4) -> int:
        if at + width > self.end:
            raise Short
        return int.from_bytes(self.v.data[at : at + width], "big")

    def past(self, at: int, longs: int) -> int:
        if at + 4 * longs > self.end:
            raise Short
        return at + 4 * longs

    def name(self, at: int, end: int) -> str:
        return _clean(self.v.data[at:end])

    def sign(self, at: int) -> Node:
        raw = self.word(at)
        flags = "".join(f" | {name}" for bit, name in FLAGS.items() if raw & bit)
        return Node(f"ID: {NAMES.get(raw & KIND, 'unknown')}{flags} (0x{raw:08X})", at, at + 4)

    def offsets(self, at: int, count: int, width: int = 4) -> list[Node]:
        shown = min(count, SHOWN)
        out = [Node(f"Offset: 0x{self.word(p, width):06X}", p, p + width) for p in range(at, at + shown * width, width)]
        return out + [Node(f"… {count - shown} more offsets", at + shown * width, at + count * width)] * (count > shown)

    # Hunks by kind: each gives its node, or raises Short.

    def content(self, at: int) -> tuple[Node, str]:
        raw, held = self.word(at), self.word(at + 4)
        kind, longs = raw & KIND, held & SIZE
        body = at + 8
        end = body if kind == 0x3EB else self.past(body, longs)
        index = self.number - self.first & 0xFFFFFFFF
        listed = self.memory[index] if self.loads and index < len(self.memory) else 0
        name = NAMES[kind]
        title = f"Hunk {self.number}: {name[5:]} ({4 * longs} bytes, {MEMORY[raw >> 30 or held >> 30 or listed]})"
        self.number = self.number + 1 & 0xFFFFFFFF
        kids = [self.sign(at), Node(f"Size: {longs} longwords ({4 * longs} bytes)", at + 4, body)]
        kids += [Node("Code" if kind == 0x3E9 else "Data", body, end)] * (end > body)
        return Node(f"{name} ({4 * longs} bytes)", at, end, kids), title

    def named(self, at: int, opened: bool = False) -> Node:
        longs = self.word(at + 4)
        end = self.past(at + 8, longs)
        name = self.name(at + 8, end)
        kids = [self.sign(at), Node(f"Name length: {longs} longwords", at + 4, at + 8), Node(f"Name: {name}", at + 8, end)]
        return Node(f"{NAMES[self.word(at) & KIND]}: {name}", at, end, kids, opened)

    def sized(self, at: int, label: str, held: str) -> Node:
        longs = self.word(at + 4)
        end = self.past(at + 8, longs)
        kids = [self.sign(at), Node(f"Size: {longs} longwords", at + 4, at + 8)] + [Node(held, at + 8, end)] * (longs > 0)
        return Node(f"{label} ({4 * longs} bytes)", at, end, kids)

    def library(self, at: int) -> Node:
        out = self.sized(at, "HUNK_LIB", "")
        out.kids[2:] = _Hunks(self.v, out.end, False).nodes(at + 8)
        out.open = True
        return out

    def overlay(self, at: int) -> Node:
        longs = self.word(at + 4)
        end = self.past(at + 8, longs + 1)
        kids = [self.sign(at), Node(f"Table size: {longs} longwords", at + 4, at + 8), Node("Overlay table", at + 8, end)]
        return Node(f"HUNK_OVERLAY (table {longs} longwords)", at, end, kids)

    def relocations(self, at: int, label: str, width: int) -> Node:
        """Groups of a count, a target and offsets, all of one width; a count of 0 ends them."""
        total, pos = 0, at + 4

        def groups() -> Iterator[tuple[int, int, Callable[[], Node]]]:
            nonlocal total, pos
            while count := self.word(pos, width):
                target, first = self.word(pos + width, width), pos + 2 * width
                end = first + count * width
                if end > self.end:
                    raise Short
                kids = lambda p=pos, f=first, n=count, t=target: [Node(f"Count: {n}", p, p + width), Node(f"Target hunk: {t}", p + width, f), *self.offsets(f, n, width)]
                yield pos, end, lambda p=pos, e=end, n=count, t=target, k=kids: Node(f"To hunk {t}: {n} offsets", p, e, k())
                total, pos = total + count, end

        kids = [self.sign(at), *_listed(groups(), lambda n: "… more groups"), Node("End marker", pos, pos + width)]
        pos += width
        if (pos - at) % 4:
            if pos + 2 > self.end:
                raise Short
            kids.append(Node("Padding", pos, pos + 2))
            pos += 2
        return Node(f"{label} ({total} relocations)", at, pos, kids)

    def external(self, at: int) -> Node:
        count, pos = 0, at + 4

        def entry(p: int, middle: int, kind: str, code: int, name: str) -> tuple[int, Callable[[], Node]]:
            head = [Node(f"Type: {kind} ({code}), name length: {(middle - p) // 4 - 1} longwords", p, p + 4), Node(f"Name: {name}", p + 4, middle)]
            first = self.word(middle)
            if code < 4:
                return middle + 4, lambda: Node(f"{kind} {name} = 0x{first:X}", p, middle + 4, [*head, Node(f"Value: 0x{first:08X}", middle, middle + 4)])
            sized = code in COMMON
            n = self.word(middle + 4) if sized else first
            refs = middle + (8 if sized else 4)
            end = self.past(refs, n)
            more = [Node(f"Size: {first} bytes", middle, middle + 4)] * sized + [Node(f"Reference count: {n}", refs - 4, refs)]
            told = f"size {first}, {n} refs" if sized else f"{n} refs"
            return end, lambda: Node(f"{kind} {name} ({told})", p, end, [*head, *more, *self.offsets(refs, n)])

        def entries() -> Iterator[tuple[int, int, Callable[[], Node]]]:
            nonlocal count, pos
            while head := self.word(pos):
                middle, code = self.past(pos + 4, head & 0xFFFFFF), head >> 24
                if code not in SYMBOLS:
                    raise Short
                end, node = entry(pos, middle, SYMBOLS[code], code, self.name(pos + 4, middle))
                yield pos, end, node
                count, pos = count + 1, end

        kids = [self.sign(at), *_listed(entries(), lambda n: "… more symbols"), Node("End marker", pos, pos + 4)]
        return Node(f"HUNK_EXT ({count} entries)", at, pos + 4, kids)

    def symbols(self, at: int) -> Node:
        count, pos = 0, at + 4

        def entries() -> Iterator[tuple[int, int, Callable[[], Node]]]:
            nonlocal count, pos
            while longs := self.word(pos):
                middle = self.past(pos + 4, longs)
                value = self.word(middle)
                yield pos, middle + 4, lambda p=pos, m=middle, x=value: Node(f"{self.name(p + 4, m)} = 0x{x:X}", p, m + 4)
                count, pos = count + 1, middle + 4

        kids = [self.sign(at), *_listed(entries(), lambda n: "… more symbols"), Node("End marker", pos, pos + 4)]
        return Node(f"HUNK_SYMBOL ({count} symbols)", at, pos + 4, kids)

    def debug(self, at: int) -> Node:
        out = self.sized(at, "HUNK_DEBUG", "Debug data")
        body, end = at + 8, out.end
        if end - body < 12 or self.v.data[body + 4 : body + 8] != b"LINE":
            return out
        out.label = f"HUNK_DEBUG (LINE, {end - body} bytes)"
        longs = self.word(body + 8)
        middle = body + 12 + 4 * longs
        if middle <= end:
            lines = [(f"Base offset: 0x{self.word(body):X}", body, body + 4), ("Format: LINE", body + 4, body + 8), (f"Name length: {longs} longwords", body + 8, body + 12)]
            lines += [(f"Source file: {self.name(body + 12, middle)}", body + 12, middle)] + [(f"Line table ({(end - middle) // 8} entries)", middle, end)] * (end > middle)
            out.kids[2:] = [Node(*x) for x in lines]
        return out

    def one(self, at: int) -> tuple[Node, str, str | None]:
        """(hunk, whether it opens a group, joins one, ends it or stands alone, title that it gives its group)."""
        raw = self.word(at)
        kind = raw & KIND
        if kind in (0x3E9, 0x3EA, 0x3EB):
            node, title = self.content(at)
            return node, "opens", title
        if kind == 0x3E8:
            return self.named(at), "opens", None
        if kind == 0x3F2:
            return Node("HUNK_END", at, at + 4), "ends", None
        if kind == SHORT_IN_LOAD_FILES and self.loads:
            return self.relocations(at, "HUNK_DREL32 (as RELOC32SHORT)", 2), "joins", None
        if kind == 0x3FC:
            return self.relocations(at, NAMES[kind], 2), "joins", None
        if kind in LONG_RELOCATIONS:
            return self.relocations(at, NAMES[kind], 4), "joins", None
        plain = {0x3EF: self.external, 0x3F0: self.symbols, 0x3F1: self.debug, 0x3FB: lambda p: self.sized(p, "HUNK_INDEX", "Index data")}
        if kind in plain:
            return plain[kind](at), "joins", None
        if kind == 0x3E7 and not self.loads:
            self.number = self.first = 0
            return self.named(at, True), "alone", None
        if kind == 0x3FA and not self.loads:
            return self.library(at), "alone", None
        if kind == 0x3F6:
            return Node("HUNK_BREAK", at, at + 4), "alone", None
        if raw & ADVISORY:
            return self.sized(at, "Advisory hunk", "Skipped data"), "joins", None
        raise Unknown

    def nodes(self, at: int) -> list[Node]:
        out: list[Node] = []
        group: list[Node] = []
        title: str | None = None

        def close() -> None:
            nonlocal title
            if title is not None:
                out.append(Node(title, group[0].start, group[-1].end, group[:]))
            else:
                out.extend(group)
            group.clear()
            title = None

        def rest(why: str) -> list[Node]:
            close()
            return out + [Node(f"Unparsed data ({why})", at, self.end)] * (at < self.end)

        while at < self.end:
            if at + 4 > self.end:
                return rest("trailing bytes")
            kind = self.word(at) & KIND
            try:
                if kind == 0x3F5 and self.loads:
                    close()
                    try:
                        out.append(self.overlay(at))
                    except Short:
                        return rest("truncated HUNK_OVERLAY")
                    at = out[-1].end
                    return rest("overlays not parsed")
                node, joins, named = self.one(at)
            except Short:
                return rest(f"truncated or malformed {NAMES.get(kind, 'hunk')}")
            except Unknown:
                return rest(f"unknown hunk ID 0x{self.word(at):08X}")
            if joins == "alone" or (joins == "opens" and title is not None):
                close()
            if joins == "opens" or group:
                group.append(node)
                title = named or title
            else:
                out.append(node)
            at = node.end
            if joins == "ends":
                close()
        close()
        return out


def _header(v: View) -> tuple[Node, int, list[int]]:
    """(node, number of the first hunk, memory of each) of a load file's header."""
    h = _Hunks(v, v.size, True)
    kids, libraries, at = [h.sign(0)], [], 4
    while longs := h.word(at):
        if longs > NAME_LONGS or len(libraries) >= LIBRARIES:
            raise Short
        end = h.past(at + 4, longs)
        libraries.append(Node(f"Library: {h.name(at + 4, end)}", at, end))
        at = end
    at += 4
    if libraries:
        kids.append(Node(f"Resident libraries ({len(libraries)})", 4, at, [*libraries, Node("End of list", at - 4, at)]))
    else:
        kids.append(Node("Resident libraries: none", 4, at))
    size, first, last = h.word(at), h.word(at + 4), h.word(at + 8)
    if first > last or size > HUNKS or last - first >= size:
        raise Short
    kids += [Node(f"{name}: {x}", at + 4 * i, at + 4 * i + 4) for i, (name, x) in enumerate((("Table size", size), ("First hunk", first), ("Last hunk", last)))]
    at, count, memory = at + 12, last - first + 1, []
    began = at

    def sizes() -> Iterator[tuple[int, int, Callable[[], Node]]]:
        nonlocal at
        for i in range(first, last + 1):
            word, p = h.word(at), at
            memory.append(word >> 30)
            told = MEMORY[word >> 30]
            at += 4
            if word >> 30 == 3:
                told = f"attributes 0x{h.word(at):08X}"
                at += 4
            yield p, at, lambda i=i, p=p, e=at, n=4 * (word & SIZE), t=told: Node(f"Hunk {i}: {n} bytes ({t})", p, e)

    listed = _listed(sizes(), lambda n: f"… {n} more hunks")
    kids.append(Node(f"Hunk sizes ({count})", began, at, listed))
    return Node(f"HUNK_HEADER ({count} hunks)", 0, at, kids, True), first, memory


def amiga(v: View) -> list[Node]:
    if v.size < 4:
        return []
    if v.number(0, 4, "big") != HEADER:
        return _Hunks(v, v.size, False).nodes(0)
    try:
        head, first, memory = _header(v)
    except Short:
        return [Node("Unparsed data (truncated HUNK_HEADER)", 0, v.size)]
    return [head, *_Hunks(v, v.size, True, first, memory).nodes(head.end)]


WALKERS = {"Amiga Hunk": amiga}
