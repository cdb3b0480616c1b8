"""Walker of WebAssembly: sections of numbered entries, and components that hold modules."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from bytestrata.formats.tree import Node, View, decimal, escaped

# Fixed values of the format.
MAGIC, HEADER, NESTED, CHARS = b"\0asm", 8, 8, 80
MODULE = [
    ("custom", "Custom"), ("type", "Type"), ("import", "Import"), ("function", "Function"), ("table", "Table"), ("memory", "Memory"), ("global", "Global"),
    ("export", "Export"), ("start", "Start"), ("element", "Element"), ("code", "Code"), ("data", "Data"), ("datacount", "Data count"), ("tag", "Tag"),
]
COMPONENT = [
    ("custom", "Custom"), ("core module", "Core module"), ("core instance", "Core instance"), ("core type", "Core type"), ("component", "Component"),
    ("instance", "Instance"), ("alias", "Alias"), ("type", "Type"), ("canon", "Canon"), ("start", "Start"), ("import", "Import"), ("export", "Export"),
    ("value", "Value"),
]
HEAP = {
    0x69: ("exn", "exnref"), 0x6A: ("array", "arrayref"), 0x6B: ("struct", "structref"), 0x6C: ("i31", "i31ref"), 0x6D: ("eq", "eqref"), 0x6E: ("any", "anyref"),
    0x6F: ("extern", "externref"), 0x70: ("func", "funcref"), 0x71: ("none", "nullref"), 0x72: ("noextern", "nullexternref"), 0x73: ("nofunc", "nullfuncref"),
    0x74: ("noexn", "nullexnref"),
}
PLAIN = {0x7F: "i32", 0x7E: "i64", 0x7D: "f32", 0x7C: "f64", 0x7B: "v128"}
ARITHMETIC = {0x6A: "i32.add", 0x6B: "i32.sub", 0x6C: "i32.mul", 0x7C: "i64.add", 0x7D: "i64.sub", 0x7E: "i64.mul"}
EXTERNAL = ["func", "table", "memory", "global", "tag"]


class Bad(Exception):
    """What is read here is not whole or not known."""


class _Reader:
    """A place in the content, up to an end."""

    def __init__(self, data: bytes, pos: int, end: int):
        self.data, self.pos, self.end = data, pos, min(end, len(data))

    def take(self, n: int) -> bytes:
        if self.pos + n > self.end:
            raise Bad
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def byte(self) -> int:
        return self.take(1)[0]

    def seven(self, bits: int) -> tuple[int, int, int]:
        """(number, bits read, last byte), seven bits a byte, lowest first."""
        n = 0
        for shift in range(0, bits, 7):
            x = self.byte()
            n |= (x & 127) << shift
            if x < 128:
                return n, shift + 7, x
        raise Bad

    def whole(self, bits: int = 32) -> int:
        n = self.seven(bits)[0]
        if bits < 64 and n >> bits:
            raise Bad
        return n & (1 << 64) - 1

    def signed(self, bits: int) -> int:
        n, read, last = self.seven(bits)
        if read < 64:
            return n - (1 << read) if last & 64 else n
        n &= (1 << 64) - 1
        return n - (1 << 64) if n >> 63 else n

    def name(self) -> str:
        text = escaped(self.take(self.whole()).decode("utf-8", "replace"), False).replace("'", "\\'")
        return text if len(text) <= CHARS else text[:CHARS] + "…"

    def heap(self) -> str:
        n = self.signed(33)
        if n >= 0:
            return str(n)
        if n < -64 or n + 128 not in HEAP:
            raise Bad
        return HEAP[n + 128][0]

    def type(self) -> str:
        x = self.byte()
        if x in (0x63, 0x64):
            return f"(ref {'null ' * (x == 0x63)}{self.heap()})"
        if x not in PLAIN and x not in HEAP:
            raise Bad
        return PLAIN.get(x) or HEAP[x][1]

    def types(self) -> list[str]:
        return [self.type() for _ in range(self.whole())]

    def limits(self) -> str:
        flags = self.byte()
        if flags > 7:
            raise Bad
        bits = 64 if flags & 4 else 32
        text = f"min {self.whole(bits)}"
        text += f", max {self.whole(bits)}" if flags & 1 else ""
        return text + ", shared" * bool(flags & 2) + ", 64-bit" * bool(flags & 4)

    def table(self) -> str:
        kind = self.type()
        return f"{kind}, {self.limits()}"

    def variable(self) -> str:
        kind, changes = self.type(), self.byte()
        if changes > 1:
            raise Bad
        return f"mut {kind}" if changes else kind

    def tag(self) -> str:
        kind, n = self.byte(), self.whole()
        return f"{f'attribute {kind}' if kind else 'exception'}, type {n}"

    def constant(self) -> str:
        """Operations of a constant expression, up to its end."""
        ops = []
        while (op := self.byte()) != 0x0B:
            if op in (0x23, 0xD2):
                ops.append(f"{'global.get' if op == 0x23 else 'ref.func'} {self.whole()}")
            elif op in (0x41, 0x42):
                ops.append(f"i{32 * (op - 0x40)}.const {self.signed(32 * (op - 0x40))}")
            elif op == 0x43:
                ops.append(f"f32.const {decimal(struct.unpack('<f', self.take(4))[0], np.float32)}")
            elif op == 0x44:
                ops.append(f"f64.const {decimal(struct.unpack('<d', self.take(8))[0])}")
            elif op in ARITHMETIC:
                ops.append(ARITHMETIC[op])
            elif op == 0xD0:
                ops.append(f"ref.null {self.heap()}")
            elif op == 0xFD and self.whole() == 12:
                self.take(16)
                ops.append("v128.const")
            else:
                raise Bad
        return ", ".join(ops) or "(empty)"

    def external(self) -> int:
        kind = self.byte()
        if kind >= len(EXTERNAL):
            raise Bad
        return kind


class _Entry:
    """Leaves of one entry, each read from where the last one ended."""

    def __init__(self, r: _Reader):
        self.r, self.start, self.kids = r, r.pos, []

    def part(self, label: str, read: Callable):
        at = self.r.pos
        value = read()
        self.kids.append(Node(label.format(value), at, self.r.pos))
        return value

    def node(self, label: str) -> Node:
        return Node(label, self.start, self.r.pos, self.kids)


def _type(r: _Reader, i: int) -> Node:
    e = _Entry(r)
    if r.byte() != 0x60:
        raise Bad
    e.kids.append(Node("Form: func (0x60)", e.start, r.pos))
    listed = lambda: f"({', '.join(r.types())})"
    given = e.part("Params: {}", listed)

    def results() -> str:
        types = r.types()
        return types[0] if len(types) == 1 else f"({', '.join(types)})"

    return e.node(f"Type {i}: {given} -> {e.part('Results: {}', results)}")


def _import(r: _Reader, i: int, module: _Module) -> Node:
    e = _Entry(r)
    where, name = e.part('Module: "{}"', r.name), e.part('Name: "{}"', r.name)
    at = r.pos
    kind = r.external()
    e.kids.append(Node(f"Kind: {kind} ({EXTERNAL[kind]})", at, r.pos))
    what = e.part("Type: {}", [lambda: f"type {r.whole()}", r.table, r.limits, r.variable, r.tag][kind])
    module.imported += kind == 0
    return e.node(f'Import {i}: "{where}"."{name}" ({EXTERNAL[kind]} {what})')


def _line(label: str, read: Callable[[_Reader], object]) -> Callable[[_Reader, int], Node]:
    """An entry of one leaf."""

    def entry(r: _Reader, i: int) -> Node:
        at = r.pos
        value = read(r)
        return Node(label.format(i, value), at, r.pos)

    return entry


def _table(r: _Reader) -> str:
    if r.data[r.pos : min(r.pos + 2, r.end)] != b"\x40\0":
        return r.table()
    r.pos += 2
    kind = r.table()
    return f"{kind}, init {r.constant()}"


def _global(r: _Reader, i: int) -> Node:
    e = _Entry(r)
    kind, value = e.part("Type: {}", r.variable), e.part("Init: {}", r.constant)
    return e.node(f"Global {i}: {kind} = {value}")


def _export(r: _Reader, i: int) -> Node:
    e = _Entry(r)
    name, at = e.part('Name: "{}"', r.name), r.pos
    kind = r.external()
    e.kids.append(Node(f"Kind: {kind} ({EXTERNAL[kind]})", at, r.pos))
    return e.node(f'Export {i}: "{name}" ({EXTERNAL[kind]} {e.part("Index: {}", r.whole)})')


def _mode(e: _Entry, r: _Reader, most: int, names: Callable[[int], str]) -> tuple[int, str]:
    at, flags = r.pos, r.whole()
    if flags > most:
        raise Bad
    e.kids.append(Node(f"Flags: {flags} ({names(flags)})", at, r.pos))
    return flags, names(flags)


def _element(r: _Reader, i: int) -> Node:
    e = _Entry(r)
    flags, said = _mode(e, r, 7, lambda n: ["active", "passive", "active", "declarative"][n & 3])
    if not flags & 1:
        table = e.part("Table: {}", r.whole) if flags & 2 else 0
        said += f", table {table}, offset {e.part('Offset: {}', r.constant)}"
    if flags & 3 and flags & 4:
        e.part("Reference type: {}", r.type)
    elif flags & 3:
        if e.part("Element kind: funcref", r.byte):
            raise Bad
    listed = _Entry(r)
    count = listed.part("Count: {}", r.whole)
    for k in range(count):
        listed.part(f"[{k}] {{}}", r.constant if flags & 4 else lambda: f"func {r.whole()}")
    e.kids.append(listed.node(f"Elements: {count}"))
    return e.node(f"Element segment {i}: {said}, {count} elements")


def _code(r: _Reader, i: int, module: _Module) -> Node:
    e = _Entry(r)
    size = e.part("Body size: {}", r.whole)
    body, end = r.pos, r.pos + size
    if end > r.end:
        raise Bad
    own = _Reader(r.data, body, end)
    held = _Entry(own)
    try:
        count = own.whole()
        for _ in range(count):
            held.part("{}", lambda: f"{own.whole()} x {own.type()}")
        e.kids.append(Node(f"Locals: {count} declarations", body, own.pos, held.kids or None))
        e.kids += [Node("Instructions", own.pos, end)] * (own.pos < end)
    except Bad:
        e.kids += [Node("Unparsed body", body, end)] * (body < end)
    r.pos = end
    return e.node(f"Function body {i} (func {module.imported + i})")


def _data(r: _Reader, i: int) -> Node:
    e = _Entry(r)
    flags, said = _mode(e, r, 2, lambda n: "passive" if n == 1 else "active")
    if flags != 1:
        memory = e.part("Memory: {}", r.whole) if flags == 2 else 0
        said += f", memory {memory}, offset {e.part('Offset: {}', r.constant)}"
    size, at = e.part("Size: {}", r.whole), r.pos
    r.take(size)
    e.kids += [Node("Data", at, r.pos)] * (size > 0)
    return e.node(f"Data segment {i}: {said}, {size} bytes")


class _Module:
    """One module or component; functions are numbered after the imported ones."""

    def __init__(self, data: bytes):
        self.data, self.imported = data, 0
        self.entries = {
            1: _type, 2: lambda r, i: _import(r, i, self), 3: lambda r, i: _line(f"Function {self.imported + i}: type {{1}}", _Reader.whole)(r, i), 4: _line("Table {}: {}", _table),
            5: _line("Memory {}: {}", _Reader.limits), 6: _global, 7: _export, 9: _element, 10: lambda r, i: _code(r, i, self), 11: _data, 13: _line("Tag {}: {}", _Reader.tag),
        }

    def fill(self, who: int, r: _Reader, kids: list[Node]) -> None:
        """Entries of a section; what can't be read is left to the reader's place."""
        at = r.pos
        if who in (8, 12):
            n = r.whole()
            kids.append(Node(f"Start function: {n}" if who == 8 else f"Data count: {n}", at, r.pos))
        elif who in self.entries:
            count = r.whole()
            kids.append(Node(f"Count: {count}", at, r.pos))
            for i in range(count):
                began = r.pos
                try:
                    kids.append(self.entries[who](r, i))
                except Bad:
                    r.pos = began
                    raise

    def section(self, at: int, limit: int, component: bool, depth: int) -> Node:
        r = _Reader(self.data, at, limit)
        who, size, body = r.byte(), r.whole(), r.pos
        end, cut, names = min(body + size, limit), body + size > limit, COMPONENT if component else MODULE
        known = who < len(names)
        kids = [Node(f"ID: {who} ({names[who][0] if known else 'unknown'})", at, at + 1), Node(f"Size: {size}{' (truncated)' * cut}", at + 1, body)]
        label, c, whole = f"{names[who][1]} section" if known else f"Unknown section (id {who})", _Reader(self.data, body, end), True
        try:
            if who == 0:
                name = c.name()
                kids.append(Node(f'Name: "{name}"', body, c.pos))
                label = f'Custom section: "{name}"'
                kids += [Node("Payload", c.pos, end)] * (c.pos < end)
                c.pos = end
            elif not component:
                self.fill(who, c, kids)
            elif who in (1, 4) and depth < NESTED:
                inner = _binary(self.data, body, end, depth + 1)
                kids += inner
                c.pos = end if inner else body
        except Bad:
            whole = False
        if c.pos < end:
            kids.append(Node("Unparsed data" if not whole else "Contents" if c.pos == body else "Trailing bytes", c.pos, end))
        return Node(label, at, end, kids)


def _binary(data: bytes, at: int, end: int, depth: int) -> list[Node]:
    first = at + HEADER
    if first > end or data[at : at + 4] != MAGIC:
        return []
    version, layer = struct.unpack_from("<HH", data, at + 4)
    kids = [Node("Magic: \\0asm", at, at + 4)]
    if layer:
        kids += [Node(f"Version: {version:#x}", at + 4, at + 6), Node(f"Layer: {layer}{' (component)' * (layer == 1)}", at + 6, first)]
    else:
        kids.append(Node(f"Version: {version} (module)", at + 4, first))
    out, pos, module = [Node("Header", at, first, kids, True)], first, _Module(data)
    while pos < end:
        try:
            out.append(module.section(pos, end, layer == 1, depth))
        except Bad:
            return [*out, Node("Truncated section header", pos, end)]
        pos = out[-1].end
    return out


def wasm(v: View) -> list[Node]:
    return _binary(v.data, 0, v.size, 0)


WALKERS = {"WebAssembly": wasm}
