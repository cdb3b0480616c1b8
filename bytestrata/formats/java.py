"""Walker of Java classes: constants that refer to each other by number, members, and attributes that nest in code."""

from __future__ import annotations

import struct

import numpy as np

from bytestrata.formats.tree import Node, View, decimal, escaped

# Fixed values of the format.
CHARS, CODE_DEPTH, REFERENCE_DEPTH = 80, 4, 4
#: Tag: name, layout of what follows it (Utf8 tells its own length).
CONSTANTS = {
    1: ("Utf8", ""), 3: ("Integer", ">i"), 4: ("Float", ">f"), 5: ("Long", ">q"), 6: ("Double", ">d"), 7: ("Class", ">H"), 8: ("String", ">H"), 9: ("Fieldref", ">HH"),
    10: ("Methodref", ">HH"), 11: ("InterfaceMethodref", ">HH"), 12: ("NameAndType", ">HH"), 15: ("MethodHandle", ">BH"), 16: ("MethodType", ">H"),
    17: ("Dynamic", ">HH"), 18: ("InvokeDynamic", ">HH"), 19: ("Module", ">H"), 20: ("Package", ">H"),
}
HANDLES = ["unknown", "getField", "getStatic", "putField", "putStatic", "invokeVirtual", "invokeStatic", "invokeSpecial", "newInvokeSpecial", "invokeInterface"]
RELEASES = {45: "JDK 1.1", 46: "JDK 1.2", 47: "JDK 1.3", 48: "JDK 1.4", 49: "Java SE 5"}
CLASS_FLAGS = {
    0x0001: "ACC_PUBLIC", 0x0010: "ACC_FINAL", 0x0020: "ACC_SUPER", 0x0200: "ACC_INTERFACE", 0x0400: "ACC_ABSTRACT", 0x1000: "ACC_SYNTHETIC",
    0x2000: "ACC_ANNOTATION", 0x4000: "ACC_ENUM", 0x8000: "ACC_MODULE",
}
FIELD_FLAGS = {
    0x0001: "ACC_PUBLIC", 0x0002: "ACC_PRIVATE", 0x0004: "ACC_PROTECTED", 0x0008: "ACC_STATIC", 0x0010: "ACC_FINAL", 0x0040: "ACC_VOLATILE",
    0x0080: "ACC_TRANSIENT", 0x1000: "ACC_SYNTHETIC", 0x4000: "ACC_ENUM",
}
METHOD_FLAGS = {
    0x0001: "ACC_PUBLIC", 0x0002: "ACC_PRIVATE", 0x0004: "ACC_PROTECTED", 0x0008: "ACC_STATIC", 0x0010: "ACC_FINAL", 0x0020: "ACC_SYNCHRONIZED", 0x0040: "ACC_BRIDGE",
    0x0080: "ACC_VARARGS", 0x0100: "ACC_NATIVE", 0x0400: "ACC_ABSTRACT", 0x0800: "ACC_STRICT", 0x1000: "ACC_SYNTHETIC",
}
POINTERS = {"SourceFile": "Source file", "Signature": "Signature", "ConstantValue": "Value"}


class Cut(Exception):
    """The content ends, or stops making sense, where more is due."""


def short(text: str) -> str:
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def release(major: int, minor: int) -> str:
    name = "JDK 1.0.2" if major == 45 and minor < 3 else RELEASES.get(major) or (f"Java SE {major - 44}" if major > 49 else "unknown")
    return name + ", preview features" * (major >= 56 and minor == 0xFFFF)


class _Class:
    def __init__(self, data: bytes):
        self.data, self.pool = data, {}

    def read(self, layout: str, at: int) -> tuple:
        if at + struct.calcsize(layout) > len(self.data):
            raise Cut
        return struct.unpack_from(layout, self.data, at)

    def text(self, i: int) -> str | None:
        tag, held = self.pool.get(i, (0, None))
        return held if tag == 1 else None

    def meaning(self, i: int, depth: int = 0) -> str | None:
        """What a constant stands for, through those that it refers to; None where they don't fit."""
        if depth > REFERENCE_DEPTH or i not in self.pool:
            return None
        tag, held = self.pool[i]
        if tag == 1:
            return held
        if tag in (3, 5):
            return str(held[0])
        if tag in (4, 6):
            return decimal(held[0], np.float32 if tag == 4 else np.float64)
        if tag in (7, 8, 16, 19, 20):
            text = self.text(held[0])
            return f'"{escaped(text)}"' if tag == 8 and text is not None else text
        if tag == 12:
            parts, between = [self.text(x) for x in held], ":"
        elif tag in (9, 10, 11):
            parts, between = [self.meaning(x, depth + 1) for x in held], "."
        else:
            first = HANDLES[held[0] if held[0] < len(HANDLES) else 0] if tag == 15 else f"#{held[0]}"
            parts, between = [first, self.meaning(held[1], depth + 1)], " " if tag == 15 else ":"
        return None if None in parts else between.join(parts)

    def named(self, i: int) -> str:
        meaning = self.meaning(i)
        return f"#{i}" if meaning is None else short(f"#{i} ({meaning})")

    def constants(self, at: int) -> tuple[Node, bool]:
        (count,) = self.read(">H", at)
        kids, places, pos, i, odd = [Node(f"Constant pool count: {count}", at, at + 2)], [], at + 2, 1, []
        try:
            while i < count:
                (tag,) = self.read("B", pos)
                if tag not in CONSTANTS:
                    odd = [Node(f"#{i} Unknown tag {tag}", pos, pos + 1)]
                    pos += 1
                    break
                if tag == 1:
                    end = pos + 3 + self.read(">H", pos + 1)[0]
                    if end > len(self.data):
                        raise Cut
                    held = self.data[pos + 3 : end].decode("utf-8", "replace")
                else:
                    layout = CONSTANTS[tag][1]
                    held, end = self.read(layout, pos + 1), pos + 1 + struct.calcsize(layout)
                self.pool[i] = tag, held
                places.append((i, pos, end))
                pos, i = end, i + 1 + (tag in (5, 6))
        except Cut:
            pass
        for k, a, b in places:
            tag, held = self.pool[k]
            meaning = f'"{escaped(held)}"' if tag == 1 else self.meaning(k)
            label = f"#{k} {CONSTANTS[tag][0]}"
            kids.append(Node(label if meaning is None else short(f"{label}: {meaning}"), a, b))
        whole = i >= count and not odd
        return Node(f"Constant pool ({max(count - 1, 0)} entries{', truncated' * (not whole)})", at, pos, kids + odd), whole

    def flags(self, names: dict[int, str], at: int) -> Node:
        (n,) = self.read(">H", at)
        rest = n & ~sum(names)
        told = [name for bit, name in names.items() if n & bit] + [f"0x{rest:04X}"] * (rest > 0)
        return Node(f"Access flags: 0x{n:04X}" + (f" ({' | '.join(told)})" if told else ""), at, at + 2)

    def pointer(self, what: str, at: int) -> Node:
        return Node(f"{what}: {self.named(self.read('>H', at)[0])}", at, at + 2)

    def info(self, at: int) -> tuple[Node, bool]:
        _, this, base = self.read(">HHH", at)
        kids = [self.flags(CLASS_FLAGS, at), self.pointer("This class", at + 2), self.pointer("Super class", at + 4) if base else Node("Super class: none", at + 4, at + 6)]
        pos, listed, whole = at + 6, [], False
        try:
            (count,) = self.read(">H", pos)
            kids.append(Node(f"Interfaces count: {count}", pos, pos + 2))
            pos += 2
            for _ in range(count):
                listed.append(self.pointer("Interface", pos))
                pos += 2
            whole = True
        except Cut:
            pass
        if listed:
            kids.append(Node(f"Interfaces ({count})", listed[0].start, pos, listed))
        name = self.meaning(this)
        return Node("Class" if name is None else short(f"Class: {name}"), at, pos, kids, True), whole

    def members(self, at: int, one: str, many: str, names: dict[int, str]) -> tuple[Node, bool]:
        (count,) = self.read(">H", at)
        kids, pos, whole = [Node(f"{many} count: {count}", at, at + 2)], at + 2, True
        for _ in range(count):
            try:
                _, name, kind = self.read(">HHH", pos)
            except Cut:
                whole = False
                break
            own = [self.flags(names, pos), self.pointer("Name", pos + 2), self.pointer("Descriptor", pos + 4)]
            more, end, whole = self.attributes(pos + 6, len(self.data), 0)
            texts = self.text(name), self.text(kind)
            kids.append(Node(one if None in texts else short(f"{one}: {texts[0]} {texts[1]}"), pos, end, own + more))
            pos = end
            if not whole:
                break
        return Node(f"{many} ({count})", at, pos, kids), whole

    def attributes(self, at: int, limit: int, depth: int) -> tuple[list[Node], int, bool]:
        """(number and attributes, their end, whether they are whole), none beyond the limit."""
        if at + 2 > limit:
            return [], at, False
        try:
            (count,) = self.read(">H", at)
        except Cut:
            return [], at, False
        out, pos = [Node(f"Attributes count: {count}", at, at + 2)], at + 2
        for _ in range(count):
            try:
                name, length = self.read(">HI", pos)
            except Cut:
                return out, pos, False
            body, stop = pos + 6, pos + 6 + length
            end, text = min(stop, limit), self.text(name)
            kids = [self.pointer("Name", pos), Node(f"Length: {length}", pos + 2, body)]
            if stop <= limit:
                kids += self.details(text, body, stop, depth)
            elif end > body:
                kids.append(Node(f"Info ({end - body} of {length} bytes, truncated)", body, end))
            out.append(Node("Attribute" if text is None else short(f"Attribute: {text}"), pos, end, kids))
            pos = end
            if stop > limit:
                return out, pos, False
        return out, pos, True

    def details(self, name: str | None, at: int, end: int, depth: int) -> list[Node]:
        try:
            if name == "Code":
                return self.code(at, end, depth)
            if name == "Exceptions":
                (count,) = self.read(">H", at)
                if at + 2 + 2 * count != end:
                    raise Cut
                return [Node(f"Number of exceptions: {count}", at, at + 2), *(self.pointer("Exception", p) for p in range(at + 2, end, 2))]
            if name in POINTERS and end - at == 2:
                return [self.pointer(POINTERS[name], at)]
        except Cut:
            pass
        return [Node(f"Info ({end - at} bytes)", at, end)] * (end > at)

    def code(self, at: int, end: int, depth: int) -> list[Node]:
        stack, places, size = self.read(">HHI", at)
        table = at + 8 + size
        if table + 2 > end:
            raise Cut
        (count,) = self.read(">H", table)
        rest = table + 2 + 8 * count
        if rest > end:
            raise Cut
        out = [Node(f"Max stack: {stack}", at, at + 2), Node(f"Max locals: {places}", at + 2, at + 4), Node(f"Code length: {size}", at + 4, at + 8)]
        out += [Node(f"Bytecode ({size} bytes)", at + 8, table)] * (size > 0) + [Node(f"Exception table length: {count}", table, table + 2)]
        handlers = []
        for p in range(table + 2, rest, 8):
            first, last, handler, kind = self.read(">HHHH", p)
            handlers.append(Node(short(f"pc {first}..{last} -> {handler}, catch {self.named(kind) if kind else 'any'}"), p, p + 8))
        out += [Node(f"Exception table ({count})", table + 2, rest, handlers)] * (count > 0)
        if depth >= CODE_DEPTH:
            return out + [Node(f"Attributes ({end - rest} bytes)", rest, end)] * (rest < end)
        inner, stop, whole = self.attributes(rest, end, depth + 1)
        if not whole or stop != end:
            raise Cut
        return out + inner


def java_class(v: View) -> list[Node]:
    c, out = _Class(v.data), []
    try:
        magic, minor, major = c.read(">IHH", 0)
        head = [Node(f"Magic: 0x{magic:08X}", 0, 4), Node(f"Minor version: {minor}", 4, 6), Node(f"Major version: {major} ({release(major, minor)})", 6, 8)]
        out.append(Node("Header", 0, 8, head, True))
        pool, whole = c.constants(8)
        out.append(pool)
        if not whole:
            return out + [Node(f"Unparsed data ({v.size - pool.end} bytes)", pool.end, v.size)] * (pool.end < v.size)
        steps = [c.info, lambda at: c.members(at, "Field", "Fields", FIELD_FLAGS), lambda at: c.members(at, "Method", "Methods", METHOD_FLAGS)]
        for step in steps:
            node, whole = step(out[-1].end)
            out.append(node)
            if not whole:
                return out
    except Cut:
        return out
    at = out[-1].end
    kids, end, whole = c.attributes(at, v.size, 0)
    if kids:
        out.append(Node(f"Attributes ({c.read('>H', at)[0]})", at, end, kids))
    return out + [Node(f"Trailing data ({v.size - end} bytes)", end, v.size)] * (whole and end < v.size)


WALKERS = {"Java class": java_class}
