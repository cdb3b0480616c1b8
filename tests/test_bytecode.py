"""Java classes, WebAssembly, Python and DEX."""

import struct

from bytestrata.formats import java
from bytestrata.formats.tree import escaped, flat
from bytestrata.formats.walkers import dissect


def rows(data):
    return flat(dissect("Java class", data))


def utf(text):
    raw = text.encode()
    return b"\1" + struct.pack(">H", len(raw)) + raw


def attribute(name, body):
    return struct.pack(">HI", name, len(body)) + body


POOL = [
    utf("A"), b"\7\0\1", utf("main"), utf("()V"), utf("Code"), utf("SourceFile"), utf('A"\n.java'), b"\x0c\0\3\0\4", b"\x0a\0\2\0\x08", b"\5" + struct.pack(">q", -5), b"",
    b"\4" + struct.pack(">f", 0.1), b"\6" + struct.pack(">d", 1e21), b"", b"\x0f\6\0\x09", b"\x12\0\2\0\x08", b"\x08\0\x07", utf("Exceptions"), b"\x09\0\x13\0\x13",
]
CODE = struct.pack(">HHI", 1, 2, 1) + b"\xb1" + struct.pack(">HHHHH", 1, 0, 1, 1, 0) + struct.pack(">H", 0)
HEAD = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(POOL) + 1) + b"".join(POOL)
METHOD = struct.pack(">HHHH", 0x200A, 3, 4, 2) + attribute(5, CODE) + attribute(18, struct.pack(">HH", 1, 2))
DATA = HEAD + struct.pack(">HHHH", 0x21, 2, 0, 1) + b"\0\2" + b"\0\0" + b"\0\1" + METHOD + b"\0\1" + attribute(6, b"\0\7") + b"end"


def test_class():
    got = [r[3] for r in rows(DATA)]
    at = {r[3]: (r[4], r[5]) for r in rows(DATA)}
    assert {"Major version: 61 (Java SE 17)", "Constant pool (19 entries)", "#7 Utf8: \"A\\\"\\n.java\"", "#9 Methodref: A.main:()V", "#10 Long: -5", "#12 Float: 0.1"} <= set(got)
    assert {"#13 Double: 1000000000000000000000", "#15 MethodHandle: invokeStatic A.main:()V", "#16 InvokeDynamic: #2:main:()V", '#17 String: "A\\"\\n.java"', "#19 Fieldref"} <= set(got)
    assert {"Class: A", "Access flags: 0x0021 (ACC_PUBLIC | ACC_SUPER)", "Super class: none", "Interface: #2 (A)", "Fields (0)", "Methods (1)", "Method: main ()V"} <= set(got)
    assert {"Access flags: 0x200A (ACC_PRIVATE | ACC_STATIC | 0x2000)", "pc 0..1 -> 1, catch any", "Bytecode (1 bytes)", "Exception: #2 (A)", 'Source file: #7 (A"\n.java)'} <= set(got)
    assert at["Trailing data (3 bytes)"] == (len(DATA) - 3, len(DATA)) and "#14" not in " ".join(got)
    for n in range(len(DATA)):
        rows(DATA[:n])


def test_broken_classes():
    assert [r[3] for r in rows(struct.pack(">IHHH", 0xCAFEBABE, 0xFFFF, 65, 3) + b"\2xyz")][-2:] == ["#1 Unknown tag 2", "Unparsed data (3 bytes)"]
    assert rows(HEAD[:30])[4][3] == "Constant pool (19 entries, truncated)"
    assert rows(DATA[:8])[-1][3] == "Major version: 61 (Java SE 17)"
    # code whose attributes don't fill it is one range
    odd = DATA.replace(attribute(5, CODE), attribute(5, CODE + b"?"))
    assert f"Info ({len(CODE) + 1} bytes)" in {r[3] for r in rows(odd)}
    # code within code, deeper than is shown
    inner = struct.pack(">HHI", 0, 0, 0) + b"\0\0" + b"\0\0"
    for _ in range(6):
        inner = struct.pack(">HHI", 0, 0, 0) + b"\0\0" + b"\0\1" + attribute(5, inner)
    deep = DATA.replace(attribute(5, CODE), attribute(5, inner))
    assert any(r[3].startswith("Attributes (") and r[3].endswith(" bytes)") for r in rows(deep))
    assert java.release(45, 2) == "JDK 1.0.2" and java.release(44, 0) == "unknown" and java.release(60, 0xFFFF) == "Java SE 16, preview features"
    assert escaped("e\u0301\u200b'é") == "e\\u{301}\\u{200b}'é" and escaped("\u0301e\u0301", False) == "\\u{301}e\u0301"


def leb(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def section(who, body):
    return bytes([who]) + leb(len(body)) + body


def vec(*items):
    return leb(len(items)) + b"".join(items)


def name(text):
    return leb(len(text.encode())) + text.encode()


WASM = (
    b"\0asm\1\0\0\0" + section(1, vec(b"\x60\2\x7f\x64\x70\1\x7e", b"\x60\0\0")) + section(2, vec(name("env") + name("it's") + b"\0\0", name("env") + name("mem") + b"\2\3\1\2"))
    + section(3, vec(b"\1")) + section(4, vec(b"\x70\0\1", b"\x40\0\x63\0\1\1\2\xd0\x70\x0b")) + section(5, vec(b"\4" + leb(1 << 40))) + section(6, vec(b"\x7f\1\x41\x7f\x0b", b"\x7d\0\x43\0\0\xc0\x3f\x0b"))
    + section(7, vec(name("go") + b"\0\1")) + section(8, b"\1") + section(9, vec(b"\0\x41\0\x0b" + vec(b"\1", b"\0"), b"\7\x70" + vec(b"\xd2\0\x0b"))) + section(12, b"\2")
    + section(10, vec(leb(5) + b"\1\3\x7f\0\x0b", leb(1) + b"\xff")) + section(11, vec(b"\0\x41\x08\x0b" + name("hi"), b"\1\0")) + section(13, vec(b"\0\1")) + section(0, name("name") + b"\0\1x")
)


def test_wasm():
    found = flat(dissect("WebAssembly", WASM))
    got = {r[3] for r in found}
    assert {"Type 0: (i32, (ref func)) -> i64", "Type 1: () -> ()", r"""Import 0: "env"."it\'s" (func type 0)""", 'Import 1: "env"."mem" (memory min 1, max 2, shared)', "Function 1: type 1"} <= got
    assert {"Table 0: funcref, min 1", "Table 1: (ref null 0), min 1, max 2, init ref.null func", f"Memory 0: min {1 << 40}, 64-bit", "Global 0: mut i32 = i32.const -1", "Global 1: f32 = f32.const 1.5"} <= got
    assert {'Export 0: "go" (func 1)', "Start function: 1", "Element segment 0: active, table 0, offset i32.const 0, 2 elements", "Element segment 1: declarative, 1 elements", "[0] ref.func 0"} <= got
    assert {"Function body 0 (func 1)", "Locals: 1 declarations", "3 x i32", "Instructions", "Function body 1 (func 2)", "Unparsed body", "Data segment 0: active, memory 0, offset i32.const 8, 2 bytes"} <= got
    assert {"Data segment 1: passive, 0 bytes", "Tag 0: exception, type 1", 'Custom section: "name"', "Data count: 2", "Version: 1 (module)"} <= got
    assert all(0 <= r[4] <= r[5] <= len(WASM) for r in found)
    for n in range(len(WASM)):
        flat(dissect("WebAssembly", WASM[:n]))


def test_wasm_components_and_odds():
    nested = b"\0asm\x0d\0\1\0" + section(1, WASM) + section(8, b"xy") + section(99, b"") + b"\1"
    found = flat(dissect("WebAssembly", nested))
    assert [r[3] for r in found if r[2] == 0] == ["Header", "Core module section", "Canon section", "Unknown section (id 99)", "Truncated section header"]
    assert {"Layer: 1 (component)", "Version: 0xd", "Contents", "Type 1: () -> ()"} <= {r[3] for r in found}
    deep = WASM[:8]
    for _ in range(12):
        deep = b"\0asm\x0d\0\1\0" + section(4, deep)
    assert max(r[2] for r in flat(dissect("WebAssembly", deep))) < 12
    odd = [r[3] for r in flat(dissect("WebAssembly", WASM[:8] + section(1, vec(b"\x60\0\0", b"\x5f\0")) + section(8, b"\1z") + b"\1\x7f\0"))]
    assert "Unparsed data" in odd and "Trailing bytes" in odd and "Size: 127 (truncated)" in odd


def marshalled(source, magic=3571, header=None):
    import marshal

    return struct.pack("<H", magic) + b"\r\n" + (header or bytes(4) + struct.pack("<II", 86400, len(source))) + marshal.dumps(compile(source, "m.py", "exec"))


PY = "def f(a, *b):\n    return [1.5, 1099511627776, %d, 'é\\n', b'x', 3j, ..., a, (None, True), 'w w']\n" % (2**200)


def test_python():
    data = marshalled(PY)
    found = flat(dissect("Python bytecode", data))
    got = [r[3] for r in found]
    assert [r[3].split(" [ref")[0] for r in found if r[2] == 0] == ["Header", 'Marshalled Code object "<module>"'] and found[-1][5] == len(data)
    assert {"Magic: 3571 (Python 3.13)", "Flags: 0x0 (timestamp-based)", "Source mtime: 86400 (1970-01-02 00:00:00 UTC)", "co_argcount: 1"} <= set(got)
    assert any(x.startswith('[0] Code object "f"') or "Code object \"f\"" in x for x in got) and any("Float: 1.5" in x for x in got) and any("Complex: (0+3j)" in x for x in got)
    assert any("Long: 1099511627776" in x for x in got) and any("Long: (14 digits)" in x for x in got) and any("Ref #" in x and " → " in x for x in got)
    assert any("VARARGS" in x for x in got) and any('"é\\n"' in x for x in got)
    for n in range(len(data)):
        flat(dissect("Python bytecode", data[:n]))
    assert "Trailing data (2 bytes)" in {r[3] for r in flat(dissect("Python bytecode", data + b"??"))}


def test_python_odds():
    py = lambda body, magic=62211, head=bytes(4): flat(dissect("Python bytecode", struct.pack("<H", magic) + b"\r\n" + head + body))
    old = b"c" + struct.pack("<4i", 0, 0, 1, 0x40) + b"s\1\0\0\0d" + b"(\0\0\0\0" * 5 + b"s\4\0\0\0m.py" + b"t\3\0\0\0fun" + struct.pack("<i", 3) + b"s\1\0\0\0\xff"
    got = [r[3] for r in py(old)]
    assert got[3] == 'Marshalled Code object "fun"' and 'co_code: Str: "d"' in got and "co_lnotab: Str: 1 bytes" in got and "co_flags: 0x00000040 (NOFREE)" in got
    assert [r[3] for r in py(b"?abc")][-2:] == ["Marshalled Unknown marshal type 0x3F '?' (parsing stopped)", "Unparsed data (3 bytes)"]
    assert "Nesting too deep (parsing stopped)" in [r[3] for r in py(b")\1" * 100 + b"N")][-1]
    assert [r[3] for r in py(b"{NT0")][-4:] == ["Marshalled Dict (1 items)", "Key: None", "Value: True", "NULL (end of dict)"]
    assert [r[3] for r in py(b"l\xfe\xff\xff\xff\1\0\1\0")][-1] == "Marshalled Long: -32769" and [r[3] for r in py(b"l\0\0")][-1] == "Marshalled Truncated object"
    hashed = flat(dissect("Python bytecode", marshalled("1", header=struct.pack("<I", 3) + bytes(range(8)))))
    assert hashed[2][3] == "Flags: 0x3 (hash-based, checked)" and hashed[3][3] == "Source hash: 0001020304050607"


def dex_file():
    texts = [b"LA;", b"V", b"main", b"it's", "é\U0001f600".encode("utf-16-be")]
    texts[4] = b"\xc3\xa9\xed\xa0\xbd\xed\xb8\x80"
    at = 0x70 + 20 + 8 + 12 + 8 + 8 + 32
    strings, place = b"", []
    for t in texts:
        place.append(at + len(strings))
        strings += bytes([len(t)]) + t + b"\0"
    listed = at + len(strings)
    strings += struct.pack("<IH", 1, 0)
    mapped = at + len(strings)
    data = strings + struct.pack("<I", 1) + struct.pack("<HHII", 0x2002, 0, 5, at)
    body = struct.pack("<5I", *place) + struct.pack("<2I", 0, 1) + struct.pack("<3I", 1, 1, listed) + struct.pack("<HHI", 0, 1, 3) + struct.pack("<HHI", 0, 0, 2)
    body += struct.pack("<8I", 0, 0x11, 0xFFFFFFFF, 0, 4, 0, 0, 0)
    tables = [v for n, w in ((5, 20), (2, 8), (1, 12), (1, 8), (1, 8), (1, 32)) for v in (n, w)]
    offsets, p = [], 0x70
    for n, w in zip(tables[::2], tables[1::2], strict=True):
        offsets += [n, p]
        p += w
    size = 0x70 + len(body) + len(data)
    return b"dex\n035\0" + bytes(24) + struct.pack("<3I", size, 0x70, 0x12345678) + struct.pack("<3I", 0, 0, mapped) + struct.pack("<12I", *offsets) + struct.pack("<2I", len(data), at) + body + data


def test_dex():
    data = dex_file()
    found = flat(dissect("DEX", data))
    got = {r[3] for r in found}
    assert [r[3] for r in found if r[2] == 0][0:3] == ["DEX header", "string_ids (5 entries)", "type_ids (2 entries)"] and [r[3] for r in found if r[2] == 0][-1].startswith("Data (")
    assert {"proto_ids[0]: (LA;)V", "field_ids[0]: LA;->it's:V", "method_ids[0]: LA;->main(LA;)V", "class_defs[0]: LA;", "Access flags: 0x11 (public final)", "Superclass: NO_INDEX"} <= got
    assert {"string_data[3]: \"it\\'s\"", 'string_data[4]: "é\U0001f600"', "String data (5 strings)", "Endian tag: 0x12345678 (little-endian)", 'Source file: string 4 "é\U0001f600"'} <= got
    assert any(x.startswith("string_data_item: 5 at 0x") for x in got) and "Map list" in got and f"File size: {len(data)}" in got
    for n in range(len(data)):
        flat(dissect("DEX", data[:n]))
    assert "type_ids[0]: string 9 (invalid)" in {r[3] for r in flat(dissect("DEX", data[: 0x70 + 20] + struct.pack("<I", 9) + data[0x70 + 24 :]))}
