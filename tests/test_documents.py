"""PDF and PSD."""

import struct

from bytestrata.formats.pdf import shown, token, value
from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect


def rows(kind, data):
    found = flat(dissect(kind, data))
    assert all(0 <= r[4] <= r[5] <= len(data) for r in found)
    return found


def labels(kind, data):
    return {r[3] for r in rows(kind, data)}


PDF = (
    b"junk\r%PDF-1.7\r\n%\xe2\xe3\n1 0 obj\n<< /Type /Page /Subtype/X /Kids [1 0 R (a\\)(b)c) <41>] % note\n /N 5 >>\nendobj\n2 0 obj <</Length 5/Filter[/A /B]>>stream\r\nhello\nendstream endobj\n"
    b"3 0 obj (text)\n4 1 obj <</Length 9>> stream\nabc\r\nendstream\nendobj xref\n0 2\n0000000000 65535 f \n0000000017 00000 n \n5 1\nbad\ntrailer <</Size 2>>\nstartxref\n99\n%%EOF\n"
    b"5 0 obj null endobj\nstartxref x %%EOF"
)


def test_pdf():
    got = labels("PDF", PDF)
    top = [(r[3], r[4]) for r in rows("PDF", PDF) if r[2] == 0]
    assert top[:3] == [("Leading data (5 bytes)", 0), ("Header (PDF 1.7)", 5), ("Binary marker comment", 15)] and [x for x, _ in top[3:]] == ["Revision 1", "Revision 2"]
    assert {"Object 1 0 (/Type /Page /Subtype /X)", "Dictionary (4 entries)", "/Kids [1 0 R (a\\)(b)c) <41>]", "/N 5", "Body (4 objects)", "Body (1 object)", "Object 3 0", "Value: (text)"} <= got
    assert {"Stream data (5 bytes, A, B)", "Stream data (3 bytes, /Length 9 inconsistent)", "Object 2 0 (stream)", "Value: null", "startxref: 99", "startxref", "/Size 2"} <= got
    assert {"Subsection (objects 0-1, 2 entries)", "Object 0: free, next 0, gen 65535", "Object 1: offset 17, gen 0", "Subsection (first 5, 0 entries)"} <= got
    for n in range(len(PDF)):
        rows("PDF", PDF[:n])


def test_pdf_limits_and_lexer():
    many = b"%PDF-1.0\n" + b"".join(b"%d 0 obj %d endobj\n" % (i, i) for i in range(1005))
    assert "(5 more objects not shown)" in labels("PDF", many) and "Body (1005 objects)" in labels("PDF", many)
    wide = b"%PDF-1.0\n1 0 obj <<" + b"".join(b"/K%d %d " % (i, i) for i in range(70))
    assert {"(6 more entries not shown)", "Dictionary (70 entries), unterminated"} <= labels("PDF", wide)
    assert token(b" %c\n(a(b)\\))x", 0)[:3] == ("text", 4, 12) and value(b"1 2 R", 0) == (0, 5) and value(b"1 2 x", 0) == (0, 1) and value(b"]", 0) is None
    assert value(b"[<</A (]) >> 1 endobj", 0) == (0, 14) and token(b"(open", 0).end == 5 and token(b"", 0) is None
    assert shown(b"a \r\n b\x01") == "a b." and shown(b"x" * 61) == "x" * 60 + "..." and shown(b"x" * 60) == "x" * 60


def tag(key, body, sign=b"8BIM", layout=">I"):
    return sign + key + struct.pack(layout, len(body)) + body + bytes(len(body) % 2)


def sized(body, layout=">I"):
    return struct.pack(layout, len(body)) + body


def layer(name, wide=False, channels=((0, 4), (-1, 2))):
    n = ">hQ" if wide else ">hI"
    extra = sized(b"mask") + sized(b"") + (bytes([len(name)]) + name).ljust(4, b"\0") + tag(b"luni", struct.pack(">I", 2) + "é!".encode("utf-16-be")) + tag(b"lyid", struct.pack(">I", 7))
    return struct.pack(">4iH", -1, 2, 3, 4, len(channels)) + b"".join(struct.pack(n, *c) for c in channels) + b"8BIMmul \x80\0\x1b\0" + sized(extra)


def psd(wide=False):
    layout = ">Q" if wide else ">I"
    resources = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + sized(b"abc") + b"\0" + b"MeSa" + struct.pack(">H", 4321) + b"\3nam" + sized(b"")
    info = struct.pack(">h", -1) + layer(b"abc", wide) + b"\0\1zz\0\2" + b"\0\0"
    body = sized(info, layout) + sized(b"glob") + tag(b"Patt", b"xy") + tag(b"Lr16", b"q", b"8B64", layout)
    return b"8BPS" + struct.pack(">H", 1 + wide) + bytes(6) + struct.pack(">HIIHH", 3, 10, 20, 8, 5) + sized(b"pal") + sized(resources) + sized(body, layout) + b"\0\1data"


def test_psd():
    for wide in (False, True):
        data = psd(wide)
        got = labels("PSD", data)
        assert {f"Version: {1 + wide} ({'PSB' if wide else 'PSD'})", "Color mode: unknown (5)", "Resource 1005 (ResolutionInfo)", 'Resource 4321 (Plug-in resource) "nam"', "Compression: RLE"} <= got
        assert {"Layer count: -1 (first alpha channel is merged transparency)", 'Layer 0: "é!"', "Bounds: top -1, left 2, bottom 3, right 4", "Channel -1 (transparency mask): 2 bytes"} <= got
        assert {"Channel 0: RLE, 4 bytes", "Channel -1 (transparency mask): ZIP, 2 bytes", "Blend mode: Multiply (mul )", "Flags: 0x1B (transparency protected, hidden, pixel data irrelevant)"} <= got
        assert {"Layer mask data (4 bytes)", 'Layer name: "abc"', "luni (Unicode layer name)", "Layer ID: 7", "Global layer mask info", "Patt (Patterns)", "Lr16 (16-bit layer data)", "Padding"} <= got
        for n in range(len(data)):
            rows("PSD", data[:n])
    odd = psd().replace(b"MeSa", b"????")
    assert "Unknown data" in labels("PSD", odd)
