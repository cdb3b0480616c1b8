"""RPM, BPG and PIF."""

import struct

from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect


def rows(kind, data):
    found = flat(dissect(kind, data))
    assert all(0 <= r[4] <= r[5] <= len(data) for r in found)
    return found


def labels(kind, data):
    return {(r[3], r[4], r[5]) for r in rows(kind, data)}


def header(entries, store):
    return b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", len(entries), len(store)) + b"".join(struct.pack(">IIII", *e) for e in entries) + store


LEAD = b"\xed\xab\xee\xdb\3\0" + struct.pack(">HH", 1, 9) + b"pkg-1".ljust(66, b"\0") + struct.pack(">HH", 1, 5) + bytes(16)
SIGNED = header([(1000, 4, 0, 1), (62, 7, 4, 3), (9999, 0, 0, 0)], struct.pack(">I", 77) + b"\1\2\3")
STORE = b"pkg\0a\0b\0c\0d\0gzip\0C\0" + struct.pack(">HH", 5, 6)
MAIN = header([(1000, 6, 0, 1), (1117, 8, 4, 4), (1125, 6, 12, 1), (1004, 9, 17, 1), (1030, 3, 19, 2), (1117, 8, 4, 1)], STORE)
RPM = LEAD + SIGNED + bytes(-len(SIGNED) % 8) + MAIN + b"\x1f\x8bdata"


def test_rpm():
    got = {x[0] for x in labels("RPM", RPM)}
    assert {"Type: source (1)", "Name: pkg-1", "OS number: Linux (1)", "Signature type: header-style (5)", "SIZE: 77", "HEADERSIGNATURES: 010203", "Tag 9999"} <= got
    assert {"NAME: pkg", 'BASENAMES: ["a", "b", "c", …] (4 items)', "BASENAMES: a", "SUMMARY: C", "FILEMODES: [5, 6] (2 items)", "Payload (gzip, 6 bytes)", "Type: I18NSTRING (9)"} <= got
    pad = -len(SIGNED) % 8
    assert f"Signature padding ({pad} bytes)" in got and pad
    at = 96 + len(SIGNED) + pad + 16 + 6 * 16
    assert ("BASENAMES", at + 4, at + 12) in labels("RPM", RPM) and ("FILEMODES", at + 19, at + 23) in labels("RPM", RPM)
    for n in range(len(RPM)):
        rows("RPM", RPM[:n])
    many = rows("RPM", LEAD + header([(1000, 6, 0, 1)] * 300, b"x\0"))
    assert ("… 44 more entries", 96 + 16 + 256 * 16, 96 + 16 + 300 * 16) in {r[3:6] for r in many}
    assert rows("RPM", LEAD + b"junk")[-1][3:6] == ("Unparsed data", 96, 100)


def small(body=b"\x26\1ab\0\0\0\1\x44\x09zz\0\0\1\x02"):
    bits = "1" * 5 + "0" + "0" + "1" + "0"
    head = int(bits.ljust(16, "0"), 2).to_bytes(2, "big") + b"?"
    return b"\3" + head + body


def test_bpg():
    inner = b"BPG\xfb\x20\0\1\1\0" + small()
    extensions = b"\5\4\0\1\x19?" + bytes([4, len(inner)]) + inner + b"\x63\1x"
    data = b"BPG\xfb\x35\x1d\x81\0\x40\0" + bytes([len(extensions)]) + extensions + small() + small()
    got = {x[0] for x in labels("BPG", data)}
    assert {"Pixel format: 4:2:0 (JPEG chroma position) (1)", "Bit depth: 13", "Color space: RGB (1)", "Alpha: alpha (premultiplied)", "Width: 128", "Picture data length: 0 (until end of file)"} <= got
    assert {"Loop count: 0 (infinite)", "Frame period: 1/25 s (0.040 s)", "Padding", "Thumbnail (BPG)", "Extension: Unknown (1 bytes)", "Alpha HEVC header", "Color HEVC header"} <= got
    assert {"strong_intra_smoothing_enabled_flag: 1", "sps_extension_present_flag: 0", "Extra header bytes", "NAL unit: IDR_W_RADL", "NAL unit: PPS"} <= got
    assert "NAL header: type 34 (PPS), layer 1, temporal_id_plus1 1" in got and "Truncated NAL unit" in got
    for n in range(len(data)):
        rows("BPG", data[:n])
    plain = b"BPG\xfb\x20\0\1\1\5" + small()
    assert [(r[3], r[4]) for r in rows("BPG", plain) if r[2] == 0] == [("BPG header", 0), ("Picture data", 9), ("Trailing data", 14)]


def test_pif():
    basic = b"\0\x78" + b"Title   ".ljust(30, b" ") + struct.pack("<HH", 640, 0xFFFF) + b"C:\\A.EXE".ljust(63, b"\0") + struct.pack("<H", 0x8011) + bytes(0x10A) + struct.pack("<H", 0x20)
    assert len(basic) == 0x171
    heading = lambda name, following, at, n: name.ljust(16, b"\0") + struct.pack("<HHH", following, at, n)
    first = heading(b"MICROSOFT PIFEX", 0x187, 0, 0x171)
    second = heading(b"WINDOWS 286 3.0", 0x1A3, 0x19D, 6) + struct.pack("<HHH", 1, 2, 3)
    third = heading(b"CONFIG  SYS 4.0", 0x187, 0x1B9, 12)
    data = basic + first + second + third + b"FILES=9\r\nA=1end"
    got = labels("PIF", data)
    assert {('Window title: "Title"', 2, 32), ("Max conventional memory: 640 KB", 32, 34), ("Min conventional memory: all available / auto (0xFFFF)", 34, 36)} <= got
    assert {("Flags: 0x8011 (Directly modify memory, Close window on exit, unknown bits 0x8000)", 0x63, 0x65), ("Flags 2: 0x0020 (Use coprocessor)", 0x16F, 0x171)} <= got
    assert {("Section data: WINDOWS 286 3.0", 0x19D, 0x1A3), ("Flags: 0x0003 (Reserve Alt+Tab, Reserve Alt+Esc)", 0x1A1, 0x1A3), ('Line: "FILES=9"', 0x1B9, 0x1C2)} <= got
    assert ("Trailing data (3 bytes)", len(data) - 3, len(data)) in got and sum(x[0].startswith("Section heading") for x in got) == 3
    for n in range(0x160, len(data)):
        rows("PIF", data[:n])
