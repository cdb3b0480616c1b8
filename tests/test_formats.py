"""Recognition by the ladder, and walkers of executables and containers, on small built contents."""

import io
import struct
import zipfile

import pytest
from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect
from bytestrata.operators.blocks import blocks, identify


def stub(tail: bytes) -> bytes:
    return b"MZ" + bytes(58) + struct.pack("<I", 64) + tail


def dol(second=0x180, entry=0x80003000, address=0x80003000) -> bytes:
    head = bytearray(0x100)
    struct.pack_into(">I", head, 0, 0x100)
    struct.pack_into(">I", head, 0x1C, second)
    for at, n in ((0x48, address), (0x48 + 0x1C, 0x80004000), (0x90, 0x80), (0x90 + 0x1C, 0x20), (0xE0, entry)):
        struct.pack_into(">I", head, at, n)
    return bytes(head) + bytes(0xA0)


def archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.comment = b"hi"
    return out.getvalue()


LINEAR = b"LX\0\0" + bytes(4) + struct.pack("<HH", 2, 1) + bytes(28) + struct.pack("<I", 4096) + bytes(132)
KNOWN = [
    ("ELF", b"\x7fELF"), ("PE", stub(b"PE\0\0")), ("NE", stub(b"NE")), ("LE", stub(b"LE\0\0")), ("LX", LINEAR), ("Data", LINEAR[:-1]), ("Data", LINEAR[:40] + struct.pack("<I", 4097) + LINEAR[44:]),
    ("Mach-O", b"\xcf\xfa\xed\xfe"), ("DEX", b"dex\n035\0"), ("Data", b"dex\n03x\0"), ("Java class", b"\xca\xfe\xba\xbe\0\0\0\x34\0\1"), ("Data", b"\xca\xfe\xba\xbe\0\0\0\x02\0\1"),
    ("NRO", bytes(16) + b"NRO0" + bytes(4) + struct.pack("<I", 0x80)), ("MIDI", b"MThd\0\0\0\6" + bytes(6)), ("Data", b"MThd\0\0\0\6" + bytes(5)), ("MIDI", b"RIFF\0\0\0\0RMID"),
    ("MP4", b"\0\0\0\x14ftypisom"), ("Data", b"\0\0\0\7ftyp"), ("MP4", b"\0\0\0\1ftyp" + bytes(7) + b"\x10"), ("Data", b"\0\0\0\1ftyp"), ("DOL", dol()), ("ICO", b"\0\0\1\0\0\0"),
    ("ICO", dol(second=0x160)), ("ICO", dol(entry=0x80004000)), ("ICO", dol(address=0x1000)), ("PSD", b"8BPS\0\1"), ("Data", b"8BPS\0\3"), ("PIF", bytes(0x171) + b"MICROSOFT PIFEX\0" + bytes(6)),
    ("bzip2", b"BZh91AY&SY"), ("Data", b"BZh01AY&SY"), ("ZIP", archive()), ("SWF", b"CWS\6\0\0\0\0"), ("Data", b"CWS\x41\0\0\0\0"), ("Python bytecode", struct.pack("<H", 3571) + b"\r\n" + bytes(12) + b"\xe3"),
    ("Data", struct.pack("<H", 3571) + b"\r\n\4" + bytes(11) + b"\xe3"), ("Python bytecode", struct.pack("<H", 62211) + b"\r\n\1\2\3\4c"), ("Atari ST program", b"\x60\x1a\0\0\0\4" + bytes(26)),
    ("Data", b"\x60\x1a\0\0\0\5" + bytes(26)), ("TE", b"VZ" + struct.pack("<HBBH", 0x8664, 1, 0, 41) + bytes(72)), ("Data", b"VZ" + struct.pack("<HBBH", 0x8664, 1, 0, 40) + bytes(72)),
    ("PDF", b"%PDF-1"), ("PDF", b"x\n%PDF-1"), ("Data", b"x%PDF-1"), ("PDF", b" " * 1022 + b"\n%PDF-1"), ("Data", b" " * 1023 + b"\n%PDF-1"), ("Data", b""), ("Data", b"\xff"), ("Data", b"MZ"),
]


def test_ladder(spark):
    df = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(KNOWN)], "i int, content binary")
    got = {r["i"]: r["t"] for r in df.select("i", identify(df["content"]).alias("t")).collect()}
    assert [(i, got[i]) for i in range(len(KNOWN))] == [(i, n) for i, (n, _) in enumerate(KNOWN)]


ELF = (
    b"\x7fELF\2\1\1\3" + bytes(8) + struct.pack("<HHIQQQIHHHHHH", 2, 0x3E, 1, 0x400000, 64, 120, 0, 64, 56, 1, 64, 2, 1)
    + struct.pack("<IIQQQQQQ", 1, 5, 0, 0x400000, 0x400000, 120, 120, 4096) + bytes(64) + struct.pack("<IIQQQQIIQQ", 1, 3, 0, 0, 248, 11, 0, 0, 1, 0) + b"\0.shstrtab\0"
)
PE = stub(b"PE\0\0") + struct.pack("<HHIIIHH", 0x8664, 1, 5, 0, 0, 4, 0x22) + b"\x0b\2xx" + b".text\0\0\0" + struct.pack("<IIIIIIHHI", 1, 0x1000, 512, 1024, 0, 0, 0, 0, 0x60000020)
MACHO = struct.pack("<IiiIIIII", 0xFEEDFACF, 0x0100000C, -1, 2, 2, 32, 1, 0) + struct.pack("<II", 0x19, 24) + b"__TEXT".ljust(16, b"\0") + struct.pack("<II", 9, 8)
OGG = b"OggS\0\2" + struct.pack("<qIIIB", -1, 7, 0, 9, 1) + b"\x08OpusHead" + b"OggS\0\4" + struct.pack("<qIIIB", 5, 7, 1, 9, 0)
GIF = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 1, 0) + bytes(6) + b"!\xf9\4abcd\0" + b"," + struct.pack("<HHHHB", 0, 0, 3, 2, 0x40) + b"\2\1x\0;"
ICO = b"\0\0\1\0\1\0" + struct.pack("<BBBBHHII", 0, 16, 0, 0, 1, 32, 44, 22) + struct.pack("<IiiHHII", 40, 16, 32, 1, 32, 0, 4) + bytes(20)
MVHD = bytes(4) + struct.pack(">IIII", 2082844800, 2082844801, 1000, 90500) + struct.pack(">IH", 0x18000, 256)
MDHD = b"\1" + bytes(3) + struct.pack(">QQIQ", 0, 0, 2, 7205) + struct.pack(">HH", 0x15C7, 0)
HDLR = bytes(8) + b"vide" + bytes(12) + b"Video\0"


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


MP4 = box(b"ftyp", b"isom" + struct.pack(">I", 512) + b"mp41") + box(b"moov", box(b"mvhd", MVHD) + box(b"trak", box(b"mdhd", MDHD) + box(b"hdlr", HDLR))) + b"\0\0\0\0mdatxyz"
SWF = b"FWS\6" + struct.pack("<I", 30) + bytes([0x28, 0x14, 0x01, 0x40]) + struct.pack("<HH", 0x0C80, 1) + struct.pack("<H", 9 << 6 | 3) + b"rgb" + struct.pack("<HI", 82 << 6 | 63, 2) + b"ab" + b"\0\0!"
CASES = [
    ("MP4", MP4, {("ftyp (File Type)", 0, 20), ("Compatible brand: mp41", 16, 20), ("mvhd (Movie Header)", 28, 62), ("Creation time: 2082844800 (1970-01-01 00:00:00 UTC)", 40, 44),
                  ("Duration: 90500 (1:30.500)", 52, 56), ("Rate: 1.5", 56, 60), ("Volume: 1", 60, 62), ("Duration: 7205 (1:00:02.500)", 102, 110), ("Language: eng", 110, 112),
                  ("Handler type: vide", 130, 134), ("Name: Video", 146, 152)}),
    ("SWF", SWF, {("Nbits: 5", 8, 9), ("Frame rate: 12.5 fps", 12, 14), ("Frame count: 1", 14, 16), ("SetBackgroundColor", 16, 21), ("Data (3 bytes)", 18, 21), ("DoABC", 21, 29), ("Length: 2", 23, 27), ("End", 29, 31), ("Tags (3)", 16, 31), ("Trailing data", 31, 32)}),
    ("DOL", dol(), {("Text 0: offset 0x100, load 0x80003000, 0x80 bytes", 0, 148), ("Entry point: 0x80003000 (in Text 0)", 224, 228), ("Text 0 (load 0x80003000, 0x80 bytes)", 256, 384),
                    ("Data 0 (load 0x80004000, 0x20 bytes)", 384, 416), ("Text 1: unused", 4, 152)}),
    ("ELF", ELF, {("Endianness: little", 5, 6), ("OS/ABI: Linux", 7, 8), ("Header: 64-bit", 16, 64), ("Program header 0: LOAD", 64, 120), ("Flags: R X", 68, 72), ("Section header 0: NULL", 120, 184),
                  ("Name: (none) (0x0)", 120, 124), ("Section header 1: .shstrtab", 184, 248), ("Name: .shstrtab (0x1)", 184, 188), ("Size: 0xb", 216, 224)}),
    ("PE", PE, {("PE header offset: 64", 60, 64), ("PE signature: PE\\0\\0", 64, 68), ("Machine: AMD64", 68, 70), ("Magic: PE32+ (64-bit)", 88, 90), ("Optional header data", 90, 92),
                ("Section: .text", 92, 132), ("Virtual address: 0x1000", 104, 108), ("Characteristics: 0x60000020", 128, 132), ("Characteristics: 0x0022", 86, 88)}),
    ("Mach-O", MACHO, {("Magic: 0xfeedfacf", 0, 4), ("64-bit: true", 0, 4), ("CPU type: ARM64", 4, 8), ("CPU subtype: -1", 8, 12), ("Load command: LC_SEGMENT_64 (__TEXT)", 32, 56),
                       ("Segment name: __TEXT", 40, 56), ("Load command: LC_UNKNOWN (0x00000009)", 56, 64), ("Command: LC_UNKNOWN (0x00000009)", 56, 60)}),
    ("ZIP", archive(), {("Local file header: a.txt", 0, 40), ("File data", 35, 40), ("Compression method: Stored", 8, 10), ("CRC-32: 0x3610a686", 14, 18), ("Central directory entry: a.txt", 40, 91),
                        ("Local header offset: 0", 82, 86), ("End of central directory", 91, 115), ("Comment", 113, 115)}),
    ("OGG", OGG, {("Page 0", 0, 36), ("Header type flag: 0x02 (first page (bos))", 5, 6), ("Granule position: -1", 6, 14), ("Payload data (Opus header)", 28, 36), ("Page 1", 36, 63), ("CRC checksum", 22, 26)}),
    ("GIF", GIF, {("Canvas width: 3", 6, 8), ("Global color table flag: true", 10, 11), ("Size of global color table: 2", 10, 11), ("Global color table (2 entries)", 13, 19),
                  ("Extension: Graphic Control Extension", 19, 27), ("Sub-block (4 bytes)", 21, 26), ("Interlace flag: true", 36, 37), ("Image data", 38, 41), ("Trailer", 41, 42)}),
    ("ICO", ICO, {("Type: 1 (ICO)", 2, 4), ("Width: 256", 6, 7), ("Height: 16", 7, 8), ("Image data: DIB image (44 bytes)", 22, 66), ("Height (combined XOR+AND masks): 32", 30, 34)}),
]


@pytest.mark.parametrize(("kind", "data", "some"), CASES)
def test_labels_and_every_truncation(kind, data, some):
    found = {(r[3], r[4], r[5]) for r in flat(dissect(kind, data))}
    assert some <= found, some - found
    for n in range(len(data)):
        flat(dissect(kind, data[:n]))


def test_blocks_of_mixed_contents(spark):
    rows = [(kind, data) for kind, data, _ in CASES] + [("none", None), ("Data", b"")]
    got = blocks(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r["path"], r["file_type"]) for r in got} == {(k, k) for k, _, _ in CASES} | {("Data", "Data")}
