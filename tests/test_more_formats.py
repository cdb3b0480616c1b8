"""JPEG, bzip2, Atari and DOS programs; files, registered formats and questions over blocks."""

import bz2
import os
import random
import struct

import pytest
from bytestrata.formats.tree import Node, flat
from bytestrata.formats.walkers import dissect
from bytestrata.operators import blocks as B
from bytestrata.operators import recognise
from bytestrata.sources import files as S


def rows(kind, data):
    return flat(dissect(kind, data))


def labels(kind, data):
    return {(r[3], r[4], r[5]) for r in rows(kind, data)}


def exif(order="<"):
    def ifd(entries, more=0):
        return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries) + struct.pack(order + "I", more)

    short = lambda n: struct.pack(order + "HH", n, 0)
    long = lambda n: struct.pack(order + "I", n)
    top = ifd([(0x112, 3, 1, short(6)), (0x10F, 2, 3, b"Me\0\0"), (0x8825, 4, 1, long(62)), (0xBEEF, 7, 9, long(0))])
    gps = ifd([(1, 2, 2, b"N\0\0\0"), (2, 5, 3, long(92))])
    body = (b"II*\0" if order == "<" else b"MM\0*") + long(8) + top
    body = body.ljust(62, b"\0") + gps
    return body.ljust(92, b"\0") + struct.pack(order + "6I", 37, 1, 25, 1, 1907, 100)


def jpeg(order):
    body = b"Exif\0\0" + exif(order)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xdb\0\4ab\xff\xda\0\3\0data\xff\0more\xff\xd0x\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_jpeg_directories_and_scans(order):
    data = jpeg(order)
    found = labels("JPEG", data)
    names = {x[0] for x in found}
    assert {"APP1 marker (Exif)", "Orientation: Rotated 90 CW (Vertical) (6)", "Make: Me", "GPS IFD", "GPSLatitudeRef: North (N)", "GPSLatitude: 37°25'19.07\" (37.421964°)", "Tag 0xbeef (UNDEFINED, count 9)", "Quantization table data", "EOI"} <= names
    at = data.index(b"\xff\xda")
    # no components, then three bytes of spectral selection, whichever they are
    assert ("SOS", at, len(data) - 2) in found and ("Spectral selection / approximation", at + 5, at + 8) in found and ("Entropy-coded scan data", at + 8, len(data) - 2) in found
    for n in range(len(data)):
        rows("JPEG", data[:n])


def test_bzip2_blocks_at_any_bit():
    gen = random.Random(1)
    one = bz2.compress(bytes(gen.randrange(256) for _ in range(250_000)), 1)
    found = rows("bzip2", one)
    top = [r[3] for r in found if r[2] == 0]
    assert top[0] == "Stream header" and [x.split(" [")[0] for x in top[1:]] == ["Block 1", "Block 2", "Block 3", "End of stream"]
    assert top[1] == "Block 1" and found[4][4:6][0] == 4
    ends = [(r[4], r[5]) for r in found if r[3].startswith("Block ") and r[2] == 0]
    assert all(a[1] - b[0] in (0, 1) for a, b in zip(ends, ends[1:]))
    two = rows("bzip2", bz2.compress(b"a") + bz2.compress(b"") + b"tail")
    assert [r[3] for r in two if r[2] == 0] == ["Stream 1 (1 block)", "Stream 2 (0 blocks)", "Trailing data"]
    for n in range(0, 400):
        rows("bzip2", one[:n])


def test_bzip2_shows_as_many_blocks_as_it_may(monkeypatch):
    from bytestrata.formats import packed

    monkeypatch.setattr(packed, "BLOCKS_SHOWN", 2)
    one = bz2.compress(os.urandom(350_000), 1)
    assert [r[3] for r in rows("bzip2", one) if r[2] == 0 and "not shown" in r[3]] == ["Blocks 3-4 (not shown)"]
    two = [r[3] for r in rows("bzip2", bz2.compress(os.urandom(150_000), 1) + bz2.compress(b"b") * 2) if r[2] == 0]
    assert two == ["Stream 1 (2 blocks)", "Streams 2-3 (not shown)"]


def test_atari_programs():
    head = struct.pack(">HIIIIIIH", 0x601A, 8, 4, 16, 28, 0, 0x10000017, 0)
    symbols = b"longname" + struct.pack(">HI", 0x8248, 5) + b"_more\0".ljust(14, b"\0")
    data = head + bytes(8) + b"DATA" + symbols + struct.pack(">I", 2) + bytes([1, 4, 3])
    found = labels("Atari ST program", data)
    assert {("Symbol table (DRI/GST, 1 symbols)", 40, 68), ("longname_more = 0x00000005", 40, 68), ("Relocation table (2 fixups) [invalid odd delta]", 68, 75), ("Fixup: text+0x00000104", 73, 74)} <= found
    assert "TPA size (bits 28-31): 1 (256 KB minimum TT-RAM)" in {x[0] for x in found} and "Memory protection (bits 4-5): global" in {x[0] for x in found}
    for n in range(len(data)):
        rows("Atari ST program", data[:n])
    many = head[:14] + struct.pack(">IIIH", 0, 0, 0, 0) + bytes(12) + struct.pack(">I", 2) + bytes([2] * 300) + b"\0"
    assert "Fixup targets (first 256 of 301)" in {x[0] for x in labels("Atari ST program", many)}


def test_recognition_of_dos_images(spark):
    call = b"\xb4\x4c\xcd\x21"
    known = [
        ("DOS COM", b"\xeb\x02\x90\x90" + call), ("DOS COM", b"\xe9\x01\x00\x90" + call), ("DOS COM", b"\xfc" + call), ("DOS COM", b"\x31\xc0" + call), ("DOS COM", b"\x8c\xc8" + call), ("Data", b"\x31\xc1" + call),
        ("Data", b"\xeb\x7f\x90\x90" + call), ("Data", b"\xeb\xfe" + call), ("Data", b"\xfc" + bytes(40) + call), ("Data", b"\x90" + call), ("Data", b"\xfc" + call + bytes(0xFF00)), ("Data", b"MZ\xfc" + call),
        ("Data", b"\xfc"), ("Data", b"\xe9\x00"), ("Data", b"\xfc\xcd\x21" + b"text " * 20),
    ]
    df = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(known)], "path long, content binary")
    got = {r.path: r.t for r in df.select("path", B.identify(df.content).alias("t")).collect()}
    assert [got[i] for i in range(len(known))] == [t for t, _ in known]
    for _, d in known:
        rows("DOS COM", d[:300])
    assert "Bytes skipped by entry jump (0102h–0103h, likely data)" in {x[0] for x in labels("DOS COM", known[0][1])}
    assert "Possible INT 21h calls (70, first 64 shown)" in {x[0] for x in labels("DOS COM", b"\xfc" + b"\xcd\x21" * 70)}


def test_registered_formats(spark, monkeypatch):
    monkeypatch.setattr(recognise, "REGISTERED", recognise.REGISTERED[:0])
    monkeypatch.setattr(B, "REGISTERED", recognise.REGISTERED)
    monkeypatch.setattr(B, "_WALKERS", {})
    B.register_dissector("Note", lambda b: b.at(0, b"BM!"), lambda v: [Node(f"Note of {v.size}", 0, v.size)], before="BMP")
    df = spark.createDataFrame([(1, b"BM!x"), (2, b"BM"), (3, None)], "path long, content binary")
    assert sorted((r.path, r.file_type, r.label) for r in B.blocks(df).collect() if r.path == 1) == [(1, "Note", "Note of 4")]
    assert {r.t for r in df.select(B.identify(df.content).alias("t")).collect()} == {"Note", "BMP", "Data"}


def test_files_are_scanned_dissected_and_watched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    contents = {"a.bmp": b"BM" + bytes(60), "sub/b.gif": b"GIF89a", "empty": b"", "c.txt": b"words"}
    for name, data in contents.items():
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    found = S.scan(spark, f"file://{tmp_path}/in")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.file_type, r.status) for r in S.summary(found).collect()}
    assert got == {"a.bmp": (62, "BMP", "Size: 62 bytes, Type: BMP | Dissected as: BMP"), "b.gif": (6, "GIF", "Size: 6 bytes, Type: GIF | Dissected as: GIF"), "c.txt": (5, "Data", "Size: 5 bytes, Type: Data | Dissected as: Data")}
    assert {(r.label, r.start, r.end, r.size) for r in S.dissected(found).where("path like '%txt'").collect()} == {("Data", 0, 5, 5)}
    assert S.scan(spark, f"file://{tmp_path}/in", glob="*.gif").count() == 1
    stream = B.blocks(S.watch(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    stream.awaitTermination(120)
    assert {r.file_type for r in spark.table("seen").collect()} == {"BMP", "Data"}


def test_ancestors_chunks_and_large_tables(spark, monkeypatch):
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    data = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"trak", box(b"mdia", box(b"free", b"x"))))
    tree = B.blocks(spark.createDataFrame([(1, data)], "path long, content binary")).cache()
    deepest = max(tree.collect(), key=lambda r: r.depth)
    around = sorted((r.steps, r.ancestor) for r in B.ancestors(tree).where(f"idx = {deepest.idx}").collect())
    assert [s for s, _ in around] == list(range(1, deepest.depth + 1)) and around[0][1] == deepest.parent
    monkeypatch.setattr(B, "CHUNK_LINES", 3)
    df = spark.createDataFrame([(1, bytes(range(256)) + b"end"), (2, b""), (3, None)], "path long, content binary")
    lines = {r.line: r.text for r in B.hex_lines(df).collect()}
    assert len(lines) == 17 and lines[16] == "00000100  65 6e 64 " + " " * 39 + " end" and lines[4].endswith(" @ABCDEFGHIJKLMNO")
    ranges = spark.createDataFrame([(1, 5, 200), (1, 7, 7)], "path long, start long, end long")
    assert [(r.line, r.hl_start, r.hl_end) for r in sorted(B.highlight(ranges).collect(), key=lambda r: r.line)] == [(k, max(5, 16 * k), min(200, 16 * k + 16)) for k in range(13)]
    monkeypatch.setattr(B, "ROWS_AT_ONCE", 4)
    assert B.blocks(df.where("path = 1").unionByName(spark.createDataFrame([(9, data)], "path long, content binary"))).where("path = 9").count() == tree.count()
