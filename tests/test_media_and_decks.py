"""Matroska, MIDI, OS/360 decks and NRO; recognition of these, Amiga hunks and MPEG audio."""

import datetime
import struct

import pytest
from bytestrata.formats.matroska import decimal, value, varint
from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect
from bytestrata.operators.recognise import identify


def rows(kind, data):
    return flat(dissect(kind, data))


def labels(kind, data):
    return {(r[3], r[4], r[5]) for r in rows(kind, data)}


def el(who, body, size=None):
    raw = bytes.fromhex(who)
    return raw + (bytes([0x80 | len(body)]) if size is None else size) + body


def ebml(doc=b"webm"):
    return el("1A45DFA3", el("4286", b"\1") + el("4282", doc))


BLOCK = el("A3", b"\x81\xff\xfe\x81frame")
MKV = ebml(b"matroska\0x") + el("18538067", el("1549A966", el("4489", struct.pack(">d", 48000.0)) + el("4461", bytes(8))) + el("1654AE6B", el("AE", el("83", b"\2"))) + el("1F43B675", el("E7", b"\5") + BLOCK, b"\xff"), b"\xff")


def test_matroska():
    got = labels("Matroska", MKV)
    assert ("EBML header (DocType: matroska)", 0, len(ebml(b"matroska\0x"))) in got
    base = MKV.index(BLOCK)
    assert ("SimpleBlock: track 1, timecode -2, keyframe (9 bytes)", base, len(MKV)) in got
    assert ("Flags: 0x81 (keyframe, lacing none, discardable)", base + 5, base + 6) in got
    assert {"Duration: 48000", "DateUTC: 2001-01-01 00:00:00 UTC", "TrackType: 2 (audio)", "Size: unknown", "Segment", "ID: 0x1F43B675 (Cluster)"} <= {x[0] for x in got}
    for n in range(len(MKV)):
        rows("Matroska", MKV[:n])


def test_matroska_odds():
    # a value cut by its parent says so twice; an unknown id; sizes beyond the content
    assert {r[3] for r in rows("Matroska", el("4D80", b"abc")[:-1])} >= {"MuxingApp: (truncated) (truncated)", "Value: (truncated)"}
    assert rows("Matroska", el("4099", b"??"))[0][3] == "Unknown element 0x4099 (2 bytes)"
    many = el("EC", b"") * 300
    assert rows("Matroska", many)[-1][3:6] == ("(44 more not shown)", 512, 600)
    deep = b"".join(bytes.fromhex("AE") + b"\xff" for _ in range(20))
    assert "Data (nesting too deep to parse)" in {r[3] for r in rows("Matroska", deep)}
    assert varint(b"\0" * 9, 0) is None and varint(b"\x40\x02", 0) == (0x4002, 2)
    assert [decimal(x) for x in (0.5, 1e21, float("nan"), float("-inf"), -0.0)] == ["0.5", "1000000000000000000000", "NaN", "-inf", "-0"]
    assert value(0x4461, "d", (10**9 * 86400).to_bytes(8, "big")) == str(datetime.date(2001, 1, 2)) + " 00:00:00 UTC"
    assert value(0x4489, "f", b"123") is None and value(0xFB, "i", b"\xff") == "-1"


def chunk(who, body):
    return who + struct.pack(">I", len(body)) + body


TRACK = bytes.fromhex("00FF0304 4C656164 00903C40 8100 3C00 00C000 00E00040 00FF5103 07A120 00FF5804 06030808 00FF5902 FE01 00F0027EF7 00FF2F00 AA")
SMF = chunk(b"MThd", struct.pack(">HHH", 1, 1, 0xE250)) + chunk(b"MTrk", TRACK) + b"xyz"


def test_midi():
    got = labels("MIDI", SMF)
    told = {x[0] for x in got}
    assert ("Header chunk (MThd)", 0, 14) in got and ("Division: SMPTE 30 fps, 80 ticks/frame", 12, 14) in got and ("Trailing data", len(SMF) - 3, len(SMF)) in got
    assert 'Track 1 (MTrk): "Lead" — 10 events' in told and "Δ128: Note On ch 1 C4 vel 0 (= Note Off) (running status)" in told
    assert "Δ0: Program Change ch 1 0 (Acoustic Grand Piano)" in told and "Pitch bend: 0 (LSB 0, MSB 64)" in told
    assert "Tempo: 500000 µs/quarter (120.00 BPM)" in told and "Δ0: Time Signature: 6/8" in told and "Δ0: Key Signature: G minor" in told and "Δ0: SysEx, 2 bytes" in told
    assert ("Data after End of Track", len(SMF) - 4, len(SMF) - 3) in got
    for n in range(len(SMF)):
        rows("MIDI", SMF[:n])
    lone = rows("MIDI", chunk(b"MTrk", b"\0\x40"))
    assert lone[0][3] == "Track 1 (MTrk) — 0 events" and lone[-1][3] == "Invalid data: byte 0x40 with no running status"
    many = rows("MIDI", chunk(b"MTrk", b"\0\x90\x3c\x40" + b"\0\x3c\x00" * 600))
    assert many[0][3].endswith("— 601 events") and many[-1][3:6] == ("(101 more events not shown)", 8 + 4 + 3 * 499, 8 + 4 + 1800)
    broken = rows("MIDI", chunk(b"MTrk", b"\0\x90\x3c\x40" + b"\0\x3c\x00" * 600 + b"\0\xf4"))
    assert broken[0][3].endswith("— 500 events") and [r[3] for r in broken[-2:]] == ["(101 more events not shown)", "Invalid status byte 0xF4"]
    body = SMF[:-3]
    riff = b"RIFF" + struct.pack("<I", 4 + 8 + len(body) + len(body) % 2) + b"RMIDdata" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    assert ("Standard MIDI File", 20, 20 + len(body)) in labels("MIDI", riff) and rows("MIDI", riff)[0][3] == "RIFF header"


def card(kind, *parts):
    raw = bytearray(b"\x40" * 80)
    raw[:4] = b"\2" + kind.encode("cp037")
    for at, part in parts:
        raw[at : at + len(part)] = part
    return bytes(raw)


E = lambda s: s.encode("cp037")
DECK = (
    card("ESD", (10, b"\0\x20"), (14, b"\0\1"), (16, E("MAIN    ") + b"\0\0\0\0\6\0\1\0" + E("EXT     ") + b"\2\0\0\0\0\0\0\0"))
    + card("TXT", (5, b"\0\0\x10"), (10, b"\0\4"), (14, b"\0\1"), (16, b"abcd"))
    + card("RLD", (10, b"\0\x0c"), (16, b"\0\2\0\1\x0d\0\0\4\x0e\0\0\x08"))
    + card("END", (5, b"\0\0\0"), (14, b"\0\1"), (32, E("1") + E("ASM       0102") + E("24123")))
    + E("  NAME X").ljust(80, b"\x40")
)


def test_object_module():
    got = labels("OS/360 Object Module", DECK)
    told = {x[0] for x in got}
    assert ("Card 1: ESD, 2 items (SD MAIN, ER EXT)", 0, 80) in got and "SD MAIN (ESDID 1) addr 0x000000 len 0x000100" in told and "ER EXT (ESDID 2)" in told
    assert "Flags: 0x06 (AMODE 31, RMODE ANY)" in told and ("Card 2: TXT addr 0x000010, 4 bytes, ESDID 1 (MAIN)", 80, 160) in got and ("Text (4 bytes)", 96, 100) in got
    assert "R pointer (ESDID): 2 (EXT)" in told and ("Entry 2: A(4) -, R 2 P 1, addr 0x000008 (same R/P)", 184, 188) in got and "Card 3: RLD, 2 entries" in told
    assert "Card 4: END entry 0x000000 ESDID 1 (MAIN), 1 IDR item" in told and "IDR 1: ASM V01 M02, 24123" in told
    assert ("Card 5: control statement \"NAME X\"", 320, 400) in got and 'Deck ID / sequence: "        "' in told
    for n in range(len(DECK)):
        rows("OS/360 Object Module", DECK[:n])
    assert rows("OS/360 Object Module", DECK[:70])[0][3] == "Card 1: ESD, 2 items (SD MAIN, ER EXT) (truncated, 70 bytes)"
    long = rows("OS/360 Object Module", DECK[80:160] * 4100 + b"\2")
    assert long[-1][3:6] == ("… 5 more cards", 4096 * 80, 4100 * 80 + 1)


def nro():
    head = struct.pack("<II8x", 0, 0x80) + b"NRO0" + struct.pack("<III", 0, 0xC0, 0) + struct.pack("<6I", 0, 0xA0, 0xA0, 0x10, 0xB0, 0x10) + bytes(8) + bytes(range(32)) + bytes(8)
    head += struct.pack("<6I", 0, 0, 4, 8, 0, 99)
    assert len(head) == 0x80
    module = b"MOD0" + struct.pack("<6i", 16, -32, 0, 0, 0, 0)
    body = (head + module).ljust(0xC0, b"\0")
    control = (b"Game".ljust(0x200, b"\0") + b"Me".ljust(0x100, b"\0")).ljust(0x3060, b"\0") + b"1.0".ljust(0xFA0, b"\0")
    return body + b"ASET" + struct.pack("<I6Q", 0, 0x38, 4, 0x3C, 0x4000, 0, 0) + b"icon" + control


def test_nro():
    data = nro()
    got = labels("NRO", data)
    assert ("MOD0 offset: 0x80", 4, 8) in got and ("BSS start offset: -0x20 (-> 0x60)", 0x88, 0x8C) in got and ("Dynamic offset: +0x10 (-> 0x90)", 0x84, 0x88) in got
    assert (".ro segment (16 bytes)", 0xA0, 0xB0) in got and (".dynstr (8 bytes)", 0xA4, 0xAC) in got and (".dynsym (99 bytes)", 0xA0, 0xB0) in got
    assert ("Icon (JPEG, 4 bytes)", 0xF8, 0xFC) in got and ("Name: Game", 0xFC, 0x2FC) in got and ("Display version: 1.0", 0xFC + 0x3060, 0xFC + 0x3070) in got
    assert ("Asset section (ASET)", 0xC0, len(data)) in got
    assert rows("NRO", data[:0xC0] + b"rest")[-1][3:6] == ("Trailing data", 0xC0, 0xC4)
    for n in [*range(0x140), 0x3000, len(data) - 1]:
        rows("NRO", data[:n])


FRAME = b"\xff\xfb\x90\x00"  # MPEG-1 layer III, 128 kbps, 44100 Hz: 417 bytes
LOAD = struct.pack(">IIIIII", 0x3F3, 0, 1, 0, 0, 1)
KNOWN = [
    ("Matroska", ebml()), ("Matroska", MKV), ("Matroska", ebml(b"matroska")), ("Data", ebml(b"mp4")), ("Data", ebml(b"webmx")), ("Data", b"\x1a\x45\xdf\xa3"),
    ("Data", el("1A45DFA3", el("4286", b"\1"))), ("Data", el("1A45DFA3", el("EC", b"", b"\xff") + el("4282", b"webm"))), ("Data", el("1A45DFA3", el("4282", b"webm"), b"\xff")),
    ("Matroska", el("1A45DFA3", el("4282", b"webm"), b"\x01" + bytes(6) + b"\x07")), ("Data", ebml()[:-1]), ("Data", b"\x1a\x45\xdf\xa3\xfe"),
    ("Amiga Hunk", LOAD), ("Amiga Hunk", LOAD + struct.pack(">I", 0x400003E9)), ("Data", LOAD + struct.pack(">I", 0x3F2)), ("Data", LOAD + b"\0"), ("Data", LOAD[:-1]),
    ("Amiga Hunk", struct.pack(">III", 0x3F3, 1, 0x61626364) + LOAD[4:]), ("Data", struct.pack(">II", 0x3F3, 65) + bytes(260) + LOAD[4:]), ("Data", struct.pack(">IIIIII", 0x3F3, 0, 1, 1, 0, 1)),
    ("Amiga Hunk", struct.pack(">IIIIIII", 0x3F3, 0, 1, 0, 0, 0xC0000001, 2)), ("Data", struct.pack(">IIIIII", 0x3F3, 0, 1, 0, 0, 0xC0000001)),
    ("Amiga Hunk", struct.pack(">I", 0x3F3) + b"\0\0\0\1abcd" * 16 + LOAD[4:]), ("Data", struct.pack(">I", 0x3F3) + b"\0\0\0\1abcd" * 17 + LOAD[4:]),
    ("Amiga Hunk", struct.pack(">II", 0x3E7, 1) + b"ab\0\0" + struct.pack(">I", 0x3E9)), ("Data", struct.pack(">II", 0x3E7, 1) + b"a\n\0\0" + struct.pack(">I", 0x3E9)),
    ("Amiga Hunk", struct.pack(">III", 0x3FA, 1, 0x3EB)), ("Data", struct.pack(">III", 0x3FA, 2, 0x3EB)), ("Data", struct.pack(">III", 0x3FA, 0, 0x3EB)),
    ("OS/360 Object Module", DECK), ("OS/360 Object Module", DECK[:83]), ("Data", DECK[:79]), ("Data", DECK[:80] + E("NAME")), ("Data", b"\2abc" + bytes(80)),
    ("MP3", b"ID3\4\0\0\0\0\0\0"), ("Data", b"ID3\5\0\0\0\0\0\0"), ("Data", b"ID3\4\0\0\0\0\0\x80"), ("Data", b"ID3\4\0\0\0\0\0"), ("MP3", FRAME), ("MP3", FRAME.ljust(417, b"\0") + FRAME),
    ("Data", FRAME.ljust(416, b"\0") + FRAME + b"\0"), ("MP3", FRAME.ljust(420, b"\0")), ("Data", FRAME.ljust(421, b"\0")), ("Data", b"\xff\xfb\xf0\x00"), ("Data", b"\xff\xfb\x00\x00"),
    ("MP3", b"\xff\xf3\x90\x02"[:3] + b"\0"), ("Data", b"\xff\xfb\x90\x02"), ("MP3", (b"\xff\xe3\x10\x00".ljust(52, b"\0")) * 2), ("MP3", (b"\xff\xff\x14\x00".ljust(32, b"\0")) * 2),
    ("MIDI", SMF), ("NRO", nro()),
]


def test_recognition(spark):
    df = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(KNOWN)], "i int, content binary")
    got = {r["i"]: r["t"] for r in df.select("i", identify(df["content"]).alias("t")).collect()}
    assert [(i, got[i]) for i in range(len(KNOWN))] == [(i, n) for i, (n, _) in enumerate(KNOWN)]


@pytest.mark.parametrize("kind", ["Matroska", "MIDI", "OS/360 Object Module", "NRO"])
def test_ranges_of_random_bytes_lie_in_the_content(kind):
    import random

    rng = random.Random(7)
    for n in range(300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert all(0 <= a <= b <= n for *_, a, b, _, _ in rows(kind, data))


def words(*numbers):
    return struct.pack(f">{len(numbers)}I", *numbers)


CODE = words(0x3E8, 1) + b"main" + words(0x3E9, 2) + b"NuNuNuNu" + words(0x3EC, 2, 1, 4, 8, 0) + words(0x3F0, 1) + b"go\0\0" + words(4, 0) + words(0x3F1, 4, 16) + b"LINE" + words(1) + b"a.c\0" + words(0x3F2)
PROGRAM = words(0x3F3, 1) + b"lib\0" + words(0, 2, 0, 1, 0x40000002, 3) + CODE + words(0x3F7) + struct.pack(">HHHH", 1, 0, 6, 0) + words(0x3EB, 3, 0x3F2)


def test_amiga_program():
    found = rows("Amiga Hunk", PROGRAM)
    got = {r[3] for r in found}
    top = [r[3] for r in found if r[2] == 0]
    assert top == ["HUNK_HEADER (2 hunks)", "Hunk 0: CODE (8 bytes, CHIP)", "HUNK_DREL32 (as RELOC32SHORT) (1 relocations)", "Hunk 1: BSS (12 bytes, ANY)"]
    assert {"Library: lib", "Hunk 0: 8 bytes (CHIP)", "HUNK_NAME: main", "Code", "To hunk 1: 2 offsets", "Offset: 0x000004", "go = 0x4", "HUNK_DEBUG (LINE, 16 bytes)", "Source file: a.c"} <= got
    assert all(0 <= r[4] <= r[5] <= len(PROGRAM) for r in found) and found[-1][5] == len(PROGRAM)
    for n in range(len(PROGRAM)):
        rows("Amiga Hunk", PROGRAM[:n])
    assert rows("Amiga Hunk", PROGRAM[:20])[0][3] == "Unparsed data (truncated HUNK_HEADER)"
    over = rows("Amiga Hunk", LOAD + words(0x3F5, 0, 7, 9))
    assert [r[3] for r in over if r[2] == 0][1:] == ["HUNK_OVERLAY (table 0 longwords)", "Unparsed data (overlays not parsed)"]
    assert rows("Amiga Hunk", LOAD + words(0x3E7, 0))[-1][3] == "Unparsed data (unknown hunk ID 0x000003E7)"
    assert rows("Amiga Hunk", LOAD + words(0x20000123, 1, 5))[-4][3] == "Advisory hunk (4 bytes)"


def test_amiga_units():
    ext = words(0x3EF, 0x01000001) + b"def\0" + words(8, 0x81000001) + b"ref\0" + words(2, 4, 8) + words(0x82000001) + b"com\0" + words(16, 1, 0) + words(0)
    unit = words(0x3E7, 1) + b"unit" + words(0x3EA, 1, 7) + ext + words(0x3F2)
    found = rows("Amiga Hunk", words(0x3FA, len(unit) // 4) + unit + words(0x3FB, 1, 0))
    got = {r[3] for r in found}
    assert {"HUNK_UNIT: unit", "Hunk 0: DATA (4 bytes, ANY)", "HUNK_EXT (3 entries)", "EXT_DEF def = 0x8", "EXT_REF32 ref (2 refs)", "EXT_COMMON com (size 16, 1 refs)", "HUNK_INDEX (4 bytes)"} <= got
    many = b"".join(words(1, 0x61626364, i) for i in range(70))
    tail = rows("Amiga Hunk", words(0x3F0) + many + words(0))
    assert tail[0][3] == "HUNK_SYMBOL (70 symbols)" and tail[-2][3:6] == ("… more symbols", 4 + 64 * 12, 4 + 70 * 12)
    assert rows("Amiga Hunk", words(0x3EF, 0x50000000, 0))[-1][3] == "Unparsed data (truncated or malformed HUNK_EXT)"
    assert rows("Amiga Hunk", words(0x3E8, 1, 0) + b"ab")[-1][3] == "Unparsed data (trailing bytes)"
