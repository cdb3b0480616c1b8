"""XZ files as the standard library writes them, RAR archives, TE images."""

import lzma
import struct
import zlib

import pytest
from bytestrata.formats import xz
from bytestrata.formats.tree import flat
from bytestrata.formats.walkers import dissect


def rows(data):
    return flat(dissect("XZ", data))


@pytest.mark.parametrize(("check", "name", "n"), [(lzma.CHECK_CRC32, "CRC32", 4), (lzma.CHECK_CRC64, "CRC64", 8), (lzma.CHECK_SHA256, "SHA-256", 32), (lzma.CHECK_NONE, "None", 0)])
def test_one_stream(check, name, n):
    data = lzma.compress(b"hello world" * 9, check=check, preset=6)
    found = rows(data)
    got = [r[3] for r in found]
    assert [r[3] for r in found if r[2] == 0] == ["Stream header", "Block 0", "Index", "Stream footer"] and got.count(f"Stream flags: check type {name}") == 2
    assert {"Dictionary size: 8 MiB", "Uncompressed size: 99", "Number of records: 1", "Filter 0: LZMA2", "Magic: YZ"} <= set(got)
    assert any(r[5] - r[4] == n and r[3].startswith(f"{name}: 0x" if n < 32 else f"{name}: ") for r in found) == (n > 0)
    for i in range(len(data)):
        assert rows(data[:i]) == [] if i < 12 else all(0 <= r[4] <= r[5] <= i for r in rows(data[:i]))


def test_streams_padding_and_filters():
    one = lzma.compress(b"a", filters=[{"id": lzma.FILTER_DELTA, "dist": 3}, {"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "dict_size": 3 << 20}])
    empty = lzma.compress(b"")
    data = one + bytes(8) + empty + bytes(4)
    found = rows(data)
    assert [(r[3], r[4], r[5]) for r in found if r[2] == 0] == [
        ("Stream 0", 0, len(one)), ("Stream padding (8 bytes)", len(one), len(one) + 8), ("Stream 1", len(one) + 8, len(data) - 4), ("Stream padding (4 bytes)", len(data) - 4, len(data)),
    ]
    got = {r[3] for r in found}
    assert {"Delta distance: 3", "Filter 1: x86 BCJ", "Dictionary size: 3 MiB", "Block flags: 0x02 (3 filters)", "Number of records: 0"} <= got
    assert [r[3] for r in rows(one + b"?") if r[2] == 0] == ["Stream header", "Block 0"]
    assert [r[3] for r in rows(empty[:12] + b"\0abc") if r[2] == 0] == ["Stream header", "Unparsed data"]
    assert [xz.dictionary(x) for x in (0, 1, 39, 40, 41)] == ["4 KiB", "6 KiB", "3072 MiB", "4 GiB - 1", "invalid (0x29)"]


def crc16(body):
    return zlib.crc32(body) & 0xFFFF


def old(kind, flags, body, data=b"", stored=None):
    rest = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
    return struct.pack("<H", crc16(rest) if stored is None else stored) + rest + data


def kids(kind, data):
    found = flat(dissect(kind, data))
    assert all(0 <= r[4] <= r[5] <= len(data) for r in found)
    return found


def entry(name, packed, method=0x33):
    return struct.pack("<IIBIIBBHI", packed, 9, 3, 0xABCD, (44 << 25 | 2 << 21 | 3 << 16) | (4 << 11 | 5 << 5 | 6), 29, method, len(name), 0o644)


OLD = (
    b"Rar!\x1a\x07\x00" + old(0x73, 0x0008, bytes(6)) + old(0x74, 0x9600, entry(b"a.txt\0x", 4) + b"a.txt\0x" + b"saltsalt" + b"tt", b"data") + old(0x74, 0x80E0, entry(b"dir", 0, 0x30) + b"dir")
    + old(0x7A, 0x8000, entry(b"CMT", 2) + b"CMT", b"cc", 1) + old(0x79, 0x8000, struct.pack("<I", 3), b"sig") + old(0x7B, 0x000A, struct.pack("<IH", 7, 2)) + b"more"
)


def test_old_rar():
    found = kids("RAR", OLD)
    got, top = {r[3] for r in found}, [r[3] for r in found if r[2] == 0]
    assert top == ["Signature: RAR 4.x", "Main archive header", "File: a.txt", "Directory: dir", "Service: CMT", "Signature block", "End of archive", "Data after end of archive"]
    assert {"Modified time: 2024-02-03 04:05:12", "Unpack version: 29 (2.9)", "Method: 0x33 (normal)", "Host OS: 3 (Unix)", "File name: a.txt (plus Unicode encoding)", "Salt: 73616c7473616c74"} <= got
    assert {"Extended time", "Packed data", "Dictionary: 64 KiB", "Dictionary: directory", "ADD_SIZE: 3", "Archive data CRC32: 0x00000007", "Volume number: 2", "Service data"} <= got
    assert any(x.startswith("Header CRC: 0x0001 (mismatch, computed 0x") for x in got) and "Header flags: 0x0008 (SOLID)" in got
    for n in range(len(OLD)):
        kids("RAR", OLD[:n])
    locked = kids("RAR", b"Rar!\x1a\x07\x00" + old(0x73, 0x80, bytes(6)) + b"????")
    assert locked[-1][3] == "Encrypted headers" and kids("RAR", b"Rar!\x1a\x07\x00abcdefgh\0\0")[-1][3] != ""


def vint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def new(kind, body, extra=b"", data=b"", good=True):
    flags = bool(extra) | 2 * bool(data)
    head = vint(kind) + vint(flags) + (vint(len(extra)) if extra else b"") + (vint(len(data)) if data else b"") + body + extra
    rest = vint(len(head)) + head
    return struct.pack("<I", zlib.crc32(rest) ^ (not good)) + rest + data


def record(kind, body):
    return vint(len(vint(kind) + body)) + vint(kind) + body


INFO = 1 | 64 | 3 << 7 | 3 << 10 | 1 << 15
EXTRA = (
    record(1, vint(0) + vint(1) + b"\x0f" + bytes(32) + b"c" * 12) + record(2, vint(0) + b"h" * 32) + record(3, vint(0x13) + struct.pack("<II", 86400, 5)) + record(3, vint(4) + struct.pack("<Q", 1 << 63))
    + record(4, b"\0\7") + record(5, b"\1\0\3abc") + record(6, vint(15) + b"\1u\1g\5\6") + record(99, b"zz")
)
NEW = (
    b"Rar!\x1a\x07\x01\x00" + new(1, vint(2) + vint(3), record(1, b"\3\5\6")) + new(2, vint(6) + vint(10) + vint(0x20) + struct.pack("<II", 0, 0xAB) + vint(INFO) + vint(1) + vint(2) + b"ab", EXTRA, b"data")
    + new(3, vint(1) + vint(0) + vint(0) + vint(0) + vint(0) + vint(2) + b"QO", b"", b"q", good=False) + new(9, b"zz") + new(5, b"\1") + b"x"
)


def test_new_rar():
    found = kids("RAR", NEW)
    got, top = {r[3] for r in found}, [r[3] for r in found if r[2] == 0]
    assert top == ["Signature: RAR 5.0", "Main archive header", "File: ab", "Service: Directory: QO", "Unknown header (type 9)", "End of archive header", "Data after end of archive"]
    assert {"Archive flags: 0x02 (volume number)", "Quick open offset: 5", "Modified time: 1970-01-01 00:00:00 UTC", "Dictionary size: 1056 KiB", "Algorithm version: 1 (RAR 7.0)", "Solid: yes"} <= got
    assert {"Hash: " + "68" * 32, "Modified time: 1970-01-02 00:00:00 UTC", "Modified time nanoseconds: 5", "Created time: 30828-09-14 02:48:05 UTC", "Version number: 7", "Target name: abc"} <= got
    assert {"User name: u", "Group ID: 6", "Extra record: Unknown", "Record data", "Dictionary size: 128 KiB (unused for directories)", "End of archive flags: 0x01 (not last volume)"} <= got
    assert any("mismatch, computed" in x for x in got) and "KDF count: 15 (2^15 iterations)" in got
    for n in range(len(NEW)):
        kids("RAR", NEW[:n])
    locked = kids("RAR", NEW[:8] + new(4, vint(0) + vint(0) + b"\x0f" + bytes(16)) + b"secret")
    assert locked[-1][3] == "Encrypted headers and data" and locked[1][7]
    assert kids("RAR", NEW[:8] + b"\0\0\0\0\0")[-1][3] == "Unparsed data"


def terse():
    section = lambda name, address, raw, place: name.ljust(8, b"\0") + struct.pack("<6IHHI", raw, address, raw, place, 0, 0, 0, 0, 0x60500020)
    stripped, first = 0x100, 0x178
    body = bytearray(0x100)
    reloc = struct.pack("<IIHH", 0x1000, 12, 0xA004, 0x5008)
    debug = struct.pack("<IIHHIIII", 0, 1, 2, 3, 2, 32, 0, first + 0x80)
    record = b"RSDS" + bytes(range(16)) + struct.pack("<I", 9) + b"a.pdb\0??"
    body[0x20 : 0x20 + len(reloc)], body[0x40 : 0x40 + len(debug)], body[0x80 : 0x80 + len(record)] = reloc, debug, record
    head = b"VZ" + struct.pack("<HBBHIIQ4I", 0x5064, 2, 11, stripped, first + 4, first, 1 << 33, first + 0x20, 12, first + 0x40, 28)
    return head + section(b".text", first, 0x60, first) + section(b".data", first + 0x60, 0xA0, first + 0x60) + bytes(first - stripped + 40 - 120) + bytes(body)


def test_terse():
    data = terse()
    found = kids("TE", data)
    got, top = {r[3] for r in found}, [r[3] for r in found if r[2] == 0]
    assert top == ["TE header", "Section headers (2)", "Section data: .text", "Section data: .data"]
    assert {"Machine: RISCV64", "Subsystem: EFI boot service driver", "Entry point: 0x17c in .text", "DIR64 at 0x1004", "RISCV_HIGH20 at 0x1008", "Debug entry: CODEVIEW (a.pdb)"} <= got
    assert {"GUID: 03020100-0504-0706-0809-0A0B0C0D0E0F", "Age: 9", "PDB path: a.pdb", "Characteristics: 0x60500020 (CNT_CODE | MEM_EXECUTE | MEM_READ | ALIGN_16BYTES)"} <= got
    parents = {r[3]: found[r[1]][3] for r in found if r[1] >= 0}
    assert parents["Base relocations (1 blocks)"] == parents["Debug directory"] == "Section data: .text" and parents["CodeView record (RSDS)"] == "Section data: .data"
    for n in range(len(data)):
        kids("TE", data[:n])
