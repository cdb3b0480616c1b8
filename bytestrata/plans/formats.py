"""Driver queries that compare whole block tables: a small content of a format for each row of part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.operators import blocks as B

COLUMNS = ("path", "file_type", "idx", "parent", "depth", "label", "start", "end", "expandable", "default_expanded")
OPEN, SHUT, LEAF = (True, True), (True, False), (False, False)
KEY, SIZE = "p_partkey", "p_size"


def little(c: str, width: int) -> Column:
    return _bytes(c, width, True)


def big(c: str, width: int) -> Column:
    return _bytes(c, width, False)


def _bytes(c: str, width: int, lowest_first: bool) -> Column:
    h = F.lpad(F.hex(F.col(c).cast("long")), F.lit(16), F.lit("0"))
    order = range(width) if lowest_first else reversed(range(width))
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in order)))


#: Query: (format, parts of the content, rows as (parent, depth, label in SQL, start, end, flags)).
FORMATS: dict[str, tuple[str, Callable[[], list], list[tuple]]] = {
    "midi_blocks": (
        "MIDI",
        lambda: [b"MThd\0\0\0\6\0\0\0\1", big(SIZE, 2), b"MTrk\0\0\0\x08\0\x90\x3c", big(SIZE, 1), b"\0\xff\x2f\0"],
        [
            (-1, 0, "'Header chunk (MThd)'", 0, 14, OPEN), (0, 1, "'Chunk ID: MThd'", 0, 4, LEAF), (0, 1, "'Length: 6'", 4, 8, LEAF), (0, 1, "'Format: 0 (single track)'", 8, 10, LEAF),
            (0, 1, "'Track count: 1'", 10, 12, LEAF), (0, 1, "'Division: ' || p_size || ' ticks per quarter note'", 12, 14, LEAF), (-1, 0, "'Track 1 (MTrk) — 2 events'", 14, 30, SHUT),
            (6, 1, "'Chunk ID: MTrk'", 14, 18, LEAF), (6, 1, "'Length: 8'", 18, 22, LEAF), (6, 1, "'Δ0: Note On ch 1 C4 vel ' || p_size", 22, 26, SHUT), (9, 2, "'Delta time: 0'", 22, 23, LEAF),
            (9, 2, "'Status: 0x90 (Note On, channel 1)'", 23, 24, LEAF), (9, 2, "'Note: C4 (60)'", 24, 25, LEAF), (9, 2, "'Velocity: ' || p_size", 25, 26, LEAF),
            (6, 1, "'Δ0: End of Track'", 26, 30, SHUT), (14, 2, "'Delta time: 0'", 26, 27, LEAF), (14, 2, "'Status: 0xFF (Meta event)'", 27, 28, LEAF),
            (14, 2, "'Type: 0x2F (End of Track)'", 28, 29, LEAF), (14, 2, "'Length: 0'", 29, 30, LEAF),
        ],
    ),
    "wasm_blocks": (
        "WebAssembly",
        lambda: [b"\0asm\1\0\0\0\x08\1", big(SIZE, 1), b"\0\5\4name"],
        [
            (-1, 0, "'Header'", 0, 8, OPEN), (0, 1, "'Magic: \\0asm'", 0, 4, LEAF), (0, 1, "'Version: 1 (module)'", 4, 8, LEAF), (-1, 0, "'Start section'", 8, 11, SHUT),
            (3, 1, "'ID: 8 (start)'", 8, 9, LEAF), (3, 1, "'Size: 1'", 9, 10, LEAF), (3, 1, "'Start function: ' || p_size", 10, 11, LEAF),
            (-1, 0, "'Custom section: \"name\"'", 11, 18, SHUT), (7, 1, "'ID: 0 (custom)'", 11, 12, LEAF), (7, 1, "'Size: 5'", 12, 13, LEAF), (7, 1, "'Name: \"name\"'", 13, 18, LEAF),
        ],
    ),
    "os360_blocks": (
        "OS/360 Object Module",
        lambda: [b"\2\xe3\xe7\xe3\x40", big(KEY, 3), b"\x40\x40\0\2\x40\x40\x40\x40ab", b"\x40" * 62],
        [
            (-1, 0, "'Card 1: TXT addr 0x' || printf('%06X', p_partkey) || ', 2 bytes'", 0, 80, SHUT), (0, 1, "'Flag: 0x02 (12-2-9 punch)'", 0, 1, LEAF), (0, 1, "'Record type: TXT'", 1, 4, LEAF),
            (0, 1, "'Address: 0x' || printf('%06X', p_partkey)", 5, 8, LEAF), (0, 1, "'Byte count: 2'", 10, 12, LEAF), (0, 1, "'ESDID: (blank)'", 14, 16, LEAF),
            (0, 1, "'Text (2 bytes)'", 16, 18, LEAF), (0, 1, "'Deck ID / sequence: \"        \"'", 72, 80, LEAF),
        ],
    ),
    "amiga_blocks": (
        "Amiga Hunk",
        lambda: [b"\0\0\x03\xe7\0\0\0\1unit\0\0\x03\xeb", big(SIZE, 4), b"\0\0\x03\xf2"],
        [
            (-1, 0, "'HUNK_UNIT: unit'", 0, 12, OPEN), (0, 1, "'ID: HUNK_UNIT (0x000003E7)'", 0, 4, LEAF), (0, 1, "'Name length: 1 longwords'", 4, 8, LEAF), (0, 1, "'Name: unit'", 8, 12, LEAF),
            (-1, 0, "'Hunk 0: BSS (' || 4 * p_size || ' bytes, ANY)'", 12, 24, SHUT), (4, 1, "'HUNK_BSS (' || 4 * p_size || ' bytes)'", 12, 20, SHUT),
            (5, 2, "'ID: HUNK_BSS (0x000003EB)'", 12, 16, LEAF), (5, 2, "'Size: ' || p_size || ' longwords (' || 4 * p_size || ' bytes)'", 16, 20, LEAF), (4, 1, "'HUNK_END'", 20, 24, LEAF),
        ],
    ),
    "matroska_blocks": (
        "Matroska",
        lambda: [b"\x1a\x45\xdf\xa3\x87\x42\x82\x84webm\x18\x53\x80\x67\x83\xe7\x81", big(SIZE, 1)],
        [
            (-1, 0, "'EBML header (DocType: webm)'", 0, 12, OPEN), (0, 1, "'ID: 0x1A45DFA3 (EBML)'", 0, 4, LEAF), (0, 1, "'Size: 7'", 4, 5, LEAF), (0, 1, "'DocType: webm'", 5, 12, SHUT),
            (3, 2, "'ID: 0x4282 (DocType)'", 5, 7, LEAF), (3, 2, "'Size: 4'", 7, 8, LEAF), (3, 2, "'Value: webm'", 8, 12, LEAF), (-1, 0, "'Segment'", 12, 20, OPEN),
            (7, 1, "'ID: 0x18538067 (Segment)'", 12, 16, LEAF), (7, 1, "'Size: 3'", 16, 17, LEAF), (7, 1, "'Timestamp: ' || p_size", 17, 20, SHUT),
            (10, 2, "'ID: 0xE7 (Timestamp)'", 17, 18, LEAF), (10, 2, "'Size: 1'", 18, 19, LEAF), (10, 2, "'Value: ' || p_size", 19, 20, LEAF),
        ],
    ),
    "pdf_blocks": (
        "PDF",
        lambda: [b"%PDF-1.4\n1 0 obj\n<< /N ", F.col(SIZE).cast("string").cast("binary"), b" >>\nendobj\n"],
        [
            (-1, 0, "'Header (PDF 1.4)'", 0, 9, OPEN), (0, 1, "'Magic: %PDF-'", 0, 5, LEAF), (0, 1, "'Version: 1.4'", 5, 8, LEAF), (-1, 0, "'Body (1 object)'", 9, "33 + length('' || p_size)", SHUT),
            (3, 1, "'Object 1 0'", 9, "33 + length('' || p_size)", SHUT), (4, 2, "'Object header: 1 0 obj'", 9, 16, LEAF), (4, 2, "'Dictionary (1 entry)'", 17, "26 + length('' || p_size)", SHUT),
            (6, 3, "'/N ' || p_size", 20, "23 + length('' || p_size)", LEAF), (4, 2, "'endobj'", "27 + length('' || p_size)", "33 + length('' || p_size)", LEAF),
        ],
    ),
    "java_blocks": (
        "Java class",
        lambda: [b"\xca\xfe\xba\xbe\0\0\0\x3d\0\2\3", big(KEY, 4)],
        [
            (-1, 0, "'Header'", 0, 8, OPEN), (0, 1, "'Magic: 0xCAFEBABE'", 0, 4, LEAF), (0, 1, "'Minor version: 0'", 4, 6, LEAF), (0, 1, "'Major version: 61 (Java SE 17)'", 6, 8, LEAF),
            (-1, 0, "'Constant pool (1 entries)'", 8, 15, SHUT), (4, 1, "'Constant pool count: 2'", 8, 10, LEAF), (4, 1, "'#1 Integer: ' || p_partkey", 10, 15, LEAF),
        ],
    ),
    "bpg_blocks": (
        "BPG",
        lambda: [b"BPG\xfb\0\0", big(SIZE, 1), b"\1\0"],
        [
            (-1, 0, "'BPG header'", 0, 9, OPEN), (0, 1, "'Magic: BPG\\xFB'", 0, 4, LEAF), (0, 1, "'Pixel format: Grayscale (0)'", 4, 5, LEAF), (0, 1, "'Alpha1 flag: 0'", 4, 5, LEAF),
            (0, 1, "'Bit depth: 8'", 4, 5, LEAF), (0, 1, "'Color space: YCbCr (BT 601) (0)'", 5, 6, LEAF), (0, 1, "'Extension present: no'", 5, 6, LEAF), (0, 1, "'Alpha2 flag: 0'", 5, 6, LEAF),
            (0, 1, "'Limited range: no'", 5, 6, LEAF), (0, 1, "'Animation: no'", 5, 6, LEAF), (0, 1, "'Alpha: none'", 4, 6, LEAF), (0, 1, "'Width: ' || p_size", 6, 7, LEAF),
            (0, 1, "'Height: 1'", 7, 8, LEAF), (0, 1, "'Picture data length: 0 (until end of file)'", 8, 9, LEAF),
        ],
    ),
    "pyc_blocks": (
        "Python bytecode",
        lambda: [b"\x03\xf3\r\n", little(KEY, 4), b"c", little(SIZE, 4)],
        [
            (-1, 0, "'Header'", 0, 8, OPEN), (0, 1, "'Magic: 62211 (Python 2.7)'", 0, 4, LEAF),
            (0, 1, "'Source mtime: ' || p_partkey || ' (' || strftime(make_timestamp(CAST(p_partkey AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC)'", 4, 8, LEAF),
            (-1, 0, "'Marshalled Code object'", 8, 13, OPEN), (3, 1, "'Type: 0x63 (''c'' code object)'", 8, 9, LEAF), (3, 1, "'co_argcount: ' || p_size", 9, 13, LEAF),
            (3, 1, "'co_nlocals: truncated'", 13, 13, LEAF),
        ],
    ),
    "rpm_blocks": (
        "RPM",
        lambda: [b"\xed\xab\xee\xdb\3\0\0\0", big(SIZE, 2), b"pkg".ljust(66, b"\0"), b"\0\1\0\5", bytes(16)],
        [
            (-1, 0, "'Lead'", 0, 96, OPEN), (0, 1, "'Magic: ED AB EE DB'", 0, 4, LEAF), (0, 1, "'Version: 3.0'", 4, 6, LEAF), (0, 1, "'Type: binary (0)'", 6, 8, LEAF),
            (0, 1, "'Arch number: ' || p_size", 8, 10, LEAF), (0, 1, "'Name: pkg'", 10, 76, LEAF), (0, 1, "'OS number: Linux (1)'", 76, 78, LEAF),
            (0, 1, "'Signature type: header-style (5)'", 78, 80, LEAF), (0, 1, "'Reserved'", 80, 96, LEAF),
        ],
    ),
    "psd_blocks": (
        "PSD",
        lambda: [b"8BPS\0\1", bytes(6), b"\0\3", big(KEY, 4), big(SIZE, 4), b"\0\x08\0\3", big(SIZE, 4)],
        [
            (-1, 0, "'File header'", 0, 26, OPEN), (0, 1, "'Signature: 8BPS'", 0, 4, LEAF), (0, 1, "'Version: 1 (PSD)'", 4, 6, LEAF), (0, 1, "'Reserved'", 6, 12, LEAF),
            (0, 1, "'Channels: 3'", 12, 14, LEAF), (0, 1, "'Height: ' || p_partkey", 14, 18, LEAF), (0, 1, "'Width: ' || p_size", 18, 22, LEAF), (0, 1, "'Depth: 8'", 22, 24, LEAF),
            (0, 1, "'Color mode: RGB'", 24, 26, LEAF), (-1, 0, "'Color mode data'", 26, 30, SHUT), (9, 1, "'Length: ' || p_size", 26, 30, LEAF),
        ],
    ),
    "xz_blocks": (
        "XZ",
        lambda: [b"\xfd7zXZ\0\0\1", little(KEY, 4)],
        [
            (-1, 0, "'Stream header'", 0, 12, OPEN), (0, 1, "'Magic: FD 37 7A 58 5A 00'", 0, 6, LEAF), (0, 1, "'Stream flags: check type CRC32'", 6, 8, LEAF),
            (0, 1, "'CRC32: 0x' || printf('%08x', p_partkey)", 8, 12, LEAF),
        ],
    ),
    "dex_blocks": (
        "DEX",
        lambda: [b"dex\n035\0", little(KEY, 4)],
        [(-1, 0, "'DEX header'", 0, 12, OPEN), (0, 1, "'Magic: dex\\n035\\0 (version 035)'", 0, 8, LEAF), (0, 1, "'Checksum (Adler-32): 0x' || printf('%08X', p_partkey)", 8, 12, LEAF)],
    ),
    "rar_blocks": (
        "RAR",
        lambda: [b"Rar!\x1a\x07\0", little(SIZE, 2), b"\x7b\0\0\x64\0"],
        [
            (-1, 0, "'Signature: RAR 4.x'", 0, 7, OPEN), (0, 1, "'Header CRC: 0x6152 (fixed)'", 0, 2, LEAF), (0, 1, "'Header type: 0x72 (MARK)'", 2, 3, LEAF),
            (0, 1, "'Header flags: 0x1A21 (fixed)'", 3, 5, LEAF), (0, 1, "'Header size: 7'", 5, 7, LEAF), (-1, 0, "'End of archive'", 7, 14, SHUT), (5, 1, "'Header'", 7, 14, OPEN),
            (6, 2, "'Header CRC: 0x' || printf('%04X', p_size) || ' (header truncated)'", 7, 9, LEAF), (6, 2, "'Header type: 0x7B (ENDARC)'", 9, 10, LEAF),
            (6, 2, "'Header flags: 0x0000'", 10, 12, LEAF), (6, 2, "'Header size: 100'", 12, 14, LEAF),
        ],
    ),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        content = F.concat(*(F.lit(x) if isinstance(x, bytes) else x for x in FORMATS[name][1]()))
        return B.blocks(spark.read.parquet(f"{d}/part.parquet").select(F.col(KEY).alias("path"), content.alias("content"))).select(*COLUMNS)

    run.__name__ = name
    return run


def whole_tables(kind: str, rows: list[tuple]) -> str:
    """SQL of the block tables of every row of part."""
    one = "SELECT p_partkey AS path, '{}' AS file_type, CAST({} AS INTEGER) AS idx, CAST({} AS INTEGER) AS parent, CAST({} AS INTEGER) AS depth, {} AS label, CAST({} AS BIGINT) AS start, CAST({} AS BIGINT) AS \"end\", {} AS expandable, {} AS default_expanded FROM part"
    return " UNION ALL ".join(one.format(kind, i, parent, depth, label, a, b, *(str(f).lower() for f in flags)) for i, (parent, depth, label, a, b, flags) in enumerate(rows))


QUERIES = {name: _query(name) for name in FORMATS}
ORACLES = {name: whole_tables(kind, rows) for name, (kind, _, rows) in FORMATS.items()}
