"""Walkers: bytes to labelled ranges, a function per format. They never raise on bad bytes; they return less."""

from __future__ import annotations

from bytestrata.formats import amiga, bpg, console, containers, dex, executables, images, java, mainframe, matroska, media, midi, packed, pdf, pif, programs, psd, pyc, rar, rpm, terse, wasm, xz
from bytestrata.formats.tree import WHITE, Field, Node, View, fields

# Fixed values of the formats.
BMP_COMPRESSION = {0: "BI_RGB", 1: "BI_RLE8", 2: "BI_RLE4", 3: "BI_BITFIELDS", None: "unknown ({})"}
PNG_COLOR = {0: "grayscale", 2: "truecolor", 3: "indexed", 4: "grayscale + alpha", 6: "truecolor + alpha", None: "unknown"}
WAV_FORMAT = {1: "PCM", 2: "ADPCM", 3: "IEEE float", 6: "A-law", 7: "mu-law", 17: "IMA ADPCM", 0xFFFE: "extensible", None: "unknown"}
WEBP_FLAGS = {0x20: "ICC profile", 0x10: "alpha", 0x08: "EXIF", 0x04: "XMP", 0x02: "animation"}
WEBP_DATA = {"VP8 ": "VP8 bitstream data", "VP8L": "VP8L bitstream data", "ICCP": "ICC profile data", "EXIF": "EXIF data", "XMP ": "XMP data"}
GZIP_METHOD = {8: "Deflate", None: "unknown ({})"}
GZIP_OS = {
    0: "FAT", 1: "Amiga", 2: "VMS", 3: "Unix", 4: "VM/CMS", 5: "Atari TOS", 6: "HPFS", 7: "Macintosh", 8: "Z-System", 9: "CP/M", 10: "TOPS-20",
    11: "NTFS", 12: "QDOS", 13: "Acorn RISCOS", 255: "unknown", None: "unknown ({})",
}
TAR_TYPE = {
    0: "Regular file", 48: "Regular file", 49: "Hard link", 50: "Symbolic link", 51: "Character device", 52: "Block device", 53: "Directory",
    54: "FIFO", 103: "PAX global extended header", 120: "PAX extended header",
}
TAR_ENTRIES = 100_000
SQLITE_ENCODING = {1: "UTF-8 (1)", 2: "UTF-16le (2)", 3: "UTF-16be (3)", None: "unknown ({})"}
FLAC_BLOCK = {0: "STREAMINFO", 1: "PADDING", 2: "APPLICATION", 3: "SEEKTABLE", 4: "VORBIS_COMMENT", 5: "CUESHEET", 6: "PICTURE", 127: "INVALID", None: "RESERVED"}

BMP_DIB: list[Field] = [
    ("Header size", 4, None), ("Width", -4, None), ("Height", -4, None), ("Planes", 2, None), ("Bits per pixel", 2, None), ("Compression", 4, BMP_COMPRESSION),
    ("Image size", 4, None), ("Horizontal resolution", -4, None), ("Vertical resolution", -4, None), ("Colors used", 4, None), ("Important colors", 4, None),
]
PNG_IHDR: list[Field] = [("Width", 4, None), ("Height", 4, None), ("Bit depth", 1, None), ("Color type", 1, PNG_COLOR), ("Compression method", 1, None), ("Filter method", 1, None), ("Interlace method", 1, None)]
WAV_FMT: list[Field] = [("Audio format", 2, WAV_FORMAT), ("Channels", 2, None), ("Sample rate", 4, None), ("Byte rate", 4, None), ("Block align", 2, None), ("Bits per sample", 2, None)]
SQLITE_HEADER: list[Field] = [
    ("page_size", 2, {1: "65536", None: "{}"}), ("file_format_write_version", 1, None), ("file_format_read_version", 1, None), ("reserved_space", 1, None),
    ("max_embedded_payload_fraction", 1, None), ("min_embedded_payload_fraction", 1, None), ("leaf_payload_fraction", 1, None), ("file_change_counter", 4, None),
    ("database_size_pages", 4, None), ("first_freelist_trunk_page", 4, None), ("total_freelist_pages", 4, None), ("schema_cookie", 4, None), ("schema_format_number", 4, None),
    ("default_page_cache_size", 4, None), ("largest_root_btree_page", 4, None), ("text_encoding", 4, SQLITE_ENCODING), ("user_version", 4, None),
    ("incremental_vacuum_mode", 4, None), ("application_id", 4, None),
]
SQLITE_TAIL: list[Field] = [("version_valid_for", 4, None), ("sqlite_version_number", 4, None)]
FLAC_INFO: list[Field] = [("Minimum block size", 2, None), ("Maximum block size", 2, None), ("Minimum frame size", 3, None), ("Maximum frame size", 3, None)]


def fallback(v: View) -> list[Node]:
    return [Node("Data", 0, v.size)]


def bmp(v: View) -> list[Node]:
    if v.size < 14:
        return []
    declared, offset, dib = (v.number(at, 4, "little") for at in (2, 10, 14))
    out = [Node("BMP file header", 0, 14, [Node("Signature: BM", 0, 2), Node(f"File size: {declared}", 2, 6), Node("Reserved", 6, 10), Node(f"Pixel data offset: {offset}", 10, 14)], True)]
    if dib:
        whole = dib == 40 and v.size >= 54
        out.append(Node("DIB header", 14, 54, fields(v, 14, BMP_DIB, "little"), True) if whole else Node(f"DIB header ({dib} bytes)", 14, min(14 + dib, v.size)))
    end = min(declared, v.size)
    end = end if end > offset else v.size
    return out + [Node("Pixel data", offset, end)] * (offset < v.size and end > offset)


def png(v: View) -> list[Node]:
    if v.size < 8:
        return []
    out, at = [Node("Signature", 0, 8)], 8
    while at + 8 <= v.size:
        length, kind, body = v.number(at, 4, "big"), v.text(at + 4, at + 8), at + 8
        end = min(body + length, v.size)
        stop = min(end + 4, v.size)
        kids = [Node(f"Length: {length}", at, at + 4), Node(f"Type: {kind}", at + 4, body)]
        if kind == "IHDR":
            kids += fields(v, body, PNG_IHDR, "big")
        elif end > body:
            kids.append(Node("Data", body, end))
        if stop > end:
            kids.append(Node("CRC", end, stop))
        out.append(Node(f"Chunk: {kind}", at, stop, kids, kind in ("IHDR", "IEND")))
        at = stop
    return out


def _riff(v: View, form: str, special: str, inside, data_label) -> list[Node]:
    """RIFF files: word-aligned chunks after a 12-byte header."""
    if v.size < 12:
        return []
    size = v.number(4, 4, "little")
    out = [Node("RIFF header", 0, 12, [Node("Chunk ID: RIFF", 0, 4), Node(f"Chunk size: {size}", 4, 8), Node(f"Format: {form}", 8, 12)], True)]
    at = 12
    while at + 8 <= v.size:
        kind, size, body = v.text(at, at + 4), v.number(at + 4, 4, "little"), at + 8
        end = min(body + size, v.size)
        stop = min(end + size % 2, v.size)
        kids = [Node(f"Chunk ID: {kind}", at, at + 4), Node(f"Chunk size: {size}", at + 4, body)]
        if kind == special:
            out.append(Node(f"Chunk: {kind}", at, stop, kids + inside(v, body), True))
        else:
            kids += [Node(data_label(kind), body, end)] * (end > body)
            out.append(Node(f"Chunk: {kind.rstrip(WHITE)}", at, stop, kids))
        at = stop
    return out


def wav(v: View) -> list[Node]:
    return _riff(v, "WAVE", "fmt ", lambda v, at: fields(v, at, WAV_FMT, "little"), lambda kind: "Data" if kind == "data" else f"Data ({kind})")


def webp(v: View) -> list[Node]:
    def canvas(v: View, at: int) -> list[Node]:
        named = lambda n: ", ".join(name for bit, name in WEBP_FLAGS.items() if n & bit) or "none"
        plus = lambda n: str(n + 1)
        return fields(v, at, [("Feature flags", 1, named)], "little") + fields(v, at + 4, [("Canvas width", 3, plus), ("Canvas height", 3, plus)], "little")

    return _riff(v, "WEBP", "VP8X", canvas, lambda kind: WEBP_DATA.get(kind, f"Data ({kind})"))


def gzip(v: View) -> list[Node]:
    head = _gzip_header(v)
    if head is None:
        return []
    at = head.end
    tail = v.size - 8 if v.size >= at + 8 else v.size
    out = [head] + [Node("Compressed data", at, tail)] * (tail > at)
    if tail + 8 <= v.size:
        crc, n = v.number(tail, 4, "little"), v.number(tail + 4, 4, "little")
        out.append(Node("Trailer", tail, tail + 8, [Node(f"CRC-32: 0x{crc:08x}", tail, tail + 4), Node(f"Input size (mod 2^32): {n}", tail + 4, tail + 8)]))
    return out


def _gzip_header(v: View) -> Node | None:
    """None where the fixed part or a terminator is missing; closed where a later optional field is cut off."""
    if v.size < 10:
        return None
    hexed = lambda n: f"0x{n:02x}"
    kids = fields(v, 0, [("ID1", 1, hexed), ("ID2", 1, hexed), ("Compression method", 1, GZIP_METHOD), ("Flags", 1, hexed), ("Modification time", 4, None), ("Extra flags", 1, hexed), ("OS", 1, GZIP_OS)], "little")
    kids[0].label, kids[1].label = "ID1: 0x1f", "ID2: 0x8b"
    flags, at = v.data[3], 10
    if flags & 4:
        n = v.number(at, 2, "little")
        if n is None:
            return None
        kids.append(Node(f"Extra field length: {n}", at, at + 2))
        end = min(at + 2 + n, v.size)
        kids += [Node("Extra field", at + 2, end)] * (end > at + 2)
        if end < at + 2 + n:
            return Node("Gzip header", 0, end, kids)
        at = end
    for bit, name in ((8, "Original file name"), (16, "Comment")):
        if flags & bit:
            end = v.data.find(b"\0", at)
            if end < 0:
                return None
            kids.append(Node(f"{name}: {v.text(at, end)}", at, end + 1))
            at = end + 1
    if flags & 2:
        n = v.number(at, 2, "little")
        if n is None:
            return Node("Gzip header", 0, at, kids)
        kids.append(Node(f"Header CRC16: 0x{n:04x}", at, at + 2))
        at += 2
    return Node("Gzip header", 0, at, kids, True)


def tar(v: View) -> list[Node]:
    out, at = [], 0
    for _ in range(TAR_ENTRIES):
        head = v.data[at : at + 512]
        if len(head) < 512:
            break
        if not any(head):
            out.append(Node("End of archive", at, at + 512))
            break
        out.append(_tar_entry(v, at))
        at = out[-1].end
    return out


def _tar_entry(v: View, at: int) -> Node:
    raw = lambda o, n: v.data[at + o : at + o + n].split(b"\0", 1)[0]
    text = lambda o, n: raw(o, n).decode("utf-8", "replace").strip(WHITE)

    def octal(o: int, n: int) -> int:
        s = raw(o, n).decode("utf-8", "replace").strip(WHITE)
        digits = s.removeprefix("+")
        return int(digits, 8) if digits.isascii() and digits.isdigit() and max(digits) < "8" and int(digits, 8) < 2**64 else 0

    size, prefix, name, kind = octal(124, 12), text(345, 155), text(0, 100), v.data[at + 156]
    body = at + 512
    parts = [
        ("Name", name, 0, 100), ("Mode", text(100, 8), 100, 108), ("UID", octal(108, 8), 108, 116), ("GID", octal(116, 8), 116, 124), ("Size", size, 124, 136),
        ("Mtime", octal(136, 12), 136, 148), ("Type", TAR_TYPE.get(kind, f"unknown ('{chr(kind)}')"), 156, 157), ("Link name", text(157, 100), 157, 257),
        ("Owner user name", text(265, 32), 265, 297), ("Owner group name", text(297, 32), 297, 329), *([("Prefix", prefix, 345, 500)] if prefix else []),
    ]
    kids = [Node(f"{n}: {x}", at + a, at + b) for n, x, a, b in parts]
    end = min(body + size, v.size)
    kids += [Node("File data", body, end)] * (end > body)
    return Node(f"File: {prefix}/{name}" if prefix else f"File: {name}", at, max(body, min(body + -(-size // 512) * 512, v.size)), kids)


def sqlite(v: View) -> list[Node]:
    if not v.size:
        return []
    kids = [Node("magic: SQLite format 3", 0, min(v.size, 16)), *fields(v, 16, SQLITE_HEADER, "big")]
    kids += [Node("reserved_for_expansion", 72, 92)] * (v.size >= 92) + fields(v, 92, SQLITE_TAIL, "big")
    return [Node("Database header", 0, min(v.size, 100), kids, True)] + [Node("Database pages", 100, v.size)] * (v.size > 100)


def flac(v: View) -> list[Node]:
    if v.size < 4:
        return []
    out, at, last = [Node("Marker: fLaC", 0, 4)], 4, False
    while not last:
        if at + 4 > v.size:
            return out
        last, kind, length, body = bool(v.data[at] & 128), v.data[at] & 127, v.number(at + 1, 3, "big"), at + 4
        end = min(body + length, v.size)
        name = FLAC_BLOCK.get(kind, FLAC_BLOCK[None])
        kids = [Node(f"Last-metadata-block flag: {str(last).lower()}", at, at + 1), Node(f"Block type: {name} ({kind})", at, at + 1), Node(f"Length: {length}", at + 1, body)]
        if kind == 0 and end >= body + 34:
            bits = v.number(body + 10, 8, "big")
            label = f"Sample rate: {bits >> 44} Hz, Channels: {(bits >> 41 & 7) + 1}, Bits per sample: {(bits >> 36 & 31) + 1}, Total samples: {bits & (1 << 36) - 1}"
            kids += [*fields(v, body, FLAC_INFO, "big"), Node(label, body + 10, body + 18), Node("MD5 signature", body + 18, body + 34)]
        elif end > body:
            kids.append(Node(f"{name} data", body, end))
        out.append(Node(f"Metadata block: {name}", at, end, kids, kind == 0))
        at = end
    return out + [Node("Audio frames", at, v.size)] * (at < v.size)


WALKERS = {"WAV": wav, "FLAC": flac, "WebP": webp, "PNG": png, "BMP": bmp, "SQLite": sqlite, "TAR": tar, "Gzip": gzip, "Data": fallback}
for more in (amiga, bpg, console, containers, dex, executables, images, java, mainframe, matroska, media, midi, packed, pdf, pif, programs, psd, pyc, rar, rpm, terse, wasm, xz):
    WALKERS |= more.WALKERS


def dissect(file_type: str, data: bytes, more: dict | None = None) -> list[Node]:
    """Ranges of content recognised as file_type. Types without a walker yet: the whole content as one range. more: walkers
    of registered types."""
    return ((more or {}).get(file_type) or WALKERS.get(file_type, fallback))(View(data))
