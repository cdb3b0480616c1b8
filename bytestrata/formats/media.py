"""Walkers of MP4, SWF and DOL."""

from __future__ import annotations

from datetime import datetime, timedelta

from bytestrata.formats.tree import OPAQUE, Field, Node, View, fields, record

# Fixed values of the formats.
MP4_CONTAINERS = {
    "moov", "trak", "mdia", "minf", "stbl", "udta", "edts", "dinf", "mvex", "moof", "traf", "mfra", "meco", "sinf", "schi", "ipro", "strk", "strd",
}
MP4_NAMES = {
    "ftyp": "File Type", "moov": "Movie", "mdat": "Media Data", "free": "Free Space", "skip": "Free Space", "wide": "Reserved Space", "trak": "Track", "mdia": "Media",
    "minf": "Media Information", "stbl": "Sample Table", "udta": "User Data", "edts": "Edit", "elst": "Edit List", "dinf": "Data Information", "dref": "Data Reference",
    "mvex": "Movie Extends", "moof": "Movie Fragment", "traf": "Track Fragment", "mfra": "Movie Fragment Random Access", "meta": "Metadata", "hdlr": "Handler Reference",
    "mvhd": "Movie Header", "tkhd": "Track Header", "mdhd": "Media Header", "stsd": "Sample Description", "stts": "Decoding Time to Sample",
    "ctts": "Composition Time to Sample", "stsc": "Sample to Chunk", "stsz": "Sample Sizes", "stz2": "Compact Sample Sizes", "stco": "Chunk Offset (32-bit)",
    "co64": "Chunk Offset (64-bit)", "stss": "Sync Sample", "smhd": "Sound Media Header", "vmhd": "Video Media Header", "nmhd": "Null Media Header",
    "gmhd": "Generic Media Header", "pnot": "Preview",
}
SWF_TAGS = {
    0: "End", 1: "ShowFrame", 2: "DefineShape", 4: "PlaceObject", 5: "RemoveObject", 6: "DefineBits", 7: "DefineButton", 8: "JPEGTables", 9: "SetBackgroundColor",
    10: "DefineFont", 11: "DefineText", 12: "DoAction", 13: "DefineFontInfo", 14: "DefineSound", 15: "StartSound", 17: "DefineButtonSound", 18: "SoundStreamHead",
    19: "SoundStreamBlock", 20: "DefineBitsLossless", 21: "DefineBitsJPEG2", 22: "DefineShape2", 23: "DefineButtonCxform", 24: "Protect", 26: "PlaceObject2",
    28: "RemoveObject2", 32: "DefineShape3", 33: "DefineText2", 34: "DefineButton2", 35: "DefineBitsJPEG3", 36: "DefineBitsLossless2", 37: "DefineEditText",
    39: "DefineSprite", 41: "ProductInfo", 43: "FrameLabel", 45: "SoundStreamHead2", 46: "DefineMorphShape", 48: "DefineFont2", 56: "ExportAssets", 57: "ImportAssets",
    58: "EnableDebugger", 59: "DoInitAction", 60: "DefineVideoStream", 61: "VideoFrame", 62: "DefineFontInfo2", 63: "DebugID", 64: "EnableDebugger2", 65: "ScriptLimits",
    66: "SetTabIndex", 69: "FileAttributes", 70: "PlaceObject3", 71: "ImportAssets2", 72: "DoABCDefine", 73: "DefineFontAlignZones", 74: "CSMTextSettings",
    75: "DefineFont3", 76: "SymbolClass", 77: "Metadata", 78: "DefineScalingGrid", 82: "DoABC", 83: "DefineShape4", 84: "DefineMorphShape2",
    86: "DefineSceneAndFrameLabelData", 87: "DefineBinaryData", 88: "DefineFontName", 89: "StartSound2", 90: "DefineBitsJPEG4", 91: "DefineFont4", 93: "EnableTelemetry",
    94: "PlaceObject4", None: "Unknown tag ({})",
}
SWF_PACKED = {b"FWS": "none", b"CWS": "zlib", b"ZWS": "LZMA"}


def plain(x: float) -> str:
    """The shortest decimal that reads back as x, without exponent or a trailing .0."""
    s = f"{x:.17f}".rstrip("0").rstrip(".") if "e" in repr(x) else repr(x)
    return s.removesuffix(".0")


def _fixed(scale: int):
    return lambda n: plain(n / scale)


def _four(v: View, at: int) -> str:
    return "".join(chr(b) if 32 <= b < 127 else "." for b in v.data[at : at + 4])


def _mp4_time(n: int) -> str:
    """Seconds since 1904. Years beyond 9999, which the calendar repeats every 400 years, are counted on."""
    days, rest = divmod(n - 2**64 if n >= 2**63 else n, 86400)
    cycles, days = divmod(days, 146097)
    t = datetime(1904, 1, 1) + timedelta(days=days, seconds=rest)
    return f"{n} ({t.year + 400 * cycles:04d}-{t:%m-%d %H:%M:%S} UTC)"


def _span(n: int, scale: int) -> str:
    total = n / scale
    hours, minutes, seconds = int(total // 3600), int(total % 3600 // 60), total % 60
    if hours:
        return f"{hours}:{minutes:02d}:{seconds:06.3f}"
    return f"{minutes}:{seconds:06.3f}" if minutes else f"{seconds:.3f}s"


def _language(n: int) -> str:
    return bytes((n >> s & 31) + 0x60 for s in (10, 5, 0)).decode("utf-8", "replace")


MATRIX: Field = ("Transformation matrix", 36, OPAQUE)
VOLUME: Field = ("Volume", 2, _fixed(256))
MP4_MOVIE: list[Field] = [("Rate", 4, _fixed(65536)), VOLUME, ("Reserved", 10, OPAQUE), MATRIX, ("Pre-defined", 24, OPAQUE), ("Next track ID", 4, None)]
MP4_TRACK: list[Field] = [
    ("Reserved", 8, OPAQUE), ("Layer", -2, None), ("Alternate group", -2, None), VOLUME, ("Reserved", 2, OPAQUE), MATRIX, ("Width", 4, _fixed(65536)), ("Height", 4, _fixed(65536)),
]
MP4_MEDIA: list[Field] = [("Language", 2, _language), ("Pre-defined", 2, OPAQUE)]


def _while_fits(v: View, at: int, end: int, layout: list[Field]) -> list[Node]:
    """Each field that fits before end; one that doesn't takes no room."""
    out = []
    for field in layout:
        one = record(v, at, [field], "big") if at + abs(field[1]) <= end else None
        if one:
            out += one[0]
            at += abs(field[1])
    return out


def _versioned(v: View, at: int) -> list[Node]:
    return [Node(f"Version: {v.data[at]}", at, at + 1), Node("Flags", at + 1, at + 4)]


def _mp4_header(v: View, kind: str, at: int, end: int) -> list[Node] | None:
    """mvhd, tkhd and mdhd: times in 4 or 8 bytes, then what fits."""
    if end < at + 4:
        return None
    out = _versioned(v, at)
    w = 8 if v.data[at] == 1 else 4
    middle: list[Field] = [("Track ID", 4, None), ("Reserved", 4, OPAQUE)] if kind == "tkhd" else [("Timescale", 4, None)]
    least = {"mvhd": 3 * w + 4, "tkhd": 3 * w + 8, "mdhd": 4 * w}[kind]
    at += 4
    if end < at + least:
        return out
    head = record(v, at, [("Creation time", w, _mp4_time), ("Modification time", w, _mp4_time), *middle, ("Duration", w, None)], "big")
    if head is None:
        return None
    kids, values = head
    if kind != "tkhd" and values[2]:
        kids[-1].label += f" ({_span(values[3], values[2])})"
    return out + kids + _while_fits(v, kids[-1].end, end, {"mvhd": MP4_MOVIE, "tkhd": MP4_TRACK, "mdhd": MP4_MEDIA}[kind])


def _mp4_brands(v: View, kind: str, at: int, end: int) -> list[Node] | None:
    if end < at + 8:
        return None
    out = [Node(f"Major brand: {_four(v, at)}", at, at + 4), *fields(v, at + 4, [("Minor version", 4, None)], "big")]
    return out + [Node(f"Compatible brand: {_four(v, p)}", p, p + 4) for p in range(at + 8, end - 3, 4)]


def _mp4_handler(v: View, kind: str, at: int, end: int) -> list[Node] | None:
    if end < at + 4:
        return None
    out = _versioned(v, at)
    if end < at + 24:
        return out
    out += [Node("Pre-defined", at + 4, at + 8), Node(f"Handler type: {_four(v, at + 8)}", at + 8, at + 12), Node("Reserved", at + 12, at + 24)]
    name = v.data[at + 24 : end].split(b"\0", 1)[0].decode("utf-8", "replace")
    return out + [Node(f"Name: {name}", at + 24, end)] * (end > at + 24)


def _mp4_samples(v: View, kind: str, at: int, end: int) -> list[Node] | None:
    if end < at + 4:
        return None
    out = _versioned(v, at)
    if end < at + 8:
        return out
    out += fields(v, at + 4, [("Entry count", 4, None)], "big")
    return out + [Node(f"Sample entries ({end - at - 8} bytes)", at + 8, end)] * (end > at + 8)


MP4_INSIDE = {"ftyp": _mp4_brands, "mvhd": _mp4_header, "tkhd": _mp4_header, "mdhd": _mp4_header, "hdlr": _mp4_handler, "stsd": _mp4_samples}


def _mp4_box(v: View, at: int, limit: int) -> tuple[Node, str, int] | None:
    """A box with its header's fields, its type and where its content starts."""
    short = v.number(at, 4, "big") if at + 8 <= v.size else None
    if short is None:
        return None
    kind, body = _four(v, at + 4), at + 8
    said = {0: "0 (extends to end of file)", 1: "1 (extended size follows)"}.get(short, short)
    kids = [Node(f"Size: {said}", at, at + 4), Node(f"Type: {kind}", at + 4, body)]
    size = short or v.size - at
    if short == 1:
        size = v.number(body, 8, "big")
        if size is None:
            return None
        kids.append(Node(f"Extended size: {size}", body, body + 8))
        body += 8
    if kind == "uuid":
        if body + 16 > v.size:
            return None
        kids.append(Node("Extended type (UUID)", body, body + 16))
        body += 16
    end = min(at + size, v.size, limit)
    if size < body - at or end <= at:
        return None
    return Node(f"{kind} ({MP4_NAMES[kind]})" if kind in MP4_NAMES else kind, at, end, kids, kind == "ftyp"), kind, body


def mp4(v: View) -> list[Node]:
    """Boxes within boxes; the open ones wait on a stack, so that depth costs no recursion."""
    out: list[Node] = []
    todo = [(out, 0, v.size)]
    while todo:
        into, at, limit = todo.pop()
        box = _mp4_box(v, at, limit) if at + 8 <= limit else None
        if box is None:
            continue
        node, kind, body = box
        into.append(node)
        todo.append((into, node.end, limit))
        if body >= node.end:
            continue
        if kind in MP4_CONTAINERS:
            todo.append((node.kids, body, node.end))
        elif kind == "meta":
            if body + 4 <= node.end:
                node.kids += _versioned(v, body)
                todo.append((node.kids, body + 4, node.end))
        else:
            inside = MP4_INSIDE[kind](v, kind, body, node.end) if kind in MP4_INSIDE else None
            what = "Media data" if kind == "mdat" else "Data"
            node.kids += [Node(f"{what} ({node.end - body} bytes)", body, node.end)] if inside is None else inside
    return out


def swf(v: View) -> list[Node]:
    if v.size < 8 or v.data[:3] not in SWF_PACKED:
        return []
    packed = SWF_PACKED[v.data[:3]]
    length = "File length" if packed == "none" else "File length (uncompressed)"
    kids = [Node(f"Signature: {v.text(0, 3)} (compression: {packed})", 0, 3), *fields(v, 3, [("Version", 1, None), (length, 4, None)], "little")]
    if packed == "LZMA":
        kids += fields(v, 8, [("Compressed length", 4, None)], "little")
        if v.size >= 17:
            kids.append(Node(f"LZMA properties: 0x{v.data[12]:02X}, dictionary size {v.number(13, 4, 'little')}", 12, 17))
    elif packed == "none":
        rect = _swf_rect(v, 8)
        kids += [rect, *fields(v, rect.end, [("Frame rate", 2, lambda n: f"{plain(n / 256)} fps"), ("Frame count", 2, None)], "little")] if rect else []
    end = kids[-1].end
    out = [Node("SWF header", 0, end, kids, True)]
    if packed == "none":
        return out + (_swf_tags(v, end) if kids[-1].label.startswith("Frame count") else [])
    whole = packed == "zlib" or end == 17
    return out + [Node(f"Compressed body ({packed})", end, v.size)] * (whole and end < v.size)


def _swf_rect(v: View, at: int) -> Node | None:
    """Four signed numbers of as many bits as the first five bits say."""
    if at >= v.size:
        return None
    n = v.data[at] >> 3
    end = at + -(-(5 + 4 * n) // 8)
    bits = v.number(at, end - at, "big")
    if bits is None:
        return None
    kids, values = [Node(f"Nbits: {n}", at, at + 1)], []
    for i, name in enumerate(("Xmin", "Xmax", "Ymin", "Ymax")):
        first = 5 + i * n
        x = bits >> ((end - at) * 8 - first - n) & (1 << n) - 1
        values.append(x - (1 << n) if n and x >> (n - 1) else x)
        kids.append(Node(f"{name}: {values[-1]} twips", at + first // 8, at + (first + max(n, 1) - 1) // 8 + 1))
    return Node(f"Frame size: {plain((values[1] - values[0]) / 20)} x {plain((values[3] - values[2]) / 20)} px", at, end, kids)


def _swf_tags(v: View, start: int) -> list[Node]:
    tags, at, code = [], start, None
    while code != 0 and (word := v.number(at, 2, "little")) is not None:
        code, length, body = word >> 6, word & 63, at + 2
        name = SWF_TAGS.get(code, SWF_TAGS[None].format(code))
        kids = [Node(f"Record header (short): code {code}, length {length}", at, body)]
        if length == 63:
            kids[0].label = f"Record header (long): code {code}, length in next field"
            length = v.number(body, 4, "little")
            if length is None:
                tags.append(Node(f"{name} (truncated)", at, v.size, kids))
                at = v.size
                break
            kids.append(Node(f"Length: {length}", body, body + 4))
            body += 4
        end = min(body + length, v.size)
        kids += [Node(f"Data ({end - body} bytes)", body, end)] * (end > body)
        tags.append(Node(f"{name} (truncated)" if body + length > v.size else name, at, end, kids))
        at = end
    out = [Node(f"Tags ({len(tags)})", start, at, tags, True)] if tags else []
    return out + [Node("Trailing data", at, v.size)] * (at < v.size)


def dol(v: View) -> list[Node]:
    """A slot's three fields lie in three tables, so that its node spans from the first to the last and overlaps others."""
    if v.size < 256:
        return []
    table = lambda at, n: [v.number(at + 4 * i, 4, "big") for i in range(n)]
    names = [f"Text {i}" for i in range(7)] + [f"Data {i}" for i in range(11)]
    slots = list(zip(names, table(0, 18), table(72, 18), table(144, 18), strict=True))
    (bss, bss_size, entry), kids = table(216, 3), []
    for i, (name, offset, address, size) in enumerate(slots):
        a, b, c = 4 * i, 72 + 4 * i, 144 + 4 * i
        parts = [Node(f"File offset: 0x{offset:X}", a, a + 4), Node(f"Load address: 0x{address:08X}", b, b + 4), Node(f"Size: 0x{size:X} bytes", c, c + 4)]
        kids.append(Node(f"{name}: offset 0x{offset:X}, load 0x{address:08X}, 0x{size:X} bytes" if size else f"{name}: unused", a, c + 4, parts))
    holder = next((f"in {name}" for name, _, address, size in slots[:7] if address <= entry < address + size), "not in any text section")
    kids += [Node(f"BSS address: 0x{bss:08X}", 216, 220), Node(f"BSS size: 0x{bss_size:X} bytes", 220, 224), Node(f"Entry point: 0x{entry:08X} ({holder})", 224, 228), Node("Padding (28 bytes)", 228, 256)]
    out, at = [Node("DOL header", 0, 256, kids, True)], 256
    for name, offset, address, size in sorted((s for s in slots if s[3]), key=lambda s: s[1]):
        start, end = min(offset, v.size), min(offset + size, v.size)
        out += [Node(f"Gap ({start - at} bytes)", at, start)] * (start > at)
        out.append(Node(f"{name} (load 0x{address:08X}, 0x{size:X} bytes{', truncated' if end - start < size else ''})", start, end))
        at = max(at, end)
    return out + [Node(f"Trailing data ({v.size - at} bytes)", at, v.size)] * (at < v.size)


WALKERS = {"MP4": mp4, "SWF": swf, "DOL": dol}
