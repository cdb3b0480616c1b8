"""Walkers of ZIP, OGG, GIF and ICO."""

from __future__ import annotations

from bytestrata.formats.tree import OPAQUE, Field, Node, View, hexed, record

# Fixed values of the formats.
ZIP_METHOD = {0: "Stored", 8: "Deflated", None: "unknown ({})"}
OGG_FLAGS = {1: "continued packet", 2: "first page (bos)", 4: "last page (eos)"}
OGG_CODEC = {b"\x01vorbis": "Vorbis identification header", b"OpusHead": "Opus header"}
GIF_EXTENSION = {0xF9: "Graphic Control Extension", 0xFE: "Comment Extension", 0x01: "Plain Text Extension", 0xFF: "Application Extension", None: "Unknown Extension"}
ICO_TYPE = {1: "1 (ICO)", 2: "2 (CUR)", None: "{} (unknown)"}

_ZIP_ENTRY: list[Field] = [
    ("Version needed", 2, None), ("General purpose flags", 2, hexed(4)), ("Compression method", 2, ZIP_METHOD), ("Last mod time", 2, None), ("Last mod date", 2, None),
    ("CRC-32", 4, hexed(8)), ("Compressed size", 4, None), ("Uncompressed size", 4, None), ("File name length", 2, None), ("Extra field length", 2, None),
]
ZIP_LOCAL: list[Field] = [("Signature: PK\\x03\\x04", 4, OPAQUE), *_ZIP_ENTRY]
ZIP_CENTRAL: list[Field] = [
    ("Signature: PK\\x01\\x02", 4, OPAQUE), ("Version made by", 2, None), *_ZIP_ENTRY, ("File comment length", 2, None), ("Disk number start", 2, None),
    ("Internal attributes", 2, None), ("External attributes", 4, None), ("Local header offset", 4, None),
]
ZIP_END: list[Field] = [
    ("Signature: PK\\x05\\x06", 4, OPAQUE), ("Disk number", 2, None), ("Disk with central directory start", 2, None), ("Central directory records on this disk", 2, None),
    ("Total central directory records", 2, None), ("Central directory size", 4, None), ("Central directory offset", 4, None), ("Comment length", 2, None),
]


def zip_archive(v: View) -> list[Node]:
    """Local entries, then the central directory, then its end record, each run where the one before it stops."""
    out, at = [], 0
    for signature, one in ((b"PK\3\4", _zip_local), (b"PK\1\2", _zip_central)):
        while v.data[at : at + 4] == signature:
            node = one(v, at)
            if node is None:
                break
            out.append(node)
            at = node.end
    end = record(v, at, ZIP_END, "little") if v.data[at : at + 4] == b"PK\5\6" else None
    if end:
        kids, stop = end[0], min(at + 22 + end[1][-1], v.size)
        kids += [Node("Comment", at + 22, stop)] * (stop > at + 22)
        out.append(Node("End of central directory", at, stop, kids, True))
    return out


def _zip_names(v: View, at: int, kids: list[Node], sizes: list[tuple[str, int]]) -> tuple[str, int] | None:
    """Adds the variable parts that follow a header to kids; the file's name and where they end."""
    if at + sum(n for _, n in sizes) > v.size:
        return None
    name = v.text(at, at + sizes[0][1])
    for what, n in sizes:
        if n or what == "File name":
            kids.append(Node(f"File name: {name}" if what == "File name" else what, at, at + n))
        at += n
    return name, at


def _zip_local(v: View, at: int) -> Node | None:
    head = record(v, at, ZIP_LOCAL, "little")
    if head is None:
        return None
    kids, values = head
    found = _zip_names(v, at + 30, kids, [("File name", values[9]), ("Extra field", values[10])])
    if found is None:
        return None
    name, body = found
    end = min(body + values[7], v.size)
    kids += [Node("File data", body, end)] * (end > body)
    return Node(f"Local file header: {name}", at, end, kids)


def _zip_central(v: View, at: int) -> Node | None:
    head = record(v, at, ZIP_CENTRAL, "little")
    if head is None:
        return None
    kids, values = head
    found = _zip_names(v, at + 46, kids, [("File name", values[10]), ("Extra field", values[11]), ("File comment", values[12])])
    return found and Node(f"Central directory entry: {found[0]}", at, found[1], kids)


OGG_PAGE: list[Field] = [
    ("Capture pattern: OggS", 4, OPAQUE), ("Stream structure version", 1, None),
    ("Header type flag", 1, lambda n: f"0x{n:02x} ({', '.join(name for bit, name in OGG_FLAGS.items() if n & bit) or 'none'})"),
    ("Granule position", -8, None), ("Bitstream serial number", 4, None), ("Page sequence number", 4, None), ("CRC checksum", 4, OPAQUE), ("Page segments", 1, None),
]


def ogg(v: View) -> list[Node]:
    out, at = [], 0
    while v.data[at : at + 4] == b"OggS":
        head = record(v, at, OGG_PAGE, "little")
        body = at + 27 + (head[1][-1] if head else 0)
        if head is None or body > v.size:
            break
        kids = [*head[0], Node("Segment table", at + 27, body)]
        end = min(body + sum(v.data[at + 27 : body]), v.size)
        if end > body:
            codec = next((name for magic, name in OGG_CODEC.items() if v.data[body:end].startswith(magic)), None)
            kids.append(Node(f"Payload data ({codec})" if codec else "Payload data", body, end))
        out.append(Node(f"Page {len(out)}", at, end, kids, not out))
        at = end
    return out


GIF_SCREEN: list[Field] = [("Canvas width", 2, None), ("Canvas height", 2, None), ("Packed", 1, None), ("Background color index", 1, None), ("Pixel aspect ratio", 1, None)]
GIF_IMAGE: list[Field] = [("Introducer", 1, OPAQUE), ("Image left", 2, None), ("Image top", 2, None), ("Image width", 2, None), ("Image height", 2, None), ("Packed", 1, None)]


def _yes(n: int) -> str:
    return "true" if n else "false"


def _packed(kids: list[Node], labels: list[str]) -> None:
    """Puts leaves for the parts of a byte in the place of its leaf."""
    i = next(i for i, k in enumerate(kids) if k.label.startswith("Packed"))
    kids[i : i + 1] = [Node(label, kids[i].start, kids[i].end) for label in labels]


def gif(v: View) -> list[Node]:
    if v.size < 6:
        return []
    out = [Node("Header", 0, 6)]
    screen = record(v, 6, GIF_SCREEN, "little")
    if screen is None:
        return out
    kids, values = screen
    bits = values[2]
    colors = 2 << (bits & 7)
    _packed(kids, [f"Global color table flag: {_yes(bits & 128)}", f"Color resolution: {bits >> 4 & 7}", f"Sort flag: {_yes(bits & 8)}", f"Size of global color table: {colors}"])
    out.append(Node("Logical screen descriptor", 6, 13, kids, True))
    at = 13
    if bits & 128:
        if at + 3 * colors > v.size:
            return out
        out.append(Node(f"Global color table ({colors} entries)", at, at + 3 * colors))
        at = out[-1].end
    while at < v.size and v.data[at] in (0x21, 0x2C):
        one = (_gif_extension if v.data[at] == 0x21 else _gif_image)(v, at)
        if one is None:
            return out
        out.append(one)
        at = one.end
    return out + [Node("Trailer", at, at + 1)] * (at < v.size and v.data[at] == 0x3B)


def _gif_runs(v: View, at: int) -> tuple[list[Node], int] | None:
    """Length-prefixed runs up to the empty one, which ends them; None if it is missing."""
    out = []
    while at < v.size:
        n = v.data[at]
        if n == 0:
            return out, at + 1
        if at + 1 + n > v.size:
            break
        out.append(Node(f"Sub-block ({n} bytes)", at, at + 1 + n))
        at += 1 + n
    return None


def _gif_extension(v: View, at: int) -> Node | None:
    kind = v.number(at + 1, 1, "little")
    runs = _gif_runs(v, at + 2)
    if kind is None or runs is None:
        return None
    kids = [Node("Introducer", at, at + 1), Node(f"Label: 0x{kind:02x}", at + 1, at + 2), *runs[0]]
    return Node(f"Extension: {GIF_EXTENSION.get(kind, GIF_EXTENSION[None])}", at, runs[1], kids)


def _gif_image(v: View, at: int) -> Node | None:
    head = record(v, at, GIF_IMAGE, "little")
    if head is None:
        return None
    kids, values = head
    bits, pos = values[5], at + 10
    _packed(kids, [f"Local color table flag: {_yes(bits & 128)}", f"Interlace flag: {_yes(bits & 64)}"])
    if bits & 128:
        # Five bits, not the format's three, count here.
        colors = 2 << (bits & 31)
        if pos + 3 * colors > v.size:
            return None
        kids.append(Node(f"Local color table ({colors} entries)", pos, pos + 3 * colors))
        pos = kids[-1].end
    runs = _gif_runs(v, pos + 1)
    if runs is None:
        return None
    kids += [Node(f"LZW minimum code size: {v.data[pos]}", pos, pos + 1), Node("Image data", pos + 1, runs[1], runs[0])]
    return Node("Image descriptor", at, runs[1], kids)


ICO_HEAD: list[Field] = [("Reserved", 2, OPAQUE), ("Type", 2, ICO_TYPE), ("Image count", 2, None)]
ICO_DIB: list[Field] = [
    ("Header size", 4, None), ("Width", -4, None), ("Height (combined XOR+AND masks)", -4, None), ("Planes", 2, None), ("Bits per pixel", 2, None), ("Compression", 4, None),
    ("Image size", 4, None),
]


def ico(v: View) -> list[Node]:
    """An image is a child of its directory entry although it lies elsewhere."""
    head = record(v, 0, ICO_HEAD, "little")
    if head is None:
        return []
    side = {0: "256", None: "{}"}
    pair = ("Hotspot X", "Hotspot Y") if head[1][1] == 2 else ("Planes", "Bit count")
    layout: list[Field] = [
        ("Width", 1, side), ("Height", 1, side), ("Color count", 1, None), ("Reserved", 1, OPAQUE), (pair[0], 2, None), (pair[1], 2, None), ("Bytes in resource", 4, None),
        ("Image offset", 4, None),
    ]
    out = [Node("ICONDIR header", 0, 6, head[0], True)]
    for i in range(head[1][2]):
        one = record(v, 6 + 16 * i, layout, "little")
        if one is None:
            break
        kids, values = one
        kids += _ico_image(v, values[7], values[6])
        out.append(Node(f"ICONDIRENTRY[{i}]", 6 + 16 * i, 22 + 16 * i, kids, i == 0))
    return out


def _ico_image(v: View, at: int, size: int) -> list[Node]:
    if not size or at >= v.size:
        return []
    end = min(at + size, v.size)
    if v.data.startswith(b"\x89PNG\r\n\x1a\n", at):
        return [Node(f"Image data: PNG image ({size} bytes)", at, end)]
    if v.number(at, 4, "little") == 40 and at + 40 <= v.size:
        dib = Node("DIB header", at, min(at + 40, end), record(v, at, ICO_DIB, "little")[0])
        return [Node(f"Image data: DIB image ({size} bytes)", at, end, [dib])]
    return [Node(f"Image data ({size} bytes)", at, end)]


WALKERS = {"ZIP": zip_archive, "OGG": ogg, "GIF": gif, "ICO": ico}
