"""Walker of PSD and PSB: five sections, resources, layers with their channels, and tagged blocks."""

from __future__ import annotations

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
HEADER, CHARS = 26, 80
SIGNS = {b"8BIM", b"MeSa", b"AgHg", b"PHUT", b"DCSR"}
TAG_SIGNS = {b"8BIM", b"8B64"}
#: Tagged blocks whose length has eight bytes in PSB.
LONG_KEYS = {b"LMsk", b"Lr16", b"Lr32", b"Layr", b"Mt16", b"Mt32", b"Mtrn", b"Alph", b"FMsk", b"lnk2", b"FEid", b"FXid", b"PxSD"}
MODES = {0: "Bitmap", 1: "Grayscale", 2: "Indexed", 3: "RGB", 4: "CMYK", 7: "Multichannel", 8: "Duotone", 9: "Lab"}
COMPRESSIONS = {0: "Raw", 1: "RLE", 2: "ZIP", 3: "ZIP with prediction"}
CHANNELS = {-1: " (transparency mask)", -2: " (user layer mask)", -3: " (real user layer mask)"}
RESOURCES = {
    1000: "Channels/rows/columns/depth/mode", 1001: "Macintosh print manager info", 1002: "Macintosh page format info", 1003: "Indexed color table", 1005: "ResolutionInfo",
    1006: "Alpha channel names", 1007: "DisplayInfo (obsolete)", 1008: "Caption", 1009: "Border information", 1010: "Background color", 1011: "Print flags",
    1012: "Grayscale/multichannel halftoning", 1013: "Color halftoning", 1014: "Duotone halftoning", 1015: "Grayscale/multichannel transfer", 1016: "Color transfer",
    1017: "Duotone transfer", 1018: "Duotone image information", 1019: "Effective black and white values", 1021: "EPS options", 1022: "Quick Mask information",
    1024: "Layer state", 1025: "Working path", 1026: "Layer groups", 1028: "IPTC-NAA record", 1029: "Raw image mode", 1030: "JPEG quality", 1032: "Grid and guides",
    1033: "Thumbnail (Photoshop 4.0)", 1034: "Copyright flag", 1035: "URL", 1036: "Thumbnail", 1037: "Global angle", 1038: "Color samplers (obsolete)",
    1039: "ICC profile", 1040: "Watermark", 1041: "ICC untagged profile", 1042: "Effects visible", 1043: "Spot halftone", 1044: "Document ID seed",
    1045: "Unicode alpha names", 1046: "Indexed color table count", 1047: "Transparency index", 1049: "Global altitude", 1050: "Slices", 1051: "Workflow URL",
    1052: "Jump to XPEP", 1053: "Alpha identifiers", 1054: "URL list", 1057: "Version info", 1058: "EXIF data 1", 1059: "EXIF data 3", 1060: "XMP metadata",
    1061: "Caption digest", 1062: "Print scale", 1064: "Pixel aspect ratio", 1065: "Layer comps", 1066: "Alternate duotone colors", 1067: "Alternate spot colors",
    1069: "Layer selection IDs", 1070: "HDR toning information", 1071: "Print info", 1072: "Layer group(s) enabled ID", 1073: "Color samplers",
    1074: "Measurement scale", 1075: "Timeline information", 1076: "Sheet disclosure", 1077: "DisplayInfo", 1078: "Onion skins", 1080: "Count information",
    1082: "Print information", 1083: "Print style", 1084: "Macintosh NSPrintInfo", 1085: "Windows DEVMODE", 1086: "Auto save file path", 1087: "Auto save format",
    1088: "Path selection state", 2999: "Clipping path name", 3000: "Origin path info", 7000: "Image Ready variables", 7001: "Image Ready data sets",
    7002: "Image Ready default selected state", 7003: "Image Ready 7 rollover expanded state", 7004: "Image Ready rollover expanded state",
    7005: "Image Ready save layer settings", 7006: "Image Ready version", 8000: "Lightroom workflow", 10000: "Print flags information",
}
RESOURCE_RANGES = [(2000, 2997, "Path information"), (4000, 4999, "Plug-in resource")]
BLENDING = {
    b"pass": "Pass through", b"norm": "Normal", b"diss": "Dissolve", b"dark": "Darken", b"mul ": "Multiply", b"idiv": "Color burn", b"lbrn": "Linear burn",
    b"dkCl": "Darker color", b"lite": "Lighten", b"scrn": "Screen", b"div ": "Color dodge", b"lddg": "Linear dodge", b"lgCl": "Lighter color", b"over": "Overlay",
    b"sLit": "Soft light", b"hLit": "Hard light", b"vLit": "Vivid light", b"lLit": "Linear light", b"pLit": "Pin light", b"hMix": "Hard mix", b"diff": "Difference",
    b"smud": "Exclusion", b"fsub": "Subtract", b"fdiv": "Divide", b"hue ": "Hue", b"sat ": "Saturation", b"colr": "Color", b"lum ": "Luminosity",
}
TAGS = {
    b"luni": "Unicode layer name", b"lyid": "Layer ID", b"lsct": "Section divider", b"lsdk": "Section divider", b"lnsr": "Layer name source",
    b"clbl": "Blend clipping elements", b"infx": "Blend interior elements", b"knko": "Knockout", b"lspf": "Protected setting", b"lclr": "Sheet color",
    b"fxrp": "Reference point", b"shmd": "Metadata setting", b"lfx2": "Object-based effects", b"lrFX": "Effects layer", b"iOpa": "Fill opacity",
    b"brst": "Channel blending restrictions", b"vmsk": "Vector mask", b"vsms": "Vector mask", b"vscg": "Vector stroke content", b"vstk": "Vector stroke",
    b"vogk": "Vector origination data", b"TySh": "Type tool object", b"tySh": "Type tool info", b"Txt2": "Text engine data", b"SoLd": "Placed layer data",
    b"SoLE": "Placed layer data", b"PlLd": "Placed layer", b"plLd": "Placed layer", b"lnk2": "Linked layer", b"lnkD": "Linked layer", b"lnk3": "Linked layer",
    b"Patt": "Patterns", b"Pat2": "Patterns", b"Pat3": "Patterns", b"Lr16": "16-bit layer data", b"Lr32": "32-bit layer data", b"Layr": "Layer data",
    b"Mt16": "Saved transparency", b"Mt32": "Saved transparency", b"Mtrn": "Saved transparency", b"Alph": "Alpha channel data", b"FMsk": "Filter mask",
    b"LMsk": "User mask", b"FXid": "Filter effects", b"FEid": "Filter effects", b"PxSD": "Pixel source data", b"Anno": "Annotations", b"cinf": "Compositor info",
    b"artb": "Artboard data", b"artd": "Artboard data", b"abdd": "Artboard data", b"lmgm": "Layer mask as global mask", b"sn2P": "Using aligned rendering",
    b"CgEd": "Content generator extra data", b"SoCo": "Solid color fill", b"GdFl": "Gradient fill", b"PtFl": "Pattern fill", b"brit": "Brightness/contrast",
    b"levl": "Levels", b"curv": "Curves", b"expA": "Exposure", b"vibA": "Vibrance", b"hue ": "Hue/saturation", b"hue2": "Hue/saturation", b"blnc": "Color balance",
    b"blwh": "Black and white", b"phfl": "Photo filter", b"mixr": "Channel mixer", b"clrL": "Color lookup", b"nvrt": "Invert", b"post": "Posterize",
    b"thrs": "Threshold", b"grdm": "Gradient map", b"selc": "Selective color",
}


class Cut(Exception):
    """The content ends before what is due."""


def _short(text: str) -> str:
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _even(n: int) -> int:
    return n + n % 2


def _named(label: str, name: str) -> str:
    return f'{label} "{_short(name)}"' if name else label


class _Image:
    def __init__(self, v: View):
        self.v, self.data, self.wide = v, v.data, v.number(4, 2, "big") == 2
        self.width = 8 if self.wide else 4

    def number(self, at: int, width: int = 4, signed: bool = False) -> int:
        n = self.v.number(at, width, "big", signed)
        if n is None:
            raise Cut
        return n

    def ascii(self, at: int) -> str:
        return self.v.text(at, at + 4)

    def pascal(self, at: int) -> str:
        n = self.number(at, 1)
        if at + 1 + n > self.v.size:
            raise Cut
        return self.data[at + 1 : at + 1 + n].decode("latin-1")

    def unicode(self, at: int, end: int) -> str | None:
        n = self.v.number(at, 4, "big")
        if n is None or at + 4 + 2 * n > end:
            return None
        return self.data[at + 4 : at + 4 + 2 * n].decode("utf-16-be", "replace").rstrip("\0")

    def header(self) -> Node:
        mode = self.number(24, 2)
        parts = [
            ("Signature: 8BPS", 0, 4), (f"Version: {self.number(4, 2)} ({'PSB' if self.wide else 'PSD'})", 4, 6), ("Reserved", 6, 12),
            (f"Channels: {self.number(12, 2)}", 12, 14), (f"Height: {self.number(14)}", 14, 18), (f"Width: {self.number(18)}", 18, 22),
            (f"Depth: {self.number(22, 2)}", 22, 24), (f"Color mode: {MODES.get(mode, f'unknown ({mode})')}", 24, 26),
        ]
        return Node("File header", 0, HEADER, [Node(*x) for x in parts], True)

    def resource(self, at: int, end: int) -> tuple[Node, int] | None:
        """(node, start of the next one); None where its size is beyond the end."""
        who, name = self.number(at + 4, 2), self.pascal(at + 6)
        middle = at + 6 + _even(1 + len(name))
        if middle + 4 > end:
            return None
        size, body = self.number(middle), middle + 4
        known = RESOURCES.get(who) or next((x for lo, hi, x in RESOURCE_RANGES if lo <= who <= hi), None)
        told = f"{who} ({known})" if known else str(who)
        kids = [Node(f"Signature: {self.ascii(at)}", at, at + 4), Node(f"ID: {told}", at + 4, at + 6), Node(f'Name: "{_short(name)}"', at + 6, middle)]
        kids += [Node(f"Size: {size}", middle, body)] + [Node("Data", body, min(body + size, end))] * (size > 0 and body < end)
        return Node(_named(f"Resource {told}", name), at, min(body + _even(size), end), kids), body + _even(size)

    def tag(self, at: int, end: int) -> tuple[Node, int] | None:
        key = self.data[at + 4 : at + 8]
        width = 8 if self.wide and key in LONG_KEYS else 4
        body = at + 8 + width
        if body > end:
            return None
        size, text = self.number(at + 8, width), self.ascii(at + 4)
        kids = [Node(f"Signature: {self.ascii(at)}", at, at + 4), Node(f"Key: {text}", at + 4, at + 8), Node(f"Length: {size}", at + 8, body)]
        if size and body < end:
            stop, label = min(body + size, end), "Data"
            name = self.unicode(body, stop) if key == b"luni" else None
            if name is not None:
                label = f'Name: "{_short(name)}"'
            elif key == b"lyid" and size >= 4:
                label = f"Layer ID: {self.v.number(body, 4, 'big') or 0}"
            kids.append(Node(label, body, stop))
        return Node(f"{text} ({TAGS[key]})" if key in TAGS else text, at, min(body + _even(size), end), kids), body + _even(size)

    def run(self, at: int, end: int, signs: set[bytes], one, cut: str) -> list[Node]:
        """Blocks of at least 12 bytes that each begin with a signature, then what is left."""
        out = []
        while at + 12 <= end:
            if self.data[at : at + 4] not in signs:
                return [*out, Node("Unknown data", at, end)]
            try:
                found = one(at, end)
            except Cut:
                break
            if found is None:
                return [*out, Node(cut, at, end)]
            out.append(found[0])
            at = found[1]
        return out + [Node("Padding", at, end)] * (at < end)

    def tags(self, at: int, end: int) -> list[Node]:
        return self.run(at, end, TAG_SIGNS, self.tag, "Truncated block")

    def layer(self, at: int, limit: int, index: int) -> tuple[Node, int, str, list[tuple[int, int]]]:
        """(node, end, name, (channel, bytes) of its channels)."""
        if at + 18 > limit:
            raise Cut
        sides = {name: self.number(at + 4 * i, 4, True) for i, name in enumerate(("top", "left", "bottom", "right"))}
        edges = [Node(f"{name.title()}: {x}", at + 4 * i, at + 4 * i + 4) for i, (name, x) in enumerate(sides.items())]
        count, entry, first = self.number(at + 16, 2), 2 + self.width, at + 18
        p = first + count * entry
        if p + 16 > limit:
            raise Cut
        kids = [Node(f"Bounds: {', '.join(f'{name} {x}' for name, x in sides.items())}", at, at + 16, edges), Node(f"Channels: {count}", at + 16, first)]
        channels = [(self.number(q, 2, True), self.number(q + 2, self.width)) for q in range(first, p, entry)]
        kids.append(Node("Channel information", first, p, [Node(f"Channel {c}{CHANNELS.get(c, '')}: {n} bytes", first + i * entry, first + (i + 1) * entry) for i, (c, n) in enumerate(channels)]))
        blend, flags, size = self.data[p + 4 : p + 8], self.number(p + 10, 1), self.number(p + 12)
        mode = f"{BLENDING[blend]} ({self.ascii(p + 4)})" if blend in BLENDING else self.ascii(p + 4)
        told = ["transparency protected"] * (flags & 1) + ["hidden" if flags & 2 else "visible"] + ["pixel data irrelevant"] * (flags & 0x18 == 0x18)
        parts = [
            (f"Blend mode signature: {self.ascii(p)}", 0, 4), (f"Blend mode: {mode}", 4, 8), (f"Opacity: {self.data[p + 8]}", 8, 9),
            (f"Clipping: {'Non-base' if self.data[p + 9] else 'Base'}", 9, 10), (f"Flags: 0x{flags:02X} ({', '.join(told)})", 10, 11), ("Filler", 11, 12),
            (f"Extra data length: {size}", 12, 16),
        ]
        kids += [Node(x, p + a, p + b) for x, a, b in parts]
        body, end, name = p + 16, min(p + 16 + size, limit), ""
        if size:
            extra, name = self.extra(body, end)
            kids.append(Node("Extra data", body, end, extra))
        return Node(_named(f"Layer {index}:", name) if name else f"Layer {index}", at, min(body + size, limit), kids), body + size, name, channels

    def extra(self, at: int, end: int) -> tuple[list[Node], str]:
        out, name = [], ""
        for label in ("Layer mask data", "Layer blending ranges"):
            if at + 4 > end:
                break
            n = self.number(at)
            out.append(Node(f"{label} ({n} bytes)", at, min(at + 4 + n, end), [Node(f"Length: {n}", at, at + 4)]))
            at += 4 + n
        try:
            if at < end:
                name = self.pascal(at)
                stop = min(at + -(-(1 + len(name)) // 4) * 4, end)
                out.append(Node(f'Layer name: "{_short(name)}"', at, stop))
                at = stop
        except Cut:
            pass
        if at < end:
            tags = self.tags(at, end)
            told = [k.label[7:-1] for t in tags if t.label.startswith("luni") for k in t.kids if k.label.startswith('Name: "')]
            name = told[-1] if told else name
            out.append(Node("Additional layer information", at, end, tags))
        return out, name

    def layers(self, at: int, body: int, end: int, size: int) -> Node:
        out = Node("Layer info", at, end, [Node(f"Length: {size}", at, body)])
        count = self.v.number(body, 2, "big", True) if size and body + 2 <= end else None
        if count is None:
            return out
        pos, found = body + 2, []
        out.open = True
        out.kids.append(Node(f"Layer count: {count}" + " (first alpha channel is merged transparency)" * (count < 0), body, pos))
        try:
            for i in range(abs(count)):
                found.append(self.layer(pos, end, i))
                pos = found[-1][1]
        except Cut:
            pass
        if not found:
            out.kids += [Node("Layer records (unparsed)", pos, end)] * (pos < end)
            return out
        stop, at, held = min(pos, end), pos, []
        for i, (_, _, name, channels) in enumerate(found):
            if at >= end:
                break
            first, own = at, []
            for c, n in channels:
                if at >= end:
                    break
                how = self.v.number(at, 2, "big") if n >= 2 else None
                told = "" if how is None else f"{COMPRESSIONS.get(how, f'unknown ({how})')}, "
                own.append(Node(f"Channel {c}{CHANNELS.get(c, '')}: {told}{n} bytes", at, min(at + n, end)))
                at += n
            held.append(Node(_named(f"Layer {i}:", name) if name else f"Layer {i}", first, min(at, end), own))
        out.kids.append(Node("Layer records", body + 2, stop, [x[0] for x in found], True))
        out.kids += [Node("Channel image data", stop, min(at, end), held)] * (stop < end) + [Node("Padding", at, end)] * (at < end)
        return out

    def layers_and_masks(self, at: int) -> tuple[Node, int]:
        size, body = self.number(at, self.width), at + self.width
        last, end = body + size, min(body + size, self.v.size)
        kids = [Node(f"Length: {size}", at, body)]
        if size and body + self.width <= end:
            n, first = self.number(body, self.width), body + self.width
            kids.append(self.layers(body, first, min(first + n, end), n))
            pos = first + n
            if pos + 4 <= end:
                n = self.number(pos)
                stop = min(pos + 4 + n, end)
                held = [Node(f"Length: {n}", pos, pos + 4)] + [Node("Data", pos + 4, stop)] * (n > 0 and pos + 4 < end)
                kids.append(Node("Global layer mask info", pos, stop, held))
                pos += 4 + n
            if pos < end:
                kids.append(Node("Additional layer information", pos, end, self.tags(pos, end)))
        return Node("Layer and mask information", at, end, kids, True), last


def psd(v: View) -> list[Node]:
    if v.size < HEADER:
        return []
    image, at = _Image(v), HEADER
    out = [image.header()]
    try:
        n = image.number(at)
        end = min(at + 4 + n, v.size)
        out.append(Node("Color mode data", at, end, [Node(f"Length: {n}", at, at + 4)] + [Node("Data", at + 4, end)] * (n > 0 and at + 4 < v.size)))
        at += 4 + n
        n = image.number(at)
        end = min(at + 4 + n, v.size)
        kids = [Node(f"Length: {n}", at, at + 4), *image.run(at + 4, end, SIGNS, image.resource, "Truncated resource")]
        out.append(Node("Image resources", at, end, kids, True))
        node, at = image.layers_and_masks(at + 4 + n)
        out.append(node)
        how = image.number(at, 2)
        kids = [Node(f"Compression: {COMPRESSIONS.get(how, f'unknown ({how})')}", at, at + 2)] + [Node("Data", at + 2, v.size)] * (at + 2 < v.size)
        out.append(Node("Image data", at, v.size, kids, True))
    except Cut:
        pass
    return out


WALKERS = {"PSD": psd}
