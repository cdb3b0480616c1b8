"""Walker of BPG: a packed header, extensions that may hold a smaller image, and units of coded picture."""

from __future__ import annotations

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
MAGIC, FIXED, NESTED, UNITS_SHOWN = b"BPG\xfb", 6, 4, 10_000
PIXELS = ["Grayscale", "4:2:0 (JPEG chroma position)", "4:2:2 (JPEG chroma position)", "4:4:4", "4:2:0 (MPEG2 chroma position)", "4:2:2 (MPEG2 chroma position)"]
COLORS = [
    "YCbCr (BT 601)", "RGB", "YCgCo", "YCbCr (BT 709)", "YCbCr (BT 2020 non-constant luminance)", "YCbCr (BT 2020 constant luminance, reserved)",
]
ALPHA = {(0, 0): "none", (1, 0): "alpha (not premultiplied)", (1, 1): "alpha (premultiplied)", (0, 1): "W plane (CMYK)"}
EXTENSIONS = {1: "EXIF", 2: "ICC profile", 3: "XMP", 4: "Thumbnail", 5: "Animation control"}
UNITS = {
    0: "TRAIL_N", 1: "TRAIL_R", 2: "TSA_N", 3: "TSA_R", 4: "STSA_N", 5: "STSA_R", 6: "RADL_N", 7: "RADL_R", 8: "RASL_N", 9: "RASL_R", 16: "BLA_W_LP", 17: "BLA_W_RADL",
    18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT", 32: "VPS", 33: "SPS", 34: "PPS", 35: "AUD", 36: "EOS", 37: "EOB", 38: "FD", 39: "PREFIX_SEI",
    40: "SUFFIX_SEI",
}
#: Fields of the coded picture's header and their bits; 0: a number that tells its own length. Those behind a + follow only
#: where the field named before them is not 0.
FIELDS = [
    ("log2_min_luma_coding_block_size_minus3", 0), ("log2_diff_max_min_luma_coding_block_size", 0), ("log2_min_transform_block_size_minus2", 0),
    ("log2_diff_max_min_transform_block_size", 0), ("max_transform_hierarchy_depth_intra", 0), ("sample_adaptive_offset_enabled_flag", 1), ("pcm_enabled_flag", 1),
    ("+pcm_enabled_flag", [
        ("pcm_sample_bit_depth_luma_minus1", 4), ("pcm_sample_bit_depth_chroma_minus1", 4), ("log2_min_pcm_luma_coding_block_size_minus3", 0),
        ("log2_diff_max_min_pcm_luma_coding_block_size", 0), ("pcm_loop_filter_disabled_flag", 1),
    ]),
    ("strong_intra_smoothing_enabled_flag", 1), ("sps_extension_present_flag", 1),
    ("+sps_extension_present_flag", [
        ("sps_range_extension_flag", 1), ("sps_extension_7bits", 7),
        ("+sps_range_extension_flag", [
            ("transform_skip_rotation_enabled_flag", 1), ("transform_skip_context_enabled_flag", 1), ("implicit_rdpcm_enabled_flag", 1), ("explicit_rdpcm_enabled_flag", 1),
            ("extended_precision_processing_flag", 1), ("intra_smoothing_disabled_flag", 1), ("high_precision_offsets_enabled_flag", 1),
            ("persistent_rice_adaptation_enabled_flag", 1), ("cabac_bypass_alignment_enabled_flag", 1),
        ]),
    ]),
]


class Bad(Exception):
    """No number of this form here."""


def _count(data: bytes, at: int, end: int, bits: int = 32) -> tuple[int, int]:
    """(number, its end), seven bits a byte, highest first."""
    n = 0
    for i in range(at, min(at + -(-bits // 7), end)):
        n = n << 7 | data[i] & 127
        if data[i] < 128:
            if n >> bits:
                break
            return n, i + 1
    raise Bad


def _yes(flag: int) -> str:
    return "yes" if flag else "no"


def _image(data: bytes, at: int, end: int, depth: int) -> list[Node]:
    if end - at < FIXED or data[at : at + 4] != MAGIC:
        return []
    a, b = data[at + 4], data[at + 5]
    pixel, color, alpha = a >> 5, b >> 4, (a >> 4 & 1, b >> 2 & 1)
    named = lambda names, i: names[i] if i < len(names) else "Reserved"
    told = [
        ("Magic: BPG\\xFB", 0, 4), (f"Pixel format: {named(PIXELS, pixel)} ({pixel})", 4, 5), (f"Alpha1 flag: {alpha[0]}", 4, 5), (f"Bit depth: {(a & 15) + 8}", 4, 5),
        (f"Color space: {named(COLORS, color)} ({color})", 5, 6), (f"Extension present: {_yes(b & 8)}", 5, 6), (f"Alpha2 flag: {alpha[1]}", 5, 6),
        (f"Limited range: {_yes(b & 2)}", 5, 6), (f"Animation: {_yes(b & 1)}", 5, 6), (f"Alpha: {ALPHA[alpha]}", 4, 6),
    ]
    kids, pos, sizes, whole = [Node(x, at + i, at + j) for x, i, j in told], at + FIXED, [], True
    try:
        for name in ["Width", "Height", "Picture data length"] + ["Extension data length"] * bool(b & 8):
            n, stop = _count(data, pos, end)
            kids.append(Node(f"{name}: {n}" + " (until end of file)" * (name == "Picture data length" and not n), pos, stop))
            sizes.append(n)
            pos = stop
    except Bad:
        whole = False
    out = [Node("BPG header", at, pos, kids, True)]
    if not whole:
        return out
    if b & 8:
        stop = min(pos + sizes[3], end)
        out.append(Node("Extension data", pos, stop, _extensions(data, pos, stop, depth), True))
        pos += sizes[3]
    if pos >= end:
        return out
    stop = min(pos + sizes[2], end) if sizes[2] else end
    out.append(Node("Picture data", pos, stop, _picture(data, pos, stop, alpha), True))
    return out + [Node("Trailing data", stop, end)] * (stop < end)


def _extensions(data: bytes, at: int, end: int, depth: int) -> list[Node]:
    out = []
    while at < end:
        try:
            tag, middle = _count(data, at, end)
            size, body = _count(data, middle, end)
        except Bad:
            return [*out, Node("Malformed extension", at, end)]
        name, stop = EXTENSIONS.get(tag, "Unknown"), min(body + size, end)
        kids = [Node(f"Tag: {tag} ({name})", at, middle), Node(f"Length: {size}", middle, body)]
        if tag == 5 and stop > body:
            kids += _animation(data, body, stop)
        elif tag == 4 and stop > body and depth < NESTED and data[body : min(body + 4, stop)] == MAGIC:
            kids.append(Node("Thumbnail (BPG)", body, stop, _image(data, body, stop, depth + 1)))
        else:
            kids += [Node("Data", body, stop)] * (stop > body)
        out.append(Node(f"Extension: {name} ({size} bytes)", at, stop, kids))
        at = body + size
    return out


def _animation(data: bytes, at: int, end: int) -> list[Node]:
    out, values = [], []
    for name in ("Loop count", "Frame period numerator", "Frame period denominator"):
        try:
            n, stop = _count(data, at, end, 16)
        except Bad:
            return out
        out.append(Node(f"{name}: {n}" + " (infinite)" * (not values and not n), at, stop))
        values.append(n)
        at = stop
    if values[2]:
        out.append(Node(f"Frame period: {values[1]}/{values[2]} s ({values[1] / values[2]:.3f} s)", out[1].start, at))
    return out + [Node("Padding", at, end)] * (at < end)


def _picture(data: bytes, at: int, end: int, alpha: tuple[int, int]) -> list[Node]:
    out, planes = [], ["Color HEVC header"]
    if any(alpha):
        planes.insert(0, "Alpha HEVC header" if alpha[0] else "W plane HEVC header (CMYK)")
    for name in planes:
        try:
            size, body = _count(data, at, end)
        except Bad:
            return out + [Node("Malformed HEVC header", at, end)] * (at < end)
        stop = min(body + size, end)
        out.append(Node(name, at, stop, [Node(f"HEVC header length: {size}", at, body), *_Bits(data, body, stop).header()]))
        at = body + size
        if at >= end:
            return out
    return [*out, Node("HEVC data", at, end, _units(data, at, end, any(alpha)))]


class _Bits:
    """Fields of any number of bits; each is shown by the bytes that it touches."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end, self.bit = data, at, end, 8 * at

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            if self.bit >= 8 * self.end:
                raise Bad
            value = value << 1 | self.data[self.bit // 8] >> 7 - self.bit % 8 & 1
            self.bit += 1
        return value

    def grown(self) -> int:
        """As many zeros as bits follow the first 1."""
        zeros = 0
        while not self.take(1):
            zeros += 1
            if zeros > 31:
                raise Bad
        return (1 << zeros) - 1 + self.take(zeros)

    def fields(self, layout: list, out: list[Node], seen: dict[str, int]) -> None:
        for name, how in layout:
            if name[0] == "+":
                if seen[name[1:]]:
                    self.fields(how, out, seen)
                continue
            before = self.bit // 8
            seen[name] = self.take(how) if how else self.grown()
            out.append(Node(f"{name}: {seen[name]}", before, -(-self.bit // 8)))

    def header(self) -> list[Node]:
        out: list[Node] = []
        try:
            self.fields(FIELDS, out, {})
        except Bad:
            return out
        used = -(-self.bit // 8)
        return out + [Node("Extra header bytes", used, self.end)] * (used < self.end)


def _units(data: bytes, at: int, end: int, alpha: bool) -> list[Node]:
    """Units that start codes part: two or three zeros and a 1."""
    out, unit = [], at
    while True:
        if len(out) >= UNITS_SHOWN:
            return [*out, Node("Remaining NAL units", at, end)]
        head = unit + 2
        code = data.find(b"\0\0\1", min(head, end), end)
        stop, following = (end, end) if code < 0 else (code - (code > head and not data[code - 1]), code + 3)
        kids, label = [Node("Start code", at, unit)] * (unit > at), "Truncated NAL unit"
        if head <= stop:
            a, b = data[unit], data[unit + 1]
            name, layer = UNITS.get(a >> 1 & 63, "Reserved"), (a & 1) << 5 | b >> 3
            kids.append(Node(f"NAL header: type {a >> 1 & 63} ({name}), layer {layer}, temporal_id_plus1 {b & 7}", unit, head))
            kids += [Node("Payload", head, stop)] * (stop > head)
            label = f"NAL unit: {name}" + (f", {'alpha' if layer == 1 else 'color'}" if alpha else "")
        out.append(Node(label, at, stop, kids))
        if stop >= end:
            return out
        at, unit = stop, following


def bpg(v: View) -> list[Node]:
    return _image(v.data, 0, v.size, 0)


WALKERS = {"BPG": bpg}
