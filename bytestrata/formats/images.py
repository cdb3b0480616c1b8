"""Walker of JPEG: markers, scans, and the directories of EXIF."""

from __future__ import annotations

import re

from bytestrata.formats.tree import Node, View

# Fixed values of the formats.
EXIF_TAGS = {
    0x000B: "ProcessingSoftware", 0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample",
    0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010A: "FillOrder", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make",
    0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts",
    0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x012D: "TransferFunction", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013D: "Predictor", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities",
    0x0140: "ColorMap", 0x0142: "TileWidth", 0x0143: "TileLength", 0x0144: "TileOffsets", 0x0145: "TileByteCounts", 0x014A: "SubIFDs",
    0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x02BC: "XMLPacket", 0x4746: "Rating", 0x4749: "RatingPercent", 0x800D: "ImageID",
    0x828D: "CFARepeatPatternDim", 0x828E: "CFAPattern", 0x828F: "BatteryLevel", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x83BB: "IPTCNAA", 0x8649: "ImageResources", 0x8769: "Exif IFD pointer", 0x8773: "InterColorProfile", 0x8822: "ExposureProgram",
    0x8824: "SpectralSensitivity", 0x8825: "GPS Info IFD pointer", 0x8827: "ISOSpeedRatings", 0x8828: "OECF", 0x8830: "SensitivityType",
    0x8832: "RecommendedExposureIndex", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue",
    0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x920B: "FlashEnergy",
    0x920E: "FocalPlaneXResolution", 0x920F: "FocalPlaneYResolution", 0x9210: "FocalPlaneResolutionUnit", 0x9214: "SubjectLocation",
    0x9215: "ExposureIndex", 0x9217: "SensingMethod", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal",
    0x9292: "SubSecTimeDigitized", 0x9400: "Temperature", 0x9401: "Humidity", 0x9402: "Pressure", 0x9403: "WaterDepth", 0x9404: "Acceleration",
    0x9405: "CameraElevationAngle", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
    0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile",
    0xA005: "Interoperability IFD pointer", 0xA20B: "FlashEnergy", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution",
    0xA210: "FocalPlaneResolutionUnit", 0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource",
    0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio",
    0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness",
    0xA40B: "DeviceSettingDescription", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xA460: "CompositeImage", 0xA500: "Gamma",
}
EXIF_VALUES = {
    0x0103: {1: "Uncompressed", 6: "JPEG"},
    0x0112: {
        1: "Horizontal (normal)", 2: "Mirrored horizontal", 3: "Rotated 180", 4: "Mirrored vertical", 5: "Mirrored horizontal, rotated 90 CW",
        6: "Rotated 90 CW (Vertical)", 7: "Mirrored horizontal, rotated 90 CCW", 8: "Rotated 90 CCW (Vertical)",
    },
    0x0128: {1: "None", 2: "Inches", 3: "Centimeters"},
    0x0213: {1: "Centered", 2: "Co-sited"},
    0x8822: {
        0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative program", 6: "Action program",
        7: "Portrait mode", 8: "Landscape mode",
    },
    0x9207: {0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Pattern", 6: "Partial", 255: "Other"},
    0x9208: {
        0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten", 4: "Flash", 9: "Fine weather", 10: "Cloudy", 11: "Shade", 255: "Other",
    },
    0x9209: {
        0x00: "No flash", 0x01: "Flash fired", 0x05: "Flash fired, return not detected", 0x07: "Flash fired, return detected",
        0x09: "Flash fired, compulsory", 0x0D: "Flash fired, compulsory, return not detected", 0x0F: "Flash fired, compulsory, return detected",
        0x10: "Flash did not fire, compulsory", 0x18: "No flash function", 0x19: "Flash fired, auto mode",
        0x1D: "Flash fired, auto mode, return not detected", 0x1F: "Flash fired, auto mode, return detected", 0x20: "No flash function",
    },
    0xA001: {1: "sRGB", 0xFFFF: "Uncalibrated"},
    0xA403: {0: "Auto", 1: "Manual"},
    0xA406: {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night scene"},
}
EXIF_KINDS = {
    1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1), 7: ("UNDEFINED", 1), 8: ("SSHORT", 2),
    9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8),
}
GPS_TAGS = [
    "GPSVersionID", "GPSLatitudeRef", "GPSLatitude", "GPSLongitudeRef", "GPSLongitude", "GPSAltitudeRef", "GPSAltitude", "GPSTimeStamp", "GPSSatellites",
    "GPSStatus", "GPSMeasureMode", "GPSDOP", "GPSSpeedRef", "GPSSpeed", "GPSTrackRef", "GPSTrack", "GPSImgDirectionRef", "GPSImgDirection", "GPSMapDatum",
    "GPSDestLatitudeRef", "GPSDestLatitude", "GPSDestLongitudeRef", "GPSDestLongitude", "GPSDestBearingRef", "GPSDestBearing", "GPSDestDistanceRef",
    "GPSDestDistance", "GPSProcessingMethod", "GPSAreaInformation", "GPSDateStamp", "GPSDifferential", "GPSHPositioningError",
]
DIRECTION = {"T": "True direction", "M": "Magnetic direction"}
GPS_VALUES = {
    1: {"N": "North", "S": "South"}, 3: {"E": "East", "W": "West"}, 5: {"0": "Above sea level", "1": "Below sea level"},
    9: {"A": "Measurement in progress", "V": "Measurement interoperability"}, 10: {"2": "2-dimensional", "3": "3-dimensional"},
    12: {"K": "Kilometers per hour", "M": "Miles per hour", "N": "Knots"}, 14: DIRECTION, 16: DIRECTION, 23: DIRECTION,
}
DENSITY = {0: "No units (aspect ratio)", 1: "Pixels per inch", 2: "Pixels per centimeter"}
SUB_DIRECTORIES = {0x8769: "Exif SubIFD", 0xA005: "Interoperability IFD", 0x8825: "GPS IFD"}
IFD_DEPTH = 4

#: Where entropy-coded data ends: at a marker that is neither a stuffed byte nor a restart.
SCAN_END = re.compile(rb"\xff(?![\x00\xd0-\xd7])")


def jpeg(v: View) -> list[Node]:
    if v.data[:2] != b"\xff\xd8":
        return []
    out, at = [Node("SOI", 0, 2)], 2
    while at + 2 <= v.size and v.data[at] == 0xFF:
        mark = v.data[at + 1]
        if mark == 0xD9:
            out.append(Node("EOI", at, at + 2))
            break
        length = v.number(at + 2, 2, "big")
        if length is None or length < 2:
            break
        found = _scan(v, at, min(at + 2 + length, v.size)) if mark == 0xDA else _segment(v, at, mark, min(at + 2 + length, v.size))
        if found is None:
            break
        out.append(found)
        at = found.end
    return out


def _data(label: str, start: int, end: int) -> list[Node]:
    return [Node(label, start, end)] * (end > start)


def _segment(v: View, at: int, mark: int, end: int) -> Node:
    body = at + 4
    if mark == 0xE1 and v.data.startswith(b"Exif\0\0", body):
        return Node("APP1 marker (Exif)", at, end, _exif(v, body, end), True)
    if mark == 0xE0 and v.data.startswith(b"JFIF\0", body):
        return Node("APP0 marker (JFIF)", at, end, _jfif(v, body, end), True)
    if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
        label = f"SOF{mark - 0xC0} marker" if mark <= 0xC3 else f"Marker 0x{mark:02x}"
        return Node(label, at, end, _frame(v, body) if body + 6 <= v.size else _data("Data", body, end), True)
    if 0xE0 <= mark <= 0xEF:
        return Node(f"APP{mark - 0xE0} marker", at, end, _data("Data", body, end))
    label, held = {0xDB: ("DQT marker", "Quantization table data"), 0xC4: ("DHT marker", "Huffman table data")}.get(mark, (f"Marker 0x{mark:02x}", "Data"))
    return Node(label, at, end, _data(held, body, end))


def _rows(v: View, at: int, count: int, parts: list[tuple[str, str]]) -> tuple[list[Node], int]:
    """Components of one byte per part, the first of which numbers it; those that lie whole in the data, and their end."""
    out, width = [], len(parts)
    while len(out) < count and at + width <= v.size:
        own = v.data[at : at + width]
        kids = [Node(f"{name}: {how.format(n)}", at + i, at + i + 1) for i, ((name, how), n) in enumerate(zip(parts, own, strict=True))]
        out.append(Node(f"Component {own[0]}", at, at + width, kids))
        at += width
    return out, at


def _frame(v: View, at: int) -> list[Node]:
    precision, height, width, n = v.data[at], v.number(at + 1, 2, "big"), v.number(at + 3, 2, "big"), v.data[at + 5]
    head = [Node(f"Precision: {precision}", at, at + 1), Node(f"Height: {height}", at + 1, at + 3), Node(f"Width: {width}", at + 3, at + 5), Node(f"Number of components: {n}", at + 5, at + 6)]
    return head + _rows(v, at + 6, n, [("Component id", "{}"), ("Sampling factors", "0x{:02x}"), ("Quantization table selector", "{}")])[0]


def _scan(v: View, at: int, end: int) -> Node | None:
    body = at + 4
    if body >= v.size:
        return None
    n = v.data[body]
    rows, here = _rows(v, body + 1, n, [("Component selector", "{}"), ("Huffman table selectors", "0x{:02x}")])
    kids = [Node(f"Number of components: {n}", body, body + 1), *rows]
    if here + 3 <= v.size:
        kids.append(Node("Spectral selection / approximation", here, here + 3))
        here += 3
    begin = max(end, here)
    # stuffed and restart pairs are skipped whole, so that their second byte begins no marker
    stop = begin
    while True:
        found = v.data.find(b"\xff", stop)
        if found < 0:
            stop = max(v.size, begin)
            break
        if SCAN_END.match(v.data, found):
            stop = found
            break
        stop = found + 2
    return Node("SOS", at, stop, kids + _data("Entropy-coded scan data", begin, stop))


def _jfif(v: View, body: int, end: int) -> list[Node]:
    at = body + 5
    if at + 9 > v.size:
        return _data("JFIF data", body, end)
    major, minor, units, wide, high = (v.data[at + i] for i in (0, 1, 2, 7, 8))
    parts = [
        (f"Version: {major}.{minor:02}", 0, 2), (f"Density units: {DENSITY.get(units, 'Unknown')} ({units})", 2, 3), (f"X density: {v.number(at + 3, 2, 'big')}", 3, 5),
        (f"Y density: {v.number(at + 5, 2, 'big')}", 5, 7), (f"Thumbnail width: {wide}", 7, 8), (f"Thumbnail height: {high}", 8, 9),
    ]
    return [Node("Identifier: JFIF", body, at), *(Node(x, at + a, at + b) for x, a, b in parts), *_data("Thumbnail data (RGB)", at + 9, min(at + 9 + 3 * wide * high, end))]


def _exif(v: View, body: int, end: int) -> list[Node]:
    base = body + 6
    order = {b"II": "little", b"MM": "big"}.get(v.data[base : base + 2])
    first = v.number(base + 4, 4, order) if order and v.number(base + 2, 2, order) == 42 else None
    if first is None:
        return _data("Exif data", body, end)
    top = _directory(v, base, first, order, "IFD0", False, 0)
    named = "big-endian (MM)" if order == "big" else "little-endian (II)"
    if top is not None:
        top.open = True
    return [Node("Identifier: Exif", body, base), Node(f"Byte order: {named}", base, base + 2), top or Node("IFD0 (unparseable)", body, end)]


def _directory(v: View, base: int, offset: int, order: str, label: str, gps: bool, depth: int) -> Node | None:
    """An image file directory; None where its count lies outside the data. Directories in it are followed to IFD_DEPTH."""
    start = base + offset
    count = v.number(start, 2, order)
    if count is None:
        return None
    kids, at = [], start + 2
    for _ in range(count):
        if at + 12 > v.size:
            break
        tag, kind, n, raw = v.number(at, 2, order), v.number(at + 2, 2, order), v.number(at + 4, 4, order), v.number(at + 8, 4, order)
        sub = None
        if not gps and tag in SUB_DIRECTORIES and depth < IFD_DEPTH:
            sub = _directory(v, base, raw, order, SUB_DIRECTORIES[tag], tag == 0x8825, depth + 1)
        kids.append(sub or Node(_entry(v, base, order, gps, tag, kind, n, at + 8, raw), at, at + 12))
        at += 12
    return Node(label, start, at, kids)


def _entry(v: View, base: int, order: str, gps: bool, tag: int, kind: int, n: int, field: int, raw: int) -> str:
    name = (GPS_TAGS[tag] if tag < len(GPS_TAGS) else "") if gps else EXIF_TAGS.get(tag, "")
    name = name or f"Tag 0x{tag:04x}"
    type_name, width = EXIF_KINDS.get(kind, ("UNKNOWN", 0))
    where = field if min(width * n, 2**32 - 1) <= 4 else base + raw
    text = _gps_triple(v, where, order, tag) if gps and kind == 5 and n == 3 else None
    if text is None:
        text = _value(v, where, order, kind, n)
    if text is not None:
        known = GPS_VALUES.get(tag, {}).get(text) if gps else EXIF_VALUES.get(tag, {}).get(int(text)) if kind == 3 and n == 1 else None
        return f"{name}: {known} ({text})" if known else f"{name}: {text}"
    return f"{name} ({type_name}, count {n})"


def _value(v: View, at: int, order: str, kind: int, n: int) -> str | None:
    """Texts, and single numbers and ratios; None for other values."""
    if kind == 2:
        return v.text(at, at + n).rstrip("\0") if at + n <= v.size else None
    if n != 1 or kind not in (3, 4, 5, 10):
        return None
    a = v.number(at, 2 if kind == 3 else 4, order)
    if kind in (3, 4) or a is None:
        return None if a is None else str(a)
    b = v.number(at + 4, 4, order)
    return None if b is None else f"{a}/{b}"


def _gps_triple(v: View, at: int, order: str, tag: int) -> str | None:
    """Degrees, minutes and seconds, or a time of day."""
    numbers = [v.number(at + 4 * i, 4, order) for i in range(6)]
    if None in numbers or tag not in (2, 4, 7, 20, 22):
        return None
    a, b, c = (x / y if y else 0.0 for x, y in zip(numbers[::2], numbers[1::2], strict=True))
    return f"{a:02.0f}:{b:02.0f}:{c:05.2f} UTC" if tag == 7 else f"{a:.0f}°{b:.0f}'{c:.2f}\" ({a + b / 60 + c / 3600:.6f}°)"


WALKERS = {"JPEG": jpeg}
