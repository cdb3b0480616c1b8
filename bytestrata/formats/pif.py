"""Walker of program information files: a fixed section, then a chain of headings that say where their data lie."""

from __future__ import annotations

import unicodedata

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
BASIC, HEADING, LAST = 0x171, 0x16, 0xFFFF
SECTIONS_SHOWN, LINES_SHOWN, CHARS = 64, 4096, 80
PROGRAM = {
    0x0001: "Directly modify memory", 0x0002: "Graphics/multiple text", 0x0004: "Prevent program switch", 0x0008: "No screen exchange", 0x0010: "Close window on exit",
    0x0040: "Direct COM1 access", 0x0080: "Direct COM2 access",
}
PROGRAM_2 = {
    0x0010: "Direct keyboard access", 0x0020: "Use coprocessor", 0x0040: "Stop in background", 0x0080: "Directly modify screen", 0x2000: "Exchange interrupt vectors",
    0x4000: "Parameters on command line",
}
OPTIONS_386 = {
    0x00000001: "Allow close when active", 0x00000002: "Background", 0x00000004: "Exclusive", 0x00000008: "Full screen", 0x00000020: "Reserve Alt+Tab",
    0x00000040: "Reserve Alt+Esc", 0x00000080: "Reserve Alt+Space", 0x00000100: "Reserve Alt+Enter", 0x00000200: "Reserve Alt+PrtSc", 0x00000400: "Reserve PrtSc",
    0x00000800: "Reserve Ctrl+Esc", 0x00001000: "Detect idle time", 0x00002000: "No HMA", 0x00004000: "Use shortcut key", 0x00008000: "EMS locked",
    0x00010000: "XMS locked", 0x00020000: "Fast paste", 0x00040000: "Lock application memory", 0x00080000: "Memory protection", 0x00100000: "Start minimized",
    0x00200000: "Start maximized", 0x00800000: "MS-DOS mode", 0x01000000: "Prevent Windows detection", 0x04000000: "Don't suggest MS-DOS mode",
    0x10000000: "Don't warn before MS-DOS mode",
}
VIDEO_386 = {
    0x0001: "Emulate video ROM", 0x0002: "No port monitoring: text", 0x0004: "No port monitoring: low graphics", 0x0008: "No port monitoring: high graphics",
    0x0010: "Video memory: text", 0x0020: "Video memory: low graphics", 0x0040: "Video memory: high graphics", 0x0080: "Retain video memory",
}
MODIFIERS = {0x0003: "Shift", 0x0004: "Ctrl", 0x0008: "Alt"}
SHORTCUT = {0x0001: "Extended scan code"}
FLAGS_286 = {
    0x0001: "Reserve Alt+Tab", 0x0002: "Reserve Alt+Esc", 0x0004: "Reserve Alt+PrtSc", 0x0008: "Reserve PrtSc", 0x0010: "Reserve Ctrl+Esc", 0x0020: "No screen save",
    0x4000: "Direct COM3 access", 0x8000: "Direct COM4 access",
}
FLAGS_VMM = {0x0002: "Run in background", 0x0010: "Don't warn on exit", 0x0020: "Disallow screen saver"}
VIDEO_VMM = {0x0001: "Emulate video ROM", 0x0080: "No dynamic video memory", 0x0100: "Full screen"}
KEYS = {
    0x0001: "Fast paste", 0x0020: "Reserve Alt+Tab", 0x0040: "Reserve Alt+Esc", 0x0080: "Reserve Alt+Space", 0x0100: "Reserve Alt+Enter", 0x0200: "Reserve Alt+PrtSc",
    0x0400: "Reserve PrtSc", 0x0800: "Reserve Ctrl+Esc",
}
MOUSE = {0x0001: "QuickEdit off", 0x0002: "Exclusive mouse"}
FONT = {0x0004: "Raster fonts available", 0x0008: "TrueType fonts available", 0x0010: "Auto font size", 0x0400: "Current font is raster", 0x0800: "Current font is TrueType"}
WINDOW, RESTORE, TIMER = {0x0002: "Show toolbar"}, {0x0001: "Don't restore settings at startup"}, {0x0010: "Compatible timer emulation"}
#: Fields that follow each other: name, bytes, and how they are shown: a number, hex, kilobytes, text (8 or 16 bits), flags, or
#: None where nobody knows.
FIRST = [
    ("Reserved", 1, "hex"), ("Checksum", 1, "hex"), ("Window title", 30, "text"), ("Max conventional memory", 2, "kb"), ("Min conventional memory", 2, "kb"),
    ("Program filename", 63, "text"), ("Flags", 2, PROGRAM), ("Working directory", 64, "text"), ("Parameters", 64, "text"), ("Video mode", 1, "hex"),
    ("Text video pages", 1, "number"), ("First used interrupt", 1, "hex"), ("Last used interrupt", 1, "hex"), ("Screen rows", 1, "number"),
    ("Screen columns", 1, "number"), ("Window X position", 1, "number"), ("Window Y position", 1, "number"), ("Last text video page / flags", 2, "hex"),
    ("Unknown (unused by Windows)", 128, None), ("Flags 2", 2, PROGRAM_2),
]
LAYOUTS = {
    "WINDOWS 386 3.0": [
        ("Max conventional memory", 2, "kb"), ("Min conventional memory", 2, "kb"), ("Foreground priority", 2, "number"), ("Background priority", 2, "number"),
        ("Max EMS memory", 2, "kb"), ("Min EMS memory", 2, "kb"), ("Max XMS memory", 2, "kb"), ("Min XMS memory", 2, "kb"), ("Options", 4, OPTIONS_386),
        ("Video", 2, VIDEO_386), ("Unknown", 2, None), ("Shortcut key scan code", 2, "hex"), ("Shortcut key modifiers", 2, MODIFIERS),
        ("Shortcut key in use (0x000F = yes)", 2, "hex"), ("Shortcut key flags", 2, SHORTCUT), ("Unknown", 8, None), ("Parameters", 64, "text"),
    ],
    "WINDOWS 286 3.0": [("Max XMS memory", 2, "kb"), ("Min XMS memory", 2, "kb"), ("Flags", 2, FLAGS_286)],
    "WINDOWS VMM 4.0": [
        ("Unknown", 88, None), ("Icon file", 80, "text"), ("Icon index", 2, "number"), ("Flags", 2, FLAGS_VMM), ("Unknown", 10, None),
        ("Idle sensitivity (0 = high priority)", 2, "number"), ("Video", 2, VIDEO_VMM), ("Unknown", 8, None), ("Window text lines (0 = auto)", 2, "number"),
        ("Keyboard", 2, KEYS), ("Unknown", 16, None), ("Mouse", 2, MOUSE), ("Unknown", 6, None), ("Font", 2, FONT), ("Unknown", 2, None),
        ("Raster font width", 2, "number"), ("Raster font height", 2, "number"), ("Font width", 2, "number"), ("Font height", 2, "number"),
        ("Raster font name", 32, "text"), ("TrueType font name", 32, "text"), ("Unknown", 2, None), ("Window flags", 2, WINDOW), ("Restore flags", 2, RESTORE),
        ("Screen columns", 2, "number"), ("Screen rows", 2, "number"), ("Client area width", 2, "number"), ("Client area height", 2, "number"),
        ("Window width", 2, "number"), ("Window height", 2, "number"), ("Unknown", 2, None), ("Last state flags", 2, "hex"), ("Last show state", 2, "hex"),
        ("Unknown", 4, None), ("Maximized right", 2, "number"), ("Maximized bottom", 2, "number"), ("Window left", 2, "number"), ("Window top", 2, "number"),
        ("Normal right", 2, "number"), ("Normal bottom", 2, "number"), ("Unknown", 4, None), ("Batch file", 80, "text"), ("Environment memory", 2, "kb"),
        ("DPMI memory", 2, "kb"), ("Unknown", 2, None),
    ],
    "WINDOWS NT  3.1": [
        ("Flags", 2, TIMER), ("Unknown", 10, None), ("CONFIG.SYS replacement", 64, "text"), ("AUTOEXEC.BAT replacement", 64, "text"), ("Unknown", 2, None),
    ],
    "WINDOWS NT  4.0": [
        ("Unknown", 4, None), ("Command line (Unicode)", 256, "wide"), ("Command line", 128, "text"), ("Unknown", 240, None), ("PIF filename (Unicode)", 160, "wide"),
        ("PIF filename", 80, "text"), ("Window title (Unicode)", 60, "wide"), ("Window title", 30, "text"), ("Icon file (Unicode)", 160, "wide"),
        ("Icon file", 80, "text"), ("Working directory (Unicode)", 128, "wide"), ("Working directory", 64, "text"), ("Unknown", 286, None),
    ],
}
TEXTS = {"CONFIG  SYS 4.0", "AUTOEXECBAT 4.0"}


def _shown(text: str) -> str:
    text = "".join("." if unicodedata.category(c) == "Cc" else c for c in text)
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _until_nul(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def _flags(n: int, names: dict[int, str]) -> str:
    known = 0
    for bits in names:
        known |= bits
    told = [name for bits, name in names.items() if n & bits == bits] + [f"unknown bits 0x{n & ~known:X}"] * (n & ~known > 0)
    return ", ".join(told) or "none"


def _label(name: str, raw: bytes, how) -> str:
    n = int.from_bytes(raw, "little")
    if how is None:
        return f"{name} ({len(raw)} bytes)"
    if isinstance(how, dict):
        return f"{name}: 0x{n:0{2 * len(raw)}X} ({_flags(n, how)})"
    if how == "text":
        return f'{name}: "{_shown(_until_nul(raw).rstrip(" "))}"'
    if how == "wide":
        text = raw.decode("utf-16-le", "replace").split("\0", 1)[0]
        return f'{name}: "{_shown(text)}"'
    if how == "kb":
        return f"{name}: all available / auto (0xFFFF)" if n == 0xFFFF else f"{name}: {n} KB"
    return f"{name}: 0x{n:0{2 * len(raw)}X}" if how == "hex" else f"{name}: {n}"


def _fields(v: View, at: int, end: int, layout: list) -> list[Node]:
    """Leaves up to the first that doesn't lie whole before the end."""
    out = []
    for name, width, how in layout:
        if at + width > end:
            break
        out.append(Node(_label(name, v.data[at : at + width], how), at, at + width))
        at += width
    return out


def _lines(v: View, at: int, end: int) -> list[Node]:
    out: list[Node] = []
    while at < end and len(out) < LINES_SHOWN:
        stop = v.data.find(b"\n", at, end) + 1 or end
        text = v.data[at:stop].decode("latin-1").rstrip("\r\n\0")
        out.append(Node(f'Line: "{_shown(text)}"', at, stop))
        at = stop
    return out


def _section(v: View, at: int) -> tuple[list[Node], int]:
    """(heading and data, place of the next heading)."""
    name, following = _until_nul(v.data[at : at + 16]), v.number(at + 16, 2, "little")
    start, size = v.number(at + 18, 2, "little"), v.number(at + 20, 2, "little")
    onward = f"Next heading: 0x{following:04X}" + " (last)" * (following == LAST)
    kids = [Node(f"Name: {_shown(name)}", at, at + 16), Node(onward, at + 16, at + 18)]
    kids += [Node(f"Data offset: 0x{start:04X}", at + 18, at + 20), Node(f"Data length: {size} (0x{size:X})", at + 20, at + 22)]
    out, end = [Node(f"Section heading: {_shown(name)}", at, at + HEADING, kids)], min(start + size, v.size)
    if size and start < end and not (name == "MICROSOFT PIFEX" and not start):
        held = _fields(v, start, end, LAYOUTS[name]) if name in LAYOUTS else _lines(v, start, end) if name in TEXTS else []
        out.append(Node(f"Section data: {_shown(name)}", start, end, held or None))
    return out, following


def pif(v: View) -> list[Node]:
    if v.size < BASIC:
        return []
    out, seen, at = [], set(), BASIC
    while len(out) < SECTIONS_SHOWN and at not in seen and at + HEADING <= v.size:
        seen.add(at)
        found, at = _section(v, at)
        out += found
        if at == LAST:
            break
    covered = max([BASIC, *(x.end for x in out)])
    first = Node("Basic section", 0, BASIC, _fields(v, 0, BASIC, FIRST), True)
    return [first, *out] + [Node(f"Trailing data ({v.size - covered} bytes)", covered, v.size)] * (covered < v.size)


WALKERS = {"PIF": pif}
