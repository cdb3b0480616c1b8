"""Walker of RAR archives of both layouts: headers with their checksums, and where encryption ends the walk."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from bytestrata.formats.tree import Node, View, moment

# Fixed values of the formats.
OLD_SIGN, NEW_SIGN = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
SHOWN, RECORDS_SHOWN, LARGEST_HEADER, CHARS = 10_000, 256, 2 << 20, 200
METHODS = ["store", "fastest", "fast", "normal", "good", "best"]
OLD_TYPES = {
    0x72: "MARK", 0x73: "MAIN", 0x74: "FILE", 0x75: "COMMENT", 0x76: "AV", 0x77: "SUB", 0x78: "PROTECT", 0x79: "SIGN", 0x7A: "NEWSUB", 0x7B: "ENDARC",
}
OLD_LABELS = {
    0x73: "Main archive header", 0x74: "File", 0x75: "Comment block", 0x76: "Authenticity verification block", 0x77: "Subblock", 0x78: "Recovery record block",
    0x79: "Signature block", 0x7A: "Service", 0x7B: "End of archive",
}
ANY_FLAGS = {0x4000: "SKIP_IF_UNKNOWN", 0x8000: "LONG_BLOCK"}
MAIN_FLAGS = {
    0x0001: "VOLUME", 0x0002: "COMMENT", 0x0004: "LOCK", 0x0008: "SOLID", 0x0010: "NEWNUMBERING", 0x0020: "AV", 0x0040: "PROTECT", 0x0080: "PASSWORD",
    0x0100: "FIRSTVOLUME",
}
FILE_FLAGS = {
    0x0001: "SPLIT_BEFORE", 0x0002: "SPLIT_AFTER", 0x0004: "PASSWORD", 0x0008: "COMMENT", 0x0010: "SOLID", 0x0100: "LARGE", 0x0200: "UNICODE", 0x0400: "SALT",
    0x0800: "VERSION", 0x1000: "EXTTIME",
}
END_FLAGS = {0x0001: "NEXT_VOLUME", 0x0002: "DATACRC", 0x0004: "REVSPACE", 0x0008: "VOLNUMBER"}
OLD_FLAGS = {0x73: MAIN_FLAGS | ANY_FLAGS, 0x74: FILE_FLAGS | ANY_FLAGS, 0x7A: FILE_FLAGS | ANY_FLAGS, 0x7B: END_FLAGS | ANY_FLAGS}
OLD_SYSTEMS = ["MS-DOS", "OS/2", "Windows", "Unix", "Mac OS", "BeOS"]
DIRECTORY, LARGE, UNICODE, SALT, TIMES, LONG, LOCKED = 0xE0, 0x0100, 0x0200, 0x0400, 0x1000, 0x8000, 0x0080
TYPES = {1: "main archive", 2: "file", 3: "service", 4: "archive encryption", 5: "end of archive"}
LABELS = {1: "Main archive header", 2: "File header", 3: "Service header", 4: "Archive encryption header", 5: "End of archive header"}
HEADER_FLAGS = {1: "extra area", 2: "data area", 4: "skip if unknown", 8: "split before", 16: "split after", 32: "child", 64: "inherited"}
ARCHIVE_FLAGS = {1: "volume", 2: "volume number", 4: "solid", 8: "recovery record", 16: "locked"}
ENTRY_FLAGS = {1: "directory", 2: "mtime", 4: "CRC32", 8: "unknown size"}
VERSIONS = ["RAR 5.0", "RAR 7.0"]
SYSTEMS = ["Windows", "Unix"]
MAIN_RECORDS = {1: "Locator", 2: "Metadata"}
RECORDS = {1: "Encryption", 2: "File hash", 3: "File time", 4: "File version", 5: "Redirection", 6: "Unix owner", 7: "Service data"}
TIME_FLAGS = {1: "Unix time", 2: "mtime", 4: "ctime", 8: "atime", 16: "nanoseconds"}
STAMPS = {2: "Modified", 4: "Created", 8: "Accessed"}
OWNER_FLAGS = {1: "user name", 2: "group name", 4: "user ID", 8: "group ID"}
LINKS = {1: "Unix symlink", 2: "Windows symlink", 3: "Windows junction", 4: "hard link", 5: "file copy"}
WINDOWS_EPOCH = 11_644_473_600


class Short(Exception):
    """A header ends within a field."""


def _name(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _flags(n: int, names: dict[int, str], width: int = 2) -> str:
    told = ", ".join(name for bit, name in names.items() if n & bit)
    return f"0x{n:0{width}X}" + (f" ({told})" if told else "")


def _of(names: list[str], n: int) -> str:
    return names[n] if 0 <= n < len(names) else "unknown"


def _sized(n: int) -> str:
    for shift, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        if n >= 1 << shift and not n % (1 << shift):
            return f"{n >> shift} {unit}"
    return f"{n} bytes"


def _dos_time(n: int) -> str:
    date, time = n >> 16, n & 0xFFFF
    return f"{1980 + (date >> 9):04}-{date >> 5 & 15:02}-{date & 31:02} {time >> 11:02}:{time >> 5 & 63:02}:{(time & 31) * 2:02}"


class _Fields:
    """Leaves read one after another up to an end; where one is not whole, Short, and the place is where reading stopped."""

    def __init__(self, data: bytes, pos: int, end: int):
        self.data, self.pos, self.end, self.out = data, pos, end, []

    def take(self, n: int) -> bytes:
        if self.pos + n > self.end:
            raise Short
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def vint(self) -> int:
        """Seven bits a byte, lowest first, in ten bytes at most."""
        n = 0
        for i in range(10):
            x = self.take(1)[0]
            n |= (x & 127) << 7 * i
            if x < 128:
                return n & (1 << 64) - 1
        raise Short

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def add(self, label: str | Callable[[int], str], width: int | None = None) -> int:
        """A leaf of a number of this many bytes, or of one that tells its own length."""
        at = self.pos
        n = self.vint() if width is None else self.number(width)
        self.out.append(Node(label(n) if callable(label) else label.format(n), at, self.pos))
        return n

    def raw(self, label: str, n: int, how: Callable[[bytes], str] = bytes.hex) -> str:
        at = self.pos
        text = how(self.take(n))
        self.out.append(Node(f"{label}: {text}", at, self.pos))
        return text

    def rest(self, label: str, end: int) -> None:
        if self.pos < end:
            self.out.append(Node(label, self.pos, end))


def _checked(name: str, stored: int, data: bytes | None, width: int) -> str:
    """A checksum beside that of the data; None: they are not whole."""
    found = None if data is None else zlib.crc32(data) & (1 << 4 * width) - 1
    state = "header truncated" if found is None else "OK" if found == stored else f"mismatch, computed 0x{found:0{width}X}"
    return f"{name}: 0x{stored:0{width}X} ({state})"


def _walk(v: View, at: int, one: Callable[[View, int], tuple[Node, str] | None], unit: str, locked: str) -> list[Node]:
    """Headers up to the end of the archive, encryption, or what is none."""
    out: list[Node] = []
    while at < v.size:
        if len(out) >= SHOWN:
            return [*out, Node(f"Remaining data ({SHOWN}-{unit} limit reached)", at, v.size)]
        found = one(v, at)
        if found is None:
            return [*out, Node("Unparsed data", at, v.size)]
        out.append(found[0])
        at = found[0].end
        if found[1]:
            label = locked if found[1] == "locked" else "Data after end of archive"
            return out + [Node(label, at, v.size)] * (at < v.size)
    return out


def _with_data(v: View, at: int, end: int, label: str, fields: list[Node], size: int, held: str) -> Node:
    """A header, and the data of this size behind it."""
    kids, stop = [Node("Header", at, min(end, v.size), fields, True)], min(end + size, v.size)
    kids += [Node(held, end, stop)] * (end < stop)
    return Node(label, at, stop if end <= v.size else v.size, kids)


def _old(v: View, at: int) -> tuple[Node, str] | None:
    if at + 7 > v.size or v.number(at + 5, 2, "little") < 7:
        return None
    stored, kind, flags, size = (v.number(at + p, n, "little") for p, n in ((0, 2), (2, 1), (3, 2), (5, 2)))
    end = at + size
    f = _Fields(v.data, at + 7, min(end, v.size))
    whole = v.data[at + 2 : end] if end <= v.size else None
    named = OLD_FLAGS.get(kind, ANY_FLAGS)
    heads = [(_checked("Header CRC", stored, whole, 4), 0, 2), (f"Header type: 0x{kind:02X} ({OLD_TYPES.get(kind, 'unknown')})", 2, 3)]
    heads += [(f"Header flags: {_flags(flags, named, 4)}", 3, 5), (f"Header size: {size}", 5, 7)]
    f.out += [Node(x, at + a, at + b) for x, a, b in heads]
    label, held, data, ends = OLD_LABELS.get(kind, f"Unknown block (0x{kind:02X})"), "Additional data", 0, ""
    try:
        if kind in (0x74, 0x7A):
            held = "Packed data" if kind == 0x74 else "Service data"
            label, data = _old_file(f, kind, flags, at, label)
        elif kind == 0x73:
            ends = "locked" if flags & LOCKED else ""
            f.add("HighPosAV: {}", 2)
            f.add("PosAV: {}", 4)
        else:
            ends = "end" if kind == 0x7B else ""
            data = _maybe(f, "ADD_SIZE: {}", 4) if flags & LONG else 0
            if kind == 0x7B and flags & 2:
                _maybe(f, "Archive data CRC32: 0x{:08X}", 4)
            if kind == 0x7B and flags & 8:
                _maybe(f, "Volume number: {}", 2)
    except Short:
        pass
    f.rest("Header data", f.end)
    return _with_data(v, at, end, label, f.out, data, held), ends


def _maybe(f: _Fields, label: str, width: int) -> int:
    try:
        return f.add(label, width)
    except Short:
        return 0


def _old_file(f: _Fields, kind: int, flags: int, at: int, label: str) -> tuple[str, int]:
    """(label, bytes of packed data). Fields count as read in groups: where one of a group is missing, all of it is shown
    again as the header's rest."""
    known, data = f.pos, 0
    try:
        data = f.add("Packed size: {}", 4)
        f.add("Unpacked size: {}", 4)
        f.add(lambda n: f"Host OS: {n} ({_of(OLD_SYSTEMS, n)})", 1)
        f.add("File CRC32: 0x{:08X}", 4)
        f.add(lambda n: f"Modified time: {_dos_time(n)}", 4)
        f.add(lambda n: f"Unpack version: {n} ({n // 10}.{n % 10})", 1)
        f.add(lambda n: f"Method: 0x{n:02X} ({_of(METHODS, n - 0x30)})", 1)
        length = f.add("Name size: {}", 2)
        f.add("Attributes: 0x{:08X}", 4)
        place = "directory" if flags & DIRECTORY == DIRECTORY else f"{64 << (flags >> 5 & 7)} KiB"
        f.out.append(Node(f"Dictionary: {place}", at + 3, at + 5))
        known = f.pos
        if flags & LARGE:
            data |= f.add("High packed size: {}", 4) << 32
            f.add("High unpacked size: {}", 4)
            known = f.pos
        first = f.pos
        name, *wide = f.take(length).split(b"\0", 1) if flags & UNICODE else [f.take(length)]
        text = _name(name)
        f.out.append(Node(f"File name: {text}{' (plus Unicode encoding)' if wide else ''}", first, f.pos))
        known = f.pos
        label = f"{'Service' if kind == 0x7A else 'Directory' if flags & DIRECTORY == DIRECTORY else 'File'}: {text}"
        if flags & SALT:
            f.raw("Salt", 8)
            known = f.pos
        if flags & TIMES and f.pos < f.end:
            f.rest("Extended time", f.end)
            known = f.pos = f.end
    except Short:
        f.pos = known
    return label, data


def _new(v: View, at: int) -> tuple[Node, str] | None:
    f = _Fields(v.data, at + 4, v.size)
    try:
        size = f.vint()
    except Short:
        return None
    if not 0 < size <= LARGEST_HEADER:
        return None
    end = f.pos + size
    whole = v.data[at + 4 : end] if end <= v.size else None
    f.out = [Node(_checked("Header CRC32", v.number(at, 4, "little"), whole, 8), at, at + 4), Node(f"Header size: {size}", at + 4, f.pos)]
    f.end = min(end, v.size)
    label, kind, extra, data, known = "Header", 0, 0, 0, False
    try:
        kind = f.add(lambda n: f"Header type: {n} ({TYPES.get(n, 'unknown')})")
        label = LABELS.get(kind, f"Unknown header (type {kind})")
        flags = f.add(lambda n: f"Header flags: {_flags(n, HEADER_FLAGS, 4)}")
        extra = f.add("Extra area size: {}") if flags & 1 else 0
        data = f.add("Data size: {}") if flags & 2 else 0
        known = True
    except Short:
        pass
    tail = end - extra if 0 < extra <= end - f.pos else end
    if known:
        f.end = min(tail, v.size)
        try:
            if kind in READERS:
                READERS[kind](f)
            elif kind in (2, 3):
                label = _file(f)
        except Short:
            pass
        label = f"Service: {label}" if kind == 3 else label
    f.rest("Unparsed header bytes" if known and kind in TYPES else "Header data", min(tail, end, v.size))
    if tail < min(end, v.size):
        stop = min(end, v.size)
        f.out.append(Node(f"Extra area ({extra} bytes)", tail, stop, _extras(v.data, tail, stop, kind), True))
    node = _with_data(v, at, end, label, f.out, data, {2: "Packed data", 3: "Service data"}.get(kind, "Data area"))
    node.open = kind == 4
    return node, {4: "locked", 5: "end"}.get(kind, "") if known else ""


def _main(f: _Fields) -> None:
    if f.add(lambda n: f"Archive flags: {_flags(n, ARCHIVE_FLAGS)}") & 2:
        f.add("Volume number: {}")


def _locked(f: _Fields) -> None:
    f.add(lambda n: f"Encryption version: {n} ({'unknown' if n else 'AES-256'})")
    _key(f, {1: "password check"}, False)


def _key(f: _Fields, names: dict[int, str], vector: bool) -> None:
    flags = f.add(lambda n: f"Encryption flags: {_flags(n, names)}")
    f.add("KDF count: {0} (2^{0} iterations)", 1)
    f.raw("Salt", 16)
    if vector:
        f.raw("IV", 16)
    if flags & 1:
        f.raw("Check value", 12)


def _finish(f: _Fields) -> None:
    f.add(lambda n: f"End of archive flags: {_flags(n, {1: 'not last volume'})}")


READERS = {1: _main, 4: _locked, 5: _finish}


def _file(f: _Fields) -> str:
    """What a file's or service's header names."""
    flags = f.add(lambda n: f"File flags: {_flags(n, ENTRY_FLAGS)}")
    f.add("Unpacked size: {}" + " (unknown)" * bool(flags & 8))
    f.add("Attributes: 0x{:X}")
    if flags & 2:
        f.add(lambda n: f"Modified time: {moment(n)}", 4)
    if flags & 4:
        f.add("Data CRC32: 0x{:08X}", 4)
    f.add("Compression info: 0x{:X}")
    info = f.out[-1]
    n = int(info.label[20:], 16)
    size = 128 * 1024 << (n >> 10 & 31)
    size += size // 32 * (n >> 15 & 31) if n & 63 else 0
    told = [f"Algorithm version: {n & 63} ({_of(VERSIONS, n & 63)})", f"Solid: {'yes' if n & 64 else 'no'}", f"Method: {n >> 7 & 7} ({_of(METHODS, n >> 7 & 7)})"]
    told.append(f"Dictionary size: {_sized(size)}" + " (unused for directories)" * (flags & 1))
    info.kids = [Node(x, info.start, info.end) for x in told]
    f.add(lambda n: f"Host OS: {n} ({_of(SYSTEMS, n)})")
    name = f.raw("Name", f.add("Name length: {}"), _name)
    return f"{'Directory' if flags & 1 else 'File'}: {name}"


def _extras(data: bytes, at: int, end: int, kind: int) -> list[Node]:
    out: list[Node] = []
    while at < end:
        if len(out) >= RECORDS_SHOWN:
            return [*out, Node("Remaining records (limit reached)", at, end)]
        f = _Fields(data, at, end)
        try:
            size = f.add("Record size: {}")
        except Short:
            size = 0
        stop = f.pos + size
        if not size or stop > end:
            return [*out, Node("Malformed extra record", at, end)]
        f.end, names, name = stop, MAIN_RECORDS if kind == 1 else RECORDS, "Unknown"
        try:
            what = f.add(lambda n, names=names: f"Record type: {n} ({names.get(n, 'Unknown')})")
            name = names.get(what, "Unknown")
            if name in EXTRAS:
                EXTRAS[name](f)
        except Short:
            pass
        f.rest("Record data", stop)
        out.append(Node(f"Extra record: {name}", at, stop, f.out))
        at = stop
    return out


def _locator(f: _Fields) -> None:
    flags = f.add(lambda n: f"Locator flags: {_flags(n, {1: 'quick open', 2: 'recovery record'})}")
    for bit, name in ((1, "Quick open"), (2, "Recovery record")):
        if flags & bit:
            f.add(name + " offset: {}")


def _encrypted(f: _Fields) -> None:
    f.add("Encryption version: {}")
    _key(f, {1: "password check", 2: "tweaked checksums"}, True)


def _hash(f: _Fields) -> None:
    if not f.add(lambda n: f"Hash type: {n} ({'unknown' if n else 'BLAKE2sp'})"):
        f.raw("Hash", 32)


def _times(f: _Fields) -> None:
    flags = f.add(lambda n: f"Time flags: {_flags(n, TIME_FLAGS)}")
    chosen = [name for bit, name in STAMPS.items() if flags & bit]
    for name in chosen:
        if flags & 1:
            f.add(lambda n, name=name: f"{name} time: {moment(n)}", 4)
        else:
            f.add(lambda n, name=name: f"{name} time: {moment(n // 10_000_000 - WINDOWS_EPOCH)}", 8)
    for name in chosen if flags & 17 == 17 else []:
        f.add(name + " time nanoseconds: {}", 4)


def _version(f: _Fields) -> None:
    f.add("Version flags: 0x{:X}")
    f.add("Version number: {}")


def _link(f: _Fields) -> None:
    f.add(lambda n: f"Redirection type: {n} ({LINKS.get(n, 'unknown')})")
    f.add(lambda n: f"Redirection flags: {_flags(n, {1: 'target is directory'})}")
    f.raw("Target name", f.add("Target name length: {}"), _name)


def _owner(f: _Fields) -> None:
    flags = f.add(lambda n: f"Owner flags: {_flags(n, OWNER_FLAGS)}")
    for bit, name in ((1, "User name"), (2, "Group name")):
        if flags & bit:
            f.raw(name, f.add(name + " length: {}"), _name)
    for bit, name in ((4, "User ID"), (8, "Group ID")):
        if flags & bit:
            f.add(name + ": {}")


EXTRAS = {"Locator": _locator, "Encryption": _encrypted, "File hash": _hash, "File time": _times, "File version": _version, "Redirection": _link, "Unix owner": _owner}


def rar(v: View) -> list[Node]:
    if v.data.startswith(NEW_SIGN):
        return [Node("Signature: RAR 5.0", 0, 8), *_walk(v, 8, _new, "header", "Encrypted headers and data")]
    if not v.data.startswith(OLD_SIGN):
        return []
    parts = [("Header CRC: 0x6152 (fixed)", 0, 2), ("Header type: 0x72 (MARK)", 2, 3), ("Header flags: 0x1A21 (fixed)", 3, 5), ("Header size: 7", 5, 7)]
    return [Node("Signature: RAR 4.x", 0, 7, [Node(*x) for x in parts], True), *_walk(v, 7, _old, "block", "Encrypted headers")]


WALKERS = {"RAR": rar}
