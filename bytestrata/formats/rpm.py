"""Walker of RPM: a lead, two headers of index and store, and what the payload is said to be."""

from __future__ import annotations

import struct
import unicodedata

from bytestrata.formats.tree import WHITE, Node, View


def _names(text: str) -> dict[int, str]:
    """Names by number; a line is the first number and the names from there on."""
    out: dict[int, str] = {}
    for line in text.split("\n"):
        first, *names = line.split() or ["0"]
        out |= {int(first) + i: name for i, name in enumerate(names) if name != "-"}
    return out


# Fixed values of the format.
LEAD, INTRO, ENTRY = 96, 16, 16
SIGN = b"\x8e\xad\xe8"
SHOWN, ITEMS, HEX_BYTES, CHARS = 256, 3, 32, 80
KINDS = {0: "binary", 1: "source"}
TYPES = ["NULL", "CHAR", "INT8", "INT16", "INT32", "INT64", "STRING", "BIN", "STRING_ARRAY", "I18NSTRING"]
WIDTHS = {2: "B", 3: "H", 4: "I", 5: "Q"}
COMPRESSED = {
    b"\x1f\x8b": "gzip", b"\xfd7zXZ\0": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"BZh": "bzip2", b"\x5d\0\0": "lzma", b"070701": "uncompressed", b"070702": "uncompressed",
}
FORMAT_TAG, COMPRESSOR_TAG = 1124, 1125
#: Names of tags, "-" for a number without one.
REGIONS = """
61 HEADERIMAGE HEADERSIGNATURES HEADERIMMUTABLE HEADERREGIONS
100 HEADERI18NTABLE
"""
SIGNATURE_TAGS = _names(
    REGIONS
    + """
264 BADSHA1_1 BADSHA1_2 PUBKEYS DSA RSA SHA1 LONGSIZE LONGARCHIVESIZE - SHA256 FILESIGNATURES FILESIGNATURELENGTH VERITYSIGNATURES VERITYSIGNATUREALGO OPENPGP SHA3_256
999 RESERVED SIZE LEMD5_1 PGP LEMD5_2 MD5 GPG PGP5 PAYLOADSIZE RESERVEDSPACE
"""
)
HEADER_TAGS = _names(
    REGIONS
    + """
1000 NAME VERSION RELEASE EPOCH SUMMARY DESCRIPTION BUILDTIME BUILDHOST INSTALLTIME SIZE DISTRIBUTION VENDOR GIF XPM LICENSE PACKAGER GROUP CHANGELOG SOURCE PATCH
1020 URL OS ARCH PREIN POSTIN PREUN POSTUN OLDFILENAMES FILESIZES FILESTATES FILEMODES FILEUIDS FILEGIDS FILERDEVS FILEMTIMES FILEDIGESTS FILELINKTOS FILEFLAGS ROOT
1039 FILEUSERNAME FILEGROUPNAME - - ICON SOURCERPM FILEVERIFYFLAGS ARCHIVESIZE PROVIDENAME REQUIREFLAGS REQUIRENAME REQUIREVERSION NOSOURCE NOPATCH CONFLICTFLAGS
1054 CONFLICTNAME CONFLICTVERSION - - - EXCLUDEARCH EXCLUDEOS EXCLUSIVEARCH EXCLUSIVEOS - RPMVERSION TRIGGERSCRIPTS TRIGGERNAME TRIGGERVERSION TRIGGERFLAGS TRIGGERINDEX
1079 VERIFYSCRIPT CHANGELOGTIME CHANGELOGNAME CHANGELOGTEXT - - PREINPROG POSTINPROG PREUNPROG POSTUNPROG BUILDARCHS OBSOLETENAME VERIFYSCRIPTPROG TRIGGERSCRIPTPROG
1094 COOKIE FILEDEVICES FILEINODES FILELANGS PREFIXES INSTPREFIXES
1106 SOURCEPACKAGE - - - - - PROVIDEFLAGS PROVIDEVERSION OBSOLETEFLAGS OBSOLETEVERSION DIRINDEXES BASENAMES DIRNAMES
1122 OPTFLAGS DISTURL PAYLOADFORMAT PAYLOADCOMPRESSOR PAYLOADFLAGS INSTALLCOLOR INSTALLTID REMOVETID - RHNPLATFORM PLATFORM
1140 FILECOLORS FILECLASS CLASSDICT FILEDEPENDSX FILEDEPENDSN DEPENDSDICT SOURCEPKGID FILECONTEXTS - - - PRETRANS POSTTRANS PRETRANSPROG POSTTRANSPROG DISTTAG
5008 LONGFILESIZES LONGSIZE FILECAPS FILEDIGESTALGO BUGURL
5017 HEADERCOLOR - - PREINFLAGS POSTINFLAGS PREUNFLAGS POSTUNFLAGS PRETRANSFLAGS POSTTRANSFLAGS
5034 VCS ORDERNAME ORDERVERSION ORDERFLAGS
5046 RECOMMENDNAME RECOMMENDVERSION RECOMMENDFLAGS SUGGESTNAME SUGGESTVERSION SUGGESTFLAGS SUPPLEMENTNAME SUPPLEMENTVERSION SUPPLEMENTFLAGS ENHANCENAME ENHANCEVERSION ENHANCEFLAGS
5062 ENCODING - - - FILETRIGGERSCRIPTS FILETRIGGERSCRIPTPROG FILETRIGGERSCRIPTFLAGS FILETRIGGERNAME FILETRIGGERINDEX FILETRIGGERVERSION FILETRIGGERFLAGS
5090 FILESIGNATURES FILESIGNATURELENGTH PAYLOADDIGEST PAYLOADDIGESTALGO - - MODULARITYLABEL PAYLOADDIGESTALT ARCHSUFFIX SPEC TRANSLATIONURL UPSTREAMRELEASES
5109 SYSUSERS - - PAYLOADSIZE PAYLOADSIZEALT RPMFORMAT - - - PACKAGEDIGESTS PACKAGEDIGESTALGOS SOURCENEVR
"""
)


def _line(text: str) -> str:
    text = "".join(" " if unicodedata.category(c) == "Cc" else c for c in text).strip(WHITE)
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _strings(store: bytes, at: int, count: int) -> tuple[list[str], int]:
    """(texts, end) of up to count texts that NULs end."""
    out: list[str] = []
    while len(out) < count and at < len(store):
        end = store.find(b"\0", at)
        end = len(store) if end < 0 else end
        out.append(store[at:end].decode("utf-8", "replace"))
        at = end + 1
    return out, min(at, len(store))


class _Header:
    """A header: the numbers of its index, which may be cut, and its store."""

    def __init__(self, v: View, at: int, names: dict[int, str]):
        self.v, self.at, self.names = v, at, names
        self.declared, self.size = struct.unpack_from(">II", v.data, at + 8)
        self.index = at + INTRO
        self.base = self.index + ENTRY * self.declared
        self.end = self.base + self.size
        self.store = v.data[self.base : self.end]
        whole = min(self.declared, (v.size - self.index) // ENTRY)
        self.entries = [struct.unpack_from(">IIII", v.data, self.index + ENTRY * i) for i in range(whole)]

    def name(self, tag: int) -> str:
        return self.names.get(tag, f"Tag {tag}")

    def text(self, tag: int) -> str | None:
        found = next((e for e in self.entries if e[0] == tag), None)
        texts = _strings(self.store, found[2], 1)[0] if found and found[1] in (6, 8, 9) else []
        return texts[0] if texts else None

    def value(self, kind: int, at: int, count: int) -> str | None:
        store = self.store
        if at >= len(store):
            return None
        if kind == 1:
            return _line(store[at : at + count].decode("utf-8", "replace"))
        if kind == 7:
            return store[at : at + count].hex() if count <= HEX_BYTES and at + count <= len(store) else f"{count} bytes"
        if kind in WIDTHS:
            width = struct.calcsize(WIDTHS[kind])
            whole = min(count, ITEMS, (len(store) - at) // width)
            items = [str(x) for x in struct.unpack_from(f">{whole}{WIDTHS[kind]}", store, at)]
        elif kind in (6, 8, 9):
            items = _strings(store, at, 1 if kind == 6 else min(count, ITEMS))[0]
            if items and (kind != 8 or count == 1):
                return _line(items[0])
            items = [f'"{x}"' for x in items]
        else:
            return None
        if not items or (count == 1 and len(items) == 1):
            return _line(items[0]) if items else None
        return _line(f"[{', '.join(items)}{', …' * (count > len(items))}] ({count} items)")

    def extent(self, kind: int, at: int, count: int) -> tuple[int, int] | None:
        """Place of a value in the store; None if it has none."""
        if at >= len(self.store):
            return None
        if kind in (1, 7):
            end = at + count
        elif kind in WIDTHS:
            end = at + count * struct.calcsize(WIDTHS[kind])
        elif kind in (6, 8, 9):
            end = _strings(self.store, at, 1 if kind == 6 else count)[1]
        else:
            end = at
        return (at, min(end, len(self.store))) if end > at and (kind not in (8, 9) or count) else None

    def entry(self, i: int) -> Node:
        (tag, kind, place, count), at = self.entries[i], self.index + ENTRY * i
        value = self.value(kind, place, count)
        known = TYPES[kind] if kind < len(TYPES) else "unknown"
        lines = [f"Tag: {tag} ({self.name(tag)})", f"Type: {known} ({kind})", f"Offset: {place}", f"Count: {count}"]
        label = self.name(tag) if value is None else f"{self.name(tag)}: {value}"
        return Node(label, at, at + ENTRY, [Node(x, at + 4 * k, at + 4 * k + 4) for k, x in enumerate(lines)])

    def node(self, title: str) -> Node:
        v, at, shown = self.v, self.at, min(len(self.entries), SHOWN)
        kids = [Node("Magic: 8E AD E8", at, at + 3), Node(f"Header version: {v.data[at + 3]}", at + 3, at + 4), Node("Reserved", at + 4, at + 8)]
        kids += [Node(f"Index entry count: {self.declared}", at + 8, at + 12), Node(f"Data store size: {self.size}", at + 12, at + 16)]
        if shown:
            listed, end, last = [self.entry(i) for i in range(shown)], min(self.base, v.size), self.index + ENTRY * shown
            listed += [Node(f"… {self.declared - shown} more entries", last, end)] * (end > last)
            kids.append(Node(f"Index ({self.declared} entries)", self.index, end, listed, True))
        if self.store:
            placed = [(self.extent(*e[1:]), self.name(e[0])) for e in self.entries[:shown]]
            values = sorted(((*place, name) for place, name in placed if place), key=lambda x: x[:2])
            held = [Node(name, self.base + a, self.base + b) for a, b, name in values]
            kids.append(Node(f"Data store ({self.size} bytes)", self.base, self.base + len(self.store), held))
        return Node(title, at, min(self.end, v.size), kids, True)


def _lead(v: View) -> Node:
    major, minor, kind, arch = struct.unpack_from(">BBHH", v.data, 4)
    system, signed = struct.unpack_from(">HH", v.data, 76)
    name = v.data[10:76].split(b"\0", 1)[0].decode("utf-8", "replace")
    parts = [
        ("Magic: ED AB EE DB", 0, 4), (f"Version: {major}.{minor}", 4, 6), (f"Type: {KINDS.get(kind, 'unknown')} ({kind})", 6, 8), (f"Arch number: {arch}", 8, 10),
        (f"Name: {_line(name)}", 10, 76), (f"OS number: {'Linux' if system == 1 else 'unknown'} ({system})", 76, 78),
        (f"Signature type: {'header-style' if signed == 5 else 'unknown'} ({signed})", 78, 80), ("Reserved", 80, LEAD),
    ]
    return Node("Lead", 0, LEAD, [Node(*x) for x in parts], True)


def rpm(v: View) -> list[Node]:
    if v.size < LEAD:
        return []
    out, at = [_lead(v)], LEAD
    for title, names in (("Signature header", SIGNATURE_TAGS), ("Header", HEADER_TAGS)):
        if v.data[at : at + 3] != SIGN or at + INTRO > v.size:
            return out + [Node("Unparsed data", at, v.size)] * (at < v.size)
        h = _Header(v, at, names)
        out.append(h.node(title))
        at = h.end
        pad = -at % 8 if title != "Header" else 0
        if pad and at < v.size:
            out.append(Node(f"Signature padding ({pad} bytes)", at, min(at + pad, v.size)))
            at += pad
        if at >= v.size:
            return out
    sniffed = next((name for sign, name in COMPRESSED.items() if v.data.startswith(sign, at)), "unknown compression")
    stated, layout = h.text(COMPRESSOR_TAG), h.text(FORMAT_TAG)
    told = [_line(x) for x in (layout, sniffed if stated is None else stated) if x is not None]
    return [*out, Node(f"Payload ({', '.join(told)}, {v.size - at} bytes)", at, v.size)]


WALKERS = {"RPM": rpm}
