"""Walker of Matroska and WebM: elements of EBML, whose sizes may be unknown."""

from __future__ import annotations

import datetime
import struct

from bytestrata.formats.tree import Node, View, decimal

# Fixed values of the format: id in hex, name, kind (m master, u unsigned, i signed, f float, s text, d date, b binary).
ELEMENTS = {
    int(x, 16): (name, kind)
    for x, name, kind in (
        line.split()
        for line in """
1A45DFA3 EBML m
4286 EBMLVersion u
42F7 EBMLReadVersion u
42F2 EBMLMaxIDLength u
42F3 EBMLMaxSizeLength u
4282 DocType s
4287 DocTypeVersion u
4285 DocTypeReadVersion u
4281 DocTypeExtension m
4283 DocTypeExtensionName s
4284 DocTypeExtensionVersion u
EC Void b
BF CRC-32 b
18538067 Segment m
114D9B74 SeekHead m
4DBB Seek m
53AB SeekID b
53AC SeekPosition u
1549A966 Info m
73A4 SegmentUUID b
7384 SegmentFilename s
3CB923 PrevUUID b
3C83AB PrevFilename s
3EB923 NextUUID b
3E83BB NextFilename s
4444 SegmentFamily b
6924 ChapterTranslate m
2AD7B1 TimestampScale u
4489 Duration f
4461 DateUTC d
7BA9 Title s
4D80 MuxingApp s
5741 WritingApp s
1F43B675 Cluster m
E7 Timestamp u
A7 Position u
AB PrevSize u
A3 SimpleBlock b
A0 BlockGroup m
A1 Block b
75A1 BlockAdditions m
A6 BlockMore m
EE BlockAddID u
A5 BlockAdditional b
9B BlockDuration u
FA ReferencePriority u
FB ReferenceBlock i
A4 CodecState b
75A2 DiscardPadding i
1654AE6B Tracks m
AE TrackEntry m
D7 TrackNumber u
73C5 TrackUID u
83 TrackType u
B9 FlagEnabled u
88 FlagDefault u
55AA FlagForced u
9C FlagLacing u
23E383 DefaultDuration u
234E7A DefaultDecodedFieldDuration u
55EE MaxBlockAdditionID u
536E Name s
22B59C Language s
22B59D LanguageBCP47 s
86 CodecID s
63A2 CodecPrivate b
258688 CodecName s
56AA CodecDelay u
56BB SeekPreRoll u
E0 Video m
9A FlagInterlaced u
53B8 StereoMode u
B0 PixelWidth u
BA PixelHeight u
54AA PixelCropBottom u
54BB PixelCropTop u
54CC PixelCropLeft u
54DD PixelCropRight u
54B0 DisplayWidth u
54BA DisplayHeight u
54B2 DisplayUnit u
55B0 Colour m
55B1 MatrixCoefficients u
55B2 BitsPerChannel u
55B9 Range u
55BA TransferCharacteristics u
55BB Primaries u
E1 Audio m
B5 SamplingFrequency f
78B5 OutputSamplingFrequency f
9F Channels u
6264 BitDepth u
6D80 ContentEncodings m
6240 ContentEncoding m
5031 ContentEncodingOrder u
5032 ContentEncodingScope u
5033 ContentEncodingType u
5034 ContentCompression m
4254 ContentCompAlgo u
4255 ContentCompSettings b
5035 ContentEncryption m
1C53BB6B Cues m
BB CuePoint m
B3 CueTime u
B7 CueTrackPositions m
F7 CueTrack u
F1 CueClusterPosition u
F0 CueRelativePosition u
B2 CueDuration u
5378 CueBlockNumber u
1941A469 Attachments m
61A7 AttachedFile m
467E FileDescription s
466E FileName s
4660 FileMediaType s
465C FileData b
46AE FileUID u
1043A770 Chapters m
45B9 EditionEntry m
45BC EditionUID u
45BD EditionFlagHidden u
45DB EditionFlagDefault u
45DD EditionFlagOrdered u
B6 ChapterAtom m
73C4 ChapterUID u
5654 ChapterStringUID s
91 ChapterTimeStart u
92 ChapterTimeEnd u
98 ChapterFlagHidden u
4598 ChapterFlagEnabled u
80 ChapterDisplay m
85 ChapString s
437C ChapLanguage s
437D ChapLanguageBCP47 s
437E ChapCountry s
1254C367 Tags m
7373 Tag m
63C0 Targets m
68CA TargetTypeValue u
63CA TargetType s
63C5 TagTrackUID u
63C9 TagEditionUID u
63C4 TagChapterUID u
63C6 TagAttachmentUID u
67C8 SimpleTag m
45A3 TagName s
447A TagLanguage s
447B TagLanguageBCP47 s
4484 TagDefault u
4487 TagString s
4485 TagBinary b
""".split("\n")
        if line
    )
}
HEADER, SEGMENT, TRACK_TYPE = 0x1A45DFA3, 0x18538067, 0x83
TOP = {0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367}
OPENED = {0x1549A966, 0x1654AE6B}
FRAMES = {0xA3: True, 0xA1: False}
TRACK_TYPES = {1: "video", 2: "audio", 3: "complex", 16: "logo", 17: "subtitle", 18: "buttons", 32: "control", 33: "metadata"}
LACING = ["none", "Xiph", "fixed-size", "EBML"]
EPOCH = datetime.datetime(2001, 1, 1)
DEPTH, SIBLINGS, SHOWN, CHARS = 16, 256, 4096, 64


def varint(data: bytes, at: int) -> tuple[int, int] | None:
    """(value with its length marker, bytes) of a number that tells its own length."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    return (int.from_bytes(data[at : at + n], "big"), n) if at + n <= len(data) else None


def element(data: bytes, at: int) -> tuple[int, int, int | None, int] | None:
    """(id, its width, size or None if unknown, start of the data)."""
    who = varint(data, at)
    size = varint(data, at + who[1]) if who and who[1] <= 4 else None
    if size is None:
        return None
    ones = (1 << 7 * size[1]) - 1
    return who[0], who[1], None if size[0] & ones == ones else size[0] & ones, at + who[1] + size[1]


def ends(parent: int | None, who: int) -> bool:
    """Whether an element can't lie in a parent of unknown size."""
    return parent is not None and (who in (HEADER, SEGMENT) or (parent != SEGMENT and who in TOP))


def string(raw: bytes) -> str:
    text = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    return text if len(text) <= CHARS else text[:CHARS] + "…"


def _date(ns: int) -> str:
    return (EPOCH + datetime.timedelta(seconds=ns // 10**9)).strftime("%Y-%m-%d %H:%M:%S UTC")


def value(who: int, kind: str, raw: bytes) -> str | None:
    """What a value shows; None if no value can have this many bytes."""
    if kind == "s":
        return string(raw)
    if kind == "f":
        return decimal(struct.unpack({0: "", 4: ">f", 8: ">d"}[len(raw)], raw)[0] if raw else 0.0) if len(raw) in (0, 4, 8) else None
    if len(raw) > 8:
        return None
    n = int.from_bytes(raw, "big", signed=kind in "id")
    if kind == "d":
        return _date(n)
    return f"{n} ({TRACK_TYPES[n]})" if who == TRACK_TYPE and n in TRACK_TYPES else str(n)


def _frames(data: bytes, at: int, end: int, simple: bool) -> tuple[list[Node], str] | None:
    track = varint(data, at)
    if track is None or at + track[1] + 3 > end:
        return None
    number, head = track[0] & (1 << 7 * track[1]) - 1, at + track[1]
    time, flags = struct.unpack_from(">hB", data, head)
    key = simple and flags & 0x80
    told = ["keyframe"] * bool(key) + [f"lacing {LACING[flags >> 1 & 3]}"] + ["invisible"] * bool(flags & 8) + ["discardable"] * bool(simple and flags & 1)
    kids = [Node(f"Track number: {number}", at, head), Node(f"Timecode: {time}", head, head + 2), Node(f"Flags: 0x{flags:02X} ({', '.join(told)})", head + 2, head + 3)]
    return [*kids, Node(f"Frame data ({end - head - 3} bytes)", head + 3, end)], f"track {number}, timecode {time}" + ", keyframe" * bool(key)


class _Walk:
    """Elements of one content. They nest DEPTH deep at most, so that functions may call themselves."""

    def __init__(self, data: bytes):
        self.data, self.left = data, SHOWN

    def siblings(self, at: int, end: int, parent: int | None, depth: int) -> tuple[list[Node], int]:
        """(elements, where they stop); parent: the id of one of unknown size."""
        out: list[Node] = []
        while at < end:
            head = element(self.data, at)
            if head is None:
                return [*out, Node("Unparseable data", at, end)], end
            if ends(parent, head[0]):
                break
            if len(out) >= SIBLINGS or not self.left:
                n, stop = self.hidden(at, end, parent, depth)
                return [*out, Node(f"({n} more not shown)", at, stop)], stop
            self.left -= 1
            out.append(self.one(at, end, head, depth))
            at = out[-1].end
        return out, min(at, end)

    def hidden(self, at: int, end: int, parent: int | None, depth: int) -> tuple[int, int]:
        """(number, end) of the elements that are not shown."""
        n = 0
        while at < end:
            head = element(self.data, at)
            if head is None:
                return n, end
            who, _, size, body = head
            if ends(parent, who):
                break
            n, body = n + 1, min(body, end)
            if size is not None:
                at = min(body + size, end)
            elif ELEMENTS.get(who, ("", "b"))[1] == "m" and depth < DEPTH:
                at = self.hidden(body, end, who, depth + 1)[1]
            else:
                at = end
        return n, min(at, end)

    def one(self, at: int, limit: int, head: tuple[int, int, int | None, int], depth: int) -> Node:
        who, width, size, body = head
        body = min(body, limit)
        name, kind = ELEMENTS.get(who, ("Unknown", "b"))
        end, cut = (limit, False) if size is None else (min(body + size, limit), body + size > limit)
        kids = [Node(f"ID: 0x{who:0{2 * width}X} ({name})", at, at + width), Node(f"Size: {'unknown' if size is None else size}", at + width, body)]
        label, opened = name, False
        if kind == "m" and depth < DEPTH:
            inner, stop = self.siblings(body, end, who if size is None else None, depth + 1)
            end = stop if size is None else end
            kids += inner
            opened = depth == 0 or who in OPENED
            doc = next((k.label for k in inner if k.label.startswith("DocType: ")), None) if who == HEADER else None
            label = f"EBML header ({doc})" if doc else name
        elif kind == "m":
            kids.append(Node("Data (nesting too deep to parse)", body, end))
        elif kind == "b":
            found = _frames(self.data, body, end, FRAMES[who]) if who in FRAMES else None
            kids += found[0] if found else [Node(f"Data ({end - body} bytes)", body, end)]
            named = name if who in ELEMENTS else f"Unknown element 0x{who:0{2 * width}X}"
            label = f"{named}: {found[1]} ({end - body} bytes)" if found else f"{named} ({end - body} bytes)"
        else:
            shown = "(truncated)" if cut else value(who, kind, self.data[body:end])
            told = f"(invalid {end - body}-byte value)" if shown is None else shown
            label = f"{name}: {told}"
            kids.append(Node(f"Value: {told}", body, end))
        return Node(label + " (truncated)" * cut, at, end, kids, opened)


def matroska(v: View) -> list[Node]:
    return _Walk(v.data).siblings(0, v.size, None, 0)[0]


WALKERS = {"Matroska": matroska}
