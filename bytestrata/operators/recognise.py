"""The ladder of formats as one Column: the first rule that holds names the content. No Python runs on the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
LINEAR_CPUS = [0x01, 0x02, 0x03, 0x04, 0x20, 0x21, 0x40, 0x41, 0x42]
TERSE_MACHINES = [0x014C, 0x8664, 0x0200, 0x01C2, 0x01C4, 0xAA64, 0x0EBC, 0x5032, 0x5064, 0x5128, 0x6232, 0x6264]
#: (first magic, last magic, length of the header) of compiled Python files.
PYTHON_MAGICS = [
    (62011, 62021, 8), (62041, 62061, 8), (62071, 62131, 8), (62151, 62161, 8), (62171, 62211, 8), (3000, 3131, 8), (3141, 3151, 8), (3160, 3180, 8),
    (3190, 3230, 12), (3250, 3310, 12), (3320, 3351, 12), (3360, 3379, 12), (3390, 3394, 16), (3400, 3413, 16), (3420, 3425, 16), (3430, 3439, 16),
    (3450, 3495, 16), (3500, 3531, 16), (3550, 3571, 16), (3600, 3627, 16),
]
CONSOLE_MEMORY = [(0x80000000, 0x81800000), (0x90000000, 0x94000000)]
PDF_WINDOW = 1024
HUNK_STARTS = [0x3E8, 0x3E9, 0x3EA, 0x3EB]
HUNK_DEBUG = 0x3F1
NAME_LONGS, LIBRARIES, HUNKS = 64, 16, 0x10000
CARDS = [b"\xc5\xe2\xc4", b"\xe3\xe7\xe3", b"\xd9\xd3\xc4", b"\xc5\xd5\xc4", b"\xe2\xe8\xd4", b"\xe7\xe2\xc4"]
#: Thousands of bits a second of MPEG audio by (version 1 or later, layer), from index 1.
BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = [44100, 48000, 32000]
DOS_IMAGE = 0xFF00
DOS_EARLY = 32
DOS_PRINTABLE = 90


class Bytes:
    """Questions about a BINARY column; what lies beyond its end is null or unequal."""

    def __init__(self, content: Column):
        self.content, self.size = content, F.octet_length(content)

    def at(self, offset: int | Column, raw: bytes) -> Column:
        where = F.lit(offset) if isinstance(offset, int) else F.least(offset, self.size.cast("long")).cast("int")
        return F.substring(self.content, where + 1, F.lit(len(raw))) == F.lit(raw)

    def number(self, offset: int | Column, width: int, order: str) -> Column:
        where = F.lit(offset) if isinstance(offset, int) else F.least(offset, self.size.cast("long")).cast("int")
        raw = F.substring(self.content, where + 1, F.lit(width))
        h = F.hex(raw)
        if order == "little":
            h = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))))
        return F.when(F.octet_length(raw) == width, F.conv(h, 16, 10)).try_cast("decimal(20,0)" if width == 8 else "long")

    def wide(self, offset: Column, width: Column) -> Column:
        """A number of 1 to 7 or 8 bytes, most significant first, whose first bit in 64 is 0."""
        raw = F.substring(self.content, F.least(offset, self.size.cast("long")).cast("int") + 1, width.cast("int"))
        return F.when(F.octet_length(raw) == width, F.conv(F.hex(raw), 16, 10).try_cast("long"))

    def little(self, offset: int | Column, width: int) -> Column:
        return self.number(offset, width, "little")

    def big(self, offset: int | Column, width: int) -> Column:
        return self.number(offset, width, "big")


def _linear(b: Bytes, name: bytes) -> Column:
    """LE and LX, behind a DOS stub or bare; bare ones need a plausible header."""
    sign = name + b"\0\0"
    page = b.little(40, 4)
    plausible = (b.little(4, 4) == 0) & b.little(8, 2).isin(LINEAR_CPUS) & (b.little(10, 2) <= 5) & page.between(16, 0x10000) & (page.bitwiseAND(page - 1) == 0)
    stub = b.at(0, b"MZ")
    return (stub & b.at(b.little(60, 4), sign)) | (~stub & b.at(0, sign) & (b.size >= 176) & plausible)


def _mp4(b: Bytes) -> Column:
    short = b.big(0, 4)
    enough = F.when(short == 1, b.big(8, 8) >= 16).when(short == 0, True).otherwise(short >= 8)
    return b.at(4, b"ftyp") & enough


def _dol(b: Bytes) -> Column:
    """No magic: a header whose sections all lie in the file and in memory, apart from each other, with the entry in a text."""
    loads = lambda start, n: _any((start >= lo) & (start + n <= hi) for lo, hi in CONSOLE_MEMORY)
    slot = lambda i: F.struct(i.alias("slot"), b.big(i * 4, 4).alias("offset"), b.big(i * 4 + 72, 4).alias("address"), b.big(i * 4 + 144, 4).alias("size"))
    used = F.filter(F.transform(F.sequence(F.lit(0), F.lit(17)), slot), lambda s: s["size"] > 0)
    aligned = lambda s: (s["offset"] % 4 == 0) & (s["size"] % 4 == 0) & (s["address"] % 4 == 0)
    fits = F.forall(used, lambda s: (s["offset"] >= 256) & (s["offset"] + s["size"] <= b.size) & aligned(s) & loads(s["address"], s["size"]))
    spans = F.array_sort(F.transform(used, lambda s: F.struct(s["offset"].alias("lo"), (s["offset"] + s["size"]).alias("hi"))))
    apart = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("hi"), F.lit(True).alias("ok")), lambda a, s: F.struct(s["hi"].alias("hi"), (a["ok"] & (s["lo"] >= a["hi"])).alias("ok")))["ok"]
    entry = b.big(224, 4)
    enters = F.exists(used, lambda s: (s["slot"] < 7) & (entry >= s["address"]) & (entry < s["address"] + s["size"]))
    bss = (b.big(220, 4) == 0) | loads(b.big(216, 4), b.big(220, 4))
    return (b.size >= 256) & b.at(228, bytes(28)) & fits & apart & bss & enters


def _any(rules) -> Column:
    first, *rest = rules
    for r in rest:
        first = first | r
    return first


def _python(b: Bytes) -> Column:
    magic = b.little(0, 2)
    code = lambda at: b.at(at, b"c") | b.at(at, b"\xe3")
    found = {n: _any(magic.between(lo, hi) for lo, hi, m in PYTHON_MAGICS if m == n) for n in (8, 12, 16)}
    return b.at(2, b"\r\n") & ((found[8] & code(8)) | (found[12] & code(12)) | (found[16] & (b.little(4, 4) <= 3) & code(16)))


def _dos_com(b: Bytes) -> Column:
    """No magic: a small image that is no text, begins with a known instruction and calls DOS."""
    chars = F.decode(b.content, "ISO-8859-1")
    op, mode, size = b.big(0, 1), b.big(1, 1), b.size
    two, three = size >= 2, size >= 3
    calls = lambda text: text.rlike("\\xCD[\\x20\\x21]")
    same = (mode >= 0xC0) & (mode % 8 == F.floor(mode / 8) % 8)
    plain = op.isin(0x0E, 0x1E, 0xFA, 0xFC) | (op.between(0xB0, 0xB7) & two) | (op.between(0xB8, 0xBF) & three) | (op.isin(0x29, 0x2B, 0x31, 0x33) & same) | ((op == 0x8C) & (mode >= 0xC0) & (F.floor(mode / 8) % 8 < 4))
    near = F.when(mode > 127, mode - 254).otherwise(mode + 2)
    target = F.when((op == 0xE9) & three, (b.little(1, 2) + 3) % 0x10000).when((op == 0xEB) & two, F.pmod(near, F.lit(0x10000)))
    after = F.when(op == 0xE9, 3).otherwise(2)
    enters = F.when(target.isNotNull(), (target >= after) & (target < size) & calls(chars)).otherwise(plain & calls(F.left(chars, F.lit(DOS_EARLY + 1))))
    printable = F.length(F.regexp_replace(chars, "[^\\x20-\\x7E\\t\\n\\r]", ""))
    able = size.between(2, DOS_IMAGE) & ~b.at(0, b"MZ") & ~b.at(0, b"ZM")
    return F.when(able, (printable * 100 < size * DOS_PRINTABLE) & enters).otherwise(False)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _varint(b: Bytes, at: Column) -> Column:
    """struct(raw, n) of a number that tells its own length; raw is null where it is not whole or longer than 8 bytes."""

    def read(first: Column) -> Column:
        n = F.lit(9) - F.length(F.bin(first))
        return F.struct(b.wide(at, F.when(first > 0, n)).alias("raw"), F.when(first > 0, n).alias("n"))

    return _let(b.number(at, 1, "big"), read)


def _ebml(b: Bytes, at: Column) -> Column:
    """struct(id, size, body) of an element; null where the head is not whole or the size is unknown."""

    def sized(who: Column) -> Column:
        def both(size: Column) -> Column:
            ones = F.call_function("shiftleft", F.lit(1).cast("long"), (size["n"] * 7).cast("int"))
            n = size["raw"] - ones
            return F.when((who["n"] <= 4) & (n < ones - 1), F.struct(who["raw"].alias("id"), n.alias("size"), (at + who["n"] + size["n"]).alias("body")))

        return _let(_varint(b, at + who["n"]), both)

    return _let(_varint(b, at), sized)


def _matroska(b: Bytes) -> Column:
    """An EBML header whose DocType is one of two; its elements are stepped through, each of two bytes at least."""

    def inside(head: Column) -> Column:
        end = F.least(head["body"] + head["size"], b.size.cast("long"))

        def step(state: Column, _: Column) -> Column:
            def told(e: Column) -> Column:
                whole = e["body"] + e["size"] <= b.size
                text = F.hex(F.substring(b.content, F.least(e["body"], b.size.cast("long")).cast("int") + 1, F.least(e["size"], b.size.cast("long")).cast("int")))
                is_doc = e["id"] == 0x4282
                return F.struct(
                    F.when(e.isNotNull() & ~is_doc, e["body"] + e["size"]).cast("long").alias("at"),
                    F.coalesce(is_doc & whole & text.rlike("^(6D6174726F736B61|7765626D)(00([0-9A-F]{2})*)?$"), F.lit(False)).alias("ok"),
                )

            return F.when(state["at"] < end, _let(_ebml(b, state["at"]), told)).otherwise(state)

        start = F.struct(head["body"].cast("long").alias("at"), F.lit(False).alias("ok"))
        steps = F.floor(F.greatest(end - head["body"], F.lit(0).cast("long")) / 2)
        return F.aggregate(F.sequence(F.lit(0).cast("long"), steps), start, step)["ok"]

    return F.when(b.at(0, b"\x1a\x45\xdf\xa3"), _let(_ebml(b, F.lit(0).cast("long")), lambda head: F.when(head.isNotNull(), inside(head)))).otherwise(False)


def _starts_hunk(word: Column, more: tuple[int, ...] = ()) -> Column:
    return word.bitwiseAND(0x1FFFFFFF).isin(*HUNK_STARTS, *more)


def _amiga(b: Bytes) -> Column:
    """Load files by their header's tables, units and libraries by what follows their name or size."""
    state = lambda at, on, ok: F.struct(at.cast("long").alias("at"), on.alias("on"), ok.alias("ok"))
    yes, no = F.lit(True), F.lit(False)

    def library(s: Column, i: Column) -> Column:
        def told(longs: Column) -> Column:
            end = s["at"] + 4 + longs * 4
            ok = (longs <= NAME_LONGS) & (i <= LIBRARIES) & (end <= b.size)
            return F.when(longs == 0, state(s["at"] + 4, no, yes)).when(ok, state(end, yes, no)).otherwise(state(s["at"], no, no))

        return F.when(s["on"], _let(b.big(s["at"], 4), told)).otherwise(s)

    def sizes(s: Column, _: Column) -> Column:
        def told(word: Column) -> Column:
            long = word >= 0xC0000000
            return F.when(word.isNull() | (long & (s["at"] + 8 > b.size)), state(s["at"], no, no)).otherwise(state(s["at"] + F.when(long, 8).otherwise(4), yes, yes))

        return F.when(s["on"], _let(b.big(s["at"], 4), told)).otherwise(s)

    def follows(s: Column) -> Column:
        return s["ok"] & F.coalesce(_starts_hunk(b.big(s["at"], 4), (HUNK_DEBUG,)), s["at"] == b.size)

    def tables(s: Column) -> Column:
        head = F.struct(b.big(s["at"], 4).alias("n"), b.big(s["at"] + 4, 4).alias("first"), b.big(s["at"] + 8, 4).alias("last"))

        def counted(h: Column) -> Column:
            able = (h["first"] <= h["last"]) & (h["n"] <= HUNKS) & (h["last"] - h["first"] < h["n"])
            walked = F.aggregate(F.sequence(h["first"], h["last"]), state(s["at"] + 12, yes, yes), sizes)
            return F.when(able, _let(walked, follows)).otherwise(no)

        return F.when(s["ok"], _let(head, counted)).otherwise(no)

    loads = _let(F.aggregate(F.sequence(F.lit(1), F.lit(LIBRARIES + 1)), state(F.lit(4), yes, no), library), tables)
    longs = b.big(4, 4)
    printable = F.hex(F.substring(b.content, F.lit(9), (longs * 4).cast("int"))).rlike("^(00|[2-6][0-9A-F]|7[0-9A-E])*$")
    unit = F.when((longs <= NAME_LONGS) & (longs * 4 + 8 <= b.size), printable & _starts_hunk(b.big(longs * 4 + 8, 4))).otherwise(no)
    held = (longs > 0) & (longs * 4 + 8 <= b.size) & _starts_hunk(b.big(8, 4))
    return F.when(b.at(0, b"\0\0\x03\xf3"), loads).when(b.at(0, b"\0\0\x03\xe7"), unit).when(b.at(0, b"\0\0\x03\xfa"), held).otherwise(no)


def _cards(b: Bytes) -> Column:
    card = lambda at: _any(b.at(at, b"\x02" + kind) for kind in CARDS)
    return (b.size >= 80) & card(0) & ((b.size < 84) | card(80))


def _mp3(b: Bytes) -> Column:
    """A tag before the audio, or a frame that fills the content or is followed by one of the same kind."""
    tag = b.at(0, b"ID3") & b.big(3, 1).between(2, 4) & (b.big(4, 1) < 255) & (b.big(6, 4).bitwiseAND(0x80808080) == 0)
    bits = lambda word, shift, n: F.shiftright(word, shift).bitwiseAND((1 << n) - 1)
    able = lambda w: (w >= 0xFFE00000) & (bits(w, 19, 2) != 1) & (bits(w, 17, 2) != 0) & ~bits(w, 12, 4).isin(0, 15) & (bits(w, 10, 2) != 3) & (bits(w, 0, 2) != 2)

    def filled(w: Column) -> Column:
        first, layer = bits(w, 19, 2) == 3, 4 - bits(w, 17, 2)
        rates = F.array(*map(F.lit, SAMPLE_RATES))
        rate = F.get(rates, bits(w, 10, 2).cast("int")) / F.when(first, 1).when(bits(w, 19, 2) == 2, 2).otherwise(4)
        table = None
        for (version, of), row in BITRATES.items():
            holds = (first if version == 1 else ~first) & ((layer == of) if version == 1 or of == 1 else (layer > 1))
            row = F.array(*map(F.lit, row))
            table = F.when(holds, row) if table is None else table.when(holds, row)
        bitrate, pad = F.get(table, (bits(w, 12, 4) - 1).cast("int")) * 1000, bits(w, 9, 1)
        slots = F.when(layer == 1, 12).when(first | (layer == 2), 144).otherwise(72)
        length = (F.floor(slots * bitrate / rate) + pad) * F.when(layer == 1, 4).otherwise(1)
        alike = lambda n: (n + 4 > b.size) | _let(b.big(n, 4), lambda x: able(x) & (x.bitwiseAND(0x1E0C00) == w.bitwiseAND(0x1E0C00)))
        return F.when(able(w), _let(length, alike)).otherwise(False)

    return tag | F.coalesce(F.when(b.big(0, 4) >= 0xFFE00000, _let(b.big(0, 4), filled)), F.lit(False))


#: (name, rule over Bytes, name of the rule that it stands before; None: last) of formats added by register_dissector().
REGISTERED: list[tuple[str, Callable[[Bytes], Column], str | None]] = []


def ladder(content: Column) -> list[tuple[str, Column]]:
    """(name, rule) in the order in which they are asked."""
    b = Bytes(content)
    at, size, little, big = b.at, b.size, b.little, b.big
    stub = at(0, b"MZ")
    rules = [
        ("ELF", at(0, b"\x7fELF")),
        ("PE", stub & at(little(60, 4), b"PE\0\0")),
        ("NE", stub & (size >= 64) & at(little(60, 4), b"NE")),
        ("LE", _linear(b, b"LE")),
        ("LX", _linear(b, b"LX")),
        ("Mach-O", at(0, b"\xce\xfa\xed\xfe") | at(0, b"\xcf\xfa\xed\xfe")),
        ("DEX", F.hex(F.substring(content, 1, 8)).rlike("^6465780A(3[0-9]){3}00$")),
        ("Java class", at(0, b"\xca\xfe\xba\xbe") & (size >= 10) & big(6, 2).between(45, 255)),
        ("WebAssembly", at(0, b"\0asm") & (size >= 8)),
        ("RPM", at(0, b"\xed\xab\xee\xdb") & (size >= 96)),
        ("NRO", at(16, b"NRO0") & little(24, 4).between(0x80, 0x40000000)),
        ("WAV", at(0, b"RIFF") & at(8, b"WAVE")),
        ("MIDI", (at(0, b"MThd") & (big(4, 4) >= 6) & (size >= 14)) | (at(0, b"RIFF") & at(8, b"RMID"))),
        ("MP4", _mp4(b)),
        ("OGG", at(0, b"OggS")),
        ("FLAC", at(0, b"fLaC")),
        ("Matroska", _matroska(b)),
        ("WebP", at(0, b"RIFF") & at(8, b"WEBP")),
        ("PNG", at(0, b"\x89PNG\r\n\x1a\n")),
        ("BPG", at(0, b"BPG\xfb") & (size >= 6)),
        ("BMP", at(0, b"BM")),
        ("DOL", _dol(b)),
        ("ICO", (at(0, b"\0\0\1\0") | at(0, b"\0\0\2\0")) & (size >= 6)),
        ("PSD", at(0, b"8BPS") & big(4, 2).isin(1, 2)),
        ("SQLite", at(0, b"SQLite format 3\0")),
        ("PIF", (size >= 0x187) & at(0x171, b"MICROSOFT PIFEX\0")),
        ("bzip2", F.hex(F.substring(content, 1, 10)).rlike("^425A683[1-9](314159265359|177245385090)$")),
        ("ZIP", at(0, b"PK\3\4")),
        ("XZ", at(0, b"\xfd7zXZ\0") & (size >= 12)),
        ("7-Zip", at(0, b"7z\xbc\xaf\x27\x1c") & (size >= 32)),
        ("RAR", at(0, b"Rar!\x1a\x07\x00") | at(0, b"Rar!\x1a\x07\x01\x00")),
        ("TAR", (size >= 512) & at(257, b"ustar")),
        ("GIF", at(0, b"GIF87a") | at(0, b"GIF89a")),
        ("JPEG", at(0, b"\xff\xd8")),
        ("SWF", (size >= 8) & _any(at(0, m) for m in (b"FWS", b"CWS", b"ZWS")) & big(3, 1).between(1, 64)),
        ("Python bytecode", _python(b)),
        ("Atari ST program", at(0, b"\x60\x1a") & (size >= 28) & (big(2, 4) + big(6, 4) + big(14, 4) + 28 <= size)),
        ("TE", at(0, b"VZ") & (size >= 40) & little(2, 2).isin(TERSE_MACHINES) & big(4, 1).between(1, 96) & (little(6, 2) > 40) & (big(4, 1) * 40 + 40 <= size)),
        ("Amiga Hunk", _amiga(b)),
        ("OS/360 Object Module", _cards(b)),
        ("MP3", _mp3(b)),
        ("Gzip", at(0, b"\x1f\x8b")),
        ("PDF", F.decode(F.substring(content, 1, PDF_WINDOW + 5), "ISO-8859-1").rlike("(^|[\\r\\n])%PDF-[0-9]")),
        ("DOS COM", _dos_com(b)),
    ]
    for name, rule, before in REGISTERED:
        at = next((i for i, (n, _) in enumerate(rules) if n == before), len(rules))
        rules.insert(at, (name, rule(b)))
    return rules


def identify(content: Column) -> Column:
    """Name of a content's format: the first rule that holds; Data if none does."""
    found = None
    for name, rule in ladder(content):
        found = F.when(rule, name) if found is None else found.when(rule, name)
    return found.otherwise("Data")
