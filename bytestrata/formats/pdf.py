"""Walker of PDF: objects, cross-reference tables and trailers as they stand, a revision up to each end mark."""

from __future__ import annotations

import re
from typing import NamedTuple

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
WINDOW, OBJECTS_SHOWN, ENTRIES_SHOWN, REFERENCES_SHOWN, CHARS = 1024, 1000, 64, 1000, 60
STRUCTURE = {b"endobj", b"stream", b"endstream", b"obj", b"xref", b"trailer", b"startxref"}
HEAD = re.compile(rb"(?:\A|(?<=[\r\n]))%PDF-[0-9]")
VERSION = re.compile(rb"[0-9.]*")
LINE = re.compile(rb"[^\r\n]*")
BREAK = re.compile(rb"\r\n|\r|\n|")
SPACE = re.compile(rb"[\0\t\n\f\r ]*")
SPACE_OR_COMMENT = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
TOKEN = re.compile(
    rb"(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[^>]*>?)|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<text>\()|(?P<other>[)>{}])|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)"
)
IN_TEXT = re.compile(rb"\\.|[()]", re.DOTALL)
DIGITS = re.compile(rb"[0-9]{1,19}\Z")
REFERENCE = re.compile(rb"([0-9]{10}) ([0-9]{5}) ([nf])[ \r\n]{0,2}")


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    raw: bytes

    @property
    def ends(self) -> bool:
        """Whether nothing may go on beyond it."""
        return self.kind == "word" and self.raw in STRUCTURE

    @property
    def number(self) -> int | None:
        return _number(self.raw) if self.kind == "word" else None


def _number(raw: bytes) -> int | None:
    return int(raw) if DIGITS.match(raw) else None


def token(data: bytes, at: int) -> Token | None:
    """The next token, behind space and comments."""
    at = SPACE_OR_COMMENT.match(data, at).end()
    found = TOKEN.match(data, at)
    if not found:
        return None
    end = found.end()
    if found.lastgroup == "text":
        depth, end = 0, len(data)
        for x in IN_TEXT.finditer(data, at):
            depth += {b"(": 1, b")": -1}.get(x.group(), 0)
            if not depth:
                end = x.end()
                break
    # Only words and names are looked at again.
    return Token(found.lastgroup, at, end, found.group() if found.lastgroup in ("word", "name") else b"")


def value(data: bytes, at: int) -> tuple[int, int] | None:
    """Place of the next value: one token, a reference of three, or all of a container."""
    first = token(data, at)
    if first is None or first.kind == "close" or first.ends:
        return None
    if first.kind == "open":
        depth, end = 1, first.end
        while depth and (t := token(data, end)) and not t.ends:
            end = t.end
            depth += (t.kind == "open") - (t.kind == "close")
        return first.start, end
    if first.number is not None:
        second = token(data, first.end)
        third = token(data, second.end) if second and second.number is not None else None
        if third and third.kind == "word" and third.raw == b"R":
            return first.start, third.end
    return first.start, first.end


def shown(raw: bytes) -> str:
    text = "".join(chr(x) if 0x21 <= x < 0x7F or x == 0x20 else "." for x in re.sub(rb"[\0\t\n\f\r ]+", b" ", raw))
    cut = len(text) > CHARS or (len(text) == CHARS and re.search(rb"[\0\t\n\f\r ]{2}\Z", raw))
    return text[:CHARS] + "..." if cut else text


class _Dict:
    """Keys and the places of their values; the first of equal keys counts."""

    def __init__(self, data: bytes, first: Token):
        self.data, self.start, self.end, self.closed, self.entries = data, first.start, first.end, False, []
        while (t := token(data, self.end)) and not t.ends:
            if t.kind == "close" and data[t.start : t.end] == b">>":
                self.end, self.closed = t.end, True
                break
            found = value(data, t.end if t.kind == "name" else self.end)
            if t.kind == "name" and found:
                self.entries.append((t.start, t.end, *found))
            self.end = found[1] if found else t.end

    def get(self, key: bytes) -> bytes | None:
        return next((self.data[c:d] for a, b, c, d in self.entries if self.data[a:b] == key), None)

    def name(self, key: bytes) -> str | None:
        held = self.get(key)
        return held[1:].decode("utf-8", "replace") if held and held[:1] == b"/" else None

    def filters(self) -> list[str]:
        held, at, out = self.get(b"/Filter") or b"", 0, []
        while t := token(held, at):
            out += [t.raw[1:].decode("utf-8", "replace")] * (t.kind == "name")
            at = t.end
        return out

    def node(self, opened: bool = False) -> Node:
        kids = [Node(f"{shown(self.data[a:b])} {shown(self.data[c:d])}", a, d) for a, b, c, d in self.entries[:ENTRIES_SHOWN]]
        rest, n = self.entries[ENTRIES_SHOWN:], len(self.entries)
        kids += [Node(f"({len(rest)} more entries not shown)", rest[0][0], rest[-1][3])] if rest else []
        label = f"Dictionary ({n} {'entry' if n == 1 else 'entries'}){', unterminated' * (not self.closed)}"
        return Node(label, self.start, self.end, kids, opened)


def _stream(data: bytes, word: Token, held: _Dict | None, kids: list[Node]) -> int:
    """Adds a stream's parts. Its stated length counts where the end stands behind it, else the next end is sought."""
    at = BREAK.match(data, word.end).end()
    kids.append(Node("stream", word.start, at))
    stated = _number(held.get(b"/Length") or b"") if held else None
    mark, agrees = -1, False
    if stated is not None and at + stated <= len(data):
        mark = SPACE.match(data, at + stated).end()
        agrees = data.startswith(b"endstream", mark)
    if agrees:
        end = at + stated
    else:
        mark = data.find(b"endstream", at)
        end = len(data) if mark < 0 else mark
        if mark >= 0:
            end -= end > at and data[end - 1] == 0x0A
            end -= end > at and data[end - 1] == 0x0D
    told = [f"{end - at} bytes"] + [", ".join(held.filters())] * bool(held and held.filters())
    told += [f"/Length {stated} inconsistent"] * (stated is not None and not agrees)
    kids += [Node(f"Stream data ({', '.join(told)})", at, end)] * (end > at)
    if mark < 0:
        return len(data)
    kids.append(Node("endstream", mark, mark + 9))
    return mark + 9


def _object(data: bytes, at: int, number: int, generation: int, body: int) -> Node:
    kids, pos, held = [Node(f"Object header: {number} {generation} obj", at, body)], body, None
    first = token(data, pos)
    if first and first.kind == "open" and data[first.start : first.end] == b"<<":
        held = _Dict(data, first)
        kids.append(held.node())
        pos = held.end
    elif first and not first.ends and (found := value(data, pos)):
        kids.append(Node(f"Value: {shown(data[found[0] : found[1]])}", *found))
        pos = found[1]
    streamed, before = False, [None, None]
    while True:
        t = token(data, pos)
        if t is None:
            break
        word = t.raw if t.kind == "word" else None
        if word == b"endobj":
            kids.append(Node("endobj", t.start, t.end))
            pos = t.end
            break
        if word == b"stream" and not streamed:
            pos, streamed, before = _stream(data, t, held, kids), True, [None, None]
            continue
        if word == b"obj":
            # The next object has begun, with two numbers: this one lacks its end.
            if all(x is not None and x.number is not None for x in before):
                pos = before[0].start
            break
        if word in (b"xref", b"trailer", b"startxref"):
            break
        before, pos = [before[1], t], t.end
    told = [f"{key} /{held.name(key.encode())}" for key in ("/Type", "/Subtype") if held and held.name(key.encode()) is not None]
    told = told or ["stream"] * streamed
    return Node(f"Object {number} {generation}" + (f" ({' '.join(told)})" if told else ""), at, pos, kids)


def _references(data: bytes, word: Token) -> Node:
    kids, end, left = [Node("xref", word.start, word.end)], word.end, REFERENCES_SHOWN
    while True:
        first = token(data, end)
        second = token(data, first.end) if first and first.number is not None else None
        if second is None or second.number is None:
            break
        following = token(data, second.end)
        if following and following.kind == "word" and following.raw == b"obj":
            break
        start, count, n = first.number, second.number, 0
        listed, pos, stop, hidden = [Node(f"Subsection header: {start} {count}", first.start, second.end)], SPACE.match(data, second.end).end(), second.end, None
        while n < count and (entry := REFERENCE.match(data, pos)):
            place, generation, used = int(entry[1]), int(entry[2]), entry[3] == b"n"
            if left:
                left -= 1
                told = f"offset {place}" if used else f"free, next {place}"
                listed.append(Node(f"Object {start + n}: {told}, gen {generation}", pos, entry.end()))
            elif hidden is None:
                hidden = (pos, n)
            n, pos, stop = n + 1, entry.end(), entry.end()
        if hidden:
            listed.append(Node(f"({n - hidden[1]} more entries not shown)", hidden[0], stop))
        label = f"Subsection (objects {start}-{start + n - 1}, {n} entries)" if n else f"Subsection (first {start}, 0 entries)"
        kids.append(Node(label, first.start, stop, listed))
        end = stop
        if n < count:
            break
    return Node("Cross-reference table", word.start, end, kids)


def _trailer(data: bytes, word: Token) -> Node:
    kids, first = [Node("trailer", word.start, word.end)], token(data, word.end)
    if first and first.kind == "open" and data[first.start : first.end] == b"<<":
        kids.append(_Dict(data, first).node(True))
    return Node("Trailer", word.start, kids[-1].end, kids, True)


def _start(data: bytes, word: Token) -> Node:
    t = token(data, word.end)
    if t and t.number is not None:
        return Node(f"startxref: {t.number}", word.start, t.end)
    return Node("startxref", word.start, word.end)


KEYWORDS = {b"xref": _references, b"trailer": _trailer, b"startxref": _start}


def _revisions(data: bytes, at: int) -> list[list[Node]]:
    out: list[list[Node]] = [[]]
    body: list[Node] = []
    left = OBJECTS_SHOWN

    def flush() -> None:
        nonlocal left
        if body:
            kids, rest = body[:left], body[left:]
            left -= len(kids)
            kids += [Node(f"({len(rest)} more objects not shown)", rest[0].start, rest[-1].end)] if rest else []
            out[-1].append(Node(f"Body ({len(body)} object{'s' * (len(body) > 1)})", body[0].start, body[-1].end, kids))
            body.clear()

    while (at := SPACE.match(data, at).end()) < len(data):
        if data[at] == 0x25:
            if data.startswith(b"%%EOF", at):
                flush()
                out[-1].append(Node("%%EOF", at, at + 5))
                out.append([])
            at = LINE.match(data, at).end()
            continue
        t = token(data, at)
        second = token(data, t.end) if t.number is not None else None
        third = token(data, second.end) if second and second.number is not None else None
        if third and third.kind == "word" and third.raw == b"obj":
            body.append(_object(data, t.start, t.number, second.number, third.end))
            # Beyond what is shown only the place is kept.
            if len(body) > left:
                body[-1].kids = None
            at = body[-1].end
        elif t.kind == "word" and t.raw in KEYWORDS:
            flush()
            out[-1].append(KEYWORDS[t.raw](data, t))
            at = out[-1][-1].end
        else:
            at = t.end
    flush()
    return [r for r in out if r]


def pdf(v: View) -> list[Node]:
    data = v.data
    found = HEAD.search(data, 0, WINDOW + 5)
    if not found:
        return []
    at = found.start()
    middle = at + 5
    version = VERSION.match(data, middle)
    end = BREAK.match(data, LINE.match(data, at).end()).end()
    told = version.group().decode("ascii")
    out = [Node(f"Leading data ({at} bytes)", 0, at)] * (at > 0)
    out.append(Node(f"Header (PDF {told})", at, end, [Node("Magic: %PDF-", at, middle), Node(f"Version: {told}", middle, version.end())], True))
    if data[end : end + 1] == b"%" and not data.startswith(b"%%EOF", end) and not LINE.match(data, end).group().isascii():
        stop = BREAK.match(data, LINE.match(data, end).end()).end()
        out.append(Node("Binary marker comment", end, stop))
        end = stop
    revisions = _revisions(data, end)
    if len(revisions) == 1:
        return out + revisions[0]
    return out + [Node(f"Revision {i}", r[0].start, r[-1].end, r, True) for i, r in enumerate(revisions, 1)]


WALKERS = {"PDF": pdf}
