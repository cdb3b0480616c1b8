"""Labelled byte ranges: what walkers build, and its flat form."""

from __future__ import annotations

import datetime
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np


class Node:
    """A labelled half-open range. ``kids`` None: a leaf."""

    __slots__ = ("label", "start", "end", "kids", "open")

    def __init__(self, label: str, start: int, end: int, kids: list[Node] | None = None, open: bool = False):
        self.label, self.start, self.end, self.kids, self.open = label, start, end, kids, open


def flat(nodes: list[Node]) -> list[tuple[int, int, int, str, int, int, bool, bool]]:
    """(idx, parent, depth, label, start, end, expandable, default_expanded) in pre-order; an explicit stack, no recursion."""
    out: list[tuple] = []
    todo = [(n, -1, 0) for n in reversed(nodes)]
    while todo:
        n, parent, depth = todo.pop()
        me = len(out)
        out.append((me, parent, depth, n.label, n.start, n.end, n.kids is not None, n.open))
        todo += [(k, me, depth + 1) for k in reversed(n.kids or [])]
    return out


class View:
    """Bounds-checked reads; None beyond the end."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def number(self, at: int, width: int, order: str, signed: bool = False) -> int | None:
        return int.from_bytes(self.data[at : at + width], order, signed=signed) if 0 <= at and at + width <= self.size else None

    def text(self, at: int, end: int) -> str:
        return self.data[at:end].decode("utf-8", "replace")


#: A field: label before ": ", width in bytes, how its number is shown. Names: {number: name, None: name of others}.
Field = tuple[str, int, "Callable[[int], str] | dict | None"]


def shown(value: int, how) -> str:
    if how is None:
        return str(value)
    if isinstance(how, dict):
        return how.get(value, how[None].format(value))
    return how(value)


def fields(v: View, at: int, layout: Iterable[Field], order: str) -> list[Node]:
    """Leaves of a fixed layout. Each is left out if it doesn't lie whole in the data. A width below 0: signed."""
    out = []
    for name, width, how in layout:
        n = v.number(at, abs(width), order, width < 0)
        if n is not None:
            out.append(Node(f"{name}: {shown(n, how)}", at, at + abs(width)))
        at += abs(width)
    return out


#: White space as Unicode has it (str.strip() takes four separators more).
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def hexed(digits: int = 1) -> Callable[[int], str]:
    return lambda n: f"0x{n:0{digits}x}"


def record(v: View, at: int, layout: list[Field], order: str) -> tuple[list[Node], list[int]] | None:
    """Leaves and numbers of a fixed layout; None where it doesn't lie whole in the data."""
    if at < 0 or at + sum(abs(width) for _, width, _ in layout) > v.size:
        return None
    out, values = [], []
    for name, width, how in layout:
        n = v.number(at, abs(width), order, width < 0)
        values.append(n)
        out.append(Node(f"{name}: {shown(n, how)}" if how is not OPAQUE else name, at, at + abs(width)))
        at += abs(width)
    return out, values


def OPAQUE(n: int) -> str:  # noqa: N802
    """How a field is shown that has a name and no value."""
    return ""


ESCAPES = {"\0": "\\0", "\t": "\\t", "\n": "\\n", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def escaped(text: str, inner: bool = True) -> str:
    """Text as it stands between quotes: what has no shape of its own by its number. inner: marks that join the character
    before them too, otherwise only one that begins the text."""

    def one(i: int, c: str) -> str:
        joins = (inner or not i) and unicodedata.category(c) in ("Mn", "Me")
        return ESCAPES.get(c) or (c if c.isprintable() and not joins else f"\\u{{{ord(c):x}}}")

    return "".join(one(i, c) for i, c in enumerate(text))


def decimal(x: float, kind: type = np.float64) -> str:
    """The fewest digits that name a number of this width, never with an exponent."""
    if x != x:
        return "NaN"
    return str(float(x)) if x in (float("inf"), float("-inf")) else np.format_float_positional(kind(x), trim="-")


#: Days after which the calendar repeats, and its years.
CYCLE, CYCLE_YEARS = 146_097, 400


def moment(seconds: int) -> str:
    """Date and time of seconds since 1970, of any year."""
    days, rest = divmod(seconds, 86_400)
    cycles, days = divmod(days, CYCLE)
    day = datetime.date(1970, 1, 1) + datetime.timedelta(days)
    return f"{day.year + CYCLE_YEARS * cycles:04}-{day:%m-%d} {rest // 3600:02}:{rest // 60 % 60:02}:{rest % 60:02} UTC"
