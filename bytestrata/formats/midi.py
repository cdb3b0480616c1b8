"""Walker of MIDI files, bare or in RIFF: chunks, and the events of tracks with their running status."""

from __future__ import annotations

import struct

from bytestrata.formats.tree import Node, View

# Fixed values of the format.
EVENTS_SHOWN, CHARS = 500, 80
LAYOUTS = {0: "single track", 1: "multi-track", 2: "multi-song"}
STATUS = {8: "Note Off", 9: "Note On", 10: "Poly Aftertouch", 11: "Control Change", 12: "Program Change", 13: "Channel Aftertouch", 14: "Pitch Bend"}
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR = ["Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#"]
MINOR = ["Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#"]
RATES = ["24", "25", "29.97", "30"]
META = {
    0x00: "Sequence Number", 0x01: "Text", 0x02: "Copyright", 0x03: "Track Name", 0x04: "Instrument Name", 0x05: "Lyric", 0x06: "Marker", 0x07: "Cue Point",
    0x08: "Program Name", 0x09: "Device Name", 0x0A: "Text (reserved)", 0x0B: "Text (reserved)", 0x0C: "Text (reserved)", 0x0D: "Text (reserved)",
    0x0E: "Text (reserved)", 0x0F: "Text (reserved)", 0x20: "Channel Prefix", 0x21: "MIDI Port", 0x2F: "End of Track", 0x51: "Set Tempo", 0x54: "SMPTE Offset",
    0x58: "Time Signature", 0x59: "Key Signature", 0x7F: "Sequencer-Specific",
}
CONTROLLERS = {
    0: "Bank Select MSB", 1: "Modulation", 2: "Breath Controller", 4: "Foot Controller", 5: "Portamento Time", 6: "Data Entry MSB", 7: "Volume", 8: "Balance",
    10: "Pan", 11: "Expression", 32: "Bank Select LSB", 38: "Data Entry LSB", 64: "Sustain Pedal", 65: "Portamento", 66: "Sostenuto", 67: "Soft Pedal",
    68: "Legato", 71: "Resonance", 72: "Release Time", 73: "Attack Time", 74: "Cutoff", 84: "Portamento Control", 91: "Reverb", 92: "Tremolo", 93: "Chorus",
    94: "Detune", 95: "Phaser", 96: "Data Increment", 97: "Data Decrement", 98: "NRPN LSB", 99: "NRPN MSB", 100: "RPN LSB", 101: "RPN MSB", 120: "All Sound Off",
    121: "Reset All Controllers", 122: "Local Control", 123: "All Notes Off", 124: "Omni Off", 125: "Omni On", 126: "Mono On", 127: "Poly On",
}
INSTRUMENTS = [
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer", "Drawbar Organ", "Percussive Organ", "Rock Organ",
    "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion", "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)",
    "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics", "Acoustic Bass", "Electric Bass (finger)",
    "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2", "Violin", "Viola", "Cello", "Contrabass",
    "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani", "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2",
    "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit", "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1",
    "Synth Brass 2", "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet", "Piccolo", "Flute", "Recorder",
    "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina", "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)",
    "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)", "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)",
    "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)", "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)",
    "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)", "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bagpipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal", "Guitar Fret Noise", "Breath Noise",
    "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
]


class Broken(Exception):
    """An event that can't be read; its text is the label of the rest of the track."""


def _four(raw: bytes) -> str:
    return "".join(chr(x) if 0x20 <= x < 0x7F else "." for x in raw)


def _text(raw: bytes) -> str:
    text = "".join(" " if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 else c for c in raw.decode("utf-8", "replace"))
    return f'"{text[:CHARS]}{"…" * (len(text) > CHARS)}"'


def _note(n: int) -> str:
    return f"{NOTES[n % 12]}{n // 12 - 1}"


def _count(data: bytes, at: int, end: int, what: str) -> tuple[int, int]:
    """(number, its end), seven bits a byte in at most four bytes."""
    n = 0
    for i in range(at, min(at + 4, end)):
        n = n << 7 | data[i] & 127
        if data[i] < 128:
            return n, i + 1
    raise Broken(what)


def _voice(data: bytes, status: int, at: int, end: int) -> tuple[str, int, list[Node]]:
    kind, channel, n = status >> 4, (status & 15) + 1, 1 if status >> 4 in (12, 13) else 2
    if at + n > end:
        raise Broken("Truncated channel message")
    a, b = data[at], data[at + n - 1]
    told = f"{STATUS[kind]} ch {channel}"
    first, second = (lambda label: Node(label, at, at + 1)), (lambda label: Node(label, at + 1, at + 2))
    if kind in (8, 9):
        return f"{told} {_note(a)} vel {b}" + " (= Note Off)" * (kind == 9 and not b), at + n, [first(f"Note: {_note(a)} ({a})"), second(f"Velocity: {b}")]
    if kind == 10:
        return f"{told} {_note(a)} pressure {b}", at + n, [first(f"Note: {_note(a)} ({a})"), second(f"Pressure: {b}")]
    if kind == 11:
        name = CONTROLLERS.get(a, "Controller")
        return f"{told} {name} = {b}", at + n, [first(f"Controller: {a} ({name})"), second(f"Value: {b}")]
    if kind == 12:
        name = INSTRUMENTS[a] if a < 128 else "?"
        return f"{told} {a} ({name})", at + n, [first(f"Program: {a} ({name})")]
    if kind == 13:
        return f"{told} pressure {a}", at + n, [first(f"Pressure: {a}")]
    bend = ((b & 127) << 7 | a & 127) - 8192
    return f"{told} {bend}", at + n, [Node(f"Pitch bend: {bend} (LSB {a}, MSB {b})", at, at + 2)]


def _exclusive(data: bytes, at: int, end: int) -> tuple[str, int, list[Node]]:
    kind = "SysEx" if data[at] == 0xF0 else "SysEx (escape/continuation)"
    n, body = _count(data, at + 1, end, "Truncated SysEx length")
    if body + n > end:
        raise Broken("Truncated SysEx data")
    kids = [Node(f"Status: 0x{data[at]:02X} ({kind})", at, at + 1), Node(f"Length: {n}", at + 1, body)]
    return f"{kind}, {n} bytes", body + n, kids + [Node("Data", body, body + n)] * (n > 0)


def _meta(data: bytes, at: int, end: int) -> tuple[str, int, list[Node], int, bytes]:
    if at + 1 >= end:
        raise Broken("Truncated meta event")
    kind = data[at + 1]
    name = META.get(kind, "Unknown meta")
    n, body = _count(data, at + 2, end, "Truncated meta event length")
    stop = body + n
    if stop > end:
        raise Broken("Truncated meta event data")
    raw = data[body:stop]
    kids = [Node("Status: 0xFF (Meta event)", at, at + 1), Node(f"Type: 0x{kind:02X} ({name})", at + 1, at + 2), Node(f"Length: {n}", at + 2, body)]
    said, more = _told(kind, name, raw, body)
    return said, stop, kids + more, kind, raw


def _told(kind: int, name: str, raw: bytes, at: int) -> tuple[str, list[Node]]:
    """(summary, leaves) of a meta event's data."""
    n = len(raw)
    whole = lambda label: [Node(label, at, at + n)]
    if kind == 0x00 and n == 2:
        number = int.from_bytes(raw, "big")
        return f"{name}: {number}", whole(f"Sequence number: {number}")
    if 0x01 <= kind <= 0x0F:
        return f"{name}: {_text(raw)}", whole(f"Text: {_text(raw)}")
    if kind == 0x20 and n == 1:
        return f"{name}: channel {raw[0] + 1}", whole(f"Channel: {raw[0] + 1}")
    if kind == 0x21 and n == 1:
        return f"{name}: {raw[0]}", whole(f"Port: {raw[0]}")
    if kind == 0x2F:
        return name, []
    if kind == 0x51 and n == 3:
        us = int.from_bytes(raw, "big")
        tempo = f"{us} µs/quarter ({6e7 / us if us else 0:.2f} BPM)"
        return f"{name}: {tempo}", whole(f"Tempo: {tempo}")
    if kind == 0x54 and n == 5:
        hour, *rest = raw
        offset = "{:02}:{:02}:{:02}:{:02}.{:02} @ {} fps".format(hour & 31, *rest, RATES[hour >> 5 & 3])
        return f"{name}: {offset}", whole(f"Offset: {offset}")
    if kind == 0x58 and n == 4:
        beat = f"{raw[0]}/{1 << raw[1] if raw[1] < 64 else 0}"
        parts = [(f"Time signature: {beat}", 0, 2), (f"MIDI clocks per metronome click: {raw[2]}", 2, 3), (f"32nd notes per quarter note: {raw[3]}", 3, 4)]
        return f"{name}: {beat}", [Node(label, at + a, at + b) for label, a, b in parts]
    if kind == 0x59 and n == 2:
        sharps = int.from_bytes(raw[:1], "big", signed=True)
        mode, keys = ("minor", MINOR) if raw[1] else ("major", MAJOR)
        key = f"{keys[sharps + 7]} {mode}" if -7 <= sharps <= 7 else f"invalid ({sharps} sharps/flats)"
        return f"{name}: {key}", [Node(f"Sharps/flats: {sharps}", at, at + 1), Node(f"Mode: {mode}", at + 1, at + 2)]
    return f"{name}, {n} bytes", whole("Data") if n else []


def _track(data: bytes, at: int, body: int, end: int, index: int, kids: list[Node]) -> Node:
    running, n, hidden, name, pos, over = None, 0, None, None, body, False
    rest: list[Node] = []
    while pos < end and not over:
        try:
            delta, head = _count(data, pos, end, "Truncated event (delta time)")
            if head >= end:
                raise Broken("Truncated event (missing status)")
            first, parts = data[head], [Node(f"Delta time: {delta}", pos, head)]
            if first < 0x80:
                if running is None:
                    raise Broken(f"Invalid data: byte 0x{first:02X} with no running status")
                said, stop, more = _voice(data, running, head, end)
                said += " (running status)"
            elif first < 0xF0:
                running = first
                parts.append(Node(f"Status: 0x{first:02X} ({STATUS[first >> 4]}, channel {(first & 15) + 1})", head, head + 1))
                said, stop, more = _voice(data, first, head + 1, end)
            elif first in (0xF0, 0xF7):
                running = None
                said, stop, more = _exclusive(data, head, end)
            elif first == 0xFF:
                running = None
                said, stop, more, kind, raw = _meta(data, head, end)
                over = kind == 0x2F
                name = _text(raw) if kind == 3 and name is None else name
            else:
                raise Broken(f"Invalid status byte 0x{first:02X}")
        except Broken as e:
            rest, over = [Node(str(e), pos, end)], True
            break
        n += 1
        if n <= EVENTS_SHOWN:
            kids.append(Node(f"Δ{delta}: {said}", pos, stop, parts + more))
        elif hidden is None:
            hidden = pos
        pos = stop
    unshown = n - EVENTS_SHOWN
    if rest:
        if hidden is not None:
            kids.append(Node(f"({unshown} more events not shown)", hidden, pos))
            n = EVENTS_SHOWN
        kids += rest
    else:
        kids += [Node(f"({unshown} more events not shown)", hidden, pos)] * (hidden is not None)
        kids += [Node("Data after End of Track", pos, end)] * (pos < end)
    label = f"Track {index} (MTrk)" + (f": {name}" if name is not None else "") + f" — {n} event{'s' * (n != 1)}"
    return Node(label, at, end, kids)


def _header(data: bytes, at: int, body: int, end: int, kids: list[Node]) -> Node:
    words = [int.from_bytes(data[p : p + 2], "big") for p in range(body, min(body + 5, end - 1), 2)]
    labels = []
    for i, x in enumerate(words):
        if i == 0:
            labels.append(f"Format: {x} ({LAYOUTS.get(x, 'unknown')})")
        elif i == 1:
            labels.append(f"Track count: {x}")
        elif x & 0x8000:
            fps = 256 - (x >> 8)
            labels.append(f"Division: SMPTE {'29.97 (drop frame)' if fps == 29 else fps} fps, {x & 255} ticks/frame")
        else:
            labels.append(f"Division: {x} ticks per quarter note")
    kids += [Node(label, body + 2 * i, body + 2 * i + 2) for i, label in enumerate(labels)]
    kids += [Node("Extra header data", body + 6, end)] * (end > body + 6)
    return Node("Header chunk (MThd)", at, end, kids, True)


def _chunks(data: bytes, at: int, limit: int) -> list[Node]:
    out, tracks = [], 0
    while at + 8 <= limit:
        who, (n,), body = data[at : at + 4], struct.unpack_from(">I", data, at + 4), at + 8
        end = min(body + n, limit)
        kids = [Node(f"Chunk ID: {_four(who)}", at, at + 4), Node(f"Length: {n}", at + 4, body)]
        if who == b"MThd":
            out.append(_header(data, at, body, end, kids))
        elif who == b"MTrk":
            tracks += 1
            out.append(_track(data, at, body, end, tracks, kids))
        else:
            out.append(Node(f"Unknown chunk: {_four(who)}", at, end, kids + [Node("Chunk data", body, end)] * (end > body)))
        at = end
    return out + [Node("Trailing data", at, limit)] * (at < limit)


def _wrapped(data: bytes) -> list[Node]:
    (size,) = struct.unpack_from("<I", data, 4)
    out = [Node("RIFF header", 0, 12, [Node("Chunk ID: RIFF", 0, 4), Node(f"Chunk size: {size}", 4, 8), Node("Form type: RMID", 8, 12)], True)]
    limit, at = min(size + 8, len(data)), 12
    while at + 8 <= limit:
        who, (n,), body = data[at : at + 4], struct.unpack_from("<I", data, at + 4), at + 8
        end = min(body + n, limit)
        kids = [Node(f"Chunk ID: {_four(who)}", at, at + 4), Node(f"Chunk size: {n}", at + 4, body)]
        midi = data[body : body + 4] == b"MThd" and end >= body + 14 and int.from_bytes(data[body + 4 : body + 8], "big") >= 6
        if who == b"data" and midi:
            kids.append(Node("Standard MIDI File", body, end, _chunks(data, body, end), True))
        elif end > body:
            kids.append(Node("Chunk data", body, end))
        pad = n % 2 == 1 and end < limit and body + n == end
        kids += [Node("Padding", end, end + 1)] * pad
        out.append(Node(f"{_four(who)} chunk", at, end + pad, kids, who == b"data"))
        at = end + pad
    return out + [Node("Trailing data", at, len(data))] * (at < len(data))


def midi(v: View) -> list[Node]:
    if v.size < 8:
        return []
    return _wrapped(v.data) if v.size >= 12 and v.data[:4] == b"RIFF" and v.data[8:12] == b"RMID" else _chunks(v.data, 0, v.size)


WALKERS = {"MIDI": midi}
