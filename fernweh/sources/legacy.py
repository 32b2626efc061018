"""Text of office documents in compound binary files: Word, Excel and PowerPoint of 1997 to 2003.

The formats are published by their maker. Streams are found by the file's allocation tables; a chain that bites its
own tail ends there. What can't be read raises ValueError with the reason.
"""

from __future__ import annotations

import re
import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END = 0xFFFFFFFA  # sector numbers from here on are none


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name; of several of one name the first counts."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    size, small = 1 << _u16(data, 0x1E), 1 << _u16(data, 0x20)
    if not 128 <= size <= 1 << 16 or not 16 <= small <= size:
        raise ValueError("invalid compound file")
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]

    def words(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def chain(first: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while first < len(table) and first not in seen:
            seen.add(first)
            out.append(first)
            first = table[first]
        return out

    places = words(data[0x4C:0x200])
    more, seen = _u32(data, 0x44), set()
    while more < END and more not in seen and (part := words(sector(more))):
        seen.add(more)
        places += part[:-1]
        more = part[-1]
    table = [x for n in places if n < END for x in words(sector(n))]
    read = lambda first: b"".join(sector(n) for n in chain(first, table))
    folder = read(_u32(data, 0x30))
    entries = []
    for at in range(0, len(folder) - 127, 128):
        entry = folder[at : at + 128]
        name = entry[: max(0, min(64, _u16(entry, 64)) - 2)].decode("utf-16-le", "replace")
        entries.append((name, entry[66], _u32(entry, 116), _u32(entry, 120)))
    root = next((e for e in entries if e[1] == 5), None)
    pool = read(root[2]) if root else b""
    minis = words(read(_u32(data, 0x3C)))
    out: dict[str, bytes] = {}
    for name, kind, first, length in entries:
        if kind != 2:
            continue
        if length < _u32(data, 0x38):
            raw = b"".join(pool[n * small : (n + 1) * small] for n in chain(first, minis))
        else:
            raw = read(first)
        out.setdefault(name, raw[:length])
    return out


def word(parts: dict[str, bytes]) -> str:
    """A document's text by its pieces; instructions of fields are left out, their results stay."""
    main = parts["WordDocument"]
    if len(main) < 0x1AA or _u16(main, 0) != 0xA5EC:
        raise ValueError("invalid Word document")
    flags = _u16(main, 0x0A)
    if flags & 0x0100:
        raise ValueError("encrypted")
    table = parts.get("1Table" if flags & 0x0200 else "0Table", b"")
    at, length = _u32(main, 0x1A2), _u32(main, 0x1A6)
    pieces, end = table[at : at + length], 0
    while end < len(pieces) and pieces[end] == 1:
        end += 3 + _u16(pieces, end + 1)
    if end >= len(pieces) or pieces[end] != 2:
        raise ValueError("invalid Word document")
    plan = pieces[end + 5 : end + 5 + _u32(pieces, end + 1)]
    n = (len(plan) - 4) // 12
    out = []
    for k in range(n):
        chars = _u32(plan, 4 * k + 4) - _u32(plan, 4 * k)
        where = _u32(plan, 4 * (n + 1) + 8 * k + 2)
        if where & 0x40000000:  # a byte a character
            start = (where & 0x3FFFFFFF) // 2
            out.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    text = re.sub("\x13[^\x13\x14\x15]*(?:\x14|(?=\x15))", "", "".join(out))
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text.replace("\x07", "\t").replace("\x0b", "\n").replace("\r", "\n"))


class _Strings:
    """Reads the shared strings over the records they run through; at a record's beginning a string says anew how wide it is."""

    def __init__(self, records: list[bytes]):
        self.records, self.k, self.at = records, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.records):
            part = self.records[self.k][self.at : self.at + n]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
            if self.at >= len(self.records[self.k]):
                self.k, self.at = self.k + 1, 0
        return out

    def chars(self, n: int, wide: bool) -> str:
        out = []
        while n > 0 and self.k < len(self.records):
            room = len(self.records[self.k]) - self.at
            own = min(n, room // (2 if wide else 1))
            raw = self.records[self.k][self.at : self.at + own * (2 if wide else 1)]
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n, self.at = n - own, self.at + len(raw)
            if n > 0 or self.at >= len(self.records[self.k]):
                self.k, self.at = self.k + 1, 0
                if n > 0 and self.k < len(self.records):
                    wide, self.at = bool(self.records[self.k][0] & 1), 1
        return "".join(out)

    def string(self) -> str:
        head = self.take(3)
        if len(head) < 3:
            return ""
        n, flags = _u16(head, 0), head[2]
        runs = _u16(self.take(2) + b"\0\0", 0) if flags & 8 else 0
        extra = _u32(self.take(4) + b"\0\0\0\0", 0) if flags & 4 else 0
        text = self.chars(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


def _number(x: float) -> str:
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)


def _packed(raw: int) -> float:
    x = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return x / 100 if raw & 1 else x


def excel(parts: dict[str, bytes]) -> str:
    """Sheets, a line per row, cells between tabs, sheets between form feeds."""
    book = parts.get("Workbook") or parts.get("Book") or b""
    at, records = 0, []
    while at + 4 <= len(book):
        kind, n = _u16(book, at), _u16(book, at + 2)
        records.append((kind, book[at + 4 : at + 4 + n]))
        at += 4 + n
    if any(kind == 0x2F for kind, _ in records):
        raise ValueError("encrypted")
    shared: list[str] = []
    for k, (kind, body) in enumerate(records):
        if kind == 0xFC and len(body) >= 8:
            run = [body[8:]]
            for other, more in records[k + 1 :]:
                if other != 0x3C:
                    break
                run.append(more)
            reader = _Strings([r for r in run if r])
            while len(shared) < _u32(body, 4) and reader.k < len(reader.records):
                shared.append(reader.string())
    sheets: list[dict[int, dict[int, str]]] = []
    last = None
    for kind, body in records:
        if kind == 0x809:
            sheets.append({})
        if not sheets:
            continue
        put = lambda row, column, text: sheets[-1].setdefault(row, {}).__setitem__(column, text)
        if kind == 0xFD and len(body) >= 10 and _u32(body, 6) < len(shared):
            put(_u16(body, 0), _u16(body, 2), shared[_u32(body, 6)])
        elif kind == 0x203 and len(body) >= 14:
            put(_u16(body, 0), _u16(body, 2), _number(struct.unpack_from("<d", body, 6)[0]))
        elif kind == 0x27E and len(body) >= 10:
            put(_u16(body, 0), _u16(body, 2), _number(_packed(_u32(body, 6))))
        elif kind == 0xBD and len(body) >= 12:
            for k in range((len(body) - 6) // 6):
                put(_u16(body, 0), _u16(body, 2) + k, _number(_packed(_u32(body, 6 + 6 * k))))
        elif kind == 0x204 and len(body) >= 9:
            put(_u16(body, 0), _u16(body, 2), _Strings([body[6:]]).string())
        elif kind == 0x06 and len(body) >= 14:
            last = (_u16(body, 0), _u16(body, 2))
            if body[12:14] != b"\xff\xff":
                put(*last, _number(struct.unpack_from("<d", body, 6)[0]))
        elif kind == 0x207 and last:
            put(*last, _Strings([body]).string())
    line = lambda row: "\t".join(row.get(c, "") for c in range(min(row), max(row) + 1))
    return "\f".join("\n".join(line(sheet[r]) for r in sorted(sheet)) for sheet in sheets if sheet)


def powerpoint(parts: dict[str, bytes]) -> str:
    """The texts of slides in the order they are stored, each on lines of its own."""
    data, at, out = parts["PowerPoint Document"], 0, []
    while at + 8 <= len(data):
        version, kind, n = _u16(data, at), _u16(data, at + 2), _u32(data, at + 4)
        body = data[at + 8 : at + 8 + n]
        if kind == 0x0FA0:
            out.append(body.decode("utf-16-le", "replace"))
        elif kind == 0x0FA8:
            out.append(body.decode("latin-1"))
        at += 8 if version & 0xF == 0xF else 8 + n  # containers are entered
    return "\n".join(x.replace("\r", "\n").replace("\x0b", "\n") for x in out)


def text(data: bytes) -> str:
    parts = streams(data)
    if "WordDocument" in parts:
        return word(parts)
    if "Workbook" in parts or "Book" in parts:
        return excel(parts)
    if "PowerPoint Document" in parts:
        return powerpoint(parts)
    raise ValueError("unsupported compound file")
