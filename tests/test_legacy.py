"""Compound binary office files, written here from the formats' descriptions."""

import struct

import pytest

from fernweh.sources import extract, legacy

FREE, STOP, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def compound(streams, mini=False):
    """A compound file of 512-byte sectors; mini puts the streams into the pool of small ones."""
    sectors, table, entries = [], [], []

    def store(raw):
        if not raw:
            return STOP
        first = len(sectors)
        for at in range(0, len(raw), 512):
            sectors.append(raw[at : at + 512].ljust(512, b"\0"))
            table.append(len(sectors))
        table[-1] = STOP
        return first

    pool, small = b"", []
    for name, raw in streams.items():
        if mini:
            first = len(small)
            n = -(-len(raw) // 64)
            small += [*range(first + 1, first + n), STOP]
            pool += raw.ljust(64 * n, b"\0")
        else:
            first = store(raw)
        entries.append((name, 2, first, len(raw)))
    entries.insert(0, ("Root Entry", 5, store(pool), len(pool)))
    folder = b""
    for name, kind, first, size in entries:
        raw = name.encode("utf-16-le")
        folder += raw.ljust(64, b"\0") + struct.pack("<HBB3I16sI8s8sIII", len(raw) + 2, kind, 1, FREE, FREE, FREE, b"", 0, b"", b"", first, size, 0)
    at_folder, at_small = store(folder), store(struct.pack(f"<{len(small)}I", *small).ljust(512, b"\xff")) if small else STOP
    at_table = len(sectors)
    table.append(TABLE)
    fat = struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff")
    head = legacy.MAGIC + b"\0" * 16 + struct.pack("<HHHHH6x", 0x3E, 3, 0xFFFE, 9, 6) + struct.pack("<9I", 0, 1, at_folder, 0, 4096 if mini else 0, at_small, 1 if small else 0, STOP, 0)
    return (head + struct.pack("<I", at_table)).ljust(512, b"\xff") + b"".join(sectors) + fat


def doc(text, wide=True, encrypted=False):
    raw = text.encode("utf-16-le" if wide else "cp1252")
    main = bytearray(0x400)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200 | (0x0100 if encrypted else 0))
    plan = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400 if wide else 0x40000000 | 0x800, 0)
    clx = b"\x01" + struct.pack("<H", 2) + b"zz" + b"\x02" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return {"WordDocument": bytes(main) + raw, "1Table": clx}


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


@pytest.mark.parametrize("mini", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_word(mini, wide):
    text = "Überschrift\rA\x07B\x07\rsee \x13 HYPERLINK \"x\" \x14this page\x15 now\x0bend\r"
    assert extract.extract("a.doc", compound(doc(text, wide), mini)) == ("indexed", None, "Überschrift\nA\tB\t\nsee this page now\nend\n")


def test_what_cannot_be_read():
    assert extract.extract("a.doc", compound(doc("x", encrypted=True)))[:2] == ("error", "encrypted")
    assert extract.extract("a.doc", compound({"Other": b"x" * 600}))[:2] == ("error", "unsupported compound file")
    whole = compound(doc("words " * 400))
    for cut in range(8, len(whole), 97):  # cut off anywhere: an error or a part, never a crash
        assert extract.extract("a.doc", whole[:cut])[0] in ("error", "indexed", "skipped")
    ring = bytearray(whole)
    struct.pack_into("<I", ring, len(ring) - 512, 0)  # a chain that bites its own tail
    assert extract.extract("a.doc", bytes(ring))[0] in ("error", "indexed", "skipped")


def test_excel():
    first = b"\x05\0\0" + b"shar" + b""
    shared = struct.pack("<II", 2, 2) + struct.pack("<HB", 6, 0) + b"plain!" + struct.pack("<HB", 8, 0) + b"half"
    book = record(0x809, b"\0" * 8) + record(0xFC, shared) + record(0x3C, b"\x01" + "ößя✓".encode("utf-16-le"))
    sheet = record(0x809, b"\0" * 8) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5))
    sheet += record(0x27E, struct.pack("<HHHI", 1, 1, 0, (1234 << 2) | 3)) + record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (7 << 2) | 2, 0, ((-3 & 0x3FFFFFFF) << 2) | 2, 1))
    sheet += record(0x06, struct.pack("<HHHd", 3, 0, 0, 4.0) + b"\0" * 6)
    data = compound({"Workbook": book + sheet}, mini=True)
    del first
    assert extract.extract("a.xls", data)[2] == "plain!\t\thalfößя✓\n2.5\t12.34\n7\t-3\n4"


def test_powerpoint():
    inner = record(0, b"")[:0] + struct.pack("<HHI", 0, 0x0FA0, 8) + "Tité".encode("utf-16-le") + struct.pack("<HHI", 0, 0x0FA8, 5) + b"a\rb c" + struct.pack("<HHI", 0, 0x1234, 2) + b"zz"
    data = compound({"PowerPoint Document": struct.pack("<HHI", 0xF, 0x03E8, len(inner)) + inner})
    assert extract.extract("a.ppt", data)[2] == "Tité\na\nb c"
