"""Compound files, and the cells, lines and slides of the legacy office files in them.

A compound file is a file system: sectors in chains, short streams in a stream of their
own, and a directory tree. Every chain is checked against its length, so that a cyclic
or truncated file is a ValueError, which files.parse reports as the file's error."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

from tarnkit.functions.text import SLIDE_NOISE, SLIDE_NOISE_PARTS

# Fixed values of the format.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
LAST_SECTOR, FREE, END, FAT_SECTOR, NO_ENTRY = 0xFFFFFFFA, 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5
SHORT_SECTOR, SHORT_LIMIT = 64, 4096
IMAGE_BYTES = 1024  # smaller pictures are bullets and icons


def _numbers(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])


class CompoundFile:
    """The streams at the top of a compound file, by name."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        if self.size not in (512, 4096):
            raise ValueError("unknown sector size")
        n_fat, first_directory = struct.unpack_from("<II", data, 44)
        self.cutoff, first_short, n_short, next_list, n_lists = struct.unpack_from("<IIIII", data, 56)
        places = list(_numbers(data[76:512]))
        for _ in range(n_lists):
            part = _numbers(self._sector(next_list))
            places, next_list = [*places, *part[:-1]], part[-1]
        self.table = [x for p in places[:n_fat] for x in _numbers(self._sector(p))]
        self.short_table = _numbers(self._chain(first_short, n_short * self.size)) if n_short else ()
        directory = self._chain(first_directory)
        self.entries = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
        start, size = self._place(self.entries[0])
        self.short_stream = self._chain(start, size) if size else b""
        self.streams = {self._name(e): e for e in self._children(struct.unpack_from("<I", self.entries[0], 76)[0]) if e[66] == STREAM}

    def _sector(self, k: int) -> bytes:
        body = self.data[(k + 1) * self.size : (k + 2) * self.size] if k < LAST_SECTOR else b""
        if not body:
            raise ValueError(f"sector {k} is beyond the end of the file")
        return body

    def _chain(self, start: int, size: int | None = None) -> bytes:
        parts, k = [], start
        while k != END:
            if len(parts) > len(self.table) or k >= len(self.table):
                raise ValueError("a chain of sectors doesn't end")
            parts.append(self._sector(k))
            k = self.table[k]
        return self._cut(b"".join(parts), size)

    def _cut(self, body: bytes, size: int | None) -> bytes:
        if size is not None and len(body) < size:
            raise ValueError("a stream is shorter than its entry says")
        return body if size is None else body[:size]

    def _place(self, entry: bytes) -> tuple[int, int]:
        start, low, high = struct.unpack_from("<III", entry, 116)
        return start, low | high << 32 if self.size == 4096 else low

    @staticmethod
    def _name(entry: bytes) -> str:
        return entry[: max(0, struct.unpack_from("<H", entry, 64)[0] - 2)].decode("utf-16-le")

    def _children(self, k: int) -> Iterator[bytes]:
        """The entries of a storage, whose siblings are a binary tree."""
        todo, seen = [k], set()
        while todo:
            k = todo.pop()
            if k == NO_ENTRY:
                continue
            if k in seen or k >= len(self.entries):
                raise ValueError("the directory isn't a tree")
            seen.add(k)
            yield self.entries[k]
            todo += struct.unpack_from("<II", self.entries[k], 68)

    def read(self, name: str) -> bytes:
        """A stream's bytes; a KeyError where there is none of that name."""
        start, size = self._place(self.streams[name])
        if size >= self.cutoff:
            return self._chain(start, size)
        parts, k = [], start
        while k != END and size:
            if len(parts) > len(self.short_table) or k >= len(self.short_table):
                raise ValueError("a chain of short sectors doesn't end")
            parts.append(self.short_stream[k * SHORT_SECTOR : (k + 1) * SHORT_SECTOR])
            k = self.short_table[k]
        return self._cut(b"".join(parts), size)


class _Pieces:
    """A record and the records that continue it, read as one; characters that go on in the next start with a flag again."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def _left(self) -> int:
        while self.part < len(self.parts) - 1 and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return len(self.parts[self.part]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            size = min(n - len(out), self._left())
            if size <= 0:
                raise ValueError("a record ends too early")
            out += self.parts[self.part][self.at : self.at + size]
            self.at += size
        return out

    def text(self, n: int) -> str:
        """A string of n characters with its flags, runs and extension."""
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.parts[self.part]):
                self._left()
                wide = self.take(1)[0] & 1
            size = min(n, max(1, self._left() >> wide))
            out.append(self.take(size << wide).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= size
        self.take(4 * runs + more)
        return "".join(out)


def _records(data: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """The records from a place on up to the end of their substream, each with those that continue it."""
    kind, parts = None, []
    while at + 4 <= len(data):
        new, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("a record ends beyond the stream")
        at += 4 + size
        if new == 0x3C and kind is not None:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        if new == 0x0A:
            return
        kind, parts = new, [body]
    if kind is not None:
        yield kind, parts


def _rk(value: int) -> float:
    """A number in 30 bits: an integer or the upper bits of a double, perhaps times 100."""
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def _shown(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def _cells(data: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """Row, column and text of a sheet's cells."""
    pending = None
    for kind, parts in _records(data, at):
        body = parts[0]
        row, column = struct.unpack_from("<HH", body) if len(body) >= 4 else (0, 0)
        if kind == 0xFD:
            yield row, column, shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind == 0x204:
            pieces = _Pieces([body[8:], *parts[1:]])
            yield row, column, pieces.text(struct.unpack_from("<H", body, 6)[0])
        elif kind == 0x203:
            yield row, column, _shown(struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x27E:
            yield row, column, _shown(_rk(struct.unpack_from("<I", body, 6)[0]))
        elif kind == 0xBD:
            for k in range((len(body) - 6) // 6):
                yield row, column + k, _shown(_rk(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        elif kind == 0x205 and not body[7]:
            yield row, column, "TRUE" if body[6] else "FALSE"
        elif kind == 0x06:
            if body[12:14] != b"\xff\xff":
                yield row, column, _shown(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 1:
                yield row, column, "TRUE" if body[8] else "FALSE"
            pending = (row, column) if body[12:14] == b"\xff\xff" and body[6] == 0 else None
        elif kind == 0x207 and pending:
            yield *pending, _Pieces([body[2:], *parts[1:]]).text(struct.unpack_from("<H", body)[0])
            pending = None


def xls(data: bytes) -> tuple[str, list]:
    """A line "Sheet-row,column: value", counted from 1, for each cell that holds something, row by row."""
    file = CompoundFile(data)
    book = file.read("Workbook")
    shared: list[str] = []
    sheets = []
    for kind, parts in _records(book, 0):
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85:
            sheets.append((struct.unpack_from("<I", parts[0])[0], _Pieces([parts[0][7:]]).text(parts[0][6])))
        elif kind == 0xFC:
            pieces = _Pieces([parts[0][8:], *parts[1:]])
            shared = [pieces.text(struct.unpack("<H", pieces.take(2))[0]) for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
    lines = []
    for at, name in sheets:
        for row, column, value in sorted(_cells(book, at, shared), key=lambda c: c[:2]):
            if value.strip():
                lines.append(f"{name}-{row + 1},{column + 1}: {value.strip()}")
    return "\n".join(lines), []


def doc(data: bytes) -> tuple[str, list]:
    """The text of a document by its table of pieces; lines end at paragraph marks and cells."""
    file = CompoundFile(data)
    body = file.read("WordDocument")
    flags = struct.unpack_from("<H", body, 10)[0] if len(body) > 12 else 0
    if flags & 0x100:
        raise ValueError("the document is encrypted")
    table = file.read("1Table" if flags & 0x200 else "0Table")
    start, size = struct.unpack_from("<II", body, 0x1A2) if len(body) >= 0x1AA else (0, 0)
    pieces = table[start : start + size]
    at = 0
    while pieces[at : at + 1] == b"\1":  # properties come before the table
        at += 3 + struct.unpack_from("<H", pieces, at + 1)[0]
    if pieces[at : at + 1] != b"\2" or len(pieces) < size:
        raise ValueError("the document has no table of pieces")
    n = (struct.unpack_from("<I", pieces, at + 1)[0] - 4) // 12
    ends, out = struct.unpack_from(f"<{n + 1}I", pieces, at + 5), []
    for k, (a, b) in enumerate(pairwise(ends)):
        place = struct.unpack_from("<I", pieces, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        narrow, place = place & 0x40000000, place & 0x3FFFFFFF
        part = body[place // 2 : place // 2 + b - a] if narrow else body[place : place + 2 * (b - a)]
        if b < a or len(part) < (b - a) * (1 if narrow else 2):
            raise ValueError("a piece lies beyond the document")
        out.append(part.decode("cp1252" if narrow else "utf-16-le", "replace"))
    marks = dict.fromkeys(range(32)) | {9: "\t", 7: "\t", 11: "\n", 13: "\n"}
    return "".join(out).translate(marks), []


def _atoms(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Type, instance and body of the records that hold no others, in order."""
    at = 0
    while at + 8 <= len(data):
        version, kind, size = struct.unpack_from("<HHI", data, at)
        at += 8
        if size > len(data) - at:
            raise ValueError("a record ends beyond the stream")
        if version & 15 != 15:
            yield kind, version >> 4, data[at : at + size]
            at += size


def ppt(data: bytes) -> tuple[str, list]:
    """The text atoms of a presentation but the master's placeholders, a line each, and its JPEG and PNG pictures."""
    file = CompoundFile(data)
    lines = []
    for kind, _, body in _atoms(file.read("PowerPoint Document")):
        if kind in (0x0FA0, 0x0FA8):
            text = body.decode("utf-16-le" if kind == 0x0FA0 else "latin-1", "replace").strip()
            if text and text not in SLIDE_NOISE and not any(p in text for p in SLIDE_NOISE_PARTS):
                lines.append(text.replace("\r", "\n").replace("\v", "\n"))
    images = []
    for kind, instance, body in _atoms(file.read("Pictures")) if "Pictures" in file.streams else ():
        body = body[33 if instance & 1 else 17 :]  # one or two digests and a tag
        if kind in (0xF01D, 0xF01E) and len(body) >= IMAGE_BYTES:
            images.append({"name": f"picture{len(images) + 1}.{'jpg' if kind == 0xF01D else 'png'}", "data": body})
    return "\n".join(lines), images


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of these streams, at most 109 * 64 kB in all."""
    sectors: list[bytes] = []
    table: list[int] = []

    def put(body: bytes) -> int:
        if not body:
            return END
        first, n = len(sectors), -(-len(body) // 512)
        sectors.extend(body[512 * k : 512 * (k + 1)].ljust(512, b"\0") for k in range(n))
        table.extend([*range(first + 1, first + n), END])
        return first

    short, short_table, entries = b"", [], []
    for name, body in streams.items():
        if len(body) < SHORT_LIMIT:
            start, n = (len(short_table), -(-len(body) // SHORT_SECTOR)) if body else (END, 0)
            short_table += [*range(start + 1, start + n), END] if n else []
            short += body.ljust(n * SHORT_SECTOR, b"\0")
        else:
            start = put(body)
        entries.append((name, STREAM, start, len(body)))
    entries.insert(0, ("Root Entry", ROOT, put(short), len(short)))
    directory = b""
    for k, (name, kind, start, size) in enumerate(entries):
        raw = name.encode("utf-16-le")
        after = k + 1 if 0 < k < len(entries) - 1 else NO_ENTRY
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, NO_ENTRY, after, 1 if k == 0 and len(entries) > 1 else NO_ENTRY) + bytes(36) + struct.pack("<III", start, size, 0)
    while len(directory) % 512:
        directory += bytes(66) + b"\0" + bytes(1) + struct.pack("<III", NO_ENTRY, NO_ENTRY, NO_ENTRY) + bytes(48)
    first_directory, n_short = put(directory), -(-len(short_table) // 128)
    first_short = put(struct.pack(f"<{n_short * 128}I", *short_table, *[FREE] * (n_short * 128 - len(short_table))))
    n_fat = 1
    while n_fat * 128 < len(table) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too large")
    first_fat = len(table)
    table += [FAT_SECTOR] * n_fat
    fat = struct.pack(f"<{n_fat * 128}I", *table, *[FREE] * (n_fat * 128 - len(table)))
    lists = [*range(first_fat, first_fat + n_fat), *[FREE] * (109 - n_fat)]
    header = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<II", n_fat, first_directory) + bytes(4) + struct.pack("<IIIII", SHORT_LIMIT, first_short, n_short, END, 0) + struct.pack("<109I", *lists)
    return header + b"".join(sectors) + fat


def write_xls(sheet: str, rows: list[list[float | str]]) -> bytes:
    """A workbook of one sheet with these rows of numbers and strings."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    named = sheet.encode("utf-16-le")
    begin = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    size = len(begin) + 4 + 8 + len(named) + 4
    head = begin + record(0x85, struct.pack("<IBBBB", size, 0, 0, len(sheet), 1) + named) + record(0x0A, b"")
    cells = [record(0x809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0))]
    for r, row in enumerate(rows):
        for c, value in enumerate(row):
            if isinstance(value, str):
                text = value.encode("utf-16-le")
                cells.append(record(0x204, struct.pack("<HHHHB", r, c, 0, len(text) // 2, 1) + text))
            elif value is not None:
                cells.append(record(0x203, struct.pack("<HHHd", r, c, 0, value)))
    return write_compound({"Workbook": head + b"".join(cells) + record(0x0A, b"")})
