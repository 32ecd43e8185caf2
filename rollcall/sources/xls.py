"""Cells of .xls workbooks: OLE2 compound files that hold a stream of BIFF records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the file formats: marks of sectors, and numbers of records.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR, ROOT = 0xFFFFFFFA, 5
BOF, EOF, CONTINUE, SST, SHEET, PASSWORD = 0x809, 0x0A, 0x3C, 0xFC, 0x85, 0x2F
LABEL, SHARED_LABEL, RICH_LABEL, NUMBER, RK, MANY_RK, FORMULA, FORMULA_TEXT, BOOL_OR_ERROR = 0x204, 0xFD, 0xD6, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
BIFF8 = 0x600

Cell = tuple[int, str, int, int, str]


class Compound:
    """Streams of an OLE2 file. Sectors are chained by a table (FAT); short streams lie in small sectors
    inside the root's stream, chained by a table of their own."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != SIGNATURE:
            raise ValueError("not a workbook of this format")
        self.data = data
        self.size, self.mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir, _, self.least, first_mini, _, first_difat, _ = struct.unpack_from("<8I", data, 44)
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < LAST_SECTOR]
        while first_difat < LAST_SECTOR and len(tables) < n_fat:
            *more, first_difat = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            tables += [s for s in more if s < LAST_SECTOR]
        self.fat = self._numbers(b"".join(map(self._sector, tables[:n_fat])))
        self.entries = {}
        folder = self._chained(first_dir, self.fat, self._sector)
        for k in range(0, len(folder) - 127, 128):
            name, length, kind, start, size = struct.unpack_from("<64sHB49xIQ", folder, k)
            if kind:
                self.entries[(kind == ROOT, name[: max(length - 2, 0)].decode("utf-16-le", "replace").lower())] = start, size & 0xFFFFFFFF
        self.mini_fat = self._numbers(self._chained(first_mini, self.fat, self._sector))
        root = next((v for (is_root, _), v in self.entries.items() if is_root), (LAST_SECTOR, 0))
        self.mini = self._chained(root[0], self.fat, self._sector)

    @staticmethod
    def _numbers(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size].ljust(self.size, b"\0")

    @staticmethod
    def _chained(start: int, table: tuple[int, ...], sector) -> bytes:
        out = []
        while start < len(table):
            out.append(sector(start))
            if len(out) > len(table):
                raise ValueError("a chain of sectors has no end")
            start = table[start]
        return b"".join(out)

    def stream(self, *names: str) -> bytes:
        """The first stream of these names."""
        for name in names:
            if found := self.entries.get((False, name)):
                start, size = found
                if size < self.least:
                    return self._chained(start, self.mini_fat, lambda k: self.mini[k * self.mini_size : (k + 1) * self.mini_size])[:size]
                return self._chained(start, self.fat, self._sector)[:size]
        raise ValueError("no workbook in the file")


def _records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of the records from an offset on: a record and those that continue it."""
    kind, parts = None, []
    while at + 4 <= len(book):
        number, length = struct.unpack_from("<2H", book, at)
        part = book[at + 4 : at + 4 + length]
        at += 4 + length
        if number == CONTINUE and kind is not None:
            parts.append(part)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = number, [part]
    if kind is not None:
        yield kind, parts


class _Parts:
    """Reads on over the parts of a record. Where characters go on in a new part, a flag at its start says
    anew whether they take one byte or two."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def left(self) -> bool:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        return self.k < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out) and self.left():
            part = self.parts[self.k][self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out

    def number(self, kind: str) -> int:
        raw = self.take(struct.calcsize(kind))
        return struct.unpack(kind, raw)[0] if len(raw) == struct.calcsize(kind) else 0

    def characters(self, n: int, wide: bool) -> str:
        out: list[str] = []
        while n > 0:
            if self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                if not self.left():
                    break
                wide, self.at = bool(self.parts[self.k][0] & 1), 1
            if not self.left():
                break
            part = self.parts[self.k][self.at : self.at + (2 * n if wide else n)]
            self.at += len(part)
            out.append(part.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= len(part) // 2 if wide else len(part)
            if wide and len(part) % 2:
                break
        return "".join(out)

    def text(self, length: str = "<H") -> str:
        """A string with its length and flags, and what follows it (formats, sounds), which is passed over."""
        n, flags = self.number(length), self.number("B")
        runs, extra = self.number("<H") if flags & 8 else 0, self.number("<I") if flags & 4 else 0
        out = self.characters(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return out


def _rk(raw: int) -> float:
    """A number in 30 bits: whole or the high half of a double, in hundredths if bit 0 is set."""
    x = float((raw ^ 0x80000000) - 0x80000000 >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<2I", 0, raw & 0xFFFFFFFC))[0]
    return x / 100 if raw & 1 else x


def xls_sheets(data: bytes) -> tuple[bytes, list[tuple[str, int]], list[str], bool]:
    """The workbook's stream, its worksheets (name, offset), its shared strings, and whether it is BIFF8."""
    book = Compound(data).stream("workbook", "book")
    sheets, shared, new = [], [], True
    for kind, parts in _records(book):
        if kind == BOF and len(parts[0]) >= 2:
            new = struct.unpack_from("<H", parts[0])[0] >= BIFF8
        elif kind == PASSWORD:
            raise ValueError("the workbook has a password")
        elif kind == SHEET and len(parts[0]) > 7 and parts[0][5] == 0:
            offset = struct.unpack_from("<I", parts[0])[0]
            r = _Parts([parts[0][6:]])
            sheets.append((r.text("B") if new else r.take(r.number("B")).decode("cp1252", "replace"), offset))
        elif kind == SST:
            r = _Parts(parts)
            n = struct.unpack("<2I", r.take(8))[1]
            while len(shared) < n and r.left():
                shared.append(r.text())
        elif kind == EOF:
            break
    return book, sheets, shared, new


def _values(kind: int, parts: list[bytes], shared: list[str], new: bool) -> Iterator[tuple[int, int, object]]:
    """(row, column, value) of a record: a text, a number, or a truth value. Errors have none."""
    raw = parts[0]
    row, col = struct.unpack_from("<2H", raw)
    if kind == SHARED_LABEL:
        k = struct.unpack_from("<I", raw, 6)[0]
        yield row, col, shared[k] if k < len(shared) else ""
    elif kind in (LABEL, RICH_LABEL):
        r = _Parts([raw[6:], *parts[1:]])
        yield row, col, r.text() if new else r.take(r.number("<H")).decode("cp1252", "replace")
    elif kind == NUMBER:
        yield row, col, struct.unpack_from("<d", raw, 6)[0]
    elif kind == RK:
        yield row, col, _rk(struct.unpack_from("<I", raw, 6)[0])
    elif kind == MANY_RK:
        for k in range((len(raw) - 6) // 6):
            yield row, col + k, _rk(struct.unpack_from("<I", raw, 6 + 6 * k)[0])
    elif kind == BOOL_OR_ERROR and not raw[7]:
        yield row, col, bool(raw[6])
    elif kind == FORMULA:
        if raw[12:14] != b"\xff\xff":
            yield row, col, struct.unpack_from("<d", raw, 6)[0]
        elif raw[6] == 1:
            yield row, col, bool(raw[8])


SHORTEST = {LABEL: 8, SHARED_LABEL: 10, RICH_LABEL: 8, NUMBER: 14, RK: 10, MANY_RK: 12, BOOL_OR_ERROR: 8, FORMULA: 14}


def xls_cells(data: bytes, number_text, sheet: int | None = None, first: int = 0, last: int | None = None) -> Iterator[Cell]:
    """(sheet_idx, sheet, row, col, text) of the cells with a text, of one sheet or all, of the rows from first
    to before last; number_text writes a number. Results of formulas count, not the formulas."""
    book, sheets, shared, new = xls_sheets(data)
    for k, (name, offset) in enumerate(sheets):
        if sheet is not None and k != sheet:
            continue
        open_formula: tuple[int, int] | None = None
        depth = 0
        for kind, parts in _records(book, offset):
            depth += (kind == BOF) - (kind == EOF)
            if depth <= 0:
                break
            found: Iterator[tuple[int, int, object]] = iter(())
            if depth > 1:
                continue  # a chart inside the sheet
            if kind == FORMULA_TEXT and open_formula:
                r = _Parts(parts)
                found = iter([(*open_formula, r.text() if new else r.take(r.number("<H")).decode("cp1252", "replace"))])
                open_formula = None
            elif kind in SHORTEST and len(parts[0]) >= SHORTEST[kind]:
                if kind == FORMULA and parts[0][12:14] == b"\xff\xff" and parts[0][6] == 0:
                    open_formula = struct.unpack_from("<2H", parts[0])
                found = _values(kind, parts, shared, new)
            for row, col, value in found:
                text = value.strip() if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else number_text(repr(value))
                if text and row >= first and (last is None or row < last):
                    yield k, name, row, col, text
