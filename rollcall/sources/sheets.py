"""Spreadsheets as cells: xlsx, xlsm, xls, ods, csv, tsv and txt files, read as they stream by.

cells_of takes files as rows (path, content), from any store that Spark reads; each file is one task's.
The data source of rollcall.sources.datasource reads files by path and cuts large ones into ranges of rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.xls import xls_cells, xls_sheets

MAX_BYTES, MAX_ROWS, MAX_COLS = 64 << 20, 200_000, 256
CELLS = "file_id string, sheet_idx int, sheet string, row int, col int, text string, error string"
#: Cells that are sent on at a time, and bytes of XML that are read at a time.
BATCH, STEP = 10_000, 1 << 16

Cell = tuple[int, str, int, int, str]


def delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab in the first five lines; the later of these on a tie."""
    head = "\n".join(text.split("\n")[:5])
    return max(",;\t", key=lambda c: (head.count(c), ",;\t".index(c)))


def csv_rows(text: str) -> Iterator[list[str]]:
    """Rows of trimmed fields: doubled quotes inside quotes, a quote opens only an empty field, CR dropped."""
    cut, at, n = delimiter(text), 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        if text.find('"', at, end) >= 0:
            row, at = _quoted_row(text, at, cut)
            yield row
            continue
        line = text[at:end].replace("\r", "")
        at = end + 1
        if line or end < n:
            yield [x.strip() for x in line.split(cut)]


def _quoted_row(text: str, k: int, cut: str) -> tuple[list[str], int]:
    """A row in which quotes occur, and where the next one begins."""
    row, field, quoted, blank, n = [], [], False, True, len(text)
    while k < n:
        c = text[k]
        k += 1
        if quoted:
            if c == '"' and text[k : k + 1] == '"':
                field.append('"')
                blank = False
                k += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
                blank = blank and c.isspace()
        elif c == '"' and blank:
            quoted = True
        elif c == cut:
            row.append("".join(field).strip())
            field, blank = [], True
        elif c == "\n":
            break
        elif c != "\r":
            field.append(c)
            blank = blank and c.isspace()
    return [*row, "".join(field).strip()], k


def csv_grid(text: str) -> list[list[str]]:
    return list(csv_rows(text))


def number_text(raw: str) -> str:
    """A numeric cell as text: whole numbers without a fraction."""
    try:
        x = float(raw)
    except ValueError:
        return raw.strip()
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _column(letters: str) -> int:
    out = 0
    for letter in letters:
        out = out * 26 + ord(letter) - 64
    return out - 1


class _Pull:
    """Walks XML as it streams by, without a tree: handlers put what is ready into out."""

    def __init__(self) -> None:
        self.out: list = []
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler = lambda tag, a: self.start(tag.rpartition(":")[2], a)
        self.parser.EndElementHandler = lambda tag: self.end(tag.rpartition(":")[2])
        self.parser.CharacterDataHandler = self.chars
        self.text: list[str] | None = None

    def chars(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def start(self, tag: str, a: dict) -> None: ...

    def end(self, tag: str) -> None: ...

    def walk(self, file: BinaryIO) -> Iterator:
        while step := file.read(STEP):
            self.parser.Parse(step)
            yield from self.out
            self.out.clear()
        self.parser.Parse(b"", True)
        yield from self.out
        self.out.clear()


class _Shared(_Pull):
    """The shared strings of a workbook; how words sound is no part of them."""

    def start(self, tag: str, a: dict) -> None:
        if tag == "si":
            self.parts, self.sounds = [], 0
        elif tag == "rPh":
            self.sounds += 1
        elif tag == "t" and not self.sounds:
            self.text = []

    def end(self, tag: str) -> None:
        if tag == "si":
            self.out.append("".join(self.parts))
        elif tag == "rPh":
            self.sounds -= 1
        elif tag == "t" and self.text is not None:
            self.parts += self.text
            self.text = None


class _Sheet(_Pull):
    """(row, col, text) of a worksheet. Cells and rows that do not say where they stand follow the one before."""

    def __init__(self, shared: list[str], first: int) -> None:
        super().__init__()
        self.shared, self.first, self.row, self.col, self.inside = shared, first, -1, -1, False
        self.columns: dict[str, int] = {}
        self.span = ""

    def start(self, tag: str, a: dict) -> None:
        if tag == "c":
            ref = a.get("r", "")
            letters = ref.rstrip("0123456789")
            if letters and letters.isalpha() and len(letters) < len(ref):
                if letters not in self.columns:
                    self.columns[letters] = _column(letters.upper())
                self.row, self.col = int(ref[len(letters) :]) - 1, self.columns[letters]
            else:
                self.col += 1
            self.kind, self.value, self.inline, self.inside = a.get("t", "n"), "", [], self.row >= self.first
        elif tag == "row":
            self.row, self.col = int(a["r"]) - 1 if a.get("r", "").isdigit() else self.row + 1, -1
        elif tag in ("v", "t") and self.inside:
            self.text = []
        elif tag == "dimension":
            self.span = a.get("ref", "")

    def end(self, tag: str) -> None:
        if tag == "c" and self.inside:
            if text := self._shown().strip():
                self.out.append((self.row, self.col, text))
            self.inside = False
        elif self.text is not None and tag in ("v", "t"):
            if tag == "v":
                self.value = "".join(self.text)
            else:
                self.inline += self.text
            self.text = None

    def _shown(self) -> str:
        if self.kind == "inlineStr":
            return "".join(self.inline)
        if not self.value or self.kind == "e":
            return ""
        if self.kind == "s":
            k = int(self.value)
            return self.shared[k] if k < len(self.shared) else ""
        if self.kind == "b":
            return "true" if self.value == "1" else "false"
        return self.value if self.kind in ("str", "d") else number_text(self.value)


def _zip(data: bytes | BinaryIO) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    except (OSError, ValueError, zipfile.BadZipFile) as e:  # stores tell it in their own ways
        raise ValueError("File is not a zip file") from e


def _xlsx_sheets(z: zipfile.ZipFile) -> list[tuple[int, str, str]]:
    """(number, name, member) of the worksheets that are there."""
    names = set(z.namelist())
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, s in enumerate(x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
        path = targets.get(next((v for a, v in s.attrib.items() if _local(a) == "id"), ""), "").lstrip("/")
        path = path if path.startswith("xl/") else f"xl/{path}"
        if path in names:
            out.append((k, s.get("name", ""), path))
    return out


def xlsx_cells(data: bytes | BinaryIO, sheet: int | None = None, first: int = 0, last: int | None = None) -> Iterator[Cell]:
    """(sheet_idx, sheet, row, col, text) of the cells with a text, of one sheet or all, of the rows from first
    to before last. Held are the shared strings, and what one step of the XML gives."""
    with _zip(data) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = list(_Shared().walk(f))
        for k, name, path in _xlsx_sheets(z):
            if sheet is not None and k != sheet:
                continue
            with z.open(path) as f:
                for row, col, text in _Sheet(shared, first).walk(f):
                    if last is not None and row >= last:
                        break
                    yield k, name, row, col, text


class _Tables(_Pull):
    """(sheet_idx, sheet, rows again, cells of a row as (col, copies, text)) of an ods file."""

    def __init__(self) -> None:
        super().__init__()
        self.sheet, self.name, self.cells, self.depth, self.cell_at = -1, "", [], 0, 0

    def start(self, tag: str, a: dict) -> None:
        self.depth += 1
        get = lambda name, d="": next((v for k, v in a.items() if k.rpartition(":")[2] == name), d)
        if tag == "table" and not self.cell_at:
            self.sheet, self.name = self.sheet + 1, get("name")
        elif tag == "table-row" and not self.cell_at:
            self.again, self.cells, self.col = int(get("number-rows-repeated", "1")), [], 0
        elif tag in ("table-cell", "covered-table-cell") and not self.cell_at:
            self.cell_at, self.copies, self.parts = self.depth, int(get("number-columns-repeated", "1")), []
            self.number = get("value") if get("value-type") == "float" else None
        elif tag == "p" and self.cell_at and self.depth == self.cell_at + 1:
            self.text = []

    def end(self, tag: str) -> None:
        if tag == "p" and self.text is not None and self.depth == self.cell_at + 1:
            self.parts.append("".join(self.text))
            self.text = None
        elif self.cell_at == self.depth:
            text = number_text(self.number) if self.number is not None else " ".join(self.parts)
            if text.strip():
                self.cells.append((self.col, self.copies, text.strip()))
            self.col += self.copies
            self.cell_at = 0
        elif tag == "table-row" and not self.cell_at:
            self.out.append((self.sheet, self.name, self.again, self.cells))
        self.depth -= 1


def ods_cells(data: bytes | BinaryIO, sheet: int | None = None, first: int = 0, last: int | None = None) -> Iterator[Cell]:
    """As xlsx_cells. Repeated cells and rows are told once in the file and come as often as they stand."""
    with _zip(data) as z, z.open("content.xml") as f:
        at, current = 0, -1
        for k, name, again, cells in _Tables().walk(f):
            at, current = (at if k == current else 0), k
            if cells and sheet in (None, k):
                for row in range(max(at, first), at + again if last is None else min(at + again, last)):
                    yield from ((k, name, row, col + x, text) for col, copies, text in cells for x in range(copies))
            at += again


def csv_cells(data: bytes | BinaryIO, sheet: int | None = None, first: int = 0, last: int | None = None) -> Iterator[Cell]:
    raw = data if isinstance(data, bytes) else data.read()
    for r, row in enumerate(csv_rows(raw.decode("utf-8-sig", "replace"))):
        if last is not None and r >= last:
            break
        if r >= first:
            yield from ((0, "", r, c, t) for c, t in enumerate(row) if t)


def _xls(data: bytes | BinaryIO, sheet: int | None = None, first: int = 0, last: int | None = None) -> Iterator[Cell]:
    yield from xls_cells(data if isinstance(data, bytes) else data.read(), number_text, sheet, first, last)


READERS: dict[str, Callable[..., Iterator[Cell]]] = {"csv": csv_cells, "tsv": csv_cells, "txt": csv_cells, "xlsx": xlsx_cells, "xlsm": xlsx_cells, "ods": ods_cells, "xls": _xls}


def file_cells(path: str, data: bytes | BinaryIO, size: int, **part) -> Iterator[Cell]:
    """Cells of a file, or of a part of it (sheet, first, last), by the ending of its name."""
    if size > MAX_BYTES:
        raise ValueError("too large")
    reader = READERS.get(path.lower().rpartition(".")[2])
    if reader is None:
        raise ValueError("unsupported format")
    return reader(data, **part)


def sheet_spans(path: str, data: BinaryIO) -> list[tuple[int, int | None]]:
    """(sheet_idx, rows) of a workbook's sheets, as far as they say how many rows they have."""
    kind = path.lower().rpartition(".")[2]
    if kind == "xls":
        return [(k, None) for k in range(len(xls_sheets(data.read())[1]))]
    if kind not in ("xlsx", "xlsm"):
        return []
    out: list[tuple[int, int | None]] = []
    with _zip(data) as z:
        for k, _, member in _xlsx_sheets(z):
            with z.open(member) as f:
                head = _Sheet([], 1 << 40)
                head.parser.Parse(f.read(1 << 12))
            last = head.span.rpartition(":")[2].lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ$")
            out.append((k, int(last) if last.isdigit() else None))
    return out


KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
NAMES = [c.strip().split()[0] for c in CELLS.split(",")]


def batches(path: str, cells: Callable[[], Iterator[Cell]], max_rows: int, max_cols: int) -> Iterator[pa.RecordBatch]:
    """Cells as Arrow batches of a bounded size. Where reading fails, what came before stands, and a row has
    the error; where rows or columns lie beyond the limits, a row says how many were left out."""
    out: list[tuple] = []
    rows_cut: dict[int, list[int]] = {}
    cols_cut: dict[int, set[int]] = {}

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], NAMES)
        out.clear()
        return batch

    try:
        for x in cells():
            if x[2] >= max_rows:
                seen = rows_cut.setdefault(x[0], [0, -1])  # how many, and the last of them: rows come in order
                seen[0], seen[1] = seen[0] + (x[2] != seen[1]), x[2]
            elif x[3] >= max_cols:
                cols_cut.setdefault(x[0], set()).add(x[3])
            else:
                out.append((path, *x, None))
                if len(out) >= BATCH:
                    yield made()
        for n, what, most in ((sum(n for n, _ in rows_cut.values()), "rows", max_rows), (sum(map(len, cols_cut.values())), "columns", max_cols)):
            if n:
                out.append((path, None, None, None, None, None, f"{n} {what} beyond the first {most} left out"))
    except Exception as e:  # an unreadable file is a result, not a failed job
        out.append((path, None, None, None, None, None, str(e)[:200] or type(e).__name__))
    if out:
        yield made()


def cells_of(files: DataFrame, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> DataFrame:
    """(file_id, sheet_idx, sheet, row, col, text, error) of files (path, content). A file that cannot be read
    gives a row with its error and no text. Of every kind of file, the first max_rows rows and max_cols
    columns of a sheet are read; where there are more, a row with an error says how many were left out."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for path, data in zip(rows.column(0), rows.column(1)):
                name, raw = path.as_py(), data.as_py() or b""
                yield from batches(name, lambda: file_cells(name, raw, len(raw)), max_rows, max_cols)

    return files.select("path", "content").mapInArrow(each, CELLS)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the spreadsheets of a folder (top level; hidden and lock files left out)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xls,ods,csv,tsv,txt}").load(folder)
    return cells_of(files.where(is_candidate(F.col("path"))))


def is_candidate(path):
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return ~name.startswith(".") & ~name.startswith("~$") & name.rlike(r"(?i)\.(xlsx|xls|xlsm|csv|ods)$|(?i)\.(tsv|txt)$")


#: The longest text that a pack may unfold to, and the version of its contents that is read here.
MAX_PACK, PACK_VERSION = 64 << 20, 1


def _unmasked(body: bytes, seed: int) -> bytes:
    """body with the words of a shift register laid over it: hides a pack from text search, no more."""
    words, whole = [], (1 << 64) - 1
    for _ in range(-(-len(body) // 8)):
        seed ^= seed << 13 & whole
        seed ^= seed >> 7
        seed ^= seed << 17 & whole
        words.append(seed)
    pad = struct.pack(f"<{len(words)}Q", *words)[: len(body)]
    return (int.from_bytes(body, "little") ^ int.from_bytes(pad, "little")).to_bytes(len(body), "little")


def unpack(content: bytes, magic: bytes = b"", seed: int | None = None) -> str:
    """The JSON of a pack: a mark, then raw deflate, under a mask if seed says so."""
    if not content.startswith(magic):
        raise ValueError("not a reference pack")
    body = content[len(magic) :]
    inflate = zlib.decompressobj(-15)
    try:
        text = inflate.decompress(_unmasked(body, seed) if seed else body, MAX_PACK + 1)
    except zlib.error as e:
        raise ValueError("a damaged reference pack") from e
    if len(text) > MAX_PACK:
        raise ValueError("too large")
    if not inflate.eof:
        raise ValueError("a damaged reference pack")
    return text.decode("utf-8")


def open_packs(files: DataFrame, magic: bytes = b"", seed: int | None = None) -> DataFrame:
    """(path, value, error) of pack files (path, content): the JSON of each, or why there is none: no pack,
    damaged, too large, not JSON, or of a version that is not known here."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for path, data in zip(rows.column(0), rows.column(1)):
                value = error = None
                try:
                    value = unpack(data.as_py() or b"", magic, seed)
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([value], pa.string()), pa.array([error], pa.string())], ["path", "value", "error"])

    read = files.select("path", "content").mapInArrow(each, "path string, value string, error string")
    whole = F.try_parse_json("value")
    version = F.try_variant_get(whole, "$.version", "int")
    error = F.coalesce("error", F.when(whole.isNull(), "not JSON").when(version.isNull(), "no version").when(version != PACK_VERSION, F.concat(F.lit("unknown version "), version.cast("string"))))
    return read.select("path", F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))


def read_pack(packs: DataFrame) -> dict[str, DataFrame]:
    """Tables of bundled reference data, JSON texts (column value, see open_packs): edges, name_edges, names,
    academics, baseline."""
    schema = "version int, sources array<string>, edges array<array<string>>, name_edges array<array<string>>, names map<string,string>, academics array<array<string>>, baseline_cgpa array<double>, baseline_branch array<string>"
    p = packs.select(F.from_json("value", schema).alias("p")).select("p.*").where(F.col("version") == PACK_VERSION)
    triple = lambda column, names: p.select(F.posexplode(column).alias("seq", "e")).select(*[F.get("e", F.lit(k)).alias(n) for k, n in enumerate(names)], "seq")
    base = p.select(F.posexplode("baseline_cgpa").alias("seq", "cgpa"), "baseline_branch")
    return {
        "edges": triple("edges", ("neo_id", "reg_no", "confidence")),
        "name_edges": triple("name_edges", ("identifier", "name_key", "confidence")),
        "names": p.select(F.explode("names").alias("name_key", "display")),
        "academics": triple("academics", ("reg_no", "cgpa", "branch")).withColumn("cgpa", F.col("cgpa").try_cast("double")),
        "baseline": base.select("seq", "cgpa", F.get("baseline_branch", F.col("seq")).alias("branch")),
    }


def _letters(k: int) -> str:
    """The letters of column k, counted from 0."""
    out = ""
    while k >= 0:
        k, last = divmod(k, 26)
        out, k = chr(65 + last) + out, k - 1
    return out


def write_xlsx(path: str | BinaryIO, sheet: str, rows: Iterator[list[str]]) -> None:
    """One sheet of strings with a frozen heading and a filter, streamed row by row into a file."""
    from xml.sax.saxutils import escape

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{ns}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            n = width = 0
            for n, row in enumerate(rows, 1):
                width = max(width, len(row))
                cells = "".join(f'<c r="{_letters(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(t or "")}</t></is></c>' for k, t in enumerate(row))
                out.write(f'<row r="{n}">{cells}</row>'.encode())
            span = f'<autoFilter ref="A1:{_letters(max(width, 1) - 1)}{max(n, 1)}"/>' if n else ""
            out.write(f"</sheetData>{span}</worksheet>".encode())
