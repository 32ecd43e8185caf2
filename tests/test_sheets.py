"""Spreadsheets: .xls against its .xlsx twin, streaming readers, the data source."""

import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.sources import datasource, sheets
from rollcall.sources.xls import xls_cells
from xls_writer import compound, workbook

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def xlsx(path, book, dimension=True):
    """A workbook of sheets (name -> {(row, col): value}) with shared strings and typed cells."""
    shared = list(dict.fromkeys(v for s in book.values() for v in s.values() if isinstance(v, str)))
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(book)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(book))) + "</R>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f'<si><t xml:space="preserve">{esc(t)}</t><rPh><t>sound</t></rPh></si>' for t in shared) + "</sst>")
        for k, cells in enumerate(book.values()):
            with z.open(f"xl/worksheets/s{k}.xml", "w") as out:
                last = max((r for r, _ in cells), default=0) + 1
                out.write((f'<worksheet xmlns="{NS}">' + (f'<dimension ref="A1:IV{last}"/>' if dimension else "") + "<sheetData>").encode())
                for row in sorted({r for r, _ in cells}):
                    out.write(f'<row r="{row + 1}">'.encode())
                    for (_, c), v in sorted((x for x in cells.items() if x[0][0] == row), key=lambda x: x[0]):
                        ref = f"{sheets._letters(c)}{row + 1}"
                        if isinstance(v, bool):
                            out.write(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'.encode())
                        elif isinstance(v, tuple):
                            out.write((f'<c r="{ref}" t="str"><f>A1</f><v>{esc(v[0])}</v></c>' if isinstance(v[0], str) else f'<c r="{ref}"><f>A1</f><v>{v[0]!r}</v></c>').encode())
                        elif v is None:
                            out.write(f'<c r="{ref}" t="e"><v>#N/A</v></c>'.encode())
                        elif isinstance(v, str):
                            out.write(f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'.encode())
                        else:
                            out.write(f'<c r="{ref}"><v>{v!r}</v></c>'.encode())
                    out.write(b"</row>")
                out.write(b"</sheetData></worksheet>")


def book_of(seed, rows=30, cols=9):
    rng = random.Random(seed)
    word = lambda: rng.choice([f"A{rng.randrange(10)}B2C3D{rng.randrange(10)}", "Ümit Özil", "łódź " * rng.randrange(1, 40), "x" * rng.randrange(1, 90), " ", "a & b < c"])
    value = lambda: rng.choice([word(), word(), rng.randrange(-9, 10_000), rng.randrange(1, 900) / 100, rng.random() * 1e9, True, False, None, (word(),), (rng.random(),)])
    return {name: {(r, c): value() for r in range(rows) for c in range(cols) if rng.random() < 0.7} for name in ("First", "Zwölf")} | {"Empty": {}}


@pytest.mark.parametrize("seed, limit, pad", [(1, 8224, 0), (2, 60, 0), (3, 37, 0), (4, 8224, 15_000)])
def test_xls_equals_its_xlsx_twin(tmp_path, seed, limit, pad):
    book = book_of(seed, rows=4 if seed == 3 else 30)
    xlsx(tmp_path / "a.xlsx", book)
    twin = list(sheets.xlsx_cells((tmp_path / "a.xlsx").read_bytes()))
    raw = compound(workbook(book, limit, labels=("Ümit Özil",)), pad=pad)
    assert sorted(xls_cells(raw, sheets.number_text)) == sorted(twin) and len(twin) > 40
    assert sorted(xls_cells(raw, sheets.number_text, 1, 2, 4)) == sorted(x for x in twin if x[0] == 1 and 2 <= x[2] < 4)
    assert [x[:2] for x in sheets._xlsx_sheets(zipfile.ZipFile(tmp_path / "a.xlsx"))] == [(0, "First"), (1, "Zwölf"), (2, "Empty")]


def test_short_xls_lies_in_small_sectors():
    raw = workbook({"S": {(0, 0): "hi", (2, 300): 7}})
    assert len(raw) < 4096
    assert list(xls_cells(compound(raw), sheets.number_text)) == [(0, "S", 0, 0, "hi"), (0, "S", 2, 300, "7")]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.binary(min_size=1, max_size=4))
def test_damaged_xls_ends(at, put):
    """Broken files give cells or a ValueError of some kind, and never hang."""
    raw = bytearray(compound(workbook(book_of(2, 6, 4), 60)))
    k = at % (len(raw) - len(put))
    raw[k : k + len(put)] = put
    list(sheets.batches("x.xls", lambda: sheets.file_cells("x.xls", bytes(raw), len(raw)), 100, 100))


def test_files_come_in_bounded_batches(spark, tmp_path):
    book = {"S": {(r, c): f"v{r % 50}" for r in range(4_000) for c in range(6)}}
    xlsx(tmp_path / "a.xlsx", book)
    with open(tmp_path / "a.xlsx", "rb") as f:
        made = list(sheets.batches("a.xlsx", lambda: sheets.file_cells("a.xlsx", f, 1), 5_000, 100))
    assert max(map(len, made)) == sheets.BATCH and sum(map(len, made)) == 24_000


def test_repeated_cells_and_rows_of_ods(tmp_path):
    table = (
        '<o:document-content xmlns:o="o" xmlns:table="t" xmlns:text="x"><table:table table:name="S"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="300"><text:p>a</text:p></table:table-cell></table:table-row>'
        '<table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row><table:table-row><table:table-cell/><table:table-cell o:value-type="float" o:value="3.0"><o:annotation><text:p>note</text:p></o:annotation><text:p>3,00</text:p></table:table-cell></table:table-row></table:table></o:document-content>'
    )
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", table)
    raw = (tmp_path / "a.ods").read_bytes()
    got = list(sheets.ods_cells(raw))
    assert len(got) == 601 and got[-1] == (0, "S", 1_000_002, 1, "3") and got[:2] == [(0, "S", 0, 0, "a"), (0, "S", 0, 1, "a")]
    rows = [b.to_pylist() for b in sheets.batches("a.ods", lambda: sheets.file_cells("a.ods", raw, 1), 200_000, 256)]
    assert {r["error"] for b in rows for r in b if r["error"]} == {"1 rows beyond the first 200000 left out", "44 columns beyond the first 256 left out"}


@settings(max_examples=200, deadline=None)
@given(st.text('a",;\n\r \t', max_size=40))
def test_csv_rows_equal_one_pass_over_all_characters(text):
    cut, rows, row, field, quoted, blank, k = sheets.delimiter(text), [], [], "", False, True, 0
    while k < len(text):
        c = text[k]
        k += 1
        if quoted:
            if c == '"' and text[k : k + 1] == '"':
                field, blank, k = field + '"', False, k + 1
            elif c == '"':
                quoted = False
            else:
                field, blank = field + c, blank and c.isspace()
        elif c == '"' and blank:
            quoted = True
        elif c == cut:
            row, field, blank = [*row, field.strip()], "", True
        elif c == "\n":
            rows, row, field, blank = [*rows, [*row, field.strip()]], [], "", True
        elif c != "\r":
            field, blank = field + c, blank and c.isspace()
    if field or row:
        rows.append([*row, field.strip()])
    got = sheets.csv_grid(text)
    assert got == rows or got == [*rows, [""]] and not field and not row  # an opened quote alone is an empty row


def test_data_source_reads_ranges_and_filters(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    big = {"S": {(r, c): f"v{r}-{c}" for r in range(900) for c in range(5)}, "T": {(3, 3): "x"}}
    xlsx(folder / "big.xlsx", big)
    xlsx(folder / "vague.xlsx", big, dimension=False)
    (folder / "old.xls").write_bytes(compound(workbook({"U": {(0, 0): "A1B2C3D4"}})))
    (folder / "a.csv").write_text("1,2\n3,4")
    (folder / "broken.xlsx").write_bytes(b"no zip")
    (folder / ".hidden.csv").write_text("x")
    monkeypatch.setattr(datasource, "SPLIT_BYTES", 3_000)
    datasource.register(spark)
    reader = datasource.SheetReader(str(folder), 250, 2_000, 256)
    parts = reader.partitions()
    assert [(p.sheet, p.first, p.last) for p in parts if p.files and p.files[0][0].endswith("big.xlsx")] == [(0, 0, 250), (0, 250, 500), (0, 500, 750), (0, 750, None), (1, 0, None)]
    got = spark.read.format("sheets").option("rowsPerPart", 250).load(str(folder))
    rows = [r.asDict() for r in got.collect()]
    expected = [r.asDict() for r in sheets.read_folder(spark, str(folder)).collect()]
    key = lambda r: (r["file_id"].rpartition("/")[2], *(str(r[c]) for c in ("sheet_idx", "row", "col", "text", "error")))
    assert sorted(map(key, rows)) == sorted(map(key, expected)) and len(rows) == 2 * 4_501 + 6
    some = got.where("sheet_idx = 0 and row >= 251 and row < 260 and col in (1, 4)")
    assert {(r.row, r.col) for r in some.collect()} == {(r, c) for r in range(251, 260) for c in (1, 4)}
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("isnotnull", "") or some.count() == 36
    reader = datasource.SheetReader(str(folder / "big.xlsx"), 250, 2_000, 256)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("sheet_idx",), 0), GreaterThan(("row",), 600), EqualTo(("text",), "x")])) == [EqualTo(("text",), "x")]
    assert [(p.sheet, p.first, p.last) for p in reader.partitions()] == [(0, 500, 750), (0, 750, None)]


def test_workbooks_are_written_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, f"N{k}", None if k % 2 else "nam<e") for k in range(300)], "list_id long, place long, id string, name string")
    folder = str(tmp_path / "out")
    datasource.write_workbooks(rows, folder, "list_id", ["place"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.xlsx", "1.xlsx", "2.xlsx"]
    got = list(sheets.xlsx_cells((tmp_path / "out" / "1.xlsx").read_bytes()))
    assert [x[4] for x in got if x[2] == 0] == ["place", "id", "name"] and [x[4] for x in got if x[3] == 1 and x[2]] == [f"N{k}" for k in range(1, 300, 3)]
    bad = rows.withColumn("id", F.when(F.col("place") == 200, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        datasource.write_workbooks(bad.withColumn("list_id", F.col("list_id") + 10), folder, "list_id", ["place"])
    left = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert left == {"0.xlsx", "1.xlsx", "2.xlsx"}
    writer = datasource.SheetWriter(folder, "list_id", ["id"])
    from pyspark.sql import Row

    one, two = (writer.write(iter([Row(list_id=7, id="a")])) for _ in range(2))
    with pytest.raises(ValueError):
        writer.commit([one, two, None])
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".7-")]
