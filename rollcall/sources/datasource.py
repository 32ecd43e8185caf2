"""Spreadsheets as a Spark data source: read in ranges of rows, written as a workbook for each list.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheets").load("/folder")                      # cells, see sheets.CELLS
    write_workbooks(rows, "/folder", "list_id", ["place"])           # one .xlsx for each list_id

Paths may be local or of any store that Arrow reads (file, hdfs, s3, gs). Files of a store that only Spark
reads go through sheets.cells_of instead.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from itertools import groupby

from pyarrow import RecordBatch
from pyarrow import compute as pc
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from rollcall.sources import sheets

#: Files from this size on are cut into sheets and ranges of rows; smaller ones share a task up to this size.
SPLIT_BYTES = 4 << 20
ENDINGS = re.compile(r"(?i)^(?!\.|~\$).*\.(xlsx|xlsm|xls|ods|csv|tsv|txt)$")


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path


@dataclass
class Piece(InputPartition):
    """Files read whole by one task, or a range of rows of one sheet of a file."""

    files: list[tuple[str, int]]
    sheet: int | None = None
    first: int = 0
    last: int | None = None


@dataclass
class Bounds:
    """What filters leave of a number: bounds, both included, and a set of values."""

    low: int = 0
    high: int = 1 << 40
    among: set[int] | None = None

    def allows(self, x: int) -> bool:
        return self.low <= x <= self.high and (self.among is None or x in self.among)

    def meets(self, first: int, last: int) -> bool:
        """Whether some number from first to before last is allowed."""
        return self.low < last and self.high >= first and (self.among is None or any(first <= x < last for x in self.among))

    def narrow(self, f: Filter) -> bool:
        if isinstance(f, EqualTo):
            self.among = {f.value} & (self.among if self.among is not None else {f.value})
        elif isinstance(f, In):
            self.among = set(f.value) & (self.among if self.among is not None else set(f.value))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True


@dataclass
class SheetReader(DataSourceReader):
    """Small files are dealt out whole, several to a task; large ones sheet by sheet in ranges of rows, as
    many as the sheet says it has. The last range of a sheet goes on to its end, so a sheet that tells
    less than it has is read whole all the same."""

    path: str
    rows_a_part: int
    max_rows: int
    max_cols: int
    bounds: dict[str, Bounds] = field(default_factory=lambda: {c: Bounds() for c in ("sheet_idx", "row", "col")})
    filtered: bool = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters of sheet, row and column are met here: parts that they rule out are not read. Rows that
        tell an error have no such number, so they go."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds and self.bounds[name].narrow(f):
                self.filtered = True
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        store, path = store_of(self.path)
        folder, _, pattern = path.rpartition("/")
        if any(c in pattern for c in "*?["):
            found = [x for x in store.get_file_info(stores.FileSelector(folder or "/")) if fnmatch(x.base_name, pattern)]
        else:
            info = store.get_file_info(path.rstrip("/"))
            if info.type == stores.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [info] if info.is_file else store.get_file_info(stores.FileSelector(info.path))
        return sorted((x.path, x.size) for x in found if x.is_file and ENDINGS.match(x.base_name))

    def partitions(self) -> list[Piece]:
        out, small, total = [], [], 0
        store, _ = store_of(self.path)
        for path, size in self._files():
            cut = self._cut(store, path, size) if SPLIT_BYTES <= size <= sheets.MAX_BYTES else []
            if cut:
                out += cut
                continue
            if small and total + size > SPLIT_BYTES:
                out.append(Piece(small))
                small, total = [], 0
            small, total = [*small, (path, size)], total + size
        return out + [Piece(small)] * bool(small)

    def _cut(self, store: stores.FileSystem, path: str, size: int) -> list[Piece]:
        try:
            with store.open_input_file(path) as f:
                spans = sheets.sheet_spans(path, f)
        except Exception:  # read whole, where it becomes a row with its error
            return []
        out = []
        for k, rows in spans:
            n = max(1, min(rows or self.max_rows, self.max_rows))
            starts = list(range(0, n, self.rows_a_part))
            for first, last in zip(starts, [*starts[1:], None]):
                if self.bounds["sheet_idx"].allows(k) and self.bounds["row"].meets(first, 1 << 40 if last is None else last):
                    out.append(Piece([(path, size)], k, first, last))
        return out or [Piece([])]

    def read(self, piece: Piece) -> Iterator[RecordBatch]:
        store, _ = store_of(self.path)
        for path, size in piece.files:

            def cells() -> Iterator[sheets.Cell]:
                with store.open_input_file(path) as f:
                    yield from sheets.file_cells(path, f, size, sheet=piece.sheet, first=piece.first, last=piece.last)

            for batch in sheets.batches(path, cells, self.max_rows, self.max_cols):
                yield self._left(batch) if self.filtered else batch

    def _left(self, batch: RecordBatch) -> RecordBatch:
        for name, b in self.bounds.items():
            x = batch.column(name)
            keep = pc.and_(pc.greater_equal(x, b.low), pc.less_equal(x, min(b.high, (1 << 31) - 1)))
            if b.among is not None:
                keep = pc.and_(keep, pc.is_in(x, value_set=sheets.pa.array(sorted(b.among), sheets.pa.int32())))
            batch = batch.filter(pc.fill_null(keep, False))
        return batch


@dataclass
class Written(WriterCommitMessage):
    """The workbooks of one task: where they lie until all tasks are done, and their names."""

    files: list[tuple[str, str]]


@dataclass
class SheetWriter(DataSourceWriter):
    """Each run of rows with one value of the group column becomes a workbook under a name that nobody
    reads; commit gives all of them their own, abort deletes them. A list in two tasks is an error."""

    path: str
    group: str
    columns: list[str]

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = store_of(self.path)
        made: list[tuple[str, str]] = []
        store.create_dir(folder)
        for key, rows in groupby(iterator, key=lambda r: r[self.group]):
            name = re.sub(r"[^\w.-]+", "_", "none" if key is None else str(key))
            waiting = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(waiting) as out:
                lines = ([None if r[c] is None else str(r[c]) for c in self.columns] for r in rows)
                sheets.write_xlsx(out, "Sheet1", _headed(self.columns, lines))
            made.append((waiting, f"{folder}/{name}.xlsx"))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        all_ = [x for m in messages if m for x in m.files]
        if len({name for _, name in all_}) < len(all_):
            self.abort(messages)
            raise ValueError("a list came from two tasks, or two lists have one name")
        for waiting, name in all_:
            store.move(waiting, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for waiting, _ in (x for m in messages if m for x in m.files):
            if store.get_file_info(waiting).is_file:
                store.delete_file(waiting)


def _headed(columns: list[str], rows: Iterator[list]) -> Iterator[list]:
    yield columns
    yield from rows


class SheetSource(DataSource):
    """Options: rowsPerPart (50,000), maxRows, maxCols when reading; group (a column) when writing."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return sheets.CELLS

    def reader(self, schema: StructType) -> SheetReader:
        get = lambda name, d: int(self.options.get(name, d))
        return SheetReader(self.options["path"], get("rowsPerPart", 50_000), get("maxRows", sheets.MAX_ROWS), get("maxCols", sheets.MAX_COLS))

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        group = self.options["group"]
        return SheetWriter(self.options["path"], group, [c for c in schema.names if c != group])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)


def write_workbooks(rows: DataFrame, folder: str, group: str, order: list[str | Column]) -> None:
    """A workbook folder/<group>.xlsx for each value of group, with the other columns in the given order of
    rows. Lists are spread over tasks, and a task streams one after the other; the folder gets all of
    them when the last is done, or none."""
    register(rows.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows.repartition(group).sortWithinPartitions(group, *order).write.format("sheets").option("group", group).mode("append").save(folder)
