"""Spreadsheet workbooks: a data source that reads the XML of a sheet row by row, and pages written as workbooks.

``WorkbookSource`` has one partition for each file and sheet. It parses the
sheet's XML from the zip as a stream, so a task holds one batch of rows and the
workbook's table of distinct texts, however long the sheet is. Files must be
readable where tasks run (a shared folder).
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.errors import SpecError
from plumbline.sources.files import clean_names

#: Rows of a batch, and rows that a written page may have.
BATCH, MOST_ROWS = 2_000, 10_000
#: Namespaces of the format's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Fixed value: the day that serial numbers count from.
EPOCH = datetime(1899, 12, 30)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and path of each sheet, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), targets[s.get(RELATION)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in found]


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{MAIN}si":
                out.append("".join(x.text or "" for x in e.iter(f"{MAIN}t")))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    styles = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, texts: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(f"{MAIN}t")) or None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return texts[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(cell.get("s", -1)) in dates:
        at = EPOCH + timedelta(microseconds=round(float(value.text) * 86_400_000) * 1000)
        return at.strftime("%Y-%m-%d" if at == at.replace(hour=0, minute=0, second=0, microsecond=0) else "%Y-%m-%dT%H:%M:%S")
    return None if kind == "e" else value.text


def sheet_rows(book: zipfile.ZipFile, path: str, texts: list[str], dates: set[int]) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number (from 1) and values by column of each row that the sheet holds; parsed rows are let go."""
    with book.open(path) as part:
        number, data = 0, None
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            if event == "start" and e.tag == f"{MAIN}sheetData":
                data = e
            elif event == "end" and e.tag == f"{MAIN}row":
                number = int(e.get("r", number + 1))
                cells, at = {}, -1
                for cell in e.iter(f"{MAIN}c"):
                    at = column_number(cell.get("r")) if cell.get("r") else at + 1
                    v = _value(cell, texts, dates)
                    if v is not None:
                        cells[at] = v
                yield number, cells
                data.clear()


def _files(path: str) -> list[str]:
    found = sorted(f for p in path.split(",") for f in (glob.glob(os.path.join(p, "*.xlsx")) if os.path.isdir(p) else glob.glob(p) or [p]))
    if not found:
        raise SpecError(f"no workbooks: {path}")
    return found


class _Sheet(InputPartition):
    def __init__(self, file: str, name: str, path: str) -> None:
        self.file, self.name, self.path = file, name, path


class _Reader(DataSourceReader):
    def __init__(self, sheets: list[_Sheet], width: int) -> None:
        self.sheets, self.width = sheets, width

    def partitions(self) -> list[_Sheet]:
        return self.sheets

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet", "row", *(f"c{i}" for i in range(self.width))]

        def batch(rows: list[tuple[int, dict[int, str]]]) -> pa.RecordBatch:
            columns = [pa.array([c.get(i) for _, c in rows], pa.string()) for i in range(self.width)]
            fixed = [pa.array([x] * len(rows), pa.string()) for x in (partition.file, partition.name)]
            return pa.RecordBatch.from_arrays([*fixed, pa.array([n for n, _ in rows], pa.int64()), *columns], names)

        with zipfile.ZipFile(partition.file) as book:
            held: list[tuple[int, dict[int, str]]] = []
            for row in sheet_rows(book, partition.path, _texts(book), _date_styles(book)):
                held.append(row)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("sheet", 0).load(path)``: file, sheet, row and the cells c0, c1, ... as text.

    ``sheet`` is a number or a name, ``*`` for all. As many columns come out as
    the widest of the sheets has.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _chosen(self) -> list[_Sheet]:
        wanted, out = str(self.options.get("sheet", "0")), []
        for file in _files(self.options["path"]):
            with zipfile.ZipFile(file) as book:
                sheets = _sheets(book)
            chosen = sheets if wanted == "*" else [s for i, s in enumerate(sheets) if wanted in (str(i), s[0])]
            if not chosen:
                raise SpecError(f"no sheet {wanted} in {file}")
            out += [_Sheet(file, *s) for s in chosen]
        return out

    def _width(self) -> int:
        """Columns of the widest sheet: by its dimension if that is given, else by a pass over its rows."""
        most = 0
        for s in self._chosen():
            with zipfile.ZipFile(s.file) as book:
                with book.open(s.path) as part:
                    head = re.search(rb'<dimension ref="[A-Z]+\d+:([A-Z]+)\d+"', part.read(4096))
                if head:
                    most = max(most, column_number(head[1].decode()) + 1)
                else:
                    most = max([most, *(max(c) + 1 for _, c in sheet_rows(book, s.path, _texts(book), set()) if c)])
        return most

    def schema(self) -> T.StructType:
        fixed = [T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType())]
        return T.StructType([*fixed, *(T.StructField(f"c{i}", T.StringType()) for i in range(self._width()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._chosen(), len(schema) - 3)


def without_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with some value in the columns, and of these only the ones that have a value in some row: one pass."""
    seen = df.agg(*(F.count(c).alias(c) for c in columns)).first() if columns else {}
    kept = [c for c in columns if seen[c]]
    some = df.where(F.coalesce(*kept).isNotNull()) if kept else df.limit(0)
    return some.drop(*(c for c in columns if c not in kept))


def read_workbook(spark: SparkSession, path: str, sheet: int | str = 0, header: bool = True) -> DataFrame:
    """One sheet of a workbook as a table of texts, with the rules of an import.

    If the first row has an empty cell, rows and columns without any value are
    left out, as a sheet often has a margin. The first row that is left names
    the columns; blank names get numbers and repeated ones as well. Without
    ``header`` columns are numbered. ``row`` keeps each row's number in the sheet.
    """
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("sheet", str(sheet)).load(path)
    columns = rows.columns[3:]
    first = rows.orderBy("row").first()
    if first is None:
        return rows.select("row")
    if first["row"] > 1 or any(first[c] is None for c in columns):
        rows = without_empty(rows, columns)
        columns = rows.columns[3:]
        first = rows.orderBy("row").first()
    if not header or first is None:
        return rows.select("row", *(F.col(c).alias(f"column_{i}") for i, c in enumerate(columns)))
    names = clean_names([first[c] or "" for c in columns])
    return rows.where(F.col("row") > first["row"]).select(F.col("row"), *(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))


def documents_from_rows(df: DataFrame, key: str, fields: dict[str, str], lists: dict[str, dict[str, str]] | None = None, order: str | None = None) -> DataFrame:
    """Rows of a sheet as nested documents, one for each key.

    ``fields`` name the column of each dotted path ("tender.value.amount"), whose
    value is that of the first row with one; ``lists`` gather an object from each
    row, without those that are empty. ``order`` is the column that tells which
    row is first (the key's other columns if none is given).
    """
    first = F.struct(*([order] if order else []), *(c for c in df.columns if c not in (key, order)))
    values = {p: F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), first)) for p, c in fields.items()}
    gathered = {}
    for name, parts in (lists or {}).items():
        some = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in parts.values())).isNotNull()
        one = F.struct(first.alias("_at"), F.struct(*(F.col(f"`{c}`").alias(n) for n, c in parts.items())).alias("_is"))
        gathered[name] = F.transform(F.array_sort(F.collect_list(F.when(some, one))), lambda x: x["_is"])
    made = df.where(F.col(key).isNotNull()).groupBy(key).agg(*(v.alias(f"_f{i}") for i, v in enumerate(values.values())), *(v.alias(f"_l{i}") for i, v in enumerate(gathered.values())))

    def nested(paths: dict[tuple[str, ...], str]) -> list[Column]:
        out = []
        for head in dict.fromkeys(p[0] for p in paths):
            below = {p[1:]: c for p, c in paths.items() if p[0] == head}
            if () in below and len(below) > 1:
                raise SpecError(f"{head} is a value and an object")
            out.append((F.col(below[()]) if () in below else F.struct(*nested(below))).alias(head))
        return out

    columns = nested({tuple(p.split(".")): f"_f{i}" for i, p in enumerate(values)} | {tuple(p.split(".")): f"_l{i}" for i, p in enumerate(gathered)})
    return made.select(key, *columns)


def write_workbook(df: DataFrame, path: str, order: str, page: int = 0, size: int = MOST_ROWS) -> int:
    """One page of rows in an order as a workbook of one sheet, with a header; returns its rows. A page has at most ``MOST_ROWS``."""
    rows = df.orderBy(order).offset(page * size).limit(min(size, MOST_ROWS)).collect()

    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, package = MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006"
    office = RELATION[1 : RELATION.index("}")]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="page" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
        book.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return len(rows)
