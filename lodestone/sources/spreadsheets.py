"""Workbooks as tables, by Spark's Python data source interface.

Register with `spark.dataSource.register(Workbooks)` and read or write the
format `workbooks`. A sheet is a partition; a writing task makes a workbook of
its own, which counts when the job commits. Only the standard library reads and
writes the files; paths are whatever Arrow's file systems reach.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS_IN_SHEET = 1_000_000  # fixed value of the format, rounded down
UNFINISHED = "_unfinished"
NOT_IN_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
ROWS = "file string, sheet string, row long, cells map<string,string>"


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part of the archive) in order."""
    ids = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    target = lambda e: ids[next(v for k, v in e.attrib.items() if k.endswith("}id"))]
    return [(e.get("name"), t[1:] if (t := target(e)).startswith("/") else f"xl/{t}") for e in sheets]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if _tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                e.clear()
    return out


def read_sheet(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row from 1, texts by column from 0) of a sheet, read as a stream; cells
    without a value are absent."""
    shared, at = _shared(book), 0
    with book.open(part) as stream:
        for _, e in ElementTree.iterparse(stream):
            if _tag(e) != "row":
                continue
            at = int(e.get("r") or at + 1)
            cells, place = {}, -1
            for c in e:
                place = _column(c.get("r")) if c.get("r") else place + 1
                value = next((x.text for x in c if _tag(x) == "v"), None)
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                elif c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                if value is not None:
                    cells[place] = value
            yield at, cells
            e.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        from pyarrow import fs

        files, path = _file_system(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.path.endswith(".xlsx") and f"/{UNFINISHED}" not in f.path)
        out = []
        for name in names:
            with files.open_input_file(name) as raw, zipfile.ZipFile(raw) as book:
                out += [Sheet(name, sheet, part) for sheet, part in sheet_parts(book)]
        return out or [Sheet("", "", "")]

    def read(self, sheet: Sheet) -> Iterator[tuple]:
        if not sheet.path:
            return
        files, _ = _file_system(self.path)
        with files.open_input_file(sheet.path) as raw, zipfile.ZipFile(raw) as book:
            head = None
            for row, cells in read_sheet(book, sheet.part):
                if head is None:
                    head = {i: name.strip() for i, name in cells.items()}
                    continue
                yield sheet.path.rpartition("/")[2], sheet.name, row, {head[i]: v for i, v in cells.items() if head.get(i)}


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _cell(self, value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value}</v></c>"
        text = escape(NOT_IN_XML.sub("", str(value)), quote=False)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    def write(self, iterator) -> Written:
        files, path = _file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        files.create_dir(f"{path}/{UNFINISHED}", recursive=True)
        rows, sheets = iter(iterator), 0
        first = next(rows, None)
        if first is None:
            return Written(None)
        with files.open_output_stream(f"{path}/{UNFINISHED}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
            while first is not None:
                sheets += 1
                with book.open(f"xl/worksheets/sheet{sheets}.xml", "w") as part:
                    put = lambda values: part.write(f"<row>{''.join(map(self._cell, values))}</row>".encode())  # noqa: B023, E731
                    part.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    put(self.columns)
                    n = 1
                    while first is not None and n < ROWS_IN_SHEET:
                        put(first)
                        first, n = next(rows, None), n + 1
                    part.write(b"</sheetData></worksheet>")
            self._frame(book, sheets)
        return Written(name)

    def _frame(self, book: zipfile.ZipFile, sheets: int) -> None:
        """What makes the sheets a workbook; fixed values of the format."""
        main, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        numbers = range(1, sheets + 1)
        listed = "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in numbers)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _file_system(self.path)
        for m in messages:
            if m and m.name:
                files.move(f"{path}/{UNFINISHED}/{m.name}", f"{path}/{m.name}")
        files.delete_dir(f"{path}/{UNFINISHED}")

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _file_system(self.path)
        files.delete_dir(f"{path}/{UNFINISHED}")


class Workbooks(DataSource):
    """Rows as (file, sheet, row, cells): the first row of a sheet names its
    columns, empty cells and cells without a name are absent. Writes append."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("workbooks are only appended to")
        return _Writer(self.options["path"], schema.fieldNames())


def named_rows(rows: DataFrame, name: str, url: str, rel: str | None = None) -> DataFrame:
    """(file, sheet, row, name, url, rel, meta) of rows whose name and url
    aren't empty; all other cells that aren't empty are in `meta`."""
    cell = lambda c: F.trim(F.coalesce(F.element_at("cells", c), F.lit("")))
    known = [c for c in (name, url, rel) if c]
    others = F.map_filter(F.transform_values("cells", lambda k, v: F.trim(v)), lambda k, v: ~k.isin(known) & (v != ""))
    kept = rows.filter((cell(name) != "") & (cell(url) != ""))
    return kept.select("file", "sheet", "row", cell(name).alias("name"), cell(url).alias("url"), (cell(rel) if rel else F.lit("")).alias("rel"), others.alias("meta"))
