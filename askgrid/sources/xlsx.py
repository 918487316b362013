"""Spreadsheets as a Python data source: cells and merged ranges, one partition a sheet.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx").load(path)                             # sheet, r, c, v, vtype
    spark.read.format("xlsx").option("relation", "merges").load(path)
    table.write.format("xlsx").mode("overwrite").save(path)          # options sheet, header, footer (JSON rows)

Option ``sheets`` is a comma-separated list of names; all sheets without it. Rows and columns
count from 1. A file's sheets are read by separate tasks with a streaming XML parser. The path of a
folder is all its workbooks; their sheets are then called ``book/sheet``. Numbers that a cell's
style shows as dates are read as dates.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CELLS = "sheet string, r int, c int, v string, vtype string"
MERGES = "sheet string, range_str string, min_row int, max_row int, min_col int, max_col int, rows_spanned int, cols_spanned int, merge_type string"
#: Namespaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Fixed values of the file format: built-in numbers of date and time formats, and rows that a sheet can have.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MOST_ROWS = 1_048_576


def place(ref: str) -> tuple[int, int]:
    """Row and column of a reference such as C4."""
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref.replace("$", "")).groups()
    column = 0
    for x in letters:
        column = 26 * column + ord(x) - 64
    return int(row), column


def merge_type(rows: int, columns: int) -> str:
    return "BOTH" if rows > 1 and columns > 1 else "VERTICAL" if rows > 1 else "HORIZONTAL" if columns > 1 else "NONE"


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in the workbook's order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = [(s.get("name"), rels[s.get(f"{_REL}id")]) for s in root.iter(f"{_MAIN}sheet")]
    return [(n, t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")) for n, t in targets]


def _words(item: ElementTree.Element) -> str:
    """The text of a string and of its formatted runs, without what tells how it is pronounced."""
    return "".join(t.text or "" for t in [*item.findall(f"{_MAIN}t"), *item.findall(f"{_MAIN}r/{_MAIN}t")])


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_words(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    shows = {n for n, code in own.items() if re.search("[dmyhs]", code.lower())} | (DATE_FORMATS - own.keys())
    return {k for k, x in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(x.get("numFmtId", 0)) in shows}


def moment(serial: float, since_1904: bool = False) -> str:
    """A serial day number as text: a date, or a time of day too where it has one. Day 60 of 1900 never was."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    at = start + timedelta(seconds=round(serial * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def cells(book: zipfile.ZipFile, name: str, part: str) -> Iterator[tuple]:
    words, dates = _shared(book), date_styles(book)
    since_1904 = any(x.get("date1904") in ("1", "true") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"))
    r = c = 0
    with book.open(part) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start" and e.tag == f"{_MAIN}row":  # rows and cells without a place follow the ones before them
                r, c = int(e.get("r", r + 1)), 0
            if event == "start" or e.tag != f"{_MAIN}c":
                if event == "end" and e.tag == f"{_MAIN}row":
                    e.clear()
                continue
            r, c = place(e.get("r")) if e.get("r") else (r, c + 1)
            kind, value = e.get("t", "n"), e.findtext(f"{_MAIN}v")
            if kind == "s" and value is not None:
                value, kind = words[int(value)], "STRING"
            elif kind == "inlineStr":
                value, kind = "".join(_words(x) for x in e.findall(f"{_MAIN}is")), "STRING"
            elif kind == "n" and value and int(e.get("s", 0)) in dates:
                value, kind = moment(float(value), since_1904), "DATETIME"
            else:
                kind = {"b": "BOOLEAN", "str": "STRING", "d": "DATETIME", "e": "NULL"}.get(kind, "NUMBER")
                value = {"0": "false", "1": "true"}.get(value, value) if kind == "BOOLEAN" else None if kind == "NULL" else value
            if value is not None and value != "":
                yield name, r, c, value, kind
            e.clear()


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(value, ref: str | None) -> str:
    """A cell; one without a place holds its own even if it is empty."""
    at = f' r="{ref}"' if ref else ""
    if value is None:
        return "" if ref else "<c/>"
    if isinstance(value, bool):
        return f'<c{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c{at}><v>{value!r}</v></c>"
    if isinstance(value, date):
        whole = isinstance(value, datetime)
        since = (value.replace(tzinfo=None) if whole else datetime(value.year, value.month, value.day)) - datetime(1899, 12, 30)
        return f'<c{at} s="{2 if whole else 1}"><v>{since.total_seconds() / 86400!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c{at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _rows(rows: Iterable[list]) -> Iterator[bytes]:
    """Rows with their places."""
    for r, row in enumerate(rows, 1):
        if r > MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
        yield f'<row r="{r}">{"".join(_cell(v, f"{_letters(c)}{r}") for c, v in enumerate(row, 1))}</row>'.encode()


def _follow(row: Iterable) -> bytes:
    """A row that follows the one before it, wherever that is."""
    return f'<row>{"".join(_cell(v, None) for v in row)}</row>'.encode()


def write_workbook(path: str, sheets: dict[str, Iterable[list]], merged: dict[str, list[str]] | None = None) -> None:
    """A workbook of rows of values, streamed row by row; a sheet holds at most MOST_ROWS rows and more raise ValueError."""
    _write_sheets(path, {name: _rows(rows) for name, rows in sheets.items()}, merged)


def _write_sheets(path: str, sheets: dict[str, Iterable[bytes]], merged: dict[str, list[str]] | None = None) -> None:
    """A workbook of sheets whose rows are written already."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _MAIN.strip("{}"), _REL.strip("{}")
    packages = "http://schemas.openxmlformats.org/package/2006"
    with _created(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
        for k, (name, rows) in enumerate(sheets.items(), 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for chunk in rows:
                    out.write(chunk)
                ranges = "".join(f'<mergeCell ref="{x}"/>' for x in (merged or {}).get(name, []))
                out.write(f"</sheetData>{f'<mergeCells>{ranges}</mergeCells>' if ranges else ''}</worksheet>".encode())
        parts = [(k, escape(n, {'"': "&quot;"})) for k, n in enumerate(sheets, 1)]
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>""" for k, n in parts)}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{packages}/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k, _ in parts)}<Relationship Id="rId{len(parts) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>""" for k, _ in parts)}</Types>')


def merges(book: zipfile.ZipFile, name: str, part: str) -> Iterator[tuple]:
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_MAIN}mergeCell":
                first, _, last = e.get("ref").partition(":")
                (r1, c1), (r2, c2) = place(first), place(last or first)
                rows, columns = r2 - r1 + 1, c2 - c1 + 1
                yield name, e.get("ref"), r1, r2, c1, c2, rows, columns, merge_type(rows, columns)


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        self.path, self.name, self.part = path, name, part


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str):
    store, own = _files(path)
    return store.open_input_file(own)


def _created(path: str):
    """A new file, its folder made where it is missing."""
    store, own = _files(path.replace("file:///", "/").removeprefix("file:"))
    if posixpath.dirname(own):
        store.create_dir(posixpath.dirname(own), recursive=True)
    return store.open_output_stream(own)


def _books(path: str) -> list[str]:
    """The workbook, or those of a folder in order of their names."""
    from pyarrow import fs

    store, own = _files(path)
    if store.get_file_info(own).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(own)) if x.path.endswith(".xlsx") and not x.base_name.startswith(("~", ".")))
    return [path.rstrip("/") + "/" + posixpath.basename(x) for x in found]


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.merged = options["path"].replace("file:///", "/").removeprefix("file:"), options.get("relation", "cells") == "merges"
        self.wanted = {s.strip() for s in options["sheets"].split(",")} if options.get("sheets") else None

    def partitions(self) -> list[Sheet]:
        books, out, names = _books(self.path), [], set()
        for path in books:
            with _opened(path) as f, zipfile.ZipFile(f) as book:
                found = sheets(book)
            names |= {n for n, _ in found}
            lead = "" if books == [self.path] else posixpath.basename(path).removesuffix(".xlsx") + "/"
            out += [Sheet(path, lead + n, p) for n, p in found if self.wanted is None or n in self.wanted]
        if self.wanted and self.wanted - names:
            raise ValueError(f"no such sheet: {sorted(self.wanted - names)}")
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with _opened(partition.path) as f, zipfile.ZipFile(f) as book:
            yield from (merges if self.merged else cells)(book, partition.name, partition.part)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: where, the place of its partition, and how many rows."""

    path: str
    partition: int
    rows: int


class XlsxWriter(DataSourceWriter):
    """Tasks write their rows as parts of a sheet; the commit puts the parts that count together.

    Parts lie in a folder beside the workbook that goes with the commit, whatever tasks that were
    killed or tried twice have left in it. The workbook gets its name once it is whole.
    """

    def __init__(self, options: dict, names: list[str]):
        self.path = options["path"].replace("file:///", "/").removeprefix("file:")
        self.sheet, self.names = options.get("sheet", "Sheet1"), names if options.get("header", "true").lower() == "true" else None
        self.footer = json.loads(options.get("footer", "[]"))
        self.folder = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, n = f"{self.folder}/{task.partitionId():06}-{task.taskAttemptId()}", 0
        with _created(path) as out:
            for n, row in enumerate(iterator, 1):
                out.write(_follow(row))
        return Part(path, task.partitionId(), n)

    def _sheet(self, parts: list[Part]) -> Iterator[bytes]:
        yield from (_follow(row) for row in [self.names] if row)
        for p in sorted(parts, key=lambda p: p.partition):
            with _opened(p.path) as f:
                while chunk := f.read(1 << 20):
                    yield chunk
        yield from map(_follow, self.footer)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [p for p in messages if p is not None]
        if sum(p.rows for p in parts) + bool(self.names) + len(self.footer) > MOST_ROWS:
            self.abort(messages)
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
        draft = f"{self.folder}/whole"
        _write_sheets(draft, {self.sheet: self._sheet(parts)})
        store, own = _files(draft)
        store.move(own, _files(self.path)[1])
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, own = _files(self.folder)
        store.delete_dir_contents(own, missing_dir_ok=True)
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return MERGES if self.options.get("relation", "cells") == "merges" else CELLS

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options)

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        if not overwrite:
            raise ValueError("a workbook is replaced, not appended to: mode overwrite")
        return XlsxWriter(self.options, schema.names)
