"""Members of ZIP files and rows of workbooks, read in the executors from the bytes of whole files."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as Xml
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of Office Open XML: namespaces, and the places of a workbook's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BOOK, BOOK_LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files below a path; a file is one row, so it must be under 2 GB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def zip_members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """path, member and content of the members whose names match a pattern, of files (path, content). A file that is no ZIP is an error."""
    wanted = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    for m in held.infolist():
                        if not m.is_dir() and wanted.fullmatch(m.filename):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m.filename]), pa.array([held.read(m)], pa.binary())], names=["path", "member", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def place_of(reference: str) -> int:
    """The column of a cell such as AB12, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of the rows of a workbook's sheet, by default its first; cells that are absent are null. ValueError where there is no such sheet."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        names = held.namelist()
        shared = [text(x) for x in Xml.fromstring(held.read(STRINGS)).findall(f"{MAIN}si")] if STRINGS in names else []
        links = {x.get("Id"): x.get("Target") for x in Xml.fromstring(held.read(BOOK_LINKS)).findall(f"{PACKAGE}Relationship")}
        sheets = {x.get("name"): links[x.get(f"{LINK}id")] for x in Xml.fromstring(held.read(BOOK)).iter(f"{MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"there is no sheet {sheet!r} among {sorted(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with held.open(part) as stream:
            for _, row in Xml.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall(f"{MAIN}c"):
                    at = place_of(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = text(c)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield int(row.get("r")), cells
                row.clear()


def workbook_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, row and cells (as text) of every workbook's sheet, of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(sheet_rows(content, sheet))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "row", "cells"])

    return files.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def tabled(rows: DataFrame, header: int = 1) -> DataFrame:
    """path and a column of text for each name in the header row; ValueError where workbooks have different headers."""
    names = [r[0] for r in rows.where(F.col("row") == header).select("cells").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("workbooks have different headers, or none")
    return rows.where(F.col("row") > header).select("path", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names[0]) if n is not None])


def workbook(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: texts as shared strings, numbers as such, None as no cell."""
    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    strings: dict[str, int] = {}
    lines = []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            at = f"{letters(i)}{n}"
            if isinstance(v, str):
                cells.append(f'<c r="{at}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    clean = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    main, link = MAIN.strip("{}"), LINK.strip("{}")
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>',
        BOOK: f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="{clean(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        BOOK_LINKS: f'<Relationships xmlns="{PACKAGE.strip("{}")}"><Relationship Id="rId1" Type="{link}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        STRINGS: f'<sst xmlns="{main}">{"".join(f"<si><t>{clean(t)}</t></si>" for t in strings)}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
        for name, body in parts.items():
            held.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()
