"""Worksheet rows from ``.xlsx`` files.

Tasks only take the parts of a package apart: they stream its XML and emit what is written there,
cell by cell. What cells refer to (shared texts, number formats, the date system) is joined and
resolved in Spark, so one workbook is never held as a whole and values stay the stored text; only
numbers under a date format become ISO dates. A package that cannot be read to its end is one
problem row.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.functions.cells import excel_serial_to_date, strip
from ledgerlane.operators.scale import broadcast_if_small, cut

# --- fixed values: part names and built-in date formats of the file type ----

BOOK, LINKS, TEXTS, STYLES = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
LAST_SERIAL = 2_958_465
BUILT_IN_DATES = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]

BATCH = 100_000
"""Cells at most that a task gathers before it hands them on, a single row aside."""
RAW_TYPES = (
    "source string, part string, a long, b long, text string, "
    "places array<long>, styles array<long>, kinds array<string>, texts array<string>"
)
"""``part`` says what a row is: cells (a row, and its cells as four arrays), text (a place), format (a id), style (a
place, b format id), epoch, disorder (rows or cells of the sheet do not ascend) or problem."""
NO_CELLS = (None, None, None, None)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(package: zipfile.ZipFile, part: str, *ends: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """Finished elements of the given names; each is emptied after use, so a part streams through."""
    with package.open(part) as stream:
        for _, element in ElementTree.iterparse(stream):
            name = _local(element.tag)
            if name in ends:
                yield name, element
                element.clear()


def _plain_text(element: ElementTree.Element) -> str:
    return "".join(element.itertext())


def _place(reference: str | None, after: int) -> int:
    """Column of a reference such as AB7, counted from 0; the next one where none is given."""
    letters = (reference or "").rstrip("0123456789$").replace("$", "").upper()
    if not letters:
        return after + 1
    total = 0
    for letter in letters:
        if not "A" <= letter <= "Z":
            raise ValueError(f"cell reference {reference!r} has no column")
        total = 26 * total + ord(letter) - ord("A") + 1
        if total > MOST_COLUMNS:
            raise ValueError(f"cell reference {reference!r} is beyond the last column")
    return total - 1


def _book(package: zipfile.ZipFile, source: str, wanted: str | None) -> Iterator[tuple]:
    """The parts of one workbook as raw rows."""
    names = set(package.namelist())
    missing = sorted({BOOK, LINKS} - names)
    if missing:
        raise ValueError(f"{source} is a zip but not a workbook: no {missing[0]}")
    sheets, epoch = {}, "0"
    for name, element in _events(package, BOOK, "sheet", "workbookPr"):
        if name == "workbookPr":
            epoch = element.get("date1904", "0")
        else:
            link = next((v for k, v in element.items() if _local(k) == "id"), None)
            sheets[element.get("name", "")] = link
    targets = {e.get("Id"): e.get("Target", "") for _, e in _events(package, LINKS, "Relationship")}
    sheets = {name: targets[link] for name, link in sheets.items() if targets.get(link)}
    if not sheets:
        raise ValueError(f"{source} declares no worksheets")
    if wanted is not None and wanted not in sheets:
        raise ValueError(f"no sheet named {wanted!r}; workbook has: {', '.join(sheets)}")
    target = sheets[next(iter(sheets)) if wanted is None else wanted]
    yield "epoch", 0, 0, "1" if epoch in ("1", "true") else "0", *NO_CELLS
    if TEXTS in names:
        for at, (_, item) in enumerate(_events(package, TEXTS, "si")):
            yield "text", at, 0, _plain_text(item), *NO_CELLS
    if STYLES in names:
        custom, seen = [], 0
        # Cell styles come as records of the cellXfs element, which ends after them.
        for name, element in _events(package, STYLES, "numFmt", "cellXfs"):
            if name == "numFmt":
                custom.append((int(element.get("numFmtId", "0")), element.get("formatCode", "")))
                continue
            for record in element:
                yield "style", seen, int(record.get("numFmtId", "0")), "", *NO_CELLS
                seen += 1
        for number, code in custom:
            yield "format", number, 0, code, *NO_CELLS
    part = posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")
    row = last = 0
    disorder = False
    for _, element in _events(package, part, "row"):
        row = int(element.get("r") or row + 1)
        if not 0 < row <= MOST_ROWS:
            raise ValueError(f"row {row} is beyond the last row")
        column, places, styles, kinds, texts = -1, [], [], [], []
        for cell in element:
            if _local(cell.tag) != "c":
                continue
            column = _place(cell.get("r"), column)
            disorder |= bool(places) and column <= places[-1]
            kind = cell.get("t", "n")
            holder = "is" if kind == "inlineStr" else "v"
            places.append(column)
            styles.append(int(cell.get("s", "-1")))
            kinds.append(kind)
            texts.append(next((_plain_text(x) for x in cell if _local(x.tag) == holder), ""))
        if places:
            disorder |= row <= last
            last = row
            yield "cells", row, 0, "", places, styles, kinds, texts
    if disorder:
        yield "disorder", 0, 0, "", *NO_CELLS


def package_rows(stream, source: str, wanted: str | None) -> Iterator[tuple]:
    """Raw rows of one package, without its source; its problem comes last."""
    try:
        # Some streams refuse, with an error of their own, to look for the end of a very short file.
        if stream.read(2) != b"PK":
            raise zipfile.BadZipFile
        with zipfile.ZipFile(stream) as package:
            yield from _book(package, source, wanted)
    except zipfile.BadZipFile:
        yield "problem", 0, 0, f"{source} is not a zip archive, so it is not an .xlsx", *NO_CELLS
    except Exception as error:  # noqa: BLE001  whatever is wrong with one file refuses that file
        told = str(error) if str(error).startswith((source, "no sheet")) else f"{source} is damaged: {type(error).__name__}"
        yield "problem", 0, 0, told, *NO_CELLS


def in_batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Raw rows in lists of bounded size; the last field that is an array tells a row's cells."""
    part, cells = [], 0
    for row in rows:
        part.append(row)
        cells += 1 + len(row[-1] or row[-2] or ())
        if cells >= BATCH:
            yield part
            part, cells = [], 0
    if part:
        yield part


def _raw(wanted: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"]):
                rows = package_rows(io.BytesIO(bytes(content)), source, wanted)
                for part in in_batches(rows):
                    yield pd.DataFrame([(source, *row) for row in part], columns=_RAW)

    return run


_RAW = ["source", "part", "a", "b", "text", "places", "styles", "kinds", "texts"]


def is_date_format(code: Column) -> Column:
    """Whether a custom format shows a year, month or day: literals and conditions do not count."""
    bare = F.regexp_replace(F.lower(code), r'\[[^\]]*\]|"[^"]*"', "")
    return F.element_at(F.split(bare, ";"), 1).rlike("[ymd]")


def workbook_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """``source, row_number, cells, problem`` of files given as ``source, content``."""
    return resolved(cut(files.mapInPandas(_raw(sheet), RAW_TYPES)))


def problem_rows(raw: DataFrame) -> DataFrame:
    """The row that stands for a file that could not be read."""
    none = F.array().cast("array<string>")
    return raw.where("part = 'problem'").select(
        "source", F.lit(0).cast("long").alias("row_number"), none.alias("cells"), F.col("text").alias("problem")
    )


def resolved(raw: DataFrame) -> DataFrame:
    """Sheet rows of a written table of raw rows.

    Rows run from 1 to the last one with text; rows that a file omits come back empty. A row is resolved where it
    was read, with what is known about its file; only cells that name a shared text, and files whose rows or
    cells do not ascend, are taken apart and put together again.
    """

    def part(name: str, *columns: Column) -> DataFrame:
        return raw.where(F.col("part") == name).select("source", *columns)

    def few(files: DataFrame) -> DataFrame:
        return broadcast_if_small(files, DEFAULTS.broadcast_rows)  # one row a file at most

    failed = few(part("problem").distinct())
    custom = part("format", F.col("a").alias("b"), is_date_format(F.col("text")).alias("custom"))
    dated = (
        part("style", F.col("a").alias("style"), "b").join(custom, ["source", "b"], "left")
        .where(F.col("b").isin(*BUILT_IN_DATES) | F.coalesce("custom", F.lit(False)))
        .groupBy("source").agg(F.collect_set("style").alias("dated"))
    )
    # Files of one name are read as one, as if their rows did not ascend.
    known = raw.where(F.col("part").isin("epoch", "disorder")).groupBy("source").agg(
        F.max((F.col("part") == "epoch") & (F.col("text") == "1")).alias("from_1904"),
        (F.count(F.lit(1)) > 1).alias("disorder"),
    ).join(dated, "source", "left")
    known = few(cut(known.withColumn("dated", F.coalesce("dated", F.array().cast("array<long>")))))
    sheet = part("cells", F.col("a").alias("row_number"), "places", "styles", "kinds", "texts")
    sheet = sheet.join(failed, "source", "left_anti").join(known, "source")  # a file is read whole or not at all

    def own_value(style: Column, kind: Column, text: Column) -> Column:
        bare = strip(text)
        serial = F.floor(bare.try_cast("double")).cast("int")
        dates = (kind == "n") & F.array_contains("dated", style) & serial.between(0, LAST_SERIAL)
        day = F.when(dates, excel_serial_to_date(serial, F.col("from_1904")).cast("string"))
        return F.when(kind == "inlineStr", text).otherwise(F.coalesce(day, bare))

    apart = F.col("disorder") | F.array_contains("kinds", "s")
    cell = F.arrays_zip("places", "styles", "kinds", "texts")
    plain = sheet.where(~apart).select(
        "source", "row_number", "places",
        F.transform(cell, lambda c: own_value(c["styles"], c["kinds"], c["texts"])).alias("found"),
    )
    mixed = sheet.where(apart)
    if not mixed.isEmpty():
        cells = mixed.select("source", "row_number", "dated", "from_1904", F.inline(cell).alias("place", "style", "kind", "text"))
        texts = part("text", F.col("a").cast("string").alias("ref"), F.col("text").alias("shared"))
        shared = cells.where("kind = 's'").join(
            texts, (cells["source"] == texts["source"]) & (strip(cells["text"]) == texts["ref"]), "left"
        ).select(cells["source"], "row_number", "place", F.coalesce("shared", F.lit("")).alias("value"))
        own = cells.where("kind <> 's'").select(
            "source", "row_number", "place", own_value(F.col("style"), F.col("kind"), F.col("text")).alias("value")
        )
        joined = (
            shared.unionByName(own).groupBy("source", "row_number", "place").agg(F.max("value").alias("value"))
            .groupBy("source", "row_number").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("m"))
        )
        plain = plain.unionByName(joined.select("source", "row_number", F.col("m.place").alias("places"), F.col("m.value").alias("found")))
    width = F.element_at("places", -1)
    gapless = F.size("places") == width + 1
    filled = F.transform(
        F.sequence(F.lit(0).cast("long"), width),
        lambda i: F.coalesce(F.get("found", F.array_position("places", i).cast("int") - 1), F.lit("")),
    )
    same = F.transform("found", lambda v: F.coalesce(v, F.lit("")))
    rows = cut(plain.select("source", "row_number", F.when(gapless, same).otherwise(filled).alias("cells")))
    shown = F.exists("cells", lambda c: strip(c) != "")
    # Rows up to the last with text; the gaps before each are empty rows.
    last = few(cut(rows.where(shown).groupBy("source").agg(F.max("row_number").alias("last"))))
    inside = rows.join(last, "source").where("row_number <= last")
    gappy = inside.groupBy("source", "last").agg(F.count(F.lit(1)).alias("held")).where("held < last").select("source")
    kept = Window.partitionBy("source").orderBy("row_number")
    before = F.coalesce(F.lag("row_number").over(kept), F.lit(0))
    gaps = (
        inside.select("source", "row_number").join(few(cut(gappy)), "source", "left_semi")
        .withColumn("before", before).where("row_number - before > 1")
    )
    empty = gaps.select("source", F.explode(F.sequence(F.col("before") + 1, F.col("row_number") - 1)).alias("row_number"))
    none = F.array().cast("array<string>")
    return (
        inside.select("source", "row_number", "cells")
        .unionByName(empty.select("source", "row_number", none.alias("cells")))
        .withColumn("problem", F.lit(None).cast("string"))
        .unionByName(problem_rows(raw))
    )


# --- writing ------------------------------------------------------------------

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_SHEET = "worksheets/sheet1.xml"
_OTHER_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/{BOOK}" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/{_SHEET}" ContentType="{_TYPE}.worksheet+xml"/>'
    f'<Override PartName="/{STYLES}" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{BOOK}"/></Relationships>',
    BOOK: f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Register" sheetId="1" r:id="r1"/></sheets></workbook>',
    LINKS: f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="{_SHEET}"/>'
    f'<Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    STYLES: f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}

_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_ISO = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_DAY_ZERO, _FIRST_SURE_DAY = dt.date(1899, 12, 30), dt.date(1900, 3, 1)


def _cell_xml(value: str | None) -> str:
    """A cell; an ISO date is kept as a day number under a date format, as spreadsheet programs keep it."""
    if not value:
        return "<c/>"
    if _ISO.fullmatch(value):
        try:
            day = dt.date.fromisoformat(value)
        except ValueError:
            day = None
        if day is not None and day >= _FIRST_SURE_DAY:
            return f'<c s="1"><v>{(day - _DAY_ZERO).days}</v></c>'
    if _NOT_XML.search(value):
        raise ValueError(f"a workbook cannot hold the text {value!r}")
    # A bare carriage return would come back as a line feed.
    text = escape(value, {"\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(out, rows: Iterator[tuple[int, list]]) -> None:
    """One workbook with one sheet of ``row number, cells``, written row by row."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in _OTHER_PARTS.items():
            package.writestr(name, text)
        with package.open(f"xl/{_SHEET}", "w", force_zip64=True) as part:
            part.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for number, cells in rows:
                if number > MOST_ROWS:
                    raise ValueError(f"row {number} is beyond the last row")
                part.write(f'<row r="{number}">{"".join(map(_cell_xml, cells))}</row>'.encode())
            part.write(b"</sheetData></worksheet>")
