"""Register files: workbooks, delimited text, refusals."""

import csv
import datetime as dt
import io
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig
from ledgerlane.functions import cells
from ledgerlane.operators import ingest
from ledgerlane.operators.scale import cut
from ledgerlane.plans import ingest_queries
from ledgerlane.sources import registers, workbooks

HEADERS = ["Supplier GSTIN", "Invoice No", "Invoice Date", "Taxable Value", "CGST", "SGST", "IGST", "Reverse Charge"]
GSTIN = "27AAAPA1234A1Z5"


def row(number="INV/001", when="2026-06-14", taxable="1000", cgst="90", sgst="90", igst="0", rcm="No", gstin=GSTIN):
    return [gstin, number, when, taxable, cgst, sgst, igst, rcm]


def workbook(sheets, date1904=False, formats=(), strings=()):
    """A minimal workbook: ``sheets`` maps a name to its sheetData inner XML."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        tags = "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)
        )
        flag = '<workbookPr date1904="1"/>' if date1904 else ""
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}">{flag}<sheets>{tags}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        custom = "".join(f'<numFmt numFmtId="{200 + i}" formatCode="{escape(f, {chr(34): "&quot;"})}"/>' for i, f in enumerate(formats))
        xfs = '<xf numFmtId="0"/><xf numFmtId="14"/>' + "".join(f'<xf numFmtId="{200 + i}"/>' for i in range(len(formats)))
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{custom}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>')
        if strings:
            items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{items}</sst>')
        for i, data in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()


def xml_rows(rows):
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r)
    return "".join(f"<row>{cells(r)}</row>" for r in rows)


def grid(spark, content, sheet=None):
    files = spark.createDataFrame([("b.xlsx", bytearray(content))], "source string, content binary")
    rows = workbooks.workbook_rows(files, sheet).collect()
    problems = [r.problem for r in rows if r.problem]
    return problems[0] if problems else sorted((r.row_number, r.cells) for r in rows)


def test_workbook_cells(spark):
    data = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>9</v></c><c r="AB1"><v>0.10</v></c></row>'
        '<row r="4"><c r="B4" s="1"><v>46000.75</v></c><c r="C4" s="2"><v>61</v></c><c r="D4" s="3"><v>61</v></c>'
        '<c r="E4" s="1"><v>60</v></c><c r="F4" t="b"><v>1</v></c></row><row r="6"><c r="A6"/></row>'
    )
    book = workbook({"One": data, "Two": xml_rows([["x"]])}, formats=["dd mmm", "[$R-1009]0"], strings=["head"])
    got = grid(spark, book)
    assert [n for n, _ in got] == [1, 2, 3, 4]
    assert got[0][1][0] == "head" and got[0][1][2] == "" and got[0][1][27] == "0.10"
    assert got[1][1] == [] and got[3][1] == ["", "2025-12-09", "1900-03-01", "61", "60", "1"]
    assert grid(spark, book, "Two") == [(1, ["x"])]
    serial = workbook({"S": '<row><c s="1"><v>0</v></c></row>'}, date1904=True)
    assert grid(spark, serial) == [(1, ["1904-01-01"])]
    assert grid(spark, book, "Three") == "no sheet named 'Three'; workbook has: One, Two"


def test_damaged_workbooks_are_one_problem(spark):
    good = workbook({"S": xml_rows([["x"]])})
    broken = [
        workbook({"S": "<row><c>"}),
        good[:-30],
        good[:200] + bytes(40) + good[240:],
        workbook({"S": '<row r="1"><c r="ZZZZ1"><v>1</v></c></row>'}),
        workbook({"S": '<row r="99999999"><c r="A1"><v>1</v></c></row>'}),
    ]
    for content in broken:
        assert isinstance(grid(spark, content), str)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("registers")
    (path / "good.XLSX").write_bytes(workbook({"R": xml_rows([HEADERS, row(), [""], row("INV/002", taxable="x")])}))
    (path / "notzip.xlsx").write_bytes(b"hello")
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "a")
    (path / "notbook.xlsx").write_bytes(other.getvalue())
    lines = [",".join(HEADERS), *[",".join(row(f"INV/{i:03d}", f"{i % 28 + 1:02d}/06/2026")) for i in range(300)]]
    (path / "large.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    (path / "quoted.TXT").write_text('Supplier GSTIN,Bill No,Date,Taxable,IGST\n' + f'{GSTIN},"A,1\n2",2026-06-14,"1,000.00",180\n')
    (path / "bad.csv").write_bytes(b"a,b\n\xff\xfe\x00,1\n")
    (path / "stray.csv").write_text("\n".join([*lines[:100], '"open', *(lines[1:] * 9)]))
    (path / "notes.md").write_text("not a register")
    for month in ("jan", "feb"):
        (path / month).mkdir()
        (path / month / "register.csv").write_text("\n".join([",".join(HEADERS), ",".join(row(f"{month}/1"))]))
    return str(path)


def name_of(source):
    return "/".join(source.split("/")[-2:]) if "register.csv" in source else source.split("/")[-1]


def test_folder_is_read_or_refused_by_name(spark, folder):
    done = ingest.load_registers(cut(registers.read_registers(spark, folder)))
    report = {name_of(r.source): r for r in done.file_report.collect()}
    refused = {k: r.refusal for k, r in report.items() if r.refusal}
    assert set(refused) == {"notzip.xlsx", "notbook.xlsx", "bad.csv", "stray.csv", "notes.md"}
    assert refused["notzip.xlsx"].endswith("notzip.xlsx is not a zip archive, so it is not an .xlsx")
    assert "is a zip but not a workbook" in refused["notbook.xlsx"]
    assert "is not UTF-8 text" in refused["bad.csv"] and "a quote may be open" in refused["stray.csv"]
    assert "files of type 'md' are not read" in refused["notes.md"]
    assert (report["good.XLSX"].accepted, report["good.XLSX"].rejected) == (1, 1)
    assert report["large.csv"].accepted == 300 and report["quoted.TXT"].accepted == 1
    assert report["jan/register.csv"].accepted == report["feb/register.csv"].accepted == 1
    ids = [r.line_id for r in done.lines.collect()]
    assert len(ids) == len(set(ids)) == 304


TEXTS = [
    'a,b\n1,"x\ny"\n2,"p ""q"" r"\n', 'a"b,c"d\n"e"f"g,h\n', '"a\r\nb",c\r\nd\r\n', "a\rb,c\r\n\n\nd", '"",""\n"\n"\n"""",x\n',
    'x,"a\n\n\nb",y\nz\n"open\nto the end', 'ä,"ö\nü"\n' * 50, "", "\n", '"a"",b\n"c,d\n',
]


def test_text_equals_the_standard_reader(spark, tmp_path):
    for i, text in enumerate(TEXTS):
        (tmp_path / f"t{i}.csv").write_bytes(text.encode())
    got = registers.read_register_csv(spark, str(tmp_path)).collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in got if r.source.endswith(f"/t{i}.csv")]
        if text:
            want = list(enumerate(csv.reader(io.StringIO(text, newline="")), start=1))
            assert sorted((r.row_number, r.cells) for r in mine) == want, text
        else:
            assert [r.problem.endswith("has a header and no rows") for r in mine] == [True]


def test_written_registers_come_back(spark, tmp_path):
    cells = [["h", "a,b", 'q"q', "x\ny", "ä ₹", ""], ["2026-06-14", "1899-01-01", "2026-02-31", " sp ", "0.10", "<&>"], [], ["0", None, "z"]]
    rows = [(name, n, c) for name in ("a/b.csv", "c.XLSX", "d/e/f.txt") for n, c in zip((1, 2, 3, 5), cells)]
    folder = f"{tmp_path}/out"
    df = spark.createDataFrame(rows, "source string, row_number long, cells array<string>")
    registers.write_registers(df, folder)
    back = registers.read_registers(spark, folder).collect()
    trim = lambda cells: ",".join(c or "" for c in cells).rstrip(",")
    want = {n: trim(c) for n, c in zip((1, 2, 3, 4, 5), [cells[0], cells[1], [], [], cells[3]])}
    for name in ("a/b.csv", "c.XLSX", "d/e/f.txt"):
        assert {r.row_number: trim(r.cells) for r in back if r.source == f"{folder}/{name}"} == want
    assert len(back) == 15 and not any(r.problem for r in back)
    # Only the files are there, and they are not written over.
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b.csv", "c.XLSX", "f.txt"]
    with pytest.raises(Exception, match="files are there already"):
        registers.write_registers(df, folder)
    with pytest.raises(Exception, match="a workbook cannot hold"):
        bad = spark.createDataFrame([("x.xlsx", 1, ["\x01"])], df.schema)
        registers.write_registers(bad, folder)
    assert {p.name for p in (tmp_path / "out").rglob("*.*") if p.is_file()} >= {"b.csv", "c.XLSX", "f.txt"}
    assert registers.read_registers(spark, folder).count() == 15
    named = registers.read_register_xlsx(spark, folder, "None such").collect()
    assert [r.problem for r in named] == ["no sheet named 'None such'; workbook has: Register"]


def test_registers_of_many_files(spark):
    """The registered queries with small files, against their SQL with the same size."""
    from checks import compare, oracle_sql
    from ledgerlane.plans import ingest_queries

    sf_dir = "/root/testdata/sf0.001"
    con = compare.connect(sf_dir)
    for name in ("register_files", "register_files_report"):
        sql = oracle_sql.oracle_sql()[name].replace("100000.0", "40.0")
        query = lambda s, d, q=ingest_queries.QUERIES[name]: q(s, d, 40)
        verdict = compare.compare(spark, con, name, query, sql, sf_dir)
        assert verdict.startswith("ok"), verdict


def load(spark, files, **options):
    rows = [(name, i, cells) for name, body in files.items() for i, cells in enumerate(body, 1)]
    sheet = spark.createDataFrame(rows, "source string, row_number bigint, cells array<string>")
    done = ingest.load_registers(cut(sheet), **options)
    return done, {r.source: r for r in done.file_report.collect()}


@pytest.mark.parametrize("config", [ReconConfig(), ReconConfig(hot_key_rows=2, broadcast_rows=0)], ids=["plain", "hot"])
def test_files_and_rows(spark, config):
    spellings = ["GSTIN of Supplier ", "vendor_gstin", "Party GSTIN", "GSTIN No.", "GSTIN", "Seller-GSTIN"]
    files = {
        "good": [HEADERS + ["Buyer GSTIN", "Remarks"], row() + ["x", "y"], [" "] * 8,
                 row(number=" "), row(taxable=""), row(igst="5"), row(when="nope"), row(rcm="UNKNOWN"),
                 row(gstin=""), row("inv 2")],
        "short": [HEADERS],
        "two": [HEADERS + ["GSTIN"], row()],
        "untaxed": [HEADERS[:4], row()[:4]],
        "mapless": [["a", "b"], ["1", "2"]],
        "open": [HEADERS, row(when="01/02/2026"), row(when="03/04/2026")],
        "mixed": [HEADERS, row(when="14/02/2026"), row(when="02/14/2026")],
        "day": [HEADERS, row(when="01/02/2026"), row(when="14/02/2026")],
        "month": [HEADERS, row(when="01/02/2026"), row(when="02/14/2026")],
        "hopeless": [HEADERS, row(rcm="maybe"), row(rcm="2")],
        **{f"spell{i}": [[s, *HEADERS[1:]], row()] for i, s in enumerate(spellings)},
    }
    done, report = load(spark, files, config=config)
    refusals = {k: r.refusal for k, r in report.items() if r.refusal}
    assert set(refusals) == {"short", "two", "untaxed", "mapless", "open", "mixed", "hopeless"}
    assert refusals["short"] == "short has a header and no rows"
    assert "'Supplier GSTIN' and 'GSTIN' both mean supplier_gstin" in refusals["two"]
    assert "no tax column found" in refusals["untaxed"]
    assert "no column found for taxable; headings read were: 'a', 'b'" in refusals["mapless"]
    assert "'01/02/2026' is a valid date read either way" in refusals["open"]
    assert "14/02/2026 needs day-first, 02/14/2026 needs month-first" in refusals["mixed"]
    assert refusals["hopeless"].endswith("First reason: 'maybe' is neither yes nor no")
    assert report["day"].date_order == "DAY_FIRST" and report["month"].evidence == "02/14/2026"
    good = report["good"]
    assert (good.accepted, good.rejected, good.unrecognised) == (2, 6, ["Remarks"])
    assert good.summary == "2 of 8 rows loaded from good; 6 rejected; columns ignored as unrecognised: Remarks"
    reasons = {r.row: r.reason for r in done.rejected.where("source = 'good'").collect()}
    assert reasons == {
        4: "invoice number is blank",
        5: "empty amount",
        6: "both intra-state and inter-state tax are populated, which no single document carries -- "
           "the row is describing two supplies or the wrong columns",
        7: "'nope' is not a date this reader recognises",
        8: "'UNKNOWN' is neither yes nor no",
        9: "supplier GSTIN is blank",
    }
    lines = {r.line_id: r for r in done.lines.where("source = 'good'").collect()}
    assert lines["good#R00010"].invoice_number == "INV2" and lines["good#R00002"].cgst == Decimal("90.00")
    days = {r.source: r.invoice_date for r in done.lines.where("source in ('day', 'month') and line_id like '%R00002'").collect()}
    assert days == {"day": dt.date(2026, 2, 1), "month": dt.date(2026, 1, 2)}


def test_caller_may_state_the_date_order(spark):
    files = {"open": [HEADERS, row(when="01/02/2026")]}
    done, report = load(spark, files, date_orders={"open": "DAY_FIRST"})
    assert report["open"].refusal is None
    assert done.lines.first().invoice_date == dt.date(2026, 2, 1)


def test_few_files_are_spread_over_the_cores(tmp_path):
    """Twelve small workbooks and texts: no task has them all, whatever their size."""
    for i in range(12):
        (tmp_path / f"r{i:02d}.{'csv' if i % 2 else 'xlsx'}").write_bytes(b"x" * 1000)
    tasks = registers._Reader({"path": str(tmp_path), "cores": "4"}).partitions()
    assert sorted(p for t in tasks for p in t.paths) == sorted(str(p) for p in tmp_path.iterdir())
    assert len(tasks) >= 4 and max(len(t.paths) for t in tasks) <= 6


def test_a_sheet_row_is_one_raw_row(spark):
    """Rows come as they stand in the sheet; batches are bounded by cells, not by rows."""
    content = workbook({"A": xml_rows([["a", "b", "c"]] * 5)})
    raw = list(workbooks.package_rows(io.BytesIO(content), "b.xlsx", None))
    assert [r[7] for r in raw if r[0] == "cells"] == [["a", "b", "c"]] * 5
    wide = [("cells", i, 0, "", [0], [0], ["n"], ["x"] * 60_000) for i in range(4)]
    assert [len(b) for b in workbooks.in_batches(iter(wide))] == [2, 2]


def test_rows_and_cells_out_of_order(spark):
    """A row that comes twice is one row, a cell that comes twice holds the larger value, and omitted rows are empty."""
    data = (
        '<row r="2"><c r="B2" t="str"><v>b</v></c><c r="A2" t="str"><v>a</v></c></row>'
        '<row r="1"><c r="A1" t="str"><v>x</v></c><c r="A1" t="str"><v>y</v></c></row>'
        '<row r="2"><c r="D2" t="str"><v>d</v></c></row>'
        '<row r="5"><c r="B5" t="str"><v>e</v></c></row><row r="6"><c r="A6" t="str"><v> </v></c></row>'
    )
    got = grid(spark, workbook({"A": data}))
    assert got == [(1, ["y"]), (2, ["a", "b", "", "d"]), (3, []), (4, []), (5, ["", "e"])]


def test_sheet_rows_are_made_once(spark, tmp_path):
    rows = [(k, k % 9, float(k), dt.datetime(1998, 1, 1 + k % 28)) for k in range(90)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    made = ingest_queries.sheet_rows(spark, str(tmp_path))
    # Whatever reads the rows reads their written texts, not the orders again.
    assert "o_totalprice" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("row_number > 1").count() == 90


@pytest.mark.parametrize("text", ["0", "007", "12.5", "12.34", "1" * 20, "12.345", "12\n", " 12", "-3", "1,200.50", "²"])
def test_plain_amounts_read_as_marked_ones(spark, text):
    cells_of = spark.createDataFrame([(text, f"₹ {text}")], "plain string, marked string")
    plain, marked = cells_of.select(cells.amount_value(F.col("plain")), cells.amount_value(F.col("marked"))).first()
    assert plain == marked
