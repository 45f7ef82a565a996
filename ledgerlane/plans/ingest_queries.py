"""Registered queries: register ingestion over sheet rows derived from the orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.functions import cells as read
from ledgerlane.operators import ingest
from ledgerlane.operators.scale import cut, rank_in_group, shared_dir
from ledgerlane.sources import derived, registers

HEADINGS = (
    ("Supplier GSTIN", "Invoice No", "Invoice Date", "Taxable Value", "CGST", "SGST", "IGST",
     "Reverse Charge", "Remarks"),
    ("GSTIN of Supplier", "Bill No.", "Bill Date", "Net Amount", "Central Tax", "State Tax",
     "Integrated Tax", "RCM", "Buyer GSTIN"),
    ("Vendor GSTIN", "Doc No", "Date", "Taxable", "CGST Amt", "GSTIN", "IGST Amt", "Rev. Chrg", ""),
)
_loaded: dict[tuple, ingest.Ingest] = {}


def _heading_row(source: int) -> tuple[str, ...]:
    return HEADINGS[2] if source == 4 else HEADINGS[source % 2]


def written_amount(amount: Column, style: Column) -> Column:
    """An amount as people write it, by style number."""
    plain = amount.cast("string")
    grouped = F.format_number(amount, 2)
    return (
        F.when(style == 0, grouped)
        .when(style == 1, F.concat(F.lit("₹ "), grouped))
        .when(style == 2, F.concat(F.lit("INR "), plain))
        .when(style == 3, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(style == 4, F.concat(plain, F.lit("-")))
        .when(style == 5, F.concat(plain, F.lit(" Cr")))
        .when(style == 6, F.concat(F.lit("  "), plain, F.lit("49 ")))
        .when(style == 7, F.lit("n/a"))
        .otherwise(F.concat(F.lit("Rs. "), F.lit("500")))
    )


def sheet_rows(spark, sf_dir) -> DataFrame:
    """Seven registers with different headings, date styles and faults; row 1 is the heading."""
    k, source, day = F.col("k"), F.col("s"), F.col("day")
    docs = derived._documents(spark, sf_dir).withColumn("s", F.col("c") % 7)
    # Register 3 shows no day past the 12th, so its dates can be read either way.
    early = F.date_add(F.trunc(day, "month"), (F.dayofmonth(day) - 1) % 12)
    date_text = (
        F.when(source == 3, F.date_format(early, "dd/MM/yyyy"))
        .when(source == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(source == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(source == 5, F.date_format(day, "d.M.yy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    # An impossible day, in the order of its column.
    impossible = F.when(source == 1, F.lit("02/31/1998")).otherwise(F.lit("31/02/1998"))
    date_text = F.when((k % 43 == 0) & (source != 3), impossible).otherwise(date_text)
    zero = F.lit("0")
    half = F.col("half").cast("string")
    both = k % 37 == 0
    row = F.array(
        F.when(k % 31 == 0, F.lit(" ")).otherwise(F.lower("gstin")),
        F.col("number"),
        date_text,
        written_amount(F.col("taxable"), F.when(k % 53 == 0, F.lit(7)).otherwise(k % 3)),
        F.when(F.col("interstate"), F.lit("")).otherwise(half),
        F.when(F.col("interstate"), F.lit("")).otherwise(half),
        F.when(F.col("interstate"), F.col("tax").cast("string"))
        .when(both, half)
        .otherwise(zero),
        F.when((source == 6) | (k % 41 == 0), F.lit("maybe"))
        .when(k % 5 == 0, F.lit("Yes"))
        .otherwise(F.lit("")),
        F.lit("x"),
    )
    blank = F.array(*[F.lit(" ") for _ in range(9)])
    name = F.concat(F.lit("register-"), source.cast("string"))
    # Counting, sampling and ranking each read the rows; their texts are made once.
    body = cut(docs.select(name.alias("source"), "k", F.when(k % 47 == 0, blank).otherwise(row).alias("cells")))
    numbered = rank_in_group(body, ["source"], ["k"], "place", DEFAULTS.hot_key_rows)
    sources = body.select("source").distinct()
    table = F.create_map(
        *[
            x
            for s in range(7)
            for x in (F.lit(f"register-{s}"), F.array(*[F.lit(h) for h in _heading_row(s)]))
        ]
    )
    headers = sources.select(
        "source", F.lit(1).cast("long").alias("row_number"), table[F.col("source")].alias("cells")
    )
    return headers.unionByName(
        numbered.select("source", (F.col("place") + 1).alias("row_number"), "cells")
    )


def loaded(spark, sf_dir) -> ingest.Ingest:
    key = derived.state(spark, sf_dir)
    if key not in _loaded:
        _loaded[key] = ingest.load_registers(cut(sheet_rows(spark, sf_dir)))
    return _loaded[key]


FILE_ROWS = 100_000
"""Rows at most of a register that is written as one file."""


def filed_rows(spark, sf_dir, file_rows: int = FILE_ROWS) -> DataFrame:
    """The registers dealt over files, workbooks and delimited text in turn; each file has the heading."""
    rows = cut(sheet_rows(spark, sf_dir))
    body, place = rows.where("row_number > 1"), F.col("row_number") - 2
    # One row per register; there are seven.
    sizes = F.broadcast(body.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("files")))
    dealt = body.join(sizes, "source").select(
        "source", (place % F.col("files")).alias("part"), (F.floor(place / F.col("files")) + 2).alias("row_number"), "cells"
    )
    headings = rows.where("row_number = 1").join(sizes, "source").select(
        "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("files") - 1)).alias("part"), "row_number", "cells"
    )
    kind = F.when(F.substring("source", -1, 1).cast("int") % 2 == 0, "xlsx").otherwise("csv")
    name = F.concat("source", F.format_string("/%05d.", "part"), kind)
    return headings.unionByName(dealt).select(name.alias("source"), "row_number", "cells")


def loaded_files(spark, sf_dir, file_rows: int = FILE_ROWS) -> ingest.Ingest:
    """The registers written as files below the run's folder, read back and loaded; sources as below that folder."""
    key = ("files", file_rows, *derived.state(spark, sf_dir))
    if key not in _loaded:
        folder = f"{shared_dir(spark)}/registers-{uuid.uuid4().hex}"
        registers.write_registers(filed_rows(spark, sf_dir, file_rows), folder)
        read_back = registers.read_registers(spark, folder)
        named = read_back.withColumn("source", F.regexp_extract("source", "([^/]+/[^/]+)$", 1))
        _loaded[key] = ingest.load_registers(cut(named))
    return _loaded[key]


def forget_runs() -> None:
    _loaded.clear()


def ingest_headers(spark, sf_dir) -> DataFrame:
    headers = sheet_rows(spark, sf_dir).where("row_number = 1")
    mapped = ingest.map_headers(headers)
    return mapped.select(
        "source",
        F.array_join(F.array_sort(F.map_keys("columns")), "|").alias("fields"),
        F.array_join("unrecognised", "|").alias("unrecognised"),
        F.size("problems").cast("long").alias("problems"),
    )


def ingest_amounts(spark, sf_dir) -> DataFrame:
    orders = derived._documents(spark, sf_dir)
    text = written_amount(F.col("taxable"), F.col("k") % 9)
    values = orders.select("k", text.alias("t")).select(
        "k",
        "t",
        read.amount_value(F.col("t")).alias("amount"),
        read.amount_value(F.col("t"), True).alias("strict"),
    )
    return values.select(
        "k",
        F.coalesce(F.col("amount").cast("double"), F.lit(-1.0)).alias("amount"),
        F.coalesce(F.col("strict").cast("double"), F.lit(-1.0)).alias("strict_amount"),
        F.coalesce(read.amount_problem(F.col("t"), F.col("amount")), F.lit("")).alias("problem"),
    )


def ingest_dates(spark, sf_dir) -> DataFrame:
    body = sheet_rows(spark, sf_dir).where("row_number > 1")
    return ingest.infer_date_order(
        body.select("source", "row_number", F.get("cells", F.lit(2)).alias("date_text"))
    ).select("source", F.col("order").alias("date_order"), "evidence")


def _lines(done: ingest.Ingest) -> DataFrame:
    return done.lines.select(
        "source",
        "line_id",
        "supplier_gstin",
        "invoice_number",
        F.col("invoice_date").cast("string").alias("invoice_date"),
        F.col("taxable").cast("double").alias("taxable"),
        F.col("igst").cast("double").alias("igst"),
        "reverse_charge",
    )


def _report(done: ingest.Ingest) -> DataFrame:
    refused = F.col("refusal").isNotNull()
    return done.file_report.select(
        "source",
        refused.alias("refused"),
        F.when(refused, F.lit(0)).otherwise(F.col("rows_seen")).alias("rows_seen"),
        F.when(refused, F.lit(0)).otherwise(F.col("rejected")).alias("rejected"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def ingest_lines(spark, sf_dir) -> DataFrame:
    return _lines(loaded(spark, sf_dir))


def ingest_rejected(spark, sf_dir) -> DataFrame:
    return loaded(spark, sf_dir).rejected.select("source", "row", "reason")


def ingest_report(spark, sf_dir) -> DataFrame:
    return _report(loaded(spark, sf_dir))


def register_files(spark, sf_dir, file_rows: int = FILE_ROWS) -> DataFrame:
    """Lines of the registers read from workbooks and delimited files."""
    return _lines(loaded_files(spark, sf_dir, file_rows))


def register_files_report(spark, sf_dir, file_rows: int = FILE_ROWS) -> DataFrame:
    return _report(loaded_files(spark, sf_dir, file_rows))


QUERIES = {
    "ingest_headers": ingest_headers,
    "ingest_amounts": ingest_amounts,
    "ingest_dates": ingest_dates,
    "ingest_lines": ingest_lines,
    "ingest_rejected": ingest_rejected,
    "ingest_report": ingest_report,
    "register_files": register_files,
    "register_files_report": register_files_report,
}
