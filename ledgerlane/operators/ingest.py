"""Register cells to purchase lines, with every refusal named.

Input is one row per sheet row: ``source, row_number, cells``; row 1 is the heading. One source
may hold much of the data, so whatever is per source is a grouped aggregate of its rows, and its
result goes back to the rows through ``lookup``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    HEADING_ALIASES,
    IGNORED_HEADINGS,
    REQUIRED_FIELDS,
    TAX_HEADS,
    TEXT_AMBIGUOUS_TAIL,
    TEXT_BOTH_REGIMES,
    TEXT_DATE_GATE_TAIL,
    TEXT_NO_TAX_COLUMN,
)
from ledgerlane.functions import cells as read
from ledgerlane.functions.money import well_formed_split
from ledgerlane.operators.scale import cut, lookup

HEADER_ROW = 1


@dataclass(frozen=True)
class Ingest:
    lines: DataFrame
    rejected: DataFrame
    file_report: DataFrame


def heading_table(spark) -> DataFrame:
    """Normalised heading to field, or to the reason it is ignored. A fixed, short table."""
    rows = [(a, field, None) for field, aliases in HEADING_ALIASES.items() for a in aliases]
    rows += [(a, None, why) for why, aliases in IGNORED_HEADINGS.items() for a in aliases]
    return spark.createDataFrame(rows, "heading_key string, field string, ignored string")


def map_headers(headers: DataFrame) -> DataFrame:
    """Heading rows (``source, cells``) to ``columns`` (field to position) and ``problems``."""
    known = F.broadcast(heading_table(headers.sparkSession))
    headings = (
        headers.select("source", F.posexplode("cells").alias("position", "heading"))
        .withColumn("heading_key", read.normalise_heading(F.col("heading")))
        .join(known, "heading_key", "left")
    )
    blank = F.col("heading_key") == ""
    unknown = F.col("field").isNull() & F.col("ignored").isNull() & ~blank
    by_field = (
        headings.where("field is not null")
        .groupBy("source", "field")
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.min("position").alias("position"),
            F.array_sort(
                F.collect_list(F.struct("position", read.quoted(F.col("heading")).alias("shown")))
            ).alias("candidates"),
        )
    )
    shown = F.array_join(F.transform("candidates", lambda c: c["shown"]), " and ")
    ambiguity = F.concat(
        shown, F.lit(" both mean "), F.col("field"), F.lit("; " + TEXT_AMBIGUOUS_TAIL)
    )
    fields = by_field.groupBy("source").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("found") == 1, F.struct("field", "position")))
        ).alias("columns"),
        F.array_sort(
            F.collect_list(F.when(F.col("found") > 1, F.struct("field", ambiguity.alias("text"))))
        ).alias("ambiguous"),
    )
    not_blank = F.when(read.strip(F.col("heading")) != "", read.quoted(F.col("heading")))
    whole = headings.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("position", not_blank.alias("shown")))).alias("all"),
        F.array_sort(F.collect_list(F.when(unknown, F.col("heading")))).alias("unrecognised"),
    )
    no_columns = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<int>")
    )
    none = F.array().cast("array<struct<field:string,text:string>>")
    joined = whole.join(fields, "source", "left").select(
        "source",
        F.coalesce("columns", no_columns).alias("columns"),
        F.coalesce("ambiguous", none).alias("ambiguous"),
        "unrecognised",
        F.array_join(F.transform("all", lambda h: h["shown"]), ", ").alias("seen"),
    )
    has = F.map_keys("columns")
    unsure = F.transform("ambiguous", lambda a: a["field"])
    missing = [
        F.when(
            ~F.array_contains(has, name) & ~F.array_contains(unsure, name),
            F.concat(F.lit(f"no column found for {name}; headings read were: "), "seen"),
        )
        for name in REQUIRED_FIELDS
    ]
    no_tax = F.when(
        F.size(F.array_intersect(has, F.array(*[F.lit(t) for t in TAX_HEADS]))) == 0,
        F.lit(TEXT_NO_TAX_COLUMN),
    )
    problems = F.concat(
        F.transform("ambiguous", lambda a: a["text"]), F.array_compact(F.array(*missing, no_tax))
    )
    return joined.select("source", "columns", "unrecognised", problems.alias("problems"))


def cell(field: str) -> Column:
    """Text of a mapped field on a row; empty where unmapped or past the row's end."""
    position = F.col("columns")[field]
    return F.coalesce(F.get("cells", position), F.lit(""))


def infer_date_order(rows: DataFrame) -> DataFrame:
    """Per source: the date order its column proves, and the first ambiguous value.

    ``rows``: source, row_number, date_text. The evidence is the first such value by row.
    """
    text, day = F.col("date_text"), F.col("day")

    def first(where: Column, value: Column) -> Column:
        return F.min_by(value, F.when(where, F.col("row_number")))

    proof = (
        rows.withColumn("day", read.strip(text))
        .groupBy("source")
        .agg(
            first(read.day_evidence(day), text).alias("day_text"),
            first(read.month_evidence(day), text).alias("month_text"),
            first(read.is_numeric_date(day), day).alias("ambiguous"),
        )
    )
    return proof.select(
        "source", read.date_order(F.col("day_text"), F.col("month_text")).alias("o"), "ambiguous"
    ).select("source", "o.*", "ambiguous")


TEXT_FIELDS = (
    "supplier_gstin",
    "invoice_number",
    "invoice_date",
    "taxable",
    *TAX_HEADS,
    "kind",
    "reverse_charge",
    "irn",
    "original_invoice_number",
)


def build_lines(rows: DataFrame, strict_currency: bool = False) -> DataFrame:
    """Purchase-line columns plus ``reason``, the first failing check of the row or NULL.

    Three steps, each computed once per row: cell texts, values, problems.
    """
    texts = rows.select(
        "source", "row_number", "cells", "order", *[cell(f).alias(f"t_{f}") for f in TEXT_FIELDS]
    ).withColumn("t_day", read.strip(F.col("t_invoice_date")))
    values = texts.select(
        "*",
        read.normalise_identifier(F.col("t_supplier_gstin")).alias("supplier_gstin"),
        read.normalise_identifier(F.col("t_invoice_number")).alias("invoice_number"),
        read.date_value(F.col("t_day"), F.col("order")).alias("invoice_date"),
        read.amount_value(F.col("t_taxable"), strict_currency).alias("taxable"),
        *[read.amount_or_zero(F.col(f"t_{t}"), strict_currency).alias(t) for t in TAX_HEADS],
        read.document_kind(F.col("t_kind")).alias("kind"),
        read.flag_value(F.col("t_reverse_charge")).alias("reverse_charge"),
        read.normalise_identifier(F.col("t_irn")).alias("irn"),
        read.normalise_identifier(F.col("t_original_invoice_number")).alias(
            "original_invoice_number"
        ),
    )

    def told(problem, field: str) -> Column:
        return problem(F.col(f"t_{field}"), F.col(field))

    reason = F.coalesce(
        F.when(F.col("supplier_gstin") == "", F.lit("supplier GSTIN is blank")),
        F.when(F.col("invoice_number") == "", F.lit("invoice number is blank")),
        *[
            read.amount_problem(F.col(f"t_{name}"), F.col(name), strict_currency)
            for name in ("taxable", *TAX_HEADS)
        ],
        F.when(
            ~well_formed_split(F.col("cgst"), F.col("sgst"), F.col("igst")),
            F.lit(TEXT_BOTH_REGIMES),
        ),
        read.date_problem(
            F.col("t_invoice_date"), F.col("t_day"), F.col("order"), F.col("invoice_date")
        ),
        told(read.document_kind_problem, "kind"),
        told(read.flag_problem, "reverse_charge"),
    )
    return values.select(
        "source",
        "row_number",
        "cells",
        F.concat("source", F.lit("#"), F.format_string("R%05d", "row_number")).alias("line_id"),
        "supplier_gstin",
        "invoice_number",
        "invoice_date",
        "taxable",
        *TAX_HEADS,
        "kind",
        "reverse_charge",
        F.when(F.col("irn") != "", F.col("irn")).alias("irn"),
        F.when(
            F.col("original_invoice_number") != "", F.col("original_invoice_number")
        ).alias("original_invoice_number"),
        F.col("row_number").cast("int").alias("source_row"),
        reason.alias("reason"),
    )


def _file_gate(sources: DataFrame) -> Column:
    """Why a whole file is refused before its rows are read, or NULL."""
    evidence = F.when(
        F.col("evidence") != "", F.concat(F.lit("and "), F.col("evidence"), F.lit(". "))
    ).otherwise(F.lit(""))
    return (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("sheet_rows") < 2, F.concat("source", F.lit(" has a header and no rows")))
        .when(
            F.size("problems") > 0,
            F.concat(
                F.col("source"), F.lit(" cannot be mapped:\n  - "), F.array_join("problems", "\n  - ")
            ),
        )
        .when(
            (F.col("order") == read.UNRESOLVED) & F.col("ambiguous").isNotNull(),
            F.concat(
                F.col("source"),
                F.lit(": the invoice date column cannot be read. Every value in it is ambiguous -- "),
                read.quoted(F.col("ambiguous")),
                F.lit(" is a valid date read either way -- "),
                evidence,
                F.lit(TEXT_DATE_GATE_TAIL),
            ),
        )
    )


def load_registers(
    sheet_rows: DataFrame,
    date_orders: dict[str, str] | None = None,
    strict_currency: bool = False,
    config: ReconConfig = DEFAULTS,
) -> Ingest:
    """All registers of a table of sheet rows. Pass a cut table: it is read several times.

    A row with number 0 carries the problem of a file that could not be read; such a file is
    refused whole. ``date_orders`` states the order for single sources; the others are inferred.
    """
    if "problem" not in sheet_rows.columns:
        sheet_rows = sheet_rows.withColumn("problem", F.lit(None).cast("string"))
    is_header = F.col("row_number") == HEADER_ROW
    body = sheet_rows.where(F.col("row_number") > HEADER_ROW)
    mapping = map_headers(sheet_rows.where(is_header))
    sizes = sheet_rows.groupBy("source").agg(
        F.max("row_number").alias("sheet_rows"), F.min("problem").alias("problem")
    )

    # One row per file. While the files are few (counted) what is known about them is
    # broadcast, and rows are parsed where they were read.
    few = sheet_rows.where(is_header).count() <= config.broadcast_rows

    def per_file(rows: DataFrame, files: DataFrame, how: str) -> DataFrame:
        if few:
            return rows.join(F.broadcast(files), "source", how)
        return lookup(rows, files, ["source"], how, config.hot_key_rows)

    mapped = per_file(
        body, mapping.where(F.size("problems") == 0).select("source", "columns"), "inner"
    )
    orders = infer_date_order(
        mapped.select("source", "row_number", cell("invoice_date").alias("date_text"))
    )
    if date_orders:
        stated = F.create_map(*[F.lit(x) for pair in date_orders.items() for x in pair])[F.col("source")]
        orders = orders.withColumn("order", F.coalesce(stated, "order")).withColumn(
            "evidence",
            F.when(stated.isNotNull(), F.lit("supplied by the caller")).otherwise(F.col("evidence")),
        )
    gated = (
        sizes.join(mapping, "source", "left")
        .join(orders, "source", "left")
        .withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    )
    gated = gated.withColumn("refusal", _file_gate(gated))

    not_blank = F.exists("cells", lambda c: F.coalesce(read.strip(c) != "", F.lit(False)))
    readable = gated.where("refusal is null").select("source", "columns", "order")
    rows = per_file(body.where(not_blank), readable, "inner")
    # Parsed once and written: counts, lines and rejections all read it, and a filter on the
    # reason must not be pushed below the parsing.
    built = cut(build_lines(rows, strict_currency))

    bad = F.col("reason").isNotNull()
    counted = built.groupBy("source").agg(
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("rejected"),
        F.min_by("reason", F.when(bad, F.col("row_number"))).alias("first_reason"),
    )
    report = _report(gated.join(counted, "source", "left"))
    loaded = report.where("refusal is null").select("source")
    kept = per_file(built, loaded, "left_semi")
    return Ingest(
        lines=kept.where(~bad).drop("cells", "row_number", "reason"),
        rejected=kept.where(bad).select(
            "source", F.col("row_number").alias("row"), "reason", F.col("cells").alias("values")
        ),
        file_report=report,
    )


def _report(sources: DataFrame) -> DataFrame:
    """One row per file: counts, interpretation, refusal, and the summary sentence."""
    accepted = F.coalesce("accepted", F.lit(0))
    rejected = F.coalesce("rejected", F.lit(0))
    refusal = F.coalesce(
        "refusal",
        F.when(
            (accepted == 0) & (rejected > 0),
            F.concat(
                F.col("source"),
                F.lit(": every row was rejected, so the file is not what its header claims. "
                      "First reason: "),
                F.col("first_reason"),
            ),
        ),
    )
    seen = F.col("accepted") + F.col("rejected")
    summary = F.concat_ws(
        "; ",
        F.concat(
            F.col("accepted").cast("string"), F.lit(" of "), seen.cast("string"),
            F.lit(" rows loaded from "), F.col("source"),
        ),
        F.when(
            F.col("rejected") > 0, F.concat(F.col("rejected").cast("string"), F.lit(" rejected"))
        ),
        F.when(
            F.size("unrecognised") > 0,
            F.concat(
                F.lit("columns ignored as unrecognised: "), F.array_join("unrecognised", ", ")
            ),
        ),
        F.when(
            F.col("evidence") != "",
            F.concat(
                F.lit("dates read "), F.lower("order"), F.lit(" ("), F.col("evidence"), F.lit(")")
            ),
        ),
    )
    return (
        sources.withColumn("refusal", refusal)
        .withColumn("accepted", accepted)
        .withColumn("rejected", rejected)
        .select(
            "source",
            "refusal",
            F.when(F.col("refusal").isNull(), seen).otherwise(0).alias("rows_seen"),
            "accepted",
            "rejected",
            F.when(seen > 0, F.col("rejected") / seen).otherwise(F.lit(0.0)).alias(
                "rejection_rate"
            ),
            "columns",
            "unrecognised",
            "problems",
            F.col("order").alias("date_order"),
            "evidence",
            F.when(F.col("refusal").isNull(), summary).alias("summary"),
        )
    )
