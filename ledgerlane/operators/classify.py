"""Exception taxonomy over what the match passes left.

Paired classes come before singleton classes, so a document held by both sides is never reported
twice. Every stage returns ``STAGE_COLUMNS``; ids are numbered once over all stages.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    TEXT_MISSING_IN_2B,
    TEXT_MISSING_IN_BOOKS,
    TEXT_RCM_BOOK,
    TEXT_RCM_PORTAL,
)
from ledgerlane.functions import dates, identifiers, money
from ledgerlane.operators.scale import global_index, lookup, rank_zip

DOCUMENT_KEY = ["gstin_key", "num_key"]
STAGE_COLUMNS = (
    "stage",
    "sort_id",
    "exception_class",
    "book",
    "portal",
    "detail",
    "candidates",
)
# Emission order of the stages; numbering follows (stage, sort_id).
(
    STAGE_RCM_BOOK,
    STAGE_RCM_PORTAL,
    STAGE_AMOUNT,
    STAGE_GSTIN,
    STAGE_PORTAL,
    STAGE_BOOK,
) = range(1, 7)


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(name) for name in df.columns])


def _no_line(df: DataFrame) -> Column:
    return F.lit(None).cast(df.schema)


def _stage(
    df: DataFrame, stage: int, sort_id: Column, cls: Column, detail: Column,
    candidates: Column | None = None,
) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(
        F.lit(stage).alias("stage"),
        sort_id.alias("sort_id"),
        cls.alias("exception_class"),
        "book",
        "portal",
        detail.alias("detail"),
        (candidates if candidates is not None else empty).alias("candidates"),
    )


def pair_reverse_charge(
    books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Each reverse-charge book with its key's portal line; unused portal lines alone.

    Many books may share one portal line. The key's last portal line (by id) is the counterpart.
    """
    no_portal = _no_line(portal)
    marks = books.select(
        *DOCUMENT_KEY, F.lit(True).alias("is_book"), "line_id", no_portal.alias("portal")
    ).unionByName(
        portal.select(
            *DOCUMENT_KEY, F.lit(False).alias("is_book"), "line_id", whole_row(portal).alias("portal")
        )
    )
    per_key = marks.groupBy(*DOCUMENT_KEY).agg(
        F.max("is_book").alias("has_book"),
        F.max_by("portal", F.when(~F.col("is_book"), F.col("line_id"))).alias("portal"),
    )
    paired = lookup(
        books.select(*DOCUMENT_KEY, whole_row(books).alias("book")),
        per_key.where("portal is not null").select(*DOCUMENT_KEY, "portal"),
        DOCUMENT_KEY,
        "left",
        config.hot_key_rows,
    )
    used = per_key.where("has_book").select(*DOCUMENT_KEY, F.col("portal.line_id").alias("used_id"))
    alone = (
        lookup(
            portal.select(*DOCUMENT_KEY, whole_row(portal).alias("portal")),
            used,
            DOCUMENT_KEY,
            "left",
            config.hot_key_rows,
        )
        .where(F.coalesce(F.col("portal.line_id") != F.col("used_id"), F.lit(True)))
        .select(_no_line(books).alias("book"), "portal")
    )
    rcm = F.lit("RCM")
    return _stage(
        paired, STAGE_RCM_BOOK, F.col("book.line_id"), rcm, F.lit(TEXT_RCM_BOOK)
    ).unionByName(
        _stage(alone, STAGE_RCM_PORTAL, F.col("portal.line_id"), rcm, F.lit(TEXT_RCM_PORTAL))
    )


def pair_amount_mismatches(
    books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Every left-over line once, zipped on the document key."""
    zipped = rank_zip(books, portal, DOCUMENT_KEY, "line_id", config.hot_key_rows)
    return zipped.select(
        F.col("left.line_id").alias("book_id"),
        F.col("right.line_id").alias("portal_id"),
        F.col("left").alias("book"),
        F.col("right").alias("portal"),
    )


def amount_mismatches(zipped: DataFrame) -> DataFrame:
    delta = money.tax_difference(F.col("book.total_tax"), F.col("portal.total_tax"))
    detail = F.concat(
        F.lit("tax differs by "), money.plain(delta), F.lit(", beyond configured tolerance")
    )
    both = zipped.where("book_id is not null and portal_id is not null")
    return _stage(both, STAGE_AMOUNT, F.col("book.line_id"), F.lit("AMOUNT_MISMATCH"), detail)


def pair_gstin_mismatches(
    books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Books whose supplier id fails its check, zipped with portal lines of equal number and tax.

    Only portal lines some failing book could take are shuffled with them.
    """
    keys = ["num_key", "total_tax"]
    failing = books.where(~identifiers.is_valid_normalised_gstin(F.col("gstin_key")))
    wanted = failing.select(*keys).distinct()
    reachable = lookup(portal, wanted, keys, "left_semi", config.hot_key_rows)
    zipped = rank_zip(failing, reachable, keys, "line_id", config.hot_key_rows)
    return zipped.where(F.col("left").isNotNull() & F.col("right").isNotNull()).select(
        F.col("left").alias("book"), F.col("right").alias("portal")
    )


def gstin_mismatches(pairs: DataFrame) -> DataFrame:
    detail = F.concat(
        F.lit("book GSTIN "),
        F.col("book.supplier_gstin"),
        F.lit(" fails checksum; portal reports "),
        F.col("portal.supplier_gstin"),
        F.lit(" for the same document"),
    )
    return _stage(
        pairs,
        STAGE_GSTIN,
        F.col("book.line_id"),
        F.lit("GSTIN_MISMATCH"),
        detail,
        F.array("portal.line_id"),
    )


def with_known_originals(
    lines: DataFrame, residue: DataFrame, numbers: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """Add ``known`` where a line's original number occurs among ``numbers``.

    Only numbers cited by left-over credit notes matter. While they are few they are broadcast,
    which keeps both whole sides and the lines out of a shuffle.
    """
    original = identifiers.normalise_invoice_number(F.col("original_invoice_number"))
    cited = (
        residue.where("kind = 'CREDIT_NOTE' and original_invoice_number is not null")
        .select(original.alias("original_key"))
        .distinct()
    )
    few = cited.count() <= config.broadcast_rows
    known = (
        numbers.select(F.col("num_key").alias("original_key"))
        .join(F.broadcast(cited) if few else cited, "original_key", "left_semi")
        .distinct()
        .withColumn("known", F.lit(True))
    )
    if few:
        return lines.join(F.broadcast(known), "original_key", "left")
    return lookup(lines, known, ["original_key"], "left", config.hot_key_rows)


def classify_portal_residue(
    residue: DataFrame,
    consumed: DataFrame,
    numbers: DataFrame,
    books: DataFrame,
    config: ReconConfig = DEFAULTS,
) -> DataFrame:
    """Cancelled, then duplicate, then unlinked credit note, then missing in books.

    ``consumed``: document keys and ids of portal lines earlier passes used. ``numbers``: number
    keys of all lines of both sides. ``books`` only gives the shape of a book line.
    A duplicate repeats a key some earlier pass consumed, or a smaller-id left-over line that is
    not cancelled. Both are group minima or maxima, combined map-side, so no key is gathered.
    """
    live = F.coalesce(F.col("irn_status") != "CANCELLED", F.lit(True))
    seen = (
        consumed.groupBy(*DOCUMENT_KEY)
        .agg(F.max("line_id").alias("consumed_id"))
        .join(
            residue.where(live).groupBy(*DOCUMENT_KEY).agg(F.min("line_id").alias("first_id")),
            DOCUMENT_KEY,
            "right",
        )
    )
    original_key = identifiers.normalise_invoice_number(F.col("original_invoice_number"))
    looked_up = lookup(
        residue.select(
            *DOCUMENT_KEY,
            "line_id",
            "kind",
            "irn",
            "irn_status",
            "original_invoice_number",
            original_key.alias("original_key"),
            whole_row(residue).alias("portal"),
        ),
        seen,
        DOCUMENT_KEY,
        "left",
        config.hot_key_rows,
    )
    looked_up = with_known_originals(looked_up, residue, numbers, config)
    earlier = F.coalesce(
        F.col("consumed_id"),
        F.when(F.col("line_id") > F.col("first_id"), F.col("first_id")),
    )
    unlinked = (F.col("kind") == "CREDIT_NOTE") & F.col("known").isNull()
    cls = (
        F.when(~live, F.lit("CANCELLED_IRN"))
        .when(earlier.isNotNull(), F.lit("DUPLICATE"))
        .when(unlinked, F.lit("CREDIT_NOTE_UNLINKED"))
        .otherwise(F.lit("MISSING_IN_BOOKS"))
    )
    shown_original = F.coalesce(
        F.concat(F.lit("'"), "original_invoice_number", F.lit("'")), F.lit("None")
    )
    detail = (
        F.when(
            ~live,
            F.concat(
                F.lit("IRN "),
                F.coalesce("irn", F.lit("None")),
                F.lit(" is cancelled at the portal but present in 2B"),
            ),
        )
        .when(
            earlier.isNotNull(),
            F.concat(
                F.lit("same supplier and invoice number as "), earlier, F.lit(", reported twice")
            ),
        )
        .when(
            unlinked,
            F.concat(
                F.lit("credit note references "), shown_original, F.lit(", absent from this period")
            ),
        )
        .otherwise(F.lit(TEXT_MISSING_IN_BOOKS))
    )
    duplicate = live & earlier.isNotNull()
    return _stage(
        looked_up.withColumn("book", _no_line(books)),
        STAGE_PORTAL,
        F.col("line_id"),
        cls,
        detail,
        F.when(duplicate, F.array(earlier)).otherwise(F.array().cast("array<string>")),
    )


def classify_book_residue(
    residue: DataFrame, portal: DataFrame, as_of: dt.date, config: ReconConfig = DEFAULTS
) -> DataFrame:
    barred = dates.is_time_barred(F.col("book.invoice_date"), as_of, config)
    detail = F.when(
        barred,
        F.concat(
            F.lit("invoice dated "),
            F.col("book.invoice_date").cast("string"),
            F.lit(" is outside the Section 16(4) window; report only"),
        ),
    ).otherwise(F.lit(TEXT_MISSING_IN_2B))
    lines = residue.select(whole_row(residue).alias("book"), _no_line(portal).alias("portal"))
    return _stage(
        lines,
        STAGE_BOOK,
        F.col("book.line_id"),
        F.when(barred, F.lit("TIME_BARRED")).otherwise(F.lit("MISSING_IN_2B")),
        detail,
    )


def assign_exception_ids(stages: DataFrame) -> DataFrame:
    """Number all exceptions in emission order; the id is ``E00001-<anchor line>``."""
    anchor = F.coalesce("portal.line_id", "book.line_id")
    numbered = global_index(stages, ["stage", "sort_id"], "seq")
    seq = F.col("seq") + 1
    return numbered.select(
        F.concat(F.format_string("E%05d-", seq), anchor).alias("exception_id"),
        seq.alias("seq"),
        "exception_class",
        "book",
        "portal",
        "detail",
        "candidates",
        F.coalesce("portal.supplier_gstin", "book.supplier_gstin").alias("supplier_gstin"),
        F.coalesce("portal.total_tax", "book.total_tax").alias("amount_at_risk"),
    )
