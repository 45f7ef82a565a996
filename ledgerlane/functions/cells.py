"""Register cells as values: a value or NULL, and for each NULL the problem. Nothing is guessed.

Half-up at two places only looks at the third decimal, so longer fractions are cut there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed_values import DOCUMENT_KIND_WORDS, TEXT_AMBIGUOUS_DATE
from ledgerlane.functions.money import MONEY

# --- fixed values: patterns and words --------------------------------------

CURRENCY = r"(?i)[₹$]|\b(?:INR|RS|RS\.)\b"
STRICT_CURRENCY = r"(?i)[₹$]|\b(?:INR|RS)\b\.?"
PLAIN_AMOUNT = r"\A[0-9]{1,20}(?:\.[0-9]{1,2})?\z"
AMOUNT = r"^(-?(?:[0-9]+|[0-9]*\.[0-9]{1,3}))(?:(?<=\.[0-9]{3})[0-9]+)?$"
DAY_MONTH_YEAR = r"^([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{2,4})$"
ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
NEGATIVE_WORDS = ("", "n", "no", "false", "0", "f")
AFFIRMATIVE_WORDS = ("y", "yes", "true", "1", "t")
DAY_FIRST, MONTH_FIRST, UNRESOLVED = "DAY_FIRST", "MONTH_FIRST", "UNRESOLVED"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def normalise_heading(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "")


def normalise_identifier(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)[,\s]", ""))


def amount_value(text: Column, strict_currency: bool = False) -> Column:
    """Currency cell to decimal(28,2), half-up; NULL where it is not an amount.

    Parentheses or a trailing minus negate; Dr/Cr is dropped. ``Rs. 500`` loses only ``Rs`` and
    reads as 0.50 unless ``strict_currency`` is set, which takes the point with it. One chain of
    replacements, each used once, so the generated code stays small. Digits without any mark, as most
    cells have them, need none of it.
    """
    bare = _without_currency(text, strict_currency)
    inner = strip(F.regexp_replace(bare, r"(?s)^\((.*)\)$", "$1"))
    unsigned = strip(F.regexp_replace(inner, "-$", ""))
    unmarked = F.regexp_replace(unsigned, r"(?i)\b(DR|CR)\b\.?$", "")
    digits = F.regexp_replace(unmarked, r"(?U)[,\s]", "")
    value = F.round(F.regexp_extract(digits, AMOUNT, 1).try_cast("decimal(31,3)"), 2)
    negative = bare.rlike(r"(?s)^\(.*\)$|-$")
    marked = (value * F.when(negative, -1).otherwise(1)).try_cast(MONEY)
    return F.when(text.rlike(PLAIN_AMOUNT), text.try_cast(MONEY)).otherwise(marked)


def _without_currency(text: Column, strict_currency: bool) -> Column:
    return strip(F.regexp_replace(text, STRICT_CURRENCY if strict_currency else CURRENCY, ""))


def amount_problem(text: Column, value: Column, strict_currency: bool = False) -> Column:
    """Why ``amount_value`` gave nothing, or NULL."""
    empty = _without_currency(text, strict_currency) == ""
    return F.when(
        value.isNull(),
        F.when(empty, F.lit("empty amount")).otherwise(
            F.concat(quoted(text), F.lit(" is not an amount"))
        ),
    )


def amount_or_zero(text: Column, strict_currency: bool = False) -> Column:
    """As ``amount_value``, but blank is zero."""
    return F.when(strip(text) == "", F.lit(0).cast(MONEY)).otherwise(
        amount_value(text, strict_currency)
    )


def day_evidence(cell: Column) -> Column:
    """True where only day-first reading is possible (stripped cell)."""
    return cell.rlike(r"^(1[3-9]|[2-9][0-9])\s*[/\-.]\s*[0-9]{1,2}\s*[/\-.]\s*[0-9]{2,4}$")


def month_evidence(cell: Column) -> Column:
    """True where only month-first reading is possible (stripped cell)."""
    return cell.rlike(r"^[0-9]{1,2}\s*[/\-.]\s*(1[3-9]|[2-9][0-9])\s*[/\-.]\s*[0-9]{2,4}$")


def date_order(day_text: Column, month_text: Column) -> Column:
    """struct(order, evidence) from the first value of each kind in a column (NULL: none)."""
    both = day_text.isNotNull() & month_text.isNotNull()
    order = (
        F.when(both, UNRESOLVED)
        .when(day_text.isNotNull(), DAY_FIRST)
        .when(month_text.isNotNull(), MONTH_FIRST)
        .otherwise(UNRESOLVED)
    )
    conflict = F.concat(
        day_text, F.lit(" needs day-first, "), month_text, F.lit(" needs month-first")
    )
    return F.struct(
        order.alias("order"),
        F.coalesce(conflict, day_text, month_text, F.lit("")).alias("evidence"),
    )


def date_value(cell: Column, order: Column) -> Column:
    """Date of a stripped cell under a decided order; an ISO prefix wins whatever the order.

    Both forms are rewritten to ``year-month-day`` text by replacement and read leniently, so an
    impossible day gives NULL. Two-digit years are of this century.
    """
    full_year = F.regexp_replace(cell, r"([/\-.]\s*)([0-9]{2})$", "$1 20$2")
    day_first = F.regexp_replace(full_year, DAY_MONTH_YEAR, "$3-$2-$1")
    month_first = F.regexp_replace(full_year, DAY_MONTH_YEAR, "$3-$1-$2")
    text = (
        F.when(cell.rlike(ISO), F.substring(cell, 1, 10))
        .when(~cell.rlike(DAY_MONTH_YEAR), F.lit(None).cast("string"))
        .when(order == DAY_FIRST, day_first)
        .when(order == MONTH_FIRST, month_first)
    )
    return F.try_to_date(text, "y-M-d")


def date_problem(text: Column, cell: Column, order: Column, value: Column) -> Column:
    """Why ``date_value`` gave nothing, or NULL."""
    is_iso = cell.rlike(ISO)
    unknown = F.concat(quoted(text), F.lit(" is not a date this reader recognises"))
    unclear = F.concat(quoted(text), F.lit(" " + TEXT_AMBIGUOUS_DATE))
    return F.when(
        value.isNull(),
        F.when(~is_iso & ~cell.rlike(DAY_MONTH_YEAR), unknown)
        .when(~is_iso & (order == UNRESOLVED), unclear)
        .otherwise(F.concat(quoted(cell), F.lit(" is not a real date"))),
    )


def is_numeric_date(cell: Column) -> Column:
    """A stripped cell whose reading as a date depends on the order of its parts."""
    return date_value(cell, F.lit(DAY_FIRST)).isNotNull() & ~cell.rlike("^[0-9]{4}")


def flag_value(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(*NEGATIVE_WORDS), False).when(word.isin(*AFFIRMATIVE_WORDS), True)


def flag_problem(text: Column, value: Column) -> Column:
    return F.when(value.isNull(), F.concat(quoted(text), F.lit(" is neither yes nor no")))


def document_kind(text: Column) -> Column:
    words = F.create_map(
        *[F.lit(x) for pair in (("", "INVOICE"), *DOCUMENT_KIND_WORDS.items()) for x in pair]
    )
    return words[normalise_heading(text)]


def document_kind_problem(text: Column, value: Column) -> Column:
    return F.when(
        value.isNull(),
        F.concat(quoted(text), F.lit(" is not a document type this reader knows")),
    )


def excel_serial_to_date(serial: Column, date_system_1904: Column) -> Column:
    """Date behind a spreadsheet serial; NULL for the day that never was (60)."""
    return (
        F.when(date_system_1904, F.date_add(F.lit("1904-01-01").cast("date"), serial))
        .when(serial >= 61, F.date_add(F.lit("1899-12-30").cast("date"), serial))
        .when(serial < 60, F.date_add(F.lit("1899-12-31").cast("date"), serial))
    )
