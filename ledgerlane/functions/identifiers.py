"""Supplier ids and invoice numbers.

Formatting is canonicalised, content is never repaired. Everything here is a built-in string
expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed_values import GSTIN_PATTERN

GSTIN_CHARS = 15
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOUBLED_ALPHABET = "".join(low + high for low, high in zip(ALPHABET[:18], ALPHABET[18:]))


def normalise_gstin(raw: Column) -> Column:
    """Delete all white space (Unicode included), upper-case."""
    return F.upper(F.regexp_replace(raw, r"(?U)\s+", ""))


def gstin_check_char(body: Column) -> Column:
    """Check character of a 14-character body, base 36 with alternating weights 1 and 2.

    Doubling then adding base-36 quotient and remainder maps 0,1,..17,18,..35 to
    0,2,..34,1,..35, so the doubled positions are looked up in an alphabet in that order. The sum
    is fourteen plain terms and stays in generated code, where an array fold would not.
    """
    total = F.lit(-(GSTIN_CHARS - 1))
    for position in range(1, GSTIN_CHARS):
        alphabet = DOUBLED_ALPHABET if position % 2 == 0 else ALPHABET
        total = total + F.instr(F.lit(alphabet), F.substring(body, position, 1))
    return F.substring(F.lit(ALPHABET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def check_gstin(raw: Column) -> Column:
    """struct(normalised, well_formed, checksum_valid, reason, state_code)."""
    return check_normalised_gstin(normalise_gstin(raw))


def check_normalised_gstin(gstin: Column) -> Column:
    """As ``check_gstin`` for an id already normalised; cheapest when that is a stored column."""
    right_length = F.length(gstin) == GSTIN_CHARS
    well_formed = right_length & gstin.rlike(GSTIN_PATTERN)
    expected = gstin_check_char(F.substring(gstin, 1, GSTIN_CHARS - 1))
    actual = F.substring(gstin, GSTIN_CHARS, 1)
    valid = well_formed & (expected == actual)
    reason = (
        F.when(
            ~right_length,
            F.concat(F.lit("length "), F.length(gstin).cast("string"), F.lit(", expected 15")),
        )
        .when(~well_formed, F.lit("does not match GSTIN structure"))
        .when(
            ~valid,
            F.concat(
                F.lit("check character '"), actual, F.lit("', expected '"), expected, F.lit("'")
            ),
        )
    )
    return F.struct(
        gstin.alias("normalised"),
        well_formed.alias("well_formed"),
        valid.alias("checksum_valid"),
        reason.alias("reason"),
        F.when(well_formed, F.substring(gstin, 1, 2)).alias("state_code"),
    )


def is_valid_normalised_gstin(gstin: Column) -> Column:
    return gstin.rlike(GSTIN_PATTERN) & (
        gstin_check_char(F.substring(gstin, 1, GSTIN_CHARS - 1))
        == F.substring(gstin, GSTIN_CHARS, 1)
    )


def normalise_invoice_number(raw: Column) -> Column:
    """Letter runs and digit runs joined by ``|``; digit runs lose leading zeros."""
    separated = F.regexp_replace(F.upper(raw), "[^A-Z0-9]+", "|")
    split = F.regexp_replace(separated, "(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Z])", "|")
    unpadded = F.regexp_replace(split, "(?<![0-9])0+(?=[0-9])", "")
    return F.regexp_replace(unpadded, r"^\|+|\|+$", "")


def invoice_tokens(raw: Column) -> Column:
    number = normalise_invoice_number(raw)
    return F.when(number == "", F.array().cast("array<string>")).otherwise(
        F.split(number, r"\|")
    )


def parent_number(number: Column) -> Column:
    """A normalised number without its last token if that token is letters, else NULL."""
    return F.when(
        number.rlike(r"(^|\|)[A-Z]+$"), F.regexp_replace(number, r"(^|\|)[A-Z]+$", "")
    )


def root_number(number: Column) -> Column:
    """A normalised number without all trailing letter tokens.

    Suffix variants share their root, so (supplier, root) bounds every candidate pairing.
    """
    return F.regexp_replace(number, r"(^|\|)[A-Z]+(\|[A-Z]+)*$", "")


def numbers_compatible(left: Column, right: Column) -> Column:
    """struct(compatible, reason, affinity) for two raw invoice numbers."""
    left_number, right_number = normalise_invoice_number(left), normalise_invoice_number(right)
    left_size = F.size(invoice_tokens(left))
    right_size = F.size(invoice_tokens(right))
    shorter = F.when(left_size <= right_size, left_number).otherwise(right_number)
    longer = F.when(left_size <= right_size, right_number).otherwise(left_number)
    stem = F.when(shorter == "", F.lit("")).otherwise(F.concat(shorter, F.lit("|")))
    extra = longer.substr(F.length(stem) + 1, F.length(longer))
    equal = left_number == right_number
    extends = longer.startswith(stem) & (extra != "")
    one_word = extra.rlike("^[A-Z]+$")
    shown = F.concat(
        F.lit("('"),
        F.regexp_replace(extra, r"\|", "', '"),
        F.when(extra.contains("|"), F.lit("')")).otherwise(F.lit("',)")),
    )
    return F.struct(
        (equal | (extends & one_word)).alias("compatible"),
        F.when(equal, F.lit("identical after normalisation"))
        .when(~extends, F.lit("token sequences diverge"))
        .when(~one_word, F.concat(F.lit("extra identifying tokens "), shown))
        .otherwise(suffix_reason(extra))
        .alias("reason"),
        F.when(equal, F.lit(1.0))
        .when(extends & one_word, F.lit(0.9))
        .otherwise(F.lit(0.0))
        .alias("affinity"),
    )


def suffix_reason(extra: Column) -> Column:
    return F.concat(F.lit("house-style suffix '"), extra, F.lit("'"))
