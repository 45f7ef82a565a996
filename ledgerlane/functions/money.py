"""Amounts: decimal(28,2), half-up, never floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig

MONEY = "decimal(28,2)"


def money(value: Column) -> Column:
    """Two decimals, half-up. Pass doubles through ``money_of_double``."""
    return F.round(value.cast("decimal(38,10)"), 2).cast(MONEY)


def money_of_double(value: Column) -> Column:
    """Round the decimal literal a double prints as, not its binary value."""
    return money(value.cast("string"))


def literal(amount) -> Column:
    return F.lit(amount).cast(MONEY)


def total_tax(cgst="cgst", sgst="sgst", igst="igst", cess="cess") -> Column:
    return (F.col(cgst) + F.col(sgst) + F.col(igst) + F.col(cess)).cast(MONEY)


def invoice_value(taxable: Column, tax: Column) -> Column:
    return (taxable + tax).cast(MONEY)


def is_interstate(igst: Column) -> Column:
    return igst > 0


def well_formed_split(cgst: Column, sgst: Column, igst: Column) -> Column:
    return ~(((cgst > 0) | (sgst > 0)) & (igst > 0))


def tax_difference(left: Column, right: Column) -> Column:
    return F.abs(left - right).cast(MONEY)


def allowed_difference(portal_tax: Column, config: ReconConfig) -> Column:
    """The looser of a flat slack and a capped share of the portal-side tax."""
    share = F.round(portal_tax * F.lit(config.tax_fraction).cast("decimal(6,4)"), 2).cast(MONEY)
    return F.greatest(literal(config.tax_slack), F.least(share, literal(config.tax_cap)))


def tax_within_tolerance(book_tax: Column, portal_tax: Column, config: ReconConfig) -> Column:
    """struct(within, delta, allowed)."""
    delta = tax_difference(book_tax, portal_tax)
    allowed = allowed_difference(portal_tax, config)
    return F.struct(
        (delta <= allowed).alias("within"), delta.alias("delta"), allowed.alias("allowed")
    )


def plain(amount: Column) -> Column:
    """Decimal text with its two places, as messages and digests show it."""
    return amount.cast(MONEY).cast("string")
