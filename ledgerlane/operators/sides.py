"""The two sides of a reconciliation in one common shape, with their match keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import identifiers
from ledgerlane.functions.money import MONEY, total_tax

LINE_TYPES = {
    "line_id": "string",
    "supplier_gstin": "string",
    "invoice_number": "string",
    "invoice_date": "date",
    "taxable": MONEY,
    "cgst": MONEY,
    "sgst": MONEY,
    "igst": MONEY,
    "cess": MONEY,
    "kind": "string",
    "reverse_charge": "boolean",
    "irn": "string",
    "irn_status": "string",
    "original_invoice_number": "string",
}
KEY_COLUMNS = ["gstin_key", "num_key", "total_tax"]


def prepare_side(df: DataFrame) -> DataFrame:
    """Common columns plus supplier key, number key and total tax, each computed once.

    A tax head without a column is 0.00; a NULL in a column makes the total unknown, and a line of
    unknown tax equals no other line.
    """
    absent = {name: 0 for name in ("cgst", "sgst", "igst", "cess")}
    columns = [
        (F.col(name) if name in df.columns else F.lit(absent.get(name))).cast(kind).alias(name)
        for name, kind in LINE_TYPES.items()
    ]
    return df.select(*columns).select(
        "*",
        identifiers.normalise_gstin(F.coalesce("supplier_gstin", F.lit(""))).alias("gstin_key"),
        identifiers.normalise_invoice_number(F.coalesce("invoice_number", F.lit(""))).alias(
            "num_key"
        ),
        total_tax().alias("total_tax"),
    )


def assert_unique_ids(df: DataFrame, column: str = "line_id") -> None:
    """Line ids are the only order the results rest on, so repeats are refused."""
    repeated = df.groupBy(column).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{column} {repeated[0][0]!r} occurs more than once")


def split_reverse_charge(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary lines, reverse-charge lines)."""
    flag = F.coalesce("reverse_charge", F.lit(False))
    return df.where(~flag), df.where(flag)
