"""Exact pass: equal supplier, number and tax, one to one in line-id order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import TEXT_EXACT
from ledgerlane.functions.money import MONEY
from ledgerlane.operators.scale import rank_zip
from ledgerlane.operators.sides import KEY_COLUMNS

MATCHED_COLUMNS = (
    "book_line_id",
    "portal_line_id",
    "rule",
    "detail",
    "tax_delta",
    "days_apart",
    "number_similarity",
    "exact",
)


def zip_exact(books: DataFrame, portal: DataFrame, config: ReconConfig = DEFAULTS) -> DataFrame:
    """Every line of both sides once, paired where exact.

    Output: document keys, ``book_id`` and ``portal_id``, and the whole line (``book`` or
    ``portal``) only where it is left over. Paired lines are needed by id alone from here on, so
    the table is small even though every document is in it.
    """
    # NULL would group with NULL: a line of unknown tax gets a key of its own.
    def keyed(df: DataFrame, side: str) -> DataFrame:
        own = F.when(F.col("total_tax").isNull(), F.concat(F.lit(side), "line_id"))
        return df.withColumn("own_key", F.coalesce(own, F.lit("")))

    zipped = rank_zip(
        keyed(books, "b"), keyed(portal, "p"), [*KEY_COLUMNS, "own_key"], "line_id", config.hot_key_rows
    )
    alone = F.col("left").isNull() | F.col("right").isNull()
    return zipped.select(
        "gstin_key",
        "num_key",
        F.col("left.line_id").alias("book_id"),
        F.col("right.line_id").alias("portal_id"),
        F.when(alone, F.col("left").dropFields("own_key")).alias("book"),
        F.when(alone, F.col("right").dropFields("own_key")).alias("portal"),
    )


def exact_matches(zipped: DataFrame) -> DataFrame:
    return zipped.where("book_id is not null and portal_id is not null").select(
        F.col("book_id").alias("book_line_id"),
        F.col("portal_id").alias("portal_line_id"),
        F.lit("exact").alias("rule"),
        F.lit(TEXT_EXACT).alias("detail"),
        F.lit(0).cast(MONEY).alias("tax_delta"),
        F.lit(0).alias("days_apart"),
        F.lit(1.0).alias("number_similarity"),
        F.lit(True).alias("exact"),
    )


def left_over(zipped: DataFrame, side: str) -> DataFrame:
    """Lines of one side the pass did not pair."""
    other = "portal" if side == "book" else "book"
    return zipped.where(F.col(f"{side}_id").isNotNull() & F.col(f"{other}_id").isNull()).select(
        f"{side}.*"
    )
