"""Registered queries: stored tables whose layout spares scans and exchanges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import money
from ledgerlane.operators.scale import cut, shared_dir
from ledgerlane.plans.evidence_queries import derived_precedents
from ledgerlane.plans.ledger_queries import as_double
from ledgerlane.sources import derived, tables

OPEN_RETURNS = 6
"""The last returns of the statement, still open."""


def _place(spark, name: str) -> tuple[str, str]:
    """A new table name and its folder below the shared one."""
    name = f"{name}_{uuid.uuid4().hex}"
    return name, f"{shared_dir(spark)}/{name}"


def returns_of(statement: DataFrame) -> DataFrame:
    """Every period of the statement, the last ones open."""
    period = F.col("return_period")
    periods = cut(statement.select("return_period").distinct().withColumn("month", F.concat(F.substring(period, 4, 4), F.substring(period, 1, 2))))
    last = periods.orderBy(F.desc("month")).limit(OPEN_RETURNS).select("return_period", F.lit("open").alias("status"))
    return cut(periods.join(last, "return_period", "left").select("return_period", F.coalesce("status", F.lit("filed")).alias("status")))


def laid_out(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Statement by return period and register, both stored in buckets of documents."""
    books, portal = derived.books(spark, sf_dir), derived.portal(spark, sf_dir)
    buckets = tables.buckets_for(max(books.count(), portal.count()))
    statement = tables.save_bucketed(portal, *_place(spark, "statement"), tables.STATEMENT_KEY, buckets, "return_period")
    register = tables.save_bucketed(books, *_place(spark, "register"), tables.STATEMENT_KEY, buckets)
    return statement, register


def statement_open(spark, sf_dir) -> DataFrame:
    """Each line of the open returns with what the register has of its document."""
    statement, register = laid_out(spark, sf_dir)
    lines = tables.open_periods(statement, returns_of(statement))
    gap = money.total_tax() - F.coalesce("booked_tax", F.lit(0))
    return tables.booked_against(lines, register).select(
        "line_id", "return_period", "booked", F.coalesce("first_book", F.lit("")).alias("first_book"),
        gap.alias("tax_gap"),
    ).withColumn("tax_gap", as_double("tax_gap"))


def precedents_stored(spark, sf_dir) -> DataFrame:
    """Precedents stored in two batches, the second holding all of the first once more; and how often each is there."""
    cases = derived_precedents(spark, sf_dir)
    name, folder = _place(spark, "precedents")
    buckets = tables.buckets_for(cases.count())
    tables.store_precedents(cases.where("exception_class <> 'AMOUNT_MISMATCH'"), name, folder, buckets)
    stored = tables.store_precedents(cases, name, folder, buckets)
    return stored.groupBy("precedent_id").agg(
        F.count(F.lit(1)).alias("stored"), F.max("exception_class").alias("exception_class"),
        F.max("norm_squared").cast("long").alias("norm_squared"),
    )


QUERIES = {
    "statement_open": statement_open,
    "precedents_stored": precedents_stored,
}
