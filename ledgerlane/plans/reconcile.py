"""The reconciliation job: fixed pass order, each pass working on what the last one left."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig, for_row_count
from ledgerlane.operators import classify, exact, suffix
from ledgerlane.operators.scale import cut
from ledgerlane.operators.sides import assert_unique_ids, prepare_side, split_reverse_charge


@dataclass(frozen=True)
class Reconciliation:
    matched: DataFrame
    exceptions: DataFrame


@dataclass(frozen=True)
class Passes:
    """Intermediate tables of a run, kept so that single stages can be inspected."""

    books: DataFrame
    portal: DataFrame
    reverse_charge: DataFrame
    exact: DataFrame
    tolerant: DataFrame
    amount: DataFrame
    gstin: DataFrame
    portal_residue: DataFrame
    book_residue: DataFrame


def run_passes(
    books: DataFrame,
    portal: DataFrame,
    *,
    as_of: dt.date,
    config: ReconConfig = DEFAULTS,
    check_ids: bool = True,
) -> Passes:
    """All passes. Both sides and four tables are written on the way, each holding what later passes reread.

    After the exact pass the data that moves is the residue, normally a small share of the input.
    """
    # Counts, checks and passes read each side several times; keys are normalised once.
    books, portal = cut(prepare_side(books)), cut(prepare_side(portal))
    if check_ids:
        assert_unique_ids(books)
        assert_unique_ids(portal)
    books, rcm_books = split_reverse_charge(books)
    portal, rcm_portal = split_reverse_charge(portal)

    config = for_row_count(config, books.count() + portal.count())
    zipped = cut(exact.zip_exact(books, portal, config))
    book_rest = exact.left_over(zipped, "book")
    portal_rest = exact.left_over(zipped, "portal")

    taken = cut(suffix.assign_best_first(book_rest, portal_rest, config))
    book_rest = suffix.remove_lines(book_rest, _ids(taken, "book_id"), config)
    portal_rest = suffix.remove_lines(portal_rest, _ids(taken, "portal_id"), config)

    by_amount = cut(classify.pair_amount_mismatches(book_rest, portal_rest, config))
    book_rest = exact.left_over(by_amount, "book")
    portal_rest = exact.left_over(by_amount, "portal")

    by_gstin = cut(classify.pair_gstin_mismatches(book_rest, portal_rest, config))
    book_rest = suffix.remove_lines(book_rest, _ids(by_gstin, "book.line_id"), config)
    portal_rest = suffix.remove_lines(portal_rest, _ids(by_gstin, "portal.line_id"), config)

    # Portal lines the passes used, as keys and ids; every pass wrote what it took.
    both = F.col("book_id").isNotNull() & F.col("portal_id").isNotNull()
    key_and_id = [*classify.DOCUMENT_KEY, "line_id"]
    paired = zipped.where(both).select(
        *classify.DOCUMENT_KEY, F.col("portal_id").alias("line_id")
    )
    consumed = (
        paired.unionByName(
            taken.select(
                "gstin_key",
                F.col("portal_num_key").alias("num_key"),
                F.col("portal_id").alias("line_id"),
            )
        )
        .unionByName(by_amount.where(both).select("portal.*").select(*key_and_id))
        .unionByName(by_gstin.select("portal.*").select(*key_and_id))
    )

    return Passes(
        books=books,
        portal=portal,
        reverse_charge=classify.pair_reverse_charge(rcm_books, rcm_portal, config),
        exact=exact.exact_matches(zipped),
        tolerant=suffix.tolerant_matches(taken),
        amount=classify.amount_mismatches(by_amount),
        gstin=classify.gstin_mismatches(by_gstin),
        portal_residue=classify.classify_portal_residue(
            portal_rest, consumed, zipped.select("num_key"), book_rest, config
        ),
        book_residue=classify.classify_book_residue(book_rest, portal_rest, as_of, config),
    )


def _ids(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col(column).alias("line_id"))


def reconcile(
    books: DataFrame,
    portal: DataFrame,
    *,
    as_of: dt.date,
    config: ReconConfig = DEFAULTS,
    check_ids: bool = True,
) -> Reconciliation:
    return number_stages(
        run_passes(books, portal, as_of=as_of, config=config, check_ids=check_ids)
    )


def number_stages(passes: Passes) -> Reconciliation:
    stages = (
        passes.reverse_charge.unionByName(passes.amount)
        .unionByName(passes.gstin)
        .unionByName(passes.portal_residue)
        .unionByName(passes.book_residue)
    )
    return Reconciliation(
        matched=passes.exact.unionByName(passes.tolerant),
        exceptions=classify.assign_exception_ids(stages),
    )


def conservation(
    books: DataFrame, portal: DataFrame, result: Reconciliation
) -> DataFrame:
    """Lines that do not appear exactly once, reverse-charge portal reuse aside."""
    inputs = books.select(F.lit("book").alias("side"), "line_id").union(
        portal.select(F.lit("portal").alias("side"), "line_id")
    )
    matched, exceptions = result.matched, result.exceptions
    rows = [
        matched.select(F.lit("book").alias("side"), F.col("book_line_id").alias("line_id")),
        matched.select(F.lit("portal").alias("side"), F.col("portal_line_id").alias("line_id")),
        exceptions.where("book is not null").select(
            F.lit("book").alias("side"), F.col("book.line_id").alias("line_id")
        ),
        exceptions.where("portal is not null and exception_class <> 'RCM'").select(
            F.lit("portal").alias("side"), F.col("portal.line_id").alias("line_id")
        ),
        exceptions.where("portal is not null and exception_class = 'RCM'")
        .select(F.lit("portal").alias("side"), F.col("portal.line_id").alias("line_id"))
        .distinct(),
    ]
    outputs = rows[0]
    for more in rows[1:]:
        outputs = outputs.union(more)
    counted = inputs.withColumn("seen_in", F.lit(1)).withColumn("seen_out", F.lit(0)).unionByName(
        outputs.withColumn("seen_in", F.lit(0)).withColumn("seen_out", F.lit(1))
    )
    return counted.groupBy("side", "line_id").agg(
        F.sum("seen_in").alias("times_in"), F.sum("seen_out").alias("times_out")
    )
