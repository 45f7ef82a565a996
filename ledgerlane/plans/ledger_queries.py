"""Registered queries over the derived ledger: matching stages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.operators import suffix, summaries
from ledgerlane.operators.scale import cut
from ledgerlane.plans import reconcile as plan
from ledgerlane.sources import derived

_runs: dict[tuple, tuple[plan.Passes, plan.Reconciliation]] = {}


def ledger(spark: SparkSession, sf_dir: str) -> tuple[plan.Passes, plan.Reconciliation]:
    """One reconciliation run per session and state of the files.

    A run ends in written tables, so the many queries that inspect it read those tables instead
    of running the passes again.
    """
    key = derived.state(spark, sf_dir)
    if key not in _runs:
        books, portal = derived.books(spark, sf_dir), derived.portal(spark, sf_dir)
        passes = plan.run_passes(books, portal, as_of=derived.AS_OF)
        _runs[key] = (passes, plan.number_stages(passes))
    return _runs[key]


def forget_runs() -> None:
    _runs.clear()


def as_double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def line_id(side: str) -> Column:
    return F.coalesce(f"{side}.line_id", F.lit("")).alias(f"{side}_line_id")


def listed(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def exact_match(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].exact.select("book_line_id", "portal_line_id")


def _sides_after_exact(spark, sf_dir):
    passes = ledger(spark, sf_dir)[0]
    matched = passes.exact
    books = passes.books.join(
        matched.select(F.col("book_line_id").alias("line_id")), "line_id", "left_anti"
    )
    portal = passes.portal.join(
        matched.select(F.col("portal_line_id").alias("line_id")), "line_id", "left_anti"
    )
    return books, portal


def fuzzy_candidates(spark, sf_dir) -> DataFrame:
    edges = suffix.candidate_edges(*_sides_after_exact(spark, sf_dir))
    return edges.select(
        "book_line_id",
        "portal_line_id",
        "affinity",
        as_double("tax_delta"),
        F.col("days_apart").cast("long").alias("days_apart"),
    )


def fuzzy_assignment(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].tolerant.select(
        "book_line_id",
        "portal_line_id",
        "number_similarity",
        as_double("tax_delta"),
        F.col("days_apart").cast("long").alias("days_apart"),
        "detail",
    )


def reverse_charge_pairs(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].reverse_charge.select(
        line_id("book"), line_id("portal"), "detail"
    )


def amount_mismatch(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].amount.select(line_id("book"), line_id("portal"), "detail")


def gstin_mismatch(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].gstin.select(
        line_id("book"), line_id("portal"), "detail", listed("candidates")
    )


def portal_residue(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].portal_residue.select(
        line_id("portal"), "exception_class", "detail", listed("candidates")
    )


def book_residue(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[0].book_residue.select(
        line_id("book"), "exception_class", "detail"
    )


def reconcile_full(spark, sf_dir) -> DataFrame:
    """The flagship: every exception of a whole reconciliation, numbered."""
    return ledger(spark, sf_dir)[1].exceptions.select(
        "exception_id",
        "seq",
        "exception_class",
        line_id("book"),
        line_id("portal"),
        "detail",
        listed("candidates"),
        "supplier_gstin",
        as_double("amount_at_risk"),
    )


def match_summary(spark, sf_dir) -> DataFrame:
    result = ledger(spark, sf_dir)[1]
    return (
        summaries.match_summary(result.matched, result.exceptions)
        .withColumn("exact_rate", F.round("exact_rate", 6))
        .withColumn("fuzzy_rate", F.round("fuzzy_rate", 6))
    )


def exceptions_by_class(spark, sf_dir) -> DataFrame:
    return summaries.exceptions_by_class(ledger(spark, sf_dir)[1].exceptions)


def conservation(spark, sf_dir) -> DataFrame:
    counted = plan.conservation(
        derived.books(spark, sf_dir), derived.portal(spark, sf_dir), ledger(spark, sf_dir)[1]
    )
    return counted.groupBy("side", "times_in", "times_out").agg(
        F.count(F.lit(1)).alias("lines")
    )


def contested_assignment(spark, sf_dir) -> DataFrame:
    """All orders as lines of one number per priority, far above the lines that one row may score: books
    of two days tie for portal lines of the day between, so the ids of both alone decide.
    """
    key, day = F.col("o_orderkey"), F.lit(derived.AS_OF)
    lines = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("gstin_key"),
        F.lit("7").alias("num_key"),
        F.lit(50).cast("decimal(18,2)").alias("total_tax"),
        F.when(F.col("o_custkey") % 2 == 0, day)
        .when(key % 2 == 0, F.date_sub(day, 2)).otherwise(F.date_add(day, 2)).alias("invoice_date"),
        F.format_string("L%012d", key).alias("line_id"),
    )
    lines = cut(lines)
    is_portal = F.col("invoice_date") == day
    taken = suffix.assign_best_first(lines.where(~is_portal), lines.where(is_portal))
    return taken.select(
        F.col("book_id").alias("book_line_id"), F.col("portal_id").alias("portal_line_id"),
        F.col("gap").cast("long").alias("days_apart"),
    )


QUERIES = {
    "contested_assignment": contested_assignment,
    "reconcile_full": reconcile_full,
    "exact_match": exact_match,
    "fuzzy_candidates": fuzzy_candidates,
    "fuzzy_assignment": fuzzy_assignment,
    "reverse_charge_pairs": reverse_charge_pairs,
    "amount_mismatch": amount_mismatch,
    "gstin_mismatch": gstin_mismatch,
    "portal_residue": portal_residue,
    "book_residue": book_residue,
    "match_summary": match_summary,
    "exceptions_by_class": exceptions_by_class,
    "conservation": conservation,
}
