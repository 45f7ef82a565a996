"""Whole reconciliations: against the walk, generated truth, conservation, input order."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane import ReconConfig, reconcile
from ledgerlane.fixed_values import DISTRIBUTION_MIX
from ledgerlane.operators.sides import assert_unique_ids
from ledgerlane.plans.reconcile import conservation
from ledgerlane.sources.generated import generate_cycle, pattern_length

from tests import models

GSTINS = ["27AAPFU0939F1ZV", "29AAPFU0939F1Z0", "27AAPFU0993F1ZV"]
NUMBERS = ["INV/1", "INV-01", "INV/1-A", "INV/1/A/B", "7", "CN/INV/1", "INV/2", "INV/3"]
AS_OF = dt.date(2026, 7, 14)


def random_side(rng, prefix, count):
    taxes = [Decimal("100.00"), Decimal("100.50"), Decimal("400.00")]
    days = [0, 5, 50, -900]
    lines = models.random_lines(rng, prefix, count, NUMBERS, taxes, days, GSTINS)
    for line in lines:
        line["reverse_charge"] = rng.random() < 0.15
        line["irn_status"] = rng.choice(["ACTIVE", "ACTIVE", "CANCELLED"])
        line["kind"] = rng.choice(["INVOICE", "INVOICE", "CREDIT_NOTE"])
        line["original_invoice_number"] = rng.choice([None, "inv 001", "ABSENT/9"])
    return lines


def to_df(spark, lines):
    base = models.to_df(spark, lines).drop("kind", "reverse_charge")
    extra = spark.createDataFrame(
        [(x["line_id"], x["kind"], x["reverse_charge"], x["irn_status"],
          x["original_invoice_number"]) for x in lines],
        "line_id string, kind string, reverse_charge boolean, irn_status string, "
        "original_invoice_number string",
    )
    return base.join(extra, "line_id")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "config", [ReconConfig(), ReconConfig(hot_key_rows=5, pair_group_lines=6, broadcast_rows=0)],
    ids=["plain", "hot"],
)
def test_equals_the_walk(spark, config, seed):
    rng = random.Random(seed)
    books, portal = random_side(rng, "B", 60), random_side(rng, "P", 70)
    result = reconcile(
        to_df(spark, books), to_df(spark, portal), as_of=AS_OF, config=config, check_ids=True
    )
    want_matched, want = models.reconcile_walk(books, portal, AS_OF)
    got_matched = sorted(
        tuple(r) for r in result.matched.select("book_line_id", "portal_line_id").collect()
    )
    assert got_matched == want_matched
    got = result.exceptions.orderBy("seq").select(
        "exception_id", "exception_class", "book.line_id", "portal.line_id", "candidates"
    ).collect()
    assert [(r[0], r[1], r[2], r[3], tuple(r[4])) for r in got] == want


@pytest.fixture(scope="module")
def cycle(spark):
    size = pattern_length(1800, 120, DISTRIBUTION_MIX)
    return generate_cycle(
        spark.range(size), seed=20260726, period="07-2026", base_date=AS_OF
    )


def test_planted_classes_and_near_misses_are_recovered(spark, cycle):
    result = reconcile(cycle.books, cycle.portal, as_of=AS_OF)
    found = Counter(r[0] for r in result.exceptions.select("exception_class").collect())
    assert found == Counter(DISTRIBUTION_MIX)
    pairs = {tuple(r) for r in result.matched.where("not exact").select(
        "book_line_id", "portal_line_id").collect()}
    assert {tuple(r) for r in cycle.near_misses.collect()} == pairs
    assert result.matched.where("exact").count() == 1800 + DISTRIBUTION_MIX["DUPLICATE"]
    counted = conservation(cycle.books, cycle.portal, result)
    assert counted.where("times_in <> 1 or times_out <> 1").isEmpty()
    truth = {r.exception_key: r.exception_class for r in cycle.truth.collect()}
    got = {r.exception_id.split("-", 1)[1]: r.exception_class for r in result.exceptions.collect()}
    assert got == truth


def test_input_order_and_partitioning_do_not_matter(spark, cycle):
    runs = []
    for shuffled in (False, True):
        books, portal = cycle.books, cycle.portal
        if shuffled:
            books = books.repartition(7).sortWithinPartitions(F.desc("line_id"))
            portal = portal.repartition(3, "invoice_date")
        result = reconcile(books, portal, as_of=AS_OF)
        runs.append((sorted(map(tuple, result.matched.collect())),
                     sorted(map(tuple, result.exceptions.collect()), key=lambda r: r[1])))
    assert runs[0] == runs[1]


def test_generation_is_repeatable_and_valid(spark, cycle):
    from ledgerlane.functions.identifiers import check_gstin

    again = generate_cycle(
        spark.range(0, 2120, 1, 5), seed=20260726, period="07-2026", base_date=AS_OF
    )
    assert cycle.books.exceptAll(again.books).isEmpty()
    checked = cycle.portal.select(check_gstin(F.col("supplier_gstin")).alias("c"))
    assert checked.where("not c.checksum_valid").isEmpty()
    other = generate_cycle(spark.range(50), seed=1, period="07-2026", base_date=AS_OF)
    assert not other.books.exceptAll(cycle.books).isEmpty()


def test_repeated_line_ids_are_refused(spark):
    df = spark.createDataFrame([("a",), ("a",)], "line_id string")
    with pytest.raises(ValueError, match="occurs more than once"):
        assert_unique_ids(df)


def test_a_large_invoice_does_not_absorb_a_large_difference(spark):
    money = "decimal(28,2)"
    types = (
        "line_id string, supplier_gstin string, invoice_number string, invoice_date date, "
        f"taxable {money}, cgst {money}, sgst {money}, igst {money}, cess {money}, "
        "kind string, reverse_charge boolean"
    )

    def line(name, cgst):
        amounts = [Decimal(x) for x in ("10000000", cgst, "900000", "0", "0")]
        return spark.createDataFrame(
            [(name, GSTINS[0], "INV/1", AS_OF, *amounts, "INVOICE", False)], types
        )

    result = reconcile(line("b", "900000"), line("p", "900500"), as_of=AS_OF)
    row = result.exceptions.first()
    assert row.exception_class == "AMOUNT_MISMATCH"
    assert row.detail == "tax differs by 500.00, beyond configured tolerance"
