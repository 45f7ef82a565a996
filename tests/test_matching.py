"""Match passes against one-by-one walks, on every physical route."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig
from ledgerlane.operators import exact, suffix
from ledgerlane.operators.scale import cut, global_index, lookup, rank_in_group
from ledgerlane.operators.sides import prepare_side

from tests import models

NUMBERS = ["INV/1", "INV-01", "INV/1-A", "INV/1/A/B", "INV1B", "7", "7A", "A", "", "INV/2"]
ROUTES = {
    "plain": ReconConfig(),
    "hot": ReconConfig(hot_key_rows=3, pair_group_lines=2),
    "rounds": ReconConfig(pair_group_lines=0),
}


def cases():
    out = []
    shapes = {
        "spread": ([Decimal(100) + Decimal(i) / 7 for i in range(12)], range(0, 60, 7)),
        "copies": ([Decimal("100.00"), Decimal("100.50")], [0, 0, 3]),
        "lattice": ([Decimal(100) + Decimal(i) / 2 for i in range(6)], range(0, 6)),
    }
    for name, (taxes, days) in shapes.items():
        taxes = [t.quantize(models.CENT) for t in taxes]
        for seed in range(1):
            out.append(pytest.param(taxes, list(days), seed, id=f"{name}{seed}"))
    return out


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize(("taxes", "days", "seed"), cases())
def test_passes_equal_the_walk(spark, route, taxes, days, seed):
    rng = random.Random(seed)
    config = ROUTES[route]
    gstins = ["27AAPFU0939F1ZV", "29AAPFU0939F1ZR"]
    books = models.random_lines(rng, "B", 30, NUMBERS, taxes, days, gstins)
    portal = models.random_lines(rng, "P", 30, NUMBERS, taxes, days, gstins)
    b, p = (prepare_side(models.to_df(spark, x).repartition(3)) for x in (books, portal))

    zipped = cut(exact.zip_exact(b, p, config))
    got = {tuple(r) for r in exact.exact_matches(zipped).select(
        "book_line_id", "portal_line_id").collect()}
    want = set(models.exact_walk(books, portal))
    assert got == want

    used_b, used_p = {x for x, _ in want}, {x for _, x in want}
    books = [x for x in books if x["line_id"] not in used_b]
    portal = [x for x in portal if x["line_id"] not in used_p]
    taken = suffix.assign_best_first(
        exact.left_over(zipped, "book"), exact.left_over(zipped, "portal"), config
    )
    got = {(r.book_id, r.portal_id) for r in taken.collect()}
    assert got == set(models.tolerant_walk(books, portal))


def test_contested_ties_take_few_rounds(spark, monkeypatch):
    """100,000 lines on three cells: two days of books tie for one day of portal lines."""
    import datetime as dt

    from ledgerlane.operators import rounds

    day = dt.date(2026, 7, 14)
    made = spark.range(100_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 4).alias("kind")
    )

    def lines(kinds, prefix):
        at = F.when(F.col("kind") == 0, day - dt.timedelta(2)).when(F.col("kind") == 1, day + dt.timedelta(2)).otherwise(day)
        return made.where(F.col("kind").isin(kinds)).select(
            F.lit("G").alias("gstin_key"), F.lit("7").alias("num_key"), F.lit(50).cast("decimal(18,2)").alias("total_tax"),
            at.alias("invoice_date"), F.concat(F.lit(prefix), "h").alias("line_id"),
        )

    books, portal = cut(lines([0, 1], "B")), cut(lines([2, 3], "P"))
    used, calls = rounds._use, []
    monkeypatch.setattr(rounds, "_use", lambda *a: calls.append(1) or used(*a))
    got = suffix.assign_best_first(books, portal, ReconConfig(hot_key_rows=20_000))
    found = sorted((r.book_id, r.portal_id) for r in got.collect())
    # One distance for all: the walk takes both sides in id order.
    ids = [sorted(r.line_id for r in df.collect()) for df in (books, portal)]
    assert found == list(zip(*ids)) and len(calls) < 10


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_ties_equal_the_walk(spark, seed):
    """Cells that tie in chains and lattices, with ids that interleave."""
    rng = random.Random(seed)
    taxes = [Decimal(100) + Decimal(i) / 4 for i in range(5)]
    books = models.random_lines(rng, "B", 90, ["7", "7A", "7B"], taxes[::2], [0, 4, 8], ["X"])
    portal = models.random_lines(rng, "P", 90, ["7", "7A", "7B"], taxes[1::2], [2, 6], ["X"])
    b, p = (cut(prepare_side(models.to_df(spark, x))) for x in (books, portal))
    taken = suffix.assign_best_first(b, p, ReconConfig(pair_group_lines=0, hot_key_rows=40))
    assert {(r.book_id, r.portal_id) for r in taken.collect()} == set(models.tolerant_walk(books, portal))


def test_rounds_report_the_same_details(spark):
    rng = random.Random(5)
    taxes = [Decimal("50.00"), Decimal("50.40"), Decimal("51.10")]
    books = models.random_lines(rng, "B", 25, NUMBERS, taxes, [0, 9], ["27AAPFU0939F1ZV"])
    portal = models.random_lines(rng, "P", 25, NUMBERS, taxes, [0, 4], ["27AAPFU0939F1ZV"])
    b, p = (cut(prepare_side(models.to_df(spark, x))) for x in (books, portal))
    reports = [
        sorted(suffix.tolerant_matches(suffix.assign_best_first(b, p, config)).collect())
        for config in ROUTES.values()
    ]
    assert reports[0] and reports[0] == reports[1] == reports[2]


def test_candidate_edges_equal_pairwise_scoring(spark):
    rng = random.Random(9)
    taxes = [Decimal(99) + Decimal(i) / 4 for i in range(9)]
    books = models.random_lines(rng, "B", 30, NUMBERS, taxes, [0, 20, 45], ["X"])
    portal = models.random_lines(rng, "P", 30, NUMBERS, taxes, [0, 20, 45], ["X"])
    b, p = (prepare_side(models.to_df(spark, x)) for x in (books, portal))
    got = {(r[0], r[1], r[2]) for r in suffix.candidate_edges(b, p).collect()}
    want = set()
    for x in books:
        for y in portal:
            score = models.affinity(x["invoice_number"], y["invoice_number"])
            gap = abs((x["invoice_date"] - y["invoice_date"]).days)
            if score and gap <= 30 and abs(x["igst"] - y["igst"]) <= models.allowed(y["igst"]):
                want.add((x["line_id"], y["line_id"], score))
    assert got == want


def test_candidates_far_apart_never_meet(spark):
    """One busy number and tax over ten years: the join's rows grow with the lines, not their square."""
    def lines(prefix, shift):
        return spark.range(2000).select(
            F.lit("G").alias("gstin_key"), F.lit("7").alias("num_key"), F.lit(50).cast("decimal(18,2)").alias("total_tax"),
            F.date_add(F.lit("2016-01-01").cast("date"), (F.col("id") * 2 + shift).cast("int")).alias("invoice_date"),
            F.format_string(prefix + "%05d", "id").alias("line_id"),
        )

    found = suffix.candidate_edges(lines("B", 0), lines("P", 1))
    pairs = found.count()
    assert pairs == sum(1 for i in range(2000) for j in range(max(0, i - 20), min(2000, i + 20)) if abs(2 * i - 2 * j - 1) <= 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "date_band" in join


def test_rank_and_index_with_hot_keys(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.format_string("L%04d", (F.col("id") * 37) % 300).alias("line_id"),
    )
    plain = rank_in_group(df, ["k"], ["line_id"], "r", None).collect()
    split = rank_in_group(df, ["k"], ["line_id"], "r", 20).collect()
    assert {tuple(x) for x in plain} == {tuple(x) for x in split}
    indexed = global_index(df.repartition(5), ["line_id"], "i").collect()
    assert [x.line_id for x in sorted(indexed, key=lambda x: x.i)] == sorted(
        x.line_id for x in indexed
    )
    assert sorted(x.i for x in indexed) == list(range(300))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_with_hot_keys(spark, how):
    left = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    right = spark.range(0, 100, 1).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = lookup(left, right, ["k"], how, None).collect()
    split = lookup(left, right, ["k"], how, 10).collect()
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, split), key=str)
