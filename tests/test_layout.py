"""Stored tables in folders and buckets: what a plan reads and moves."""

import re

from ledgerlane.plans import layout_queries
from ledgerlane.sources import tables

TYPES = "line_id string, supplier_gstin string, invoice_number string, tax long, return_period string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def statement(spark, tmp_path, rows=None):
    if rows is None:
        rows = [(f"P{i:03d}", f"S{i % 3}", f"N{i % 40}", i, f"{i % 12 + 1:02d}-2026") for i in range(240)]
        rows += [("P900", None, "N1", 1, "12-2026"), ("P901", "S1", None, 1, "12-2026"), ("P902", "S1", "N1", 1, None)]
    df = spark.createDataFrame(rows, TYPES)
    name, _ = layout_queries._place(spark, "statement")
    return name, tables.save_bucketed(df, name, f"{tmp_path}/{name}", tables.STATEMENT_KEY, 4, "return_period")


def register(spark, tmp_path):
    rows = [(f"B{i:03d}", f"S{i % 3}", f"N{i % 50}", i * 1.0) for i in range(150)] + [("B900", None, "N1", 1.0)]
    df = spark.createDataFrame(rows, "line_id string, supplier_gstin string, invoice_number string, igst double")
    for head in ("cgst", "sgst", "cess"):
        df = df.selectExpr("*", f"0.0D AS {head}")
    name, _ = layout_queries._place(spark, "register")
    return tables.save_bucketed(df, name, f"{tmp_path}/{name}", tables.STATEMENT_KEY, 4)


def returns(spark, periods):
    rows = [(f"{m:02d}-2026", "open" if m in periods else "filed") for m in range(1, 13)]
    return spark.createDataFrame(rows, "return_period string, status string")


def test_open_returns_read_their_folders_only(spark, tmp_path):
    _, stored = statement(spark, tmp_path)
    due = tables.open_periods(stored, returns(spark, {2, 5}))
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", plan_of(due))
    files = {r[0] for r in due.selectExpr("input_file_name()").distinct().collect()}
    assert {re.search("return_period=([^/]+)", f)[1] for f in files} == {"02-2026", "05-2026"}


def test_lines_meet_the_register_without_an_exchange(spark, tmp_path):
    _, stored = statement(spark, tmp_path)
    met = tables.booked_against(stored, register(spark, tmp_path))
    plan = plan_of(met)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {r.line_id: (r.booked, r.first_book, r.booked_tax) for r in met.collect()}
    assert len(got) == 243
    books = [(f"B{i:03d}", f"S{i % 3}", f"N{i % 50}", i * 1.0) for i in range(150)]
    for i in range(240):
        mine = [(b, t) for b, s, n, t in books if (s, n) == (f"S{i % 3}", f"N{i % 40}")]
        want = (len(mine), min(mine)[0] if mine else None, sum(t for _, t in mine) if mine else None)
        assert (got[f"P{i:03d}"][0], got[f"P{i:03d}"][1]) == want[:2]
        assert got[f"P{i:03d}"][2] is None if want[2] is None else float(got[f"P{i:03d}"][2]) == want[2]
    # What is unknown equals nothing.
    assert got["P900"][0] == got["P901"][0] == 0 and got["P902"][0] == 1


def test_a_stored_table_is_opened_again(spark, tmp_path):
    name, stored = statement(spark, tmp_path)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    again = tables.open_bucketed(
        spark, f"{name}_again", f"{tmp_path}/{name}", types, tables.STATEMENT_KEY, 4, "return_period"
    )
    assert again.exceptAll(stored).isEmpty() and again.count() == 243
    assert "Exchange" not in plan_of(again.groupBy(*tables.STATEMENT_KEY).count())


def test_an_empty_statement(spark, tmp_path):
    _, stored = statement(spark, tmp_path, rows=[])
    assert tables.open_periods(stored, returns(spark, {1})).count() == 0
    assert tables.booked_against(stored, register(spark, tmp_path)).count() == 0


def test_stored_precedents_do_not_move_to_meet_new_ones(spark, tmp_path):
    from ledgerlane.operators.precedents import add_precedents

    types = "precedent_id string, exception_class string, gstin string, summary string, human_confirmed boolean"
    cases = [(f"C{i}", "DUPLICATE" if i % 2 else "AMOUNT_MISMATCH", f"G{i % 5}", f"case {i}", i % 7 != 0) for i in range(60)]
    name, folder = layout_queries._place(spark, "precedents")
    tables.store_precedents(spark.createDataFrame(cases[:40], types), name, f"{tmp_path}/{name}", 4)
    stored = tables.store_precedents(spark.createDataFrame([*cases, *cases[:30]], types), name, f"{tmp_path}/{name}", 4)
    ids = [r.precedent_id for r in stored.collect()]
    assert sorted(ids) == sorted(c[0] for c in cases if c[4])
    plan = plan_of(add_precedents(spark.createDataFrame(cases, types), stored.hint("merge"), 4))
    assert plan.count("Exchange") == 1  # the incoming cases
    assert tables.store_precedents(spark.createDataFrame([], types), name, "", 4).count() == len(ids)


def test_buckets_grow_in_powers_of_two():
    assert [tables.buckets_for(n) for n in (0, 8_000_000, 8_000_001, 10**10)] == [2, 2, 4, 4096]
