"""Scalar expressions on the representative cases."""

import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.functions import cells, dates, digests, identifiers, money, statistics

from tests import models


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def many(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", build(F.col("x"))).collect())]


def test_numbers_normalise_and_compare(spark):
    pairs = [("KX/88/0042", "kx-88-42"), ("q 9 000", "Q/9/0"), ("ZZ-0100", "zz 100")]
    for left, right in pairs:
        a, b = many(spark, identifiers.normalise_invoice_number, [left, right])
        assert a == b
    a, b = many(spark, identifiers.normalise_invoice_number, ["KX/4/42", "KX/44/2"])
    assert a != b
    cases = {
        ("KX0881", "KX0902"): (False, "token sequences diverge", 0.0),
        ("KX/55", "KX/55/3"): (False, "extra identifying tokens ('3',)", 0.0),
        ("KX0881", "KX0881-B"): (True, "house-style suffix 'B'", 0.9),
        ("KX/55/3", "KX-55-003"): (True, "identical after normalisation", 1.0),
        ("X-A-B", "X"): (False, "extra identifying tokens ('A', 'B')", 0.0),
        ("", "A"): (True, "house-style suffix 'A'", 0.9),
    }
    df = spark.createDataFrame(list(cases), "l string, r string")
    got = df.select("l", "r", identifiers.numbers_compatible(F.col("l"), F.col("r"))).collect()
    assert {(r[0], r[1]): tuple(r[2]) for r in got} == cases


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("AB09/- ax", max_size=9), min_size=40, max_size=60))
def test_number_keys_equal_the_tokens(spark, numbers):
    got = many(spark, identifiers.normalise_invoice_number, numbers)
    assert got == ["|".join(models.tokens(n)) for n in numbers]
    assert many(spark, identifiers.normalise_invoice_number, got) == got
    sizes = many(spark, lambda x: F.size(identifiers.invoice_tokens(x)), numbers)
    assert sizes == [len(models.tokens(n)) for n in numbers]


def test_gstin_checks(spark):
    bodies = ["27AAPFU0939F1Z", "29ABCDE1234F2Z", "07ZZZZZ9999Z9Z", "36QWERT0000Y1Z"]
    got = many(spark, identifiers.gstin_check_char, bodies)
    assert got == [models.check_char(b) for b in bodies] and got[0] == "V"
    values = ["27aapfu0939f1zv", " 27AAPFU 0939F1ZV", "27AAPFU0939F1Z", "27AAPFU0939F1ZX", "4" * 15]
    reasons = many(spark, lambda x: identifiers.check_gstin(x)["reason"], values)
    assert reasons == [
        None, None, "length 14, expected 15", "check character 'X', expected 'V'",
        "does not match GSTIN structure",
    ]
    valid = many(
        spark, lambda x: identifiers.is_valid_normalised_gstin(identifiers.normalise_gstin(x)), values
    )
    assert valid == [True, True, False, False, False]


def test_money_rounds_half_up(spark):
    values = ["1.005", "-1.005", "2.675", "0.994999", "1E+2"]
    got = many(spark, money.money, values)
    assert got == [Decimal(x) for x in ("1.01", "-1.01", "2.68", "0.99", "100.00")]
    assert one(spark, money.money_of_double(F.col("x")), 2.675, "double") == Decimal("2.68")


@pytest.mark.parametrize(
    ("portal", "allowed"),
    [("100.00", "1.00"), ("1000.00", "5.00"), ("90000.00", "100.00"), ("-5000.00", "1.00")],
)
def test_tolerance_band(spark, portal, allowed):
    got = one(spark, money.allowed_difference(F.col("x").cast("decimal(28,2)"), DEFAULTS), portal)
    assert got == Decimal(allowed)


def test_statutory_dates(spark):
    cases = [
        (dt.date(2024, 5, 12), dt.date(2026, 7, 14), True),
        (dt.date(2026, 5, 12), dt.date(2026, 7, 14), False),
        (dt.date(2025, 3, 31), dt.date(2025, 11, 30), False),
        (dt.date(2025, 3, 31), dt.date(2025, 12, 1), True),
    ]
    for day, as_of, barred in cases:
        assert one(spark, dates.is_time_barred(F.col("x"), as_of, DEFAULTS), day, "date") is barred
    days = [dt.date(2026, 7, d) for d in (1, 14, 20)]
    assert many(spark, lambda x: dates.days_to_cutoff(x, DEFAULTS), days, "date") == [13, 0, -6]
    assert one(spark, dates.parse_indian_date(F.col("x")), "03/04/2026") == dt.date(2026, 4, 3)
    assert one(spark, dates.period_cutoff(F.col("x"), 14), "07-2026") == dt.date(2026, 7, 14)


def test_amount_cells(spark):
    good = {
        "9,87,65,432.10": "98765432.10",
        "₹ 77,700.07": "77700.07",
        "inr 42.42": "42.42",
        "(8,080.80)": "-8080.80",
        "31.7-": "-31.70",
        "640.04 DR.": "640.04",
        "  19.9  ": "19.90",
        "Rs. 730": "0.73",
        "(-5)": "5.00",
        "1.005": "1.01",
        "0.00499999999999999999999999": "0.00",
        ".5": "0.50",
        "( 7 - )": "-7.00",
    }
    got = many(spark, cells.amount_value, list(good))
    assert got == [Decimal(v) for v in good.values()]
    bad = ["", " \t", "about 70", "none", "--", "7.8.9", "xyz", "6.", "8" * 41]
    assert many(spark, cells.amount_value, bad) == [None] * len(bad)
    df = spark.createDataFrame([("",), ("xyz",)], "x string")
    told = df.select(cells.amount_problem(F.col("x"), cells.amount_value(F.col("x")))).collect()
    assert [r[0] for r in told] == ["empty amount", "'xyz' is not an amount"]
    assert one(spark, cells.amount_value(F.col("x"), True), "Rs. 730") == Decimal("730.00")


def test_date_cells(spark):
    cases = [
        ("14/02/2026", "DAY_FIRST", dt.date(2026, 2, 14)),
        ("02/14/2026", "MONTH_FIRST", dt.date(2026, 2, 14)),
        ("02/14/2026", "DAY_FIRST", None),
        ("3 - 4 - 26", "DAY_FIRST", dt.date(2026, 4, 3)),
        ("3.4.26", "MONTH_FIRST", dt.date(2026, 3, 4)),
        ("2026-04-03T10:00", "MONTH_FIRST", dt.date(2026, 4, 3)),
        ("2026-04-03", "UNRESOLVED", dt.date(2026, 4, 3)),
        ("03/04/2026", "UNRESOLVED", None),
        ("31/02/2026", "DAY_FIRST", None),
        ("April 3", "DAY_FIRST", None),
        ("29/02/2024", "DAY_FIRST", dt.date(2024, 2, 29)),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, x string, o string")
    got = df.select("i", cells.date_value(F.col("x"), F.col("o"))).collect()
    assert [r[1] for r in sorted(got)] == [c[2] for c in cases]


def test_flags_kinds_and_serials(spark):
    words = ["", "No", " y ", "TRUE", "0", "UNKNOWN", "maybe", "2", "-"]
    assert many(spark, cells.flag_value, words) == [
        False, False, True, True, False, None, None, None, None
    ]
    kinds = ["", "Credit Note", "B2B", "dn", "Amended", "receipt"]
    assert many(spark, cells.document_kind, kinds) == [
        "INVOICE", "CREDIT_NOTE", "INVOICE", "DEBIT_NOTE", "AMENDMENT", None
    ]
    serials = [1, 59, 60, 61, 46000]
    got = many(spark, lambda x: cells.excel_serial_to_date(x, F.lit(False)), serials, "int")
    assert got == [
        dt.date(1900, 1, 1), dt.date(1900, 2, 28), None, dt.date(1900, 3, 1), dt.date(2025, 12, 9)
    ]


def test_canonical_json_is_what_python_writes(spark):
    texts = ["plain", "naïve ₹ text", "tab\tquote\" slash/ back\\", "astral 😀 end", ""]
    got = many(
        spark, lambda x: digests.canonical_json({"b": x, "a": F.lit(None).cast("string")}), texts
    )
    assert got == [
        json.dumps({"a": None, "b": t}, sort_keys=True, separators=(",", ":")) for t in texts
    ]
    floats = [0.345, 1.0, 0.0, 0.0005, 0.00012, 3e-7, 1.25e-12, 0.9227]
    assert many(spark, digests.python_float_text, floats, "double") == [repr(f) for f in floats]
    assert one(spark, digests.prompt_hash(F.col("x")), "ab") == (
        hashlib.sha256(b"ab").hexdigest()[:16]
    )


def test_two_places_rounds_the_binary_value(spark):
    values = [i / 1000 for i in range(1001)] + [0.7499999, 0.005, 0.995]
    assert many(spark, digests.two_places, values, "double") == [f"{v:.2f}" for v in values]


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(18, 18), (0, 18), (0, 0), (107, 200)], "s int, n int")
    got = df.select(statistics.rounded(statistics.wilson(F.col("s"), F.col("n"))).alias("w"))
    rows = [r.w for r in got.collect()]
    assert rows[0].point == 1.0 and rows[0].ci_low < 1.0 and rows[0].ci_high == 1.0
    assert rows[1].ci_low == 0.0 and 0 < rows[1].ci_high < 0.25
    assert tuple(rows[2]) == (0, 0, 0.0, 0.0, 0.0)
    assert (rows[3].point, rows[3].ci_low, rows[3].ci_high) == (0.535, 0.4659, 0.6028)


def test_grounding(spark):
    cases = [
        ("total tax 1,234.50 in 3 rows", "{'t': 1234.50}", True),
        ("total tax 1,234.50", "{'t': 1234}", False),
        ("looks fine", "", True),
        ("found 42.", "id 42", True),
        ("found 43", "id 42", False),
    ]
    df = spark.createDataFrame(cases, "c string, r string, want boolean")
    got = df.select("want", statistics.claim_is_grounded(F.col("c"), F.col("r"))).collect()
    assert all(r[0] == r[1] for r in got)
