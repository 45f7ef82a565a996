"""Evidence lookups, findings, traces and precedents against plain models."""

import hashlib
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.config import ReconConfig
from ledgerlane.operators import evidence, findings, precedents
from ledgerlane.operators.sides import prepare_side

from tests import models

CONFIGS = [ReconConfig(), ReconConfig(hot_key_rows=3, broadcast_rows=0)]


@pytest.mark.parametrize("config", CONFIGS, ids=["plain", "hot"])
def test_register_probe(spark, config):
    rng = random.Random(4)
    taxes = [Decimal("100.00") + Decimal(i) / 4 for i in range(9)]
    numbers = ["INV/1", "INV/2", "INV-01"]
    books = models.random_lines(rng, "B", 60, numbers, taxes, [0], ["G1", "G2"])
    asked = [
        (f"E{i}", "tc00", rng.choice(["", "g1", "G2", "G9"]), rng.choice([None, "", "inv 1"]),
         rng.choice([None, Decimal("101.00"), Decimal("100.25")]))
        for i in range(30)
    ]
    requests = spark.createDataFrame(
        asked, "exception_id string, call_id string, gstin string, invoice_number string, amount decimal(28,2)"
    )
    got = evidence.probe_purchase_register(requests, prepare_side(models.to_df(spark, books)), config)
    found = {r.exception_id: (r.match_count, [x.line_id for x in r.rows or []]) for r in got.collect()}
    for name, _, gstin, number, amount in asked:
        hits = sorted(
            b["line_id"]
            for b in books
            if gstin.upper() in ("", b["supplier_gstin"])
            and (not number or models.tokens(number) == models.tokens(b["invoice_number"]))
            and (amount is None or abs(b["igst"] - amount) <= 1)
        )
        assert found[name] == (len(hits), hits[:8])


def test_tolerance_probe(spark):
    df = spark.createDataFrame([("1000.00", "1004.99"), ("1000.00", "1005.50")], "l string, r string")
    got = [r[0] for r in df.select(evidence.probe_tolerance(F.col("l"), F.col("r"))).collect()]
    assert [(r.difference, r.allowed, r.within_tolerance) for r in got] == [
        (Decimal("4.99"), Decimal("5.02"), True), (Decimal("5.50"), Decimal("5.03"), False)
    ]


def test_vendor_and_irn_probes(spark):
    requests = spark.createDataFrame(
        [("E1", "c", " 27aapfu0939f1zv", "I1"), ("E2", "c", "27AAPFU0939F1ZX", "I9")],
        "exception_id string, call_id string, gstin string, irn string",
    )
    vendors = spark.createDataFrame(
        [("27AAPFU0939F1ZV", "Kaveri Traders", True, None)],
        "gstin string, legal_name string, files_late boolean, risk_flag string",
    )
    known, unknown = sorted(evidence.probe_vendor_master(requests, vendors).collect())
    assert known.known_vendor and known.legal_name == "Kaveri Traders" and known.files_late
    assert not unknown.known_vendor and not unknown.gstin_checksum_valid
    assert unknown.checksum_note == "check character 'X', expected 'V'"
    registry = spark.createDataFrame([("I1", "CANCELLED")], "irn string, status string")
    hit, miss = sorted(evidence.probe_irn_status(requests, registry).collect())
    assert hit.cancelled and hit.known and not miss.known and miss.cancelled is None


def test_findings_are_refused_with_reasons(spark):
    item = '{"tool_call_id": "tc00-a", "tool_name": "a", "claim": "c"}'
    body = '{"proposed_class": "DUPLICATE", "proposed_action": "REJECT", "confidence": %s, "rationale": " r ", "evidence": [%s]}'
    replies = [
        ("ok", "text before " + body % ("0.8", item) + " after"),
        ("clamped", body % ("-3", item)),
        ("words", body % ('"0.5"', item)),
        ("null", body % ("null", item)),
        ("invented", body % ("0.8", item.replace("tc00", "tc07"))),
        ("broken", "{nope}"),
        ("none", "no braces"),
        ("class", body.replace("DUPLICATE", "ODD") % ("0.8", item)),
        ("bare", body % ("0.9", "")),
    ]
    steps = [(name, f"tc0{i}-a") for name, _ in replies for i in range(2)]
    got = findings.validate_findings(
        spark.createDataFrame(replies, "exception_id string, text string"),
        spark.createDataFrame(steps, "exception_id string, call_id string"),
    )
    rows = {r.exception_id: r for r in got.collect()}
    assert (rows["ok"].confidence, rows["ok"].rationale, rows["ok"].steps_used) == (0.8, "r", 2)
    assert rows["clamped"].confidence == 0.0 and rows["words"].confidence == 0.5
    assert rows["bare"].evidence == [] and rows["bare"].failure == ""
    failures = {k: r.failure for k, r in rows.items() if r.failure}
    assert failures == {
        "null": "confidence is not a number",
        "invented": "evidence cites 'tc07-a', which is not a tool call this run made",
        "broken": "unparseable JSON",
        "none": "no JSON object in the reply",
        "class": "unusable class or action",
    }


def test_traces_end_for_the_first_reason(spark):
    def case(name, calls, tokens=10, elapsed=0.0):
        return [
            (name, i, c == "final", "t", c, tokens, elapsed * i) for i, c in enumerate(calls)
        ]

    rows = (
        case("done", ["a", "b", "final"])
        + case("loop", ["a", "a", "a", "b"])
        + case("loop2", ["a", "a", "b", "b", "final"])
        + case("once", ["a", "a", "b", "final"])
        + case("steps", [str(i) for i in range(30)])
        + case("full", [*[str(i) for i in range(8)], "final"])
        + case("spend", ["a", "b", "c", "final"], tokens=40_000)
        + case("slow", ["a", "b", "c", "final"], elapsed=50.0)
    )
    df = spark.createDataFrame(
        rows, "case_id string, idx int, is_final boolean, tool_name string, arguments string, "
        "tokens bigint, elapsed double"
    )
    got = {r.case_id: (r.terminated_because, r.steps) for r in findings.trace_termination(df).collect()}
    assert got == {
        "done": ("completed", 2),
        "loop": ("loop_detected", 2),
        "loop2": ("loop_detected", 3),
        "once": ("completed", 3),
        "steps": ("step_budget_exhausted", 8),
        "full": ("completed", 8),
        "spend": ("spend_cap", 2),
        "slow": ("wall_clock_timeout", 3),
    }
    # Numbers with gaps count by their order, and a final response may hold no valid finding.
    gaps = df.withColumn("idx", F.col("idx") * 7 + 3).withColumn(
        "invalid", F.when(F.col("case_id") == "once", " no citation ").when(F.col("case_id") == "done", "")
    )
    again = {r.case_id: (r.terminated_because, r.steps) for r in findings.trace_termination(gaps).collect()}
    assert again == {**got, "once": ("invalid_finding: no citation", 3)}


def embed(text):
    vector = [0] * 256
    for token in text.upper().replace("/", " ").split():
        digest = hashlib.sha256(token.encode()).digest()
        vector[int.from_bytes(digest[:4], "big") % 256] += 1 if digest[4] % 2 == 0 else -1
    return vector


@pytest.mark.parametrize("rows", [64, 1])
@pytest.mark.parametrize("config", CONFIGS, ids=["plain", "hot"])
def test_precedents(spark, config, rows, monkeypatch):
    monkeypatch.setattr(precedents, "LIST_ROWS", rows)
    rng = random.Random(8)
    words = ["invoice", "tax/late", "swap", "₹", "credit", "a", "b"]
    cases = [
        (f"C{i:02d}", rng.choice(["RCM", "DUPLICATE"]), rng.choice(["G1", "G2", "G3"]),
         " ".join(rng.choices(words, k=4)), ["p", "q"][: rng.randrange(3)], f"r{i}", i % 4 != 0, 1)
        for i in range(40)
    ]
    table = spark.createDataFrame(
        cases, "precedent_id string, exception_class string, gstin string, summary string, "
        "probe_sequence array<string>, resolution string, human_confirmed boolean, cycle int"
    )
    stored = precedents.add_precedents(table)
    assert stored.count() == 30
    assert precedents.add_precedents(table, stored).isEmpty()
    asked = [("RCM", "G1"), ("RCM", "G9"), ("DUPLICATE", "G2"), ("TIME_BARRED", "G1")]
    queries = spark.createDataFrame(asked, "exception_class string, gstin string")
    hits = precedents.search_precedents(queries, stored, config)
    got = {}
    for r in hits.orderBy("place").collect():
        got.setdefault((r.exception_class, r.gstin), []).append(
            (r.precedent_id, r.similarity, r.same_vendor)
        )
    want = {}
    for cls, gstin in asked:
        q, scored = embed(f"{cls} {gstin}"), []
        for c in cases:
            if c[1] != cls or not c[6]:
                continue
            v = embed(f"{cls} {c[2]} {c[3]}")
            norm = math.sqrt(sum(x * x for x in q) * sum(x * x for x in v))
            score = sum(x * y for x, y in zip(q, v)) / norm if norm else 0.0
            scored.append((-score, c[0], c[2] == gstin))
        if scored:
            want[cls, gstin] = [(i, pytest.approx(round(-s, 4)), v) for s, i, v in sorted(scored)[:3]]
    assert got == want
    hint = precedents.precedent_hint(hits).where("gstin = 'G2'").first().hint
    assert hint.count("\n") == 2 and hint.startswith("- ") and "; outcome: r" in hint


def test_first_rows_are_limited_where_they_lie(spark):
    rows = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string")).alias("k"),
        F.format_string("L%06d", (F.col("id") * 7919) % 20_000).alias("line_id"),
    )
    summary = evidence.summarise(rows, ["k"], ["line_id"], ["line_id"], ReconConfig())
    plan = summary._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [row_number") :]
    # What reaches the exchange below the window was cut to the first rows of each key and task.
    assert window.index("Final") < window.index("Exchange hashpartitioning") < window.index("Partial")
    got = {r.k: (r.match_count, [x.line_id for x in r.rows]) for r in summary.collect()}
    ids = {}
    for r in rows.collect():
        ids.setdefault(r.k, []).append(r.line_id)
    assert got == {k: (len(v), sorted(v)[:8]) for k, v in ids.items()}


def test_precedents_are_scored_over_postings_only(spark):
    """2,000 cases of one class, ten of the vendor asked about: a few more than those are scored."""
    cases = spark.range(2000).select(
        F.format_string("C%05d", "id").alias("precedent_id"), F.lit("RCM").alias("exception_class"),
        F.concat(F.lit("G"), (F.col("id") % 200).cast("string")).alias("gstin"),
        F.concat(F.lit("invoice "), F.col("id").cast("string")).alias("summary"),
        F.array(F.lit("p")).alias("probe_sequence"), F.lit("r").alias("resolution"), F.lit(True).alias("human_confirmed"),
    )
    stored = precedents.add_precedents(cases)
    asked = precedents._asked(spark.createDataFrame([("RCM", "G7")], "exception_class string, gstin string"))
    classes = precedents.usual_indexes(stored)
    assert len(classes.first().usual) == 2  # the class and the word "invoice"
    vectors = asked.join(classes, "exception_class").withColumns(precedents._split("q_vector"))
    vectors = vectors.withColumn("q_norm", precedents.norm_squared(F.col("q_vector")))
    kept = stored.join(classes, "exception_class").withColumns(precedents._split("vector"))
    pairs = precedents.posted_pairs(vectors, kept)
    assert 10 <= pairs.count() < 100
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join [exception_class" in plan and "idx" in plan.split("Join [exception_class")[1].split("\n")[0]


def test_first_requests(spark):
    rows = [(i, "m", t) for i, t in enumerate(["é", "é", "x", "é", "y"])]
    df = spark.createDataFrame(rows, "ord int, model string, text string")
    got = findings.first_requests(df, ["model", "text"], "ord").collect()
    assert sorted((r.ord, r.asked) for r in got) == [(0, 3), (2, 1), (4, 1)]


def test_a_wide_tolerance_costs_no_more(spark):
    requests = spark.createDataFrame(
        [("E1", "c1", "", "", Decimal("100.00"), Decimal("5000000000.00")), ("E2", "c2", "", "", Decimal("100.00"), Decimal("0.50"))],
        "exception_id string, call_id string, gstin string, invoice_number string, amount decimal(28,2), tolerance decimal(28,2)",
    )
    bank = spark.createDataFrame(
        [(f"P{i:03d}", "27AAPFU0939F1ZV", Decimal(i * 1000 - 50_000) + Decimal("0.25"), None, "n") for i in range(200)]
        + [("Q1", "x", Decimal("100.50"), None, "n")],
        "payment_id string, counterparty_gstin string, amount decimal(28,2), value_date date, narration string",
    )
    wide, narrow = sorted(evidence.probe_bank_ledger(requests, bank).collect())
    assert wide.match_count == 201 and [r.payment_id for r in wide.rows] == [f"P{i:03d}" for i in range(8)]
    assert narrow.match_count == 1 and narrow.rows[0].payment_id == "Q1"


def test_rows_that_nobody_asks_for_do_not_move(spark, monkeypatch):
    """Of 4,000 lines of 400 suppliers, what three requests cannot meet is dropped before anything is summarised."""
    books = spark.range(4000).select(
        F.format_string("B%05d", "id").alias("line_id"),
        F.concat(F.lit("G"), F.col("id") % 400).alias("supplier_gstin"),
        F.concat(F.lit("INV/"), "id").alias("invoice_number"),
        F.lit(None).cast("date").alias("invoice_date"),
        F.col("id").cast("decimal(28,2)").alias("igst"),
        *[F.lit(0).cast("decimal(28,2)").alias(c) for c in ("taxable", "cgst", "sgst", "cess")],
        F.lit("INVOICE").alias("kind"), F.lit(False).alias("reverse_charge"),
        *[F.lit(None).cast("string").alias(c) for c in ("irn", "original_invoice_number")],
    )
    requests = spark.createDataFrame(
        [("E1", "c", "G7", None, None), ("E2", "c", "G7", "INV/407", None), ("E3", "c", "G9", None, Decimal("409.00"))],
        "exception_id string, call_id string, gstin string, invoice_number string, amount decimal(28,2)",
    )
    taken, summarise = [], evidence.summarise

    def counted(rows, *more):
        taken.append(rows.count())
        return summarise(rows, *more)

    monkeypatch.setattr(evidence, "summarise", counted)
    got = {r.exception_id: (r.match_count, [x.line_id for x in r.rows])
           for r in evidence.probe_purchase_register(requests, prepare_side(books)).collect()}
    assert got == {"E1": (10, [f"B{i:05d}" for i in range(7, 3207, 400)]), "E2": (1, ["B00407"]), "E3": (1, ["B00409"])}
    assert len(taken) == 3 and sum(taken) < 40


def test_briefs_carry_similar_cases(spark):
    line = "struct<invoice_number:string,invoice_date:date,supplier_gstin:string,taxable:decimal(28,2),total_tax:decimal(28,2),irn:string>"
    rows = [("E1", "RCM", "g", "d", None, None), ("E2", "RCM", "h", "", None, None), ("E3", "RCM", None, "", None, None),
            ("E4", "DUPLICATE", "g", "", None, None)]
    cases = spark.createDataFrame(
        rows, f"exception_id string, exception_class string, supplier_gstin string, detail string, book {line}, portal {line}"
    )
    hints = spark.createDataFrame([("RCM", "g", "- one\n- two"), ("RCM", "h", "")], "exception_class string, gstin string, hint string")
    rest = "No counterpart in the purchase register.\nNo counterpart in the GSTR-2B."
    want = {f"E{i}": f"Exception E{i} classified by rules as {r[1]}.\n" + ("d\n" if i == 1 else "") + rest for i, r in enumerate(rows, 1)}
    want["E1"] += "\n\nSimilar cases resolved previously:\n- one\n- two"
    for config in (ReconConfig(), ReconConfig(hot_key_rows=1)):
        got = findings.case_briefs(cases, hints, config).collect()
        assert len(got) == 4 and {r.exception_id: r.brief for r in got} == want
