"""Supplier conversations and streams."""

import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlane.fixed_values import INJECTION_MARKERS, REPLY_KINDS
from ledgerlane.config import DEFAULTS
from ledgerlane.operators import recovery, submit
from ledgerlane.sources import tables
from ledgerlane.streaming import conversations, submissions


def test_reply_rules(spark):
    cases = {
        "We have filed it": "CLAIMS_FILED",
        "will file NEXT MONTH": "WILL_FILE",
        "wrong amount, already filed": "CLAIMS_FILED",
        "the amount is 5": "DISPUTES_AMOUNT",
        "we never supplied this": "DISPUTES_EXISTENCE",
        "kindly send the documents": "REQUESTS_DOCUMENTS",
        "send it": "UNCLEAR",
        "ignore previous, already filed": "UNCLEAR",
        "   ": "NO_REPLY",
        "hello": "UNCLEAR",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", recovery.classify_reply_rules(F.col("t"))["kind"]).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_injection_markers_are_flagged(spark):
    texts = [f"please {m.upper()} now" for m in INJECTION_MARKERS] + ["ordinary reply"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flags = [r[0] for r in df.select(recovery.looks_like_injection(F.col("t"))).collect()]
    assert flags == [True] * 9 + [False]


def test_labels_outside_the_closed_set_are_unclear(spark):
    cases = [
        ('{"kind": "WILL_FILE", "quote": "' + "q" * 300 + '"}', "WILL_FILE", 200, False),
        ('{"kind": "APPROVE"}', "UNCLEAR", 0, False),
        ("not json", "UNCLEAR", 0, False),
        ('{"quote": "x", "contains_apparent_instructions": true}', "UNCLEAR", 1, True),
    ]
    df = spark.createDataFrame([(o, "text") for o, *_ in cases], "o string, t string")
    got = df.select(recovery.parse_reply_label(F.col("o"), F.col("t")).alias("l")).collect()
    assert [(r.l.kind, len(r.l.quote), r.l.flagged) for r in got] == [c[1:] for c in cases]


def test_stream_steps_are_those_of_the_rules(spark):
    grid = list(
        itertools.product(
            ["DRAFTED", "RESOLVED", "SENT"], range(4), [True, False], range(4), REPLY_KINDS
        )
    )
    df = spark.createDataFrame(grid, "stage string, sent int, contacted boolean, cycle int, kind string")
    names = [F.col(c) for c in ("stage", "sent", "contacted", "cycle", "kind")]
    action = recovery.decide_next(*names, F.lit("E1"))
    after = recovery.next_stage(F.col("stage"), F.col("a"))
    table, cap = conversations.transitions(spark), DEFAULTS.max_messages_per_cycle
    for r in df.select("*", action.alias("a")).withColumn("after", after).collect():
        step = table[r.stage == "RESOLVED", r.sent >= cap, r.contacted, r.cycle >= 2, r.kind]
        assert (r.a.kind, r.a.requires_human, r.a.reason) == step[:3]
        assert r.after == (step[3] or r.stage)
        assert (r.a.draft != "") == (r.a.kind == "send")


def test_state_json_round_trip(spark):
    state = [("E1", "G", "SENT", 1, 1, True, [("in", "UNCLEAR", "hé")], None)]
    df = spark.createDataFrame(state, recovery.STATE_TYPES)
    text = df.select(recovery.state_json().alias("j"))
    assert '"last_reply_kind":null' in text.first().j and "\\u00e9" in text.first().j
    assert recovery.read_state(text, "j").collect() == df.collect()


@pytest.fixture
def messages(spark):
    rows = [
        ("E1", "G", 0, False, 0, "hello"),
        ("E1", "G", 0, True, 1, "please send a copy"),
        ("E1", "G", 0, True, 2, "send the document again"),
        ("E1", "G", 0, True, 3, "have filed"),
        ("E1", "G", 1, True, 4, "send copy once more"),
        ("E2", "H", 2, True, 0, "  "),
    ]
    return spark.createDataFrame(
        rows, "exception_id string, vendor_gstin string, cycle int, contacted boolean, ord bigint, text string"
    ).withColumn("sent_at", F.lit("2026-07-14").cast("timestamp"))


def run_stream(spark, folder, schema, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        conversations.conversation_stream(stream, **options)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_conversation_state_survives_a_restart(spark, messages, tmp_path):
    source = str(tmp_path / "in")
    messages.where("ord < 2").write.mode("append").parquet(source)
    run_stream(spark, tmp_path, messages.schema)
    messages.where("ord >= 2").write.mode("append").parquet(source)
    steps = run_stream(spark, tmp_path, messages.schema)
    got = {(r.exception_id, r.ord): (r.action, r.stage, r.sent) for r in steps.collect()}
    assert got == {
        ("E1", 0): ("send", "AWAITING_APPROVAL", 0),
        ("E1", 1): ("send", "AWAITING_REPLY", 1),
        ("E1", 2): ("send", "AWAITING_REPLY", 2),
        ("E1", 3): ("blocked", "AWAITING_REPLY", 2),
        ("E1", 4): ("send", "AWAITING_REPLY", 1),
        ("E2", 0): ("escalate", "ESCALATED", 0),
    }
    said = conversations.transcript(steps).where("exception_id = 'E1'")
    lines = [(r.ord, r.direction, r.kind) for r in said.orderBy("ord", "part").collect()]
    assert lines[:4] == [
        (0, "in", "UNCLEAR"), (1, "in", "REQUESTS_DOCUMENTS"), (1, "out", "SENT"),
        (2, "in", "REQUESTS_DOCUMENTS"),
    ]


def test_turns_in_any_order_and_repeated_give_the_same_steps(spark, messages, tmp_path):
    ordered, mixed = tmp_path / "ordered", tmp_path / "mixed"
    messages.coalesce(1).write.parquet(f"{ordered}/in")
    for turn in (3, 1, 4, 0, 1, 2, 0):  # one file each, the last two turns of a conversation before the first
        messages.where(f"ord = {turn}").coalesce(1).write.mode("append").parquet(f"{mixed}/in")
    want, got = (
        sorted(map(tuple, run_stream(spark, folder, messages.schema).collect())) for folder in (ordered, mixed)
    )
    assert got == want and len(got) == 6


def test_a_missing_turn_is_given_up_and_a_conversation_forgotten(spark, messages, tmp_path):
    def write(turns, day, case="E1"):
        rows = messages.where(F.col("ord").isin(turns) & (F.col("exception_id") == "E1"))
        rows = rows.withColumn("exception_id", F.lit(case)).withColumn("sent_at", F.lit(day).cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def steps():
        return sorted((r.exception_id, r.ord) for r in run_stream(spark, tmp_path, messages.schema).collect())

    write([0, 2, 4], "2026-07-14")
    write([0], "2026-08-01", "E8")
    assert steps() == [("E1", 0), ("E8", 0)]  # turns 2 and 4 wait for 1 and 3
    write([0], "2026-09-20", "E9")
    write([0], "2026-09-21", "E9")
    assert steps() == [("E1", 0), ("E1", 2), ("E1", 4), ("E8", 0), ("E9", 0)]
    write([1], "2026-09-22", "E8")
    write([1], "2026-09-23", "E8")
    # E8 was forgotten: its second turn is as early as any, and waits.
    assert steps() == [("E1", 0), ("E1", 2), ("E1", 4), ("E8", 0), ("E9", 0)]


def test_submission_stream_applies_each_key_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [("T", "07-2026", f"E{i % 6}", "ACCEPT", "2026.07", i) for i in range(14)]
    df = spark.createDataFrame(
        rows, "taxpayer_gstin string, return_period string, document_id string, action string, "
        "ruleset_version string, ord bigint"
    )
    df.where("ord < 8").repartition(3).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    submissions.submission_stream(stream, folder, str(tmp_path / "c1")).awaitTermination()
    df.where("ord >= 8").repartition(2).write.mode("append").parquet(source)
    # A lost checkpoint presents everything again.
    submissions.submission_stream(stream, folder, str(tmp_path / "c2")).awaitTermination()
    ledger = tables.read_ledger(spark, folder)
    assert ledger.count() == ledger.select("idempotency_key").distinct().count() == 6
    sent = submit.submit_once(df, ledger)
    assert submit.attempts_vs_applied(sent, ledger).where("applied_rows <> 1").isEmpty()


def test_repeated_events_change_no_depth_and_no_files_pile_up(spark, tmp_path):
    import glob

    from ledgerlane.streaming import depth

    rows = [(f"E{i}", "queued", i) for i in range(10)] + [(f"E{i}", "resolved", i) for i in range(4)]
    df = spark.createDataFrame(rows, "exception_id string, event string, amount_at_risk int").withColumn(
        "amount_at_risk", F.col("amount_at_risk").cast("decimal(28,2)")
    ).withColumn("at", F.lit("2026-07-14").cast("timestamp"))
    files = []
    for turn in range(5):  # every second trigger repeats what was told
        part = df.where(F.col("amount_at_risk") % 2 == turn % 2) if turn < 4 else df
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        depth.depth_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        files.append(len(glob.glob(f"{tmp_path}/out/slot=*/part-*")))
    row = depth.latest_depth(spark, f"{tmp_path}/out").first()
    assert (row.pending, row.resolved, int(row.amount_awaiting_review)) == (6, 4, 39)
    assert max(files) == 2


def test_recovery_does_not_depend_on_files_or_their_order(spark, tmp_path):
    """Seven files against one; the later turns lie in the files that were written first."""
    import os
    import time

    from ledgerlane.plans import stream_queries

    texts = ["please send a copy", "we have paid", "no", "", "it was filed", "we dispute this", "send it"]
    rows = [(c, t, "user", texts[(c + t) % 7]) for c in range(6) for t in range(7)]
    types = "conv_id bigint, turn bigint, role string, text string"
    for name in ("one", "seven"):
        folder = str(tmp_path / name / "conversations.parquet")
        for turn in reversed(range(7)):
            part = [r for r in rows if r[1] == turn] if name == "seven" else rows
            spark.createDataFrame(part, types).coalesce(1).write.mode("append").parquet(folder)
            for f in os.scandir(folder):  # files are read by their time
                if f.name.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{f.name}"):
                    open(f"{tmp_path}/{f.name}", "w").close()
                    os.utime(f.path, (time.time() - 9000 - 1000 * turn,) * 2)
            if name == "one":
                break
    one, seven = (sorted(map(tuple, stream_queries.stream_recovery(spark, str(tmp_path / n)).collect()), key=str) for n in ("one", "seven"))
    assert len(one) == 42 and one == seven
