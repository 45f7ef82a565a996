"""Gate, submission, audit, review and whole cycles."""

import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane import ReconConfig, reconcile
from ledgerlane.fixed_values import DISTRIBUTION_MIX, EXCEPTION_CLASSES, GENESIS_DIGEST, TIER_OF_CLASS
from ledgerlane.operators import audit, findings, policy, review, submit, summaries
from ledgerlane.plans import cycle as cycle_plan
from ledgerlane.plans import decision_queries
from ledgerlane.sources import commits, tables
from ledgerlane.sources.generated import generate_cycle, pattern_length

AS_OF = dt.date(2026, 7, 10)
NOW = dt.datetime(2026, 7, 10, 9, 0, tzinfo=dt.timezone.utc)
EVIDENCE = [("tc00-x", "x", "saw it")]
FINDING_TYPES = (
    "exception_id string, proposed_class string, proposed_action string, confidence double, "
    f"rationale string, evidence {findings.EVIDENCE_TYPE}"
)


def decide_one(spark, cls, amount="5000.00", finding=None):
    exceptions = spark.createDataFrame(
        [("E1", cls, Decimal(amount))],
        "exception_id string, exception_class string, amount_at_risk decimal(28,2)",
    )
    rows = [("E1", cls, *finding)] if finding else []
    row = policy.decide(exceptions, spark.createDataFrame(rows, FINDING_TYPES)).first()
    return row.action, row.requires_human, row.escalated, row.reasons[-1]


@pytest.mark.parametrize(
    ("cls", "amount", "finding", "want"),
    [
        ("DUPLICATE", "1", None, ("REJECT", True, False, "DUPLICATE is closed by rule under ruleset 2026.07")),
        ("TIME_BARRED", "1", None, ("PENDING", False, False, "TIME_BARRED is closed by rule under ruleset 2026.07")),
        ("MISSING_IN_BOOKS", "1", None, ("PENDING", True, True, "no finding available; held pending rather than actioned")),
        ("MISSING_IN_BOOKS", "1", ("ACCEPT", 0.9, " ", EVIDENCE), ("PENDING", True, True, None)),
        ("MISSING_IN_BOOKS", "1", ("ACCEPT", 0.9, "why", []), ("PENDING", True, True, None)),
        ("MISSING_IN_BOOKS", "1", ("ACCEPT", 0.745, "why", EVIDENCE), ("PENDING", True, True, f"confidence {0.745:.2f} below floor 0.75")),
        ("MISSING_IN_BOOKS", "1", ("REJECT", 0.9, "why", EVIDENCE), ("REJECT", True, False, "reject purges the value from 2B for this period; human approval required")),
        ("MISSING_IN_BOOKS", "90000.00", ("ACCEPT", 0.9, "why", EVIDENCE), ("ACCEPT", True, False, "tax value 90000.00 exceeds the auto-accept ceiling 25000.00")),
        ("MISSING_IN_BOOKS", "25000.00", ("ACCEPT", 0.75, "why", EVIDENCE), ("ACCEPT", False, False, "within straight-through limits")),
        ("MISSING_IN_BOOKS", "90000.00", ("PENDING", 0.9, "why", EVIDENCE), ("PENDING", False, False, "within straight-through limits")),
    ],
)
def test_every_gate_branch(spark, cls, amount, finding, want):
    got = decide_one(spark, cls, amount, finding)
    assert got[:3] == want[:3]
    assert want[3] is None or got[3] == want[3]


def test_routing_covers_every_class():
    assert set(TIER_OF_CLASS) == set(EXCEPTION_CLASSES)


@pytest.mark.parametrize(
    ("claimed", "available", "threshold", "fires"),
    [("260000", "200000", "40000.00", True), ("9050000", "9000000", "100000.00", False),
     ("240000", "200000", "40000.00", False), ("210000", "200000", "40000.00", False)],
)
def test_exposure(spark, claimed, available, threshold, fires):
    totals = spark.createDataFrame(
        [(Decimal(claimed), Decimal(available))],
        "claimed_itc decimal(28,2), available_itc decimal(28,2)",
    )
    row = summaries.drc01c_exposure(totals).first()
    assert (row.threshold, row.fires) == (Decimal(threshold), fires)
    assert row.headroom == Decimal(threshold) - Decimal(claimed) + Decimal(available)


def submissions(spark, rows):
    return spark.createDataFrame(
        [("27AAPFU0939F1ZV", "07-2026", doc, action, "2026.07", i) for i, (doc, action) in enumerate(rows)],
        "taxpayer_gstin string, return_period string, document_id string, action string, "
        "ruleset_version string, ord bigint",
    )


@pytest.mark.parametrize("config", [ReconConfig(), ReconConfig(hot_key_rows=2)], ids=["plain", "hot"])
def test_submission_is_idempotent(spark, tmp_path, config):
    folder = str(tmp_path)
    rows = [("E1", "ACCEPT")] * 6 + [("E2", "REJECT"), ("E1", "REJECT")]
    first = tables.submit_to_ledger(submissions(spark, rows), folder, config)
    outcomes = [r.outcome for r in first.orderBy("ord").collect()]
    assert outcomes == ["APPLIED"] + ["ALREADY_APPLIED"] * 5 + ["APPLIED", "APPLIED"]
    assert submit.exactly_once_violations(first).isEmpty()
    again = submit.submit_once(submissions(spark, rows), tables.read_ledger(spark, folder), config)
    assert {r.outcome for r in again.collect()} == {"ALREADY_APPLIED"}
    key = hashlib.sha256(b"27AAPFU0939F1ZV|07-2026|E2|REJECT|2026.07").hexdigest()[:32]
    row = again.where("document_id = 'E2'").first()
    assert (row.idempotency_key, row.portal_reference) == (key, f"REF-{key[:12]}")
    inbox = submit.ims_inbox(tables.read_ledger(spark, folder), "27AAPFU0939F1ZV", "07-2026")
    assert [(r.document_id, r.current_action) for r in inbox.collect()] == [
        ("E1", "REJECT"), ("E2", "REJECT")
    ]
    assert submit.ims_inbox(tables.read_ledger(spark, folder), "other", "07-2026").isEmpty()


def test_writers_that_overlap_apply_each_key_once(spark, tmp_path, monkeypatch):
    """Three writers decide over the same ledger; each commit that comes late is decided again."""
    import threading

    folder, results, tries = str(tmp_path), {}, []
    together, live = threading.Barrier(3), commits.live

    def slow(*args):
        state = live(*args)
        tries.append(1)
        if len(tries) <= 3:
            together.wait(60)
        return state

    monkeypatch.setattr(commits, "live", slow)
    monkeypatch.setattr(commits, "MERGE_EVERY", 2)

    def run(writer):
        rows = [(f"E{i}", "ACCEPT") for i in range(4 * writer, 4 * writer + 8)]
        results[writer] = tables.submit_to_ledger(submissions(spark, rows), folder).collect()

    threads = [threading.Thread(target=run, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    monkeypatch.undo()
    ledger = tables.read_ledger(spark, folder)
    assert sorted(r.document_id for r in ledger.collect()) == sorted(f"E{i}" for i in range(16))
    effects = [r.document_id for rows in results.values() for r in rows if r.outcome == "APPLIED"]
    assert sorted(effects) == sorted(f"E{i}" for i in range(16))
    assert len(tries) > 5
    # Merged folders hold the same rows, and a number is given once.
    number, names, added = commits.live(spark, f"{folder}/ledger")
    assert commits.merge(spark, f"{folder}/ledger", submit.LEDGER_TYPES, "return_period")
    assert not commits.commit(spark, f"{folder}/ledger", number, ["other"])
    assert tables.read_ledger(spark, folder, ["07-2026"]).count() == 16
    assert tables.read_ledger(spark, folder, ["08-2026"]).isEmpty()
    assert tables.submit_to_ledger(submissions(spark, [("E3", "ACCEPT")]), folder).first().outcome == "ALREADY_APPLIED"


def entries(spark, count):
    rows = [
        ("c", i, f"E{i}", "PENDING", i % 2 == 0, ["a ₹", "b"], NOW, "2026.07", "", "", 0.5 + i / 97,
         ["tc00"], None if i % 2 else "R. Sen", Decimal(i))
        for i in range(count)
    ]
    names = audit.CHAIN_TYPES.split(", previous_digest")[0]
    return spark.createDataFrame(rows, names)


def python_digest(row):
    body = {k: v for k, v in row.asDict().items() if k not in ("chain_id", "digest", "superseded_by")}
    body["recorded_at"] = "2026-07-10 09:00:00+00:00"
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def test_chain_digests_and_breaks(spark):
    log = audit.append_chain(entries(spark, 5)).orderBy("sequence")
    rows = log.collect()
    previous = GENESIS_DIGEST
    for row in rows:
        assert row.previous_digest == previous
        assert row.digest == python_digest(row)
        previous = row.digest

    def verdict(df):
        row = audit.verify_chain(df).first()
        return row.intact, row.message

    assert verdict(log) == (True, "chain intact")
    assert verdict(log.where("sequence <> 2")) == (False, "entry at position 2 claims sequence 3")
    altered = log.withColumn("action", F.when(F.col("sequence") == 1, "REJECT").otherwise(F.col("action")))
    assert verdict(altered) == (False, "entry 2 does not follow entry 1")
    pointer = spark.createDataFrame([("c", 1, 4)], "chain_id string, sequence bigint, replaced_by bigint")
    later = audit.supersede(log, pointer)
    assert verdict(later) == (True, "chain intact")
    assert later.where("sequence = 1").first().superseded_by == 4
    assert [r.sequence for r in audit.history_for(log, "E3").collect()] == [3]


def test_segments_bound_the_chaining(spark):
    whole = entries(spark, 10)
    log = audit.append_chain(whole, segment_rows=4)
    assert audit.verify_chain(log, segment_rows=4).first().intact
    grown = audit.extend_chain(
        audit.append_chain(whole.where("sequence < 6"), 4), whole.where("sequence >= 6"), 4
    )
    digests = [{r.sequence: r.digest for r in df.collect()} for df in (log, grown)]
    assert digests[0] == digests[1]
    heads = audit.append_chain(audit.segment_heads(log, 4))
    assert [r.sequence for r in heads.orderBy("sequence").collect()] == [0, 1, 2]
    assert audit.verify_chain(heads).first().intact


def test_whole_chains_cross_batches(spark):
    two = entries(spark, 7).unionByName(entries(spark, 4).withColumn("chain_id", F.lit("d")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = audit.append_chain(two.repartition(3), segment_rows=None).orderBy("chain_id", "sequence").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.chain_id, r.sequence) for r in rows] == [("c", i) for i in range(7)] + [("d", i) for i in range(4)]
    for before, row in zip([None, *rows], rows):
        assert row.previous_digest == (before.digest if row.sequence else GENESIS_DIGEST)
        assert row.digest == python_digest(row)


def test_audit_digest_is_one_chain_of_all_classes(spark, monkeypatch):
    """Entries of every class follow each other in one log, also past the length of a segment."""
    count = audit.SEGMENT_ROWS + 3
    classes = F.array(*[F.lit(c) for c in EXCEPTION_CLASSES])
    decided = spark.range(count).select(
        (F.col("id") + 1).alias("seq"),
        F.format_string("E%06d", "id").alias("exception_id"),
        F.element_at(classes, (F.col("id") % len(EXCEPTION_CLASSES) + 1).cast("int")).alias("exception_class"),
        F.lit("PENDING").alias("action"),
        F.lit(True).alias("requires_human"),
        F.array(F.lit("why")).alias("reasons"),
        F.lit("what").alias("detail"),
        F.lit(None).cast(f"struct<confidence:double,evidence:{findings.EVIDENCE_TYPE}>").alias("finding"),
        F.lit("5.00").cast("decimal(28,2)").alias("amount_at_risk"),
    )
    monkeypatch.setattr(decision_queries, "decisions", lambda spark, sf_dir: decided.repartition(5, "exception_id"))
    log = decision_queries.audit_digest(spark, "no folder").orderBy("sequence").collect()
    assert [r.sequence for r in log] == list(range(count))
    assert len({r.chain_id for r in log}) == 1
    previous = GENESIS_DIGEST
    for i, row in enumerate(log):
        investigated = TIER_OF_CLASS[EXCEPTION_CLASSES[i % len(EXCEPTION_CLASSES)]] == "TIER_2"
        body = {
            "sequence": i, "exception_id": f"E{i:06d}", "action": "PENDING", "requires_human": True, "reasons": ["why"],
            "recorded_at": "2001-07-14 09:00:00+00:00", "ruleset_version": "2026.07", "model": "",
            "prompt_digest": hashlib.sha256(b"what").hexdigest()[:16] if investigated else "", "confidence": None,
            "evidence_call_ids": [], "approver": None, "amount_at_risk": "5.00", "previous_digest": previous,
        }
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert (row.exception_id, row.previous_digest) == (body["exception_id"], previous)
        previous = hashlib.sha256(text.encode()).hexdigest()
        assert row.digest == previous


def test_audit_jsonl_round_trip(spark, tmp_path):
    log = audit.append_chain(entries(spark, 6))
    path = str(tmp_path / "log")
    tables.write_audit_jsonl(log, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
    back = tables.read_audit_jsonl(spark, path, "c")
    assert audit.verify_chain(back).first().intact
    assert {r.digest for r in back.collect()} == {r.digest for r in log.collect()}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    size = pattern_length(1800, 120, DISTRIBUTION_MIX)
    made = generate_cycle(spark.range(size), seed=3, period="07-2026", base_date=dt.date(2026, 7, 14))
    result = reconcile(made.books, made.portal, as_of=AS_OF)
    folder = str(tmp_path_factory.mktemp("cycle"))
    arguments = dict(as_of=AS_OF, recorded_at=NOW, period="07-2026", approver="S. Das", proposals=findings.playbook_findings(result.exceptions))
    return result, folder, arguments, cycle_plan.run_cycle(result, folder, **arguments)


def test_cycle_decides_and_records_everything(spark, finished):
    result, folder, arguments, done = finished
    count = result.exceptions.count()
    assert done.decisions.count() == count == done.audit.count()
    assert audit.verify_chain(done.audit).first().intact
    human = done.decisions.where("requires_human").select("exception_id")
    assert human.join(done.submissions, F.col("exception_id") == F.col("document_id")).isEmpty()
    outcome = done.outcome.first()
    assert outcome.documents == 1800 + 18 + 120 + count
    assert outcome.submitted == done.submissions.count() > 0
    assert (outcome.replayed, outcome.exactly_once_violations) == (0, 0)
    assert (outcome.days_to_cutoff, outcome.queued_for_human) == (4, done.queue.count())

    rerun = cycle_plan.run_cycle(result, folder, **arguments)
    again = rerun.outcome.first()
    assert (again.submitted, again.replayed) == (0, outcome.submitted)
    # The stored log is the cycle's own, so it is kept; other entries start another.
    assert tables.read_audit(spark, folder)[0] == 1 and rerun.audit.count() == count
    attempts = cycle_plan.cycle_attempts(spark, folder).orderBy("place").collect()
    assert [(r.last_step, r.ended) for r in attempts] == [("done", True)] * 2
    other = tables.grown_from(audit.append_chain(entries(spark, 3)), folder)
    assert other is None
    short = cycle_plan.run_cycle(result, folder, limit=20, **arguments)
    assert short.outcome.first().exceptions == 20


def test_reviews_bind_to_what_was_shown(spark, finished, tmp_path):
    _, _, _, done = finished
    queue = review.pending_queue(done.queue)
    cards = queue.collect()
    order = [(c.proposed_action != "REJECT", -c.amount_at_risk, c.audit_sequence) for c in cards]
    assert order == sorted(order)
    reject, other = cards[0], cards[-1]
    assert reject.proposed_action == "REJECT" and other.proposed_action != "REJECT"
    rows = [
        (0, "E99999-X", "A. Iyer", "APPROVE", "", None, ""),
        (1, reject.exception_id, "  ", "APPROVE", reject.confirmation, None, ""),
        (2, reject.exception_id, "A. Iyer", "APPROVE", "stale", None, ""),
        (3, other.exception_id, "A. Iyer", "OVERRIDE", other.confirmation, "NO_ACTION", ""),
        (4, other.exception_id, "A. Iyer", "OVERRIDE", other.confirmation, "REJECT", " paid twice "),
        (5, reject.exception_id, " A. Iyer ", "HOLD", reject.confirmation, None, ""),
        (6, reject.exception_id, "B. Rao", "APPROVE", reject.confirmation, None, ""),
    ]
    approvals = spark.createDataFrame(
        [(o, e, a, k, c, NOW, v, n) for o, e, a, k, c, v, n in rows],
        "ord bigint, exception_id string, approver string, review_action string, "
        "confirmation string, recorded_at timestamp, override string, note string",
    )
    for config in (ReconConfig(), ReconConfig(hot_key_rows=2)):
        judged = review.resolve_approvals(done.queue, approvals, config).orderBy("ord").collect()
        assert [r.status for r in judged] == [
            "unknown", "unnamed", "stale", "bad_override", "resolved", "resolved", "already_resolved"
        ]
    assert judged[4].reasons[-2:] == ["overrided by A. Iyer", "reviewer note: paid twice"]
    assert judged[5].final_action == "PENDING" and judged[5].reasons[-1] == "holdd by A. Iyer"

    folder = str(tmp_path)
    applied = cycle_plan.apply_reviews(done, approvals, folder, period="07-2026").collect()
    sent = {r.ord: r.outcome for r in applied if r.outcome}
    assert sent == {4: "APPLIED"}
    number, log = tables.read_audit(spark, folder)
    assert number == 1 and log.count() == done.audit.count() + 2
    assert audit.verify_chain(log).first().intact
    # A second batch remembers the first: nothing is decided twice, and no number is given twice.
    third = cards[1]
    late = [(7, reject.exception_id, "C. Roy", "APPROVE", reject.confirmation, None, ""),
            (8, third.exception_id, "C. Roy", "APPROVE", third.confirmation, None, "")]
    more = spark.createDataFrame([(o, e, a, k, c, NOW, v, n) for o, e, a, k, c, v, n in late], approvals.schema)
    again = {r.ord: r.status for r in cycle_plan.apply_reviews(done, more, folder, period="07-2026").collect()}
    assert again == {7: "already_resolved", 8: "resolved"}
    number, longer = tables.read_audit(spark, folder)
    assert number == 2 and longer.count() == longer.select("sequence").distinct().count() == done.audit.count() + 3
    assert audit.verify_chain(longer).first().intact
    # A version made from an older one is refused.
    assert tables.write_audit(log, folder, 1) is None
    pointed = {r.sequence: r.superseded_by for r in log.where("superseded_by is not null").collect()}
    assert set(pointed) == {reject.audit_sequence, other.audit_sequence}
    left = review.queue_depth(done.queue, approvals.where("ord in (4, 5)")).first()
    assert (left.pending, left.resolved) == (len(cards) - 2, 2)
