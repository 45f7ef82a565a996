"""Registered queries: scalar expressions, gate, submission, audit, review and cycle."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS
from ledgerlane.fixed_values import DEFAULT_TAXPAYER
from ledgerlane.functions import dates, digests, identifiers, money
from ledgerlane.operators import audit, evidence, findings, hashtree, policy, review, submit, summaries
from ledgerlane.operators.scale import cut, rank_in_group, shared_dir, side_by_side
from ledgerlane.operators.sides import prepare_side
from ledgerlane.plans import cycle as cycle_plan
from ledgerlane.plans.ledger_queries import as_double, ledger, listed
from ledgerlane.sources import derived, tables

RECORDED_AT = dt.datetime(2001, 7, 14, 9, 0, tzinfo=dt.timezone.utc)
_decided: dict[tuple, DataFrame] = {}


def order_key(anchor: Column | None = None) -> Column:
    """Order number behind an exception, from its anchor line id."""
    anchor = anchor if anchor is not None else F.coalesce("portal.line_id", "book.line_id")
    return F.substring(anchor, 2, 10).cast("long")


def exceptions_with_key(spark, sf_dir) -> DataFrame:
    return ledger(spark, sf_dir)[1].exceptions.withColumn("k", order_key())


def derived_findings(spark, sf_dir) -> DataFrame:
    """A proposal per investigated exception, with every kind of weakness at a known rate."""
    k = F.col("k")
    actions = F.array(F.lit("ACCEPT"), F.lit("REJECT"), F.lit("PENDING"))
    items = F.array(
        *[
            F.struct(
                F.lit(f"tc0{i}-{tool}").alias("tool_call_id"),
                F.lit(tool).alias("tool_name"),
                F.concat(F.lit("case "), k.cast("string")).alias("claim"),
            )
            for i, tool in enumerate(("query_purchase_register", "query_vendor_master"))
        ]
    )
    none = F.filter(items, lambda e: F.lit(False))
    return (
        exceptions_with_key(spark, sf_dir)
        .where((policy.route(F.col("exception_class")) == "TIER_2") & (k % 17 != 0))
        .select(
            "exception_id",
            "k",
            F.col("exception_class").alias("proposed_class"),
            F.element_at(actions, (k % 3 + 1).cast("int")).alias("proposed_action"),
            (k * 37 % 1000 / 1000.0).alias("confidence"),
            F.when(k % 19 == 0, F.lit("  "))
            .otherwise(F.concat(F.lit("checked order "), k.cast("string")))
            .alias("rationale"),
            F.when(k % 11 == 0, none).otherwise(items).alias("evidence"),
        )
    )


def decisions(spark, sf_dir) -> DataFrame:
    key = derived.state(spark, sf_dir)
    if key not in _decided:
        result = ledger(spark, sf_dir)[1]
        proposals = derived_findings(spark, sf_dir).drop("k")
        _decided[key] = cut(cycle_plan.decide_all(result, proposals))
    return _decided[key]


def forget_runs() -> None:
    _decided.clear()


def gstin_validation(spark, sf_dir) -> DataFrame:
    lines = derived.books(spark, sf_dir).select("line_id", "supplier_gstin")
    odd = F.conv(F.substring("line_id", 2, 10), 10, 10).cast("long") % 9
    raw = (
        F.when(odd == 0, F.lower("supplier_gstin"))
        .when(odd == 1, F.concat(F.lit("  "), "supplier_gstin"))
        .when(odd == 2, F.substring("supplier_gstin", 1, 14))
        .when(odd == 3, F.concat(F.substring("supplier_gstin", 1, 14), F.lit("0")))
        .otherwise(F.col("supplier_gstin"))
    )
    checked = lines.withColumn("gstin_key", identifiers.normalise_gstin(raw))
    return checked.select(
        "line_id", identifiers.check_normalised_gstin(F.col("gstin_key")).alias("c")
    ).select(
        "line_id",
        F.col("c.normalised").alias("normalised"),
        F.col("c.well_formed").alias("well_formed"),
        F.col("c.checksum_valid").alias("checksum_valid"),
        F.coalesce("c.reason", F.lit("")).alias("reason"),
        F.coalesce("c.state_code", F.lit("")).alias("state_code"),
    )


def invoice_number_normalisation(spark, sf_dir) -> DataFrame:
    lines = derived.portal(spark, sf_dir).select("line_id", "invoice_number")
    other = F.when(
        F.conv(F.substring("line_id", 2, 10), 10, 10).cast("long") % 2 == 0,
        F.concat(F.lower("invoice_number"), F.lit(" x")),
    ).otherwise(F.concat("invoice_number", F.lit("/007")))
    test = identifiers.numbers_compatible(F.col("invoice_number"), other)
    return lines.select(
        "line_id",
        identifiers.normalise_invoice_number(F.col("invoice_number")).alias("num_key"),
        F.size(identifiers.invoice_tokens(F.col("invoice_number"))).cast("long").alias("tokens"),
        test["compatible"].alias("compatible"),
        test["reason"].alias("reason"),
        test["affinity"].alias("affinity"),
    )


def tax_amounts(spark, sf_dir) -> DataFrame:
    lines = prepare_side(derived.portal(spark, sf_dir))
    value = money.invoice_value(F.col("taxable"), F.col("total_tax"))
    return lines.select(
        "line_id",
        as_double("total_tax"),
        value.cast("double").alias("invoice_value"),
        money.is_interstate(F.col("igst")).alias("interstate"),
        money.well_formed_split(F.col("cgst"), F.col("sgst"), F.col("igst")).alias("well_formed"),
        money.money_of_double(F.col("taxable").cast("double") / 8).cast("double").alias("eighth"),
    )


def statutory_dates(spark, sf_dir) -> DataFrame:
    day, as_of = F.col("invoice_date"), F.lit(derived.AS_OF)
    return derived.portal(spark, sf_dir).select(
        "line_id",
        dates.days_between(day, as_of).cast("long").alias("days_apart"),
        dates.financial_year_start(day).cast("long").alias("fy_start"),
        dates.is_time_barred(day, derived.AS_OF, DEFAULTS).alias("time_barred"),
        dates.days_to_cutoff(day, DEFAULTS).cast("long").alias("days_to_cutoff"),
        dates.period_cutoff(F.col("return_period"), 14).cast("string").alias("period_cutoff"),
    )


def tolerance_band(spark, sf_dir) -> DataFrame:
    orders = derived.table(spark, sf_dir, "orders")
    price = F.round("o_totalprice", 2).cast(money.MONEY)
    right = F.round(price * F.lit("0.1").cast("decimal(2,1)"), 2).cast(money.MONEY)
    left = right + (F.col("o_orderkey") % 240 - 20) * F.lit("0.50").cast("decimal(3,2)")
    return orders.select("o_orderkey", evidence.probe_tolerance(left, right).alias("t")).select(
        "o_orderkey",
        F.col("t.difference").cast("double").alias("difference"),
        F.col("t.allowed").cast("double").alias("allowed"),
        F.col("t.within_tolerance").alias("within_tolerance"),
    )


def drc01c_exposure(spark, sf_dir) -> DataFrame:
    def by_month(df):
        return df.withColumn("return_period", dates.return_period(F.col("invoice_date")))

    books = by_month(prepare_side(derived.books(spark, sf_dir)))
    portal = by_month(prepare_side(derived.portal(spark, sf_dir)))
    exposure = summaries.drc01c_exposure(summaries.itc_totals(books, portal, "return_period"))
    return exposure.select(
        "return_period",
        *[as_double(c) for c in ("claimed_itc", "available_itc", "excess", "threshold", "headroom")],
        "fires",
    )


def gate_decisions(spark, sf_dir) -> DataFrame:
    return decisions(spark, sf_dir).select(
        "exception_id",
        policy.route(F.col("exception_class")).alias("tier"),
        "action",
        "requires_human",
        "escalated",
        policy.is_irreversible(F.col("action")).alias("irreversible"),
        listed("reasons"),
    )


def presented_submissions(spark, sf_dir) -> DataFrame:
    """Every decided accept or reject, some presented twice, as a retrying caller would."""
    chosen = decisions(spark, sf_dir).where(F.col("action").isin("ACCEPT", "REJECT"))
    once = submit.to_submissions(chosen, DEFAULT_TAXPAYER, derived.PERIOD)
    again = once.where(F.col("ord") % 3 == 0).withColumn("ord", F.col("ord") + 10_000_000)
    return once.unionByName(again)


def ledger_before(spark, sf_dir) -> DataFrame:
    """A ledger that already holds every fifth decision."""
    chosen = decisions(spark, sf_dir).where(
        F.col("action").isin("ACCEPT", "REJECT") & (F.col("seq") % 5 == 0)
    )
    earlier = submit.to_submissions(chosen, DEFAULT_TAXPAYER, derived.PERIOD)
    keyed = submit.with_key(earlier)
    return keyed.select(
        "taxpayer_gstin",
        "return_period",
        "document_id",
        "action",
        "ruleset_version",
        "idempotency_key",
        F.concat(F.lit("REF-"), F.substring("idempotency_key", 1, 12)).alias("portal_reference"),
        (-F.col("ord")).alias("applied_seq"),
    )


def submit_once(spark, sf_dir) -> DataFrame:
    sent = submit.submit_once(
        presented_submissions(spark, sf_dir), ledger_before(spark, sf_dir)
    )
    return sent.select(
        "document_id", "ord", "idempotency_key", "outcome", "portal_reference", "detail"
    )


def exactly_once(spark, sf_dir) -> DataFrame:
    before = ledger_before(spark, sf_dir)
    sent = submit.submit_once(presented_submissions(spark, sf_dir), before)
    after = before.unionByName(submit.ledger_rows(sent))
    counted = submit.attempts_vs_applied(sent, after)
    inbox = submit.ims_inbox(after, DEFAULT_TAXPAYER, derived.PERIOD)
    totals = counted.agg(
        F.sum("presentations").alias("attempts"),
        F.sum("effects").alias("effects"),
        F.count_if(F.col("applied_rows") > 1).alias("duplicates"),
        F.sum("applied_rows").alias("applied_rows"),
    )
    documents = inbox.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("current_action") == "REJECT").alias("rejected_documents"),
    )
    violations = submit.exactly_once_violations(sent).agg(F.count(F.lit(1)).alias("violations"))
    return side_by_side(totals, documents, violations)


def _entries(spark, sf_dir) -> DataFrame:
    """Audit entries of the cycle: one log, in the order in which the exceptions are decided."""
    cycle = digests.cycle_id(
        F.lit(DEFAULT_TAXPAYER), F.lit(derived.PERIOD), F.lit(DEFAULTS.ruleset_version)
    )
    return audit.audit_entries(
        decisions(spark, sf_dir), cycle, F.col("seq") - 1, F.lit(RECORDED_AT), approver="J. Rao"
    )


def _entries_by_class(spark, sf_dir) -> DataFrame:
    """Audit entries with one chain per exception class, so that single chains can be damaged."""
    numbered = rank_in_group(
        decisions(spark, sf_dir), ["exception_class"], ["seq"], "place", DEFAULTS.hot_key_rows
    ).withColumn("place", F.col("place") - 1)
    return audit.audit_entries(
        numbered, F.col("exception_class"), F.col("place"), F.lit(RECORDED_AT), approver="J. Rao"
    )


def audit_digest(spark, sf_dir) -> DataFrame:
    """The cycle's log as one unbroken chain: every entry covers the one before it, whatever its class."""
    return audit.append_chain(_entries(spark, sf_dir), segment_rows=None).select(
        "chain_id", "sequence", "exception_id", "previous_digest", "digest"
    )


def audit_verify(spark, sf_dir) -> DataFrame:
    """One chain per class: some intact, one with a missing entry, one with an altered entry."""
    log = audit.append_chain(_entries_by_class(spark, sf_dir))
    damaged = log.where(
        ~((F.col("chain_id") == "DUPLICATE") & (F.col("sequence") == 20))
    ).withColumn(
        "action",
        F.when(
            (F.col("chain_id") == "RCM") & (F.col("sequence") == 10), F.lit("ACCEPT")
        ).otherwise(F.col("action")),
    )
    return audit.verify_chain(damaged)


SEGMENT = 20
"""Entries per segment in ``audit_segments``, so that small tables have several."""


def audit_segments(spark, sf_dir) -> DataFrame:
    """Chains in segments with their links; in one chain a whole segment was replaced by another."""
    entries = _entries_by_class(spark, sf_dir)
    links = audit.link_log(cut(audit.append_chain(entries, SEGMENT)), SEGMENT)
    replaced = (F.col("chain_id") == "DUPLICATE") & (F.floor(F.col("sequence") / SEGMENT) == 1)
    forged = entries.withColumn("action", F.when(replaced, F.lit("NO_ACTION")).otherwise(F.col("action")))
    return audit.verify_log(cut(audit.append_chain(forged, SEGMENT)), cut(links), segment_rows=SEGMENT)


TREE_HEIGHT = 3
"""Levels of a block in ``audit_tree``, so that small tables need several steps."""


def audit_tree(spark, sf_dir) -> DataFrame:
    """Seals of all chains: whether they grew from the log of at most 100 entries a chain, how many
    entries of a copy with one altered entry are proved against them, and where that copy differs."""
    log = cut(audit.append_chain(_entries_by_class(spark, sf_dir)))
    tree = hashtree.build(log, TREE_HEIGHT)
    sealed = cut(hashtree.seals(tree))
    older = cut(hashtree.seals(hashtree.build(log.where("sequence < 100"), TREE_HEIGHT)))
    grown = hashtree.verify_growth(hashtree.prove_growth(tree, older), older, sealed)
    altered = (F.col("chain_id") == "DUPLICATE") & (F.col("sequence") == 20)
    copy = log.withColumn("action", F.when(altered, F.lit("NO_ACTION")).otherwise(F.col("action")))
    other = hashtree.build(copy, TREE_HEIGHT)
    proved = hashtree.verify(hashtree.prove_entries(other, copy), sealed).groupBy("chain_id").agg(
        F.count_if("holds").alias("proved")
    )
    found = hashtree.verify_seals(other, sealed, hashtree.marks(tree))
    return found.join(sealed.select("chain_id", "root"), "chain_id").join(grown, "chain_id").join(proved, "chain_id")


def audit_history(spark, sf_dir) -> DataFrame:
    """Superseded entries and what replaced them."""
    log = audit.append_chain(_entries_by_class(spark, sf_dir))
    pointers = log.where(F.col("sequence") % 4 == 0).select(
        "chain_id", "sequence", (F.col("sequence") + 1000).alias("replaced_by")
    )
    return (
        audit.supersede(log, pointers)
        .where("superseded_by is not null")
        .select("chain_id", "sequence", "exception_id", "action", "superseded_by")
    )


def review_queue(spark, sf_dir) -> DataFrame:
    queue = review.build_review_queue(decisions(spark, sf_dir))
    return review.pending_queue(queue).select(
        "exception_id",
        "exception_class",
        "supplier_gstin",
        "invoice_number",
        as_double("amount_at_risk"),
        "proposed_action",
        "audit_sequence",
        "confirmation",
    )


def derived_approvals(queue: DataFrame) -> DataFrame:
    """Approvals of every kind, derived from the cards: two per card, in a known order."""
    k = order_key(F.substring_index("exception_id", "-", -1))
    attempt = F.explode(F.array(F.lit(0), F.lit(1)))
    override = (
        F.when(F.col("k") % 4 == 0, F.lit("ACCEPT"))
        .when(F.col("k") % 4 == 1, F.lit("NO_ACTION"))
        .when(F.col("k") % 4 == 2, F.lit("REJECT"))
    )
    kinds = F.array(F.lit("APPROVE"), F.lit("OVERRIDE"), F.lit("HOLD"))
    return (
        queue.select("exception_id", "audit_sequence", "confirmation", k.alias("k"), attempt.alias("n"))
        .select(
            (F.col("audit_sequence") * 2 + F.col("n")).alias("ord"),
            F.when(F.col("k") % 29 == 0, F.concat(F.lit("X"), "exception_id"))
            .otherwise(F.col("exception_id"))
            .alias("exception_id"),
            F.when(F.col("k") % 13 == F.col("n"), F.lit("  ")).otherwise(F.lit(" A. Iyer ")).alias("approver"),
            F.element_at(kinds, ((F.col("k") + F.col("n")) % 3 + 1).cast("int")).alias("review_action"),
            F.when(F.col("k") % 7 == F.col("n"), F.lit("stale")).otherwise(F.col("confirmation")).alias("confirmation"),
            F.lit(RECORDED_AT).alias("recorded_at"),
            override.alias("override"),
            F.when(F.col("k") % 2 == 0, F.lit(" seen ")).otherwise(F.lit("")).alias("note"),
        )
    )


def review_resolution(spark, sf_dir) -> DataFrame:
    queue = review.build_review_queue(decisions(spark, sf_dir))
    judged = review.resolve_approvals(queue, derived_approvals(queue))
    return judged.select(
        "ord",
        "exception_id",
        "status",
        F.coalesce("final_action", F.lit("")).alias("final_action"),
        F.coalesce(F.array_join("reasons", "|"), F.lit("")).alias("reasons"),
        "message",
    )


def review_batches(spark, sf_dir) -> DataFrame:
    """Two batches of approvals, the first of each card and the second, against one stored log: what the
    first resolved, the second finds decided, and every entry of the log has a number of its own.
    """
    folder = f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    decided = decisions(spark, sf_dir)
    entries = audit.audit_entries(decided, F.lit("cycle"), F.col("seq") - 1, F.lit(RECORDED_AT), DEFAULTS, None)
    log = tables.write_audit(audit.append_chain(entries), folder, 0)
    queue = cut(review.build_review_queue(decided))
    made = cycle_plan.Cycle(decisions=decided, audit=log, queue=queue, submissions=None, outcome=None)
    approvals = cut(derived_approvals(queue))
    judged = [
        cycle_plan.apply_reviews(made, approvals.where(F.col("ord") % 2 == n), folder, period=derived.PERIOD)
        for n in (0, 1)
    ]
    _, last = tables.read_audit(spark, folder)
    head = decided.count()
    added = last.where(F.col("sequence") >= head).select(
        "exception_id", F.col("sequence").alias("entry"), F.lit("resolved").alias("status")
    )
    return judged[0].unionByName(judged[1]).join(added, ["exception_id", "status"], "left").select(
        "ord", "exception_id", "status",
        F.coalesce("final_action", F.lit("")).alias("final_action"),
        F.coalesce("entry", F.lit(-1)).cast("long").alias("entry"),
    )


def review_depth(spark, sf_dir) -> DataFrame:
    queue = review.build_review_queue(decisions(spark, sf_dir))
    resolved = review.resolve_approvals(queue, derived_approvals(queue)).where(
        "status = 'resolved'"
    )
    return review.queue_depth(queue, resolved).select(
        "pending", "resolved", as_double("amount_awaiting_review")
    )


def cycle_outcome(spark, sf_dir) -> DataFrame:
    result = ledger(spark, sf_dir)[1]
    decided = decisions(spark, sf_dir)
    wanted = submit.to_submissions(policy.submittable(decided), DEFAULT_TAXPAYER, derived.PERIOD)
    sent = submit.submit_once(wanted, ledger_before(spark, sf_dir))
    cycle = digests.cycle_id(
        F.lit(DEFAULT_TAXPAYER), F.lit(derived.PERIOD), F.lit(DEFAULTS.ruleset_version)
    )
    return cycle_plan.cycle_outcome(
        result, decided, sent, derived.AS_OF, derived.PERIOD
    ).withColumn("cycle_id", cycle).withColumn(
        "days_to_cutoff", F.col("days_to_cutoff").cast("long")
    )


class _Stopped(Exception):
    """A cycle was made to stop."""


def cycle_crashes(spark, sf_dir) -> DataFrame:
    """A cycle that stops after each of its writes, and is run again each time until it ends."""
    folder = f"{shared_dir(spark)}/crashes-{uuid.uuid4().hex}"
    result, proposals = ledger(spark, sf_dir)[1], cut(derived_findings(spark, sf_dir).drop("k"))
    for last in ("audit", "ledger", ""):

        def stop(step: str, last: str = last) -> None:
            if step == last:
                raise _Stopped(step)

        try:
            done = cycle_plan.run_cycle(
                result, folder, as_of=derived.AS_OF, recorded_at=RECORDED_AT, period=derived.PERIOD,
                proposals=proposals, approver="J. Rao", after_write=stop,
            )
        except _Stopped:
            continue
    number, log = tables.read_audit(spark, folder)
    attempts = cycle_plan.cycle_attempts(spark, folder).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ended").alias("ended")
    )
    stored = tables.read_ledger(spark, folder).groupBy("idempotency_key").count().agg(
        F.sum("count").alias("applied"), F.count_if(F.col("count") > 1).alias("duplicates")
    )
    sent = done.submissions.agg(
        F.count_if(submit.took_effect()).alias("applied_last"), F.count_if(~submit.took_effect()).alias("replayed_last")
    )
    entries = log.agg(F.count(F.lit(1)).alias("entries")).withColumn("versions", F.lit(number).cast("long"))
    sound = tables.verify_audit(spark, folder).agg(F.bool_and("intact").alias("intact"))
    return side_by_side(attempts, stored, sent, entries, sound)


def case_text(spark, sf_dir) -> DataFrame:
    return exceptions_with_key(spark, sf_dir).select(
        "exception_id",
        findings.describe_exception().alias("case_text"),
        digests.prompt_hash(F.col("detail")).alias("prompt_digest"),
    )


def playbook_findings(spark, sf_dir) -> DataFrame:
    proposals = findings.playbook_findings(ledger(spark, sf_dir)[1].exceptions)
    ids = F.transform("evidence", lambda e: e["tool_call_id"])
    return proposals.select(
        "exception_id",
        "proposed_action",
        "confidence",
        F.array_join(ids, "|").alias("calls"),
        F.col("steps_used").cast("long").alias("steps_used"),
    )


QUERIES = {
    "gstin_validation": gstin_validation,
    "invoice_number_normalisation": invoice_number_normalisation,
    "tax_amounts": tax_amounts,
    "statutory_dates": statutory_dates,
    "tolerance_band": tolerance_band,
    "drc01c_exposure": drc01c_exposure,
    "gate_decisions": gate_decisions,
    "submit_once": submit_once,
    "exactly_once": exactly_once,
    "audit_digest": audit_digest,
    "audit_verify": audit_verify,
    "audit_segments": audit_segments,
    "audit_tree": audit_tree,
    "audit_history": audit_history,
    "review_queue": review_queue,
    "review_resolution": review_resolution,
    "review_batches": review_batches,
    "review_depth": review_depth,
    "cycle_outcome": cycle_outcome,
    "cycle_crashes": cycle_crashes,
    "case_text": case_text,
    "playbook_findings": playbook_findings,
}
