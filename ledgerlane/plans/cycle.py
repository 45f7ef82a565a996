"""One filing cycle: reconcile, decide, record, then submit.

The audit table is written before the submission ledger. A run that stops in between leaves a
recorded decision with an unknown outcome; running again presents the same keys and applies
nothing twice. What is about to be written is noted first, so the steps of every attempt can be read
afterwards (``cycle_attempts``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import DEFAULT_TAXPAYER
from ledgerlane.functions import dates, digests
from ledgerlane.operators import audit, findings, policy, review, submit, summaries
from ledgerlane.operators.scale import cut, global_index, side_by_side
from ledgerlane.plans.reconcile import Reconciliation
from ledgerlane.sources import tables


@dataclass(frozen=True)
class Cycle:
    decisions: DataFrame
    audit: DataFrame
    queue: DataFrame
    submissions: DataFrame
    outcome: DataFrame


def first_exceptions(exceptions: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` exceptions by id; ids are consecutive, so this is a filter."""
    return exceptions if not limit else exceptions.where(F.col("seq") <= limit)


def decide_all(
    result: Reconciliation,
    proposals: DataFrame | None,
    config: ReconConfig = DEFAULTS,
    limit: int | None = None,
) -> DataFrame:
    """Gate decisions. Proposals only count for classes that are investigated; without any, every
    investigated exception stays pending."""
    exceptions = first_exceptions(result.exceptions, limit)
    investigated = exceptions.where(policy.route(F.col("exception_class")) == "TIER_2")
    if proposals is None:
        proposals = exceptions.sparkSession.createDataFrame([], findings.FINDING_TYPE)
    allowed = proposals.join(investigated.select("exception_id"), "exception_id", "left_semi")
    return policy.decide(exceptions, allowed, config)


def cycle_outcome(
    result: Reconciliation, decisions: DataFrame, submissions: DataFrame, as_of: dt.date,
    period: str, config: ReconConfig = DEFAULTS,
) -> DataFrame:
    """One row of cycle counts."""
    summary = summaries.match_summary(result.matched, result.exceptions).select(
        "documents", "exact_count", "fuzzy_count"
    )
    investigated = policy.route(F.col("exception_class")) == "TIER_2"
    counts = decisions.agg(
        F.count(F.lit(1)).alias("exceptions"),
        F.count_if(~investigated).alias("rule_closed"),
        F.count_if(investigated).alias("investigated"),
        F.count_if("requires_human").alias("queued_for_human"),
    )
    sent = submissions.agg(
        F.count_if(submit.took_effect()).alias("submitted"),
        F.count_if(~submit.took_effect()).alias("replayed"),
    )
    violations = submit.exactly_once_violations(submissions).agg(
        F.count(F.lit(1)).alias("exactly_once_violations")
    )
    return (
        side_by_side(summary, counts, sent, violations)
        .withColumn("period", F.lit(period))
        .withColumn("days_to_cutoff", dates.days_to_cutoff(F.lit(as_of), config))
    )


def run_cycle(
    result: Reconciliation,
    folder: str,
    *,
    as_of: dt.date,
    recorded_at: dt.datetime,
    period: str,
    proposals: DataFrame | None = None,
    taxpayer: str = DEFAULT_TAXPAYER,
    limit: int | None = None,
    approver: str | None = None,
    config: ReconConfig = DEFAULTS,
    after_write: Callable[[str], None] | None = None,
) -> Cycle:
    """Run a cycle into ``folder`` (``audit`` and ``ledger`` tables).

    It may stop anywhere and be run again with the same arguments. A stored log that begins with the cycle's
    entries is kept, with what reviews added to it; another one is started anew. ``after_write`` is called
    with the name of each table once it is written.
    """
    spark, attempt = result.exceptions.sparkSession, uuid.uuid4().hex
    written = after_write or (lambda step: None)
    decisions = cut(decide_all(result, proposals, config, limit))
    cycle = digests.cycle_id(F.lit(taxpayer), F.lit(period), F.lit(config.ruleset_version))
    entries = audit.audit_entries(
        decisions, cycle, F.col("seq") - 1, F.lit(recorded_at), config, approver
    )
    chained = cut(audit.append_chain(entries))
    tables.intend(spark, folder, attempt, "audit")
    log = tables.grown_from(chained, folder)
    while log is None:
        number, _ = tables.read_audit(spark, folder)
        log = tables.write_audit(chained, folder, number, anew=True)
    written("audit")

    wanted = submit.to_submissions(policy.submittable(decisions), taxpayer, period, config)
    tables.intend(spark, folder, attempt, "ledger")
    sent = tables.submit_to_ledger(wanted, folder, config)
    written("ledger")
    tables.intend(spark, folder, attempt, "done")
    return Cycle(
        decisions=decisions,
        audit=log,
        queue=review.build_review_queue(decisions),
        submissions=sent,
        outcome=cycle_outcome(result, decisions, sent, as_of, period, config),
    )


def cycle_attempts(spark, folder: str) -> DataFrame:
    """Attempts at the cycle in ``folder``: the last step each came to, and whether it ended."""
    last = F.max_by("step", "place")
    return tables.read_intents(spark, folder).groupBy("attempt").agg(
        F.min("place").alias("place"), last.alias("last_step"), (last == "done").alias("ended")
    )


def _recorded(log: DataFrame, judged: DataFrame, config: ReconConfig) -> tuple[DataFrame, DataFrame]:
    """The resolved approvals with their place in the log, and the log with them."""
    resolved = global_index(judged.where("status = 'resolved'"), ["ord"], "place")
    # A cycle has one chain; its length is where the new entries go on.
    (head,) = log.groupBy("chain_id").count().collect()
    numbered = resolved.withColumn("chain_id", F.lit(head["chain_id"])).withColumn(
        "sequence", F.col("place") + head["count"]
    )
    entries = numbered.select(
        "chain_id",
        "sequence",
        "exception_id",
        F.col("final_action").alias("action"),
        F.lit(False).alias("requires_human"),
        "reasons",
        "recorded_at",
        F.lit(config.ruleset_version).alias("ruleset_version"),
        F.lit("").alias("model"),
        F.lit("").alias("prompt_digest"),
        "confidence",
        F.transform("evidence", lambda e: e["tool_call_id"]).alias("evidence_call_ids"),
        F.col("name").alias("approver"),
        "amount_at_risk",
    )
    pointers = numbered.select(
        "chain_id",
        F.col("audit_sequence").alias("sequence"),
        (F.col("place") + head["count"]).alias("replaced_by"),
    )
    return numbered, audit.supersede(audit.extend_chain(log, entries), pointers)


def apply_reviews(
    cycle: Cycle,
    approvals: DataFrame,
    folder: str,
    *,
    period: str,
    taxpayer: str = DEFAULT_TAXPAYER,
    config: ReconConfig = DEFAULTS,
) -> DataFrame:
    """Judge approvals; record the valid ones, supersede what they replace, then submit.

    Batches may follow each other: each goes on from the last version of the log in ``folder`` (the cycle's
    own where there is none), and a card whose entry that log supersedes was decided. If another
    batch commits its version first, this one is judged again over it.
    """
    spark = approvals.sparkSession
    approvals, written = cut(approvals), None
    while written is None:
        number, log = tables.read_audit(spark, folder)
        log = cycle.audit if log is None else log
        replaced = log.where("superseded_by IS NOT NULL").select(F.col("sequence").alias("audit_sequence"))
        settled = cycle.queue.join(replaced, "audit_sequence").select("exception_id")
        judged = cut(review.resolve_approvals(cycle.queue, approvals, config, settled))
        numbered, after = _recorded(log, judged, config)
        if numbered.isEmpty():
            break
        written = tables.write_audit(after, folder, number)

    wanted = numbered.where(F.col("final_action").isin("ACCEPT", "REJECT")).select(
        "exception_id", F.col("final_action").alias("action"), F.col("ord").alias("seq")
    )
    sent = tables.submit_to_ledger(submit.to_submissions(wanted, taxpayer, period, config), folder, config)
    return judged.join(sent.select("ord", "outcome", "portal_reference"), "ord", "left")
