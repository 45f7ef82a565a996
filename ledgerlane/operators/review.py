"""Human review: the queue, what binds an approval to it, and what approvals do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    OVERRIDES,
    TEXT_BAD_OVERRIDE,
    TEXT_STALE_VIEW,
    TEXT_UNNAMED_APPROVER,
)
from ledgerlane.functions import digests, money
from ledgerlane.functions.money import MONEY
from ledgerlane.operators.scale import lookup


def confirmation_digest(item: str = "") -> Column:
    """Digest of everything on a card that could change a decision."""

    def col(name: str) -> Column:
        return F.col(f"{item}{name}")

    confidence = F.coalesce(F.format_string("%.4f", col("confidence")), F.lit(""))
    no_confidence = F.when(col("confidence").isNull(), F.lit("")).otherwise(confidence)
    evidence = F.transform(
        col("evidence"), lambda e: F.concat(e["tool_call_id"], F.lit(":"), e["claim"])
    )
    return digests.sha256_hex(
        F.concat_ws(
            "␟",
            col("exception_id"),
            col("exception_class"),
            col("proposed_action"),
            money.plain(col("amount_at_risk")),
            col("rationale"),
            no_confidence,
            F.array_join(col("reasons"), "|"),
            F.array_join(evidence, "|"),
        ),
        32,
    )


def build_review_queue(decisions: DataFrame) -> DataFrame:
    """Cards for the decisions that need a person. The invoice number is the book's first."""
    finding = F.col("finding")
    no_evidence = F.filter(finding["evidence"], lambda e: F.lit(False))
    cards = decisions.where("requires_human").select(
        "exception_id",
        "exception_class",
        "supplier_gstin",
        F.coalesce("book.invoice_number", "portal.invoice_number").alias("invoice_number"),
        "amount_at_risk",
        F.col("action").alias("proposed_action"),
        "reasons",
        F.coalesce(finding["rationale"], F.lit("")).alias("rationale"),
        finding["confidence"].alias("confidence"),
        F.coalesce(finding["evidence"], no_evidence, _empty_evidence()).alias("evidence"),
        (F.col("seq") - 1).alias("audit_sequence"),
        "detail",
    )
    return cards.withColumn("confirmation", confirmation_digest())


def _empty_evidence() -> Column:
    return F.array().cast(
        "array<struct<tool_call_id:string,tool_name:string,claim:string>>"
    )


def pending_queue(queue: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Open cards: rejects first, then highest amount, then arrival."""
    if resolved is not None:
        queue = queue.join(resolved.select("exception_id"), "exception_id", "left_anti")
    return queue.orderBy(
        F.col("proposed_action") != "REJECT", F.desc("amount_at_risk"), "audit_sequence"
    )


def queue_depth(queue: DataFrame, resolved_ids: DataFrame) -> DataFrame:
    """One row: pending and resolved cards, amount still waiting."""
    marked = queue.join(
        resolved_ids.select("exception_id").distinct().withColumn("done", F.lit(True)),
        "exception_id",
        "left",
    )
    open_card = F.col("done").isNull()
    return marked.agg(
        F.count_if(open_card).alias("pending"),
        F.count_if(~open_card).alias("resolved"),
        F.coalesce(F.sum(F.when(open_card, F.col("amount_at_risk"))), F.lit(0))
        .cast(MONEY)
        .alias("amount_awaiting_review"),
    )


def final_action(review_action: Column, proposal: Column, override: Column) -> Column:
    """NULL where an override names nothing allowed."""
    return (
        F.when(review_action == "APPROVE", proposal)
        .when(review_action == "HOLD", F.lit("PENDING"))
        .when(override.isin(*OVERRIDES), override)
    )


def review_reasons(review_action: Column, approver: Column, note: Column) -> Column:
    decided = F.concat(F.lower(review_action), F.lit("d by "), approver)
    noted = F.concat(F.lit("reviewer note: "), F.trim(note))
    has_note = F.coalesce(F.trim(note) != "", F.lit(False))
    return F.when(has_note, F.array(decided, noted)).otherwise(F.array(decided))


def resolve_approvals(
    queue: DataFrame,
    approvals: DataFrame,
    config: ReconConfig = DEFAULTS,
    settled: DataFrame | None = None,
) -> DataFrame:
    """Status of each approval, checked in order; the first valid one per card wins.

    ``settled`` has the exception_id of cards that earlier batches resolved: approvals of these come late.

    Many approvals may name one card, so cards are looked up with hot keys apart and the winner
    is a grouped minimum.
    """
    cards = queue.select(
        "exception_id",
        F.lit(True).alias("queued"),
        F.col("proposed_action"),
        F.col("confirmation").alias("current_confirmation"),
        F.col("reasons").alias("card_reasons"),
        "confidence",
        "evidence",
        "amount_at_risk",
        "audit_sequence",
    )
    if settled is None:
        cards = cards.withColumn("settled", F.lit(False))
    else:
        known = settled.select("exception_id", F.lit(True).alias("settled"))
        cards = cards.join(known, "exception_id", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    looked_up = lookup(approvals, cards, ["exception_id"], "left", config.hot_key_rows)
    name = F.trim(F.coalesce("approver", F.lit("")))
    action = final_action(F.col("review_action"), F.col("proposed_action"), F.col("override"))
    checked = (
        looked_up.withColumn("name", name)
        .withColumn("final_action", action)
        .withColumn(
            "fault",
            F.when(F.col("queued").isNull(), F.lit("unknown"))
            .when(F.col("settled"), F.lit("settled"))
            .when(F.col("name") == "", F.lit("unnamed"))
            .when(
                F.coalesce(F.col("confirmation") != F.col("current_confirmation"), F.lit(True)),
                F.lit("stale"),
            )
            .when(F.col("final_action").isNull(), F.lit("bad_override")),
        )
    )
    winners = (
        checked.where("fault is null")
        .groupBy("exception_id")
        .agg(F.min("ord").alias("winning_ord"))
    )
    judged = lookup(checked, winners, ["exception_id"], "left", config.hot_key_rows)
    later = F.col("winning_ord").isNotNull() & (F.col("ord") > F.col("winning_ord"))
    status = (
        F.when(F.col("fault") == "unknown", F.lit("unknown"))
        .when(later | F.coalesce(F.col("fault") == "settled", F.lit(False)), F.lit("already_resolved"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .otherwise(F.lit("resolved"))
    )
    message = (
        F.when(
            F.col("status") == "unknown",
            F.concat("exception_id", F.lit(" is not in the review queue")),
        )
        .when(
            F.col("status") == "already_resolved",
            F.concat("exception_id", F.lit(" was already decided")),
        )
        .when(F.col("status") == "unnamed", F.lit(TEXT_UNNAMED_APPROVER))
        .when(F.col("status") == "stale", F.lit(TEXT_STALE_VIEW))
        .when(F.col("status") == "bad_override", F.lit(TEXT_BAD_OVERRIDE))
        .otherwise(F.lit(""))
    )
    reasons = F.concat(
        "card_reasons", review_reasons(F.col("review_action"), F.col("name"), F.col("note"))
    )
    return (
        judged.withColumn("status", status)
        .withColumn("message", message)
        .withColumn("reasons", F.when(F.col("status") == "resolved", reasons))
        .withColumn(
            "final_action", F.when(F.col("status") == "resolved", F.col("final_action"))
        )
        .drop("fault", "winning_ord", "queued", "settled", "current_confirmation", "card_reasons")
    )
