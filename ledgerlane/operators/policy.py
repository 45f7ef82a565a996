"""The gate: exceptions and proposals in, decisions out, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.config import DEFAULTS, ReconConfig
from ledgerlane.fixed_values import (
    RULE_ACTION_OF_CLASS,
    SUBMITTABLE,
    TEXT_NO_EVIDENCE,
    TEXT_NO_FINDING,
    TEXT_REJECT_NEEDS_HUMAN,
    TEXT_STRAIGHT_THROUGH,
    TIER_OF_CLASS,
)
from ledgerlane.functions import money
from ledgerlane.functions.digests import two_places


def from_table(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def route(exception_class: Column) -> Column:
    return from_table(exception_class, TIER_OF_CLASS)


def has_articulable_reason(rationale: Column, evidence: Column) -> Column:
    return F.coalesce((F.trim(rationale) != "") & (F.size(evidence) > 0), F.lit(False))


def is_irreversible(action: Column) -> Column:
    return action == "REJECT"


def _decision(action: Column, human: bool, escalated: bool, *reasons: Column) -> Column:
    return F.struct(
        action.alias("action"),
        F.lit(human).alias("requires_human"),
        F.lit(escalated).alias("escalated"),
        F.array(*reasons).alias("reasons"),
    )


def decide(
    exceptions: DataFrame, findings: DataFrame, config: ReconConfig = DEFAULTS
) -> DataFrame:
    """One decision per exception. ``findings`` has at most one row per ``exception_id``."""
    proposals = findings.select(
        "exception_id",
        F.struct("proposed_class", "proposed_action", "confidence", "rationale", "evidence").alias(
            "finding"
        ),
    )
    joined = exceptions.join(proposals, "exception_id", "left")
    finding, cls, amount = F.col("finding"), F.col("exception_class"), F.col("amount_at_risk")
    rule_action = from_table(cls, RULE_ACTION_OF_CLASS)
    by_rule = F.concat(cls, F.lit(f" is closed by rule under ruleset {config.ruleset_version}"))
    confidence = two_places(finding["confidence"])
    action = finding["proposed_action"]
    proposed = F.concat(
        F.lit("agent proposed "), action, F.lit(" with confidence "), confidence
    )
    pending = F.lit("PENDING")
    ceiling = money.literal(config.auto_accept_ceiling)
    decision = (
        F.when(rule_action == "REJECT", _decision(rule_action, True, False, by_rule))
        .when(rule_action.isNotNull(), _decision(rule_action, False, False, by_rule))
        .when(finding.isNull(), _decision(pending, True, True, F.lit(TEXT_NO_FINDING)))
        .when(
            ~has_articulable_reason(finding["rationale"], finding["evidence"]),
            _decision(pending, True, True, F.lit(TEXT_NO_EVIDENCE)),
        )
        .when(
            finding["confidence"] < config.confidence_floor,
            _decision(
                pending,
                True,
                True,
                F.concat(
                    F.lit("confidence "),
                    confidence,
                    F.lit(f" below floor {config.confidence_floor:.2f}"),
                ),
            ),
        )
        .when(
            is_irreversible(action),
            _decision(action, True, False, proposed, F.lit(TEXT_REJECT_NEEDS_HUMAN)),
        )
        .when(
            (action == "ACCEPT") & (amount > ceiling),
            _decision(
                action,
                True,
                False,
                proposed,
                F.concat(
                    F.lit("tax value "),
                    money.plain(amount),
                    F.lit(f" exceeds the auto-accept ceiling {config.auto_accept_ceiling}"),
                ),
            ),
        )
        .otherwise(_decision(action, False, False, proposed, F.lit(TEXT_STRAIGHT_THROUGH)))
    )
    return joined.withColumn("_decision", decision).select("*", "_decision.*").drop("_decision")


def submittable(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("requires_human") & F.col("action").isin(*SUBMITTABLE))
